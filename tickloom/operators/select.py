"""Expiry, spot, moneyness and volume selection of contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite

MAX_BROADCAST_ROWS = 100_000


def add_dte(df: DataFrame, expiry: str = "expiry", date: str = "date") -> DataFrame:
    return df.withColumn("dte", F.datediff(expiry, date))


def in_dte(df: DataFrame, low: int = 0, high: int = 14) -> DataFrame:
    return df.filter(F.col("dte").between(low, high))


def fallback_spot(df: DataFrame, key: str = "underlying", strike: str = "strike", size: str = "size", low: int = 0, high: int = 14) -> DataFrame:
    """(key, fallback): the mean strike of rows near expiry, weighted by size (at least 1e-9)."""
    w = F.greatest(F.col(size).cast("double"), F.lit(1e-9))
    near = in_dte(df, low, high)
    return near.groupBy(key).agg((F.sum(F.col(strike) * w) / F.sum(w)).alias("fallback"))


def add_spot(df: DataFrame, spots: DataFrame, key: str = "underlying", price: str = "spot", **near) -> DataFrame:
    """``df`` with ``spot``: the table's finite price, else the fallback; rows of keys with neither go.

    The table is broadcast when it has at most ``MAX_BROADCAST_ROWS`` rows and joined by shuffle beyond.
    """
    table = spots.select(F.col(key), finite(F.col(price)).alias("__table")).dropDuplicates([key])
    small = table.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    joined = df.join(F.broadcast(table) if small else table, key, "left")
    joined = joined.join(fallback_spot(df, key, **near), key, "left")
    return joined.withColumn("spot", F.coalesce("__table", "fallback")).filter("spot is not null").drop("__table", "fallback")


def add_moneyness(df: DataFrame) -> DataFrame:
    return df.withColumn("abs_moneyness", F.abs(F.col("strike") / F.col("spot") - 1))


def explode_caps(df: DataFrame, caps: Sequence[float]) -> DataFrame:
    """A copy of each row for every cap ``moneyness`` that it meets."""
    return df.withColumn("moneyness", F.explode(F.array(*(F.lit(float(c)) for c in caps)))).filter(F.col("abs_moneyness") <= F.col("moneyness"))


def top_contracts(df: DataFrame, groups: Sequence[str] = ("underlying",), contract: str = "ticker", size: str = "size", n: int = 50) -> DataFrame:
    """(groups, contract, volume, rank) of the n contracts of largest volume in each group; ties by name."""
    volume = df.groupBy(*groups, contract).agg(F.sum(size).alias("volume"))
    order = Window.partitionBy(*groups).orderBy(F.desc("volume"), contract)
    return volume.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def keep_top(df: DataFrame, groups: Sequence[str] = ("underlying",), contract: str = "ticker", size: str = "size", n: int = 50) -> DataFrame:
    top = top_contracts(df, groups, contract, size, n).select(*groups, contract)
    return df.join(top, [*groups, contract], "left_semi")


def at_least(df: DataFrame, groups: Sequence[str], n: int, counted: str | None = None) -> DataFrame:
    """The rows of groups that have at least n rows, or n values of ``counted``."""
    count = F.count(F.col(counted) if counted else F.lit(1)).over(Window.partitionBy(*groups))
    return df.withColumn("__n", count).filter(F.col("__n") >= n).drop("__n")
