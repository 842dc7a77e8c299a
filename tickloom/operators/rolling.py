"""Rolling refits: which rows train and which are predicted at each refit of a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _div(a, b: int):
    """Whole steps toward minus infinity, in integers."""
    b_ = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b_), b_)


def refit_grid(df: DataFrame, groups: Sequence[str], ts: str, train: int, step: int) -> DataFrame:
    """(groups, first, last, refits): the first refit, ``train`` after the first row, and the number of refits up to the last row.

    Groups that end by their first refit have none and are left out.
    """
    day = df.groupBy(*groups).agg((F.min(ts) + F.lit(train).cast("long")).alias("first"), F.max(ts).alias("last"))
    return day.filter("first < last").withColumn("refits", _div(F.col("last") - F.col("first"), step) + 1)


def assign(df: DataFrame, groups: Sequence[str], ts: str, train: int, step: int, purge: int = 0) -> DataFrame:
    """A copy of each row for every refit that it trains (``test`` false) and the one that predicts it (true).

    Refit k is at first + k * step; it trains on [refit - train, refit) and predicts [refit, refit + step). The refits are
    found by arithmetic, so that no range join is needed. ``purge`` ends the training rows that much earlier.
    """
    grid = refit_grid(df, groups, ts, train, step)
    at = df.join(grid, list(groups))
    k = _div(F.col(ts) - F.col("first"), step)
    lo = F.greatest(_div(F.col(ts) + F.lit(purge).cast("long") - F.col("first"), step) + 1, F.lit(0).cast("long"))
    hi = F.least(_div(F.col(ts) + F.lit(train).cast("long") - F.col("first"), step), F.col("refits") - 1)
    one = lambda k, test: F.struct(k.alias("refit"), F.lit(test).alias("test"))
    trains = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda x: one(x, False))).otherwise(F.array().cast("array<struct<refit:bigint,test:boolean>>"))
    tests = F.when((k >= 0) & (k < F.col("refits")), F.array(one(k, True))).otherwise(F.array().cast("array<struct<refit:bigint,test:boolean>>"))
    return at.withColumn("__r", F.explode(F.concat(trains, tests))).withColumns({"refit": F.col("__r.refit"), "test": F.col("__r.test")}).drop("__r", "first", "last", "refits")


def mean_baseline(df: DataFrame, groups: Sequence[str], ts: str, y: str, train: int, step: int, least: int) -> DataFrame:
    """Predictions by the mean of the training rows' labels, of refits with enough of them."""
    rows = assign(df, groups, ts, train, step)
    means = rows.filter("not test").groupBy(*groups, "refit").agg(F.avg(y).alias("y_pred"), F.count(F.lit(1)).alias("n_train")).filter(F.col("n_train") >= least)
    return rows.filter("test").join(means, [*groups, "refit"]).drop("test")


def window_statistics(df: DataFrame, groups: Sequence[str], ts: str, columns: Sequence[str], train: int, step: int) -> DataFrame:
    """Of each refit's training rows the exact median (for imputing), mean and population deviation of the columns."""
    aggs = []
    for c in columns:
        aggs += [F.median(c).alias(f"{c}__median"), F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return assign(df, groups, ts, train, step).filter("not test").groupBy(*groups, "refit").agg(F.count(F.lit(1)).alias("n_train"), *aggs)
