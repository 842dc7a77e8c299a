"""Trade direction: price against mid, else the last price move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import coerce
from tickloom.plans.config import CONTRACT_DAY


def add_direction(df: DataFrame, groups: Sequence[str] = CONTRACT_DAY, price: str = "price", mid: str = "mid", out: str = "dir_proxy", ts: str = "trade_ts", seq: str = "sequence_number") -> DataFrame:
    """+1 above mid, -1 below; at mid or without one the sign of the price move, where no move repeats the last one.

    0 for a group's first row, for a missing price and after one.
    """
    order = [ts, *([seq] if seq in df.columns else [])]
    w = Window.partitionBy(*groups).orderBy(*order)
    df = df.withColumns({price: coerce(F.col(price)), mid: coerce(F.col(mid))})
    df = df.withColumn("__tick", F.signum(F.col(price) - F.lag(price).over(w)))
    carried = F.last(F.when(F.col("__tick") != 0, F.col("__tick")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tick = F.when(F.col("__tick") == 0, F.coalesce(carried, F.lit(0.0))).otherwise(F.col("__tick"))
    quote = F.signum(F.col(price) - F.col(mid))
    side = F.when(F.col(price).isNull(), F.lit(0.0)).when(quote != 0, quote).otherwise(tick)
    return df.withColumn(out, F.coalesce(side, F.lit(0.0)).cast("int")).drop("__tick")
