"""As-of join: each left row with the latest right row of its key at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str | Sequence[str] = "ticker", left_ts: str = "trade_ts", right_ts: str = "quote_ts", tie: str | None = "sequence_number") -> DataFrame:
    """All left rows with a right row's columns, or nulls where none is early enough.

    Both sides are put in one sequence by key and time, and the last right row is carried forward: one
    shuffle and one sort, whatever the sides' sizes. Of right rows with one time the highest ``tie`` wins.
    Rows without a key or a time are dropped.
    """
    by = [by] if isinstance(by, str) else list(by)
    carried = [c for c in right.columns if c not in by]
    own = [c for c in left.columns if c not in by]
    keys = [F.col(c) for c in by]
    rank = F.col(tie).cast("long") if tie and tie in right.columns else F.lit(None).cast("long")
    q = right.na.drop(subset=[*by, right_ts]).select(*keys, F.col(right_ts).cast("long").alias("__at"), F.lit(0).alias("__side"), rank.alias("__tie"), F.struct(*carried).alias("__q"))
    t = left.na.drop(subset=[*by, left_ts]).select(*keys, F.col(left_ts).cast("long").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.struct(*own).alias("__t"))
    both = q.unionByName(t, allowMissingColumns=True)
    seen = Window.partitionBy(*by).orderBy("__at", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__q", F.last("__q", ignorenulls=True).over(seen)).filter("__side = 1")
    order = [F.col(c) if c in by else F.col(f"__t.{c}") for c in left.columns]
    return found.select(*order, *(F.col(f"__q.{c}") for c in carried))
