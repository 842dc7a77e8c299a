"""Cleaning rules for aligned trades and quotes, their counts, and the merge of simultaneous trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import coerce, holds, ratio
from tickloom.operators.windows import tie_order

NUMBERS = ("price", "size", "bid_price", "ask_price", "bid_size", "ask_size")
RULES = {
    "c1": "zero_or_nonpositive_price_or_size",
    "c2": "negative_spread",
    "c3": "both_bid_ask_size_le_1",
    "c4": "spread_gt_50x_daily_median",
    "c5": "mid_gt_10x_rolling_mean_abs_dev_from_centered_median",
    "c6": "ask_bid_ratio_gt_5",
    "c7": "trade_price_outside_bid_minus_spread__ask_plus_spread",
}
ANY = "any_rule"


def add_spread(df: DataFrame) -> DataFrame:
    bid, ask = F.col("bid_price"), F.col("ask_price")
    return df.withColumns({"spread": ask - bid, "mid": (ask + bid) / 2})


def add_rolling_deviation(df: DataFrame, key: str = "ticker", order: Sequence[str] = ("date", "trade_ts"), rows: int = 50, least: int = 25) -> DataFrame:
    """rolling_med_mid, abs_dev_mid and rolling_mean_abs_dev_mid over a centred window of rows of the key.

    The window has ``rows`` rows, one more before than after, and crosses days; with fewer than ``least`` values there
    is none. Rows of one time are in the order of ``tie_order``.
    """
    df = df.withColumn("__tie", tie_order(df))
    frame = Window.partitionBy(key).orderBy(*order, "__tie").rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    enough = lambda c, v: F.when(F.count(c).over(frame) >= least, v)
    df = df.withColumn("rolling_med_mid", enough("mid", F.expr("percentile(mid, 0.5)").over(frame)))
    df = df.withColumn("abs_dev_mid", F.abs(F.col("mid") - F.col("rolling_med_mid")))
    return df.withColumn("rolling_mean_abs_dev_mid", enough("abs_dev_mid", F.avg("abs_dev_mid").over(frame))).drop("__tie")


def rule_columns() -> dict[str, Column]:
    """Whether each rule holds, by its short name; false where it can't be decided."""
    c = F.col
    low = lambda name: holds(c(name) <= 0)
    any_low = low(NUMBERS[0])
    for name in NUMBERS[1:]:
        any_low = any_low | low(name)
    return {
        "c1": any_low,
        "c2": holds(c("spread") < 0),
        "c3": holds((c("bid_size") <= 1) & (c("ask_size") <= 1)),
        "c4": holds(c("spread") > 50 * c("day_median_spread")),
        "c5": holds(c("abs_dev_mid") > 10 * c("rolling_mean_abs_dev_mid")),
        "c6": holds(ratio(c("ask_price"), c("bid_price")) > 5),
        "c7": holds(c("price") < c("bid_price") - c("spread")) | holds(c("price") > c("ask_price") + c("spread")),
    }


def flag_rules(df: DataFrame, key: str = "ticker", order: Sequence[str] = ("date", "trade_ts")) -> DataFrame:
    """``df`` with the derived columns, a column per rule and ``bad``, the union of all rules.

    No rule sees another's effect; two windows over the key and one over key and date do all.
    """
    df = add_spread(df.withColumns({n: coerce(F.col(n)) for n in NUMBERS if n in df.columns}))
    df = add_rolling_deviation(df, key, order)
    df = df.withColumn("day_median_spread", F.median("spread").over(Window.partitionBy(key, "date")))
    rules = rule_columns()
    df = df.withColumns(rules)
    bad = F.col("c1")
    for name in list(rules)[1:]:
        bad = bad | F.col(name)
    return df.withColumn("bad", bad)


def clean_rows(df: DataFrame, **how) -> DataFrame:
    """The rows that no rule rejects, with spread, mid and the rolling columns."""
    flagged = df if "bad" in df.columns else flag_rules(df, **how)
    return flagged.filter(~F.col("bad")).drop(*RULES, "bad", "day_median_spread")


def rule_counts(flagged: DataFrame) -> DataFrame:
    """(rule, count): one row a rule and one for their union, which isn't their sum."""
    names = [*RULES, "bad"]
    one = flagged.agg(*(F.coalesce(F.sum(F.col(n).cast("long")), F.lit(0)).cast("long").alias(n) for n in names))
    shown = [*RULES.values(), ANY]
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("rule"), F.col(n).alias("count")) for n, s in zip(names, shown)))).alias("r")).select("r.rule", "r.count")


FIRST = ("conditions", "correction", "exchange", "dt", "date", "underlying", "expiry", "cp_flag", "strike", "dt_utc", "dt_et", "dt_ct", "trade_dt", "ask_exchange", "bid_exchange", "sequence_number", "quote_ts", "quote_dt")


def merge_simultaneous(df: DataFrame, key: str = "ticker", ts: str = "trade_ts", sum_quote_sizes: bool = True) -> DataFrame:
    """One row per (key, time): medians of prices, sums of sizes, and of other columns the first non-null by quote time.

    Trades of one time usually meet one quote; then the first in the file counts (see ``tie_order``). Spread and mid come from the medians. ``sum_quote_sizes=False`` takes the first quote sizes instead.
    """
    order = F.struct(*(F.col(c) for c in ("quote_ts", "sequence_number") if c in df.columns), tie_order(df).alias("tie"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    sizes = ["size", *(("ask_size", "bid_size") if sum_quote_sizes else ())]
    aggs = []
    for c in df.columns:
        if c in ("price", "ask_price", "bid_price"):
            aggs.append(F.median(c).alias(c))
        elif c in sizes:
            aggs.append(F.sum(c).alias(c))
        elif c in FIRST or c in ("ask_size", "bid_size"):
            aggs.append(first(c))
    return add_spread(df.groupBy(key, ts).agg(*aggs))
