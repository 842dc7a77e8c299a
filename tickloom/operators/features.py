"""Thirteen microstructure features over spans of history, and how full the spans are."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.numeric import coerce, finite, ratio
from tickloom.operators.direction import add_direction
from tickloom.operators.windows import past, span_label
from tickloom.plans.config import CONTRACT_DAY, Settings

FAMILIES = ("breadth", "immediacy", "volume_all", "volume_avg", "volume_max", "lambda_", "lob_imbalance", "txn_imbalance", "past_return", "turnover", "autocov", "quoted_spread", "effective_spread")
_SELECT = re.compile("^(?:" + "|".join(FAMILIES) + ")__")
INPUTS = ("price", "size", "mid", "bid_price", "ask_price", "bid_size", "ask_size")


def column_name(family: str, left: float, right: float) -> str:
    return f"{family.rstrip('_')}__{span_label(left, right)}"


def predictor_columns(columns: Sequence[str], include_lambda: bool = False) -> list[str]:
    """Sorted feature columns. By default those of lambda are left out, as their names carry one underscore too few for the pattern."""
    return sorted(c for c in columns if _SELECT.match(c) or include_lambda and c.startswith("lambda__"))


def filled_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those columns that have a value in some row; one aggregate finds them all."""
    if not columns:
        return []
    counts = df.agg(*(F.count(finite(F.col(c))).alias(c) for c in columns)).first()
    return [c for c in columns if counts[c]]


def add_terms(df: DataFrame, groups: Sequence[str], ts: str, seq: str, turnover_base: str | None) -> DataFrame:
    """What the features sum or average, row by row."""
    order = [ts, *([seq] if seq in df.columns else [])]
    w = Window.partitionBy(*groups).orderBy(*order)
    c = F.col
    move = lambda a, b: F.when((a > 0) & (b > 0), F.ln(a / b))
    p0, p1, p2 = c("price"), F.lag("price", 1).over(w), F.lag("price", 2).over(w)
    depth = c("ask_size") + c("bid_size")
    signed = c("size") * c("dir_proxy")
    return df.withColumns(
        {
            "__cov": finite(move(p0, p1) * move(p1, p2)),
            "__quoted": F.when(c("mid") > 0, finite((c("ask_price") - c("bid_price")) / F.when(c("mid") > 0, c("mid")))),
            "__lob": F.when(depth > 0, (c("ask_size") - c("bid_size")) / F.when(depth > 0, depth)),
            "__signed": signed,
            "__effn": F.when((p0 > 0) & (c("mid") > 0), finite(F.ln(p0 / F.when(c("mid") > 0, c("mid"))) * signed * p0)),
            "__effd": F.when(p0 > 0, finite(c("size") * p0)),
            "__mid": F.struct(c("mid")),
            "__seq": F.struct(*order),
            "__base": coerce(c(turnover_base)) if turnover_base and turnover_base in df.columns else F.lit(None).cast("double"),
        }
    )


def span_features(w: WindowSpec, left: float, right: float) -> dict[str, Column]:
    """All features of one span; missing in an empty one."""
    n = F.count(F.lit(1)).over(w)
    some = n > 0
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    volume = total("size")
    traded = some & (volume > 0)
    first = F.min_by("__mid", "__seq").over(w).getField("mid")
    last = F.max_by("__mid", "__seq").over(w).getField("mid")
    weight = total("__effd")
    return {
        "breadth": F.when(some, n.cast("double")),
        "immediacy": ratio(F.lit(float(right - left)), n),
        "volume_all": F.when(some, volume),
        "volume_avg": ratio(volume, n),
        "volume_max": F.max("size").over(w),
        "lambda_": F.when(traded, ratio(last - first, volume)),
        "lob_imbalance": F.avg("__lob").over(w),
        "txn_imbalance": F.when(traded, ratio(total("__signed"), volume)),
        "past_return": F.when(last > 0, 1 - ratio(F.avg("price").over(w), last)),
        "turnover": F.when(some & (F.col("__base") > 0), ratio(volume, F.col("__base"))),
        "autocov": F.avg("__cov").over(w),
        "quoted_spread": F.avg("__quoted").over(w),
        "effective_spread": F.when(weight > 0, ratio(total("__effn"), weight)),
    }


def add_features(df: DataFrame, spans: Sequence[tuple[float, float]] = Settings().spans, groups: Sequence[str] = CONTRACT_DAY, ts: str = "trade_ts", seq: str = "sequence_number", tick: int = 1_000_000_000, turnover_base: str | None = None, families: Sequence[str] = FAMILIES) -> DataFrame:
    """``df`` with a column {family}__{span} for every family and span, and dir_proxy.

    All spans share one partitioning and sort; every frame is a range over the integer time key.
    """
    df = df.withColumns({c: coerce(F.col(c)) for c in INPUTS if c in df.columns})
    if "dir_proxy" not in df.columns:
        df = add_direction(df, groups, ts=ts, seq=seq)
    df = add_terms(df, groups, ts, seq, turnover_base)
    out = {}
    for left, right in spans:
        found = span_features(past(groups, ts, left, right, tick), left, right)
        out.update({column_name(f, left, right): found[f] for f in families})
    df = df.withColumns(out)
    return df.drop("__cov", "__quoted", "__lob", "__signed", "__effn", "__effd", "__mid", "__seq", "__base")


def span_occupancy(df: DataFrame, spans: Sequence[tuple[float, float]] = Settings().spans, groups: Sequence[str] = CONTRACT_DAY, ts: str = "trade_ts", tick: int = 1_000_000_000) -> DataFrame:
    """(span, non_empty_ratio, avg_n_trades_in_window, median_n_trades_in_window): per group, then the plain mean over groups."""
    df = df.na.drop(subset=[ts, *groups])
    counts = [F.struct(F.lit(span_label(a, b)).alias("span"), F.count(F.lit(1)).over(past(groups, ts, a, b, tick)).alias("n")) for a, b in spans]
    cols = {f"__s{i}": c for i, c in enumerate(counts)}
    long = df.withColumns(cols).select(*groups, F.explode(F.array(*cols)).alias("s")).select(*groups, "s.span", "s.n")
    per = long.groupBy(*groups, "span").agg(F.avg((F.col("n") > 0).cast("int")).alias("a"), F.avg("n").alias("b"), F.median("n").alias("c"))
    return per.groupBy("span").agg(F.avg("a").alias("non_empty_ratio"), F.avg("b").alias("avg_n_trades_in_window"), F.avg("c").alias("median_n_trades_in_window"))
