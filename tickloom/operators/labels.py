"""Forward return labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import coerce
from tickloom.operators.windows import future
from tickloom.plans.config import CONTRACT_DAY

FUTURE, COUNT, LABEL = "future_avg_trade_price_5s", "n_future_trades_5s", "y_5s_ret"


def add_label(df: DataFrame, horizon: float = 5, groups: Sequence[str] = ("ticker", *CONTRACT_DAY), ts: str = "trade_ts", tick: int = 1_000_000_000, suffix: str = "") -> DataFrame:
    """The plain mean of later prices within the horizon, their number, and their return over mid.

    Column names keep the 5 s whatever the horizon, unless ``suffix`` is given. Rows without a time, price, mid or
    group key are dropped; a mid that isn't positive has no return.
    """
    df = df.withColumns({"price": coerce(F.col("price")), "mid": coerce(F.col("mid"))}).na.drop(subset=[ts, "price", "mid", *groups])
    w = future(groups, ts, horizon, tick)
    mean = F.avg("price").over(w)
    return df.withColumns({FUTURE + suffix: mean, COUNT + suffix: F.count(F.lit(1)).over(w), LABEL + suffix: F.when(F.col("mid") > 0, mean / F.col("mid") - 1)})


def add_labels(df: DataFrame, horizons: Sequence[float], **how) -> DataFrame:
    """All horizons side by side, on one sort: columns get the suffix __h{horizon}."""
    for h in horizons:
        df = add_label(df, h, suffix=f"__h{h:g}", **how)
    return df
