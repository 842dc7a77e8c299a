"""Calendar-time frames over an integer time key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: The place of a trade in its file; ``load_trades`` adds it.
TRADE_ORDER = "trade_order"


def tie_order(df: DataFrame) -> Column:
    """What orders rows of equal times: their place in the file, or else a hash of the whole row, so that the order of input never matters."""
    if TRADE_ORDER in df.columns:
        return F.col(TRADE_ORDER)
    return F.xxhash64(*sorted(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))



def span_label(left: float, right: float) -> str:
    """0, 5 -> 0_5s; 0.5, 1 -> 0p5_1s."""
    return f"{left:g}_{right:g}s".replace(".", "p")


def past(groups: Sequence[str], ts: str, left: float, right: float, tick: int) -> WindowSpec:
    """Rows of (T - right, T - left]; with left = 0 the row itself belongs to it."""
    return Window.partitionBy(*groups).orderBy(ts).rangeBetween(1 - int(right * tick), -int(left * tick))


def future(groups: Sequence[str], ts: str, horizon: float, tick: int) -> WindowSpec:
    """Rows of (T, T + horizon]; rows of one time don't see each other."""
    return Window.partitionBy(*groups).orderBy(ts).rangeBetween(1, int(horizon * tick))
