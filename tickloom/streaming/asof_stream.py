"""Streaming as-of enrichment: each arriving trade gets the latest earlier quote of its key.

Not part of the batch feature set; it is the same join for a live feed. The state of a key is its
quotes of the last ``keep`` ticks of time and the one before them, so a trade that comes late, by at most ``keep``, gets the quote
that the batch join would give it from the quotes that have come. Of quotes with one time the highest sequence number wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "ticker string, trade_ts bigint, price double, quote_ts bigint, bid_price double, ask_price double"
STATE = "quote_ts array<bigint>, seq array<bigint>, bid_price array<double>, ask_price array<double>"
KEEP = 60_000_000_000


def enrich_stream(trades: DataFrame, quotes: DataFrame, keep: int = KEEP) -> DataFrame:
    """Streams of (ticker, trade_ts, price) and (ticker, quote_ts, bid_price, ask_price[, sequence_number]) to trades with quotes."""
    none = F.lit(None)
    seq = F.col("sequence_number") if "sequence_number" in quotes.columns else F.lit(0)
    t = trades.select("ticker", F.col("trade_ts").alias("at"), F.lit(1).alias("side"), none.cast("long").alias("seq"), "price", none.cast("double").alias("bid_price"), none.cast("double").alias("ask_price"))
    q = quotes.select("ticker", F.col("quote_ts").alias("at"), F.lit(0).alias("side"), seq.cast("long").alias("seq"), none.cast("double").alias("price"), "bid_price", "ask_price")

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        new, asked = rows[rows["side"] == 0], rows[rows["side"] == 1].sort_values(["at", "price"])
        held = [np.asarray(c) for c in state.get] if state.exists else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        ts, order, bid, ask = (np.concatenate([h, new[c].to_numpy(k)]) for h, c, k in zip(held, ("at", "seq", "bid_price", "ask_price"), (np.int64, np.int64, float, float)))
        by = np.lexsort((order, ts))
        ts, order, bid, ask = ts[by], order[by], bid[by], ask[by]
        if len(asked):
            k = np.searchsorted(ts, asked["at"].to_numpy(np.int64), "right") - 1
            fits = k >= 0
            out = pd.DataFrame({"ticker": key[0], "trade_ts": asked["at"].to_numpy(), "price": asked["price"].to_numpy()})
            for name, values in (("quote_ts", ts), ("bid_price", bid), ("ask_price", ask)):
                out[name] = pd.Series([values[i].item() if f else None for i, f in zip(k, fits)], dtype=object)
            yield out
        if len(ts):
            first = max(0, int(np.searchsorted(ts, ts[-1] - keep)) - 1)
            state.update(tuple(x[first:].tolist() for x in (ts, order, bid, ask)))

    return q.unionByName(t).groupBy("ticker").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
