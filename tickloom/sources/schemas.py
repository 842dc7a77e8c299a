"""Schemas of the input files."""

from __future__ import annotations

TRADES = "ticker string, conditions string, correction int, exchange int, price double, sip_timestamp bigint, size bigint"
QUOTES = "ticker string, ask_exchange int, ask_price double, ask_size bigint, bid_exchange int, bid_price double, bid_size bigint, sequence_number bigint, sip_timestamp bigint"
QUOTE_COLUMNS = tuple(c.split()[0] for c in QUOTES.split(", "))
