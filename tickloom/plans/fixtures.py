"""The shared test tables read as ticks; one reference second is one hour here.

Clicks, purchases and signups are trades, views and errors are quotes, a user is a contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.asof import asof_join
from tickloom.operators.clean import add_spread

HOUR = 3_600_000_000
TRADE_TYPES = ("click", "purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    at = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return ev.select("event_id", F.col("user_id").alias("ticker"), at.alias("t"), F.to_date("ts").alias("date"), "ts", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ticks(spark, sf_dir).filter(F.col("event_type").isin(*TRADE_TYPES))
    return x.select("ticker", F.col("t").alias("trade_ts"), "date", "event_type", F.col("value").alias("price"), F.col("k").alias("size"), "event_id")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ticks(spark, sf_dir).filter(~F.col("event_type").isin(*TRADE_TYPES))
    k, v = F.col("k"), F.col("value")
    return x.select("ticker", F.col("t").alias("quote_ts"), v.alias("bid_price"), (v * (1 + k / F.lit(1000.0))).alias("ask_price"), (k % 7).alias("bid_size"), (k % 5).alias("ask_size"), (k % 3).alias("bid_exchange"), (k % 4).alias("ask_exchange"), F.col("event_id").alias("sequence_number"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join(trades(spark, sf_dir), quotes(spark, sf_dir))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with a quote, and its mid and spread."""
    return add_spread(merged(spark, sf_dir).filter("quote_ts is not null"))


def spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``priced`` with some crossed quotes, outliers and wide ratios, which the tables have none of."""
    i, bid, ask = F.col("event_id"), F.col("bid_price"), F.col("ask_price")
    x = merged(spark, sf_dir).filter("quote_ts is not null")
    crossed, far, wide = i % 97 == 0, i % 101 == 0, i % 89 == 0
    new_bid = F.when(crossed, ask).when(far, bid * 100).otherwise(bid)
    new_ask = F.when(crossed, bid).when(far, ask * 100).when(wide, bid * 8).otherwise(ask)
    return add_spread(x.withColumns({"bid_price": new_bid, "ask_price": new_ask}))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as option trades: a supplier is an underlying, a part a contract."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("underlying"), F.col("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") * 4 - 4).alias("expiry"), (900 + F.col("l_partkey") % 1000).cast("double").alias("strike"), F.col("l_quantity").alias("size"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of two thirds of the underlyings."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0")
    return s.select(F.col("s_suppkey").alias("underlying"), (1000 + F.col("s_suppkey") % 400).cast("double").alias("spot"))
