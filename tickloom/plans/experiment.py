"""The whole experiment as one lazy plan over all underlyings, caps and horizons, and its command line.

Features depend on neither horizon nor cap, so they are computed once for each contract-day; caps and
horizons then select and label rows of the same table.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.numeric import normalise
from tickloom.functions.times import NEW_YORK, in_session, instant, wall
from tickloom.operators.asof import asof_join
from tickloom.operators.clean import clean_rows, merge_simultaneous
from tickloom.operators.direction import add_direction
from tickloom.operators.features import add_features, filled_columns, predictor_columns
from tickloom.operators.labels import COUNT, FUTURE, LABEL, add_labels
from tickloom.operators.metrics import evaluate
from tickloom.operators.models import rolling_predict
from tickloom.operators.select import add_dte, add_moneyness, add_spot, at_least, explode_caps, in_dte, keep_top
from tickloom.plans.config import Settings
from tickloom.sources.io import ensure_tables, read_spots, scratch, setting, write_summary


#: Closing prices that are read where the command line names no file.
SPOT_CSV = "spot_prices.csv"


def align(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades with the latest quote of their symbol; times renamed to trade_ts and quote_ts."""
    t = trades.withColumnRenamed("sip_timestamp", "trade_ts").withColumn("trade_dt", instant(F.col("trade_ts")))
    q = quotes.withColumnRenamed("sip_timestamp", "quote_ts").withColumn("quote_dt", instant(F.col("quote_ts")))
    return asof_join(t, q)


def tidy(merged: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Same exchange, complete rows, regular hours, cleaning rules, one row per time."""
    df = merged.withColumn("dt_et", wall(instant(F.col("trade_ts")), NEW_YORK))
    if settings.same_exchange and "ask_exchange" in df.columns:
        df = df.filter(F.col("ask_exchange") == F.col("bid_exchange"))
    df = normalise(df)
    df = df.na.drop("any").filter(in_session(F.col("dt_et")))
    return merge_simultaneous(clean_rows(df), sum_quote_sizes=settings.sum_quote_sizes)


def feature_table(trades: DataFrame, quotes: DataFrame, spots: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each cleaned tick near expiry with its direction, features and the labels of all horizons.

    Plan it under ``spark.sql.constraintPropagation.enabled = false``, as ``run`` does: hundreds of guarded columns make the
    optimiser's derived constraints grow without end, and no filter needs them.
    """
    trades = at_least(trades.filter(F.col("underlying").isin(list(settings.underlyings))), ["underlying"], settings.min_rows)
    df = add_dte(tidy(align(trades, quotes), settings))
    df = add_moneyness(in_dte(add_spot(df, spots, low=settings.dte[0], high=settings.dte[1]), *settings.dte))
    df = df.filter(F.col("abs_moneyness") <= max(settings.caps))
    df = df.withColumn("trade_dt_et", wall(instant(F.col("trade_ts")), NEW_YORK))
    how = {"groups": settings.groups, "tick": settings.tick}
    df = add_labels(df, settings.horizons, **how)
    return add_features(add_direction(df, settings.groups), settings.spans, **how)


def cells(features: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``features`` by (underlying, moneyness, horizon): top contracts of each cap, and one label column."""
    df = keep_top(explode_caps(features, settings.caps), ("underlying", "moneyness"), n=settings.top_contracts)
    df = at_least(df, ["underlying", "moneyness"], settings.min_rows)
    names = (FUTURE, COUNT, LABEL)
    labels = F.array(*(F.struct(F.lit(int(h)).alias("horizon"), *(F.col(f"{n}__h{h:g}").alias(n) for n in names)) for h in settings.horizons))
    held = [c for c in df.columns if not c.startswith(tuple(f"{n}__h" for n in names))]
    df = df.select(*held, F.explode(labels).alias("l")).select(*held, "l.*")
    return at_least(df, ["underlying", "moneyness", "horizon"], settings.min_labels, LABEL)


def run(trades: DataFrame, quotes: DataFrame, spots: DataFrame, settings: Settings = Settings(), models: bool = True) -> DataFrame:
    """A row per cell and model with n, rmse, r2 and dir_acc; without models a row per cell with n_feat_rows.

    The feature table, which all cells read, is written to the shared folder once.
    """
    spark = trades.sparkSession
    path = scratch(spark, "features")
    with setting(spark, "spark.sql.constraintPropagation.enabled", "false"):
        feature_table(trades, quotes, spots, settings).write.parquet(path)
    table = spark.read.parquet(path)
    long = cells(table, settings)
    group = ["underlying", "moneyness", "horizon"]
    if not models:
        return long.groupBy(*group).agg(F.count(F.lit(1)).alias("n_feat_rows"))
    used = filled_columns(table, predictor_columns(table.columns, settings.include_lambda))
    minute = 60 * settings.tick
    purge = lambda h: h * settings.tick if settings.purge_label_overlap else 0
    parts = []
    for p, of in ([(0, None)] if not settings.purge_label_overlap else [(purge(h), h) for h in settings.horizons]):
        rows = long if of is None else long.filter(F.col("horizon") == of)
        parts.append(rolling_predict(rows, used, settings.models, [*group, "date"], y=LABEL, train=settings.train_minutes * minute, step=settings.refit_minutes * minute, least=settings.min_train_rows, keep=("ticker",), purge=p))
    return evaluate(reduce(DataFrame.unionByName, parts), [*group, "model"], LABEL)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Rolling regressions on option trades and quotes")
    p.add_argument("--data-dir", default="dataset")
    p.add_argument("--output-dir", default="output")
    p.add_argument("--trade-csv", default="trades_2025-12-01.csv.gz")
    p.add_argument("--quote-csv", default="quotes_2025-12-01.csv.gz")
    p.add_argument("--no-prepare", action="store_true", help="take the tables as they are in the output folder")
    p.add_argument("--trade-parquet")
    p.add_argument("--quote-parquet")
    p.add_argument("--spot-csv", help=f"prices by Ticker; by default {SPOT_CSV} in the data folder, and without that strikes near expiry stand in")
    p.add_argument("--spot-price-col", default="Close_Price_2025-12-01")
    p.add_argument("--tickers", help="names between commas")
    p.add_argument("--no-models", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if a.trade_parquet and a.quote_parquet:
        trades, quotes = a.trade_parquet, a.quote_parquet
    elif a.no_prepare:
        trades, quotes = f"{a.output_dir}/trades.parquet", f"{a.output_dir}/quotes.parquet"
    else:
        trades, quotes = ensure_tables(spark, a.data_dir, a.output_dir, a.trade_csv, a.quote_csv)
    settings = Settings(underlyings=tuple(t.strip() for t in a.tickers.split(","))) if a.tickers else Settings()
    spots = read_spots(spark, a.spot_csv or f"{a.data_dir}/{SPOT_CSV}", a.spot_price_col)
    result = run(spark.read.parquet(trades), spark.read.parquet(quotes), spots, settings, not a.no_models)
    write_summary(result, f"{a.output_dir}/summary_experiment.csv")


if __name__ == "__main__":
    main()
