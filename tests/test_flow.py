"""Files in, summary out; and the streaming join."""

import datetime as dt
import os
import random

import pandas as pd
import pytest

from tickloom.plans import experiment
from tickloom.plans.config import Settings
from tickloom.sources import io
from tickloom.streaming.asof_stream import enrich_stream

OPEN = int(dt.datetime(2025, 12, 1, 14, 30, tzinfo=dt.UTC).timestamp()) * 10**9


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    r, folder = random.Random(1), tmp_path_factory.mktemp("data")
    trades, quotes = [], []
    for root, spot in (("AAPL", 280), ("T", 25)):
        for k in range(2):
            symbol, t, p, seq = f"O:{root}251205{'CP'[k]}{spot * 1000:08d}", OPEN, 5.0, 0
            for _ in range(700):
                t += int(r.expovariate(1 / 5) * 1e9) + 1
                p = max(1.0, p + r.choice([-0.05, 0, 0.05]))
                quotes.append((symbol, 1, round(p + 0.05, 2), 9, 1, round(p - 0.05, 2), 8, seq := seq + 1, t))
                trades.append((symbol, "209", 0, 1, round(p + r.choice([-0.05, 0, 0.05]), 2), t + 1000, r.randint(1, 9)))
    quotes.append(("O:XYZ251205C00001000", 1, 1.0, 1, 1, 0.9, 1, 1, OPEN))
    pd.DataFrame(trades, columns="ticker conditions correction exchange price sip_timestamp size".split()).to_csv(folder / "t.csv.gz", index=False)
    pd.DataFrame(quotes, columns="ticker ask_exchange ask_price ask_size bid_exchange bid_price bid_size sequence_number sip_timestamp".split()).to_csv(folder / "q.csv.gz", index=False)
    pd.DataFrame({"Ticker": ["AAPL"], "px": [281.0], "Status": ["OK"]}).to_csv(folder / "spot.csv", index=False)
    return folder


def test_tables_are_built_once(spark, files, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.ensure_tables(spark, str(files), str(tmp_path), "absent.csv", "q.csv.gz")
    trades, quotes = io.ensure_tables(spark, str(files), str(tmp_path), "t.csv.gz", "q.csv.gz")
    assert io.ensure_tables(spark, "nowhere", str(tmp_path), "t.csv.gz", "q.csv.gz") == (trades, quotes)
    assert spark.read.parquet(trades).count() == 2800 and spark.read.parquet(quotes).count() == 2800
    assert {p for p in os.listdir(trades) if "=" in p} == {"date=2025-12-01"}
    assert io.scan_prefix(spark.read.parquet(quotes), "T").count() == 1400
    assert io.load_quotes(spark, str(files / "q.csv.gz"), rows=5).count() == 5


def test_experiment(spark, files, tmp_path):
    trades, quotes = io.ensure_tables(spark, str(files), str(tmp_path), "t.csv.gz", "q.csv.gz")
    t, q = spark.read.parquet(trades), spark.read.parquet(quotes)
    spots = io.read_spots(spark, str(files / "spot.csv"), "px")
    settings = Settings(horizons=(5, 30), caps=(0.08, 0.12), spans=((0, 5), (5, 60)), models=("Ridge", "XGBoost"))
    counts = experiment.run(t, q, spots, settings, models=False).collect()
    assert {(r.underlying, r.moneyness, r.horizon) for r in counts} == {(u, c, h) for u in ("AAPL", "T") for c in (0.08, 0.12) for h in (5, 30)}
    assert all(r.n_feat_rows > 1000 for r in counts)
    result = experiment.run(t, q, spots, settings)
    rows = result.collect()
    assert len(rows) == 16 and all(r.n > 100 and r.rmse > 0 and 0 <= r.dir_acc <= 1 for r in rows)
    path = str(tmp_path / "summary.csv")
    for _ in range(2):
        io.write_summary(spark.createDataFrame(rows, result.schema), path)
    assert len(pd.read_csv(path)) == 16


def test_command_line(files, tmp_path, spark):
    experiment.main(["--data-dir", str(files), "--output-dir", str(tmp_path), "--trade-csv", "t.csv.gz", "--quote-csv", "q.csv.gz", "--tickers", "AAPL, T", "--no-models"])
    assert len(pd.read_csv(tmp_path / "summary_experiment.csv")) == 36


def test_settings_of_the_session_stay(spark, files, tmp_path):
    before = spark.conf.get("spark.sql.constraintPropagation.enabled")
    trades, quotes = io.ensure_tables(spark, str(files), str(tmp_path), "t.csv.gz", "q.csv.gz")
    experiment.run(spark.read.parquet(trades), spark.read.parquet(quotes), io.read_spots(spark, str(tmp_path / "absent.csv"), "px"), Settings(horizons=(5,), caps=(0.1,), spans=((0, 5),)), models=False)
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == before


def test_stream_gives_the_latest_quote(spark, tmp_path):
    t, q = str(tmp_path / "t"), str(tmp_path / "q")
    quote, trade = "ticker string, quote_ts bigint, sequence_number bigint, bid_price double, ask_price double", "ticker string, trade_ts bigint, price double"
    spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("b", 1, 3.0)], trade).write.parquet(t)
    spark.createDataFrame([("a", 5, 1, 1.1, 1.2), ("a", 7, 2, 1.3, 1.4), ("a", 7, 1, 7.3, 7.4), ("b", 2, 1, 9.0, 9.1)], quote).write.parquet(q)
    streams = [spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in (t, q)]

    def batch():
        run = enrich_stream(*streams, keep=100).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
        run = run.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.select("ticker", "trade_ts", "quote_ts", "bid_price").collect())).trigger(availableNow=True).start()
        run.awaitTermination(120)

    seen = []
    batch()
    assert sorted(seen) == [("a", 5, 5, 1.1), ("a", 9, 7, 1.3), ("b", 1, None, None)]
    # a later batch: a newer quote, a trade that comes late and one after it
    seen = []
    spark.createDataFrame([("a", 60, 9, 5.0, 5.1)], quote).write.mode("append").parquet(q)
    spark.createDataFrame([("a", 8, 1.0), ("a", 61, 1.0)], trade).write.mode("append").parquet(t)
    batch()
    assert sorted(seen) == [("a", 8, 7, 1.3), ("a", 61, 60, 5.0)]
