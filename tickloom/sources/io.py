"""Reading and writing tick files, on any file system that Spark reads."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.symbols import of_roots, parse_symbol
from tickloom.functions.times import clock_columns
from tickloom.operators.windows import TRADE_ORDER
from tickloom.plans.config import UNDERLYINGS
from tickloom.sources.schemas import QUOTE_COLUMNS, QUOTES, TRADES

CHECKPOINT_DIR = "spark.checkpoint.dir"


def _at(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM's."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, removed with the session; a temporary folder where a local master has none."""
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set(CHECKPOINT_DIR, path)
    path = f"{path.rstrip('/')}/tickloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _at(spark, path)
        fs.delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, rows: int | None = None, order: str | None = None) -> DataFrame:
    """A CSV with a header; columns are matched by name. With ``schema`` nothing is inferred; ``rows`` keeps the first ones.

    A folder's files follow each other by name, and each task keeps no more than ``rows`` of them. One gzip file is read no further.
    ``order`` names a column for the rows' order in the file. A gzip file is one stream, so one task reads it and the
    rows are spread right after.
    """
    if schema is None:
        df = spark.read.csv(path, header=True, inferSchema=True)
    else:
        present = spark.read.csv(path, header=True).columns
        kinds = {c.strip().split()[0]: c.strip().split()[1] for c in schema.split(",")}
        df = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in present))
    if order:
        df = df.withColumn(order, F.monotonically_increasing_id())
    if rows is not None:
        files = df.inputFiles()
        if len(files) == 1 and files[0].endswith(".gz"):
            return df.limit(rows)
        place = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()}
        return df.withColumns(place).orderBy(*place).limit(rows).drop(*place)
    return df.repartition(spark.sparkContext.defaultParallelism) if str(path).endswith(".gz") else df


def load_trades(spark: SparkSession, path: str, underlyings: Sequence[str] | None = None) -> DataFrame:
    """Trades with their order, clock columns and parsed symbols, of some underlyings or all."""
    df = read_csv(spark, path, TRADES, order=TRADE_ORDER)
    df = df.withColumns(clock_columns(F.col("sip_timestamp"))).withColumns(parse_symbol(F.col("ticker")))
    return df if underlyings is None else df.filter(F.col("underlying").isin(list(underlyings)))


def load_quotes(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    return read_csv(spark, path, QUOTES, rows)


def filter_quotes(quotes: DataFrame, roots: Sequence[str] = UNDERLYINGS) -> DataFrame:
    """The nine quote columns of symbols with one of the roots."""
    return quotes.filter(of_roots(F.col("ticker"), roots)).select(*QUOTE_COLUMNS)


def scan_prefix(df: DataFrame, underlying: str) -> DataFrame:
    """Quotes whose symbol begins with O: and the underlying's name; longer names that share it come along."""
    return df.filter(F.col("ticker").startswith(f"O:{underlying}"))


def write_trades(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("date", "underlying").parquet(path)


def write_quotes(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One CSV file with a header; what was there is replaced. A summary has a row a cell and model, so one task writes it."""
    folder = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").csv(folder, header=True)
    fs, target = _at(df.sparkSession, path)
    _, parts = _at(df.sparkSession, folder)
    part = next(s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().endswith(".csv"))
    fs.delete(target, True)
    fs.rename(part, target)
    fs.delete(parts, True)


def read_spots(spark: SparkSession, path: str | None, price: str) -> DataFrame:
    """(underlying, spot) from a CSV with a Ticker column; empty without a file."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], "underlying string, spot double")
    return spark.read.csv(path, header=True).select(F.col("Ticker").alias("underlying"), F.col(f"`{price}`").try_cast("double").alias("spot"))


def ensure_tables(spark: SparkSession, data_dir: str, out_dir: str, trade_csv: str, quote_csv: str, roots: Sequence[str] = UNDERLYINGS) -> tuple[str, str]:
    """Paths of the trade and quote tables, built from the CSV files where they are absent."""
    trades, quotes = f"{out_dir}/trades.parquet", f"{out_dir}/quotes.parquet"
    for table, source, build in (
        (trades, f"{data_dir}/{trade_csv}", lambda p: write_trades(load_trades(spark, p, roots), trades)),
        (quotes, f"{data_dir}/{quote_csv}", lambda p: write_quotes(filter_quotes(load_quotes(spark, p), roots), quotes)),
    ):
        if not exists(spark, table):
            if not exists(spark, source):
                raise FileNotFoundError(f"neither {table} nor its source {source} is there")
            build(source)
    return trades, quotes
