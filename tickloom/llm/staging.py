"""Intermediate tables in the folder that all executors share.

Lineage is cut with written Parquet tables (never with executor-local copies), so a lost
executor costs a re-read and not a recomputation. Tables go when a later one replaces them, when
the operator that wrote them ends, or with the session.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder for the session; any other
    master raises, as a machine-local folder would be lost with its machine.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    spark.conf.set(CHECKPOINT_DIR, path)
    return path


_tables: dict[str, SparkSession] = {}
_open = threading.local()


def _remove(path: str) -> None:
    spark = _tables.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_tables):
        _remove(path)


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and nothing reads any more; other frames are passed over."""
    for t in tables:
        if getattr(t, "_staged", None) in _tables:
            _remove(t._staged)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread writes inside are removed at the end, but for those passed to the yielded function.

    Use it where all that is read later is kept: a lazy frame over a removed table fails.
    """
    made: list[str] = []
    kept: list[str] = []
    stack = _open.__dict__.setdefault("stack", [])
    stack.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._staged)
        return table

    try:
        yield keep
    finally:
        stack.pop()
        for path in made:
            if path not in kept:
                _remove(path)
        if stack:
            stack[-1] += kept


def materialise(df: DataFrame, label: str, instead_of: Sequence[DataFrame] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    The shuffle files of the writing job are dropped when it ends, as the written table
    replaces them; so are the tables ``instead_of`` which it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    _tables[path] = spark
    if stack := _open.__dict__.get("stack"):
        stack[-1].append(path)
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    release(*instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out
