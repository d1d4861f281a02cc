"""Small helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]"
NO_ID = -(1 << 63)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is unset and all tasks run on this machine, as in tests, a temporary folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder()
    path = f"{base.rstrip('/')}/umbra-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    for own in _SCOPES.get():
        own.append(path)
    return path


#: Paths handed out and not dropped yet, in order.
_MADE: list[str] = []
#: The lists of the scopes that are open in this thread.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope():
    """A list of the paths that are handed out inside, in this thread; other runs and threads have their own."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield own
    finally:
        _SCOPES.reset(token)


def drop_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete intermediate tables, all of this session's by default. Only what has been computed from them and written is left then."""
    folders = spark._jvm.org.apache.hadoop.fs
    for p in _MADE.copy() if paths is None else paths:
        at = folders.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if p in _MADE:  # it may have been dropped before
            _MADE.remove(p)


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="umbra-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stored(), with the path, for drop_tables()."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: What operators remember in a Python worker, by operator: how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    _REMEMBERED[owner] = forget


def alone(owner: str = "") -> None:
    """In a Python worker that serves one operator after another: forget what others remember, and give free memory back."""
    for name in [n for n in _REMEMBERED if n != owner]:
        _REMEMBERED.pop(name)()
    trim()


def trim() -> None:
    """Give memory that is free back to the system, for workers stay after their task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
