"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

#: Paths that each application has handed out and not discarded.
_MADE: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of its own; others must set it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-opslog-")
    return _OWN[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def write_table(df: DataFrame, name: str) -> str:
    """Writes df as Parquet to the shared folder and returns the path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, a lost executor costs nothing, and a second
    use recomputes nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what new_path or write_table made, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.get(spark.sparkContext.applicationId, set()).discard(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what operators have stored inside. Results are lazy and read those tables, so they have to be written or
    collected inside."""
    app = spark.sparkContext.applicationId
    before = set(_MADE.get(app, ()))
    try:
        yield
    finally:
        for path in _MADE.get(app, set()) - before:
            discard(spark, path)


def spare(columns: Iterable[str], base: str) -> str:
    """A column name like base that is not taken yet."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
