"""Tables written to the folder that the driver and all executors share.

Iterative plans cut their lineage by writing a table and reading it back; losing an executor then costs no more than
the stage that was running.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is made only in local mode, where it is unset."""
    where = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="plumbline-")
    return f"file://{_own[app]}"


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def note(path: str) -> None:
    """Puts a path on the list of the innermost open ``scope`` of this thread."""
    if open_ := getattr(_scopes, "open", None):
        open_[-1].append(path)


def materialize(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; returns the table read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    note(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, name: str = "table") -> DataFrame:
    """``materialize`` for tables that a lazy result goes on reading."""
    return materialize(df, name)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    fs, at = _filesystem(spark, path)
    fs.delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that this thread writes within, once what was asked of them is written itself.

    It gives the list of their paths: those taken off it stay. Lazy results of what is deleted can't be read afterwards.
    """
    own: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), own]
    try:
        yield own
    finally:
        _scopes.open = _scopes.open[:-1]
        for path in own:
            drop(spark, path)
