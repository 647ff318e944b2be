"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space, in regular expressions of Java and of DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, or all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows that go to and from a Python worker at once, where they carry whole texts, and bytes of them but for the last row.
BATCH, BYTES = 1_024, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH`` rows and ``BYTES`` bytes, if they are larger: both sides of a worker hold whole batches, often twice."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH:
        spark.conf.set(rows, str(BATCH))
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) <= BYTES:
        spark.conf.set(size, str(BYTES))


@contextmanager
def batches_for_a_while(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` for what runs within; afterwards the session has its own settings again."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    own = [spark.conf.get(n) for n in names]
    small_batches(spark)
    try:
        yield
    finally:
        for name, value in zip(names, own, strict=True):
            spark.conf.set(name, value)


def free(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has, in any case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    made = f"_{name}"
    while made.lower() in taken:
        made = f"_{made}"
    return made


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of one byte a character take the faster function, which does the same to them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts a stream of rows sorted by keys where no group of equal keys is split.

    Each table holds whole groups; it is as large as a batch and the one group that goes on past it.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh = pa.array([not held or any(not held[-1].column(k)[held[-1].num_rows - 1].equals(batch.column(k)[0]) for k in keys)])
        if n > 1:
            steps = [pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, n - 1)) for k in keys]
            fresh = pa.concat_arrays([fresh, reduce(pc.or_, steps)])
        starts = pc.indices_nonzero(fresh)
        if len(starts):
            at = starts[len(starts) - 1].as_py()
            if held or at:
                whole = pa.Table.from_batches([*held, batch.slice(0, at)])
                if whole.num_rows:
                    yield whole
            held, batch = [], batch.slice(at)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
