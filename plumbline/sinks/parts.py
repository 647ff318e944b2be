"""Texts of any length, written by Spark in parts and handed on as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.store import drop, note, shared_dir

#: Bytes that the driver holds of a text at once.
CHUNK = 1 << 20


def stream(lines: DataFrame) -> Iterator[bytes]:
    """The lines of a table's one text column, each with its line end, in the table's order and in chunks of bytes.

    Executors write them to the shared folder; the driver reads one part after another, and deletes them in the end.
    """
    spark = lines.sparkSession
    path = f"{shared_dir(spark)}/plumbline/report-{uuid.uuid4().hex}"
    note(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        lines.write.text(path)
        parts = sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
        for _, part in parts:
            source = fs.open(part)
            try:
                while chunk := bytes(source.readNBytes(CHUNK)):
                    yield chunk
            finally:
                source.close()
    finally:
        drop(spark, path)


def joined(chunks: Iterator[bytes], between: bytes) -> Iterator[bytes]:
    """Lines with something else between them than line ends, and nothing after the last."""
    held = b""
    for chunk in chunks:
        chunk = held + chunk
        held = b"\n" if chunk.endswith(b"\n") else b""
        yield (chunk[:-1] if held else chunk).replace(b"\n", between)


def csv_line(df: DataFrame) -> Column:
    """A row as a line of CSV: quotes where a text needs them, nothing for null, True and False."""

    def field(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "string":
            c = F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        return F.coalesce(F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string"), F.lit(""))

    return F.concat_ws(",", *[field(n, k) for n, k in df.dtypes])
