"""Folders of any file system that Spark reads, and the files below them as a table.

The tree is listed level by level: the folders of a level are dealt to tasks, which list them and give files and further
folders as rows; each level is written before the next. So neither the driver nor a task holds the files of more than a
batch. Executors list mounted folders by themselves, and the stores that Arrow opens through it; what only Spark's own file
systems open (views, other vendors') is listed through these, folder by folder, and written in batches just the same.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.store import table
from plumbline.sources.paths import inside

ENTRIES = "path string, folder boolean, file_size long, mtime_ns long"
BATCH = 10_000
#: Schemes whose folders Arrow opens on executors.
ARROW = {"s3", "s3a", "gs", "gcs", "hdfs"}


class Folder:
    """A folder by path or URI: the few questions that the driver asks of it, about its manifest and its entries."""

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        scheme, _, rest = str(root).partition(":/")
        self.spark, self.scheme = spark, scheme if rest and re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", scheme) else "file"
        self.local = Path(re.sub(r"^file:/+", "/", str(root))).resolve() if self.scheme == "file" else None
        self.root = str(self.local) if self.local else str(root).rstrip("/")
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.local.as_uri() if self.local else self.root)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        #: As Spark's readers name it.
        self.qualified = self._fs.makeQualified(at).toString().rstrip("/")

    @property
    def name(self) -> str:
        return posixpath.basename(self.root)

    def _at(self, rel: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.qualified}/{rel}" if rel else self.qualified)

    def is_dir(self, rel: str = "") -> bool:
        return (self.local / rel).is_dir() if self.local else self._fs.exists(self._at(rel)) and self._fs.getFileStatus(self._at(rel)).isDirectory()

    def is_file(self, rel: str) -> bool:
        return (self.local / rel).is_file() if self.local else self._fs.exists(self._at(rel)) and self._fs.getFileStatus(self._at(rel)).isFile()

    def dirs(self, rel: str) -> list[str]:
        """The names of the folders in a folder, sorted."""
        if self.local:
            return sorted(d.name for d in (self.local / rel).iterdir() if d.is_dir())
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(rel)) if s.isDirectory())

    def text(self, rel: str) -> str:
        """A small file's text."""
        if self.local:
            return (self.local / rel).read_text("utf-8", "replace")
        stream = self._fs.open(self._at(rel))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def place(self, base: str, entry: str) -> str | None:
        """An existing file or folder named against a base, links resolved, as a path below the root; None for others."""
        if self.local:
            path = self.local / base / entry
            if not path.exists() or not inside(path, self.local):
                return None
            rel = path.resolve().relative_to(self.local).as_posix()
        else:
            entry = entry.removeprefix(f"{self.root}/")
            rel = posixpath.normpath(posixpath.join(base, entry))
            if entry.startswith("/") or "://" in entry or rel.split("/")[0] == ".." or not self._fs.exists(self._at("" if rel == "." else rel)):
                return None
        return "" if rel == "." else rel

    def children(self, rel: str) -> Iterator[tuple[str, bool, int, int]]:
        """What is in a folder, by Spark's file system."""
        found = self._fs.listStatusIterator(self._at(rel))
        while found.hasNext():
            s = found.next()
            yield posixpath.join(rel, s.getPath().getName()), s.isDirectory(), s.getLen(), s.getModificationTime() * 1_000_000


def _mounted(root: str, rel: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """What is in a mounted folder; links that lead out of the root and linked folders are left out."""
    top = Path(root)
    with os.scandir(top / rel) as entries:
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir(follow_symlinks=False):
                yield path, True, None, None
            elif e.is_file() and (not e.is_symlink() or inside(top / path, top)):
                yield path, False, e.stat().st_size, e.stat().st_mtime_ns
            elif e.is_symlink() and not e.is_dir() and inside(top / path, top):
                yield path, False, None, None


def _stored(root: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", root))

    def children(_: str, rel: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
        for e in system.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"))):
            yield posixpath.join(rel, e.base_name), e.type == fs.FileType.Directory, e.size, e.mtime_ns

    return children


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "folder": pa.bool_(), "file_size": pa.int64(), "mtime_ns": pa.int64()}
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


def _list(root: str, mounted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        children = _mounted if mounted else _stored(root)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                yield from _batches(children(root, rel))

    return run


def listing(folder: Folder) -> DataFrame:
    """(path, file_size, mtime_ns) of all files below a folder, paths relative to it; size and time are null for dead links."""
    spark, levels, todo = folder.spark, [], [""]
    by_tasks = folder.local is not None or folder.scheme in ARROW
    dirs = spark.createDataFrame([("",)], "path string")
    while todo:
        if by_tasks:
            level = table(dirs.mapInArrow(_list(folder.root, folder.local is not None), ENTRIES), "listing")
            n = level.where("folder").count()
            dirs = level.where("folder").select("path").repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))
            todo = [""] * bool(n)
            levels.append(level)
        else:
            found = (row for rel in todo for row in folder.children(rel))
            parts = [table(spark.createDataFrame(pa.Table.from_batches([b])), "listing") for b in _batches(found)]
            # Folders alone are kept here, and only those of one level.
            todo = [r.path for p in parts for r in p.where("folder").select("path").toLocalIterator()]
            levels += parts
    none = spark.createDataFrame([], ENTRIES)
    return reduce(DataFrame.unionByName, levels, none).where("not folder").drop("folder")


# Paths as columns.
def parent(path: Column) -> Column:
    """The folder of a path, '' at the top."""
    return F.regexp_replace(path, r"(?s)/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The suffix with its dot; names that begin with dots and have no other have none."""
    return F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.substr(base_name(path), F.lit(1), F.char_length(base_name(path)) - F.char_length(suffix(path)))


def under(folder: Column | str, name: Column) -> Column:
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def normal(path: Column) -> Column:
    """A relative path without . and .. parts; null if it leads out of its root."""
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    step = lambda a, s: F.when(s.isin("", "."), a).when(s == "..", up(a)).otherwise(F.array_append(a, s))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """All folders that a path lies in, '' among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
