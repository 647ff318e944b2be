"""ZIP archives, unpacked by tasks: the list at an archive's end says where each member is, and what it may become.

The driver reads that list alone, and holds it against all limits before a byte is unpacked. Members are dealt to tasks
by their sizes; each is read at its own place in the archive and may not become other than the list says, in size or in
checksum. So nothing larger than the limits ever comes out, whatever the archive holds.
"""

from __future__ import annotations

import shutil
import stat
import struct
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.errors import SecurityError
from plumbline.sources.paths import ZipLimits, member, unwrapped

CHUNK = 1 << 20
MEMBERS = "name string, place long, packed long, size long, crc long, deflated boolean"


def listed(archive: str | Path, limits: ZipLimits) -> list[tuple]:
    """(name, place, packed, size, crc, deflated) of all members that are files; raises for what the limits or paths forbid."""
    try:
        with zipfile.ZipFile(archive) as z:
            members = z.infolist()
    except zipfile.BadZipFile as e:
        raise SecurityError(f"{archive} is no ZIP file") from e
    if len(members) > limits.files:
        raise SecurityError(f"the archive has {len(members)} members, over {limits.files}")
    out, total, seen = [], 0, set()
    for m in members:
        name = str(member(m.filename))
        if m.flag_bits & 1 or stat.S_ISLNK(m.external_attr >> 16):
            raise SecurityError(f"{m.filename!r} is encrypted or a link")
        if m.is_dir():
            continue
        if name in seen or m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise SecurityError(f"{m.filename!r} is there twice or packed in an unknown way")
        seen.add(name)
        total += m.file_size
        if m.file_size > limits.member_bytes or total > limits.total_bytes or m.file_size > limits.ratio * max(m.compress_size, 1024):
            raise SecurityError(f"{m.filename!r} is larger than the limits allow")
        out.append((name, m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type == zipfile.ZIP_DEFLATED))
    return out


def _pieces(source, packed: int, deflated: bool) -> Iterator[bytes]:
    unpack = zlib.decompressobj(-15) if deflated else None
    while packed and (part := source.read(min(CHUNK, packed))):
        packed -= len(part)
        while unpack and part:
            yield unpack.decompress(part, CHUNK)
            part = unpack.unconsumed_tail
        if not unpack:
            yield part
    if unpack:
        yield unpack.flush()


def write_member(archive: str, to: Path, place: int, packed: int, size: int, crc: int, deflated: bool) -> bool:
    """Unpacks one member; whether it is what the list says. No more is written than that."""
    to.parent.mkdir(parents=True, exist_ok=True)
    with open(archive, "rb") as source, to.open("wb") as out:
        source.seek(place)
        head = source.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            return False
        source.seek(sum(struct.unpack("<HH", head[26:30])), 1)
        n = check = 0
        try:
            for piece in _pieces(source, packed, deflated):
                n, check = n + len(piece), zlib.crc32(piece, check)
                if n > size:
                    return False
                out.write(piece)
        except zlib.error:
            return False
    return n == size and check == crc


def _unpack(archive: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [m["name"] for m in batch.to_pylist() if not write_member(archive, Path(target, m["name"]), *[m[k] for k in ("place", "packed", "size", "crc", "deflated")])]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["name"])

    return run


def extract(spark: SparkSession, archive: str | Path, target: str | Path, limits: ZipLimits | None = None) -> Path:
    """Unpacks a ZIP file and returns the folder of the dataset in it; both must be on a file system that executors mount.

    Members that lead out, are links, encrypted or listed twice, or exceed a limit stop it before any is unpacked; those that
    aren't what the list says stop it too. What was unpacked is removed then.
    """
    target = Path(target)
    members = listed(archive, limits or ZipLimits())
    target.mkdir(parents=True, exist_ok=True)
    try:
        tasks = max(1, min(len(members), 4 * spark.sparkContext.defaultParallelism))
        # In turn by size, so that tasks get about as much as each other.
        dealt = [(k % tasks, *m) for k, m in enumerate(sorted(members, key=lambda m: -m[3]))]
        rows = spark.createDataFrame(dealt, f"task int, {MEMBERS}").repartitionByRange(tasks, "task").drop("task")
        bad = rows.mapInArrow(_unpack(str(archive), str(target)), "name string").orderBy(F.asc("name")).first()
        if bad:
            raise SecurityError(f"{bad.name!r} isn't what the archive's list says")
    except BaseException:
        shutil.rmtree(target, ignore_errors=True)
        raise
    return unwrapped(target)
