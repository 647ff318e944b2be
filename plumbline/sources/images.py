"""Measurements of image files: one scan of bytes for hash and header, one of pixels decoded by the JVM.

Both drop empty files, so the listing is the left side of the join. What is listed as too large or unsupported isn't
read. A measurement doesn't depend on thresholds, so it is kept in a table and found again by path, size and time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions import pixels
from plumbline.functions.columns import image_id, quality_flags, to_hex
from plumbline.plans.keyed import KeyedStore
from plumbline.plans.store import table
from plumbline.sources.listing import Folder
from plumbline.sources.yolo import relative

VERSION = "1"
_HEADER = "path string, sha256 string, format string, w int, h int, channels int, turned boolean, problem string"
_PIXELS = "path string, blur_score double, brightness double, contrast double, phash_l long, dhash_l long, flat boolean"
KEY = ["path", "file_size", "mtime_ns", "params"]
#: Files that are named to the reader one by one; more are read with all that is in their folder.
FEW = 1_000


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [pixels.header(x.as_py()) for x in batch.column(2)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)]], [c.split()[0] for c in _HEADER.split(", ")])


def _measured(max_side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, c, data in zip(*[batch.column(n) for n in range(1, 5)], strict=True):
                p = np.frombuffer(data.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), c.as_py())
                out.append(pixels.measure(p, max_side))
            signed = lambda n: pa.array(np.array([r[n] for r in out], np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in out], pa.float64()) for n in range(3)], signed(3), signed(4), pa.array([r[5] for r in out], pa.bool_())], [c.split()[0] for c in _PIXELS.split(", ")])

    return run


def params(cfg: Config, full: bool) -> str:
    """What a measurement depends on besides its file."""
    return f"{VERSION}:{cfg.quality.analysis_max_side}:{cfg.max_pixels}:{cfg.max_file_bytes}:{int(full)}"


def _reader(folder: Folder, able: DataFrame):
    """Reads a format's rows: of the files themselves where they are few, as after a small change, of the whole folder else."""
    few = [r.path for r in able.limit(FEW + 1).collect()]
    paths = [f"{folder.qualified}/" + re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in few] if len(few) <= FEW else [folder.qualified]

    def load(kind: str, **options: str) -> DataFrame:
        source = folder.spark.read.format(kind).options(**options)
        if not few:
            return source.option("recursiveFileLookup", "true").load(folder.qualified).where("false")
        try:
            return source.load(paths) if len(few) <= FEW else source.option("recursiveFileLookup", "true").load(paths)
        except AnalysisException:  # a file has gone since it was listed
            return source.option("recursiveFileLookup", "true").load(folder.qualified)

    return load


def measure(folder: Folder, files: DataFrame, cfg: Config | None = None, full: bool = True) -> DataFrame:
    """files with (status, error, format, width, height, channels, is_grayscale, sha256, phash_l, dhash_l, blur_score, brightness, contrast).

    The first that holds: no size known is corrupted, a suffix of another format unsupported, no bytes zero_byte, too many
    bytes too_large, no image corrupted, another format unsupported, too many pixels too_large, pixels that can't be
    decoded corrupted, else ok. Formats that the JVM doesn't decode (WebP) are ok with a size and without pixel measures.
    Only a full measurement has pixel measures.
    """
    cfg = cfg or Config()
    able = files.where(~F.col("unsupported") & (F.col("file_size") > 0) & (F.col("file_size") <= cfg.max_file_bytes)).select("path")
    load = _reader(folder, able)
    bytes_ = load("binaryFile").where(F.col("length") <= cfg.max_file_bytes)
    bytes_ = bytes_.select(relative(folder, F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"), "content").join(able, "path", "left_semi")
    head = table(bytes_.mapInArrow(_headers, _HEADER), "headers")
    decodable = head.where(F.col("problem").isNull() & F.col("format").isin("JPEG", "PNG", "BMP", "TIFF") & (F.col("w").cast("long") * F.col("h") <= cfg.max_pixels)).select("path")
    # This source names files as URIs.
    read = load("image", dropInvalid="true").select("image.*")
    read = read.select(relative(folder, F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))).alias("path"), "height", "width", "nChannels", "data").join(decodable, "path", "left_semi")
    seen = read.mapInArrow(_measured(cfg.quality.analysis_max_side), _PIXELS) if full else read.select("path", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _PIXELS.split(", ")[1:-1]], (F.col("nChannels") == 1).alias("flat"))
    m = files.join(head, "path", "left").join(seen.withColumn("decoded", F.lit(True)), "path", "left")
    many = F.col("w").cast("long") * F.col("h") > cfg.max_pixels
    status = (
        F.when(F.col("file_size").isNull(), "corrupted").when(F.col("unsupported"), "unsupported").when(F.col("file_size") == 0, "zero_byte").when(F.col("file_size") > cfg.max_file_bytes, "too_large")
        .when(F.col("format").isNull() | F.col("problem").isNotNull(), "corrupted").when(~F.col("format").isin(*pixels.FORMATS), "unsupported").when(many, "too_large")
        .when(F.col("decoded").isNull() & (F.col("format") != "WEBP"), "corrupted").otherwise("ok")
    )
    error = F.when(status == "corrupted", F.coalesce("problem", F.lit("the pixels can't be decoded")))
    side = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
    gray = F.coalesce("flat", F.lit(False)) | F.coalesce(F.col("channels").isin(1, 2), F.lit(False))
    return m.select(*files.columns, status.alias("status"), error.alias("error"), "format", side("w", "h").alias("width"), side("h", "w").alias("height"), "channels", gray.alias("is_grayscale"), "sha256", "phash_l", "dhash_l", "blur_score", "brightness", "contrast")


def cached(folder: Folder, files: DataFrame, cache: str | None, cfg: Config | None = None, full: bool = True) -> DataFrame:
    """``measure``, with what a cache has for the same path, size, time and parameters; what it lacks is merged into it.

    The cache has the latest measurement of each path and parameters, so it grows with the files and not with the audits.
    """
    cfg = cfg or Config()
    if cache is None or not cfg.use_cache:
        return measure(folder, files, cfg, full)
    mark = F.lit(params(cfg, full)).alias("params")
    where = F.sha1(F.lit(folder.qualified)).alias("folder")
    store = KeyedStore(folder.spark, cache, ["folder", "path", "params"])
    known = store.read()
    if known is None:
        fresh = out = table(measure(folder, files, cfg, full), "measured")
    else:
        # Whatever a file's split is now is taken from the listing.
        had = known.drop(*[c for c in files.columns if c not in KEY])
        hit = files.select("*", mark, where).join(had, ["folder", *KEY])
        fresh = table(measure(folder, files.join(hit.select("path"), "path", "left_anti"), cfg, full), "measured")
        out = table(hit.select(*fresh.columns).unionByName(fresh), "measurements")
    # Without a size there is nothing to find a measurement by.
    store.put(fresh.where("file_size is not null and mtime_ns is not null").select(where, mark, "*"))
    return out


def described(measured: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Measurements with ids, hex hashes, flags, aspect ratio and whether the hashes can be relied on."""
    cfg = cfg or Config()
    flags = quality_flags(*[F.col(c) for c in ("status", "width", "height", "blur_score", "brightness", "contrast")], cfg.quality)
    ratio = F.when((F.col("width") > 0) & (F.col("height") > 0), F.round(F.col("width").cast("double") / F.col("height"), 4))
    return measured.select(image_id(F.col("path")).alias("id"), "*", to_hex(F.col("phash_l")).alias("phash"), to_hex(F.col("dhash_l")).alias("dhash"), (F.col("contrast") >= cfg.duplicates.min_hash_std).alias("hash_reliable"), ratio.alias("aspect_ratio"), flags.alias("flags"))
