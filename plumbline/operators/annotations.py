"""Label lines: parsing, validation and duplicate boxes.

A label text becomes rows of lines, a line becomes codes of what is wrong with it and, if nothing is, a box. Everything
is a Column expression; duplicate boxes are found in the lists of an image's classes, and in crowded images in cells of a grid,
whose boxes are compared in Arrow batches.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import Annotations
from plumbline.functions.columns import iou
from plumbline.plans import ranks
from plumbline.plans.store import table

#: Line ends and white space (fixed values: those of Unicode text lines).
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
BLANK = r"(?U)[\s\x1c-\x1f]+"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
RAW = 200
#: Boxes of a cell of crowded images that a task holds.
PART = 500_000
#: How many times as wide cells are as boxes reach.
SPAN = 4

#: What each code means for the level of an issue.
LEVELS = {
    **dict.fromkeys(["malformed_line", "invalid_class_id", "negative_coordinate", "coordinate_out_of_range", "invalid_size", "zero_area", "label_file_unreadable", "label_file_too_large"], "error"),
    **dict.fromkeys(["box_out_of_bounds", "duplicate_annotation", "tiny_box", "large_box", "missing_label_file", "orphan_label"], "warning"),
    "empty_label_file": "info",
}
MESSAGES = {
    "malformed_line": "the line isn't a class and four numbers, or a polygon of three points or more",
    "invalid_class_id": "there is no class of this number",
    "negative_coordinate": "a coordinate is below 0",
    "coordinate_out_of_range": "a coordinate or size is above 1",
    "invalid_size": "width or height is below 0",
    "zero_area": "width or height is 0",
    "label_file_unreadable": "the label file can't be read",
    "label_file_too_large": "the label file is too large",
    "box_out_of_bounds": "the box reaches out of the image",
    "duplicate_annotation": "the box repeats an earlier one of its class",
    "tiny_box": "the box is tiny",
    "large_box": "the box covers almost the whole image",
    "missing_label_file": "the image has no label file",
    "orphan_label": "the label file has no image",
    "empty_label_file": "the label file is empty",
}


def level(code: Column) -> Column:
    """error, warning or info; warning for an unknown code."""
    out = F.lit("warning")
    for kind in ("error", "info"):
        out = F.when(code.isin([c for c, v in LEVELS.items() if v == kind]), kind).otherwise(out)
    return out


def message(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair]), code)


def lines(labels: DataFrame, key: str = "label_path", text: str = "text") -> DataFrame:
    """(key, line, raw, tokens): the lines that aren't blank, numbered from 1 with those that are."""
    split = labels.select(key, F.posexplode(F.split(F.regexp_replace(text, "^\ufeff", ""), LINE_END, -1)).alias("n", "raw"))
    stripped = F.regexp_replace("raw", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return split.select(key, (F.col("n") + 1).alias("line"), stripped.alias("raw")).where("raw != ''").withColumn("tokens", F.split("raw", BLANK))


def parsed(rows: DataFrame, class_count: int, cfg: Annotations | None = None) -> DataFrame:
    """Rows of ``lines`` with (codes, class_id, cx, cy, w, h, area, flags).

    codes are the errors of a line, in the order in which they are looked for; a line with any has no box, and flags are
    the warnings of the others. class_count 0 knows no upper limit of classes.
    """
    cfg = cfg or Annotations()
    n, last = F.size("tokens"), float("inf")
    values = F.transform(F.slice("tokens", 2, F.greatest(n - 1, F.lit(0))), lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))
    well = ((n == 5) | ((n >= 7) & (n % 2 == 1))) & F.get("tokens", F.lit(0)).rlike(INTEGER)
    rows = rows.withColumn("_v", values).withColumn("_well", well & F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < last)))
    number = F.get("tokens", F.lit(0)).try_cast("decimal(38,0)")
    polygon = n > 5
    axis = lambda odd: F.filter("_v", lambda x, i: i % 2 == odd)
    low, high = (lambda odd: F.array_min(axis(odd))), (lambda odd: F.array_max(axis(odd)))
    at = lambda i: F.get("_v", F.lit(i))
    box = [F.when(polygon, (low(0) + high(0)) / 2).otherwise(at(0)), F.when(polygon, (low(1) + high(1)) / 2).otherwise(at(1)), F.when(polygon, high(0) - low(0)).otherwise(at(2)), F.when(polygon, high(1) - low(1)).otherwise(at(3))]
    rows = rows.withColumns(dict(zip(("cx", "cy", "w", "h"), [F.when(F.col("_well"), b) for b in box], strict=True))).withColumn("_poly", polygon).withColumn("_cls", F.when(F.col("_well"), number))
    least, most = F.when(F.col("_poly"), F.array_min("_v")).otherwise(F.least("cx", "cy")), F.array_max("_v")
    beyond = F.col("_cls").isNull() | (F.col("_cls") < 0) | (F.col("_cls") >= class_count if class_count else F.col("_cls") > 2147483647)
    size = ~F.col("_poly") & ((F.col("w") < 0) | (F.col("h") < 0))
    checks = [
        (beyond, "invalid_class_id"),
        (least < 0, "negative_coordinate"),
        (most > 1, "coordinate_out_of_range"),
        (size, "invalid_size"),
        (~size & ((F.col("w") == 0) | (F.col("h") == 0)), "zero_area"),
    ]
    codes = F.when(~F.col("_well"), F.array(F.lit("malformed_line"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in checks])))
    rows = rows.withColumn("codes", codes).withColumn("area", F.col("w") * F.col("h")).withColumn("class_id", F.col("_cls").try_cast("int"))
    tol = cfg.bounds_tolerance
    out = lambda c, s: (F.col(c) - F.col(s) / 2 < -tol) | (F.col(c) + F.col(s) / 2 > 1 + tol)
    flags = [(F.col("_poly"), "polygon"), (out("cx", "w") | out("cy", "h"), "out_of_bounds"), (F.col("area") < cfg.tiny_box_area, "tiny"), (F.col("area") > cfg.large_box_area, "large")]
    flags = F.when(F.size("codes") == 0, F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in flags]))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("flags", flags).drop("_v", "_well", "_poly", "_cls")


def _in_cells(values: DataFrame, on: list[str], threshold: float, most: int) -> DataFrame:
    """(on, box, of_line, iou): for rows (on, box, first) the matches, by one cell and part of it at a time, with the earliest box before or at theirs.

    Such boxes have heights in a ratio of 1 to 1 / threshold at most, and upper edges that are apart by (1 - threshold) of the
    larger height at most. So heights are binned, by SPAN times that ratio, and edges laid on a grid of SPAN times what the bin
    allows. A box goes to its own cell, where it is found and searches, and searches in those cells beside it that are within
    reach, which few are. The boxes of a cell are cut into parts of ``most`` in their order, which is what a task holds, and
    each part is searched by its own and by all that come later.
    """
    t = min(threshold, 0.99)
    base = (1 + 1e-6) / t
    bin_ = F.ln("box.h") / (SPAN * math.log(base))
    reach = lambda k: (1 - t) * F.pow(F.lit(base), SPAN * (k + 1) + 1)
    row = lambda k: (F.col("box.cy") - F.col("box.h") / 2) / (SPAN * reach(k))
    around = lambda x: F.array_distinct(F.array(*[F.floor(x + d / SPAN).cast("long") for d in (-1, 0, 1)]))
    # Boxes without a size, or beyond numbers, match nothing.
    sized = values.where((F.col("box.w") > 0) & (F.col("box.h") > 0)).where(" and ".join(f"abs(box.{c}) < double('inf')" for c in ("cx", "cy", "w", "h")))
    rows = sized.select(*on, "box", "first", F.explode(around(bin_)).alias("k")).select("*", F.explode(around(row(F.col("k")))).alias("i"))
    rows = rows.withColumn("later", F.when((F.col("k") == F.floor(bin_)) & (F.col("i") == F.floor(row(F.col("k")))), 0).otherwise(1))
    # Rows are dealt once: those of a cell stay together in what follows.
    before = F.count_if(F.col("later") == 0).over(Window.partitionBy(*on, "k", "i").orderBy("first", "later").rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.withColumn("_last", F.floor((before - 1) / most).cast("int")).where("_last >= 0").withColumn("_part", F.explode(F.sequence(F.lit(0), "_last")))
    cut = cut.withColumn("later", F.when(F.col("_part") == F.col("_last"), F.col("later")).otherwise(1))
    flat = cut.select(*on, "k", "i", "_part", "later", "first", "box.*").sortWithinPartitions(*on, "k", "i", "_part", "later", "first")
    kinds = values.schema
    fields = [*[kinds[c] for c in on], T.StructField("row", flat.select("cx", "cy", "w", "h").schema), kinds["first"], T.StructField("of_line", kinds["first"].dataType), T.StructField("iou", T.DoubleType())]
    met = flat.mapInArrow(_matches(on, threshold), T.StructType(fields))
    return met.select(*on, F.col("row").alias("box"), "of_line", "iou")


def _firsts(box: np.ndarray, first: np.ndarray, threshold: float, step: int = 256, rows: int = 256, level: int = 4_096):
    """A search among boxes (cx, cy, w, h) sorted by ``first``: (boxes, lines) to the place of the first that each matches, or -1, and their IoU.

    The earliest ``level`` boxes are looked at first, then eight times as many and so on, by those that have found none. A
    level is sorted by bins of width, rows of upper edges and left edges, so that searching boxes of one bin and row and about
    one left edge meet slices of nine such lists.
    """
    t = min(threshold, 0.99)
    base = (1 + 1e-6) / t
    bins = lambda w: np.floor(np.log(w) / math.log(base))

    def sides(b: np.ndarray) -> np.ndarray:
        cx, cy, w, h = b
        return np.array([cx - w / 2, cx + w / 2, cy - h / 2, cy + h / 2, w * h])

    def best(n_th: np.ndarray, b: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, value, left = np.full(len(line), -1), np.zeros(len(line)), np.arange(len(line))
        for s in range(0, len(n_th), step):
            some = n_th[s : s + step]
            left = left[line[left] >= first[some[0]]]
            if not len(left):
                break
            x1, x2, y1, y2, area = own[:, None, some]
            u1, u2, v1, v2, size = b[:, left, None]
            shape = len(left), len(some)
            over, high, less = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
            np.subtract(np.minimum(x2, u2, out=over), np.maximum(x1, u1, out=less), out=over)
            np.subtract(np.minimum(y2, v2, out=high), np.maximum(y1, v1, out=less), out=high)
            np.multiply(np.maximum(over, 0.0, out=over), np.maximum(high, 0.0, out=high), out=over)
            union = np.subtract(np.add(area, size, out=high), over, out=high)
            # A union of no size has no overlap either, and is divided by 1.
            union[union <= 0] = 1.0
            iou = np.divide(over, union, out=over)
            good = iou >= threshold
            if first[some[-1]] > line[left].min():
                good &= first[some] <= line[left, None]
            found = good.any(axis=1)
            n = good[found].argmax(axis=1)
            at[left[found]], value[left[found]] = some[n], iou[found, n]
            left = left[~found]
        return at, value

    def lists(*keys: np.ndarray) -> list[tuple[int, int]]:
        """Where lists of equal keys begin and end."""
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0)) + 1
        return list(itertools.pairwise([0, *cuts.tolist(), len(keys[0])])) if len(keys[0]) else []

    # The one of a pair that is further left, or up, is apart by (1 - t) of its own side at most.
    far, tall = (lambda n: (1 - t) * base ** (n + 1)), (1 - t) * base * box[3].max()
    own, k, levels, lo = sides(box), bins(box[2]), [], 0
    y_th, room = np.floor(own[2] / tall), np.empty((3, step * rows))
    while lo < len(first):
        hi = min(len(first), lo + level * 8 ** len(levels))
        order = lo + np.lexsort((own[0, lo:hi], y_th[lo:hi], k[lo:hi]))
        levels.append((lo, order, {(k[order[x]], y_th[order[x]]): (own[0, order[x:y]], order[x:y]) for x, y in lists(k[order], y_th[order])}))
        lo = hi

    def search(box: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, m = sides(box), bins(box[2])
        z_th = np.floor(b[2] / tall)
        at, value, left = np.full(len(line), -1), np.zeros(len(line)), np.lexsort((b[0], z_th, m))
        for lo, order, held in levels:
            left = left[(at[left] < 0) & (line[left] >= first[lo])]
            if len(order) <= 2 * step:
                pieces = [(left[s : s + rows], np.sort(order)) for s in range(0, len(left), rows)]
            else:
                pieces = ((left[s : min(s + rows, y)], None) for x, y in lists(m[left], z_th[left]) for s in range(x, y, rows))
            for some, n_th in pieces:
                if n_th is None:
                    n, z, x, y = m[some[0]], z_th[some[0]], b[0, some[0]], b[0, some[-1]] + far(m[some[0]])
                    near = [(i, *held[i, j]) for i in (n - 1, n, n + 1) for j in (z - 1, z, z + 1) if (i, j) in held]
                    if not near:
                        continue
                    n_th = np.sort(np.concatenate([th[np.searchsorted(edges, x - far(i), "left") : np.searchsorted(edges, y, "right")] for i, edges, th in near]))
                at[some], value[some] = best(n_th, b[:, some], line[some])
        return at, value

    return search


def _matches(on: list[str], threshold: float, most: int = 65_536):
    """Over rows sorted by cell, part, ``later`` and ``first``: each box with the first of its part that it matches.

    Those of ``later`` 0 are held, and then search as the others do, up to ``most`` of them at once.
    """
    names, sides = [*on, "k", "i", "_part"], ["cx", "cy", "w", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, waiting, search, ready = None, [], [], None, []
        joined = lambda pieces: (np.concatenate([p[0] for p in pieces], axis=1), np.concatenate([p[1] for p in pieces]))

        def found() -> None:
            """What is held and waits is searched for, and goes to ``ready``."""
            nonlocal search, held, waiting
            if held:
                own = joined(held)
                search, waiting, held = (_firsts(*own, threshold), own[1]), [own, *waiting], []
            if waiting:
                box, line = joined(waiting)
                waiting = [(box[:, s : s + most], line[s : s + most]) for s in range(0, len(line), most)]
            for box, line in waiting if search else []:
                at, value = search[0](box, line)
                some = np.flatnonzero(at >= 0)
                whole = pa.StructArray.from_arrays([pa.array(c) for c in box[:, some]], sides)
                ready.append(pa.RecordBatch.from_arrays([*[pa.repeat(v, len(some)) for v in key[: len(on)]], whole, pa.array(line[some]), pa.array(search[1][at[some]]), pa.array(value[some])], [*on, "row", "first", "of_line", "iou"]))
            waiting = []

        def whole(least: int) -> Iterator[pa.RecordBatch]:
            if sum(r.num_rows for r in ready) >= least:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches(max_chunksize=10_000)
                ready.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for c in names if n > 1 else []:
                fresh[1:] |= pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(fresh).tolist(), n]
            box, line, later = np.array([batch.column(c).to_numpy() for c in sides]), batch.column("first").to_numpy(), batch.column("later").to_numpy()
            for x, y in itertools.pairwise(cuts):
                own = [batch.column(c)[x] for c in names]
                if own != key:
                    found()
                    key, search = own, None
                z = x + int(np.searchsorted(later[x:y], 1))
                if z > x:
                    held.append((box[:, x:z], line[x:z]))
                if z < y:
                    waiting.append((box[:, z:y], line[z:y]))
                    if sum(len(w[1]) for w in waiting) >= most:
                        found()
                yield from whole(10_000)
        found()
        yield from whole(1)

    return run


def duplicate_boxes(boxes: DataFrame, cfg: Annotations | None = None, image: str = "image_id", order: list[str] | None = None) -> DataFrame:
    """(image, class_id, line, of_line, iou): boxes that repeat an earlier box of their class, with the first one.

    ``line`` tells a box's place in its image. In images with up to ``max_boxes_for_iou`` boxes all of a class are compared
    in a list of them, in others those that a grid brings together, equal ones once: the result is the same. Images are
    counted beforehand, so that a crowded one's boxes are never dealt to one task.
    """
    cfg = cfg or Annotations()
    on, t = [image, "class_id"], cfg.duplicate_iou
    own = boxes.select(*on, "line", F.struct(*[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "w", "h")]).alias("box")).where(F.col(image).isNotNull() & F.col("class_id").isNotNull())
    if t < 0.1:
        return _in_lists(own, on, t)
    counts, many = own.groupBy(image).count(), F.col("count") > cfg.max_boxes_for_iou
    few, crowded = counts.agg(F.count_if(~many), F.count_if(many)).first()
    if not crowded:
        return _in_lists(own, on, t)
    if not few:
        return _in_grid(own, on, t)
    names = table(counts.where(many).select(image), "crowded")
    return _in_lists(own.join(names, image, "left_anti"), on, t).unionByName(_in_grid(own.join(names, image, "left_semi"), on, t))


def _in_lists(own: DataFrame, on: list[str], t: float) -> DataFrame:
    """``duplicate_boxes`` of (on, line, box), all boxes of ``on`` in a list."""
    # An image's rows are dealt once: what follows for its classes stays where they are.
    several = own.withColumn("_n", F.count("*").over(Window.partitionBy(*on))).where("_n > 1")
    lists = several.groupBy(*on).agg(F.collect_list(F.struct("line", "box")).alias("l"))
    earlier = lambda b: F.filter("l", lambda a: (a["line"] < b["line"]) & (iou(a["box"], b["box"]) >= t))
    firsts = F.transform("l", lambda b: F.struct(b["line"].alias("line"), F.array_min(F.transform(earlier(b), lambda a: F.struct(a["line"].alias("of_line"), iou(a["box"], b["box"]).alias("iou")))).alias("f")))
    return lists.select(*on, F.explode(firsts).alias("b")).where("b.f is not null").select(*on, "b.line", "b.f.of_line", "b.f.iou")


def _in_grid(own: DataFrame, on: list[str], t: float) -> DataFrame:
    """``duplicate_boxes`` of (on, line, box), equal boxes once, by cells of a grid."""
    values = own.groupBy(*on, "box").agg(F.min("line").alias("first"))
    first = _in_cells(values, on, t, PART).groupBy(*on, "box").agg(F.min("of_line").alias("of_line"), F.min_by("iou", "of_line").alias("iou"))
    return own.join(first, [*on, "box"]).where(F.col("of_line") < F.col("line")).select(*on, "line", "of_line", "iou")


FLAG_CODES = {"out_of_bounds": "box_out_of_bounds", "tiny": "tiny_box", "large": "large_box"}


def validate(files: DataFrame, labels: DataFrame, class_count: int, cfg: Annotations | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, boxes, issues) of images (id, path, split, label_path) and label files (label_path, size, text).

    text is null for a file that can't be read. images has (id, label_status, total_lines, invalid_lines); label_status is
    ok, empty or missing. issues come with the image they belong to, and label files of no image are orphans. An image's
    label file is read for each image that has it.
    """
    cfg = cfg or Annotations()
    own = files.select(F.col("id").alias("image_id"), F.col("path").alias("image_path"), "split", "label_path")
    tied = own.join(labels, "label_path", "left")
    state = F.when(F.col("size").isNull(), "missing_label_file").when(F.col("size") > cfg.max_label_bytes, "label_file_too_large").when(F.col("text").isNull(), "label_file_unreadable")
    tied = tied.withColumn("state", state)
    context = ["image_id", "image_path", "split", "label_path"]
    readable = tied.where("state is null")
    key = F.struct(*context).alias("key")
    rows = parsed(lines(readable.select(key, "text"), "key"), class_count, cfg).select("key.*", "line", "raw", "codes", "class_id", "cx", "cy", "w", "h", "area", "flags")
    # Read by everything below.
    rows = table(rows, "lines")
    boxes = rows.where(F.size("codes") == 0).select(*context, "line", "raw", "class_id", "cx", "cy", "w", "h", "area", "flags")
    again = table(duplicate_boxes(boxes, cfg).select("image_id", "class_id", "line", "of_line"), "repeats")
    boxes = boxes.join(again, ["image_id", "class_id", "line"], "left").withColumn("flags", F.when(F.col("of_line").isNotNull(), F.array_append("flags", F.lit("duplicate"))).otherwise(F.col("flags")))
    counts = rows.groupBy("image_id", "label_path").agg(F.count("*").alias("total"), F.count_if(F.size("codes") > 0).alias("invalid"))
    images = tied.select("image_id", "label_path", "state").join(counts, ["image_id", "label_path"], "left")
    broken = F.col("state").isin("label_file_too_large", "label_file_unreadable")
    status = F.when(F.col("state") == "missing_label_file", "missing").when(F.col("state").isNull() & F.col("total").isNull(), "empty").otherwise("ok")
    count = lambda c: F.when(broken, F.lit(1)).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    images = images.select(F.col("image_id").alias("id"), status.alias("label_status"), count(F.col("total")).alias("total_lines"), count(F.col("invalid")).alias("invalid_lines"))

    raw = F.substring("raw", 1, RAW).alias("raw")
    none = lambda c: F.lit(None).cast(c)
    parts = [
        rows.select(*context, "line", raw, F.explode("codes").alias("code")),
        boxes.select(*context, "line", raw, F.explode(F.filter(F.transform("flags", lambda f: F.element_at(F.create_map(*[F.lit(x) for p in {**FLAG_CODES, "polygon": "", "duplicate": ""}.items() for x in p]), f)), lambda c: c != "")).alias("code")),
        boxes.where("of_line is not null").select(*context, "line", none("string").alias("raw"), F.lit("duplicate_annotation").alias("code")),
        tied.where("state is not null").select(*context, none("int").alias("line"), none("string").alias("raw"), F.col("state").alias("code")),
        readable.join(counts, ["image_id", "label_path"], "left_anti").select(*context, none("int").alias("line"), none("string").alias("raw"), F.lit("empty_label_file").alias("code")),
        labels.join(files, "label_path", "left_anti").select(none("string").alias("image_id"), none("string").alias("image_path"), none("string").alias("split"), "label_path", none("int").alias("line"), none("string").alias("raw"), F.lit("orphan_label").alias("code")),
    ]
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    return images, boxes.drop("raw", "of_line"), issues.withColumn("level", level(F.col("code"))).withColumn("message", message(F.col("code")))


def numbered(issues: DataFrame) -> DataFrame:
    """Issues with ``seq``: those of images by path and line, then orphans by path."""
    return ranks.numbered(issues, "seq", F.col("image_path").asc_nulls_last(), F.col("label_path"), F.col("line").asc_nulls_first(), F.col("code"))
