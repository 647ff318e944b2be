"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of splits wherever it matters; other names come later, by name.
SPLITS = {"train": 0, "val": 1, "test": 2}
#: Other names of splits (fixed values).
ALIASES = {"valid": "val", "validation": "val", "dev": "val", "training": "train", "testing": "test"}


def image_id(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 12)


def split_rank(split: Column) -> Column:
    out = F.lit(9)
    for name, rank in SPLITS.items():
        out = F.when(split == name, rank).otherwise(out)
    return out


def normal_split(name: Column) -> Column:
    """Trimmed, in lower case, aliases resolved; empty or null is ``unspecified``."""
    plain = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.when(plain == "", "unspecified").otherwise(plain)
    for alias, to in ALIASES.items():
        out = F.when(plain == alias, to).otherwise(out)
    return out


def to_hex(x: Column) -> Column:
    """A 64-bit number as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def from_hex(x: Column) -> Column:
    """16 hex digits as a long, the highest bit being its sign."""
    return F.conv(x, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs (cx, cy, w, h); 0 where the union is empty."""
    over = lambda c, s: F.greatest(F.lit(0.0), F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2))
    inter = over("cx", "w") * over("cy", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / F.when(union > 0, union)).otherwise(0.0)


def quality_flags(status: Column, width: Column, height: Column, blur: Column, brightness: Column, contrast: Column, q) -> Column:
    """The flags of an image, in a fixed order; none unless its status is ok and it has a size."""
    side, wide = F.least(width, height), F.greatest(width, height)
    flags = [
        (side < q.min_side_px, "low_resolution"),
        (wide.cast("double") / side > q.max_aspect_ratio, "extreme_aspect"),
        (blur < q.blur_threshold, "blurry"),
        (brightness < q.dark_brightness, "dark"),
        ((brightness > q.bright_brightness) & ~(brightness < q.dark_brightness), "bright"),
        (contrast < q.low_contrast_std, "low_contrast"),
    ]
    usable = (status == "ok") & (width > 0) & (height > 0)
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))
    return F.when(usable, found).otherwise(F.array().cast("array<string>"))


def histogram_bin(value: Column, edges: list[float]) -> Column:
    """The bin of a value by the inner edges alone: values below the first or above the last edge go to the outer bins."""
    out = F.lit(0)
    for n, edge in enumerate(edges[1:-1], 1):
        out = F.when(value >= F.lit(float(edge)), n).otherwise(out)
    return out


def guarded(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula, with an apostrophe in front."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
