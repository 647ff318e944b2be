"""Bounded JPEG previews, made by the JVM's image library and kept on disk."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.errors import NotFound
from plumbline.sources.paths import joined

SIZES = (128, 256, 512, 1024, 1600)


def snapped(size: int) -> int:
    """The next size at or above."""
    return next((s for s in SIZES if s >= size), SIZES[-1])


def thumbnail(spark: SparkSession, root: Path, rel_path: str, folder: Path, name: str, size: int = 256) -> Path:
    """A preview whose longer side is at most a snapped size; raises for what can't be decoded."""
    size = snapped(size)
    out = folder / f"{name}-{size}.jpg"
    if out.is_file():
        return out
    jvm = spark._jvm
    source = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(joined(root, rel_path))))
    if source is None:
        raise NotFound(f"{rel_path} has no preview")
    w, h = source.getWidth(), source.getHeight()
    scale = min(1.0, size / max(w, h))
    to = jvm.java.awt.image.BufferedImage(max(1, round(w * scale)), max(1, round(h * scale)), 1)
    g = to.createGraphics()
    g.drawImage(source.getScaledInstance(to.getWidth(), to.getHeight(), 16), 0, 0, None)
    g.dispose()
    folder.mkdir(parents=True, exist_ok=True)
    jvm.javax.imageio.ImageIO.write(to, "jpg", jvm.java.io.File(str(out)))
    return out
