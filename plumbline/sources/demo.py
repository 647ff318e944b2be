"""A small dataset with known defects, made of numbers alone."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """rows x columns x 3 as a PNG file."""
    h, w = pixels.shape[:2]
    rows = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    kind = 2 if pixels.ndim == 3 else 0
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def scene(seed: int, w: int = 160, h: int = 120) -> np.ndarray:
    """Sharp shapes over noise; no two seeds look alike."""
    rng = np.random.default_rng(seed)
    img = rng.integers(60, 190, (h // 20 + 1, w // 20 + 1, 3)).repeat(20, 0).repeat(20, 1)[:h, :w].astype(float)
    for _ in range(6):
        x, y, r = rng.integers(0, w), rng.integers(0, h), rng.integers(8, 30)
        yy, xx = np.mgrid[:h, :w]
        img[(xx - x) ** 2 + (yy - y) ** 2 < r * r] = rng.integers(0, 256, 3)
    return np.clip(img + rng.normal(0, 12, img.shape), 0, 255)


def blurred(img: np.ndarray, n: int = 9) -> np.ndarray:
    for axis in (0, 1):
        img = sum(np.roll(img, k, axis) for k in range(-n, n + 1)) / (2 * n + 1)
    return img


def generate(root: str | Path) -> dict:
    """Writes the dataset and returns what is wrong with it.

    60 images, 40 in train, 12 in val and 8 in test, of four classes of which one has no box.
    """
    root, n = Path(root), 0
    wrong: dict = {"corrupted": 1, "zero_byte": 1, "unsupported": 1, "blurry": 3, "dark": 2, "grayscale": 2, "missing_label": 2, "empty_label": 1, "orphan_label": 1, "invalid_lines": 5, "leaked": 2, "exact_groups": 2, "near_groups": 1}
    for split, count in (("train", 40), ("val", 12), ("test", 8)):
        (root / "images" / split).mkdir(parents=True, exist_ok=True)
        (root / "labels" / split).mkdir(parents=True, exist_ok=True)
        for k in range(count):
            name, img = f"{split}_{k:03d}", scene(1000 + n)
            if split == "train" and k in (2, 3, 4):
                img = blurred(img)
            if split == "train" and k in (5, 6):
                img = img * 0.08
            if split == "train" and k in (7, 8):
                img = img.mean(2, keepdims=True).repeat(3, 2)
            data = png(img)
            if (split, k) == ("train", 10):
                data = data[: len(data) // 2]
            if (split, k) == ("train", 11):
                data = b""
            if (split, k) == ("train", 13):  # a copy within the split
                data = png(scene(1000 + 12))
            if (split, k) == ("train", 15):  # a brighter copy
                data = png(np.clip(scene(1000 + 14) * 1.06 + 3, 0, 255))
            if (split, k) in (("val", 0), ("test", 0)):  # copies across splits
                data = png(scene(1000 + 12)) if split == "val" else png(scene(1000 + 20))
            (root / "images" / split / f"{name}.png").write_bytes(data)
            n += 1
            if (split, k) in (("train", 16), ("val", 3)):
                continue
            text = f"{k % 2} 0.5 0.5 0.3 0.4\n" + (f"2 0.2{k % 10} 0.3 0.1 0.1\n" if split != "test" and k % 5 == 0 else "")
            if (split, k) == ("train", 17):
                text = ""
            if (split, k) == ("train", 18):
                text += "0 0.5 0.5\n7 0.5 0.5 0.1 0.1\n0 -0.1 0.5 0.1 0.1\n0 1.4 0.5 0.1 0.1\n0 0.5 0.5 0 0.1\n"
            (root / "labels" / split / f"{name}.txt").write_text(text)
    (root / "images/train/picture.gif").write_bytes(b"GIF89a\x01\0\x01\0\0\0\0;")
    (root / "labels/train/ghost.txt").write_text("0 0.5 0.5 0.1 0.1\n")
    (root / "data.yaml").write_text("names: [square, circle, triangle, star]\ntrain: images/train\nval: images/val\ntest: images/test\n")
    wrong["missing_label"] += 1  # the picture of another format has none either
    return wrong | {"images": n + 1}
