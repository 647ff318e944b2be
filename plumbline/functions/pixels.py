"""Headers and pixels of images, in NumPy; what runs in Arrow batches on the executors."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

FORMATS = ("JPEG", "PNG", "BMP", "WEBP", "TIFF")


def sniff(b: bytes) -> str | None:
    """The format by the first bytes."""
    if b[:3] == b"\xff\xd8\xff":
        return "JPEG"
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG"
    if b[:2] == b"BM":
        return "BMP"
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return "WEBP"
    if b[:4] in (b"II*\0", b"MM\0*"):
        return "TIFF"
    return "GIF" if b[:6] in (b"GIF87a", b"GIF89a") else None


def _orientation(exif: bytes) -> int:
    """Tag 0x0112 of the first directory of an EXIF block, or 1."""
    e = "<" if exif[:2] == b"II" else ">"
    at = struct.unpack(e + "I", exif[4:8])[0]
    for n in range(struct.unpack(e + "H", exif[at : at + 2])[0]):
        tag, _, _, value = struct.unpack(e + "HHIH", exif[at + 2 + 12 * n : at + 12 + 12 * n])
        if tag == 0x0112:
            return value
    return 1


def _jpeg(b: bytes) -> tuple[int, int, int, bool]:
    at, turned, size = 2, False, None
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = b[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:
            at += 1 if kind == 0xFF else 2
            continue
        length = struct.unpack(">H", b[at + 2 : at + 4])[0]
        part = b[at + 4 : at + 2 + length]
        if kind == 0xE1 and part[:6] == b"Exif\0\0":
            try:
                turned = _orientation(part[6:]) in (5, 6, 7, 8)
            except (struct.error, IndexError):
                turned = False
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w, channels = struct.unpack(">HHB", part[1:6])
            size = w, h, channels
        if kind == 0xDA:
            break
        at += 2 + length
    if size is None:
        raise ValueError("there is no frame")
    if b.rstrip(b"\0")[-2:] != b"\xff\xd9":
        raise ValueError("the end is missing")
    return (*size, turned)


def _png(b: bytes) -> tuple[int, int, int, bool]:
    w, h, _, kind = struct.unpack(">IIBB", b[16:26])
    if b"IEND" not in b[-16:]:
        raise ValueError("the end is missing")
    return w, h, {0: 1, 2: 3, 3: 4 if b"tRNS" in b[: b.find(b"IDAT")] else 3, 4: 2, 6: 4}[kind], False


def _bmp(b: bytes) -> tuple[int, int, int, bool]:
    w, h, _, bits = struct.unpack("<iiHH", b[18:30])
    return abs(w), abs(h), max(1, bits // 8) if bits != 8 else 3, False


def _webp(b: bytes) -> tuple[int, int, int, bool]:
    kind = b[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), 4 if b[20] & 16 else 3, False
    if kind == b"VP8L":
        n = int.from_bytes(b[21:25], "little")
        return 1 + (n & 0x3FFF), 1 + (n >> 14 & 0x3FFF), 4 if n >> 28 & 1 else 3, False
    w, h = struct.unpack("<HH", b[26:30])
    return w & 0x3FFF, h & 0x3FFF, 3, False


def _tiff(b: bytes) -> tuple[int, int, int, bool]:
    e = "<" if b[:2] == b"II" else ">"
    at, tags = struct.unpack(e + "I", b[4:8])[0], {}
    for n in range(struct.unpack(e + "H", b[at : at + 2])[0]):
        tag, kind, _ = struct.unpack(e + "HHI", b[at + 2 + 12 * n : at + 10 + 12 * n])
        tags[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), b[at + 10 + 12 * n :][: 2 if kind == 3 else 4])[0]
    return tags[256], tags[257], tags.get(277, 1), tags.get(274, 1) in (5, 6, 7, 8)


_READ = {"JPEG": _jpeg, "PNG": _png, "BMP": _bmp, "WEBP": _webp, "TIFF": _tiff}


def header(b: bytes) -> tuple[str | None, int | None, int | None, int | None, bool, str | None]:
    """(format, width, height, channels, turned, error); format is None for what isn't an image."""
    kind = sniff(b)
    if kind not in _READ:
        return kind, None, None, None, False, None if kind else "not an image"
    try:
        w, h, channels, turned = _READ[kind](b)
        if w < 1 or h < 1:
            raise ValueError("it has no size")
        return kind, w, h, channels, turned, None
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return kind, None, None, None, False, f"damaged {kind}: {e}"


@lru_cache(64)
def _shares(n: int, m: int) -> np.ndarray:
    """The share of each of n source cells in each of m target cells, as area averaging has it; linear if it enlarges."""
    out = np.zeros((m, n))
    scale = n / m
    for i in range(m):
        if scale >= 1:
            a, b = i * scale, (i + 1) * scale
            for j in range(int(a), min(n, int(np.ceil(b - 1e-9)))):
                out[i, j] = min(b, j + 1) - max(a, j)
        else:
            j = int(np.floor(i * scale))
            f = i + 1 - (j + 1) / scale
            f = 0.0 if f <= 0 else f - np.floor(f)
            out[i, min(j, n - 1)] += 1 - f
            out[i, min(j + 1, n - 1)] += f
    return out / out.sum(1, keepdims=True)


def resized(gray: np.ndarray, w: int, h: int) -> np.ndarray:
    return _shares(gray.shape[0], h) @ gray @ _shares(gray.shape[1], w).T


def _bits(x: np.ndarray) -> int:
    return int.from_bytes(np.packbits(x.ravel()).tobytes(), "big")


@lru_cache(1)
def _dct() -> np.ndarray:
    k, n = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
    c = np.cos(np.pi * (2 * n + 1) * k / 64) * np.sqrt(2 / 32)
    c[0] /= np.sqrt(2)
    return c


def phash(gray: np.ndarray) -> int:
    """Signs of the 8 x 8 lowest frequencies of a 32 x 32 copy against their median."""
    c = _dct()
    low = (c @ np.rint(resized(gray, 32, 32)) @ c.T)[:8, :8]
    return _bits(low > np.median(low))


def dhash(gray: np.ndarray) -> int:
    """Whether each of the 9 x 8 cells is darker than the next to its right."""
    x = np.rint(resized(gray, 9, 8))
    return _bits(x[:, 1:] > x[:, :-1])


def grayscale(bgr: np.ndarray) -> bool:
    """Whether three channels are the same but for less than one step on average, by at most 256 rows and columns."""
    s = bgr[:: max(1, -(-bgr.shape[0] // 256)), :: max(1, -(-bgr.shape[1] // 256))].astype(np.int16)
    return bool(np.abs(s[..., 0] - s[..., 1]).mean() < 1 and np.abs(s[..., 1] - s[..., 2]).mean() < 1)


def measure(pixels: np.ndarray, max_side: int) -> tuple[float, float, float, int, int, bool]:
    """(blur, brightness, contrast, phash, dhash, is_grayscale) of rows x columns x channels, blue first."""
    p = pixels[..., :3] if pixels.shape[2] >= 3 else pixels[..., :1]
    gray = np.rint(p @ np.array([0.114, 0.587, 0.299])) if p.shape[2] == 3 else p[..., 0].astype(float)
    flat = p.shape[2] == 1 or grayscale(p)
    small = gray
    if max(gray.shape) > max_side:
        scale = max_side / max(gray.shape)
        small = np.rint(resized(gray, max(1, round(gray.shape[1] * scale)), max(1, round(gray.shape[0] * scale))))
    e = np.pad(small, 1, mode="reflect") if min(small.shape) > 1 else np.pad(small, 1, mode="edge")
    edges = e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:] - 4 * small
    return float(edges.var()), float(small.mean()), float(small.std()), phash(small), dhash(small), flat
