"""Linear models over hashed features, trained on bounded samples in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(x: np.ndarray) -> bytes:
    """A vector's numbers that are not zero, in single precision, and their places: a small part of it, where it is sparse."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].astype(np.float32).tobytes()


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, places, numbers) of all rows of ``packed`` bytes, one after another; first has the end too."""
    raw = [x.as_buffer() for x in column]
    n = np.array([len(x) // 6 for x in raw], np.int64)
    places = [np.frombuffer(x, np.uint16, k) for x, k in zip(raw, n, strict=True)]
    numbers = [np.frombuffer(x, np.float32, k, 2 * k) for x, k in zip(raw, n, strict=True)]
    return np.concatenate([[0], np.cumsum(n)]), np.concatenate([np.zeros(0, np.uint16), *places]), np.concatenate([np.zeros(0, np.float32), *numbers])


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of ``size`` numbers in single precision, from ``packed`` bytes, and a last column of ones."""
    first, places, numbers = unpacked(column)
    out = np.zeros((len(column), size + 1), np.float32)
    out[:, size] = 1
    out[np.repeat(np.arange(len(column)), np.diff(first)), places] = numbers
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of an L2-regularised linear SVM with squared hinge loss, by dual coordinate descent; y is -1 or 1.

    Sides of different size count alike: each example's cost is weighted by the other side's share.
    """
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean()).clip(1e-3)
    diag = 1.0 / (2 * c * 2 * share)
    norm = np.einsum("ij,ij->i", x, x).astype(np.float64) + diag
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], np.float64)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            grad = y[i] * (x[i] @ w) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - grad / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def logistic(column: pa.ChunkedArray, size: int, p: np.ndarray, l2: float = 1e-4, rounds: int = 300, rate: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft labels p, by gradient steps of a size for each feature; sides count alike.

    The rows are ``packed`` bytes and stay sparse; the last weight is the intercept.
    """
    first, places, numbers = unpacked(column)
    row, numbers = np.repeat(np.arange(len(p)), np.diff(first)), numbers.astype(np.float64)
    share = p * max(1e-3, (1 - p).mean()) + (1 - p) * max(1e-3, p.mean())
    share = share / share.mean()
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, numbers * w[places], len(p)) + w[size]
        off = (sigmoid(z) - p) * share / len(p)
        grad = np.append(np.bincount(places, numbers * off[row], size), off.sum()) + l2 * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
