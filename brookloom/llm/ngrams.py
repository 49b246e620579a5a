"""Hashed byte n-grams of many texts at once, for linear models whose score is a mean of weights."""

from __future__ import annotations

import numpy as np

BITS = 16
WIDTH = 1 << BITS


def joined(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The mapped bytes of all texts, each between spaces, and where each text begins (and the last ends)."""
    parts = [b" " + t.translate(table) + b" " for t in texts]
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    return np.frombuffer(b"".join(parts), np.uint8), starts


def hashed(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte; the last n - 1 are left out."""
    h = np.full(len(data) - n + 1, n, np.uint32)
    for k in range(n):
        h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32(WIDTH - 1)


def mean_weights(data: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
    """For each text and column of weights the mean weight of its n-grams; n-grams don't cross texts.

    weights: one row of WIDTH for each model.
    """
    out = np.zeros((len(starts) - 1, len(weights)))
    total = np.zeros(len(starts) - 1)
    for n in sizes:
        if len(data) < n:
            continue
        at = hashed(data, n)
        ends = np.maximum(starts[:-1], starts[1:] - n + 1)
        total += ends - starts[:-1]
        for k, w in enumerate(weights):
            run = np.concatenate(([0.0], np.cumsum(w[at], dtype=np.float64)))
            out[:, k] += run[np.minimum(ends, len(at))] - run[np.minimum(starts[:-1], len(at))]
    return out / np.maximum(total, 1)[:, None]


def counts(text: bytes, table: bytes, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their share of its n-grams."""
    data, _ = joined([text], table)
    at = np.concatenate([hashed(data, n) for n in sizes if len(data) >= n])
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, n = np.unique(at, return_counts=True)
    return found.astype(np.int32), (n / len(at)).astype(np.float32)
