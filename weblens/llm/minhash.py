"""MinHash bands of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def shingle_hashes(texts: list[str], words: int = 5, masks: dict[str, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all word shingles in text order, start of each text's shingles); a shorter text is one shingle, an empty one too. masks: words and what to take for them."""
    split = [t.split() or [""] for t in texts]
    lengths = np.fromiter((len(x) for x in split), np.int64, len(split))
    flat = pd.Series([w for x in split for w in x], dtype=object)
    codes, unique = pd.factorize(flat)
    if masks:
        unique = [masks.get(w.strip(".,;:()"), w) for w in unique]
    word = pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False)[codes]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.maximum(lengths - words + 1, 1)
    first = np.cumsum(counts) - counts
    at = np.repeat(starts - first, counts) + np.arange(counts.sum())
    last = np.repeat(ends, counts)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for i in range(words):
            pos = at + i
            inside = pos < last
            h = h * _PRIME + np.where(inside, word[np.minimum(pos, len(word) - 1)], np.uint64(7))
        h = _mix(h)
    return h, first


def bands(texts: list[str], number: int, rows: int, words: int = 5, masks: dict[str, str] | None = None) -> np.ndarray:
    """int64 array (texts, number): band hashes of rows MinHash values each."""
    if not texts:
        return np.zeros((0, number), np.int64)
    h, first = shingle_hashes(texts, words, masks)
    out = np.zeros((len(texts), number), np.uint64)
    rng = np.random.default_rng(12345)
    factor = rng.integers(1, 1 << 63, number * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(number * rows):
            low = np.minimum.reduceat(h * factor[i], first)  # h is mixed: an odd factor orders it anew
            out[:, i // rows] = out[:, i // rows] * _PRIME + low
    return out.view(np.int64)
