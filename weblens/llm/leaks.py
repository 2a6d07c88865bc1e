"""Evaluation passages that leak into training text.

Q-gram lemma filtering: text is reduced to its lower-case words joined by one
space. A piece of L characters that differs from a text by at most k edits shares
at least L - q + 1 - k q of its q-grams with it, on diagonals (text position less
passage position) that lie k apart at most. The q-grams of all passages are held
in sorted hash arrays behind a bitmap; every document's q-grams are looked up,
matches are counted in overlapping bands of 2 (k + 1) diagonals for each document
and passage, and only bands that reach the bound of the passage's shortest window
of `words` words are kept. In these, every such window is verified by a banded
alignment against the document.

Plan: one pass over the documents without a shuffle of their text; passages are
a stated query set and go to the tasks in blocks of about BLOCK_CHARS characters,
so what is broadcast is bounded. A set of several blocks is searched in two steps:
one pass over all documents keeps those that can reach the lemma's bound with
q-grams of any passage, by a bitmap of SIEVE_BITS, and only these meet the blocks.

Defined results: NULL or empty texts and passages of fewer than `words` words
have no leaks; repeated rows count once; an empty table on either side gives an
empty result; other columns are ignored; texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.session import write_shared

#: Characters of passages that go to the tasks at once.
BLOCK_CHARS = 4_000_000
#: Bits of the bitmap of all passages' q-grams; it is used for sets beyond one block.
SIEVE_BITS = 1 << 27
#: Longest q-gram.
MAX_Q = 12
#: Characters of documents that are looked up at once.
_SLICE_CHARS = 2_000_000
_P = 0x9E3779B97F4A7C15
_BITS = 20


def word_text(text: Column) -> Column:
    """Lower-case runs of letters and digits, each between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, length, total, whole = codes.astype(np.uint64) + np.uint64(1), 1, 0, None
        while True:
            if q & length:
                if whole is None:
                    whole = power
                else:
                    n = len(codes) - total - length + 1
                    whole = whole[:n] * np.uint64(pow(_P, length, 1 << 64)) + power[total : total + n]
                total += length
            if total == q:
                return (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            n = len(power) - length
            power = power[:n] * np.uint64(pow(_P, length, 1 << 64)) + power[length : length + n]
            length *= 2


def _windows(text: str, words: int) -> list[tuple[int, int]]:
    """(start, end) of every run of so many words, with the spaces on both sides."""
    spaces = [i for i, c in enumerate(text) if c == " "]
    return [(spaces[i], spaces[i + words] + 1) for i in range(len(spaces) - words)]


def edits_within(piece: str, text: str, k: int) -> bool:
    """Banded alignment: whether piece is within k edits of some substring of text that begins up to 2 k + 1 characters in."""
    if k == 0:
        return piece in text
    n, width = len(piece), len(text) - len(piece) + k
    big = k + 1
    row = [0] * (len(text) + 1)
    for i in range(1, n + 1):
        low, high = max(1, i - k), min(len(text), i + width)
        new = [big] * (len(text) + 1)
        if i <= k:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (piece[i - 1] != text[j - 1]), row[j] + 1, new[j - 1] + 1, big)
        row = new
        if min(row) > k:
            return False
    return min(row) <= k


class Passages:
    """The q-grams of a block of passages, for look-up."""

    def __init__(self, items: list[tuple[int, str]], words: int, edits: int):
        self.words, self.edits = words, edits
        self.items = [(i, t, np.array(w, np.int64)) for i, t in items if (w := _windows(t, words))]
        shortest = [int((w[:, 1] - w[:, 0]).min()) for _, _, w in self.items]
        self.q = max(2, min([MAX_Q, *(n // (edits + 2) + 1 for n in shortest)]))
        self.bound = np.array([max(1, n - self.q + 1 - edits * self.q) for n in shortest], np.int64)
        parts = [_grams(_codes(t), self.q) for _, t, _ in self.items]
        grams = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        pos = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> set[tuple[int, int]]:
        """(index of text, item id) of all leaks."""
        out: set[tuple[int, int]] = set()
        if not texts or not self.items:
            return out
        joined = "\0".join(texts)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        h = _grams(_codes(joined), self.q)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[slot] == h[at]
        at, slot = at[real], slot[real]
        if not len(at):
            return out
        count = self.count[slot]
        entry = np.repeat(self.first[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = np.repeat(at, count)
        doc = np.searchsorted(starts, at, "right") - 1
        item, step = self.item[entry], self.edits + 1
        band = (at - starts[doc] - self.pos[entry]) // step
        shift = np.int64(1) << np.int64(31)
        base = (doc * len(self.items) + item) * shift + (band + (shift >> np.int64(1)))
        pos = self.pos[entry]
        keys, pos = (base, pos) if self.edits == 0 else (np.concatenate([base, base - 1]), np.concatenate([pos, pos]))
        order = np.argsort(keys, kind="stable")
        bands, begin, n = np.unique(keys[order], return_index=True, return_counts=True)
        group = bands // shift
        for r in np.flatnonzero(n >= self.bound[group % len(self.items)]):
            d, i = divmod(int(group[r]), len(self.items))
            item_id, passage, windows = self.items[i]
            if (d, item_id) in out:
                continue
            low = (int(bands[r] % shift) - int(shift >> np.int64(1))) * step
            here = np.unique(pos[order[begin[r] : begin[r] + n[r]]])
            first, last = windows[:, 0], windows[:, 1]
            inside = np.searchsorted(here, last - self.q, "right") - np.searchsorted(here, first, "left")
            enough = inside >= np.maximum(1, last - first - self.q + 1 - self.edits * self.q)  # the lemma for each window
            for a, b in windows[enough].tolist():
                start = max(0, a + low - self.edits)
                piece = texts[d][start : max(0, b + low + (2 * step - 1 if self.edits else 0) + self.edits)]
                if passage[a:b] in piece or (self.edits and edits_within(passage[a:b], piece, self.edits)):
                    out.add((d, item_id))
                    break
        return out


def _sieve_bounds(words: int, edits: int) -> tuple[int, int, int]:
    """(q, fewest q-grams, longest run of them at least) of any window of so many words, as the shortest one has: words of one letter."""
    shortest = 2 * words + 1
    q = max(2, min(MAX_Q, shortest // (edits + 2) + 1))
    least = max(1, shortest - q + 1 - edits * q)
    return q, least, max(1, least // (edits + 1))


def _sieve(queries: DataFrame, q: int) -> np.ndarray:
    """Bitmap of the q-grams of all passages, combined in the cluster."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [_grams(_codes(t), q) for t in batch["_words"]]
            if parts:
                slot = np.unique(np.concatenate(parts) % np.uint64(SIEVE_BITS)).astype(np.int64)
                yield pd.DataFrame({"i": slot // 32, "b": np.int64(1) << (slot % 32)})

    bits = queries.select("_words").mapInPandas(slots, "i bigint, b bigint").groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()  # at most SIEVE_BITS / 32 rows
    out = np.zeros(SIEVE_BITS // 32, np.uint32)
    out[bits["i"].to_numpy()] = bits["b"].to_numpy().astype(np.uint32)
    return out


def _sieved(own: DataFrame, queries: DataFrame, words: int, edits: int) -> DataFrame:
    """The documents that have enough q-grams of passages, and enough of them in a row, written to the shared folder."""
    q, least, run = _sieve_bounds(words, edits)
    sent = own.sparkSession.sparkContext.broadcast(_sieve(queries, q))

    def possible(text: str) -> bool:
        slot = _grams(_codes(text), q) % np.uint64(SIEVE_BITS)
        hit = (sent.value[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1
        if hit.sum() < least:
            return False
        gaps = np.diff(np.flatnonzero(np.concatenate([[True], ~hit, [True]])))
        return bool(gaps.max() > run)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[possible(t) for t in batch["_words"]]]

    return write_shared(own.mapInPandas(keep, own.schema))


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", words: int = 10, edits: int = 0) -> DataFrame:
    """(doc_key, item_key): documents with `words` consecutive words of a passage, up to `edits` character edits."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField(item_key, items.schema[item_key].dataType)])
    own = docs.where(F.col(text).isNotNull()).select(doc_key, word_text(F.col(text)).alias("_words"))
    queries = items.where(F.col(passage).isNotNull()).select(item_key, word_text(F.col(passage)).alias("_words")).distinct()
    size = queries.agg(F.sum(F.length("_words"))).first()[0] or 0
    number = -(-size // BLOCK_CHARS)
    if number > 1:
        own = _sieved(own, queries, words, edits)
        queries = write_shared(queries.withColumn("_block", F.pmod(F.xxhash64(item_key, "_words"), F.lit(number))))
    result = spark.createDataFrame([], schema)
    for n in range(number):
        block = [(r[0], r[1]) for r in (queries if number == 1 else queries.where(F.col("_block") == n)).select(item_key, "_words").collect()]  # about BLOCK_CHARS characters
        sent = spark.sparkContext.broadcast(Passages(block, words, edits))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            passages = sent.value
            for batch in batches:
                keys, texts = batch[doc_key].tolist(), batch["_words"].tolist()
                found, begin, size = [], 0, 0
                for i, t in enumerate(texts):
                    size += len(t)
                    if size >= _SLICE_CHARS or i == len(texts) - 1:
                        found += [(keys[begin + d], item) for d, item in passages.search(texts[begin : i + 1])]
                        begin, size = i + 1, 0
                yield pd.DataFrame(found, columns=[doc_key, item_key])

        result = result.unionByName(own.mapInPandas(search, schema))
    return result.distinct()
