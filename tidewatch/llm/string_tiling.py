"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs between white space and ASCII punctuation.  A Karp-Rabin value is
rolled over every ``min_match`` words of texts and benchmark items; equal values are
seeds.  A bitmap of fixed size (2^27 bits, 16 MB, whatever the benchmark's size) keeps
values that no item has out of the shuffle; the join on the value itself is exact.  Seeds
of a (document, item) pair that together could not cover the threshold are dropped by that
bound.  For the others, runs of seeds on a diagonal are the matches: the longest
match of unmarked words becomes a tile, what a tile cuts off is tried again, until no
match of ``min_match`` words is left.  As tiles may lie in any order, a passage whose
sentences were moved about is covered all the same.

Null and empty texts and items, and items of fewer than ``min_match`` words, match nothing.
Repeated rows give one pair; repeated item ids count with their best coverage.  Null ids are
reported as null.  Other columns are not read (``keep_clean`` passes them on).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITMAP_BITS = 27
BASE = np.uint64(0x100000001B3)
#: ASCII characters other than letters and digits part words.
APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(APART).split()


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound; forgetting only costs time."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def rolled(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Karp-Rabin value, modulo 2^64, of every window of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out *= BASE
        out += h[k : len(h) - size + 1 + k]
    return out


def tiles(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text position, item position, words) from seeds (text position, item position)."""
    seeds = sorted(set(pairs), key=lambda s: (s[0] - s[1], s[0]))
    heap: list[tuple[int, int, int]] = []
    start = 0
    for i in range(1, len(seeds) + 1):
        if i == len(seeds) or seeds[i] != (seeds[i - 1][0] + 1, seeds[i - 1][1] + 1):
            heap.append((-(i - start + size - 1), seeds[start][0], seeds[start][1]))
            start = i
    heapq.heapify(heap)
    used_text, used_item, out = set(), set(), []
    while heap:
        length, p, q = heapq.heappop(heap)
        free, run = [], 0
        for k in range(-length + 1):
            if k < -length and p + k not in used_text and q + k not in used_item:
                run += 1
                continue
            if run >= size:
                free.append((-run, p + k - run, q + k - run))
            run = 0
        if free == [(length, p, q)]:
            out.append((p, q, -length))
            used_text.update(range(p, p - length))
            used_item.update(range(q, q - length))
        else:
            for f in free:
                heapq.heappush(heap, f)
    return out


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bytes of the bitmap of all seed values; at most 2^21 words of 64 bits come to the driver."""
    bit = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    words = seeds.select(F.shiftrightunsigned(bit, 6).alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b")).groupBy("w")
    got = words.agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_match: int = 4, threshold: float = 0.5,
) -> DataFrame:
    """Pairs over the threshold: id, sig (hash of the text), item, coverage, covered_words, item_words, n_tiles, longest_tile."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                words = tokens(text.as_py())
                values = rolled(words, min_match, hashes)
                n = len(values)
                if n:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item.as_py()] * n, item.type), pa.array(np.full(n, len(words), np.int64)),
                        pa.array(np.arange(n, dtype=np.int64)), pa.array(values.view(np.int64)),
                    ], names=["item", "item_words", "q", "h"])

    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    seeds = items.mapInArrow(item_seeds, f"item {item_kind}, item_words long, q long, h long")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))

    def text_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), bits.value
        for batch in batches:
            rows, at, values = [], [], []
            for i, text in enumerate(batch.column("text")):
                h = rolled(tokens(text.as_py()), min_match, hashes)
                bit = h >> np.uint64(64 - BITMAP_BITS)
                p = np.flatnonzero(known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
                if len(p):
                    rows.append(np.full(len(p), i))
                    at.append(p)
                    values.append(h[p].view(np.int64))
            if rows:
                index = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(index), batch.column("sig").take(index), pa.array(np.concatenate(at)), pa.array(np.concatenate(values)),
                ], names=["id", "sig", "p", "h"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(text_seeds, f"id {kind}, sig long, p long, h long")
    pairs = found.join(seeds, "h").groupBy("id", "sig", "item", "item_words").agg(F.collect_set(F.struct("p", "q")).alias("seeds"))
    reach = F.size(F.array_distinct(F.transform("seeds", lambda s: s["q"]))) * min_match
    pairs = pairs.where(reach >= F.lit(threshold) * F.col("item_words"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [tiles([(s["p"], s["q"]) for s in row], min_match) for row in batch.column("seeds").to_pylist()]
            covered = [sum(t[2] for t in row) for row in got]
            n = batch.column("item_words").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("sig"), batch.column("item"), pa.array([c / w for c, w in zip(covered, n)], pa.float64()),
                pa.array(covered, pa.int64()), batch.column("item_words"), pa.array([len(row) for row in got], pa.int64()),
                pa.array([max((t[2] for t in row), default=0) for row in got], pa.int64()),
            ], names=["id", "sig", "item", "coverage", "covered_words", "item_words", "n_tiles", "longest_tile"])

    out = pairs.mapInArrow(tile, f"id {kind}, sig long, item {item_kind}, coverage double, covered_words long, item_words long, n_tiles long, longest_tile long")
    return out.where(F.col("coverage") >= threshold)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **parameters) -> DataFrame:
    """One row per contaminated (document id, item id), with its best coverage."""
    best = contaminated(docs, benchmark, id_col, item_col=item_col, **parameters).groupBy("id", "item").agg(
        F.max(F.struct("coverage", "covered_words", "item_words", "n_tiles", "longest_tile")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents that no item contaminates, all columns kept."""
    bad = contaminated(docs, benchmark, id_col, text_col, **parameters).select(F.col("id").alias("__id"), F.col("sig").alias("__sig")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col]) == bad["__sig"]), "left_anti")
