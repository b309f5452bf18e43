"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``; only A-Z are lower-cased.  Of two near words, one half of the shorter
is also at the same end of the longer.  So every word is filed under the first and the last half of its letters, for its own
length (it may be searched for, and found) and for one less (it may be found by words one letter shorter).  Keys are dealt by hash to blocks of
about ``BLOCK`` words; a key with more words than ``CROWD`` has blocks of its own, its words are dealt over them, and each is searched for in
all of them.  Nothing depends on how common a word or key is, and no pair is listed that is not near.

In a block, a bit-sliced index has a set of words (bits of 64-bit integers) per position and letter.  All words searched for move on together,
letter by letter; three sets for each of them are kept at once: no error so far, one letter replaced, one letter
more in the other word.  The third is matched with the index one position further on.  Only the
slices of two positions are held, so very long words need little memory.

A word's form is its near word of largest count, if that is at least twice its own; roots follow forms to the end.  As counts
double with each step, chains are short, and pointer doubling ends after a few rounds.

Null texts have no words.  Null ids count as the empty text in the rule that damages words.  Rows that repeat an
id, or a whole row, count each by itself.  Other columns are not read.  Without documents there are no words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import LOWER, UPPER
from tidewatch.session import stored

#: Words of a block, and of a key from which on it has blocks of its own.
BLOCK, CROWD = 1024, 2048
#: Texts are read in blocks of about so many bytes.
TEXT_BYTES = 1 << 24

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes of the letters.  U+00C0 to U+00FF are the byte C3 and one more.
ASCII_LETTER = np.isin(np.arange(256), np.frombuffer((UPPER + LOWER).encode(), dtype=np.uint8))
LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32_of(prefixes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of prefix + data[start : start + length] for many runs, byte by byte over all at once; prefixes are crc32 values."""
    order = np.argsort(-length, kind="stable")
    start, state = start[order], ~prefixes[order]
    for k, n in enumerate(np.cumsum(np.bincount(length)[::-1])[::-1][1:]):  # n runs are longer than k
        state[:n] = CRC[(state[:n] ^ data[start[:n] + k]) & np.uint32(255)] ^ state[:n] >> np.uint32(8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, length and text number of every run of letters."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]).translate(LOWERED), dtype=np.uint8)
    letter = ASCII_LETTER[data]
    lead = data == LEAD
    letter |= lead
    letter[1:] |= lead[:-1]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    return data, start, end - start, np.searchsorted(first, start, side="right") - 1


def damaged(word: bytes, h: int) -> bytes:
    """The word without its letter h % length."""
    letters = word.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def count_runs(ids: list[str], texts: list[bytes], damage: int | None, shortest: int) -> Counter:
    """Words of a block with their counts; where ``damage`` divides crc32('<id>:<run>'), the run loses a letter."""
    import zlib

    data, start, length, text = runs_of(texts)
    keep = length >= shortest
    start, length, text = start[keep], length[keep], text[keep]
    if not len(start):
        return Counter()
    offsets = np.empty(2 * len(start) + 1, dtype=np.int64)
    offsets[:-1:2], offsets[1::2], offsets[-1] = start, start + length, len(data)
    every = pa.Array.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    own = every.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    code, words = own.indices.to_numpy(), own.dictionary.to_pylist()
    hit = np.zeros(len(code), dtype=bool)
    if damage is not None:
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
        h = crc32_of(before[text], data, start, length)
        hit = h % np.uint32(damage) == 0
    out = Counter()
    for k in np.flatnonzero(hit):
        out[damaged(words[code[k]], int(h[k]))] += 1
    n = np.bincount(code[~hit], minlength=len(words))
    for k in np.flatnonzero(n):
        out[words[k]] += int(n[k])
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None, shortest: int = 5, least: int = 3) -> DataFrame:
    """Stored rows (word, n): words of at least ``shortest`` letters found ``least`` times or more in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts() -> pa.RecordBatch:
            got = count_runs(ids, texts, damage, shortest)
            return pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.binary()).cast(pa.string()), pa.array(got.values(), pa.int64())], names=["word", "n"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                t = text.as_buffer()
                if t is None or not t.size:
                    continue
                ids.append(i)
                texts.append(t.to_pybytes())
                size += t.size
                if size >= TEXT_BYTES:
                    yield counts()
                    ids, texts, size = [], [], 0
        if texts:
            yield counts()

    read = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    words = read.mapInArrow(run, "word string, n long").where(F.char_length("word") >= shortest)
    return stored(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "vocabulary")


class Slices:
    """The words of a block as one set of bits per position and letter; built position by position."""

    def __init__(self, words: list[bytes]):
        self.size = np.array([len(w) for w in words])
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.width = -(-len(words) // 64)
        self.seat = np.arange(len(words))

    def letters(self, position: int) -> np.ndarray:
        """For each of 256 letters, the words that have it at the position."""
        out = np.zeros((256, self.width), dtype=np.uint64)
        has = self.seat[self.size > position]
        np.bitwise_or.at(out, (self.flat[self.at[has] + position], has >> 6), np.uint64(1) << (has & 63).astype(np.uint64))
        return out

    def of_size(self, sizes: np.ndarray) -> np.ndarray:
        """For each size, the words of that size."""
        distinct, which = np.unique(sizes, return_inverse=True)
        out = np.zeros((len(distinct), self.width), dtype=np.uint64)
        for k, n in enumerate(distinct):
            has = self.seat[self.size == n]
            np.bitwise_or.at(out[k], has >> 6, np.uint64(1) << (has & 63).astype(np.uint64))
        return out[which]


def near_in_block(queries: list[bytes], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) of words, as one byte a letter, that differ by one replaced letter or by one more in the word."""
    index = Slices(words)
    size = np.array([len(q) for q in queries])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat, at = np.frombuffer(b"".join(queries), dtype=np.uint8), (np.cumsum([0, *map(len, queries)])[:-1])[order]
    zero = np.full((len(queries), index.width), np.uint64(2**64 - 1))
    replaced, longer = np.zeros_like(zero), np.zeros_like(zero)
    here = index.letters(0)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))  # queries of more than k letters
        ahead = index.letters(k + 1)
        letter = flat[at[:n] + k]
        same, later = here[letter], ahead[letter]
        longer[:n] = (longer[:n] | zero[:n]) & later
        replaced[:n] = replaced[:n] & same | zero[:n] & ~same
        zero[:n] &= same
        here = ahead
    found = replaced & index.of_size(size) | (longer | zero) & index.of_size(size + 1)
    row, cell = np.nonzero(found)
    bits = np.unpackbits(found[row, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return order[row[which]], cell[which] * 64 + bit


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (word, near, n): all pairs of near words in both orders, with the count of ``near``."""
    size = F.char_length("word")
    part = lambda side, s: F.expr(f"{side}(word, ({s}) div 2)")
    keys = F.array(*(
        F.struct(F.xxhash64(size - less, F.lit(side), part(side, f"char_length(word) - {less}")).alias("key"), F.lit(side == "right").alias("last"), F.lit(less == 0).alias("asks"))
        for side in ("left", "right") for less in (0, 1)
    ))
    filed = stored(words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*"), "filed")
    blocks = max(1, -(-filed.count() // BLOCK))
    crowd = filed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD)
    dealt = filed.join(crowd.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("seats")), "key", "left")
    seat = F.pmod(F.xxhash64("word"), F.col("seats")).cast("int")
    seats = F.when(F.col("seats").isNull(), F.array(F.lit(-1))).when(F.col("asks"), F.sequence(F.lit(0), F.col("seats") - 1)).otherwise(F.array(seat))
    dealt = dealt.withColumn("own", F.coalesce(seat, F.lit(-1))).withColumn("seat", F.explode(seats))
    block = F.when(F.col("seat") < 0, F.pmod("key", F.lit(blocks))).otherwise(F.col("key"))
    dealt = dealt.select(block.alias("block"), "seat", "key", "last", "asks", (F.col("seat") == F.col("own")).alias("found"), "word", "n")

    def run(table: pa.Table) -> pa.Table:
        text = np.array(table.column("word").to_pylist(), dtype=object)
        letters = np.array([w.encode("latin-1") for w in text], dtype=object)
        key, last, n = (table.column(c).to_numpy() for c in ("key", "last", "n"))
        asks, found = np.flatnonzero(table.column("asks").to_numpy()), np.flatnonzero(table.column("found").to_numpy())
        q, w = near_in_block(letters[asks].tolist(), letters[found].tolist()) if len(asks) and len(found) else (np.zeros(0, int), np.zeros(0, int))
        q, w = asks[q], found[w]
        own = key[q] == key[w]  # blocks hold several keys; a pair counts under its own
        q, w = q[own], w[own]
        twice = np.array([bool(l) and a[: len(a) // 2] == b[: len(a) // 2] for l, a, b in zip(last[q], letters[q], letters[w])], dtype=bool)
        q, w = q[~twice], w[~twice]  # the first halves are alike too: found there
        more = np.array([len(letters[b]) > len(letters[a]) for a, b in zip(q, w)], dtype=bool)
        a, b = np.r_[q, w[more]], np.r_[w, q[more]]
        return pa.table({"word": pa.array(text[a], pa.string()), "near": pa.array(text[b], pa.string()), "n": pa.array(n[b], pa.int64())})

    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 16)  # a task has few blocks, however many words there are
    return dealt.repartition(tasks, "block", "seat").groupBy("block", "seat").applyInArrow(run, "word string, near string, n long")


def roots_of(links: DataFrame) -> DataFrame:
    """Rows (word, root) for links (word, form) without cycles: the end of each chain, by pointer doubling."""
    ends = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """Rows word, form, root, n, n_near, form_n for a vocabulary (word, n) without repeated words; letters up to U+00FF."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("m", -F.col("best.n"))
    good = F.col("m") >= factor * F.col("n")
    rows = stored(joined.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("m")).alias("form_n")), "forms")
    roots = roots_of(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
