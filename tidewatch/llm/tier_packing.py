"""Packing of token sequences into context windows of several sizes.

Tiers are the powers of two from ``shortest`` to ``longest``.  A document is encoded and ends
with one more id.  What fills whole windows of the longest tier is cut off at once; the rest, or a
shorter document, is routed to the smallest tier that holds it.  Tiers are packed from long to short: a
piece opens a window of its tier, the gap is filled with the longest pieces of shorter tiers
that fit, and what no whole piece fits is filled with the head of one that is cut.  So every window is
full.  The last few pieces of a partition, too few for a window, are cut at powers of two.

Packing happens where the documents are read, pool by pool: nothing is shuffled, a task holds one pool of
pieces, and a lost task packs its partition again alike.  ``sequence_id`` is the partition's number times
2^32 plus a count.  ``balance_steps`` then numbers the sequences of each tier over all partitions, by
prefix sums of their counts, and deals them out to training steps of equal token counts.

The vocabulary file is that of the ``tokenizers`` library.  The same vocabulary and merges run in ``tiktoken``,
which gives the same ids about four times as fast (a test compares both libraries).

Null and empty texts are the end id alone.  Rows that repeat an id, or a whole row, are packed each by itself, under
that id.  Null ids are kept.  Other columns are not read.  No documents give no pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.session import stored

#: Texts are encoded in chunks of about so many characters, so that the library's work memory stays small.
CHUNK_CHARS = 1 << 20
#: A task packs so many tokens of waiting pieces together.
POOL_TOKENS = 1 << 20
#: Partitions whose counts are added up together before the prefix sum over all of them.
SPAN = 1024


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str):
    """A tokenizer of a byte-level BPE file of the ``tokenizers`` library; read once in each Python worker."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    step = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"] or spec["normalizer"]:
        raise ValueError(f"{vocabulary} is not a plain byte-level BPE")
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"the merges of {vocabulary} are not in the order of their ids")
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ids, special_tokens=special)


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Parts of a text whose ids follow each other like those of the text: cuts lie before white space that follows none."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not (text[cut] in " \n\t" and not text[cut - 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(text: str | None, vocabulary: str, pattern: str, end_id: int | None = 0, size: int = CHUNK_CHARS) -> np.ndarray:
    """Ids of a text, special tokens included where the text holds them, then ``end_id``."""
    to_ids = encoder(vocabulary, pattern).encode_to_numpy
    parts = [to_ids(c, allowed_special="all").astype("<u4") for c in chunks(text or "", size) if c]
    return np.concatenate([*parts, np.array([] if end_id is None else [end_id], dtype="<u4")])


class Pool:
    """Waiting pieces (document row, start, length) by length; the set of lengths is one integer's bits."""

    def __init__(self, longest: int):
        self.stacks: list[list] = [[] for _ in range(longest + 1)]
        self.lengths = self.tokens = 0

    def add(self, row: int, start: int, length: int) -> None:
        self.stacks[length].append((row, start))
        self.lengths |= 1 << length
        self.tokens += length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens."""
        length = (self.lengths & ((2 << most) - 1)).bit_length() - 1
        if length < 1:
            return None
        row, start = self.stacks[length].pop()
        if not self.stacks[length]:
            self.lengths ^= 1 << length
        self.tokens -= length
        return row, start, length


def pack_pool(pool: Pool, shortest: int, longest: int, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Full windows (size, pieces); what fills none stays in the pool, or is cut at powers of two if it is the last."""
    while pool.tokens:
        piece = pool.take(longest)
        size = max(shortest, 1 << (piece[2] - 1).bit_length())
        window, gap = [piece], size - piece[2]
        if pool.tokens < gap:
            pool.add(*piece)
            break
        while gap:
            more = pool.take(gap)
            if more is None:
                row, start, length = pool.take(longest)
                pool.add(row, start + gap, length - gap)
                more = (row, start, gap)
            window.append(more)
            gap -= more[2]
        yield size, window
    size = longest
    while last and pool.tokens:
        while size > pool.tokens:
            size //= 2
        window, gap = [], size
        while gap:
            row, start, length = pool.take(longest)
            if length > gap:
                pool.add(row, start + gap, length - gap)
            window.append((row, start, min(length, gap)))
            gap -= window[-1][2]
        yield size, window


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    longest: int = 1024, shortest: int = 64, end_id: int = 0, pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """Pieces: id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset, tier, tier_rank.

    ``tier`` is the length of the sequence, ``tier_rank`` counts the partition's sequences of that tier.
    """
    if longest & (longest - 1) or shortest & (shortest - 1) or not 0 < shortest <= longest:
        raise ValueError("tiers are powers of two")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        pool, waiting, ranks, made, kind = Pool(longest), {}, {}, 0, None
        columns = ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "tier_rank")
        rows: dict[str, list] = {c: [] for c in columns}

        def put(size: int, window: list[tuple[int, int, int]]) -> None:
            """One sequence; a row's ids are kept from ``base`` on, until its ``left`` tokens are placed."""
            nonlocal made
            at, rank = 0, ranks.get(size, 0)
            for row, start, length in window:
                name, ids, base, total, left = waiting[row]
                values = (name, start, length, ids[start - base : start - base + length].tobytes(), total, first + made, at, size, rank)
                for column, value in zip(rows.values(), values):
                    column.append(value)
                at += length
                if left > length:
                    waiting[row] = (name, ids, base, total, left - length)
                else:
                    del waiting[row]
            made, ranks[size] = made + 1, rank + 1

        def full(least: int = 4096) -> Iterator[pa.RecordBatch]:
            if len(rows["id"]) >= least:
                types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))
                for v in rows.values():
                    v.clear()

        count = 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py(), vocabulary, pattern, end_id)
                total = len(ids)
                whole = total - total % longest
                waiting[count] = (name, ids, 0, total, total)
                for start in range(0, whole, longest):
                    put(longest, [(count, start, longest)])
                    yield from full()
                if total > whole:
                    waiting[count] = (name, ids[whole:].copy(), whole, total, total - whole)
                    pool.add(count, whole, total - whole)
                count += 1
                if pool.tokens >= pool_tokens:
                    for window in pack_pool(pool, shortest, longest, last=False):
                        put(*window)
                yield from full()
        for window in pack_pool(pool, shortest, longest, last=True):
            put(*window)
        yield from full(1)

    schema = f"id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, tier_rank long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """Rows (sequence_id, tier, ids binary): the ids of each window in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id", "tier").agg(F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def balance_steps(pieces: DataFrame, step_tokens: int = 1 << 17) -> DataFrame:
    """Adds step_id, numbering per tier: steps of one tier that hold ``step_tokens`` tokens each (a tier's last step: the rest).

    ``pieces`` (without wide columns, please) is stored, as it is read for the counts and again for the numbers.
    """
    pieces = stored(pieces.withColumn("__part", F.shiftright("sequence_id", 32)), "pieces")
    counts = pieces.where("offset = 0").groupBy("tier", "__part").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("__part") / SPAN))
    spans = counts.groupBy("tier", "span").agg(F.sum("n").alias("n"))
    before = spans.select("tier", "span", (F.sum("n").over(Window.partitionBy("tier").orderBy("span")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("tier", "span").orderBy("__part")) - F.col("n")
    base = counts.withColumn("within", within).join(before, ["tier", "span"]).select("tier", "__part", (F.col("before") + F.col("within")).alias("base"))
    number = F.col("base") + F.col("tier_rank")
    each = F.greatest(F.lit(step_tokens) / F.col("tier"), F.lit(1)).cast("long")
    return pieces.join(base, ["tier", "__part"]).withColumn("step_id", F.floor(number / each)).drop("__part", "base")
