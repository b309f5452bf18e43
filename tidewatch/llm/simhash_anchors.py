"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints are 64 bits.  The anchors are the codewords of a product of two binary Golay
codes [23,12] on bits 0-22 and 23-45; each has covering radius 3, so every fingerprint has
exactly one *home* anchor within 3 bits in either block.  If two fingerprints differ in at
most t bits, then whatever the home of one, the other lies within 3+t1 and 3+t2 bits of it
with t1+t2 <= t.  So each distinct fingerprint is sent to every such anchor (about 61 for
t = 2), and is compared there with those at home only: every link is found, once.

Equal fingerprints collapse before anything is replicated.  2^24 anchors spread the rest;
a crowded anchor is a skewed join key, which adaptive execution splits.  Only links that
pass the comparison leave the join.  Components come from alternating star contractions
over the links, each round stored, and get the smallest id of their documents.

Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows
and repeated ids give a row each.  Null ids get a fingerprint and a component, but never
name one.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import stored

#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1 (fixed value).
GOLAY = 0b110001110101
LENGTH, RADIUS = 23, 3
PARITY = 11
SLICE = 262_144


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64, seed 42, of every shingle of ``size`` words, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)] if words else [], dtype="<u8")
    shifted = zip(*(words[i:] for i in range(size)))
    return np.fromiter((digest(b" ".join(s), 42) for s in shifted), dtype="<u8", count=len(words) - size + 1)


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bit i is set if it is set in more than half of the shingle hashes."""
    words = text.lower().split()
    total, ones = 0, np.zeros(64, dtype=np.int64)
    for at in range(0, max(len(words) - size + 1, 1), SLICE):
        hashes = shingle_hashes(words[at : at + SLICE + size - 1], size)
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, fp long")


def _remainder(x: np.ndarray) -> np.ndarray:
    """x modulo the generator polynomial: zero for codewords."""
    x = x.copy()
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - PARITY), 0)
    return x


def error_patterns(spark: SparkSession, excess: int) -> DataFrame:
    """Rows (syndrome, pattern, over): y XOR pattern is a codeword for every y of that syndrome; over is what
    the pattern's weight exceeds the covering radius by.  For excess 2: 44,552 rows, whatever the data."""
    x = np.arange(1 << LENGTH, dtype=np.int64)
    weight = np.bitwise_count(x)
    x = x[weight <= RADIUS + excess]
    over = np.maximum(np.bitwise_count(x).astype(np.int64) - RADIUS, 0)
    rows = np.stack([_remainder(x), x, over], axis=1)
    return spark.createDataFrame(rows.tolist(), "syndrome long, pattern long, over long")


def _syndrome(block: Column) -> Column:
    """The remainder of a block, bit by bit as parities of masks."""
    columns = _remainder(np.int64(1) << np.arange(LENGTH, dtype=np.int64))
    out = F.lit(0).cast("long")
    for r in range(PARITY):
        mask = sum(1 << i for i in range(LENGTH) if columns[i] >> r & 1)
        out = out.bitwiseOR(F.shiftleft(F.bit_count(block.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)).cast("long"), r))
    return out


def replicate(fps: DataFrame, threshold: int) -> DataFrame:
    """Rows (fp, anchor, home): every anchor within covering radius plus threshold; home marks the nearest.

    The pattern table has a fixed size (44,552 rows for threshold 2) and is broadcast.
    """
    ones = F.lit((1 << LENGTH) - 1).cast("long")
    patterns = error_patterns(fps.sparkSession, threshold)
    b1, b2 = F.col("fp").bitwiseAND(ones), F.shiftrightunsigned("fp", LENGTH).bitwiseAND(ones)
    split = fps.select("fp", b1.alias("b1"), b2.alias("b2"), _syndrome(b1).alias("s1"), _syndrome(b2).alias("s2"))
    first = patterns.select(F.col("syndrome").alias("s1"), F.col("pattern").alias("p1"), F.col("over").alias("o1"))
    second = patterns.select(F.col("syndrome").alias("s2"), F.col("pattern").alias("p2"), F.col("over").alias("o2"))
    near = split.join(F.broadcast(first), "s1")
    near = near.join(F.broadcast(second), (near["s2"] == second["s2"]) & (F.col("o1") + F.col("o2") <= threshold))
    anchor = F.shiftleft(F.col("b1").bitwiseXOR(F.col("p1")), LENGTH).bitwiseOR(F.col("b2").bitwiseXOR(F.col("p2")))
    return near.select("fp", anchor.alias("anchor"), ((F.col("o1") == 0) & (F.col("o2") == 0)).alias("home"))


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in 1 to ``threshold`` bits, each once."""
    sent = replicate(fps, threshold)
    home = sent.where("home").select("anchor", F.col("fp").alias("a"))
    rest = sent.select("anchor", F.col("fp").alias("b"))
    return home.join(rest, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def components(edges: DataFrame, stored: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Rows (node, root): root is the smallest node of the component, for every node with an edge.

    Large-star and small-star steps in turn until nothing changes (logarithmically many
    rounds).  Minima are aggregated before the shuffle, so a node with very many
    neighbours is no group of its own; every round is stored.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())

    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stored(small.where("u != v").distinct())
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = 2) -> DataFrame:
    """One row per document: id, fp, fingerprint (16 hex digits), component_id, n_links (other fingerprints
    that its own links to), n_copies (documents with its fingerprint)."""
    marked = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n_copies")), "distinct")
    pairs = stored(links(distinct.select("fp"), threshold), "links")
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
    degree = ends.groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    member = components(pairs).withColumnRenamed("node", "fp")
    linked = distinct.join(member, "fp").join(degree, "fp")
    ids = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    known = linked.join(ids, "root").select("fp", "component_id", "n_links")
    classes = distinct.join(known, "fp", "left").select(
        "fp", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies",
    )
    out = marked.join(classes, "fp").select(
        F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links", "n_copies",
    )
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = 2) -> DataFrame:
    """The documents whose id is the smallest of their component, all columns kept.

    Rows that share that id (repeated rows) come down to one; documents with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col, size, threshold)
    stay = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__keep")).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(stay, named[id_col] == stay["__keep"]).drop("__keep").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
