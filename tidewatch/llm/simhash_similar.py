"""Near copies by word-shingle similarity, complete: every pair of texts at ``least`` ends in one group.

Candidates come from a prefix filter on a text's distinct five-word shingles, rarest first.  Two sets
whose Jaccard similarity is ``least`` or more share at least least * max(n) shingles, so they share one among the
first n - ceil(least * n) + 1 of each, in any order that holds for all texts.  The order is by how often blocks of
texts repeat a shingle: each block adds up the shingles that two of its texts or more have, and the sums of all blocks rank
the FREQUENT commonest.  What many documents share comes last, so a passage that they share
makes no candidates of texts that are otherwise their own.

A pair meets under every such *token*.  Under the first one that it shares, what is left of both sets
bounds the overlap; then the two prefixes, which hold all tokens up to the smaller of their ends, bound it
again.  No pair that passes is lost, and what remains is checked exactly on the texts.

Only components are wanted, so pairs that are connected already need no check.  First, one member of each
token leads and is checked against the others, which makes no more pairs than there are tokens.
Only tokens whose members are not all connected go on: there a few members lead against all members of other
components that have not led, and sixteen times as many in the next round, until every
member has led.  A group of copies costs about one check per member; only members that never connect meet in all pairs.
All steps are joins and aggregates on (token, node), which Spark splits where a token is common.  What a round stores
is removed when it is over.

With ``threshold`` the links of ``simhash_anchors`` come first: texts whose fingerprints differ in that many bits or fewer are
one group too, and the components are those of both kinds of links.

Equal texts collapse first (``node``, a 64-bit hash of the text).  Components name the smallest id.

Null ids take no part.  Rows that share an id are judged each by its text: of a group, the rows of its smallest id and
text stay, rows that are alike in both come down to one.  Null and empty texts have no shingle
and are copies of each other.  Other columns are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.simhash_anchors import SLICE, components, near_duplicates, shingle_hashes
from tidewatch.session import Scratch, stored

Store = Callable[[DataFrame], DataFrame]
#: So many times as many members of a token lead in each round after the first.
GROWTH = 16
#: Shingles that have a rank of their own; all others are rare (rank 0).  The table that is broadcast has 8 bytes for each.
FREQUENT = 1 << 20
#: Shingles of a block of texts that are counted together.
BLOCK_SHINGLES = 1 << 22
#: Against rounding in bounds.
EPS = 1e-9


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles, ascending, in 62 bits; one for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, dtype=np.int64)
    parts = [np.unique(shingle_hashes(words[at : at + SLICE + size - 1], size) >> np.uint64(2)) for at in range(0, max(len(words) - size + 1, 1), SLICE)]
    return np.unique(np.concatenate(parts)).view("<i8")


def prefix(h: np.ndarray, ranked: np.ndarray, least: float = 0.8) -> tuple[int, np.ndarray]:
    """Number of shingles, and the first tokens: one at least is shared with every text that is similar.

    ``ranked`` holds (hash, rank) in order of the hash.  A token is a hash, or 2^62 plus the rank: rare ones come first.
    """
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked[:, 0], h), len(ranked) - 1)
        h = np.sort(np.where(ranked[at, 0] == h, ranked[at, 1] | 1 << 62, h))
    return len(h), h[: len(h) - math.ceil(least * len(h) - EPS) + 1]


def grams(text: bytes, size: int = 5) -> set:
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)}


def similarity(a: bytes, b: bytes, size: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; of the whole sequence for fewer words."""
    x, y = grams(a, size), grams(b, size)
    return len(x & y) / len(x | y)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))


def ranks(texts: DataFrame, size: int, stored: Store) -> np.ndarray:
    """(hash, rank) of the shingles that most texts repeat, at most FREQUENT, by hash; a larger rank is more frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(token[often]), pa.array(n[often])], names=["token", "n"])

        held, filled = [], 0
        for batch in batches:
            for t in batch.column("text"):
                held.append(shingles(t.as_py(), size))
                filled += len(held[-1])
                if filled >= BLOCK_SHINGLES:
                    yield counted()
                    held, filled = [], 0
        if held:
            yield counted()

    sums = stored(texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    step = F.floor(8 * F.log2("n")).cast("int")
    room, least = FREQUENT, None
    for r in sums.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = sums.where(F.lit(False) if least is None else step >= least).toArrow()
    token, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    rank = np.empty(len(n), dtype=np.int64)
    rank[np.lexsort((token, n))] = np.arange(1, len(n) + 1)
    by = np.argsort(token)
    return np.stack([token[by], rank[by]], axis=1)


def prefixes(texts: DataFrame, least: float, size: int, stored: Store) -> DataFrame:
    """Stored rows (node, n, tokens): the number of distinct shingles and the prefix."""
    sent = texts.sparkSession.sparkContext.broadcast(ranks(texts, size, stored))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [prefix(shingles(t.as_py(), size), sent.value, least) for t in batch.column("text")]
            tokens = pa.array([g[1] for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([g[0] for g in got], pa.int64()), tokens], names=["node", "n", "tokens"])

    once = texts.select("node", "text").mapInArrow(run, "node long, n long, tokens array<long>").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    return stored(once)


def postings(heads: DataFrame, stored: Store) -> DataFrame:
    """Stored rows (token, node, n, at, m): the token is number ``at`` of the node's n shingles, m > 1 nodes have it in their prefix."""
    each = heads.select("node", "n", F.posexplode("tokens").alias("at", "token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return stored(each.join(shared, "token").select("token", "node", "n", "at", "m"))


def bounded(pairs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose overlap may suffice by their prefixes."""
    b = heads.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    a = heads.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    both = pairs.join(b, "b").join(a, "a").withColumn("known", F.least(F.element_at("ta", -1), F.element_at("tb", -1)))
    rest = [F.col(n) - F.size(F.filter(F.col(t), lambda x: x <= F.col("known"))) for n, t in (("na", "ta"), ("nb", "tb"))]
    most = F.size(F.array_intersect("ta", "tb")) + F.least(*rest)
    return both.where(most >= (F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - F.lit(EPS)).select("a", "b")


def _enough(n_a: str, at_a: str, n_b: str, at_b: str, least: float) -> Column:
    """Whether the overlap may suffice if this token is the first that both have."""
    most = F.least(F.col(n_a) - F.col(at_a), F.col(n_b) - F.col(at_b))
    return most >= (F.col(n_a) + F.col(n_b)) * F.lit(least / (1 + least)) - F.lit(EPS)


def led(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b): the member of each token with the smallest hash, and every other whose overlap with it may suffice."""
    lead = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))).alias("l"))
    pairs = rows.join(lead.select("token", "l.a", "l.na", "l.ia"), "token").where(F.col("node") != F.col("a"))
    return pairs.where(_enough("na", "ia", "n", "at", least)).select("a", F.col("node").alias("b")).distinct()


def met(rows: DataFrame, low: float, high: float, least: float) -> DataFrame:
    """Pairs (a, b) of nodes in different components whose overlap may suffice: a leads under a token of both, b has not led in a round before."""
    turn = F.pmod(F.xxhash64("node"), F.lit(1 << 31)) / F.lit(float(1 << 31)) * F.col("m")
    rows = rows.withColumn("turn", turn).where(F.col("turn") >= low).withColumn("leads", F.col("turn") < high)
    lead = rows.where("leads").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("label").alias("la"))
    rest = rows.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("label").alias("lb"), "leads")
    return lead.join(rest, "token").where(F.col("la") != F.col("lb")).where(_enough("na", "ia", "nb", "ib", least)).where("NOT leads OR a < b").select("a", "b").distinct()


def checked(pairs: DataFrame, texts: DataFrame, least: float, size: int, stored: Store) -> DataFrame:
    """The stored pairs (a, b) that are similar; ``texts`` has a row per node."""
    pairs = stored(pairs)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends = stored(texts.join(ends, "node", "left_semi"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, set()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                if a != at:
                    at, x = a, grams(ta.as_py(), size)
                y = grams(tb.as_py(), size)
                n = len(x & y)
                keep.append(n / (len(x) + len(y) - n) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(ends.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(ends.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"))


def anchored(texts: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) from every node to the smallest one that links of fingerprints at ``threshold`` reach."""
    found = near_duplicates(texts.select("node", F.col("text").cast("string").alias("text")), "node", "text", threshold=threshold)
    return found.select(F.col("node").alias("a"), F.col("component_id").alias("b")).where("a != b").distinct()


def linked(texts: DataFrame, least: float, size: int, kept: Scratch, threshold: int | None = None) -> DataFrame:
    """Rows (node, root) for every node that is similar to another: components of all pairs at ``least``, and of
    the fingerprints at ``threshold``."""
    heads = prefixes(texts, least, size, kept.stored)
    rows, k, edges = postings(heads, kept.stored), -1, None
    if threshold is not None:
        edges = kept.stored(anchored(texts, threshold))

    def of_rows(table: DataFrame) -> DataFrame:
        """Only nodes that still have a token to look at go on: later rounds move little."""
        return table.join(rows.select("node").distinct(), "node", "left_semi")

    heads, texts = kept.stored(of_rows(heads)), kept.stored(of_rows(texts).groupBy("node").agg(F.first("text").alias("text")))
    while True:
        with Scratch(texts.sparkSession, "round") as scratch:
            pairs = led(rows, least) if k < 0 else met(rows, float(GROWTH**k) if k else 0.0, float(GROWTH ** (k + 1)), least)
            found = kept.stored(checked(bounded(scratch.stored(pairs), heads, least), texts, least, size, scratch.stored))
            edges = found if edges is None else edges.unionByName(found)
            names = kept.stored(components(edges, scratch.stored))
            if k >= 0:
                rows = rows.where(F.col("m") > GROWTH ** (k + 1))
            rows = rows.select("token", "node", "n", "at", "m").join(names, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
            rows = scratch.stored(rows)
            apart = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
            rows = kept.stored(rows.join(apart, "token", "left_semi"))
        if rows.isEmpty():
            return names
        heads, texts = kept.stored(of_rows(heads)), kept.stored(of_rows(texts))
        k += 1


def similar_nodes(docs: DataFrame, id_col: str, text_col: str, least: float, size: int, threshold: int | None = None) -> DataFrame:
    """Rows (id, node, component_id, keeps), one per row with an id; ``keeps`` marks the component's smallest id and text."""
    texts = _texts(docs, id_col, text_col)
    marked = texts.select("id", "node")
    classes = marked.groupBy("node").agg(F.min("id").alias("low"))
    with Scratch(docs.sparkSession, "near") as kept:
        named = stored(classes.join(linked(texts, least, size, kept, threshold), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "classes")
    lowest = named.groupBy("root").agg(F.min(F.struct("low", "node")).alias("first"))
    member = named.join(lowest, "root").select("node", F.col("first.low").alias("component_id"), F.col("first.node").alias("first"))
    return marked.join(member, "node").select("id", "node", "component_id", ((F.col("id") == F.col("component_id")) & (F.col("node") == F.col("first"))).alias("keeps"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    """(id, component_id) for every row with an id."""
    return similar_nodes(docs, id_col, text_col, least, size).select(F.col("id").alias(id_col), "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, size: int = 5,
                     threshold: int | None = None) -> DataFrame:
    """One document of each group, that of the smallest id and text, all columns kept; those with a null id stay.

    Of rows that share id and text, the one with the smallest hash of all columns stays.
    """
    groups = similar_nodes(docs, id_col, text_col, least, size, threshold)
    stay = groups.where("keeps").select(F.col("id").alias("__keep"), F.col("node").alias("__node")).distinct()
    node = F.xxhash64(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(stay, (named[id_col] == stay["__keep"]) & (node == stay["__node"]))
    columns = [named[c] for c in docs.columns]
    one = kept.groupBy(stay["__keep"], stay["__node"]).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return one.select("__row.*").unionByName(docs.where(F.col(id_col).isNull()))
