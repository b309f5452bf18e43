"""Language-model scores by prediction by partial matching over byte contexts.

The trie of byte contexts up to ``order`` is a set of tables, one per depth: a node's row is
(context, next symbol, count).  Symbols are the 256 bytes and an end of text, so a model
is a distribution over whole texts.  Escapes are estimated by method D (distinct symbols
over twice the count), and symbols that a longer context has seen are excluded below it.
Below depth 0 all symbols not yet excluded are equal.

Counting, building and scoring are Spark jobs whose tables grow with the corpus; nothing of
the model is broadcast or collected (three totals apart).  Texts are cut at white space into
segments that carry the bytes before them, so scores of segments add up and a very long
text is spread.  Segments are packed into blocks of bounded bytes.  A block (or each part of it, if tasks share it) asks
once for every distinct gram and word that it holds; the keys travel packed, dealt by hash
to buckets, where those of all blocks meet, are summed, and go back with counts and costs.
Then each block scores its own segments with array lookups.

The training texts are those with ``held_out`` false.  Null texts are empty: one end, no
word.  Rows that share id and text are scored once and come back as many times.  Null ids
are ids of their own.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import work_folder

SEGMENT_BYTES = 65_536
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
BUCKET_KEYS = 4_000_000
SYMBOL_BITS = 9
END = 256
GRAM, WORD, ENDS = 0, 1, 2


def cut(text: bytes, size: int = SEGMENT_BYTES) -> list[int]:
    """Segment ends: the first white space at or after each ``size`` bytes, and the end of the text."""
    ends, at = [], 0
    while len(text) - at > size:
        at += size
        while at < len(text) and text[at] not in b" \t\n\x0b\x0c\r":
            at += 1
        ends.append(at)
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def grams(contexts: list[bytes], datas: list[bytes], lasts: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All (context, symbol) numbers of the segments, and how many each segment has."""
    tail = [b"\0" if last else b"" for last in lasts]
    raw = np.frombuffer(b"".join(p for t in zip(contexts, datas, tail) for p in t) + b"\0", dtype=np.uint8)[:-1]
    lengths = np.array([len(d) for d in datas], dtype=np.int64) + np.array(lasts, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + order)])
    real = np.ones(len(raw), dtype=bool)
    for k in range(order):
        real[starts[:-1] + k] = False
    at = np.flatnonzero(real)
    symbol = raw.astype(np.int64)
    symbol[starts[1:][np.array(lasts, dtype=bool)] - 1] = END
    out = symbol[at]
    for k in range(1, order + 1):
        out |= raw[at - k].astype(np.int64) << (SYMBOL_BITS + 8 * (k - 1))
    return out, lengths


def _segments(docs: DataFrame, held_out: Column, id_col: str, text_col: str, order: int) -> DataFrame:
    """Stored rows (block, id, sig, held, n_seg, last, context, data), the rows of a block together."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, filled = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("block", "id", "sig", "held", "n_seg", "last", "context", "data")}
            size, id_type = 0, batch.column("id").type
            schema = pa.schema([("block", pa.int64()), ("id", id_type), ("sig", pa.int64()), ("held", pa.bool_()), ("n_seg", pa.int64()),
                                ("last", pa.bool_()), ("context", pa.binary()), ("data", pa.binary())])
            for key, sig, held, text in zip(*(batch.column(c) for c in ("id", "sig", "held", "text"))):
                text = text.as_py().lower()
                ends = cut(text)
                for start, end in zip([0, *ends], ends):
                    before = text[max(start - order, 0) : start]
                    for name, value in zip(rows, (block, key.as_py(), sig.as_py(), held.as_py(), len(ends), end == len(text),
                                                  before.rjust(order, b"\0"), text[start:end])):
                        rows[name].append(value)
                    size += end - start
                    filled += end - start
                    if filled >= BLOCK_BYTES:
                        block, filled = block + 1, 0
                    if size >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_pydict(rows, schema=schema)
                        rows, size = {k: [] for k in rows}, 0
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    text = F.coalesce(F.col(text_col), F.lit(""))
    ready = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("sig"), held_out.alias("held"), text.cast("binary").alias("text"))
    return _compact(ready.mapInArrow(run, f"block long, id {kind}, sig long, held boolean, n_seg long, last boolean, context binary, data binary"), "segments")


def _compact(df: DataFrame, purpose: str) -> DataFrame:
    """Write in the shared work folder with the denser codec, and read again."""
    path = work_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes, dtype: str = "<i8") -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return pack(np.diff(keys, prepend=np.int64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    u = keys.view(np.uint64)
    return ((u ^ u >> np.uint64(9) ^ u >> np.uint64(17)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % buckets


def bucket_column(key: Column, buckets: int) -> Column:
    mixed = key.bitwiseXOR(F.shiftrightunsigned(key, 9)).bitwiseXOR(F.shiftrightunsigned(key, 17))
    return (mixed.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) % buckets).cast("long")


REQUEST = "bucket long, block long, g_keys binary, g_n binary, w_keys binary, w_n binary, ends long"


def _requests(segments: DataFrame, order: int, buckets: int) -> DataFrame:
    """Stored rows (bucket, block, packed grams and counts, packed words and counts, ends): what a block, or the part of it that
    a task reads, holds: each distinct gram and word once with its count in training texts, dealt to buckets by the
    key.  Buckets without a key get no row, so there are never more rows than keys."""

    def counted(block: int, parts: list, words: Counter, others: set, ends: int) -> pa.RecordBatch:
        import xxhash

        grams_, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        grams_n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        names = [*words, *(w for w in others if w not in words)]
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names)).view(np.int64)
        words_n = np.zeros(len(names), dtype=np.int64)
        words_n[: len(words)] = np.fromiter(words.values(), np.int64, len(words))
        homes = [bucket_of(keys, buckets) for keys in (grams_, hashed)]
        used = np.unique(np.concatenate([*homes, np.zeros(int(ends > 0), dtype=np.int64)]))
        split = []
        for keys, n, home in ((grams_, grams_n, homes[0]), (hashed, words_n, homes[1])):
            by = np.lexsort((keys, home))
            keys, n, home = keys[by], n[by], home[by]
            first, after = np.searchsorted(home, used), np.searchsorted(home, used, side="right")
            split.append([(pack_keys(keys[i:j]), pack(n[i:j])) for i, j in zip(first, after)])
        return pa.RecordBatch.from_pydict({
            "bucket": used, "block": np.full(len(used), block), "g_keys": [x[0] for x in split[0]], "g_n": [x[1] for x in split[0]],
            "w_keys": [x[0] for x in split[1]], "w_n": [x[1] for x in split[1]], "ends": np.where(used == 0, ends, 0),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        block, parts, words, others, ends = None, [], Counter(), set(), 0
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            breaks = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for a, b in zip(breaks, breaks[1:]):
                if a == b:
                    continue
                if block is not None and blocks[a] != block:
                    yield counted(block, parts, words, others, ends)
                    parts, words, others, ends = [], Counter(), set(), 0
                block = int(blocks[a])
                held, last, context, data = (batch.column(c).slice(a, b - a).to_pylist() for c in ("held", "last", "context", "data"))
                for i, j in _chunks(data):
                    numbers, lengths = grams(context[i:j], data[i:j], last[i:j], order)
                    codes, unique = pd.factorize(numbers)
                    weights = np.repeat(1.0 - np.array(held[i:j], dtype=np.float64), lengths)
                    parts.append((unique, np.bincount(codes, weights=weights, minlength=len(unique))))
                for out, is_last, text in zip(held, last, data):
                    if out:
                        others.update(text.split())
                    else:
                        words.update(text.split())
                        ends += is_last
        if block is not None:
            yield counted(block, parts, words, others, ends)

    return _compact(segments.select("block", "held", "last", "context", "data").mapInArrow(run, REQUEST), "requests")


def _chunks(data: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of segments of about CHUNK_BYTES together."""
    start = size = 0
    for i, text in enumerate(data):
        size += len(text)
        if size >= CHUNK_BYTES or i + 1 == len(data):
            yield start, i + 1
            start, size = i + 1, 0


TOTAL = "kind byte, block long, key long, n long, keys binary, vals binary"


def _totals(requests: DataFrame, tasks: int) -> DataFrame:
    """Stored rows per bucket: GRAM (key, n: count in all training texts), WORD (block, keys, vals: the
    counts of the block's words), ENDS (key: distinct training words, n: their uses)."""

    def run(table: pa.Table) -> pa.Table:
        def together(keys_of: str, n_of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
            keys = [unpack_keys(x) for x in table.column(keys_of).to_pylist()]
            n = np.concatenate([unpack(x) for x in table.column(n_of).to_pylist()])
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return unique, np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64), inverse, np.cumsum([len(k) for k in keys])[:-1]

        grams_, grams_n, _, _ = together("g_keys", "g_n")
        words, words_n, inverse, ends = together("w_keys", "w_n")
        replies = [pack(x) for x in np.split(words_n[inverse], ends)]
        m, k = len(grams_), len(replies)
        none = np.zeros(k + 1, dtype=np.int64)
        return pa.table({
            "kind": pa.array(np.repeat(np.array([GRAM, WORD, ENDS], dtype=np.int8), [m, k, 1])),
            "block": pa.chunked_array([np.zeros(m, np.int64), table.column("block").combine_chunks(), [0]], pa.int64()),
            "key": np.concatenate([grams_, none[:k], [(words_n > 0).sum()]]), "n": np.concatenate([grams_n, none[:k], [words_n.sum()]]),
            "keys": pa.array([None] * m + table.column("w_keys").to_pylist() + [None], pa.binary()),
            "vals": pa.array([None] * m + replies + [None], pa.binary()),
        })

    return _compact(requests.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, TOTAL), "totals")


def _replies(requests: DataFrame, costs: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """Rows (block, kind, keys, vals): the costs of a block's grams, bucket by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, value = right.column("key").to_numpy(), right.column("value").to_numpy()
        by = np.argsort(key)
        key, value = key[by], value[by]
        vals = [pack(value[np.searchsorted(key, unpack_keys(x))]) for x in left.column("g_keys").to_pylist()]
        return pa.table({"block": left.column("block"), "kind": pa.array(np.full(len(vals), GRAM, np.int8)), "keys": left.column("g_keys"), "vals": pa.array(vals, pa.binary())})

    asked = requests.select("bucket", "block", "g_keys").repartition(tasks, "bucket").groupBy("bucket")
    given = costs.select(bucket_column(F.col("key"), buckets).alias("bucket"), "key", "value").repartition(tasks, "bucket").groupBy("bucket")
    return asked.cogroup(given).applyInArrow(run, "block long, kind byte, keys binary, vals binary")


def gram_costs(counts: DataFrame, order: int) -> DataFrame:
    """(key, value): log10 probability of the symbol after its context, for every gram in ``counts`` (key, n)."""
    levels = {order: _compact(counts.select(F.col("key").alias("g"), F.col("n").alias("c")), "trie")}
    for j in range(order - 1, -1, -1):
        mask = F.lit((1 << (SYMBOL_BITS + 8 * j)) - 1).cast("long")
        levels[j] = _compact(levels[j + 1].groupBy(F.col("g").bitwiseAND(mask).alias("g")).agg(F.sum("c").alias("c")), "trie")
    by = Window.partitionBy(F.shiftright("g", SYMBOL_BITS))  # at most 257 rows

    def node(j: int) -> DataFrame:
        return levels[j].select("g", "c", F.sum("c").over(by).alias("n"), F.sum((F.col("c") > 0).cast("long")).over(by).alias("q"))

    # below: log10 probability of a symbol that the node has not seen, all longer contexts' symbols excluded
    here = node(0).withColumn("below", -F.log10(F.greatest(F.lit(END + 1) - F.col("q"), F.lit(1))))
    for j in range(1, order + 1):
        mask = F.lit((1 << (SYMBOL_BITS + 8 * (j - 1))) - 1).cast("long")
        up = here.select(F.col("g").alias("g0"), F.col("c").alias("c0"), F.col("n").alias("n0"), F.col("q").alias("q0"), F.col("below").alias("below0"))
        joined = node(j).join(up, F.col("g").bitwiseAND(mask) == F.col("g0"))
        left = F.col("n0") - F.sum(F.when(F.col("c") > 0, F.col("c0")).otherwise(0)).over(by)
        fresh = F.col("q0") - F.col("q")
        joined = joined.withColumn("left", left).withColumn("fresh", fresh)
        below = F.when(F.col("c0") > 0, F.log10((2 * F.col("c0") - 1) / (2 * F.col("left"))))
        below = below.when(F.col("fresh") > 0, F.log10(F.col("fresh") / (2 * F.col("left"))) + F.col("below0")).otherwise(F.col("below0"))
        here = joined.select("g", "c", "n", "q", F.when(F.col("c") > 0, F.lit(0.0)).otherwise(below).alias("below"))
    value = F.when(F.col("c") > 0, F.log10((2 * F.col("c") - 1) / (2 * F.col("n"))))
    value = value.when(F.col("n") > 0, F.log10(F.col("q") / (2 * F.col("n"))) + F.col("below")).otherwise(F.col("below"))
    return here.select(F.col("g").alias("key"), value.alias("value"))


def _scored(segments: DataFrame, costs: DataFrame, order: int, n_all: int, n_distinct: int, n_ends: int, tasks: int) -> DataFrame:
    """Per segment: tokens, known tokens, word score and model score."""
    kind = segments.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import pandas as pd
        import xxhash

        left = left.combine_chunks()
        keys: dict[int, list] = {GRAM: [np.zeros(0, np.int64)], WORD: [np.zeros(0, np.int64)]}
        vals: dict[int, list] = {GRAM: [np.zeros(0)], WORD: [np.zeros(0, np.int64)]}
        for kind_, k, v in zip(*(right.column(c).to_pylist() for c in ("kind", "keys", "vals"))):
            keys[kind_].append(unpack_keys(k))
            vals[kind_].append(unpack(v, "<f8" if kind_ == GRAM else "<i8"))
        numbers, first = np.unique(np.concatenate(keys[GRAM]), return_index=True)  # parts of a block may ask for the same
        index, cost = pd.Index(numbers), np.concatenate(vals[GRAM])[first]
        hashes = np.concatenate(keys[WORD])
        by = np.argsort(hashes)
        hashes, counts = hashes[by], np.concatenate(vals[WORD])[by]
        cost_of_all = np.log10(n_all + n_distinct + 1.0)

        class Logs(dict):
            def __missing__(self, word: bytes) -> float:
                c = counts[np.searchsorted(hashes, np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64))]
                out = self[word] = math.log10(c + 1.0) if c else -1.0
                return out

        logs, rest = Logs(), n_ends
        scores, bases, tokens, knowns = [], [], [], []
        last, context, data = (left.column(c).to_pylist() for c in ("last", "context", "data"))
        for i, j in _chunks(data):
            numbers, lengths = grams(context[i:j], data[i:j], last[i:j], order)
            of_all, filled = cost[index.get_indexer(numbers)], lengths > 0
            sums = np.zeros(j - i)
            sums[filled] = np.add.reduceat(of_all, (np.cumsum(lengths) - lengths)[filled]) if len(of_all) else 0.0
            scores.append(sums)
        for is_last, text in zip(last, data):
            words = text.split()
            got = np.fromiter(map(logs.__getitem__, words), np.float64, len(words))
            known = got >= 0
            base, n, k = got[known].sum(), len(words), int(known.sum())
            if is_last:
                base, n, k = base + np.log10(rest + 1.0), n + 1, k + (rest > 0)
            bases.append(base - n * cost_of_all)
            tokens.append(n)
            knowns.append(k)
        return pa.table({
            "id": left.column("id"), "sig": left.column("sig"), "held": left.column("held"), "n_seg": left.column("n_seg"),
            "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(knowns, pa.int64()),
            "base": pa.array(bases, pa.float64()), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64()),
        })

    texts = segments.select("block", "id", "sig", "held", "n_seg", "last", "context", "data").repartition(tasks, "block").groupBy("block")
    return texts.cogroup(costs.repartition(tasks, "block").groupBy("block")).applyInArrow(
        run, f"id {kind}, sig long, held boolean, n_seg long, n_tokens long, n_known long, base double, score double")


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 4) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score (word unigrams), score (the trie)."""
    if not 0 <= order <= 6:
        raise ValueError("a gram of more than six bytes and a symbol does not fit one number")
    segments = _segments(docs, held_out, id_col, text_col, order)
    blocks = segments.select("block").distinct().count()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, blocks * 1_000_000 // BUCKET_KEYS)  # a block of 32 MB has about a million distinct keys
    few, many = max(least, blocks), max(least, buckets)  # about one group a task, however large the corpus
    asked = _requests(segments, order, buckets)
    totals = _totals(asked, many)
    n_distinct, n_words = totals.where(F.col("kind") == ENDS).agg(F.sum("key"), F.sum("n")).first()
    n_ends = asked.agg(F.sum("ends")).first()[0] or 0
    n_all, n_distinct = (n_words or 0) + n_ends, (n_distinct or 0) + (n_ends > 0)
    costs = gram_costs(totals.where(F.col("kind") == GRAM).select("key", "n"), order)
    answers = _replies(asked, costs, buckets, many).unionByName(totals.where(F.col("kind") == WORD).select("block", "kind", "keys", "vals"))
    parts = _scored(segments, answers, order, n_all, n_distinct, n_ends, few)
    whole = parts.groupBy("id", "sig", "held", "n_seg").agg(
        (F.count(F.lit(1)) / F.col("n_seg")).cast("int").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base"), F.sum("score").alias("score"),
    )
    each = lambda c: (F.col(c) / F.col("copies"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("score").alias("score"),
    )
