"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of at most ``chunk_chars`` characters is one chunk and is encoded where it is
read.  A longer text is cut into chunks that overlap by ``overlap_chars``; the chunks are
spread over the cluster and pre-tokenised in parallel.  Where a chunk's pre-token
boundaries meet those of the chunk before it, both scans go on alike (the pattern looks
ahead, never back), so the first common boundary is the seam.  A chunk without a common
boundary (one run of letters longer than the overlap) is joined to the piece before it.
Pieces are encoded in parallel; ids and raw bytes are then read in order, piece by piece.

Null and empty texts have no tokens.  Rows that repeat an id, or a whole row, give one
result each.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: The last characters of a chunk may belong to a longer match: boundaries there do not count.
MARGIN = 4
DIGEST = "{id} {type}, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str):
    """The rank file as a tokenizer; read once in each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, vocabulary: str, pattern: str) -> np.ndarray:
    return encoder(vocabulary, pattern).encode_to_numpy(text, disallowed_special=()).astype("<u4")


def decode_ids(ids: np.ndarray, vocabulary: str, pattern: str) -> bytes:
    """Raw bytes of the tokens, one after another; not necessarily whole characters."""
    return encoder(vocabulary, pattern).decode_bytes(ids.tolist())


def boundaries(text: str, pattern: str, start: int, stop: int) -> list[int]:
    """Pre-token starts p with start <= p < stop, by a scan from the beginning of the text."""
    import regex

    out = [0] if start <= 0 < stop else []
    for m in regex.finditer(pattern, text):
        if m.end() >= stop:
            break
        if m.end() >= start:
            out.append(m.end())
    return out


def _batch(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(values, schema=schema)


def _arrow(id_type: pa.DataType, **fields) -> pa.Schema:
    return pa.schema([("id", id_type)] + list(fields.items()))


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = 65_536, overlap_chars: int = 2_048, ids: bool = False,
) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256; with ``ids``, per piece
    (id, sig, gid, text, ids as little-endian 32-bit binary), to be read in the order of gid."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= chunk_chars)
    long = texts.where(F.length("text") > chunk_chars)

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"id": batch.column("id").to_pylist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column("text"):
                got = encode_text(text.as_py(), vocabulary, pattern)
                out["n_tokens"].append(len(got))
                out["ids_sha256"].append(hashlib.sha256(got.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decode_ids(got, vocabulary, pattern)).hexdigest())
            yield _batch(out, _arrow(batch.column("id").type, n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string()))

    pieces = _pieces(_seams(_chunks(long, kind, chunk_chars, overlap_chars), kind, pattern, chunk_chars, overlap_chars), kind, vocabulary, pattern)
    if ids:
        def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [encode_text(text.as_py(), vocabulary, pattern).tobytes() for text in batch.column("text")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "ids"])

        whole = short.select("id", F.xxhash64("text").alias("sig"), F.lit(0).cast("long").alias("gid"), "text")
        whole = whole.mapInArrow(encode_whole, f"id {kind}, sig long, gid long, text string, ids binary")
        return whole.unionByName(pieces.select("id", "sig", "gid", "text", "ids"))
    done = short.mapInArrow(encode_rows, DIGEST.format(id="id", type=kind)).unionByName(_digests(pieces, kind, vocabulary, pattern))
    return done.withColumnRenamed("id", id_col)


def _chunks(long: DataFrame, kind: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Rows (id, sig, copies, k, chunk), spread by chunk; equal rows travel once."""
    distinct = long.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("sig", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _arrow(batch.column("id").type, sig=pa.int64(), copies=pa.int64(), k=pa.int64(), chunk=pa.string())
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                for k, at in enumerate(range(0, len(text), chunk_chars)):
                    yield _batch({
                        "id": [batch.column("id")[i].as_py()], "sig": [batch.column("sig")[i].as_py()],
                        "copies": [batch.column("copies")[i].as_py()], "k": [k], "chunk": [text[at : at + chunk_chars + overlap_chars]],
                    }, schema)

    return distinct.select("id", "sig", "copies", "text").mapInArrow(cut, f"id {kind}, sig long, copies long, k long, chunk string").repartition("id", "sig", "k")


def _seams(chunks: DataFrame, kind: str, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Rows (id, sig, copies, gid, k, piece): the chunks, cut at the seams; pieces that no seam parts share a gid."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for chunk in batch.column("chunk"):
                chunk = chunk.as_py()
                heads.append(boundaries(chunk, pattern, 0, min(overlap_chars, len(chunk) - MARGIN)))
                tails.append([p - chunk_chars for p in boundaries(chunk, pattern, chunk_chars, len(chunk) - MARGIN)])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, ints), pa.array(tails, ints)],
                schema=pa.schema([*batch.schema, ("head", ints), ("tail", ints)]),
            )

    scanned = chunks.mapInArrow(scan, f"id {kind}, sig long, copies long, k long, chunk string, head array<long>, tail array<long>")
    by = Window.partitionBy("id", "sig").orderBy("k")
    seam = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.col("head"), F.lag("tail").over(by))))
    cut = scanned.withColumn("cut", seam).drop("head", "tail")
    cut = cut.withColumn("next_cut", F.lead("cut").over(by)).withColumn("gid", F.sum(F.when(F.col("cut").isNotNull(), 1).otherwise(0)).over(by).cast("long"))
    start, end = F.coalesce("cut", F.lit(0)), chunk_chars + F.coalesce("next_cut", F.lit(0))
    return cut.select("id", "sig", "copies", "gid", "k", F.substring("chunk", start + 1, end - start).alias("piece"))


def _pieces(seams: DataFrame, kind: str, vocabulary: str, pattern: str) -> DataFrame:
    """Rows (id, sig, copies, gid, text, ids), encoded in parallel."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, schema = None, [], None

        def done() -> pa.RecordBatch:
            text = "".join(parts)
            return _batch({"id": [key[0]], "sig": [key[1]], "copies": [key[2]], "gid": [key[3]], "text": [text],
                           "ids": [encode_text(text, vocabulary, pattern).tobytes()]}, schema)

        for batch in batches:
            schema = _arrow(batch.column("id").type, sig=pa.int64(), copies=pa.int64(), gid=pa.int64(), text=pa.string(), ids=pa.binary())
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "sig", "copies", "gid", "piece"))):
                if key is not None and row[:4] != key:
                    yield done()
                    parts = []
                key = row[:4]
                parts.append(row[4])
        if key is not None:
            yield done()

    ordered = seams.repartition("id", "sig", "gid").sortWithinPartitions("id", "sig", "gid", "k")
    return ordered.mapInArrow(encode, f"id {kind}, sig long, copies long, gid long, text string, ids binary")


def _digests(pieces: DataFrame, kind: str, vocabulary: str, pattern: str) -> DataFrame:
    """Hash ids and decoded bytes in order, holding one piece at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = schema = None
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()

        def done() -> pa.RecordBatch:
            m = key[2]
            return _batch({"id": [key[0]] * m, "n_tokens": [n] * m, "ids_sha256": [of_ids.hexdigest()] * m, "decoded_sha256": [of_bytes.hexdigest()] * m}, schema)

        for batch in batches:
            schema = _arrow(batch.column("id").type, n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())
            for *row, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "sig", "copies", "ids"))):
                if key is not None and row != key:
                    yield done()
                    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                key = row
                got = np.frombuffer(raw, "<u4")
                n += len(got)
                of_ids.update(raw)
                of_bytes.update(decode_ids(got, vocabulary, pattern))
        if key is not None:
            yield done()

    ordered = pieces.select("id", "sig", "copies", "gid", "ids").repartition("id", "sig").sortWithinPartitions("id", "sig", "gid")
    return ordered.mapInArrow(digest, DIGEST.format(id="id", type=kind))
