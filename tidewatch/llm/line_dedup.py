"""Line dedup: drop lines that many documents share, JVM expressions only.

Lines are exploded with their position; only two 64-bit hashes of the line's key travel,
not the line.  ``count(distinct id)`` counts partially by (key, document) before the
shuffle, so a line that a third of all documents hold is no hot group.  Dropped positions
return to their document, and the text is put together from the others by position.

A null or empty text is one empty line.  A line's key is the line without ASCII white
space at both ends and with A-Z lower-cased; keys shorter than ``min_chars`` code points
are never dropped.  Rows that share an id are one document in the count; each row gives its
own result.  A null id counts as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import SPACES, ascii_lower
from tidewatch.session import stored


def _marked(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """All columns of docs, with __text (null as empty) and __drop (positions of dropped lines, or null)."""
    texts = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__sig", F.xxhash64("__text"))
    keys = F.transform(F.split("__text", "\n"), lambda s: ascii_lower(F.btrim(s, F.lit(SPACES))))
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(k, k).alias("h2"))))
    lines = texts.select(F.col(id_col).alias("__id"), "__sig", F.posexplode(hashes).alias("__pos", "__h")).where("__h is not null")
    lines = lines.select("__id", "__sig", "__pos", F.col("__h.h1").alias("__h1"), F.col("__h.h2").alias("__h2"))
    often = lines.groupBy("__h1", "__h2").agg(F.count_distinct(F.struct("__id")).alias("__n")).where(F.col("__n") >= min_docs).drop("__n")
    often = stored(often, "lines")  # read from files, the join below is one that a frequent line can be split in
    hits = lines.join(often, ["__h1", "__h2"]).groupBy("__id", "__sig").agg(F.collect_set("__pos").alias("__drop"))
    hits = hits.withColumnsRenamed({"__id": "__id2", "__sig": "__sig2"})
    same = texts[id_col].eqNullSafe(hits["__id2"]) & (texts["__sig"] == hits["__sig2"])
    return texts.join(hits, same, "left").drop("__id2", "__sig2", "__sig")


def _kept():
    lines = F.split("__text", "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.array_size(lines) - 1), F.col("__drop"))
    joined = F.array_join(F.transform(rest, lambda p: F.element_at(lines, p + 1)), "\n")
    return F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(joined)


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the text that is left; all other columns as they are (null texts become empty)."""
    marked = _marked(docs, id_col, text_col, min_docs, min_chars)
    return marked.select(*[_kept().alias(c) if c == text_col else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: id, n_lines, n_dropped, kept_sha256."""
    marked = _marked(docs, id_col, text_col, min_docs, min_chars)
    return marked.select(
        id_col, F.array_size(F.split("__text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("__drop"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(_kept(), 256).alias("kept_sha256"),
    )
