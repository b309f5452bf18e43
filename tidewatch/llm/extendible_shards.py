"""Sharding by extendible hashing, JVM expressions only.

An item's hash is the first 60 bits of the md5 of its id.  The directory is indexed by
hash-prefix bits: a bucket at depth d holds the items that share their first d bits, and
only a bucket over the byte limit is split on the next bit.  So an item's bucket is its
shortest prefix whose items fit the limit together.

Bytes are summed once per fine prefix (a few bits beyond the average depth); sums of all
shorter prefixes come from those.  Prefixes that are still too large go on alone, some bits
deeper each round.  Items that all 60 bits don't part (repeated ids, or one item over the
limit) fill overflow shards in turn, each up to the limit; an item that alone is larger
than the limit has a shard of its own and is the only case of ``oversize``.

Null ids hash like the empty string, null texts have 0 bytes, repeated rows are items of
their own, other columns are passed on by ``write_shards`` and not read otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import stored

BITS = 60


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _depths(leaves: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """(leaf, depth, shard_bytes) for leaves of ``last`` bits with their bytes; no row where even the leaf is too large."""
    up = leaves.select("leaf", "bytes", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"))
    up = up.withColumn("prefix", F.call_function("shiftright", F.col("leaf"), F.lit(last) - F.col("depth")))
    fits = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    return up.join(fits, ["depth", "prefix"]).groupBy("leaf").agg(F.min(F.struct("depth", "shard_bytes")).alias("m")).select("leaf", "m.*")


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", extra_bits: int = 4, key: Column | None = None) -> DataFrame:
    """One row per item: id, bytes, depth, prefix, overflow, shard (depth-prefix-overflow), shard_bytes, oversize."""
    if limit < 1:
        raise ValueError("a shard holds at least one byte")
    items = stored(docs.select(
        F.col(id_col).alias("__id"), hash_bits(F.col(id_col) if key is None else key).alias("__h"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("__b"),
    ), "items")
    total = items.agg(F.sum("__b")).first()[0] or 0
    first, last = 0, min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + extra_bits)
    done, rest = [], items
    while True:
        leafed = rest.withColumn("__leaf", _prefix(F.col("__h"), last))
        leaves = leafed.groupBy("__leaf").agg(F.sum("__b").alias("bytes")).withColumnRenamed("__leaf", "leaf")
        depths = stored(_depths(leaves, first, last, limit), "depths")
        joined = leafed.join(depths, leafed["__leaf"] == depths["leaf"], "left")
        done.append(joined.where(F.col("depth").isNotNull()).select("__id", "__h", "__b", "depth", "shard_bytes", F.lit(0).cast("long").alias("overflow")))
        rest = stored(joined.where(F.col("depth").isNull()).select("__id", "__h", "__b"), "rest")
        if rest.isEmpty():
            break
        if last == BITS:
            done.append(_overflow(rest, limit))
            break
        first, last = last + 1, min(BITS, last + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("prefix", F.call_function("shiftright", F.col("__h"), F.lit(BITS) - F.col("depth")))
    return out.select(
        F.col("__id").alias(id_col), F.col("__b").alias("bytes"), "depth", "prefix", "overflow",
        F.concat_ws("-", "depth", "prefix", "overflow").alias("shard"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"),
    )


def _overflow(rest: DataFrame, limit: int) -> DataFrame:
    """Items of one hash in shards of at most the limit, large ones alone; only running sums are kept."""
    small = F.col("__b") <= limit
    by = Window.partitionBy("__h", "__small").orderBy("__b")
    run = rest.withColumn("__small", small).withColumn("__rank", F.row_number().over(by).cast("long"))
    # sorted by size, a shard of floor(limit / largest of its run) items can't pass the limit
    per = F.greatest(F.floor(F.lit(limit) / F.greatest(F.max("__b").over(Window.partitionBy("__h", "__small")), F.lit(1))), F.lit(1)).cast("long")
    run = run.withColumn("overflow", F.when(F.col("__small"), 2 * F.floor((F.col("__rank") - 1) / per)).otherwise(2 * F.col("__rank") + 1).cast("long"))
    sums = run.groupBy("__h", "overflow").agg(F.sum("__b").alias("shard_bytes"))
    return run.join(sums, ["__h", "overflow"]).select("__id", "__h", "__b", F.lit(BITS).alias("depth"), "shard_bytes", "overflow")


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard: shard, depth, prefix, overflow, n_items, bytes."""
    return assigned.groupBy("shard", "depth", "prefix", "overflow").agg(F.count(F.lit(1)).alias("n_items"), F.sum("bytes").alias("bytes"))


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents, one folder ``shard=...`` each, and return the directory.

    Documents that share an id share a shard only as far as the limit allows; as their
    rows can't be told apart by the id, they are dealt to that id's shards in turn.
    """
    placed = stored(assign(docs, limit, id_col, text_col), "placed")
    one = placed.groupBy(F.col(id_col).alias("__id"), F.col("bytes").alias("__b")).agg(F.min("shard").alias("shard"), F.count_distinct("shard").alias("__n"))
    many = placed.join(one.where("__n > 1"), placed[id_col].eqNullSafe(F.col("__id")) & (placed["bytes"] == F.col("__b"))).select("__id", "__b", placed["shard"])
    by = Window.partitionBy("__id", "__b").orderBy("shard")
    many = many.withColumn("__k", F.row_number().over(by))
    by_doc = Window.partitionBy(id_col, "__bytes").orderBy(F.lit(0))
    sized = docs.withColumn("__bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    single = sized.join(one.where("__n = 1").select("__id", "__b", "shard"), sized[id_col].eqNullSafe(F.col("__id")) & (sized["__bytes"] == F.col("__b")))
    repeated = sized.join(one.where("__n > 1").select("__id", "__b"), sized[id_col].eqNullSafe(F.col("__id")) & (sized["__bytes"] == F.col("__b"))).drop("__id", "__b")
    repeated = repeated.withColumn("__j", F.row_number().over(by_doc))
    dealt = repeated.join(many, repeated[id_col].eqNullSafe(many["__id"]) & (repeated["__bytes"] == many["__b"]) & (repeated["__j"] == many["__k"]))
    columns = [*docs.columns, "shard"]
    whole = single.select(*columns).unionByName(dealt.select(*columns))
    whole.repartition("shard").write.partitionBy("shard").parquet(path)
    return directory(placed)
