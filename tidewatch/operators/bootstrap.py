"""Record-level bootstrap with hash-drawn integer weights.

A replicate draws as many stays as there are, with replacement; each row then
counts as often as its stay was drawn.  Draw i of replicate r picks the stay at
position ``hash(seed, r, i) mod n``, so a lost task redraws the same weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.operators.ranking import ordered_index, ranged, same_keys
from tidewatch.operators.utility import normalised
from tidewatch.session import stored
from tidewatch.spec import KEY

CHUNK = 8192
#: Cells of a range, which one task holds in memory with their weights (two bytes a replicate each).
RANGE_CELLS = 65_536


def stay_weights(stays: DataFrame, n_boot: int, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """``*keys, stay_id, w``: how often each replicate draws the stay, ``n_boot`` 16-bit numbers in one value.

    Inside each key as many stays are drawn as it has.
    """
    keys = list(keys)
    name = F.col(KEY).cast("string")
    members = stored(stays.select(*keys, KEY).distinct(), "members")
    numbered = ordered_index(members, keys, [F.md5(name), F.col(KEY)], "position")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("position").cast("string")))
    if keys:
        sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
        sized = numbered.join(sizes.withColumnsRenamed({k: f"_{k}" for k in keys}), same_renamed(keys)).drop(*[f"_{k}" for k in keys])
    else:
        sized = numbered.withColumn("size", members.agg(F.count(F.lit(1))).scalar())
    drawn = sized.select(*keys, "size", "position", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate")).select(
        *keys, "replicate", (F.conv(F.substring(draw, 1, 15), 16, 10).cast("long") % F.col("size")).alias("position"))
    picked = drawn.groupBy(*keys, "position").agg(F.collect_list("replicate").alias("drawn"))
    both = numbered.join(picked.withColumnsRenamed({k: f"_{k}" for k in [*keys, "position"]}), same_renamed([*keys, "position"]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [np.bincount(d, minlength=n_boot).astype("<u2").tobytes() for d in batch.column("drawn").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, KEY)), pa.array(w, pa.binary())], names=[*keys, KEY, "w"])

    types = dict(stays.dtypes)
    return both.select(*keys, KEY, "drawn").mapInArrow(counted, ", ".join([f"`{c}` {types[c]}" for c in (*keys, KEY)] + ["w binary"]))


def same_renamed(keys: Sequence[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def weights_of(column: pa.ChunkedArray | pa.Array, n_boot: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, n_boot)


def _interval(replicates: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """2.5% and 97.5% percentiles over the replicates (``n_boot`` rows per key)."""
    ends = F.array(F.lit(0.025), F.lit(0.975))
    wide = replicates.groupBy(*keys).agg(*[F.percentile(F.col(c), ends).alias(c) for c in columns])
    return wide.select(
        *keys, *[F.col(c)[i].alias(f"{c}_{end}") for c in columns for i, end in enumerate(("lo", "hi"))]
    )


def stay_cells(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positives ``p`` and negatives ``n`` per (``*keys``, stay, score) of the scored rows, stored.

    Ties inside a stay collapse here, before anything meets the replicates.
    """
    y = F.col("label").cast("long")
    rows = scored.filter(F.col("score").isNotNull())
    return stored(rows.groupBy(*keys, KEY, "score").agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n")), "cells")


def tied_sums(drawn: DataFrame, n_boot: int, keys: Sequence[str], heavy: int = CHUNK) -> DataFrame:
    """Adds ``sums``: rows of a score that has more than ``heavy`` cells become one row with the weighted positives and
    negatives of every replicate; on other rows it is null.

    Each task adds up its rows of such scores first, so a score that most rows share is no group of its own.
    """
    keys = list(keys)
    types = dict(drawn.dtypes)
    common = drawn.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") > heavy)
    common = common.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "score"]], F.lit(True).alias("common"))
    marked = stored(drawn.join(common, same_renamed([*keys, "score"]), "left").select(*drawn.columns, F.coalesce("common", F.lit(False)).alias("common")), "marked")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = [batch.column(c).type for c in (*keys, "score")]
            names = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "score"))))
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                w = weights_of(part.column("w"), n_boot).astype(np.float64)
                p, n = (part.column(c).to_numpy() for c in ("p", "n"))
                place: dict[tuple, list[int]] = {}
                for j, name in enumerate(names[i : i + CHUNK]):
                    place.setdefault(name, []).append(j)
                for name, at in place.items():
                    both = np.stack([p[at] @ w[at], n[at] @ w[at]])
                    totals[name] = totals[name] + both if name in totals else both
        if totals:
            columns = [pa.array([k[i] for k in totals], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=[*keys, "score", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())  # whole numbers: the order does not matter
        return table.slice(0, 1).set_column(table.schema.get_field_index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

    schema = ", ".join([f"`{c}` {types[c]}" for c in (*keys, "score")] + ["sums binary"])
    sums = marked.filter("common").select(*keys, "score", "p", "n", "w").mapInArrow(add, schema).groupBy(*keys, "score").applyInArrow(merge, schema)
    return marked.filter("not common").drop("common").unionByName(sums, allowMissingColumns=True)


def ranked_replicates(cells: DataFrame, n_boot: int, seed: int = 0, keys: Sequence[str] = (), heavy: int = CHUNK) -> DataFrame:
    """AUROC and AUPRC of every replicate of ``stay_cells``: ``*keys, replicate, auroc, auprc``.

    The cells are range-partitioned by score once, each with its stay's weights; a range
    gives, per replicate, its positives, negatives and the area within, and once the
    positives and negatives above it are known, its part of the average precision.  With
    ``keys``, each key's stays are resampled by themselves.
    """
    keys = list(keys)
    types = dict(cells.dtypes)
    w = stay_weights(cells, n_boot, seed, keys).withColumnsRenamed({k: f"_{k}" for k in (*keys, KEY)})
    drawn = cells.join(w, same_renamed([*keys, KEY])).select(*keys, F.col("score").cast("double").alias("score"), "p", "n", "w")
    # weights shrink so well that Spark, left to itself, would merge ranges by their bytes until they fill a task's memory
    parts = math.ceil(cells.count() / RANGE_CELLS) + 1
    rows = ranged(tied_sums(drawn, n_boot, keys, heavy), keys, [F.col("score").desc()], parts)
    at = [*keys, "_range"]
    key_schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["_range int"])

    def walk(table: pa.Table, tp: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positives and negatives at the end, area and precision sums, from those above the range."""
        score = table.column("score").to_numpy()
        by = np.argsort(-score, kind="stable")
        area, precision = np.zeros(n_boot), np.zeros(n_boot)
        ends = np.flatnonzero(np.append(np.diff(score[by]) != 0, True)) + 1  # ties stay together
        start, pos, neg = 0, np.zeros(n_boot), np.zeros(n_boot)
        p, n = (table.column(c).fill_null(0).to_numpy()[by] for c in ("p", "n"))
        raw, sums = (table.column(c).combine_chunks().take(pa.array(by)) for c in ("w", "sums"))
        nothing = bytes(2 * n_boot)
        for end_at in range(0, len(ends), CHUNK):
            cut = ends[end_at : end_at + CHUNK]
            for a in range(start, cut[-1], CHUNK):
                b = min(a + CHUNK, cut[-1])
                w_ = weights_of(raw.slice(a, b - a).fill_null(nothing), n_boot).astype(np.float64)
                wp, wn = w_ * p[a:b, None], w_ * n[a:b, None]
                for k, both in enumerate(sums.slice(a, b - a).to_pylist()):
                    if both is not None:
                        wp[k], wn[k] = np.frombuffer(both).reshape(2, n_boot)
                inside = cut[(cut > a) & (cut <= b)] - a
                edges = np.concatenate([[0], inside])
                for i, j in zip(edges, edges[1:]) if len(inside) < b - a else ():
                    g_pos, g_neg = pos + wp[i:j].sum(0), neg + wn[i:j].sum(0)
                    tp, fp = tp + g_pos, fp + g_neg
                    area += g_neg * (tp - g_pos / 2)
                    precision += np.divide(g_pos * tp, tp + fp, out=np.zeros(n_boot), where=tp + fp > 0)
                    pos, neg = np.zeros(n_boot), np.zeros(n_boot)
                if len(inside) == b - a:  # no ties: all rows of the chunk at once
                    wp[0] += pos
                    wn[0] += neg
                    tps, fps = tp + np.cumsum(wp, 0), fp + np.cumsum(wn, 0)
                    area += (wn * (tps - wp / 2)).sum(0)
                    precision += np.divide(wp * tps, tps + fps, out=np.zeros_like(wp), where=tps + fps > 0).sum(0)
                    tp, fp, pos, neg = tps[-1], fps[-1], np.zeros(n_boot), np.zeros(n_boot)
                elif edges[-1] < b - a:
                    pos, neg = pos + wp[edges[-1]:].sum(0), neg + wn[edges[-1]:].sum(0)
            start = cut[-1]
        return tp, fp, area, precision

    def head(key: tuple) -> dict:
        return {k: pa.array([v.as_py()] * n_boot, v.type) for k, v in zip(at, key)} | {"replicate": pa.array(np.arange(n_boot, dtype=np.int32))}

    def first(key: tuple, table: pa.Table) -> pa.Table:
        tp, fp, area, _ = walk(table, np.zeros(n_boot), np.zeros(n_boot))
        return pa.table(head(key) | {"pos": tp, "neg": fp, "area": area})

    def second(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        by = np.argsort(above.column("replicate").to_numpy())
        tp, fp = (above.column(c).to_numpy()[by].astype(np.float64) for c in ("pos_above", "neg_above"))
        return pa.table(head(key) | {"precision": walk(table, tp, fp)[3]})

    parts = rows.groupBy(*at).applyInArrow(first, key_schema + ", replicate int, pos double, neg double, area double")
    before = Window.partitionBy(*keys, "replicate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_above") for c in ("pos", "neg")]), "parts")
    precisions = rows.groupBy(*at).cogroup(parts.groupBy(*at)).applyInArrow(second, key_schema + ", replicate int, precision double")
    both = parts.select(*keys, "replicate", "pos", "neg", (F.col("area") + F.col("neg") * F.col("pos_above")).alias("area"), F.lit(0.0).alias("precision"))
    both = both.unionByName(precisions.select(*keys, "replicate", F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0.0).alias("area"), "precision"))
    p, n = F.sum("pos"), F.sum("neg")
    usable = (p > 0) & (n > 0)
    return both.groupBy(*keys, "replicate").agg(
        F.when(usable, F.sum("area") / p / n).alias("auroc"), F.when(usable, F.sum("precision") / p).alias("auprc"))


def ranked_interval(cells: DataFrame, n_boot: int = 200, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    return _interval(ranked_replicates(cells, n_boot, seed, keys), ("auroc", "auprc"), keys)


def utility_replicates(per_stay: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """Normalised utility of every replicate from per-stay sums."""
    names = ("observed", "best", "inaction")
    w = stay_weights(per_stay, n_boot, seed).withColumnRenamed(KEY, f"_{KEY}")
    drawn = per_stay.join(w, same_renamed([KEY])).select(*[F.col(c).cast("double").alias(c) for c in names], "w")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), n_boot))
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                total += np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in names]) @ weights_of(part.column("w"), n_boot).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot, dtype=np.int32)), *map(pa.array, total)], names=["replicate", *names])

    sums = drawn.mapInArrow(partial, "replicate int, observed double, best double, inaction double").groupBy("replicate").agg(
        *[F.sum(c).alias(c) for c in names]
    )
    return sums.select(
        "replicate", normalised(F.col("observed"), F.col("best"), F.col("inaction")).alias("utility")
    )


def utility_interval(per_stay: DataFrame, n_boot: int = 200, seed: int = 0) -> DataFrame:
    return _interval(utility_replicates(per_stay, n_boot, seed), ("utility",))
