"""Exact ranks, quantiles and ranked metrics without one task that sees all values.

Values are first collapsed to one row each and range-partitioned once: the borders come from
a sample of the values themselves, so ranges hold about equal numbers of rows whatever the
scale of the values.  A value's position is the total of all ranges before its own
plus the prefix within the range.  The borders decide about balance only; results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import stored

FAN = 4096
#: Ranks of the sketches in ``wide_quantiles`` are off by at most a share of 1 / ACCURACY.
ACCURACY = 2000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of key columns in which null equals null."""
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """The rows, stored, with ``_range``: numbers that rise with (keys, order), about equal shares of rows each."""
    by = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def prefix_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: Sequence[str], descending: bool = False,
                  parts: int | None = None) -> DataFrame:
    """Add ``before_<c>``: the total of ``c`` over rows of the same keys that come strictly earlier.

    ``order`` must be unique per key.  The rows are written once, because the range totals and the rows
    themselves both read them.
    """
    keys = list(keys)
    order = [o.desc() for o in order] if descending else list(order)
    rows = ranged(df, keys, order, parts)

    def ahead(group, by, prefix):
        w = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{prefix}{c}") for c in totals]

    at = [*keys, "_range"]
    cells = rows.groupBy(*at).agg(*[F.sum(c).alias(c) for c in totals])
    offsets = cells.select(*at, *ahead(keys, ["_range"], "_off_"))  # a row per range
    within = rows.select("*", *ahead(at, order, "_in_"))
    return within.join(offsets, same_keys(within, offsets, at)).select(
        *[within[c] for c in df.columns],
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"before_{c}") for c in totals],
    )


def class_counts(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
                 weight: Column | None = None) -> DataFrame:
    """One row per distinct score with the (weighted) number of positives and negatives."""
    one = F.lit(1).cast("long") if weight is None else weight.cast("long")
    y = F.col(label).cast("long")
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.sum(one * y).alias("pos"), F.sum(one * (1 - y)).alias("neg"))
    )


def roc_points(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives at each distinct score, highest first."""
    ranked = prefix_totals(counts, keys, [F.col("score")], ["pos", "neg"], descending=True)
    return ranked.select(
        *keys, "score", "pos", "neg",
        (F.col("before_pos") + F.col("pos")).alias("tp"),
        (F.col("before_neg") + F.col("neg")).alias("fp"),
    )


def ranked_metrics(counts: DataFrame, keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Exact AUROC (ties by trapezoid) and average precision; null with one class only.

    ``extra`` adds aggregates over the same rows (score, pos, neg, tp, fp).
    """
    pts = roc_points(counts, keys)
    p, n = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    precision = F.sum(F.when(F.col("tp") + F.col("fp") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))))
    both = (p > 0) & (n > 0)
    aggs = [
        F.when(both, area / p / n).alias("auroc"),
        F.when(both, precision / p).alias("auprc"),
        p.alias("positives"),
        n.alias("negatives"),
        *extra,
    ]
    return pts.groupBy(*keys).agg(*aggs)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles: ``*keys, q, value`` (nulls ignored).

    ``keys`` must have few distinct values (features, groups): their sizes are joined back.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = stored(counts, "values")
    ranked = prefix_totals(counts, keys, [F.col("v")], ["n"])
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"))
    # both sides carry the block of ranks they touch, FAN blocks per key
    span = F.greatest(F.ceil(F.col("size") / FAN), F.lit(1))
    at = F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("size") - 1)).alias("at")) for q in probs
    ]))
    wanted = sizes.select(*keys, span.alias("span"), at.alias("t")).select(
        *keys, "span", "t.q", "t.at", F.explode(F.array_distinct(F.array(F.floor("t.at"), F.ceil("t.at")))).alias("rank")
    ).withColumn("block", F.floor(F.col("rank") / F.col("span")))
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1
    ranked = ranked.join(sizes, keys) if keys else ranked.withColumn("size", sizes.scalar())
    ranges = ranked.select(
        *keys, "v", first.alias("first"), last.alias("last"),
        F.explode(F.sequence(F.floor(first / span), F.floor(last / span))).alias("block"),
    )
    hits = ranges.join(wanted, [*keys, "block"]).filter(F.col("rank").between(F.col("first"), F.col("last")))
    picked = hits.groupBy(*keys, "q", "at").agg(
        F.max(F.when(F.col("rank") == F.floor("at"), F.col("v"))).alias("lo"),
        F.max(F.when(F.col("rank") == F.ceil("at"), F.col("v"))).alias("hi"),
    )
    return picked.select(*keys, "q", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value"))


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """0-based position of each (unique) row in ``order`` within ``keys``."""
    numbered = prefix_totals(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"])
    return numbered.select(*df.columns, F.col("before__one").alias(name))


def wide_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of many columns, in two passes over the rows: ``feature, q, value``.

    The first pass keeps a mergeable sketch per column, which brackets every wanted rank.  The second counts
    the values below each bracket and extracts those inside, a small share of the rows, each distinct value once per task.  Only
    these are ranked.  Columns without a value are absent.
    """
    columns, probs = list(columns), [float(q) for q in probs]
    margin = 2.0 / ACCURACY
    ends = F.array(*[F.lit(min(max(q + side * margin, 0.0), 1.0)) for q in probs for side in (-1, 1)])
    values = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(columns)]
    wide = df.select(*values)
    names = [v for v in wide.columns]
    row = wide.agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, ends, F.lit(ACCURACY)).alias("ends")).alias(v) for v in names
    ]).first()  # a few numbers per column
    brackets = []
    for i, v in enumerate(names):
        if row[v]["n"]:
            few = row[v]["n"] <= 4 * ACCURACY  # the margin would be under one rank
            for k, q in enumerate(probs):
                low = row[v]["low"] if few or q <= margin else row[v]["ends"][2 * k]
                high = row[v]["high"] if few or q >= 1 - margin else row[v]["ends"][2 * k + 1]
                brackets.append((i, k, low, high, q * (row[v]["n"] - 1)))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(brackets), dtype=np.int64)
        for batch in batches:
            parts = []
            for b, (i, _, low, high, _) in enumerate(brackets):
                x = batch.column(i)
                x = x.drop_null().to_numpy(zero_copy_only=False)
                below[b] += int((x < low).sum())
                v, n = np.unique(x[(x >= low) & (x <= high)], return_counts=True)
                parts.append((np.full(len(v), b, np.int32), v, n))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["bracket", "v", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(brackets), dtype=np.int32)), pa.array([None] * len(brackets), pa.float64()), pa.array(below)], names=["bracket", "v", "n"])

    found = stored(wide.mapInArrow(inside, "bracket int, v double, n long").groupBy("bracket", "v").agg(F.sum("n").alias("n")), "brackets")
    ranked = prefix_totals(found.filter(F.col("v").isNotNull()), ["bracket"], [F.col("v")], ["n"])
    below = found.filter(F.col("v").isNull()).select("bracket", F.col("n").alias("below"))
    wanted = df.sparkSession.createDataFrame([(b, columns[i], probs[k], at) for b, (i, k, _, _, at) in enumerate(brackets)], "bracket int, feature string, q double, at double")
    near = ranked.join(below, "bracket").join(wanted, "bracket").withColumn("first", F.col("below") + F.col("before_n")).withColumn("last", F.col("first") + F.col("n") - 1)
    holds = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("v")))
    picked = near.groupBy("feature", "q", "at").agg(holds(F.floor("at")).alias("lo"), holds(F.ceil("at")).alias("hi"))
    return picked.select("feature", "q", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value"))
