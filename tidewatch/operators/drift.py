"""Transfer drift, importance and family shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.naming import feature_family
from tidewatch.spec import ICU, PanelSpec


def feature_drift(features: DataFrame, columns: Sequence[str], group: str = "hospital",
                  base: str = "A", other: str = "B") -> DataFrame:
    """Mean, spread and missing rate of each feature in two groups, and their SMD.

    One aggregate per group with all columns side by side; only the resulting two
    rows are turned into a long table.
    """
    stats = {"mean": lambda c: F.avg(c), "sd": lambda c: F.stddev_pop(c),
             "missing": lambda c: F.avg(F.col(c).isNull().cast("double"))}
    wide = features.filter(F.col(group).isin(base, other)).groupBy(group).agg(*[
        F.struct(*[f(c).alias(n) for n, f in stats.items()]).alias(c) for c in columns
    ])
    long = wide.unpivot([group], list(columns), "feature", "s")
    pick = {g: F.max(F.when(F.col(group) == g, F.col("s"))) for g in (base, other)}
    both = long.groupBy("feature").agg(pick[base].alias("a"), pick[other].alias("b"))
    spread = F.sqrt((F.pow("a.sd", F.lit(2)) + F.pow("b.sd", F.lit(2))) / 2)
    return both.select(
        "feature",
        F.col("a.mean").alias("mean_a"), F.col("b.mean").alias("mean_b"),
        ((F.col("b.mean") - F.col("a.mean")) / F.nullif(spread, F.lit(0.0))).alias("smd_b_vs_a"),
        F.col("a.missing").alias("missing_a"), F.col("b.missing").alias("missing_b"),
    )


def contribution_table(rows: DataFrame, weights: Mapping[str, float], centre: Mapping[str, float],
                       scale: Mapping[str, float]) -> dict:
    """coef * standardised value per feature; a missing value contributes nothing."""
    return {
        f: F.coalesce(F.lit(float(w)) * (F.col(f) - float(centre[f])) / float(scale[f]), F.lit(0.0))
        for f, w in weights.items()
    }


def importance(rows: DataFrame, contributions: Mapping, n: int | None = None) -> DataFrame:
    """Mean |contribution| per feature and its share, largest first."""
    wide = rows.agg(*[F.avg(F.abs(c)).alias(f) for f, c in contributions.items()])
    long = wide.unpivot([], list(contributions), "feature", "importance")
    total = long.agg(F.sum("importance")).scalar()
    out = long.select("feature", "importance", (F.col("importance") / total).alias("share"))
    out = out.orderBy(F.desc("importance"), "feature")
    return out if n is None else out.limit(n)


def family_share(shares: DataFrame, spec: PanelSpec = ICU) -> DataFrame:
    return shares.groupBy(feature_family(F.col("feature"), spec).alias("family")).agg(F.sum("share").alias("share"))


def top_contributions(contributions: Mapping, values: Mapping, k: int = 8):
    """The ``k`` largest contributions of a row by absolute value, as an array of structs."""
    items = F.array(*[
        F.struct(
            F.lit(name).alias("feature"), c.alias("contribution"),
            values[name].cast("double").alias("value"), values[name].isNull().alias("missing"),
        )
        for name, c in contributions.items()
    ])

    def larger_first(x, y):
        a, b = F.abs(x["contribution"]), F.abs(y["contribution"])
        return F.when(a > b, -1).when(a < b, 1).when(x["feature"] < y["feature"], -1).otherwise(1)

    return F.slice(F.array_sort(items, larger_first), 1, k)
