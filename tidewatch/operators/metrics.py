"""Hourly metrics, calibration table, confusion counts, subgroups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.clinical import age_band
from tidewatch.operators.bootstrap import ranked_interval, stay_cells
from tidewatch.operators.ranking import class_counts, ranked_metrics
from tidewatch.spec import KEY


def predictions(scored: DataFrame, threshold: float, fallback: float = 0.0) -> DataFrame:
    """Every hour gets a probability and an alarm; unavailable hours get the fallback and no alarm."""
    alarm = (F.col("status") == "scored") & (F.col("score") >= threshold)
    return scored.withColumn("probability", F.coalesce("score", F.lit(float(fallback)))).withColumn(
        "prediction", F.coalesce(alarm, F.lit(False)).cast("int")
    )


def brier(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("score").isNotNull()).agg(
        F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier")
    )


def bin_edges(bins: int = 10) -> list[float]:
    """Equal-width edges of [0, 1] as multiples of the step (so 3 steps are 0.30000000000000004)."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction against observed rate per bin; empty bins are absent, p = 1 is in the last."""
    edges = bin_edges(bins)
    index = sum(((F.col("score") >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    table = F.array(*[F.lit(e) for e in edges])
    grouped = scored.filter(F.col("score").isNotNull()).groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_predicted"),
        F.avg(F.col("label").cast("double")).alias("observed_rate"),
    )
    return grouped.select(
        F.element_at(table, F.col("bin") + 1).alias("bin_lower"),
        F.element_at(table, F.col("bin") + 2).alias("bin_upper"),
        "n", "mean_predicted", "observed_rate",
    )


def hourly_metrics(scored: DataFrame, n_boot: int = 0, seed: int = 0, probabilistic: bool = True) -> DataFrame:
    """One row: rows scored, prevalence, AUROC, AUPRC, Brier, and intervals when ``n_boot`` > 0."""
    s = F.col("score")
    # distinct scores with class counts are enough for the Brier score
    loss = F.sum(F.col("pos") * F.pow(s - 1, F.lit(2)) + F.col("neg") * F.pow(s, F.lit(2)))
    brier_ = [(loss / F.sum(F.col("pos") + F.col("neg"))).alias("brier")] if probabilistic else []
    out = ranked_metrics(class_counts(scored), extra=brier_)
    n = F.col("positives") + F.col("negatives")
    out = out.select(
        n.alias("rows_scored"), (F.col("positives") / n).alias("positive_hour_prevalence"), "auroc", "auprc",
        *(["brier"] if probabilistic else []),
    )
    if n_boot:
        ends = ("auroc_lo", "auroc_hi", "auprc_lo", "auprc_hi")
        row = ranked_interval(stay_cells(scored), n_boot, seed).select(F.struct(*ends)).scalar()
        out = out.withColumn("_ci", row).select(*out.columns, *[F.col(f"_ci.{e}").alias(e) for e in ends])
    return out


def confusion(predicted: DataFrame) -> DataFrame:
    """Counts, accuracy and F-measure of the thresholded alarms."""
    y, a = F.col("label") == 1, F.col("prediction") == 1
    c = predicted.agg(
        F.count_if(y & a).alias("tp"), F.count_if(~y & a).alias("fp"),
        F.count_if(y & ~a).alias("fn"), F.count_if(~y & ~a).alias("tn"),
    )
    hits = F.col("tp") + F.col("tn")
    return c.select(
        "tp", "fp", "fn", "tn",
        (hits / (hits + F.col("fp") + F.col("fn"))).alias("accuracy"),
        (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f_measure"),
    )


def subgroup_metrics(scored: DataFrame, demographics: DataFrame, n_boot: int = 0, min_events: int = 30,
                     seed: int = 0) -> DataFrame:
    """Ranked metrics per age band and per Gender code.

    ``demographics``: stay_id, Age, Gender (first known values).  A row belongs to one
    group of each kind; groups with fewer than ``min_events`` positive stays are unstable.
    """
    band = F.concat(F.lit("age "), age_band(F.col("Age")))
    code = F.concat(F.lit("Gender="), F.col("Gender").cast("int").cast("string"), F.lit(" (source code)"))
    rows = (
        scored.filter(F.col("score").isNotNull()).select(KEY, "label", "score")
        .join(demographics.select(KEY, "Age", "Gender"), KEY, "left")
        .select(KEY, "label", "score", F.explode(F.array_compact(F.array(band, code))).alias("subgroup"))
    )
    cells = stay_cells(rows, ["subgroup"])
    per_stay = cells.groupBy("subgroup", KEY).agg(
        F.sum(F.col("p") + F.col("n")).alias("rows"), (F.sum("p") > 0).cast("long").alias("septic")
    )
    sizes = per_stay.groupBy("subgroup").agg(
        F.count(F.lit(1)).alias("stays"), F.sum("septic").alias("septic_stays"),
        F.sum("rows").alias("rows"),
    )
    counts = cells.groupBy("subgroup", "score").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    ranked = ranked_metrics(counts, ["subgroup"])
    out = sizes.join(ranked, "subgroup").select(
        "subgroup", "stays", "septic_stays", "rows", "auroc", "auprc",
        (F.col("septic_stays") < min_events).alias("unstable"),
    )
    if n_boot:
        ci = ranked_interval(cells, n_boot, seed, ["subgroup"])
        shown = [F.when(F.col("septic_stays") >= 2, F.col(c)).alias(c) for c in ci.columns if c != "subgroup"]
        out = out.join(ci, "subgroup", "left").select(*out.columns, *shown)
    return out
