"""End-to-end jobs: prepare, label join, evaluate, select policy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.naming import feature_family
from tidewatch.operators import alerts, bootstrap, labels, metrics, quality, ranking, splits, utility
from tidewatch.plans import models
from tidewatch.session import stored
from tidewatch.sources import records, runs, tables
from tidewatch.spec import EXPECTED_STAYS, HOUR, ICU, KEY, LABEL, AlertPolicy, PanelSpec


def labelled(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Features joined one-to-one with labels; a missing or repeated label fails the job when it runs."""
    once = outcomes.groupBy(KEY, HOUR).agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))
    joined = features.join(once, [KEY, HOUR], "left")
    sound = F.when(F.col("n").isNull(), F.raise_error(F.lit("no label for some feature row"))).when(
        F.col("n") > 1, F.raise_error(F.lit("several labels for one feature row"))
    ).otherwise(F.col("label"))
    return joined.select(*features.columns, sound.alias("label"))


def prepare(spark: SparkSession, raw_root: str, out: str, expected: Mapping[str, int] | None = EXPECTED_STAYS,
            manifest: DataFrame | None = None) -> DataFrame:
    """Record files to ``hourly``, ``outcomes`` and ``encounters`` tables; returns the quality report.

    The raw files are read and checked once.  The tables and the quarantine are written first, then the
    job fails if any file was rejected or a hospital's count is off.  Empty files are known by ``manifest``.
    """
    checked = stored(records.check_files(records.list_files(spark, raw_root, manifest=manifest)), "checked")
    tables.write_table(records.quarantine(checked), out, "quarantine")
    rows = stored(records.hours(checked), "parsed")  # feeds three tables and the checks
    if quality.duplicate_keys(rows).take(1):
        raise records.BadRecords("a stay has two rows for one hour")
    hourly, outcomes = quality.split_tables(rows, ICU, LABEL)
    stays = quality.encounters(rows, LABEL, ids=("hospital", "record"))
    for name, df in (("hourly", hourly), ("outcomes", outcomes), ("encounters", stays)):
        tables.write_table(df, out, name)
    stays = tables.read_table(spark, out, "encounters")
    tables.write_table(quality.quality_report(rows, stays, LABEL), out, "quality")
    tables.write_table(quality.missing_fraction(rows, ICU.inputs), out, "missing_fraction")
    tables.write_table(tables.file_digests(spark, out), out, "digests")
    records.refuse_bad(checked, stays, expected)
    return tables.read_table(spark, out, "quality")


def select_policy(scored: DataFrame, budgets=(1, 2, 5, 10, 20), primary: float = 10, consecutive=(1, 2, 3),
                  cooldowns=(0, 6, 12)) -> dict:
    """Choose the alert policy and the benchmark threshold on validation rows, which are written once."""
    scored = stored(scored, "validation")
    thresholds = utility.as_array(utility.threshold_grid(scored, utility.even_probs(0.80, 0.9995, 40), digits=6))
    grid = alerts.policy_grid(scored, labels.onset(scored), thresholds, consecutive, cooldowns)
    chosen = {r["budget"]: r.asDict() for r in alerts.best_per_budget(grid, budgets).collect()}  # one row per budget
    best = chosen[float(primary)]
    if not best["feasible"]:
        raise RuntimeError(f"no policy stays within {primary} alerts per 100 patient-days")
    top = utility.best_threshold(utility.utility_curve(scored)).first()
    policy = AlertPolicy(best["threshold"], best["consecutive"], best["cooldown_h"])
    return {"policy": policy, "by_budget": chosen, "benchmark_threshold": top["threshold"], "utility": top["utility"]}


def evaluate(scored: DataFrame, demographics: DataFrame, policy: AlertPolicy, threshold: float, run: str, split: str,
             n_boot: int = 200, seed: int = 0, rules: DataFrame | None = None, log: str | None = None,
             out: str | None = None) -> DataFrame:
    """All metrics of one run and split as ``run, split, part, metric, value``.

    Predictions are written first (to the table ``predictions`` below ``out``, else to the work folder) and every part
    reads them from there.  ``rules`` (stay_id, hour_index, rule, score) are baselines on the same hours.  With ``log``
    the look is appended to that log, and its number is part of the document.
    """
    spark = scored.sparkSession
    predicted = metrics.predictions(scored, threshold)
    if out is None:
        rows = stored(predicted, "predictions")
    else:
        tables.write_table(predicted.withColumn("run", F.lit(run)).withColumn("split", F.lit(split)), out, f"predictions/{run}/{split}")
        rows = tables.read_table(spark, out, f"predictions/{run}/{split}").drop("run", "split")
    facts = labels.onset(rows)
    fired = alerts.alert_hours(rows, policy)
    per_stay = stored(utility.stay_utilities(rows), "utilities")
    covered = stored(quality.coverage(rows), "coverage")
    parts = {
        "counts": rows.agg(F.count_distinct(KEY).alias("records"), F.count_if(F.col("status") != "scored").alias("fallback_rows")),
        "hourly": metrics.hourly_metrics(rows, n_boot, seed),
        "benchmark": utility.normalised_utility(per_stay),
        "alerts": alerts.alert_metrics(alerts.match_onsets(fired, facts)),
        "coverage": covered.drop("unavailable_by_reason"),
        "confusion": metrics.confusion(rows),
    }
    if n_boot:
        parts["benchmark_ci"] = bootstrap.utility_interval(per_stay, n_boot, seed)
    if log is not None:
        runs.append_look(spark, log, run, split)
        seen = runs.looks(spark.read.parquet(log)).filter((F.col("run") == run) & (F.col("split") == split))
        parts["look"] = seen.select(F.col("looks").alias("number"))
    ids = (F.lit(run).alias("run"), F.lit(split).alias("split"))
    named = [(frame, F.lit(part)) for part, frame in parts.items()]
    named.append((covered.select(F.explode("unavailable_by_reason").alias("reason", "hours")), F.concat(F.lit("unavailable "), F.col("reason"))))
    table = metrics.reliability(rows)
    named.append((table, F.concat(F.lit("reliability from "), F.round("bin_lower", 6).cast("string"))))
    groups = metrics.subgroup_metrics(rows, demographics, min(n_boot, 100))
    named.append((groups, F.concat(F.lit("subgroup "), F.col("subgroup"))))
    if rules is not None:
        judged = rules.join(rows.select(KEY, HOUR, "label"), [KEY, HOUR])
        ranked = ranking.ranked_metrics(ranking.class_counts(judged, ["rule"]), ["rule"])
        named.append((ranked, F.concat(F.lit("rule "), F.col("rule"))))
    document = None
    for frame, part in named:
        long_rows = tables.metrics_long(frame, *ids, part.alias("part"))
        document = long_rows if document is None else document.unionByName(long_rows)
    return document


def explain(validation: DataFrame, model, n_stays: int, seed: int = 0, spec: PanelSpec = ICU, out: str | None = None) -> DataFrame:
    """``feature, importance, share, family, stays`` of a linear model on a fixed sample of validation stays, largest first.

    With ``out`` the document is written there as JSON and read back.
    """
    sampled = splits.sample(validation.select(KEY).distinct(), n_stays, seed)
    rows = stored(validation.join(sampled.select(KEY), KEY, "left_semi"), "explained")
    stays = rows.select(KEY).distinct().count()
    found = models.explain(rows, model).withColumns({"family": feature_family(F.col("feature"), spec), "stays": F.lit(stays)})
    if out is None:
        return found
    found.coalesce(1).write.mode("overwrite").json(out)
    return found.sparkSession.read.schema(found.schema).json(out)
