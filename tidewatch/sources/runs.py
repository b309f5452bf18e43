"""Run documents: nested JSON under run folders, read as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_documents(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """JSON files below ``root`` that match ``pattern``, with run and split taken from the folders."""
    docs = spark.read.schema(schema).option("multiLine", "true").json(f"{root}/{pattern}")
    path = F.col("_metadata.file_path")
    run = F.regexp_extract(path, r"/run(?:_id)?=([^/]+)/", 1)
    split = F.regexp_extract(path, r"/split=([^/]+)/", 1)
    return docs.select(run.alias("run_id"), F.nullif(split, F.lit("")).alias("split"), "*")


def runs_report(bundles: DataFrame, evaluations: DataFrame, searches: DataFrame | None = None, explanations: DataFrame | None = None,
                top: int = 10) -> DataFrame:
    """One row per run: its metadata, evaluations by split (map), policy search, and ``top`` features by importance.

    ``searches``: run_id and the columns of one policy search.  ``explanations``: run_id, feature, importance, share; a row per feature.
    """
    by_split = evaluations.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "metrics")))).alias("evaluations")
    )
    out = bundles.join(by_split, "run_id", "left")
    if searches is not None:
        fields = [c for c in searches.columns if c != "run_id"]
        out = out.join(searches.select("run_id", F.struct(*fields).alias("policy_search")), "run_id", "left")
    if explanations is not None:
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("_order"), "feature", "importance", "share")))
        best = explanations.groupBy("run_id").agg(F.transform(F.slice(ranked, 1, top), lambda r: r.dropFields("_order")).alias("features"))
        out = out.join(best, "run_id", "left")
    return out


def promote(candidates: DataFrame) -> DataFrame:
    """The run with the best validation AUPRC (first name on ties)."""
    best = F.max_by("run_id", F.struct(F.col("val_auprc"), -F.col("position")))
    return candidates.agg(best.alias("selected"), F.max("val_auprc").alias("val_auprc"), F.count(F.lit(1)).alias("candidates"))


def append_look(spark: SparkSession, path: str, run: str, split: str) -> None:
    """Add one row (run, split, now) to the look log."""
    spark.range(1).select(F.lit(run).alias("run"), F.lit(split).alias("split"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def looks(log: DataFrame) -> DataFrame:
    """How often each run has looked at each split, and when first."""
    return log.groupBy("run", "split").agg(F.count(F.lit(1)).alias("looks"), F.min("at").alias("first_at"))


def prior_looks(log: DataFrame) -> DataFrame:
    """Looks at a split by other runs before a run's own first look.

    A run has no look of its own before its first, so this is the number of log rows
    of the split that are strictly earlier: a rank, not a self-join.
    """
    from tidewatch.operators.ranking import prefix_totals

    at = F.unix_micros(F.col("at").cast("timestamp"))
    moments = log.groupBy("split", at.alias("us")).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_totals(moments, ["split"], [F.col("us")], ["n"])
    firsts = log.groupBy("run", "split").agg(F.min(at).alias("us"))
    return firsts.join(ranked, ["split", "us"]).select("run", "split", F.col("before_n").alias("prior_looks"))
