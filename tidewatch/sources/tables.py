"""Tables of a research store: write, read, cache, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.scoring import finite
from tidewatch.operators.trailing import trailing_features
from tidewatch.session import exists, remove, stored, subfolders
from tidewatch.spec import ICU, KEY, FeatureConfig, PanelSpec, feature_version

TABLES = ("hourly", "outcomes", "encounters")


def write_table(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write through Spark's commit protocol: readers see the old or the whole new table."""
    path = f"{root}/{name}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Was the folder written to the end (job commit marker present)?"""
    return exists(spark, f"{path}/_SUCCESS")


#: Parts of a feature cache, by a hash of the stay.
CACHE_PARTS = 64


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(parts)).cast("int")


def part_digests(hourly: DataFrame, parts: int = CACHE_PARTS) -> DataFrame:
    """``part, rows, digest``: what each part of the stays holds, whatever the order of its rows."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(hourly.columns)])
    total = F.sum(row.cast("decimal(38,0)")).cast("string")
    return hourly.groupBy(_part(parts).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.bit_xor(row).cast("string"), total).alias("digest"))


def cached_features(spark: SparkSession, root: str, hourly: DataFrame, cfg: FeatureConfig,
                    spec: PanelSpec = ICU, parts: int = CACHE_PARTS) -> DataFrame:
    """Features of ``cfg``, a table per feature version that follows its input.

    The stays are dealt to ``parts``; parts whose rows have changed since they were written are computed
    again, the others are read.  The digests are written last, so a call that fails is made good by the next.
    """
    base = f"{root}/features/schema_version={feature_version(cfg, spec)}-parts={parts}"
    now = stored(part_digests(hourly, parts), "digests")
    same = spark.createDataFrame([], now.schema)
    if is_complete(spark, f"{base}/digests"):
        same = now.join(spark.read.schema(now.schema).parquet(f"{base}/digests"), now.columns, "left_semi")
    changed = [r["part"] for r in now.join(same, "part", "left_anti").select("part").collect()]  # at most ``parts``
    held = {int(n.split("=")[1]) for n in subfolders(spark, f"{base}/data", finished=False)}
    gone = held - {r["part"] for r in now.select("part").collect()}
    if not changed and not gone:
        return spark.read.parquet(f"{base}/data").drop("part")
    remove(spark, f"{base}/digests")
    for part in gone:
        remove(spark, f"{base}/data/part={part}")
    if changed:
        fresh = trailing_features(hourly.filter(_part(parts).isin(changed)), cfg, spec).withColumn("part", _part(parts))
        writer = fresh.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(f"{base}/data")
    now.write.parquet(f"{base}/digests")
    return spark.read.parquet(f"{base}/data").drop("part")


def file_digests(spark: SparkSession, root: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """``table_name, file, sha256`` of every part file."""
    out = None
    for name in names:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option(
            "recursiveFileLookup", "true").load(f"{root}/{name}")
        part = files.select(
            F.lit(name).alias("table_name"), F.element_at(F.split("path", "/"), -1).alias("file"),
            F.sha2("content", 256).alias("sha256"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def changed_outputs(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Part files that are new, gone or different since ``recorded`` was taken."""
    both = now.join(recorded.withColumnRenamed("sha256", "want"), ["table_name", "file"], "full_outer")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("want"))).select("table_name", "file")


def metrics_long(metrics: DataFrame, *ids: Column) -> DataFrame:
    """A one-row-per-id metrics frame as ``*ids, metric, value`` with NaN and infinities as null."""
    names = [f.name for f in metrics.schema if f.dataType.typeName() not in ("string", "boolean")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), finite(F.col(n)).alias("value")) for n in names]))
    return metrics.select(*ids, pairs.alias("m")).select("*", "m.metric", "m.value").drop("m")


def write_metrics(long: DataFrame, path: str) -> None:
    long.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
