"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach.

    Uses ``spark.checkpoint.dir`` of the session.  Where it is unset (tests, bench), a
    local master, whose tasks share this machine, works below the warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write an intermediate result once and go on from the files.

    For results that several branches of a plan read: the branches would otherwise
    each run the whole upstream (column pruning makes their exchanges differ, so
    Spark cannot reuse them).  The table outlives lost executors and cuts lineage.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str, finished: bool = True) -> list[str]:
    """Names of the folders below ``path`` (that a job has finished writing); none if it does not exist."""
    at, files = _hadoop(spark, path)
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.isDirectory()]
    names = [(p.getName(), p) for p in found if not p.getName().startswith("_")]
    return sorted(n for n, p in names if not finished or files.exists(_hadoop(spark, f"{p}/_SUCCESS")[0]))


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _hadoop(spark, path)
    return bool(files.exists(at))


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as programs on every executor open it, if it lies in a mounted folder; none in another store."""
    at, files = _hadoop(spark, path)
    uri = files.makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def succeeded(spark: SparkSession, path: str) -> None:
    """Leave the marker of a finished job."""
    at, files = _hadoop(spark, f"{path}/_SUCCESS")
    files.create(at, True).close()


@contextmanager
def listed_by_few(spark: SparkSession) -> Iterator[None]:
    """Folders that are loaded here are listed by some tasks per core; Spark starts up to 10,000 tasks, one for each folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(8 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package has written."""
    at, files = _hadoop(spark, path)
    files.delete(at, True)


class Scratch:
    """Stored results of one step; removed when the step has written what it returns."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root, self.n = spark, work_folder(spark, purpose), 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.root)
