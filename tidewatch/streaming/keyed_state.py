"""One row of state per key, as a change log with compaction.

A micro-batch appends the rows of the keys that it touched (``log/batch=<id>``), so what it writes
grows with the batch and not with the number of keys.  A key's state is its newest row in the
last compacted table (``base/upto=<id>``) and the logs after it.  Both are partitioned by a hash of the
key, so that a batch reads the parts that its keys fall in.  Once the log holds as many rows as
the base, or has MAX_LOGS batches, it is folded in; rows that have expired are left out then.  A row is
therefore rewritten about once for each time that it changes.

A batch reads only what earlier batches wrote and replaces its own folders, so it can run again
after a crash.  The base and the logs before the last one stay for that; older ones are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import remove, subfolders

#: Parts that a table is split into, and batches whose logs are read one by one at most.
PARTS, MAX_LOGS = 64, 32


class KeyedState:
    def __init__(self, path: str, key: str, schema: str, parts: int = PARTS, max_logs: int = MAX_LOGS):
        """``schema`` (DDL) holds ``key`` and the state's columns."""
        self.path, self.key, self.schema, self.parts, self.max_logs = path.rstrip("/"), key, schema, parts, max_logs

    def _ids(self, spark: SparkSession, kind: str, before: int) -> list[int]:
        found = sorted(int(n.split("=")[1]) for n in subfolders(spark, f"{self.path}/{kind}"))
        return [i for i in found if i < before]

    def _pieces(self, spark: SparkSession, before: int) -> tuple[list[str], list[str], int | None]:
        base = self._ids(spark, "base", before)[-1:]
        logs = [i for i in self._ids(spark, "log", before) if not base or i > base[0]]
        return [f"{self.path}/base/upto={i}" for i in base], [f"{self.path}/log/batch={i}" for i in logs], base[0] if base else None

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        schema = f"{self.schema}, gone boolean, version long, part int"
        if not paths:
            return spark.createDataFrame([], schema)
        out = None
        for p in paths:  # each folder is a table of its own, partitioned by ``part``
            one = spark.read.schema(schema).parquet(p)
            out = one if out is None else out.unionByName(one)
        return out

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "version").alias("s")).select(self.key, "s.*").where("NOT gone")

    def of(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """State of ``keys`` (one column) as the batches before ``batch_id`` left it; unknown keys are absent."""
        spark = keys.sparkSession
        base, logs, _ = self._pieces(spark, batch_id)
        touched = [r.part for r in keys.select(self.part_of().alias("part")).distinct().collect()]  # at most PARTS
        rows = self._read(spark, [*base, *logs]).where(F.col("part").isin(touched))
        return self._newest(rows.join(keys.distinct(), self.key, "left_semi")).drop("gone", "version", "part")

    def all(self, spark: SparkSession, batch_id: int) -> DataFrame:
        base, logs, _ = self._pieces(spark, batch_id)
        return self._newest(self._read(spark, [*base, *logs])).drop("gone", "version", "part")

    def put(self, changed: DataFrame, batch_id: int, live: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write the rows that the batch changed; fold the log in when it is due, only the rows that ``live`` lets pass."""
        spark = changed.sparkSession
        own = f"{self.path}/log/batch={batch_id}"
        rows = changed.withColumns({"gone": F.lit(False), "version": F.lit(batch_id).cast("long"), "part": self.part_of()})
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(own)
        base, logs, last = self._pieces(spark, batch_id)
        logs.append(own)
        n_base, n_logs = (self._read(spark, p).count() for p in (base, logs))
        if len(logs) < self.max_logs and n_logs < max(n_base, 1):
            return
        kept = self._newest(self._read(spark, [*base, *logs]))
        if live is not None:
            kept = live(kept)
        kept.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/base/upto={batch_id}")
        if last is not None:  # a repeat of this batch still needs ``last`` and the logs after it
            for i in self._ids(spark, "base", last):
                remove(spark, f"{self.path}/base/upto={i}")
            for i in self._ids(spark, "log", last + 1):
                remove(spark, f"{self.path}/log/batch={i}")
