"""Panel rules, per-stay and per-hospital summaries, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.spec import DATASET, HOUR, ICU, KEY, LABEL_VERSION, TARGET, PanelSpec


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = (KEY, HOUR)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def contiguity_violations(rows: DataFrame, key: str = KEY, hour: str = HOUR) -> DataFrame:
    """Entities whose hours are not exactly first..last, once each.

    Distinct hours first (so repeats collapse map-side), then counts: no per-entity sort.
    """
    hours = rows.groupBy(key, hour).agg(F.count(F.lit(1)).alias("n"))
    facts = hours.groupBy(key).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_hours"),
        F.min(hour).alias("first"), F.max(hour).alias("last"),
    )
    span = (F.col("last") - F.col("first") + 1).cast("long")
    return facts.select(
        key, "n_rows", "n_hours", span.alias("span"),
        (F.col("n_rows") - F.col("n_hours")).alias("repeated"),
        (span - F.col("n_hours")).alias("missing"),
    ).filter((F.col("repeated") > 0) | (F.col("missing") > 0))


def panel_rules(rows: DataFrame, clock: str = "ICULOS", label: str = "label") -> DataFrame:
    """Broken rules per stay.

    A row follows the one before it when its clock is exactly one later; the label is
    0 or 1 and never reverts.  Every rule is a count or a min/max, so a stay's rows are
    pre-aggregated where they are read: clocks are strictly hourly in row order exactly
    when ``clock - hour_index`` is constant, and a label reverts exactly when some 0 comes
    after the first 1.
    """
    y = F.col(label)
    per_stay = rows.groupBy(KEY).agg(
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_labels"),
        F.count_if(F.col(clock).isNull()).alias("missing_clock"),
        (F.max(F.col(clock) - F.col(HOUR)) != F.min(F.col(clock) - F.col(HOUR))).alias("not_hourly"),
        (F.max(F.when(y == 0, F.col(HOUR))) > F.min(F.when(y == 1, F.col(HOUR)))).alias("reverts"),
    )
    return per_stay.select(
        KEY, "bad_labels", "missing_clock",
        F.coalesce("not_hourly", F.lit(False)).alias("not_hourly"),
        F.coalesce("reverts", F.lit(False)).alias("reverts"),
    )


def rule_error(bad_labels: Column, missing_clock: Column, not_hourly: Column, reverts: Column) -> Column:
    """The first broken rule as a message, or null."""
    return (
        F.when(bad_labels > 0, "label takes values other than 0 and 1")
        .when(missing_clock > 0, "ICULOS without a value")
        .when(not_hourly, "ICULOS skips or repeats an hour")
        .when(reverts, "label falls back to 0")
    )


def split_tables(rows: DataFrame, spec: PanelSpec = ICU, label: str = "label",
                 ids: Sequence[str] = ("hospital", "record")) -> tuple[DataFrame, DataFrame]:
    """Inputs (float, no label) and outcomes (label only)."""
    hourly = rows.select(KEY, *ids, HOUR, *[F.col(c).cast("float").alias(c) for c in spec.inputs])
    outcomes = rows.select(
        KEY, F.lit(TARGET).alias("target_id"), HOUR, F.col(label).cast("byte").alias("label"),
        F.lit(LABEL_VERSION).alias("label_version"),
    )
    return hourly, outcomes


def first_known(column: str) -> Column:
    """First non-null value of a stay in hour order."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(HOUR)))


def encounters(rows: DataFrame, label: str = "label", offset: str | None = "HospAdmTime",
               clock: str | None = "ICULOS", ids: Sequence[str] = ("hospital",), dataset: str = DATASET) -> DataFrame:
    """One row per stay."""
    extra = [first_known(src).cast("double").alias(dst)
             for src, dst in ((offset, "admission_offset_h"), (clock, "first_iculos")) if src]
    per_stay = rows.groupBy(KEY, *ids).agg(
        F.count(F.lit(1)).alias("n_hours"),
        *extra,
        (F.max(label) == 1).alias("ever_positive"),
        (F.min_by(label, HOUR) == 1).alias("first_row_positive"),
    )
    return per_stay.select(
        F.lit(dataset).alias("dataset"), F.lit("1.0.0").alias("dataset_version"), KEY,
        F.lit(None).cast("string").alias("patient_key_if_available"),
        *[F.col(i).alias("hospital_key" if i == "hospital" else i) for i in ids],
        *[c for c in per_stay.columns if c not in (KEY, *ids)],
    )


def quality_report(rows: DataFrame, stays: DataFrame, label: str = "label") -> DataFrame:
    """Per hospital: sizes, prevalence, censoring, length of stay."""
    hours = rows.groupBy(F.col("hospital").alias("hospital")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positive_hours")
    )
    # lengths of stay are small whole numbers, so the exact percentile keeps a short value list
    per_stay = stays.groupBy(F.col("hospital_key").alias("hospital")).agg(
        F.count(F.lit(1)).alias("stays"),
        F.count_if("ever_positive").alias("ever_positive_stays"),
        F.count_if("first_row_positive").alias("left_censored_positive_stays"),
        F.percentile("n_hours", F.lit(0.5)).alias("median_hours"),
        F.max("n_hours").alias("max_hours"),
    )
    return per_stay.join(hours, "hospital").select(
        "hospital", "stays", "rows", (F.col("rows") / 24.0).alias("patient_days"), "positive_hours",
        (F.col("positive_hours") / F.col("rows")).alias("positive_hour_prevalence"),
        "ever_positive_stays", "left_censored_positive_stays", "median_hours", "max_hours",
    )


def missing_fraction(rows: DataFrame, columns: Sequence[str], by: str = "hospital") -> DataFrame:
    """Long table ``by, variable, missing_fraction`` from one pass over the rows."""
    wide = rows.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([by], list(columns), "variable", "missing_fraction")


def file_report(rows: DataFrame, spec: PanelSpec = ICU, by: Sequence[str] = ("hospital", "record")) -> DataFrame:
    """Per record: rows, columns and the missing fraction of each clinical variable (map)."""
    wide = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in spec.clinical]),
            F.array(*[F.avg(F.col(c).isNull().cast("double")) for c in spec.clinical]),
        ).alias("missing_fraction"),
    )
    return wide.withColumn("columns", F.lit(len(spec.inputs) + 1))


def count_gate(stays: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Stay counts per hospital beside the expected ones."""
    pairs = F.explode(F.create_map(*[x for h, n in expected.items() for x in (F.lit(h), F.lit(int(n)).cast("long"))]))
    want = stays.sparkSession.range(1).select(pairs.alias("hospital", "expected"))
    got = stays.groupBy(F.col("hospital_key").alias("hospital")).agg(F.count(F.lit(1)).alias("stays"))
    return want.join(got, "hospital", "left").select(
        "hospital", F.coalesce("stays", F.lit(0)).alias("stays"), "expected",
        (F.coalesce("stays", F.lit(0)) == F.col("expected")).alias("ok"),
    )


def coverage(scored: DataFrame) -> DataFrame:
    """Scheduled and scored hours, and unavailable hours by reason (map)."""
    by_status = scored.groupBy("status").agg(F.count(F.lit(1)).alias("n"))  # one row per status
    done = F.coalesce(F.sum(F.when(F.col("status") == "scored", F.col("n"))), F.lit(0))
    other = F.collect_list(F.when(F.col("status") != "scored", F.struct("status", "n")))
    return by_status.agg(
        F.sum("n").alias("scheduled_hours"), done.alias("scored_hours"),
        (done / F.sum("n")).alias("coverage"),
        F.map_from_entries(F.array_sort(other)).alias("unavailable_by_reason"),
    )
