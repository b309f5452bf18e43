"""What a user may see at a simulated clock: board, timeline, freshness, alerts, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.blocks import BLOCK_HOURS
from tidewatch.operators.trailing import running_state
from tidewatch.spec import HOUR, ICU, KEY, PanelSpec


class BeyondClock(ValueError):
    """An hour after the replay clock was asked for."""


def limit_hour(clock: int, until: int | None = None) -> int:
    if until is not None and until > clock:
        raise BeyondClock(f"hour {until} lies after the clock, which reads {clock}")
    return clock if until is None else until


def board(predictions: DataFrame, alerts: DataFrame, stays: DataFrame, clock: int) -> DataFrame:
    """One row per stay at ``clock``.

    ``predictions``: stay_id, hour_index, score, status, state.  ``alerts``: stay_id,
    alert_hour, review ('open' or 'acknowledged').  ``stays``: stay_id, n_hours.
    """
    newest = predictions.filter(F.col(HOUR) <= clock).groupBy(KEY).agg(
        F.max_by(F.struct(F.col(HOUR), "score", "status", "state"), F.col(HOUR)).alias("p")
    )
    counts = alerts.filter(F.col("alert_hour") <= clock).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("review") == "open").alias("open_alerts")
    )
    last = F.col("n_hours") - 1
    return stays.select(KEY, "n_hours").join(newest, KEY, "left").join(counts, KEY, "left").select(
        KEY,
        (F.least(F.lit(clock), last) + 1).cast("long").alias("visible_hours"),
        (F.lit(clock) < last).alias("active"), (F.lit(clock) >= last).alias("ended"),
        F.col(f"p.{HOUR}").alias("latest_hour"), F.col("p.score").alias("latest_score"),
        F.col("p.status").alias("latest_status"), F.col("p.state").alias("policy_state"),
        F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("open_alerts", F.lit(0)).alias("open_alerts"),
    )


def six_digits(x: Column) -> Column:
    """Six significant digits: the precision of stored float32 values."""
    return F.format_string("%.6g", x.cast("double")).cast("double")


def timeline(panel: DataFrame, clock: int, until: int | None = None, spec: PanelSpec = ICU,
             stays: Sequence | None = None) -> DataFrame:
    """Observations up to the clock as ``stay_id, hour_index, variable, value, unit``."""
    rows = panel.filter(F.col(HOUR) <= limit_hour(clock, until))
    if stays is not None:
        rows = rows.filter(F.col(KEY).isin(*stays))
    columns = list(spec.clinical)
    long = rows.select(KEY, HOUR, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [KEY, HOUR], columns, "variable", "value"
    )
    units = F.create_map(*[F.lit(x) for c in columns for x in (c, spec.units[c])])
    return long.filter(F.col("value").isNotNull()).select(
        KEY, HOUR, "variable", six_digits(F.col("value")).alias("value"), units[F.col("variable")].alias("unit")
    )


def freshness(panel: DataFrame, stays: DataFrame, clock: int, until: int | None = None, spec: PanelSpec = ICU) -> DataFrame:
    """Last hour of each variable and how long ago that was; ended stays count from their last hour."""
    limit = limit_hour(clock, until)
    # one aggregate over the wide rows, long only afterwards
    wide = panel.filter(F.col(HOUR) <= limit).groupBy(KEY).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.col(HOUR))).alias(c) for c in spec.clinical]
    )
    long = wide.unpivot([KEY], list(spec.clinical), "variable", "last_hour").filter(F.col("last_hour").isNotNull())
    at = F.least(F.lit(limit), F.col("n_hours") - 1)
    return long.join(stays.select(KEY, "n_hours"), KEY).select(
        KEY, "variable", "last_hour", (at - F.col("last_hour")).cast("long").alias("hours_since")
    )


def retrospective(facts: DataFrame, replays: DataFrame) -> DataFrame:
    """Onset proxy of stays whose replay is finished.  ``replays``: replay_id, stay_id, status."""
    done = replays.filter(F.col("status") == "finished").select("replay_id", KEY)
    return done.join(facts, KEY).select(
        "replay_id", KEY, F.col("label_start").alias("label_start_hour"), F.col("onset").alias("onset_proxy_hour"),
        "left_censored",
    )


def alerts_until(alerts: DataFrame, clock: int) -> DataFrame:
    return alerts.filter(F.col("alert_hour") <= clock).orderBy("alert_hour", KEY)


def alert_list(steps: DataFrame, reviews: DataFrame, clock: int, until: int | None = None) -> DataFrame:
    """Every alert up to the clock with its score, versions and review, oldest first.

    ``steps``: stay_id, hour_index, score, state, alert and any ``*_version`` columns.  ``reviews``: stay_id, alert_hour,
    reviewer, reviewed_at_hour, annotation; one after the clock is not seen, and of several the first counts.
    """
    limit = limit_hour(clock, until)
    versions = [c for c in steps.columns if c.endswith("_version")]
    emitted = steps.filter((F.col("alert") == 1) & (F.col(HOUR) <= limit)).select(KEY, F.col(HOUR).alias("alert_hour"), "score", "state", *versions)
    first = reviews.filter(F.col("reviewed_at_hour") <= limit).groupBy(KEY, "alert_hour").agg(
        F.min(F.struct("reviewed_at_hour", "reviewer", "annotation")).alias("r"))
    both = emitted.join(first, [KEY, "alert_hour"], "left")
    review = F.when(F.col("r").isNull(), "open").otherwise("acknowledged").alias("review")
    return both.select(KEY, "alert_hour", "score", "state", review, "r.reviewer", "r.reviewed_at_hour", "r.annotation", *versions).orderBy("alert_hour", KEY)


def newest_first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Top-n by descending ``order`` (no full sort)."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def audit_events(steps: DataFrame) -> DataFrame:
    """``replay_id, hour_index, kind, payload`` from step rows (stay_id, hour_index, score, alert)."""
    emitted = steps.filter(F.col("alert") == 1).select(
        "replay_id", HOUR, F.lit("alert_emitted").alias("kind"),
        F.to_json(F.struct(F.col(KEY), F.col(HOUR).alias("hour"), F.col("score"))).alias("payload"),
    )
    done = steps.groupBy("replay_id", HOUR).agg(
        F.count(F.lit(1)).alias("scored"), F.sum("alert").alias("alerts")
    ).select(
        "replay_id", HOUR, F.lit("replay_step").alias("kind"),
        F.to_json(F.struct(F.col(HOUR).alias("hour"), "scored", "alerts")).alias("payload"),
    )
    return emitted.unionByName(done)


def score_segments(scored: DataFrame, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Stretches of scored hours between unavailable ones."""
    rows = scored.select(KEY, HOUR, "score").withColumn("gap", F.when(F.col("score").isNull(), 1))
    seen = running_state(rows, ("gap",), block_hours=block_hours)
    return (
        seen.filter(F.col("score").isNotNull())
        .groupBy(KEY, F.coalesce("gap@seen", F.lit(-1)).alias("after_gap"))
        .agg(F.min(HOUR).alias("first_hour"), F.max(HOUR).alias("last_hour"), F.count(F.lit(1)).alias("n"))
        .drop("after_gap")
    )


def first_attempt(rows: DataFrame, key: Sequence[str], attempt: str) -> DataFrame:
    """One row per key: the earliest attempt wins, later ones are no-ops."""
    rest = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(attempt)).alias("row"))
    return kept.select(*key, "row.*")
