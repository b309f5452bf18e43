"""Onset, horizon labels and per-entity outcome facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.spec import HOUR, KEY

LEAD_HOURS = 6  # fixed value: the supplied label starts this many hours before onset


def onset(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per stay: size, last hour, first positive hour, inferred onset and flags.

    A stay that is positive from its first row has an unknown onset (left-censored).
    The onset may lie beyond the last observed hour.
    """
    start = F.min(F.when(F.col(label) == 1, F.col(HOUR)))
    facts = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.min(HOUR).alias("first_hour"),
        F.max(HOUR).alias("last_hour"),
        start.alias("start"),
    )
    septic = F.col("start").isNotNull()
    censored = F.coalesce(F.col("start") == F.col("first_hour"), F.lit(False))
    return facts.select(
        KEY, "n_hours", "first_hour", "last_hour",
        F.col("start").alias("label_start"),
        F.when(~censored, F.col("start") + LEAD_HOURS).alias("onset"),
        septic.alias("septic"),
        censored.alias("left_censored"),
        (septic & ~censored).alias("evaluable"),
    )


def reward_times(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per stay: first hour and reward onset (first positive + 6, censored stays included)."""
    return rows.groupBy(KEY).agg(
        F.min(HOUR).alias("first_hour"),
        (F.min(F.when(F.col(label) == 1, F.col(HOUR))) - F.min(HOUR) + LEAD_HOURS).alias("t_onset"),
    )


def state_label(rows: DataFrame, label: str = "label") -> DataFrame:
    """The supplied state label, unshifted."""
    return rows.select(KEY, HOUR, F.col(label).cast("byte").alias("label"))


def incident_labels(rows: DataFrame, facts: DataFrame, horizon: int = 6) -> DataFrame:
    """Will the first onset fall in (t, t + horizon]?

    1 inside the horizon, 0 when the whole horizon was watched without onset, else
    null.  Hours from the onset on are not at risk; stays whose onset is at or
    before hour 0 are prevalent and excluded.  ``facts`` has stay_id, onset, last_hour.
    """
    t, at = F.col(HOUR), F.col("onset")
    joined = rows.select(KEY, HOUR).join(facts.select(KEY, "onset", "last_hour"), KEY)
    prevalent = F.coalesce(at <= 0, F.lit(False))
    at_risk = ~prevalent & F.coalesce(at > t, F.lit(True))
    label = F.when(at <= t + horizon, 1).when(t + horizon <= F.col("last_hour"), 0)
    return joined.select(
        KEY, HOUR,
        F.when(at_risk, label).alias("label"),
        at_risk.alias("at_risk"),
        F.when(prevalent, "prevalent_excluded").otherwise("included").alias("status"),
    )
