"""Time-dependent reward, normalised utility and the threshold sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.scoring import ideal_alarm, reward
from tidewatch.operators.labels import reward_times
from tidewatch.operators.ranking import prefix_totals, quantiles
from tidewatch.session import stored
from tidewatch.spec import HOUR, KEY


def with_rewards(rows: DataFrame, alarm: str | None = None, label: str = "label") -> DataFrame:
    """Add the reward of alarming, of silence, of the ideal choice and of ``alarm``."""
    timed = rows.join(reward_times(rows, label), KEY)
    t, at = F.col(HOUR) - F.col("first_hour"), F.col("t_onset")
    out = {
        "t": t,
        "t_onset": at,
        "u_alarm": reward(t, at, F.lit(True)),
        "u_silent": reward(t, at, F.lit(False)),
        "u_best": reward(t, at, ideal_alarm(t, at)),
    }
    if alarm:
        out["u_observed"] = reward(t, at, F.col(alarm).cast("boolean"))
    return timed.select(*rows.columns, *[c.alias(n) for n, c in out.items()])


def stay_utilities(rows: DataFrame, alarm: str = "prediction") -> DataFrame:
    """Per-stay sums; enough for the utility and for its bootstrap."""
    return (
        with_rewards(rows, alarm)
        .groupBy(KEY)
        .agg(
            F.sum("u_observed").alias("observed"),
            F.sum("u_best").alias("best"),
            F.sum("u_silent").alias("inaction"),
        )
    )


def normalised(observed, best, inaction):
    gap = best - inaction
    return F.when(F.abs(gap) > 1e-12, (observed - inaction) / gap)


def normalised_utility(per_stay: DataFrame) -> DataFrame:
    total = per_stay.agg(*[F.sum(c).alias(c) for c in ("observed", "best", "inaction")])
    return total.select(
        "observed", "best", "inaction",
        normalised(F.col("observed"), F.col("best"), F.col("inaction")).alias("utility"),
    )


def even_probs(start: float, stop: float, n: int) -> list[float]:
    """``n`` evenly spaced probabilities, end points included."""
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


def threshold_grid(rows: DataFrame, probs: Sequence[float], digits: int | None = None) -> DataFrame:
    """Distinct score quantiles, at most ``len(probs)`` rows."""
    at = quantiles(rows, "score", probs)
    value = F.col("value") if digits is None else F.round("value", digits)
    return at.select(value.alias("threshold")).distinct()


def as_array(thresholds: DataFrame):
    """A small threshold table as one ascending array value (a scalar subquery)."""
    return thresholds.agg(F.array_sort(F.collect_list("threshold"))).scalar()


def utility_curve(rows: DataFrame, probs: Sequence[float] | None = None) -> DataFrame:
    """Normalised utility at every grid threshold in one pass over the rows.

    U(thr) = sum of silence + sum over score >= thr of (alarm - silence).  Gains are
    summed per distinct score, the thresholds join that list with gain 0, and each
    reads the total from its own position upward.
    """
    grid = threshold_grid(rows, list(probs or even_probs(0.5, 0.999, 120)))
    per_score = stored(with_rewards(rows).groupBy(F.col("score").cast("double").alias("threshold")).agg(
        F.sum(F.col("u_alarm") - F.col("u_silent")).alias("gain"), F.sum("u_silent").alias("inaction"), F.sum("u_best").alias("best")
    ), "gains")
    gains = per_score.filter(F.col("threshold").isNotNull()).select("threshold", "gain")
    marks = gains.withColumn("asked", F.lit(0)).unionByName(
        grid.select("threshold", F.lit(0.0).alias("gain"), F.lit(1).alias("asked"))
    )
    points = marks.groupBy("threshold").agg(F.sum("gain").alias("gain"), F.max("asked").alias("asked"))
    ranked = prefix_totals(points, [], [F.col("threshold")], ["gain"], descending=True)
    fixed = per_score.agg(F.struct(F.sum("inaction").alias("inaction"), F.sum("best").alias("best"))).scalar()
    asked = ranked.filter(F.col("asked") == 1).withColumn("fixed", fixed)
    inaction, best = F.col("fixed.inaction"), F.col("fixed.best")
    observed = F.col("before_gain") + F.col("gain") + inaction
    return asked.select("threshold", normalised(observed, best, inaction).alias("utility"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The lowest threshold that reaches the maximum."""
    u = F.round("utility", 9)
    return curve.agg(
        F.max_by("threshold", F.struct(u, -F.col("threshold"))).alias("threshold"), F.max("utility").alias("utility")
    )
