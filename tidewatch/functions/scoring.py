"""Score, calibration and reward expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# --- fixed values: reward windows (hours from onset) and rewards ---
EARLIEST, OPTIMAL, LATEST = -12, -6, 3
HIT_MAX, MISS_MIN, FALSE_ALARM = 1.0, -2.0, -0.05
LOGIT_EPS = 1e-7
# --------------------------------------------------------------------


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    x = x.cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~bad, x)


def status(latest_vitals: Sequence[Column]) -> Column:
    """A row is scored when at least one fast variable still has a valid value."""
    return F.when(F.coalesce(*latest_vitals).isNotNull(), "scored").otherwise("data_unavailable")


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(LOGIT_EPS), F.least(F.lit(1 - LOGIT_EPS), p.cast("double")))
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def calibrated(p: Column, a: float | Column, b: float | Column) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    return sigmoid(a * logit(p) + b)


def bagged(margins: Sequence[Column]) -> Column:
    """Mean margin of several models, as a probability."""
    return sigmoid(reduce(add, margins) / len(margins))


def reward(t: Column, onset: Column, alarm: Column) -> Column:
    """Reward of one hour.  ``onset`` is null for entities that never turn positive.

    Early alarms ramp up to the optimum and decay to zero at ``LATEST``; silence
    after the optimum costs ever more; hours past ``LATEST`` count nothing.
    """
    d = (t - onset).cast("double")
    ramp = F.greatest(HIT_MAX * (d - EARLIEST) / (OPTIMAL - EARLIEST), F.lit(FALSE_ALARM))
    decay = HIT_MAX * (LATEST - d) / (LATEST - OPTIMAL)
    silence = MISS_MIN * (d - OPTIMAL) / (LATEST - OPTIMAL)
    on_alarm = (
        F.when(onset.isNull(), F.lit(FALSE_ALARM))
        .when(d > LATEST, 0.0)
        .when(d <= OPTIMAL, ramp)
        .otherwise(decay)
    )
    on_silence = F.when((d > OPTIMAL) & (d <= LATEST), silence).otherwise(0.0)
    return F.when(alarm, on_alarm).otherwise(on_silence)


def ideal_alarm(t: Column, onset: Column) -> Column:
    return F.coalesce((t - onset).between(EARLIEST, LATEST), F.lit(False))
