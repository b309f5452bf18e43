"""Derived clinical quantities from latest valid values (Column in, Column out)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# --- fixed values: grade cut points and screening limits ---
COAG_CUTS = (150, 100, 50, 20)  # platelets, lower is worse
LIVER_CUTS = (1.2, 2.0, 6.0, 12.0)  # bilirubin
RENAL_CUTS = (1.2, 2.0, 3.5, 5.0)  # creatinine
# -----------------------------------------------------------


def shock_index(hr: Column, sbp: Column) -> Column:
    return F.when(sbp > 0, hr / sbp)


def pulse_pressure(sbp: Column, dbp: Column) -> Column:
    return sbp - dbp


def grade(x: Column, cuts: Sequence[float], lower_is_worse: bool = False) -> Column:
    """0..len(cuts) by how many cut points are passed; unknown stays unknown."""
    passed = [(x < c) if lower_is_worse else (x >= c) for c in cuts]
    return reduce(add, [p.cast("double") for p in passed])


def known_criteria(*criteria: tuple[Column, Column]) -> Column:
    """How many ``(input, condition)`` pairs hold; null when no input is known."""
    met = reduce(add, [F.coalesce(cond.cast("double"), F.lit(0.0)) for _, cond in criteria])
    return F.when(F.coalesce(*[x for x, _ in criteria]).isNotNull(), met)


def _out_of_range(x: Column, low: float, high: float) -> Column:
    return (x > high) | (x < low)


def organ_scores(latest: Mapping[str, Column]) -> dict[str, Column]:
    """Partial organ grades and screening counts.  ``latest`` maps variable name to column."""
    hr, rr, temp = latest["HR"], latest["Resp"], latest["Temp"]
    sbp, mean_bp = latest["SBP"], latest["MAP"]
    spo2, fio2, wbc = latest["O2Sat"], latest["FiO2"], latest["WBC"]
    organs = {
        "SOFA_coag": grade(latest["Platelets"], COAG_CUTS, lower_is_worse=True),
        "SOFA_liver": grade(latest["Bilirubin_total"], LIVER_CUTS),
        "SOFA_renal": grade(latest["Creatinine"], RENAL_CUTS),
        "SOFA_cardio_map": (mean_bp < 70).cast("double"),
    }
    parts = list(organs.values())
    known = reduce(add, [p.isNotNull().cast("double") for p in parts])
    total = reduce(add, [F.coalesce(p, F.lit(0.0)) for p in parts])
    fever = _out_of_range(temp, 36, 38)
    return organs | {
        "SOFA_partial": F.when(known > 0, total),
        "SOFA_components": known,
        # a fraction only; other encodings of FiO2 are left alone
        "SF_ratio": F.when(fio2.between(0.21, 1.0), spo2 / fio2),
        "qSOFA_partial": known_criteria((rr, rr >= 22), (sbp, sbp <= 100)),
        "SIRS_partial": known_criteria(
            (temp, fever), (hr, hr > 90), (rr, rr > 20), (wbc, _out_of_range(wbc, 4, 12))
        ),
        "abnormal_vitals": known_criteria(
            (hr, hr > 90), (rr, rr > 20), (temp, fever), (mean_bp, mean_bp < 65), (spo2, spo2 < 92), (sbp, sbp < 90)
        ),
    }


def _points(*conditions: Column) -> Column:
    """Rule baselines count an unknown input as not met."""
    return reduce(add, [F.coalesce(c, F.lit(False)).cast("double") for c in conditions])


def rule_qsofa(latest: Mapping[str, Column]) -> Column:
    return _points(latest["Resp"] >= 22, latest["SBP"] <= 100)


def rule_sirs(latest: Mapping[str, Column]) -> Column:
    return _points(
        _out_of_range(latest["Temp"], 36, 38),
        latest["HR"] > 90,
        latest["Resp"] > 20,
        _out_of_range(latest["WBC"], 4, 12),
    )


def age_band(age: Column) -> Column:
    return (
        F.when((age >= 0) & (age < 50), "<50")
        .when((age >= 50) & (age < 65), "50-64")
        .when((age >= 65) & (age < 80), "65-79")
        .when((age >= 80) & (age < 200), ">=80")
    )
