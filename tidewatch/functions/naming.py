"""Identifiers, version strings and feature families."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch.spec import DATASET, ICU, ORGAN_FEATURES, PanelSpec


def namespaced_id(hospital: Column, record: Column, dataset: str = DATASET) -> Column:
    return F.concat_ws(":", F.lit(dataset), hospital, record)


def id_parts(stay: Column) -> dict[str, Column]:
    parts = F.split(stay, ":")
    return {"dataset": parts[0], "hospital": parts[1], "record": parts[2]}


def export_file_name(stay: Column) -> Column:
    return F.concat(F.regexp_replace(stay.cast("string"), ":", "_"), F.lit(".psv"))


def decimal_text(x: Column) -> Column:
    """Shortest text of a value with at most six decimals ("0.5", "1.0")."""
    trimmed = F.regexp_replace(F.format_string("%.6f", x.cast("double")), "0+$", "")
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def policy_version(threshold: Column, consecutive: Column, cooldown_h: Column) -> Column:
    """Same value as ``AlertPolicy.version`` for thresholds in [0.0001, 1] with six decimals."""
    doc = F.concat(
        F.lit('{"consecutive": '), consecutive.cast("string"),
        F.lit(', "cooldown_h": '), cooldown_h.cast("string"),
        F.lit(', "threshold": '), decimal_text(threshold), F.lit("}"),
    )
    return F.concat(F.lit("policy-"), F.substring(F.sha2(doc, 256), 1, 10))


def input_fingerprint(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def feature_family(name: Column, spec: PanelSpec = ICU) -> Column:
    base = F.split_part(name, F.lit("__"), F.lit(1))
    pattern = (
        name.endswith("__observed") | name.endswith("__hours_since")
        | name.startswith("vitals__count") | name.startswith("labs__count")
    )
    return (
        F.when(pattern, "observation pattern")
        .when(name.isin(*ORGAN_FEATURES, "ShockIndex", "PulsePressure"), "derived score")
        .when(name.isin(*spec.time_columns, "Unit1", "Unit2"), "time / administrative")
        .when(name.isin(*spec.demographics), "demographic")
        .when(base.isin(*spec.vitals), "vital sign")
        .when(base.isin(*spec.labs), "lab")
        .otherwise("other")
    )
