"""Windowed feature queries over the event panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import clinical
from tidewatch.functions.naming import input_fingerprint
from tidewatch.operators.labels import incident_labels, onset, reward_times, state_label
from tidewatch.operators.trailing import latest_features, trailing_features
from tidewatch.plans.catalog import register, rounded
from tidewatch.plans.event_panel import CONFIG, MEASURES, SPEC, EventPanel
from tidewatch.plans.panel_sql import ALL_FEATURES_SQL, EXPIRY, FEATURES, LABS, VITALS, with_info, with_latest, with_panel
from tidewatch.spec import HOUR, KEY, feature_names

WINDOWS = CONFIG.windows
# slopes such as 7.135 / 16 end exactly on a rounding edge, where engines may differ in the last bit
OFF_EDGE = 3.7e-9
_OVER = "OVER (PARTITION BY stay_id ORDER BY hour_index"


def _features(spark, sf_dir, *names, shift=0.0):
    p = EventPanel(spark, sf_dir)
    f = trailing_features(p.inputs, CONFIG, SPEC, as_float32=False)
    return f.select(KEY, HOUR, *[rounded(F.col(n) + shift, name=n) for n in names])


@register("position", with_panel(
    f"SELECT stay_id, hour_index, row_number() {_OVER}) - 1 AS position FROM panel"))
def position(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    start = p.panel.groupBy(KEY).agg(F.min(HOUR).alias("start"))
    return p.panel.join(start, KEY).select(KEY, HOUR, (F.col(HOUR) - F.col("start")).cast("long").alias("position"))


@register("asof_latest", with_latest(
    "SELECT stay_id, hour_index, " + ", ".join(f'round(l_{m}, 6) AS "{m}__last"' for m in MEASURES) + " FROM latest"))
def asof_latest(spark, sf_dir):
    return _features(spark, sf_dir, *[f"{m}__last" for m in MEASURES])


@register("hours_since", with_panel(
    "SELECT stay_id, hour_index, "
    + ", ".join(f'(hour_index - max(CASE WHEN "{m}" IS NOT NULL THEN hour_index END) {_OVER}))::DOUBLE '
                f'AS "{m}__hours_since"' for m in MEASURES) + " FROM panel"))
def hours_since(spark, sf_dir):
    return _features(spark, sf_dir, *[f"{m}__hours_since" for m in MEASURES])


def _frame(w):
    return f"{_OVER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


_STAT_SQL = {"mean": "avg", "min": "min", "max": "max"}


@register("trailing_stats", with_panel(
    "SELECT stay_id, hour_index, "
    + ", ".join(f'round({fn}("{v}") {_frame(w)}, 6) AS "{v}__{s}_{w}h"'
                for v in VITALS for w in WINDOWS for s, fn in _STAT_SQL.items()) + " FROM panel"))
def trailing_stats(spark, sf_dir):
    return _features(spark, sf_dir, *[f"{v}__{s}_{w}h" for v in SPEC.vitals for w in WINDOWS for s in _STAT_SQL])


@register("trailing_std", with_panel(
    "SELECT stay_id, hour_index, "
    + ", ".join(f'CASE WHEN count("{v}") {_frame(w)} >= 2 THEN round(stddev_samp("{v}") {_frame(w)}, 6) END '
                f'AS "{v}__std_{w}h"' for v in VITALS for w in WINDOWS) + " FROM panel"))
def trailing_std(spark, sf_dir):
    return _features(spark, sf_dir, *[f"{v}__std_{w}h" for v in SPEC.vitals for w in WINDOWS])


@register("trailing_slope", with_panel(
    "SELECT stay_id, hour_index, "
    + ", ".join(f'CASE WHEN count("{v}") {_frame(w)} >= 2 THEN round(regr_slope("{v}", hour_index) {_frame(w)} + {OFF_EDGE}, 6) '
                f'END AS "{v}__slope_{w}h"' for v in VITALS for w in WINDOWS) + " FROM panel"))
def trailing_slope(spark, sf_dir):
    return _features(spark, sf_dir, *[f"{v}__slope_{w}h" for v in SPEC.vitals for w in WINDOWS], shift=OFF_EDGE)


def _obs(m):
    """Observations with their predecessor, then the latest of them per hour (an as-of join)."""
    return (f'o_{m} AS (SELECT stay_id, hour_index AS h, "{m}" - lag("{m}") {_OVER}) AS d '
            f'FROM panel WHERE "{m}" IS NOT NULL)')


@register("lab_delta", with_panel(
    ", " + ", ".join(_obs(m) for m in LABS)
    + " SELECT p.stay_id, p.hour_index, "
    + ", ".join(f'CASE WHEN p.hour_index - o_{m}.h <= {EXPIRY[m]} THEN round(o_{m}.d, 6) END AS "{m}__delta"'
                for m in LABS)
    + " FROM panel p "
    + " ".join(f"ASOF LEFT JOIN o_{m} ON p.stay_id = o_{m}.stay_id AND p.hour_index >= o_{m}.h" for m in LABS)))
def lab_delta(spark, sf_dir):
    return _features(spark, sf_dir, *[f"{m}__delta" for m in SPEC.labs])


@register("observed", with_panel(
    "SELECT stay_id, hour_index, "
    + ", ".join(f'CASE WHEN "{m}" IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS "{m}__observed"' for m in MEASURES)
    + " FROM panel"))
def observed(spark, sf_dir):
    return _features(spark, sf_dir, *[f"{m}__observed" for m in MEASURES])


def _count_sql(ms):
    return " + ".join(f'CASE WHEN "{m}" IS NULL THEN 0 ELSE 1 END' for m in ms)


@register("trailing_counts", with_panel(
    f"SELECT stay_id, hour_index, sum({_count_sql(VITALS)}) {_frame(24)}::DOUBLE AS vitals__count_24h, "
    f"sum({_count_sql(LABS)}) {_frame(24)}::DOUBLE AS labs__count_24h FROM panel"))
def trailing_counts(spark, sf_dir):
    return _features(spark, sf_dir, "vitals__count_24h", "labs__count_24h")


@register("from_first", with_latest(
    ", firsts AS (SELECT stay_id, "
    + ", ".join(f'min(hour_index) FILTER (WHERE "{m}" IS NOT NULL) AS h_{m}, '
                f'arg_min("{m}", hour_index) FILTER (WHERE "{m}" IS NOT NULL) AS f_{m}' for m in MEASURES)
    + " FROM panel GROUP BY 1) SELECT l.stay_id, l.hour_index, "
    + ", ".join(f'CASE WHEN l.hour_index >= f.h_{m} THEN round(l.l_{m} - f.f_{m}, 6) END AS "{m}__from_first"'
                for m in MEASURES)
    + " FROM latest l JOIN firsts f USING (stay_id)"))
def from_first(spark, sf_dir):
    return _features(spark, sf_dir, *[f"{m}__from_first" for m in MEASURES])


@register("feature_frame", with_latest(ALL_FEATURES_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_rows, count(\"{c}\") AS known, round(avg(\"{c}\"::FLOAT::DOUBLE), 4) AS mean FROM features" for c in FEATURES)))
def feature_frame(spark, sf_dir):
    """The whole declared feature frame in float32: known values and mean of every feature."""
    f = trailing_features(EventPanel(spark, sf_dir).inputs, CONFIG, SPEC)
    wide = f.agg(*[F.struct(F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("known"), F.avg(F.col(c).cast("double")).alias("mean")).alias(c) for c in FEATURES])
    return wide.unpivot([], FEATURES, "feature", "s").select("feature", "s.n_rows", "s.known", rounded("s.mean", 4, "mean"))


@register("derived", with_latest(
    "SELECT stay_id, hour_index, CASE WHEN l_click > 0 THEN round(l_view / l_click, 6) END AS \"ShockIndex\", "
    "round(l_click - l_purchase, 6) AS \"PulsePressure\" FROM latest"))
def derived(spark, sf_dir):
    """view, click and purchase stand in for heart rate and the two pressures."""
    p = EventPanel(spark, sf_dir)
    x = p.latest
    return p.state.select(
        KEY, HOUR,
        rounded(clinical.shock_index(x["view"], x["click"]), name="ShockIndex"),
        rounded(clinical.pulse_pressure(x["click"], x["purchase"]), name="PulsePressure"),
    )


# stand-ins for the clinical inputs: variable = offset + measure / divisor
STAND_INS = {
    "Platelets": ("view", 0.25, 0), "Bilirubin_total": ("click", 10, 0), "Creatinine": ("purchase", 20, 0),
    "MAP": ("view", 1, 40), "HR": ("click", 1, 50), "Resp": ("purchase", 4, 10), "Temp": ("signup", 20, 35),
    "SBP": ("error", 1, 60), "O2Sat": ("view", 5, 80), "FiO2": ("click", 50, 0), "WBC": ("signup", 5, 0),
}
_CLINICAL = with_latest(
    ", c AS (SELECT stay_id, hour_index, label, "
    + ", ".join(f'{off} + l_{m} / {div} AS "{v}"' for v, (m, div, off) in STAND_INS.items()) + " FROM latest)")


def stand_ins(p: EventPanel):
    return {v: off + p.latest[m] / div for v, (m, div, off) in STAND_INS.items()}


def _grade_sql(v, cuts, op):
    return f'CASE WHEN "{v}" IS NOT NULL THEN ' + " + ".join(
        f'CASE WHEN "{v}" {op} {c} THEN 1.0 ELSE 0.0 END' for c in cuts) + " END::DOUBLE"


def _known_sql(*pairs):
    inputs = ", ".join(f'"{v}"' for v, _ in pairs)
    return (f"CASE WHEN coalesce({inputs}) IS NOT NULL THEN "
            + " + ".join(f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END" for _, c in pairs) + " END::DOUBLE")


_FEVER = '("Temp" > 38 OR "Temp" < 36)'
_ORGANS = {
    "SOFA_coag": _grade_sql("Platelets", (150, 100, 50, 20), "<"),
    "SOFA_liver": _grade_sql("Bilirubin_total", (1.2, 2.0, 6.0, 12.0), ">="),
    "SOFA_renal": _grade_sql("Creatinine", (1.2, 2.0, 3.5, 5.0), ">="),
    "SOFA_cardio_map": _grade_sql("MAP", (70,), "<"),
}


@register("organ_scores", _CLINICAL + ", o AS (SELECT *, " + ", ".join(f'{e} AS "{n}"' for n, e in _ORGANS.items())
          + ' FROM c) SELECT stay_id, hour_index, "SOFA_coag", "SOFA_liver", "SOFA_renal", "SOFA_cardio_map", '
          + 'CASE WHEN coalesce("SOFA_coag", "SOFA_liver", "SOFA_renal", "SOFA_cardio_map") IS NOT NULL THEN '
          + " + ".join(f'coalesce("{n}", 0)' for n in _ORGANS) + ' END AS "SOFA_partial", ('
          + " + ".join(f'CASE WHEN "{n}" IS NULL THEN 0 ELSE 1 END' for n in _ORGANS)
          + ')::DOUBLE AS "SOFA_components", '
          + 'CASE WHEN "FiO2" BETWEEN 0.21 AND 1.0 THEN round("O2Sat" / "FiO2", 6) END AS "SF_ratio", '
          + _known_sql(("Resp", '"Resp" >= 22'), ("SBP", '"SBP" <= 100')) + ' AS "qSOFA_partial", '
          + _known_sql(("Temp", _FEVER), ("HR", '"HR" > 90'), ("Resp", '"Resp" > 20'),
                       ("WBC", '("WBC" > 12 OR "WBC" < 4)')) + ' AS "SIRS_partial", '
          + _known_sql(("HR", '"HR" > 90'), ("Resp", '"Resp" > 20'), ("Temp", _FEVER), ("MAP", '"MAP" < 65'),
                       ("O2Sat", '"O2Sat" < 92'), ("SBP", '"SBP" < 90')) + " AS abnormal_vitals FROM o")
def organ_scores(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    scores = clinical.organ_scores(stand_ins(p))
    return p.state.select(KEY, HOUR, *[rounded(c, name=n) for n, c in scores.items()])


_RULE_SQL = (
    "(CASE WHEN \"Resp\" >= 22 THEN 1 ELSE 0 END + CASE WHEN \"SBP\" <= 100 THEN 1 ELSE 0 END)::DOUBLE",
    f"(CASE WHEN {_FEVER} THEN 1 ELSE 0 END + CASE WHEN \"HR\" > 90 THEN 1 ELSE 0 END + CASE WHEN \"Resp\" > 20 "
    "THEN 1 ELSE 0 END + CASE WHEN \"WBC\" > 12 OR \"WBC\" < 4 THEN 1 ELSE 0 END)::DOUBLE",
)


@register("rule_scores", _CLINICAL + f"SELECT stay_id, hour_index, {_RULE_SQL[0]} AS partial_qsofa, "
          f"{_RULE_SQL[1]} AS partial_sirs FROM c")
def rule_scores(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    x = stand_ins(p)
    return p.state.select(
        KEY, HOUR, clinical.rule_qsofa(x).alias("partial_qsofa"), clinical.rule_sirs(x).alias("partial_sirs")
    )


CLOCK = 40


@register("latest_features", with_latest(
    f", v AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY hour_index DESC) AS rn FROM latest "
    f"WHERE hour_index <= {CLOCK}) SELECT stay_id, hour_index, "
    + ", ".join(f'round(l_{m}, 6) AS "{m}__last"' for m in MEASURES) + " FROM v WHERE rn = 1"))
def latest_row(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    f = trailing_features(p.inputs, CONFIG, SPEC, as_float32=False)
    newest = latest_features(f.select(KEY, HOUR, *[f"{m}__last" for m in MEASURES]), CLOCK)
    return newest.select(KEY, HOUR, *[rounded(f"{m}__last") for m in MEASURES])


@register("visible_history", with_panel(
    "SELECT stay_id, hour_index, " + ", ".join(f'round("{m}", 6) AS "{m}"' for m in MEASURES)
    + f" FROM panel WHERE hour_index <= {CLOCK}"))
def visible_history(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    return p.inputs.filter(F.col(HOUR) <= CLOCK).select(KEY, HOUR, *[rounded(m) for m in MEASURES])


#: Features whose text form both engines share: whole numbers and readings as they came.
_HASHED = [c for c in FEATURES if c.endswith(("__last", "__observed", "__hours_since")) or c in ("Age", "Gender")]


@register("input_hash", with_latest(ALL_FEATURES_SQL + "SELECT stay_id, hour_index, sha256('{' || concat_ws(',', "
    + ", ".join(f"'\"{c}\":' || \"{c}\"::VARCHAR" for c in _HASHED) + ") || '}') AS input_hash FROM features"))
def input_hash(spark, sf_dir):
    """Fingerprint of each feature row, over the features that have one text form in both engines."""
    f = trailing_features(EventPanel(spark, sf_dir).inputs, CONFIG, SPEC, as_float32=False)
    return f.select(KEY, HOUR, input_fingerprint(_HASHED).alias("input_hash"))


@register("onset", with_info(
    "SELECT stay_id, n_hours, label_start, onset, septic, left_censored, septic AND NOT left_censored AS evaluable "
    "FROM info"))
def onset_facts(spark, sf_dir):
    return onset(EventPanel(spark, sf_dir).panel).drop("first_hour", "last_hour")


@register("state_label", with_panel("SELECT stay_id, hour_index, label::TINYINT AS label FROM panel"))
def target_a(spark, sf_dir):
    return state_label(EventPanel(spark, sf_dir).panel)


@register("sepsis_times", with_info(
    "SELECT s.stay_id, s.hour_index AS t, (i.label_start + 6)::INT AS t_onset FROM scored s JOIN info i USING (stay_id)"))
def sepsis_times(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    return p.panel.join(reward_times(p.panel), KEY).select(
        KEY, (F.col(HOUR) - F.col("first_hour")).alias("t"), F.col("t_onset").cast("int").alias("t_onset")
    )


@register("incident_label", with_info(
    "SELECT s.stay_id, s.hour_index, CASE WHEN i.onset <= s.hour_index THEN NULL "
    "WHEN i.onset BETWEEN s.hour_index + 1 AND s.hour_index + 6 THEN 1 "
    "WHEN s.hour_index + 6 <= i.n_hours - 1 THEN 0 END AS label, "
    "NOT coalesce(i.onset <= s.hour_index, false) AS at_risk, 'included' AS status "
    "FROM scored s JOIN info i USING (stay_id)"))
def incident_label(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    return incident_labels(p.panel, onset(p.panel))
