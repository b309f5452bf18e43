"""Alert policy queries over the scored event panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.naming import policy_version
from tidewatch.operators import alerts, labels, utility
from tidewatch.plans.catalog import register, rounded
from tidewatch.plans.event_panel import EventPanel
from tidewatch.plans.panel_sql import with_info, with_scored
from tidewatch.spec import HOUR, KEY, AlertPolicy

POLICY = AlertPolicy(0.5, consecutive=2, cooldown_h=6)
PLAIN = AlertPolicy(0.5, consecutive=2, cooldown_h=0)


def fired(p: EventPanel, policy: AlertPolicy = POLICY) -> DataFrame:
    return alerts.alert_hours(p.scored_table, policy)


def states(p: EventPanel, policy: AlertPolicy = POLICY) -> DataFrame:
    return alerts.policy_states(p.scored_table, policy)


# --- the state machine hour by hour, as a recursive query ----------------------------

def machine_sql(policies: str) -> str:
    """CTEs ``machine`` (state after each hour) for a CTE ``pol`` of policies."""
    in_cd = "coalesce(n.hour_index < m.until, false)"
    above = "n.score >= m.thr"
    held = "m.state IN ('alerted', 'acknowledged')"
    blocked = f"(m.state IN ('cooldown', 'data_unavailable') AND {in_cd})"
    count = f"(CASE WHEN {above} THEN m.consec + 1 ELSE 0 END)"
    fires = f"(n.score IS NOT NULL AND NOT ({held}) AND NOT {blocked} AND {count} >= m.k)"
    return f""", pol AS ({policies}),
machine AS (
  SELECT s0.stay_id, p.thr, p.k, p.cd, -1 AS hour_index, 'monitoring' AS state, 0 AS consec,
         NULL::INT AS until, 0 AS alert
  FROM (SELECT DISTINCT stay_id FROM scored) s0, pol p
  UNION ALL
  SELECT m.stay_id, m.thr, m.k, m.cd, n.hour_index,
         CASE WHEN n.score IS NULL THEN 'data_unavailable'
              WHEN {held} THEN (CASE WHEN {above} THEN m.state WHEN {in_cd} THEN 'cooldown' ELSE 'monitoring' END)
              WHEN {blocked} THEN 'cooldown'
              WHEN {fires} THEN 'alerted' ELSE 'monitoring' END,
         CASE WHEN n.score IS NULL OR {held} OR {blocked} OR {fires} THEN 0 ELSE {count} END,
         CASE WHEN {fires} THEN (CASE WHEN m.cd > 0 THEN n.hour_index + m.cd END) ELSE m.until END,
         CASE WHEN {fires} THEN 1 ELSE 0 END
  FROM machine m JOIN scored n ON n.stay_id = m.stay_id AND n.hour_index = m.hour_index + 1)"""


def _one(policy: AlertPolicy) -> str:
    return f"SELECT {policy.threshold}::DOUBLE AS thr, {policy.consecutive} AS k, {policy.cooldown_h} AS cd"


def with_machine(policies: str, body: str) -> str:
    return with_info(machine_sql(policies) + " " + body, recursive=True)


@register("policy_states", with_machine(_one(POLICY), "SELECT stay_id, hour_index, state, alert FROM machine WHERE hour_index >= 0"))
def policy_states(spark, sf_dir):
    return states(EventPanel(spark, sf_dir)).drop("score")


@register("alert_hours", with_machine(_one(POLICY), "SELECT stay_id, hour_index AS alert_hour FROM machine WHERE alert = 1"))
def alert_hours(spark, sf_dir):
    return fired(EventPanel(spark, sf_dir))


@register("alert_hours_nocd", with_machine(_one(PLAIN), "SELECT stay_id, hour_index AS alert_hour FROM machine WHERE alert = 1"))
def alert_hours_nocd(spark, sf_dir):
    return fired(EventPanel(spark, sf_dir), PLAIN)


_MATCH = (", al AS (SELECT stay_id, hour_index AS h FROM machine WHERE alert = 1), "
          "mt AS (SELECT i.stay_id, i.n_hours, i.onset, i.septic, i.left_censored, count(h) AS n, "
          "min(h) FILTER (WHERE h >= onset - 12 AND h < onset) AS first_early, "
          "min(h) FILTER (WHERE h BETWEEN onset - 12 AND onset - 6) AS first_warning, "
          "min(h) FILTER (WHERE h BETWEEN onset - 12 AND onset + 3) AS first_match "
          "FROM info i LEFT JOIN al USING (stay_id) GROUP BY ALL) ")


@register("alert_onset_match", with_machine(
    _one(POLICY), _MATCH + "SELECT stay_id, n AS n_alerts, first_early, first_warning, first_match, "
    "onset - first_early AS lead_h FROM mt"))
def alert_onset_match(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    m = alerts.match_onsets(fired(p), labels.onset(p.scored_table))
    return m.select(KEY, "n_alerts", "first_early", "first_warning", "first_match", "lead_h")


_SUMS = """
  count(*) AS stays, count(*) FILTER (WHERE septic AND NOT left_censored) AS n_eval,
  count(*) FILTER (WHERE septic AND left_censored) AS n_cens,
  sum(n_hours)::DOUBLE AS hrs, sum(CASE WHEN septic THEN 0 ELSE n_hours END)::DOUBLE AS hrs_non,
  sum(n)::BIGINT AS n_alerts,
  sum(CASE WHEN NOT septic THEN n WHEN left_censored THEN 0
           WHEN first_match IS NULL THEN n ELSE n - 1 END)::BIGINT AS unmatched,
  sum(CASE WHEN septic THEN 0 ELSE n END)::BIGINT AS false_non,
  sum(CASE WHEN left_censored THEN n ELSE 0 END)::BIGINT AS cens_alerts,
  count(*) FILTER (WHERE onset IS NOT NULL AND first_early IS NOT NULL) AS early,
  count(*) FILTER (WHERE onset IS NOT NULL AND first_warning IS NOT NULL) AS warned,
  count(*) FILTER (WHERE first_match < onset) AS pre, count(*) FILTER (WHERE first_match >= onset) AS late,
  quantile_cont((onset - first_early)::DOUBLE, 0.5) AS lead_med,
  quantile_cont((onset - first_early)::DOUBLE, 0.25) AS lead_lo,
  quantile_cont((onset - first_early)::DOUBLE, 0.75) AS lead_hi"""

_RATES = {
    "alerts_per_100_patient_days": "100 * n_alerts / (hrs / 24)",
    "false_alerts_nonseptic_per_100_patient_days": "100 * false_non / nullif(hrs_non / 24, 0)",
    "early_sensitivity": "early::DOUBLE / nullif(n_eval, 0)",
    "six_hour_warning_rate": "warned::DOUBLE / nullif(n_eval, 0)",
    "lead_time_median_h": "lead_med",
    "alert_precision": "(pre + late)::DOUBLE / nullif(n_alerts - cens_alerts, 0)",
}


@register("alert_metrics", with_machine(
    _one(POLICY), _MATCH + f", z AS (SELECT {_SUMS} FROM mt) SELECT stays, n_eval AS septic_onset_evaluable_stays, "
    "n_cens AS left_censored_positive_stays, round(hrs / 24, 6) AS patient_days, n_alerts AS alerts_emitted, "
    "unmatched AS unmatched_alerts, round(100 * unmatched / (hrs / 24), 6) AS unmatched_per_100_patient_days, "
    "false_non AS false_alerts_nonseptic, cens_alerts AS alerts_in_left_censored_stays, early AS detected_early, "
    "n_eval - early AS missed, lead_lo AS lead_time_q25_h, lead_hi AS lead_time_q75_h, pre AS matched_pre_onset, "
    "late AS matched_late, round(pre::DOUBLE / nullif(n_alerts - cens_alerts, 0), 6) AS alert_precision_pre_onset, "
    + ", ".join(f"round({e}, 6) AS {n}" for n, e in _RATES.items()) + " FROM z"))
def alert_metrics(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    m = alerts.alert_metrics(alerts.match_onsets(fired(p), labels.onset(p.scored_table)))
    whole = {"stays", "septic_onset_evaluable_stays", "left_censored_positive_stays", "alerts_emitted", "unmatched_alerts",
             "false_alerts_nonseptic", "alerts_in_left_censored_stays", "detected_early", "missed", "matched_pre_onset",
             "matched_late"}
    return m.select(*[F.col(c) if c in whole else rounded(c) for c in m.columns])


# --- policy search -------------------------------------------------------------------

_PROBS = utility.even_probs(0.80, 0.9995, 40)
_GRID = (f"SELECT thr, k, cd FROM (SELECT DISTINCT round(unnest(quantile_cont(score, {_PROBS!r})), 6) AS thr FROM scored "
         "WHERE score IS NOT NULL), (VALUES (1), (2), (3)) a(k), (VALUES (0), (6), (12)) b(cd)")
_GRID_ROWS = (", al AS (SELECT stay_id, thr, k, cd, hour_index AS h FROM machine WHERE alert = 1), "
              "mt AS (SELECT i.stay_id, p.thr, p.k, p.cd, i.n_hours, i.onset, i.septic, i.left_censored, count(h) AS n, "
              "min(h) FILTER (WHERE h >= onset - 12 AND h < onset) AS first_early, "
              "min(h) FILTER (WHERE h BETWEEN onset - 12 AND onset - 6) AS first_warning, "
              "min(h) FILTER (WHERE h BETWEEN onset - 12 AND onset + 3) AS first_match "
              "FROM info i CROSS JOIN pol p LEFT JOIN al ON al.stay_id = i.stay_id AND al.thr = p.thr AND al.k = p.k "
              "AND al.cd = p.cd GROUP BY ALL), "
              f"z AS (SELECT thr, k, cd, {_SUMS} FROM mt GROUP BY ALL), "
              "grd AS (SELECT thr AS threshold, k AS consecutive, cd AS cooldown_h, "
              + ", ".join(f"{e} AS {n}" for n, e in _RATES.items()) + " FROM z) ")


def grid(p: EventPanel) -> DataFrame:
    thresholds = utility.as_array(utility.threshold_grid(p.scored_table, _PROBS, digits=6))
    return alerts.policy_grid(p.scored_table, labels.onset(p.scored_table), thresholds)


@register("policy_grid", with_machine(
    _GRID, _GRID_ROWS + "SELECT threshold, consecutive, cooldown_h, 'policy-' || substr(sha256('{\"consecutive\": ' || "
    "consecutive || ', \"cooldown_h\": ' || cooldown_h || ', \"threshold\": ' || "
    "rtrim(printf('%.6f', threshold), '0') || '}'), 1, 10) AS policy_version, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in _RATES) + " FROM grd"))
def policy_grid(spark, sf_dir):
    g = grid(EventPanel(spark, sf_dir))
    version = policy_version(F.col("threshold"), F.col("consecutive"), F.col("cooldown_h"))
    return g.select(*alerts.POLICY, version.alias("policy_version"), *[rounded(n) for n in _RATES])


@register("policy_by_budget", with_machine(
    _GRID, _GRID_ROWS + ", b AS (SELECT unnest([1.0, 2.0, 5.0, 10.0, 20.0])::DOUBLE AS budget), "
    "r AS (SELECT b.budget, grd.*, row_number() OVER (PARTITION BY b.budget ORDER BY early_sensitivity DESC, "
    "coalesce(alert_precision, 0) DESC, threshold, consecutive, cooldown_h) AS rn "
    "FROM b JOIN grd ON grd.alerts_per_100_patient_days <= b.budget) "
    "SELECT b.budget, r.budget IS NOT NULL AS feasible, threshold, consecutive, cooldown_h, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in _RATES) + " FROM b LEFT JOIN r ON r.budget = b.budget AND rn = 1"))
def policy_by_budget(spark, sf_dir):
    best = alerts.best_per_budget(grid(EventPanel(spark, sf_dir)))
    return best.select("budget", "feasible", *alerts.POLICY, *[rounded(n) for n in _RATES])


# --- acknowledgement -----------------------------------------------------------------

def reviews(fired_: DataFrame) -> DataFrame:
    """Simulated reviews: every third user's alerts, one hour later."""
    return fired_.filter(F.col(KEY) % 3 == 1).withColumn("reviewed_at_hour", F.col("alert_hour") + 1)


@register("ack_alerts", with_machine(
    _one(POLICY), ", t AS (SELECT stay_id, hour_index, state, alert, max(CASE WHEN alert = 1 THEN hour_index END) "
    "OVER (PARTITION BY stay_id ORDER BY hour_index) AS mark FROM machine WHERE hour_index >= 0) "
    "SELECT stay_id, hour_index, CASE WHEN state = 'alerted' AND stay_id % 3 = 1 AND hour_index >= mark + 1 "
    "THEN 'acknowledged' ELSE state END AS state, alert FROM t"))
def ack_alerts(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    return alerts.acknowledge(states(p), reviews(fired(p)))


@register("alert_counts", with_machine(
    _one(POLICY), "SELECT count(*) FILTER (WHERE stay_id % 3 <> 1) AS open, count(*) FILTER (WHERE stay_id % 3 = 1) AS "
    "acknowledged, count(*) AS all_alerts FROM machine WHERE alert = 1"))
def alert_counts(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    f = fired(p)
    reviewed = f.join(reviews(f), [KEY, "alert_hour"], "left")
    done = F.col("reviewed_at_hour").isNotNull()
    return reviewed.agg(
        F.count_if(~done).alias("open"), F.count_if(done).alias("acknowledged"), F.count(F.lit(1)).alias("all_alerts")
    )


@register("versions", with_scored(
    f", thr AS (SELECT DISTINCT round(unnest(quantile_cont(score, {_PROBS!r})), 6) AS threshold FROM scored "
    "WHERE score IS NOT NULL) SELECT threshold, 'policy-' || substr(sha256('{\"consecutive\": 1, \"cooldown_h\": 0, "
    "\"threshold\": ' || rtrim(printf('%.6f', threshold), '0') || '}'), 1, 10) AS policy_version FROM thr"))
def versions(spark, sf_dir):
    t = utility.threshold_grid(EventPanel(spark, sf_dir).scored, _PROBS, digits=6)
    return t.select("threshold", policy_version(F.col("threshold"), F.lit(1), F.lit(0)).alias("policy_version"))
