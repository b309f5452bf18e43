"""Ranked metrics, utility, calibration and bootstrap queries over the scored event panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import clinical, scoring
from tidewatch.operators import bootstrap, drift, metrics, ranking, utility
from tidewatch.operators.quality import coverage, first_known
from tidewatch.plans.catalog import register, rounded
from tidewatch.plans.event_panel import CONFIG, MEASURES, SPEC, EventPanel, table
from tidewatch.plans.panel_sql import with_info, with_latest, with_panel, with_scored
from tidewatch.plans.queries_features import _CLINICAL, _RULE_SQL, stand_ins
from tidewatch.operators.trailing import trailing_features
from tidewatch.spec import HOUR, KEY, AlertPolicy

ALARM_AT = 0.5
N_BOOT, GROUP_BOOT = 200, 100


def scored(spark, sf_dir):
    return EventPanel(spark, sf_dir).scored


def predicted(spark, sf_dir):
    return metrics.predictions(scored(spark, sf_dir), ALARM_AT)


def scored_table(spark, sf_dir):
    return EventPanel(spark, sf_dir).scored_table


def predicted_table(spark, sf_dir):
    return metrics.predictions(scored_table(spark, sf_dir), ALARM_AT)


# --- status and coverage -----------------------------------------------------------

@register("status", with_scored("SELECT stay_id, hour_index, status FROM scored"))
def status(spark, sf_dir):
    return scored(spark, sf_dir).select(KEY, HOUR, "status")


@register("score", with_scored("SELECT stay_id, hour_index, status, score FROM scored"))
def score(spark, sf_dir):
    return scored(spark, sf_dir).select(KEY, HOUR, "status", "score")


@register("predictions", with_scored(
    "SELECT stay_id, hour_index, coalesce(score, 0.0) AS probability, "
    f"CASE WHEN score >= {ALARM_AT} THEN 1 ELSE 0 END AS prediction FROM scored"))
def predictions(spark, sf_dir):
    return predicted(spark, sf_dir).select(KEY, HOUR, "probability", "prediction")


@register("coverage", with_scored(
    "SELECT count(*) AS scheduled_hours, count(score) AS scored_hours, "
    "round(count(score)::DOUBLE / count(*), 6) AS coverage, "
    "count(*) FILTER (WHERE status = 'data_unavailable') AS unavailable_hours FROM scored"))
def coverage_total(spark, sf_dir):
    return coverage(scored(spark, sf_dir)).select(
        "scheduled_hours", "scored_hours", rounded("coverage"),
        F.coalesce(F.col("unavailable_by_reason")["data_unavailable"], F.lit(0)).alias("unavailable_hours"),
    )


@register("coverage_by_hospital", with_scored(
    "SELECT hospital, count(*) AS scheduled_hours, count(score) AS scored_hours, "
    "round(count(score)::DOUBLE / count(*), 6) AS coverage, round(avg(score), 6) AS mean_score "
    "FROM scored GROUP BY 1"))
def coverage_by_hospital(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("hospital").agg(
        F.count(F.lit(1)).alias("scheduled_hours"), F.count("score").alias("scored_hours"),
        rounded(F.count("score") / F.count(F.lit(1)), name="coverage"), rounded(F.avg("score"), name="mean_score"),
    )


# --- ranked metrics ----------------------------------------------------------------

_COUNTS = (", g AS (SELECT score AS sc, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scored "
           "WHERE score IS NOT NULL GROUP BY 1), "
           "c AS (SELECT *, sum(pos) OVER (ORDER BY sc DESC) AS tp, sum(neg) OVER (ORDER BY sc DESC) AS fp, "
           "sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g) ")
_AUROC = "sum(neg * (tp - pos / 2)) / max(p) / max(n)"
_AUPRC = "sum(pos * tp / (tp + fp)) / max(p)"


@register("roc_points", with_scored(_COUNTS + "SELECT sc AS score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM c"))
def roc_points(spark, sf_dir):
    return ranking.roc_points(ranking.class_counts(scored(spark, sf_dir))).select("score", "tp", "fp")


@register("auroc", with_scored(_COUNTS + f"SELECT round({_AUROC}, 6) AS auroc FROM c"))
def auroc(spark, sf_dir):
    return ranking.ranked_metrics(ranking.class_counts(scored(spark, sf_dir))).select(rounded("auroc"))


@register("auprc", with_scored(_COUNTS + f"SELECT round({_AUPRC}, 6) AS auprc FROM c"))
def auprc(spark, sf_dir):
    return ranking.ranked_metrics(ranking.class_counts(scored(spark, sf_dir))).select(rounded("auprc"))


@register("auroc_documents", """
WITH d AS (SELECT l.toxic AS y, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS s FROM labels l JOIN documents d USING (doc_id)),
pairs AS (SELECT avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auroc
          FROM d a, d b WHERE a.y = 1 AND b.y = 0)
SELECT round(auroc, 6) AS auroc, (SELECT count(*) FROM d) AS n FROM pairs""")
def auroc_documents(spark, sf_dir):
    """Second ranked fixture: toxicity against document length (the SQL counts pairs)."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select((F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"), F.col("toxic").alias("label"))
    m = ranking.ranked_metrics(ranking.class_counts(rows))
    return m.select(rounded("auroc"), (F.col("positives") + F.col("negatives")).alias("n"))


@register("brier", with_scored("SELECT round(avg((score - label) ** 2), 6) AS brier FROM scored WHERE score IS NOT NULL"))
def brier(spark, sf_dir):
    return metrics.brier(scored(spark, sf_dir)).select(rounded("brier"))


_EDGES = metrics.bin_edges()
_BIN = " + ".join(f"CASE WHEN score >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in _EDGES[1:-1])
_EDGE_LIST = "[" + ", ".join(f"{e!r}::DOUBLE" for e in _EDGES) + "]"


@register("reliability", with_scored(
    f", b AS (SELECT {_BIN} AS bin, score, label FROM scored WHERE score IS NOT NULL) "
    f"SELECT {_EDGE_LIST}[bin + 1] AS bin_lower, {_EDGE_LIST}[bin + 2] AS bin_upper, count(*) AS n, "
    "round(avg(score), 6) AS mean_predicted, round(avg(label), 6) AS observed_rate FROM b GROUP BY bin"))
def reliability(spark, sf_dir):
    return metrics.reliability(scored(spark, sf_dir)).select(
        "bin_lower", "bin_upper", "n", rounded("mean_predicted"), rounded("observed_rate")
    )


@register("hourly_metrics", with_scored(
    _COUNTS + f"SELECT sum(pos + neg)::BIGINT AS rows_scored, round(max(p) / (max(p) + max(n)), 6) AS "
    f"positive_hour_prevalence, round({_AUROC}, 6) AS auroc, round({_AUPRC}, 6) AS auprc, "
    "round(sum(pos * (1 - sc) ** 2 + neg * sc ** 2) / sum(pos + neg), 6) AS brier FROM c"))
def hourly(spark, sf_dir):
    m = metrics.hourly_metrics(scored(spark, sf_dir))
    return m.select("rows_scored", *[rounded(c) for c in m.columns if c != "rows_scored"])


@register("confusion", with_scored(
    f", q AS (SELECT label, CASE WHEN score >= {ALARM_AT} THEN 1 ELSE 0 END AS a FROM scored), "
    "k AS (SELECT count(*) FILTER (WHERE label = 1 AND a = 1) AS tp, count(*) FILTER (WHERE label = 0 AND a = 1) AS fp, "
    "count(*) FILTER (WHERE label = 1 AND a = 0) AS fn, count(*) FILTER (WHERE label = 0 AND a = 0) AS tn FROM q) "
    "SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, "
    "round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f_measure FROM k"))
def confusion(spark, sf_dir):
    c = metrics.confusion(predicted(spark, sf_dir))
    return c.select("tp", "fp", "fn", "tn", rounded("accuracy"), rounded("f_measure"))


@register("rule_baselines", _CLINICAL + f", rules AS (SELECT 'partial_qSOFA' AS rule, label, {_RULE_SQL[0]} AS sc FROM c "
          f"UNION ALL SELECT 'partial_SIRS', label, {_RULE_SQL[1]} FROM c), "
          "g AS (SELECT rule, sc, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM rules GROUP BY 1, 2), "
          "k AS (SELECT *, sum(pos) OVER (PARTITION BY rule ORDER BY sc DESC) AS tp, "
          "sum(neg) OVER (PARTITION BY rule ORDER BY sc DESC) AS fp, sum(pos) OVER (PARTITION BY rule) AS p, "
          "sum(neg) OVER (PARTITION BY rule) AS n FROM g) "
          f"SELECT rule, round({_AUROC}, 6) AS auroc, round({_AUPRC}, 6) AS auprc FROM k GROUP BY 1")
def rule_baselines(spark, sf_dir):
    """Rule scores joined to the labels of the scored frame."""
    p = EventPanel(spark, sf_dir)
    x = stand_ins(p)
    rules = p.state.select(
        KEY, HOUR,
        F.explode(F.create_map(
            F.lit("partial_qSOFA"), clinical.rule_qsofa(x), F.lit("partial_SIRS"), clinical.rule_sirs(x)
        )).alias("rule", "score"),
    )
    rows = rules.join(p.panel.select(KEY, HOUR, "label"), [KEY, HOUR])
    return ranking.ranked_metrics(ranking.class_counts(rows, ["rule"]), ["rule"]).select(
        "rule", rounded("auroc"), rounded("auprc")
    )


_GROUPS = (", d AS (SELECT *, 'age ' || CASE WHEN \"Age\" < 50 THEN '<50' WHEN \"Age\" < 65 THEN '50-64' "
           "WHEN \"Age\" < 80 THEN '65-79' ELSE '>=80' END AS band, "
           "'Gender=' || \"Gender\"::INT || ' (source code)' AS code FROM scored WHERE score IS NOT NULL), "
           "r AS (SELECT band AS subgroup, stay_id, label, score FROM d UNION ALL SELECT code, stay_id, label, score FROM d), "
           "s AS (SELECT subgroup, count(*) AS stays, sum(septic)::BIGINT AS septic_stays, sum(n)::BIGINT AS rows FROM "
           "(SELECT subgroup, stay_id, max(label) AS septic, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1), "
           "g AS (SELECT subgroup, score AS sc, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM r GROUP BY 1, 2), "
           "c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY subgroup) AS p, "
           "sum(neg) OVER (PARTITION BY subgroup) AS n FROM g WINDOW w AS (PARTITION BY subgroup ORDER BY sc DESC)), "
           f"m AS (SELECT subgroup, round({_AUROC}, 6) AS auroc, round({_AUPRC}, 6) AS auprc FROM c GROUP BY 1) ")


@register("subgroups", with_scored(
    _GROUPS + "SELECT subgroup, stays, septic_stays, rows, auroc, auprc, septic_stays < 30 AS unstable "
    "FROM s JOIN m USING (subgroup)"))
def subgroups(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    demo = p.scored_table.groupBy(KEY).agg(first_known("Age").alias("Age"), first_known("Gender").alias("Gender"))
    out = metrics.subgroup_metrics(p.scored_table, demo)
    return out.select("subgroup", "stays", "septic_stays", "rows", rounded("auroc"), rounded("auprc"), "unstable")


# --- utility -----------------------------------------------------------------------

def _reward_sql(alarm):
    """Reward of one hour written out per case; ts is null for stays that never turn positive."""
    return (f"CASE WHEN ts IS NULL THEN (CASE WHEN {alarm} THEN -0.05 ELSE 0 END) "
            "WHEN t - ts > 3 THEN 0 "
            f"WHEN {alarm} THEN (CASE WHEN t - ts <= -6 THEN greatest((t - ts) / 6.0::DOUBLE + 2, -0.05) "
            "ELSE (t - ts) * -1.0::DOUBLE / 9 + 1.0::DOUBLE / 3 END) "
            "ELSE (CASE WHEN t - ts <= -6 THEN 0 ELSE (t - ts) * -2.0::DOUBLE / 9 - 4.0::DOUBLE / 3 END) END::DOUBLE")


_REWARDS = (", u0 AS (SELECT s.stay_id, s.hour_index AS t, s.score, i.label_start + 6 AS ts FROM scored s "
            "JOIN info i USING (stay_id)), "
            f"u AS (SELECT stay_id, t, score, {_reward_sql('true')} AS u_alarm, {_reward_sql('false')} AS u_silent, "
            f"{_reward_sql('coalesce(t BETWEEN ts - 12 AND ts + 3, false)')} AS u_best, "
            f"{_reward_sql(f'coalesce(score >= {ALARM_AT}, false)')} AS u_observed FROM u0) ")


@register("row_utility", with_info(
    _REWARDS + "SELECT stay_id, t AS hour_index, round(u_alarm, 6) AS u_alarm, round(u_silent, 6) AS u_silent, "
    "round(u_best, 6) AS u_best, round(u_observed, 6) AS u_observed FROM u"))
def row_utility(spark, sf_dir):
    rows = utility.with_rewards(predicted_table(spark, sf_dir), "prediction")
    return rows.select(KEY, HOUR, *[rounded(c) for c in ("u_alarm", "u_silent", "u_best", "u_observed")])


@register("utility", with_info(
    _REWARDS + "SELECT round(sum(u_observed), 6) AS observed, round(sum(u_best), 6) AS best, "
    "round(sum(u_silent), 6) AS inaction, "
    "round((sum(u_observed) - sum(u_silent)) / (sum(u_best) - sum(u_silent)), 6) AS utility FROM u"))
def utility_total(spark, sf_dir):
    u = utility.normalised_utility(utility.stay_utilities(predicted_table(spark, sf_dir)))
    return u.select(*[rounded(c) for c in u.columns])


_PROBS = "[" + ", ".join(repr(q) for q in utility.even_probs(0.5, 0.999, 120)) + "]"
_CURVE = _REWARDS + (
    f", thr AS (SELECT DISTINCT unnest(quantile_cont(score, {_PROBS})) AS threshold FROM u WHERE score IS NOT NULL), "
    "totals AS (SELECT sum(u_best) AS b, sum(u_silent) AS i FROM u), "
    "gains AS (SELECT threshold, sum(u_alarm - u_silent) AS gain FROM thr JOIN u ON u.score >= threshold GROUP BY 1), "
    "curve AS (SELECT threshold, coalesce(gain, 0) / (b - i) AS utility FROM thr LEFT JOIN gains USING (threshold), totals) ")


@register("utility_curve", with_info(
    _CURVE + "SELECT round(threshold, 9) AS threshold, round(utility, 6) AS utility FROM curve"))
def utility_curve(spark, sf_dir):
    return utility.utility_curve(scored_table(spark, sf_dir)).select(rounded("threshold", 9), rounded("utility"))


@register("best_threshold", with_info(
    _CURVE + "SELECT round(threshold, 9) AS threshold, round(utility, 6) AS utility FROM curve "
    "ORDER BY round(curve.utility, 9) DESC, curve.threshold LIMIT 1"))
def best_threshold(spark, sf_dir):
    best = utility.best_threshold(utility.utility_curve(scored_table(spark, sf_dir)))
    return best.select(rounded("threshold", 9), rounded("utility"))


_GRID_PROBS = utility.even_probs(0.80, 0.9995, 40)


@register("threshold_grid", with_scored(
    f"SELECT DISTINCT round(unnest(quantile_cont(score, {_GRID_PROBS!r})), 6) AS threshold FROM scored "
    "WHERE score IS NOT NULL"))
def threshold_grid(spark, sf_dir):
    return utility.threshold_grid(scored(spark, sf_dir), _GRID_PROBS, digits=6)


# --- calibration -------------------------------------------------------------------

@register("calibrate_apply", with_scored(
    ", z AS (SELECT stay_id, hour_index, greatest(1e-7, least(1 - 1e-7, score))::DOUBLE AS p FROM scored "
    "WHERE score IS NOT NULL) SELECT stay_id, hour_index, round(1 / (1 + exp(-(1.3 * ln(p / (1 - p)) - 0.4))), 6) "
    "AS calibrated FROM z"))
def calibrate_apply(spark, sf_dir):
    rows = scored(spark, sf_dir).filter(F.col("score").isNotNull())
    return rows.select(KEY, HOUR, rounded(scoring.calibrated(F.col("score"), 1.3, -0.4), name="calibrated"))


@register("bag_score", with_latest(
    ", m AS (SELECT stay_id, hour_index, (coalesce(l_view, 0) - 40) / 50 AS a, (coalesce(l_click, 0) - 50) / 60 AS b, "
    "(coalesce(l_error, 0) - 45) / 40 AS c FROM latest) "
    "SELECT stay_id, hour_index, round(1 / (1 + exp(-(a + b + c) / 3)), 6) AS score FROM m"))
def bag_score(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    margins = [(F.coalesce(p.latest[m], F.lit(0.0)) - off) / div
               for m, off, div in (("view", 40, 50), ("click", 50, 60), ("error", 45, 40))]
    return p.state.select(KEY, HOUR, rounded(scoring.bagged(margins), name="score"))


# --- bootstrap ---------------------------------------------------------------------

def _weights_sql(source, keys="", n=N_BOOT):
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    on = f"d.{keys} = p.{keys} AND " if keys else ""
    return (f", members AS (SELECT DISTINCT {k}stay_id FROM {source}), "
            f"pos AS (SELECT {k}stay_id, row_number() OVER ({part}ORDER BY md5(stay_id::VARCHAR), stay_id) - 1 AS i, "
            f"count(*) OVER ({part.strip()}) AS size FROM members), "
            f"draws AS (SELECT {k}r, ('0x' || substr(md5('0|' || r || '|' || i), 1, 15))::BIGINT % size AS i "
            f"FROM pos, range({n}) t(r)), "
            f"w AS (SELECT {'d.' + k if keys else ''}d.r, p.stay_id, count(*)::DOUBLE AS weight FROM draws d JOIN pos p "
            f"ON {on}d.i = p.i GROUP BY ALL) ")


_REPLICATES = (", rs AS (SELECT stay_id, label, score FROM scored WHERE score IS NOT NULL)" + _weights_sql("rs")
               + ", g AS (SELECT w.r, rs.score AS sc, sum(label * weight) AS pos, sum((1 - label) * weight) AS neg "
               "FROM rs JOIN w USING (stay_id) GROUP BY 1, 2), "
               "c AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY r) AS p, "
               "sum(neg) OVER (PARTITION BY r) AS n FROM g WINDOW o AS (PARTITION BY r ORDER BY sc DESC)), "
               f"m AS (SELECT r, {_AUROC} AS auroc, {_AUPRC} AS auprc FROM c GROUP BY 1) ")


@register("bootstrap_replicates", with_scored(
    _REPLICATES + "SELECT r::INT AS replicate, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM m"))
def bootstrap_replicates(spark, sf_dir):
    return bootstrap.ranked_replicates(bootstrap.stay_cells(scored(spark, sf_dir)), N_BOOT).select(
        "replicate", rounded("auroc"), rounded("auprc")
    )


@register("bootstrap_ci", with_scored(
    _REPLICATES + "SELECT round(quantile_cont(auroc, 0.025), 6) AS auroc_lo, round(quantile_cont(auroc, 0.975), 6) AS "
    "auroc_hi, round(quantile_cont(auprc, 0.025), 6) AS auprc_lo, round(quantile_cont(auprc, 0.975), 6) AS auprc_hi FROM m"))
def bootstrap_ci(spark, sf_dir):
    ci = bootstrap.ranked_interval(bootstrap.stay_cells(scored(spark, sf_dir)), N_BOOT)
    return ci.select(*[rounded(c) for c in ci.columns])


@register("utility_ci", with_info(
    _REWARDS + ", per AS (SELECT stay_id, sum(u_observed) AS o, sum(u_best) AS b, sum(u_silent) AS i0 FROM u GROUP BY 1)"
    + _weights_sql("per")
    + ", m AS (SELECT r, (sum(o * weight) - sum(i0 * weight)) / (sum(b * weight) - sum(i0 * weight)) AS utility "
    "FROM per JOIN w USING (stay_id) GROUP BY 1) "
    "SELECT round(quantile_cont(utility, 0.025), 6) AS utility_lo, round(quantile_cont(utility, 0.975), 6) AS utility_hi FROM m"))
def utility_ci(spark, sf_dir):
    ci = bootstrap.utility_interval(utility.stay_utilities(predicted_table(spark, sf_dir)), N_BOOT)
    return ci.select(*[rounded(c) for c in ci.columns])


@register("subgroup_ci", with_scored(
    _GROUPS.rstrip() + _weights_sql("r", "subgroup", GROUP_BOOT)
    + ", g2 AS (SELECT w.subgroup, w.r, r.score AS sc, sum(label * weight) AS pos, sum((1 - label) * weight) AS neg "
    "FROM r JOIN w USING (subgroup, stay_id) GROUP BY ALL), "
    "c2 AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY subgroup, r) AS p, "
    "sum(neg) OVER (PARTITION BY subgroup, r) AS n FROM g2 WINDOW o AS (PARTITION BY subgroup, r ORDER BY sc DESC)), "
    f"m2 AS (SELECT subgroup, r, {_AUROC} AS auroc, {_AUPRC} AS auprc FROM c2 GROUP BY ALL) "
    "SELECT subgroup, round(quantile_cont(auroc, 0.025), 6) AS auroc_lo, round(quantile_cont(auroc, 0.975), 6) AS auroc_hi, "
    "round(quantile_cont(auprc, 0.025), 6) AS auprc_lo, round(quantile_cont(auprc, 0.975), 6) AS auprc_hi "
    "FROM m2 GROUP BY 1"))
def subgroup_ci(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    demo = p.scored_table.groupBy(KEY).agg(first_known("Age").alias("Age"), first_known("Gender").alias("Gender"))
    out = metrics.subgroup_metrics(p.scored_table, demo, n_boot=GROUP_BOOT)
    return out.select("subgroup", *[rounded(c) for c in ("auroc_lo", "auroc_hi", "auprc_lo", "auprc_hi")])


# --- the evaluation document -------------------------------------------------------

_DOCUMENT_POLICY = AlertPolicy(0.5, consecutive=2, cooldown_h=6)
_DOC = (_COUNTS + f", doc AS (SELECT 'hourly' AS part, 'rows_scored' AS metric, sum(pos + neg)::DOUBLE AS value FROM c "
        f"UNION ALL SELECT 'hourly', 'auroc', {_AUROC} FROM c UNION ALL SELECT 'hourly', 'auprc', {_AUPRC} FROM c "
        "UNION ALL SELECT 'counts', 'records', count(DISTINCT stay_id) FROM scored "
        "UNION ALL SELECT 'counts', 'fallback_rows', count(*) FILTER (WHERE status <> 'scored') FROM scored "
        "UNION ALL SELECT 'coverage', 'scheduled_hours', count(*) FROM scored UNION ALL SELECT 'coverage', 'scored_hours', count(score) FROM scored "
        "UNION ALL SELECT 'coverage', 'coverage', count(score)::DOUBLE / count(*) FROM scored "
        "UNION ALL SELECT 'unavailable ' || status, 'hours', count(*) FROM scored WHERE status <> 'scored' GROUP BY status "
        f"UNION ALL SELECT 'confusion', 'tp', count(*) FILTER (WHERE label = 1 AND score >= {ALARM_AT}) FROM scored "
        f"UNION ALL SELECT 'confusion', 'fp', count(*) FILTER (WHERE label = 0 AND score >= {ALARM_AT}) FROM scored "
        "UNION ALL SELECT 'look', 'number', 2 "
        f"UNION ALL SELECT 'reliability from ' || (ln // 10) || '.' || (ln % 10), 'n', n FROM (SELECT ({_BIN}) AS ln, count(*) AS n FROM scored "
        "WHERE score IS NOT NULL GROUP BY 1)) SELECT part, metric, round(value::DOUBLE, 6) AS value FROM doc")


@register("evaluation_document", with_scored(_DOC))
def evaluation_document(spark, sf_dir):
    """The second evaluation of a run on all stays: the parts that have a short SQL form."""
    from tidewatch.plans.jobs import evaluate
    from tidewatch.session import work_folder

    p = EventPanel(spark, sf_dir)
    demo = p.scored_table.groupBy(KEY).agg(first_known("Age").alias("Age"), first_known("Gender").alias("Gender"))
    root = work_folder(spark, "evaluation")
    for _ in range(2):
        document = evaluate(p.scored_table, demo, _DOCUMENT_POLICY, ALARM_AT, "run-1", "all", n_boot=0, log=f"{root}/looks", out=root)
    whole = {"counts": None, "coverage": None, "look": None, "hourly": ("rows_scored", "auroc", "auprc"), "confusion": ("tp", "fp")}
    keep = F.col("part").startswith("unavailable ") | (F.col("part").startswith("reliability ") & (F.col("metric") == "n"))
    for part, names in whole.items():
        keep = keep | ((F.col("part") == part) & (F.lit(True) if names is None else F.col("metric").isin(*names)))
    return document.filter(keep).select("part", "metric", rounded("value"))
