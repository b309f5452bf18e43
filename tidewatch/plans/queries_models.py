"""Preprocessing statistics, fits and explanations over the event panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.operators import drift, splits
from tidewatch.operators.labels import state_label
from tidewatch.operators.ranking import wide_quantiles
from tidewatch.operators.trailing import trailing_features
from tidewatch.plans import jobs, models
from tidewatch.plans.catalog import register, rounded
from tidewatch.plans.event_panel import CONFIG, MEASURES, SPEC, EventPanel
from tidewatch.plans.jobs import labelled
from tidewatch.plans.panel_sql import with_info, with_latest, with_scored
from tidewatch.plans.queries_data import _SPLIT_SQL, panel_splits
from tidewatch.session import stored, work_folder
from tidewatch.spec import HOUR, KEY, feature_names

LASTS = MEASURES
NAMES = feature_names(CONFIG, SPEC)


def split_rows(p: EventPanel, *names):
    """Labelled feature rows of each named split."""
    placed = stored(panel_splits(p).filter(F.col("split").isin(*names)), "placed")
    panel = stored(p.panel.join(placed.select(KEY), KEY, "left_semi"), "panel")  # features look at a stay's own hours only
    f = trailing_features(panel.drop("label"), CONFIG, SPEC, as_float32=False)
    rows = labelled(f, state_label(panel)).join(placed, KEY)
    rows.write.partitionBy("split").parquet(path := work_folder(p.spark, "rows"))
    read = p.spark.read.schema(rows.schema).parquet(path)  # a split is a folder
    return [read.filter(F.col("split") == n).drop("split") for n in names]


_TRAIN = (_SPLIT_SQL + ", tr AS (SELECT l.* FROM latest l SEMI JOIN sp ON sp.stay_id = l.stay_id AND split = 'a_train') ")


@register("class_balance", with_info(
    _TRAIN + "SELECT sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives, round(avg(label), 6) AS prevalence, "
    "round(sum(1 - label)::DOUBLE / sum(label), 6) AS positive_weight FROM tr"))
def class_balance(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    train = splits.in_split(p.panel, panel_splits(p), "a_train")
    b = models.class_balance(train)
    return b.select("positives", "negatives", rounded("prevalence"), rounded("positive_weight"))


def _train_latest(p: EventPanel):
    rows = p.state.select(KEY, *[p.latest[m].alias(f"{m}__last") for m in LASTS])
    return stored(splits.in_split(rows, panel_splits(p), "a_train"), "train")


@register("clip_bounds", with_info(_TRAIN + " UNION ALL ".join(
    f"SELECT '{m}__last' AS feature, round(quantile_cont(l_{m}, 0.005), 6) AS lower, round(quantile_cont(l_{m}, 0.995), 6) "
    "AS upper FROM tr" for m in LASTS)))
def clip_bounds(spark, sf_dir):
    """Training-only clip quantiles."""
    q = wide_quantiles(_train_latest(EventPanel(spark, sf_dir)), [f"{m}__last" for m in LASTS], [0.005, 0.995])
    at = lambda p: F.max(F.when(F.col("q") == p, F.col("value")))
    return q.groupBy("feature").agg(rounded(at(0.005), name="lower"), rounded(at(0.995), name="upper"))


def _stats_sql(m):
    """DuckDB's greatest/least skip nulls, so the gap is tested first."""
    x = f"CASE WHEN l_{m} IS NULL THEN med ELSE greatest(least(l_{m}, hi), lo) END"
    q = ", ".join(f"quantile_cont(l_{m}, {p}) AS {n}" for n, p in (("lo", 0.005), ("hi", 0.995), ("med", 0.5)))
    return (f"SELECT '{m}__last' AS feature, round(any_value(med), 6) AS median, round(avg({x}), 6) AS mean, "
            f"round(stddev_pop({x}), 6) AS spread FROM tr, (SELECT {q} FROM tr)")


@register("preprocess_stats", with_info(_TRAIN + " UNION ALL ".join(_stats_sql(m) for m in LASTS)))
def preprocess_stats(spark, sf_dir):
    """Training-only medians and moments after clipping and imputation."""
    pre = models.fit_preprocess(_train_latest(EventPanel(spark, sf_dir)), [f"{m}__last" for m in LASTS])
    rows = [(f, pre.median[f], pre.mean[i], pre.spread[i]) for i, f in enumerate(pre.kept)]  # one per feature
    out = spark.createDataFrame(rows, "feature string, median double, mean double, spread double")
    return out.select("feature", rounded("median"), rounded("mean"), rounded("spread"))


# --- explanation with given coefficients --------------------------------------------------

COEF = {"view": 0.8, "click": -0.5, "purchase": 0.3, "signup": -0.2, "error": 1.1}
CENTRE = {"view": 48.0, "click": 50.0, "purchase": 48.0, "signup": 51.0, "error": 49.0}
SCALE = {"view": 45.0, "click": 50.0, "purchase": 47.0, "signup": 52.0, "error": 46.0}
SEEN = {"view": 0.31, "click": 0.17, "purchase": -0.23, "signup": 0.41, "error": -0.37}  # of ``__observed``, around 0.5


def _given(p: EventPanel):
    rows = p.state.select(KEY, HOUR, *[p.latest[m].alias(f"{m}__last") for m in COEF], *[F.col(m).isNotNull().cast("double").alias(f"{m}__observed") for m in COEF])
    named = lambda d: {f"{m}__last": x for m, x in d.items()}
    return rows, drift.contribution_table(rows, named(COEF), named(CENTRE), named(SCALE))


def _contrib_sql(m):
    return f"coalesce({COEF[m]}::DOUBLE * (l_{m} - {CENTRE[m]}::DOUBLE) / {SCALE[m]}::DOUBLE, 0)"


@register("top_contributions", with_latest(
    ", c AS (" + " UNION ALL ".join(
        [f"SELECT stay_id, hour_index, '{m}__last' AS feature, {_contrib_sql(m)} AS contribution, l_{m} AS value FROM latest" for m in COEF]
        + [f"SELECT stay_id, hour_index, '{m}__observed', {SEEN[m]}::DOUBLE * ((CASE WHEN {m} IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE - 0.5) / 0.25, "
           f"(CASE WHEN {m} IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE FROM panel" for m in COEF])
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY stay_id, hour_index ORDER BY abs(contribution) DESC, "
    "feature) AS rank FROM c) SELECT stay_id, hour_index, rank::INT AS rank, feature, round(contribution, 6) AS contribution, "
    "round(value, 6) AS value, value IS NULL AS missing FROM r WHERE rank <= 8"))
def top_contributions(spark, sf_dir):
    """The eight largest of ten contributions of every hour."""
    rows, contributions = _given(EventPanel(spark, sf_dir))
    observed = {f"{m}__observed": w for m, w in SEEN.items()}
    contributions |= drift.contribution_table(rows, observed, dict.fromkeys(observed, 0.5), dict.fromkeys(observed, 0.25))
    top = drift.top_contributions(contributions, {f: F.col(f) for f in contributions}, 8)
    flat = rows.select(KEY, HOUR, F.posexplode(top).alias("at", "c"))
    return flat.select(
        KEY, HOUR, (F.col("at") + 1).alias("rank"), "c.feature", rounded("c.contribution", name="contribution"),
        rounded("c.value", name="value"), "c.missing",
    )


@register("contributions_json", with_latest(
    ", c AS (" + " UNION ALL ".join(
        f"SELECT stay_id, hour_index, '{m}__last' AS feature, {_contrib_sql(m)} AS contribution FROM latest" for m in COEF)
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY stay_id, hour_index ORDER BY abs(contribution) DESC, feature) AS rank "
    "FROM c) SELECT stay_id, hour_index, max(feature) FILTER (WHERE rank = 1) AS first, max(feature) FILTER (WHERE rank = 2) AS second, "
    "2 AS n FROM r GROUP BY 1, 2"))
def contributions_json(spark, sf_dir):
    """The two largest contributions stored as a JSON text and parsed back."""
    rows, contributions = _given(EventPanel(spark, sf_dir))
    top = drift.top_contributions(contributions, {f: F.col(f) for f in contributions}, 2)
    text = rows.select(KEY, HOUR, F.to_json(top).alias("contributions_json"))
    back = F.from_json("contributions_json", "array<struct<feature:string,contribution:double,value:double,missing:boolean>>")
    return text.select(KEY, HOUR, back.alias("c")).select(
        KEY, HOUR, F.col("c")[0]["feature"].alias("first"), F.col("c")[1]["feature"].alias("second"), F.size("c").alias("n")
    )


_IMPORTANCE = ", i AS (" + " UNION ALL ".join(
    f"SELECT '{m}__last' AS feature, avg(abs({_contrib_sql(m)})) AS importance FROM latest" for m in COEF) + ") "


@register("importance", with_latest(
    _IMPORTANCE + "SELECT feature, round(importance, 6) AS importance, round(importance / (SELECT sum(importance) FROM i), 6) "
    "AS share FROM i ORDER BY i.importance DESC LIMIT 3"))
def importance(spark, sf_dir):
    rows, contributions = _given(EventPanel(spark, sf_dir))
    return drift.importance(rows, contributions, 3).select("feature", rounded("importance"), rounded("share"))


@register("family_share", with_latest(
    _IMPORTANCE + "SELECT CASE WHEN feature IN ('signup__last', 'error__last') THEN 'lab' ELSE 'vital sign' END AS family, "
    "round(sum(importance) / (SELECT sum(importance) FROM i), 6) AS share FROM i GROUP BY 1"))
def family_share(spark, sf_dir):
    rows, contributions = _given(EventPanel(spark, sf_dir))
    out = drift.family_share(drift.importance(rows, contributions), SPEC)
    return out.select("family", rounded("share"))


# --- fits -------------------------------------------------------------------------------------
# Fitted numbers have no SQL twin, but much about them does: what the rows are, what a fit with an intercept must give
# on its own rows, and the loss of the constant that boosting starts from.

def facts(spark, values: dict):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in values.items()], "fact string, value double")


def _mean(rows, column):
    return rows.agg(F.avg(column)).first()[0]


_FIT = (_SPLIT_SQL + ", y AS (SELECT split, label FROM panel JOIN sp USING (stay_id)), "
        "n AS (SELECT split, count(*) AS n, avg(label) AS rate, sum(label) AS pos FROM y GROUP BY 1), "
        "tr AS (SELECT * FROM n WHERE split = 'a_train'), va AS (SELECT * FROM n WHERE split = 'a_validation'), ca AS (SELECT * FROM n WHERE split = 'a_calibration') ")
_TREES = {"kind": "trees", "rounds": 6, "step": 0.3, "depth": 3, "patience": 2, "bins": 31}


@register("logistic_trials", with_info(
    _FIT + "SELECT 'train rows' AS fact, n::DOUBLE AS value FROM tr UNION ALL SELECT 'validation rows', n FROM va UNION ALL SELECT 'trials', 3 "
    "UNION ALL SELECT 'ranked by AUPRC', 1 UNION ALL SELECT 'AUPRC within (0, 1]', 3 UNION ALL SELECT 'train mean of the first', round(rate, 4) FROM tr "
    f"UNION ALL SELECT 'features', {len(feature_names(CONFIG, SPEC))}"))
def logistic_trials(spark, sf_dir):
    """Two logistic models and one boosted, ranked by validation AUPRC; an unweighted logistic fit keeps the training rate."""
    train, valid = split_rows(EventPanel(spark, sf_dir), "a_train", "a_validation")
    done = models.run_trials(train, valid, NAMES, [{"c": 0.1}, {"c": 0.01, "balanced": True}, _TREES])
    first = next(t["model"] for t in done if t["position"] == 0)
    auprc = [t["val_auprc"] for t in done]
    return facts(spark, {
        "train rows": train.count(), "validation rows": valid.count(), "trials": len(done), "ranked by AUPRC": auprc == sorted(auprc, reverse=True),
        "AUPRC within (0, 1]": sum(0 < a <= 1 for a in auprc), "train mean of the first": round(_mean(train, first.probability()), 4), "features": len(NAMES),
    })


@register("logistic_score", with_scored(
    "SELECT stay_id, hour_index, status, status = 'scored' AS has_score, true AS in_range FROM scored"))
def logistic_score(spark, sf_dir):
    """Fit, calibrate on its own split, score every hour."""
    p = EventPanel(spark, sf_dir)
    train, cal = split_rows(p, "a_train", "a_calibration")
    model = models.fit_logistic(train, NAMES)
    platt = models.fit_platt(cal.select("label", model.probability().alias("raw")))
    f = trailing_features(p.inputs, CONFIG, SPEC, as_float32=False)
    s = models.score_frame(f, model, platt, CONFIG, SPEC)
    return s.select(KEY, HOUR, "status", F.col("score").isNotNull().alias("has_score"), F.coalesce(F.col("score").between(0, 1), F.lit(True)).alias("in_range"))


@register("calibration_fit", with_info(
    _FIT + "SELECT 'rows' AS fact, n::DOUBLE AS value FROM ca UNION ALL SELECT 'positives', pos FROM ca UNION ALL SELECT 'mean after calibration', round(rate, 4) FROM ca"))
def calibration_fit(spark, sf_dir):
    """Sigmoid calibration on its own split: the calibrated mean is the split's rate of positives."""
    train, cal = split_rows(EventPanel(spark, sf_dir), "a_train", "a_calibration")
    model = models.fit_logistic(train, NAMES)
    raw = stored(cal.select("label", model.probability().alias("raw")), "raw")
    platt = models.fit_platt(raw)
    after = _mean(raw, scoring.calibrated(F.col("raw"), platt["a"], platt["b"]))
    return facts(spark, {"rows": platt["rows"], "positives": platt["positives"], "mean after calibration": round(after, 4)})


_LOSS = "-(va.pos * ln(tr.rate) + (va.n - va.pos) * ln(1 - tr.rate)) / va.n"


@register("tree_bag_score", with_info(
    _FIT + ", te AS (SELECT count(*) AS n FROM scored JOIN sp USING (stay_id) WHERE split = 'a_test'), "
    "ok AS (SELECT count(*) AS n FROM scored JOIN sp USING (stay_id) WHERE split = 'a_test' AND status = 'scored') "
    "SELECT 'start' AS fact, round(ln(tr.rate / (1 - tr.rate)), 6) AS value FROM tr "
    f"UNION ALL SELECT 'loss of the start', round({_LOSS}, 6) FROM tr, va UNION ALL SELECT 'best loss is no larger', 2 UNION ALL SELECT 'stopped early', 2 "
    "UNION ALL SELECT 'scored hours', n FROM ok UNION ALL SELECT 'hours', n FROM te UNION ALL SELECT 'in range', n FROM ok UNION ALL SELECT 'same after loading', n FROM te"))
def tree_bag_score(spark, sf_dir):
    """Two boosted models with early stopping, saved, loaded and averaged on the log-odds."""
    p = EventPanel(spark, sf_dir)
    train, valid = split_rows(p, "a_train", "a_validation")
    params = {k: v for k, v in _TREES.items() if k != "kind"} | {"rounds": 40, "row_fraction": 0.8, "feature_fraction": 0.8}
    bag = models.fit_boosted(train, valid, NAMES, (1, 2), models.BoostParams(**params))
    path = work_folder(spark, "bag")
    models.save_trees(spark, path, bag, CONFIG, SPEC)
    again, _, _ = models.load_trees(spark, path, SPEC)
    f = splits.in_split(trailing_features(p.inputs, CONFIG, SPEC, as_float32=False), panel_splits(p), "a_test")
    one, two = (models.score_frame(f, m, None, CONFIG, SPEC) for m in (bag, again))
    both = one.join(two.select(KEY, HOUR, F.col("score").alias("other")), [KEY, HOUR])
    n = both.agg(F.count(F.lit(1)), F.count("score"), F.count_if(F.col("score").between(0, 1)), F.count_if(F.col("score").eqNullSafe(F.col("other")))).first()
    return facts(spark, {
        "start": round(bag.start, 6), "loss of the start": round(bag.losses[0][0], 6), "best loss is no larger": sum(min(x) <= x[0] for x in bag.losses),
        "stopped early": sum(len(x) <= params["rounds"] for x in bag.losses), "hours": n[0], "scored hours": n[1], "in range": n[2], "same after loading": n[3],
    })


@register("explained", with_info(
    _FIT + f"SELECT 'features' AS fact, {len(feature_names(CONFIG, SPEC))} AS value UNION ALL SELECT 'shares add up', 1 UNION ALL SELECT 'families', 4 "
    "UNION ALL SELECT 'sampled stays', least(50, count(*)) FROM sp WHERE split = 'a_validation'"))
def explained(spark, sf_dir):
    """Importance of the fitted model on a fixed sample of validation stays."""
    train, valid = split_rows(EventPanel(spark, sf_dir), "a_train", "a_validation")
    doc = jobs.explain(valid, models.fit_logistic(train, NAMES), 50, seed=1, spec=SPEC)
    t = doc.agg(F.count(F.lit(1)), F.round(F.sum("share"), 6), F.count_distinct("family"), F.max("stays")).first()
    return facts(spark, {"features": t[0], "shares add up": t[1], "families": t[2], "sampled stays": t[3]})
