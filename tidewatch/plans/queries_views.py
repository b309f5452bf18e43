"""Views at a clock, deduplication, and the streaming replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions import scoring
from tidewatch.operators import drift, labels, views
from tidewatch.plans.catalog import register, rounded
from tidewatch.plans.event_panel import CONFIG, MEASURES, SPEC, EventPanel
from tidewatch.plans.panel_sql import with_info, with_panel, with_scored
from tidewatch.plans.queries_alerts import POLICY, _one, fired, reviews, states, with_machine
from tidewatch.session import stored, work_folder
from tidewatch.spec import HOUR, KEY, feature_version
from tidewatch.streaming.replay import HANDED, hands_on, run_available

CLOCK = 80


def reviewed(p: EventPanel):
    f = fired(p)
    r = f.join(reviews(f), [KEY, "alert_hour"], "left")
    return r.select(KEY, "alert_hour", F.when(F.col("reviewed_at_hour").isNull(), "open").otherwise("acknowledged").alias("review"))


def steps(p: EventPanel):
    s = states(p)
    return s.withColumn("status", F.when(F.col("score").isNull(), "data_unavailable").otherwise("scored"))


@register("patients", with_machine(_one(POLICY), f"""
, m AS (SELECT k.stay_id, k.hour_index, k.state, k.alert, s.score, s.status FROM machine k JOIN scored s USING (stay_id, hour_index)),
v AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY hour_index DESC) AS rn FROM m WHERE hour_index <= {CLOCK}),
a AS (SELECT stay_id, count(*) AS alerts, count(*) FILTER (WHERE stay_id % 3 <> 1) AS open_alerts FROM m
      WHERE alert = 1 AND hour_index <= {CLOCK} GROUP BY 1)
SELECT i.stay_id, least({CLOCK}, n_hours - 1) + 1 AS visible_hours, {CLOCK} < n_hours - 1 AS active,
       {CLOCK} >= n_hours - 1 AS ended, v.hour_index AS latest_hour, v.score AS latest_score, v.status AS latest_status,
       v.state AS policy_state, coalesce(alerts, 0) AS alerts, coalesce(open_alerts, 0) AS open_alerts
FROM info i LEFT JOIN v ON v.stay_id = i.stay_id AND rn = 1 LEFT JOIN a ON a.stay_id = i.stay_id"""))
def patients(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    return views.board(steps(p), reviewed(p), labels.onset(p.scored_table), CLOCK)


@register("timeline", with_panel(" UNION ALL ".join(
    f"SELECT stay_id, hour_index, '{m}' AS variable, printf('%.6g', \"{m}\")::DOUBLE AS value, 'points' AS unit "
    f"FROM panel WHERE \"{m}\" IS NOT NULL AND hour_index <= {CLOCK}" for m in MEASURES)))
def timeline(spark, sf_dir):
    return views.timeline(EventPanel(spark, sf_dir).inputs, CLOCK, spec=SPEC)


@register("freshness", with_info("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT p.stay_id, '{m}' AS variable, max(hour_index) AS last_hour, "
    f"(least({CLOCK}, any_value(n_hours) - 1) - max(hour_index))::BIGINT AS hours_since FROM panel p JOIN info USING (stay_id) "
    f"WHERE \"{m}\" IS NOT NULL AND hour_index <= {CLOCK} GROUP BY 1" for m in MEASURES) + ")"))
def freshness(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    return views.freshness(p.inputs, labels.onset(p.panel), CLOCK, spec=SPEC)


@register("retrospective", with_info(
    "SELECT 'replay-' || stay_id % 2 AS replay_id, stay_id, label_start AS label_start_hour, onset AS onset_proxy_hour, "
    "left_censored FROM info WHERE stay_id % 2 = 1"))
def retrospective(spark, sf_dir):
    """Two replays, one of them still running."""
    facts = labels.onset(EventPanel(spark, sf_dir).panel)
    replays = facts.select(
        F.concat(F.lit("replay-"), (F.col(KEY) % 2).cast("string")).alias("replay_id"), KEY,
        F.when(F.col(KEY) % 2 == 1, "finished").otherwise("playing").alias("status"),
    )
    return views.retrospective(facts, replays)


@register("alerts_list", with_machine(
    _one(POLICY), f"SELECT k.stay_id, k.hour_index AS alert_hour, s.score, k.state, "
    f"CASE WHEN k.stay_id % 3 = 1 AND k.hour_index + 2 <= {CLOCK} THEN 'acknowledged' ELSE 'open' END AS review, "
    f"CASE WHEN k.stay_id % 3 = 1 AND k.hour_index + 2 <= {CLOCK} THEN 'nurse-' || k.stay_id % 4 END AS reviewer, "
    f"CASE WHEN k.stay_id % 3 = 1 AND k.hour_index + 2 <= {CLOCK} THEN k.hour_index + 2 END::INT AS reviewed_at_hour, "
    f"CASE WHEN k.stay_id % 3 = 1 AND k.hour_index + 2 <= {CLOCK} THEN 'seen at ' || (k.hour_index + 2) END AS annotation, "
    f"'fixture-1' AS model_version, '{POLICY.version}' AS policy_version "
    f"FROM machine k JOIN scored s USING (stay_id, hour_index) WHERE k.alert = 1 AND k.hour_index <= {CLOCK}"))
def alerts_list(spark, sf_dir):
    """Alerts with scores, versions, and what reviewers wrote about them by the clock; some reviewed twice."""
    s = steps(EventPanel(spark, sf_dir)).withColumns({"model_version": F.lit("fixture-1"), "policy_version": F.lit(POLICY.version)})
    s = stored(s, "steps")
    late = F.explode(F.array(F.lit(2), F.lit(5)))
    reviews = s.filter((F.col("alert") == 1) & (F.col(KEY) % 3 == 1)).select(KEY, F.col(HOUR).alias("alert_hour"), late.alias("after"))
    at = (F.col("alert_hour") + F.col("after")).cast("int")
    reviews = reviews.select(KEY, "alert_hour", F.concat(F.lit("nurse-"), (F.col(KEY) % 4).cast("string")).alias("reviewer"), at.alias("reviewed_at_hour"),
                             F.concat(F.lit("seen at "), at.cast("string")).alias("annotation"))
    return views.alert_list(s, reviews, CLOCK)


_AUDIT_SQL = """
, m AS (SELECT k.stay_id, k.hour_index, k.alert, s.score FROM machine k JOIN scored s USING (stay_id, hour_index)),
e AS (SELECT hour_index, 'alert_emitted' AS kind, '{"stay_id":' || stay_id || ',"hour":' || hour_index || ',"score":' || score || '}' AS payload
      FROM m WHERE alert = 1
      UNION ALL SELECT hour_index, 'replay_step', '{"hour":' || hour_index || ',"scored":' || count(*) || ',"alerts":'
      || sum(alert) || '}' FROM m GROUP BY 1) """
_NEWEST = "SELECT hour_index, kind, payload FROM e ORDER BY hour_index DESC, kind DESC, payload DESC LIMIT 200"


@register("audit_tail", with_machine(_one(POLICY), _AUDIT_SQL + _NEWEST))
def audit_tail(spark, sf_dir):
    """The newest 200 audit events of a replay over all stays."""
    s = steps(EventPanel(spark, sf_dir)).withColumn("replay_id", F.lit("replay"))
    return views.newest_first(views.audit_events(s), 200, HOUR, "kind", "payload").select(HOUR, "kind", "payload")


@register("score_segments", with_scored(
    ", t AS (SELECT stay_id, hour_index, score, count(*) FILTER (WHERE score IS NULL) OVER (PARTITION BY stay_id "
    "ORDER BY hour_index) AS island FROM scored) SELECT stay_id, min(hour_index) AS first_hour, max(hour_index) AS last_hour, "
    "count(*) AS n FROM t WHERE score IS NOT NULL GROUP BY stay_id, island"))
def score_segments(spark, sf_dir):
    p = EventPanel(spark, sf_dir)
    return views.score_segments(p.scored)


@register("dedupe_predictions", with_scored("SELECT stay_id, hour_index, score, 0 AS attempt FROM scored"))
def dedupe_predictions(spark, sf_dir):
    """Predictions of which a part was written again by a retried step."""
    s = EventPanel(spark, sf_dir).scored.select(KEY, HOUR, "score")
    attempts = F.when(F.col(KEY) % 5 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    retried = s.withColumn("attempt", F.explode(attempts))
    again = retried.withColumn("score", F.when(F.col("attempt") == 1, F.lit(-1.0)).otherwise(F.col("score")))
    return views.first_attempt(again, [KEY, HOUR], "attempt")


@hands_on
def fixture_score(features: DataFrame) -> DataFrame:
    """The panel's score from features; contributions are the readings that it adds up."""
    last = {m: F.coalesce(F.col(f"{m}__last").cast("double"), F.lit(0.0)) for m in ("view", "click", "purchase", "error")}
    s = last["view"] + last["click"] + last["purchase"] + last["error"]
    status = scoring.status([F.col(f"{v}__last") for v in SPEC.vitals])
    top = drift.top_contributions({f"{m}__last": c for m, c in last.items()}, {f"{m}__last": F.col(f"{m}__last") for m in last})
    return features.select(KEY, HOUR, F.when(status == "scored", F.round(s / (s + 200), 6)).alias("score"), status.alias("status"),
                           F.to_json(top).alias("contributions"), *[c for c in features.columns if c == HANDED])


def _panel_and_stays(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The panel and its stays as tables: every arrival and every micro-batch reads them."""
    panel = stored(EventPanel(spark, sf_dir).panel, "panel")
    return panel, stored(labels.onset(panel), "stays")


def replayed(spark, sf_dir) -> str:
    """Replay the panel in three arrivals, each run going on from the checkpoint of the last; the sink's folder."""
    panel, stays = _panel_and_stays(spark, sf_dir)
    root = work_folder(spark, "replay")
    rows = panel.select(KEY, HOUR, *MEASURES, "Age", "Gender")
    stays = stays.select(F.lit("replay").alias("replay_id"), KEY, "n_hours")
    arrivals = [f"{HOUR} < 30", f"{HOUR} >= 30 and {HOUR} < 70", f"{HOUR} >= 70"]
    for arrival in arrivals:
        rows.filter(arrival).write.mode("append").parquet(f"{root}/panel")
        run_available(spark, f"{root}/panel", rows.schema, stays, f"{root}/steps", f"{root}/checkpoint",
                      fixture_score, POLICY, CONFIG, SPEC, model_version="fixture-1")
    return f"{root}/steps"


@register("replay_stream", with_machine(
    _one(POLICY), "SELECT k.stay_id, k.hour_index, s.score, s.status, k.state, k.alert, 'fixture-1' AS model_version, "
    f"'{POLICY.version}' AS policy_version, '{feature_version(CONFIG, SPEC)}' AS feature_schema_version, 64 AS hash_length, 4 AS n_contributions "
    "FROM machine k JOIN scored s USING (stay_id, hour_index)"))
def replay_stream(spark, sf_dir):
    """Every hour as the stream wrote it, with versions, input hash and contributions."""
    done = spark.read.parquet(replayed(spark, sf_dir)).filter("kind = 'prediction'")
    parts = F.from_json("contributions", "array<struct<feature:string,contribution:double,value:double,missing:boolean>>")
    return done.select(KEY, HOUR, rounded("score"), "status", "state", "alert", "model_version", "policy_version", "feature_schema_version",
                       F.length("input_hash").alias("hash_length"), F.size(parts).alias("n_contributions"))


@register("replay_audit", with_machine(_one(POLICY), _AUDIT_SQL + "SELECT hour_index, kind, payload FROM e"))
def replay_audit(spark, sf_dir):
    """All audit events that the stream wrote."""
    return spark.read.parquet(replayed(spark, sf_dir) + "_audit").select(HOUR, "kind", "payload")


#: Event times (6-hour bins of a replay) that end the first two arrivals; rows of some stays between 40 and 50 come with the third.
_FIRST, _SECOND, _LATENESS = 50, 100, 24


@register("replay_late", with_panel(f"""
SELECT * FROM (
  WITH ev AS (SELECT stay_id, hour_index, 24 * (stay_id % 4) + hour_index AS e FROM panel),
  d AS (SELECT *, stay_id % 5 = 0 AND e BETWEEN 40 AND 49 AS delayed FROM ev),
  g AS (SELECT *, max(delayed) OVER (PARTITION BY stay_id) AS holed FROM d),
  b AS (SELECT max(e) - {_LATENESS} AS w FROM d WHERE e < {_FIRST} AND NOT delayed),
  c AS (SELECT max(e) - {_LATENESS} AS w FROM d WHERE e < {_SECOND} AND NOT delayed)
  SELECT stay_id, hour_index, CASE WHEN holed AND e >= {_FIRST} THEN 'gap' ELSE 'prediction' END AS kind, NULL::BIGINT AS watermark FROM g WHERE NOT delayed
  UNION ALL SELECT stay_id, hour_index, 'late', w::BIGINT FROM d, b WHERE e < 20 AND e < w
  UNION ALL SELECT stay_id, hour_index, 'late', w::BIGINT FROM d, c WHERE delayed AND e < w)"""))
def replay_late(spark, sf_dir):
    """A replay of staggered stays with a watermark: early rows come again, and some rows too late, which leaves gaps."""
    panel, stays = _panel_and_stays(spark, sf_dir)
    root = work_folder(spark, "replay")
    starts = 24 * (F.col(KEY) % 4)
    rows = panel.select(KEY, HOUR, *MEASURES, "Age", "Gender").withColumn("e", starts + F.col(HOUR))
    delayed = (F.col(KEY) % 5 == 0) & F.col("e").between(40, 49)
    stays = stays.select(F.lit("replay").alias("replay_id"), KEY, "n_hours", starts.alias("starts"))
    arrivals = [(F.col("e") < _FIRST) & ~delayed, (F.col("e") < 20) | F.col("e").between(_FIRST, _SECOND - 1), (F.col("e") >= _SECOND) | delayed]
    for arrival in arrivals:
        rows.filter(arrival).drop("e").write.mode("append").parquet(f"{root}/panel")
        run_available(spark, f"{root}/panel", rows.drop("e").schema, stays, f"{root}/steps", f"{root}/checkpoint",
                      fixture_score, POLICY, CONFIG, SPEC, lateness=_LATENESS)
    done = spark.read.parquet(f"{root}/steps").select(KEY, HOUR, "kind", F.lit(None).cast("long").alias("watermark"))
    return done.unionByName(spark.read.parquet(f"{root}/steps_late").select(KEY, HOUR, F.lit("late").alias("kind"), "watermark"))
