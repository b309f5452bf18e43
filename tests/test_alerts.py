import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts, labels
from tidewatch.spec import AlertPolicy

SCHEMA = "stay_id string, hour_index int, score double, status string"


def rows(series: dict):
    return [(s, h, None if v is None else float(v), "data_unavailable" if v is None else "scored")
            for s, vs in series.items() for h, v in enumerate(vs)]


def by_steps(policy, values):
    """Alerts and states straight from the definition: look back over the run that an hour lies in."""
    high = [v is not None and v >= policy.threshold for v in values]
    last, fired, names = None, [], []
    for h, v in enumerate(values):
        start = h
        while high[h] and start > 0 and high[start - 1]:
            start -= 1
        calm_until = 0 if last is None else last + policy.cooldown_h
        standing = high[h] and last is not None and last >= start
        if high[h] and not standing and h - max(start, calm_until) + 1 >= policy.consecutive:
            fired.append(h)
            last, standing = h, True
        names.append("data_unavailable" if v is None else "alerted" if standing else "cooldown" if h < calm_until else "monitoring")
    return fired, names


def run(spark, series, policy, **kw):
    df = spark.createDataFrame(rows(series), SCHEMA)
    got = {s: [] for s in series}
    for r in alerts.alert_hours(df, policy, **kw).collect():
        got[r["stay_id"]].append(r["alert_hour"])
    return {s: sorted(v) for s, v in got.items()}


def test_worked_examples(spark):
    two = AlertPolicy(0.5, consecutive=2)
    assert run(spark, {"a": [.6, .7, .8, .2, .9, .9], "b": [.9, None, .9, .9]}, two) == {"a": [1, 5], "b": [3]}
    slow = AlertPolicy(0.5, cooldown_h=6)
    assert run(spark, {"a": [.9, .1, .9, .9, .1, .1, .1, .9]}, slow) == {"a": [0, 7]}


def random_series(n, longest, seed):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n):
        size = int(rng.integers(1, longest))
        level = rng.random()
        out[f"s{i}"] = [None if rng.random() < 0.15 else float(v) for v in np.round((rng.random(size) + level) / 2, 3)]
    return out


@pytest.mark.parametrize("policy", [AlertPolicy(0.5, 1, 0), AlertPolicy(0.45, 2, 3), AlertPolicy(0.6, 3, 12)], ids=str)
@pytest.mark.parametrize("blocks", [None, 16], ids=["plain", "blocked"])
def test_runs_equal_the_state_machine(spark, policy, blocks):
    if blocks and policy.cooldown_h + policy.consecutive >= blocks:
        blocks = 20
    series = random_series(60, 90, seed=policy.cooldown_h + 1)
    kw = {} if blocks is None else {"block_hours": blocks}
    assert run(spark, series, policy, **kw) == {s: by_steps(policy, v)[0] for s, v in series.items()}


@pytest.mark.parametrize("kw", [{}, {"block_hours": 16}], ids=["one block", "blocks"])
def test_states_equal_the_state_machine(spark, kw):
    policy = AlertPolicy(0.5, 2, 6)
    series = random_series(40, 80, seed=11)
    df = spark.createDataFrame(rows(series), SCHEMA)
    got = {s: {} for s in series}
    for r in alerts.policy_states(df, policy, **kw).collect():
        got[r["stay_id"]][r["hour_index"]] = r["state"]
    for s, values in series.items():
        assert [got[s][h] for h in range(len(values))] == by_steps(policy, values)[1]


def test_versions(spark):
    from tidewatch.functions.naming import policy_version

    p = AlertPolicy(0.5, 2, 6)
    assert p.version == AlertPolicy(0.5, 2, 6).version != AlertPolicy(0.5, 2, 12).version
    got = spark.range(1).select(policy_version(F.lit(0.5), F.lit(2), F.lit(6))).first()[0]
    assert got == p.version
    with pytest.raises(ValueError):
        AlertPolicy(1.5)


def test_alert_metrics(spark):
    facts = spark.createDataFrame([
        ("s1", 48, 30, True, False), ("s2", 48, 25, True, False), ("s3", 48, 30, True, False),
        ("s4", 96, None, False, False), ("s5", 24, None, True, True),
    ], "stay_id string, n_hours long, onset int, septic boolean, left_censored boolean")
    fired = spark.createDataFrame([("s1", 20), ("s1", 30), ("s3", 32), ("s4", 5), ("s4", 50), ("s5", 1)],
                                  "stay_id string, alert_hour int")
    m = alerts.alert_metrics(alerts.match_onsets(fired, facts)).first()
    assert m["septic_onset_evaluable_stays"] == 3 and m["detected_early"] == 1 and m["missed"] == 2
    assert m["early_sensitivity"] == pytest.approx(1 / 3) and m["six_hour_warning_rate"] == pytest.approx(1 / 3)
    assert m["lead_time_median_h"] == 10 and m["matched_pre_onset"] == 1 and m["matched_late"] == 1
    assert m["false_alerts_nonseptic"] == 2 and m["unmatched_alerts"] == 3 and m["alerts_in_left_censored_stays"] == 1
    assert m["alert_precision"] == pytest.approx(2 / 5)
    assert m["patient_days"] == pytest.approx(264 / 24)
    assert m["alerts_per_100_patient_days"] == pytest.approx(100 * 6 / (264 / 24))


def test_grid_equals_single_policies(spark):
    series = random_series(25, 60, seed=2)
    data = [(*r, 1 if int(r[0][1:]) % 3 == 0 and r[1] >= int(r[0][1:]) else 0) for r in rows(series)]
    df = spark.createDataFrame(data, SCHEMA + ", label int")
    facts = labels.onset(df)
    thresholds = F.array(F.lit(0.55), F.lit(0.7), F.lit(0.99))
    for kw in ({}, {"block_hours": 16}):
        grid = {(r["threshold"], r["consecutive"], r["cooldown_h"]): r
                for r in alerts.policy_grid(df, facts, thresholds, (1, 2), (0, 6), **kw).collect()}
        assert len(grid) == 12
        for key in ((0.55, 2, 6), (0.7, 1, 0), (0.99, 1, 6)):
            single = alerts.alert_metrics(
                alerts.match_onsets(alerts.alert_hours(df, AlertPolicy(*key)), facts)).first()
            for name, value in single.asDict().items():
                assert grid[key][name] == pytest.approx(value), (key, name)


def test_block_length_changes_nothing(spark):
    """Hours may be missing, whole blocks included; states, reviews and segments stay the same."""
    from tidewatch.operators import views

    rng = np.random.default_rng(21)
    rows = []
    for s in range(12):
        hours = sorted(rng.choice(220, rng.integers(30, 200), replace=False).tolist())
        hours = [h for h in hours if not 60 <= h < 60 + 10 * (s % 5)]
        for h in hours:
            x = None if rng.random() < 0.08 else round(float(0.45 + 0.4 * np.sin(h / 9 + s) + rng.normal(0, 0.1)), 3)
            rows.append((f"s{s}", h, x, "data_unavailable" if x is None else "scored"))
    rows += [("gap", h, 0.9 if 20 <= h <= 50 else 0.1, "scored") for h in range(80) if h != 31]
    df = spark.createDataFrame(rows, "stay_id string, hour_index int, score double, status string")
    policy = AlertPolicy(0.5, 2, 3)
    reviews = alerts.alert_hours(df, policy).selectExpr("stay_id", "alert_hour", "alert_hour + 1 as reviewed_at_hour")
    seen = []
    for block in (8, 32, 4096):
        states = alerts.policy_states(df, policy, block_hours=block)
        acked = alerts.acknowledge(states, reviews, block_hours=block)
        seen.append([sorted(map(tuple, x.collect()), key=repr) for x in (states, acked, views.score_segments(df, block_hours=block))])
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == len(rows)
