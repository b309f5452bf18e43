import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import bootstrap, labels, metrics, ranking, utility


def cohort(seed=3, n_stays=60):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(n_stays):
        n = int(rng.integers(8, 40))
        y = np.zeros(n, dtype=int)
        if rng.random() < 0.3:
            y[int(rng.integers(0, n)):] = 1
        p = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)
        out += [(f"s{s}", h, int(y[h]), float(p[h])) for h in range(n)]
    return pd.DataFrame(out, columns=["stay_id", "hour_index", "label", "score"])


def auroc(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y == 0
    wins = (p[pos][:, None] > p[neg][None, :]) + 0.5 * (p[pos][:, None] == p[neg][None, :])
    return float((w[pos][:, None] * wins * w[neg][None, :]).sum() / w[pos].sum() / w[neg].sum())


def auprc(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    total, out, last = (w * y).sum(), 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        m = p >= s
        tp = (w * y)[m].sum()
        out += (tp / total - last) * (tp / w[m].sum() if w[m].sum() else 0.0)
        last = tp / total
    return float(out)


@pytest.fixture(scope="module")
def frame():
    return cohort()


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame, "stay_id string, hour_index int, label int, score double").cache()


def test_ranked_metrics_equal_pair_counts(df, frame):
    m = ranking.ranked_metrics(ranking.class_counts(df)).first()
    y, p = frame.label.to_numpy(), frame.score.to_numpy()
    assert m["auroc"] == pytest.approx(auroc(y, p), abs=1e-12)
    assert m["auprc"] == pytest.approx(auprc(y, p), abs=1e-12)


def test_weights_and_one_class(df, frame):
    w = F.pmod(F.hash("stay_id"), F.lit(4))
    m = ranking.ranked_metrics(ranking.class_counts(df, weight=w)).first()
    weights = {r[0]: r[1] for r in df.select("stay_id", w).distinct().collect()}
    v = frame.stay_id.map(weights).to_numpy(dtype=float)
    assert m["auroc"] == pytest.approx(auroc(frame.label.to_numpy(), frame.score.to_numpy(), v), abs=1e-12)
    one = ranking.ranked_metrics(ranking.class_counts(df.filter("label = 0"))).first()
    assert one["auroc"] is None and one["auprc"] is None


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1e-9, 300), rng.normal(1e6, 5, 200), np.repeat(3.25, 100)])
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("one", 7.0), ("one", None)], "k string, v double")
    probs = [0.0, 0.005, 0.37, 0.5, 0.995, 1.0]
    got = {(r["k"], r["q"]): r["value"] for r in ranking.quantiles(df, "v", probs, ["k"]).collect()}
    np.testing.assert_allclose([got["k", q] for q in probs], np.quantile(values, probs), rtol=1e-12)
    assert all(got["one", q] == 7.0 for q in probs)


def test_ordered_index_counts_from_zero(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("stay_id"))
    name = F.col("stay_id")
    rows = ranking.ordered_index(df, [], [F.md5(name), name], "i").withColumn("h", F.md5(name)).collect()
    assert [r["i"] for r in sorted(rows, key=lambda r: r["h"])] == list(range(500))


def test_bootstrap_equals_naive_resampling(df, frame):
    n_boot = 8
    packed = bootstrap.stay_weights(df, n_boot, seed=7).toPandas()
    weights = pd.DataFrame([(r, s, w) for s, x in zip(packed.stay_id, packed.w) for r, w in enumerate(np.frombuffer(x, "<u2"))], columns=["replicate", "stay_id", "weight"])
    assert (weights.groupby("replicate").weight.sum() == frame.stay_id.nunique()).all()
    cells = bootstrap.stay_cells(df)
    got = {r["replicate"]: r for r in bootstrap.ranked_replicates(cells, n_boot, seed=7).collect()}
    rows = df.withColumn("prediction", (F.col("score") > 0.6).cast("int"))
    per_stay = utility.stay_utilities(rows)
    again = {r["replicate"]: r["utility"] for r in bootstrap.utility_replicates(per_stay, n_boot, seed=7).collect()}
    sums = per_stay.toPandas().set_index("stay_id")
    for r in range(n_boot):
        w = weights[weights.replicate == r].set_index("stay_id").weight
        # the resampled frame itself: every drawn stay's rows as often as it was drawn
        copies = pd.concat([frame[frame.stay_id == s] for s, k in w.items() for _ in range(k)])
        y, p = copies.label.to_numpy(), copies.score.to_numpy()
        assert got[r]["auroc"] == pytest.approx(auroc(y, p), abs=1e-12)
        assert got[r]["auprc"] == pytest.approx(auprc(y, p), abs=1e-12)
        s = sums.loc[w.index].mul(w, axis=0).sum()
        assert again[r] == pytest.approx((s.observed - s.inaction) / (s.best - s.inaction), abs=1e-12)


def test_utility_worked_example(spark):
    df = spark.createDataFrame([("s", h, int(h >= 4), int(h >= 2)) for h in range(6)],
                               "stay_id string, hour_index int, label int, prediction int")
    assert utility.stay_utilities(df).first()["observed"] == pytest.approx(3.388888888888889, abs=1e-12)


def test_utility_curve_equals_single_thresholds(df):
    curve = {r["threshold"]: r["utility"] for r in utility.utility_curve(df, [0.5, 0.8, 0.99]).collect()}
    assert curve
    for thr, u in curve.items():
        rows = df.withColumn("prediction", (F.col("score") >= thr).cast("int"))
        assert utility.normalised_utility(utility.stay_utilities(rows)).first()["utility"] == pytest.approx(u, abs=1e-12)


def test_reliability_edges(spark):
    df = spark.createDataFrame([(p, 1) for p in (0.0, 0.1, 0.3, 0.30000000000000004, 1.0)], "score double, label int")
    got = {round(r["bin_lower"], 6): r["n"] for r in metrics.reliability(df).collect()}
    assert got == {0.0: 1, 0.1: 1, 0.2: 1, 0.3: 1, 0.9: 1}


def test_onset_proxy(spark):
    series = {"late": [0, 0, 0, 1, 1], "first": [1, 1, 1], "never": [0, 0, 0, 0]}
    df = spark.createDataFrame([(s, h, v) for s, vs in series.items() for h, v in enumerate(vs)],
                               "stay_id string, hour_index int, label int")
    o = {r["stay_id"]: r for r in labels.onset(df).collect()}
    assert (o["late"]["label_start"], o["late"]["onset"], o["late"]["evaluable"]) == (3, 9, True)
    assert o["first"]["left_censored"] and o["first"]["onset"] is None and not o["first"]["evaluable"]
    assert not o["never"]["septic"] and o["never"]["onset"] is None


def test_incident_labels(spark):
    cases = {"included": (12, 8, 11), "prevalent": (12, 0, 11), "none": (10, None, 9), "early_end": (6, 6, 5)}
    hours = spark.createDataFrame([(s, h) for s, (n, _, _) in cases.items() for h in range(n)], "stay_id string, hour_index int")
    facts = spark.createDataFrame([(s, o, last) for s, (_, o, last) in cases.items()],
                                  "stay_id string, onset int, last_hour int")
    got = {}
    for r in labels.incident_labels(hours, facts).orderBy("hour_index").collect():
        got.setdefault(r["stay_id"], []).append((r["label"], r["at_risk"], r["status"]))
    assert [x[0] for x in got["included"]] == [0, 0, 1, 1, 1, 1, 1, 1, None, None, None, None]
    assert [x[1] for x in got["included"]] == [True] * 8 + [False] * 4
    assert not any(x[1] for x in got["prevalent"]) and {x[2] for x in got["prevalent"]} == {"prevalent_excluded"}
    assert [x[0] for x in got["none"]] == [0] * 4 + [None] * 6
    assert got["early_end"][4][0] == 1


@pytest.mark.parametrize("kind", ["near a billion", "up to 2000"])
def test_ranges_are_even_and_exact(spark, kind):
    """Borders come from the data: no range holds more than a few times its share, and results stay exact."""
    rng = np.random.default_rng(2)
    values = np.unique(1e9 + rng.random(20_000) if kind == "near a billion" else rng.uniform(0, 2000, 20_000))
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "v double, n long").repartition(8)
    shares = [r["count"] for r in ranking.ranged(df, [], [F.col("v")], 16).groupBy("_range").count().collect()]
    assert len(shares) == 16 and max(shares) < 3 * len(values) / 16
    got = {r["v"]: r["before_n"] for r in ranking.prefix_totals(df, [], [F.col("v")], ["n"], parts=16).collect()}
    before = np.concatenate([[0], np.cumsum(np.arange(len(values)) % 3)])
    assert got == {float(v): int(b) for v, b in zip(values, before)}
    probs = [0.1, 0.5, 0.77]
    found = {r["q"]: r["value"] for r in ranking.quantiles(df, "v", probs).collect()}
    np.testing.assert_allclose([found[q] for q in probs], np.quantile(values, probs), rtol=1e-12)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "k string, v double").withColumn("n", F.lit(1).cast("long"))
    assert {(r["k"], r["v"]): r["before_n"] for r in ranking.prefix_totals(df, ["k"], [F.col("v")], ["n"]).collect()} == {(None, 1.0): 0, (None, 2.0): 1, ("a", 5.0): 0}


def test_tied_scores_are_added_up_first(spark):
    """Four scores for all rows, one of them in nearly all: the same replicates whether they are summed before the ranges or in them."""
    rng = np.random.default_rng(17)
    rows = [(f"s{i // 4}", i % 4, float(rng.choice([0.1, 0.1, 0.1, 0.4, 0.7, 0.9])), int(rng.random() < 0.3)) for i in range(1200)]
    df = spark.createDataFrame(rows, "stay_id string, hour_index int, score double, label int").repartition(5)
    cells = bootstrap.stay_cells(df)
    want, got = ({r["replicate"]: (r["auroc"], r["auprc"]) for r in bootstrap.ranked_replicates(cells, 6, seed=3, heavy=h).collect()} for h in (10**6, 20))
    assert want.keys() == got.keys() and len(got) == 6
    for r, pair in want.items():
        assert got[r] == pytest.approx(pair, abs=1e-12)
    marked = bootstrap.tied_sums(cells.withColumn("w", F.lit(bytes(4))), 2, [], heavy=20)
    assert marked.filter("sums is not null").count() == marked.count() == 4


@pytest.mark.parametrize("n", [1, 7, 300, 20000])
def test_wide_quantiles_are_exact(spark, n, monkeypatch):
    monkeypatch.setattr(ranking, "ACCURACY", 50)
    rng = np.random.default_rng(n)
    data = {"a": rng.normal(0, 1, n), "b": np.round(rng.exponential(3, n)), "c": np.where(rng.random(n) < 0.6, np.nan, rng.normal(5, 1, n)), "d": np.full(n, np.nan), "e f": np.full(n, 2.5)}
    frame = pd.DataFrame(data)
    df = spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in frame.itertuples(index=False)], "a double, b double, c double, d double, `e f` double").repartition(3)
    probs = [0.0, 0.005, 0.3, 0.5, 0.95, 1.0]
    got = {(r["feature"], r["q"]): r["value"] for r in ranking.wide_quantiles(df, list(frame), probs).collect()}
    known = [c for c in frame if frame[c].notna().any()]
    assert set(got) == {(c, q) for c in known for q in probs}
    for c in known:
        for q in probs:
            assert got[c, q] == pytest.approx(np.quantile(frame[c].dropna(), q), rel=1e-12), (c, q)
