import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import splits
from tidewatch.plans import models
from tidewatch.plans.jobs import evaluate, labelled, select_policy
from tidewatch.spec import FeatureConfig, PanelSpec, feature_names


@pytest.fixture(scope="module")
def stays(spark):
    return spark.range(1300).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("stay_id"),
        F.when(F.col("id") < 1000, "A").otherwise("B").alias("hospital"),
        (F.col("id") % 11 == 0).alias("ever_positive"),
    )


def test_splits_are_disjoint_stratified_and_stable(spark, stays):
    s = splits.make_splits(stays, 2019).cache()
    assert s.count() == 1300 and splits.split_overlap(s).count() == 0
    sizes = {(r["split"], r["ever_positive"]): r["count"]
             for r in s.join(stays, "stay_id").groupBy("split", "ever_positive").count().collect()}
    assert {k: v for k, v in sizes.items() if k[1]} == {
        ("a_train", True): 55, ("a_validation", True): 13, ("a_calibration", True): 9, ("a_test", True): 14,
        ("b_external", True): 28}
    digest = splits.split_digest(s)
    splits.verify_splits(splits.make_splits(stays, 2019), digest)
    moved = s.withColumn("split", F.when(F.col("stay_id") == "s5", "a_test").otherwise(F.col("split")))
    if moved.exceptAll(s).count():
        with pytest.raises(ValueError, match="digest"):
            splits.verify_splits(moved, digest)
    assert s.exceptAll(splits.make_splits(stays, 7)).count() > 0
    with pytest.raises(ValueError):
        splits.make_splits(stays, 1, {"a_train": 0.5})


def test_samples(stays):
    a = splits.sample(stays, 20, seed=1).collect()
    assert len({r["stay_id"] for r in a}) == 20 and a == splits.sample(stays, 20, seed=1).collect()
    e = splits.enriched_sample(stays, 40, 0.25, seed=1).collect()
    assert len(e) == 40 and sum(r["ever_positive"] for r in e) == 10


SPEC = PanelSpec(vitals=("a", "b"), labs=("c",), demographics=(), administrative=(), time_columns=(), units={})
CFG = FeatureConfig(windows=(), stats=())
NAMES = feature_names(CFG, SPEC)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(int)
    data = [(f"s{i // 10}", i % 10, float(r[0]), float(r[1]), None if i % 4 == 0 else float(r[2]), None, int(k))
            for i, (r, k) in enumerate(zip(x, y))]
    assert NAMES == ["a__last", "b__last", "c__last", "c__delta"]
    schema = "stay_id string, hour_index int, " + ", ".join(f"`{n}` double" for n in NAMES) + ", label int"
    return spark.createDataFrame(data, schema).cache()


def newton(x, y, c):
    """Penalised logistic regression (intercept free) by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1.0), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        grad = ridge * w + c * z.T @ (p - y)
        hess = np.diag(ridge) + c * (z * (p * (1 - p))[:, None]).T @ z
        w -= np.linalg.solve(hess, grad)
    return w


def test_logistic_equals_newton_on_the_same_design(rows):
    model = models.fit_logistic(rows, NAMES, c=0.1)
    assert model.pre.dropped == ["c__delta"] and model.pre.gaps == ["c__last"]
    frame = rows.orderBy("stay_id", "hour_index").toPandas()
    raw = frame[NAMES[:3]].to_numpy(dtype=float)
    lo, hi, med = (np.nanquantile(raw, q, axis=0) for q in (0.005, 0.995, 0.5))
    x = np.clip(raw, lo, hi)
    x = np.where(np.isnan(x), med, x)
    x = np.column_stack([x, np.isnan(raw[:, 2])])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    want = newton(x, frame.label.to_numpy(), 0.1)
    np.testing.assert_allclose([*model.coef, model.intercept], want, rtol=1e-4, atol=1e-5)
    scored = rows.select("stay_id", "hour_index", model.probability().alias("p")).orderBy("stay_id", "hour_index").toPandas()
    np.testing.assert_allclose(scored.p, 1 / (1 + np.exp(-(x @ want[:-1] + want[-1]))), rtol=1e-4)


@pytest.mark.parametrize("balanced", [False, True])
def test_a_fit_is_at_the_optimum_after_few_passes(spark, rows, monkeypatch, balanced):
    passes, plain = [], models.Packs.total
    monkeypatch.setattr(models.Packs, "total", lambda self, part, size: passes.append(size) or plain(self, part, size))
    monkeypatch.setattr(models, "PACK", 100)  # the last pack of a task is not full
    model = models.fit_logistic(rows.repartition(3), NAMES, c=0.1, balanced=balanced)
    assert len(passes) <= 12
    y = rows.select(model.probability().alias("p"), "label", *[c.alias(f"z{i}") for i, c in enumerate(model.pre.scaled())]).toPandas()
    n, pos = len(y), y.label.sum()
    w = np.where(y.label == 1, n / (2 * pos), n / (2 * (n - pos))) if balanced else np.ones(n)
    assert abs((w * (y.p - y.label)).sum() / n) < 1e-8
    for i, coef in enumerate(model.coef):
        assert abs((w * (y.p - y.label) * y[f"z{i}"]).sum() / n + coef / (0.1 * n)) < 1e-7


def test_a_fit_of_one_class_is_its_constant(rows):
    ones = models.fit_logistic(rows.filter("label = 1"), NAMES)
    assert ones.intercept == float("inf") and not any(ones.coef)


def test_statistics_come_from_training_rows_only(rows):
    wild = rows.withColumn("a__last", F.col("a__last") + 1e6)
    both = rows.withColumn("split", F.lit("train")).unionByName(wild.withColumn("split", F.lit("test")))
    assert models.fit_preprocess(both.filter("split = 'train'"), NAMES) == models.fit_preprocess(rows, NAMES)


def test_platt_and_persistence(spark, rows, tmp_path):
    model = models.fit_logistic(rows, NAMES)
    platt = models.fit_platt(rows.select("label", model.probability().alias("raw")))
    assert platt["rows"] == 600 and platt["a"] > 0.5
    path = str(tmp_path / "model")
    models.save_linear(spark, path, model, CFG, SPEC, calibration=platt)
    again, cfg, doc = models.load_linear(spark, path, SPEC)
    assert again == model and cfg == CFG and doc["calibration"]["a"] == platt["a"]
    with pytest.raises(models.ContractError):
        models.load_linear(spark, path, PanelSpec(vitals=("a",), labs=("c",), demographics=(), administrative=(), units={}))
    features = rows.drop("label")
    s = models.score_frame(features, model, platt, CFG, SPEC)
    assert s.filter("score is null").count() == 0
    with pytest.raises(models.ContractError):
        models.score_frame(features.select("stay_id", "hour_index", *reversed(NAMES)), model, platt, CFG, SPEC)


def test_label_join_is_one_to_one(spark, rows):
    f = rows.drop("label")
    outcomes = rows.select("stay_id", "hour_index", "label")
    assert labelled(f, outcomes).exceptAll(rows.select(*f.columns, "label")).count() == 0
    for broken in (outcomes.filter("hour_index > 0"), outcomes.unionByName(outcomes.limit(1))):
        with pytest.raises(Exception, match="label"):
            labelled(f, broken).collect()


def test_policy_selection_and_evaluation(spark):
    rng = np.random.default_rng(4)
    data = []
    for s in range(40):
        start = int(rng.integers(10, 30)) if s % 3 == 0 else None
        for h in range(40):
            y = int(start is not None and h >= start)
            data.append((f"s{s}", h, y, float(np.round(min(1, max(0, 0.3 * y + 0.5 * rng.random())), 3)), "scored"))
    df = spark.createDataFrame(data, "stay_id string, hour_index int, label int, score double, status string").cache()
    demo = df.select("stay_id").distinct().select("stay_id", F.lit(70.0).alias("Age"), F.lit(1.0).alias("Gender"))
    chosen = select_policy(df, budgets=(5, 50), primary=50, consecutive=(1, 2), cooldowns=(0, 6))
    assert chosen["by_budget"][50.0]["alerts_per_100_patient_days"] <= 50
    doc = evaluate(df, demo, chosen["policy"], chosen["benchmark_threshold"], "r1", "a_test", n_boot=5).collect()
    value = {(r["part"], r["metric"]): r["value"] for r in doc}
    assert value["benchmark", "utility"] == pytest.approx(chosen["utility"], abs=1e-9)
    assert value["hourly", "rows_scored"] == 1600 and value["coverage", "coverage"] == 1.0
    assert value["hourly", "auroc_lo"] <= value["hourly", "auroc"] <= value["hourly", "auroc_hi"] + 0.05
    assert ("subgroup age 65-79", "auroc") in value
