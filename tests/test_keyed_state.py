import os

import pytest
from pyspark.sql import functions as F

from tidewatch.plans.event_panel import CONFIG, MEASURES, SPEC
from tidewatch.plans.queries_views import fixture_score
from tidewatch.session import subfolders
from tidewatch.spec import AlertPolicy
from tidewatch.streaming.keyed_state import KeyedState
from tidewatch.streaming.replay import run_available

SCHEMA = "k long, v long"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def seen(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_newest_row_of_each_key_over_compactions(spark, tmp_path):
    state, want = KeyedState(str(tmp_path / "s"), "k", SCHEMA, parts=4, max_logs=3), {}
    for batch in range(12):
        change = {k: 100 * batch + k for k in range(batch, batch + 5)}
        before = seen(state.of(rows(spark, [(k, 0) for k in range(30)]).select("k"), batch))
        assert before == want
        state.put(rows(spark, list(change.items())), batch)
        want |= change
        assert seen(state.all(spark, batch + 1)) == want
    assert len(subfolders(spark, str(tmp_path / "s/base"))) <= 2
    assert len(subfolders(spark, str(tmp_path / "s/log"))) <= 6


def test_a_batch_can_run_again(spark, tmp_path):
    state = KeyedState(str(tmp_path / "s"), "k", SCHEMA, parts=2, max_logs=2)
    for batch in range(7):
        for attempt in (1, 2):
            assert seen(state.all(spark, batch)) == {k: k + 10 * (batch - 1) for k in range(3) if batch}
            state.put(rows(spark, [(k, k + 10 * batch + (1000 if attempt == 1 else 0)) for k in range(3)]), batch)
    assert seen(state.all(spark, 7)) == {k: k + 60 for k in range(3)}


def test_a_small_batch_writes_few_rows(spark, tmp_path):
    state = KeyedState(str(tmp_path / "s"), "k", SCHEMA, parts=8)
    state.put(rows(spark, [(k, k) for k in range(2000)]), 0)
    state.put(rows(spark, [(k, -k) for k in range(20)]), 1)
    assert spark.read.parquet(str(tmp_path / "s/log/batch=1")).count() == 20
    assert subfolders(spark, str(tmp_path / "s/base")) == ["upto=0"]
    got = seen(state.all(spark, 2))
    assert len(got) == 2000 and all(got[k] == (-k if k < 20 else k) for k in got)


def test_expired_rows_leave_with_the_compaction(spark, tmp_path):
    state = KeyedState(str(tmp_path / "s"), "k", SCHEMA, parts=2, max_logs=1)
    state.put(rows(spark, [(k, k) for k in range(10)]), 0, lambda df: df.where("v >= 4"))
    assert seen(state.all(spark, 1)) == {k: k for k in range(4, 10)}


@pytest.mark.parametrize("lateness", [6, None])
def test_state_is_bounded_by_the_stays_under_way(spark, tmp_path, lateness):
    """Stays of 8 hours, one of them beginning each hour, over 60 hours of replay."""
    columns = ["stay_id", "hour_index", *MEASURES, "Age", "Gender"]
    data = [(s, h, *[float(50 + s + h)] * len(MEASURES), 40.0, 1.0, s + h) for s in range(52) for h in range(8)]
    panel = spark.createDataFrame(data, ", ".join(["stay_id long", "hour_index int", *[f"`{c}` double" for c in columns[2:]], "e int"])).cache()
    stays = spark.createDataFrame([("r", s, 8, s) for s in range(52)], "replay_id string, stay_id long, n_hours int, starts int")
    source, steps, mark = (str(tmp_path / n) for n in ("panel", "steps", "checkpoint"))
    sizes = []
    for batch, low in enumerate(range(0, 60, 12)):
        panel.filter((F.col("e") >= low) & (F.col("e") < low + 12)).drop("e").write.mode("append").parquet(source)
        run_available(spark, source, panel.drop("e").schema, stays, steps, mark, fixture_score, AlertPolicy(0.5, 2, 6), CONFIG, SPEC, lateness=lateness)
        table = KeyedState(f"{steps}_state/stays", "stay_id", "stay_id struct<replay_id: string, stay_id: long>")
        bases = subfolders(spark, f"{steps}_state/stays/base")
        sizes.append(spark.read.parquet(*[f"{steps}_state/stays/base/{b}" for b in bases[-1:]]).count() if bases else 0)
    done = spark.read.parquet(steps)
    assert done.filter("kind = 'prediction'").count() == len(data) and done.count() == len(data)
    if lateness:
        assert max(sizes) < 30 and os.path.isdir(f"{steps}_late") and spark.read.parquet(f"{steps}_late").count() == 0
        # the first stay's hours come again long after: late, nothing changes
        panel.filter("stay_id = 0").drop("e").write.mode("append").parquet(source)
        run_available(spark, source, panel.drop("e").schema, stays, steps, mark, fixture_score, AlertPolicy(0.5, 2, 6), CONFIG, SPEC, lateness=lateness)
        assert spark.read.parquet(f"{steps}_late").count() == 8 and spark.read.parquet(steps).count() == len(data)
        assert table.all(spark, 5).count() < 40
