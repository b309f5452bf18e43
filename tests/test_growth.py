"""Plans and settings that keep large tables out of one place."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import alerts, bootstrap, labels
from tidewatch.plans import queries_models
from tidewatch.plans.event_panel import EventPanel
from tidewatch.session import Scratch, stored
from tidewatch.sources import records
from tidewatch.spec import HOUR, KEY, AlertPolicy


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events of 60 users in six-hour steps, as the queries read them."""
    begin = dt.datetime(2024, 1, 1)
    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(u * 100 + i, begin + dt.timedelta(hours=6 * (i + (u + i) % 3)), u, kinds[(u * 7 + i * i) % 5], float((u * 37 + i * 53) % 290), "{}")
            for u in range(60) for i in range(40)]
    out = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{out}/events.parquet")
    return out


def test_states_of_a_stored_panel_are_joined_by_sorting(spark):
    rows = [(s, h, "scored", 0.1 * ((s + h) % 10)) for s in range(5) for h in range(30)]
    scored = stored(spark.createDataFrame(rows, f"{KEY} long, {HOUR} int, status string, score double"), "scored")
    got = alerts.policy_states(scored, AlertPolicy(0.5, 2, 6))
    fired = got.filter("alert = 1").select(KEY, HOUR, "score")
    assert "strategy=merge" in plan(fired)
    assert got.count() == len(rows) and fired.count() > 0


def test_inputs_and_outcomes_are_joined_by_sorting(spark, events):
    got = entry.queries()["split_tables"](spark, events)
    assert "strategy=merge" in plan(got)
    assert got.count() == got.select(KEY, HOUR).distinct().count() > 60 and got.filter(F.col("label").isNull()).count() == 0


def test_record_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("A", f"p{i:06d}", h, 60.0 + h, 1.0 + h) for i in range(60) for h in range(3)], f"hospital string, record string, {HOUR} int, HR double, ICULOS double")
    records.write_records(rows, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("hospital=A/record=*/part-*"))
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > 4
    assert (tmp_path / "out" / "_SUCCESS").exists()


def test_record_files_in_a_mounted_folder_are_written_without_hadoop_and_alike(spark, tmp_path, monkeypatch):
    """Hadoop starts a program for each new file there; both ways give the same folders and lines, also when added to."""
    names = ["p1", "a=b/c d", "%x{y}", "", None, "\u00e9"]
    rows = [("A", r, h, None if (i + h) % 5 == 0 else f"{r}-{h}|\u00fc") for i, r in enumerate(names) for h in range(4)]
    lines = spark.createDataFrame(rows, f"hospital string, record string, {HOUR} int, value string")
    changed = spark.createDataFrame([("A", "p1", 0, "new"), ("B", "p1", 0, "other")], lines.schema)

    def written(root):
        records.write_lines(lines, str(root))
        first = sorted((str(f.parent.relative_to(root)), f.read_text()) for f in root.glob("*/*/part-*"))
        records.write_lines(changed, str(root), add=True)
        return first, sorted((str(f.parent.relative_to(root)), f.read_text()) for f in root.glob("*/*/part-*"))

    got = written(tmp_path / "own")
    assert not list((tmp_path / "own").glob("*/*/.part-*")) and not list((tmp_path / "own").glob("*/*/_*")) and (tmp_path / "own" / "_SUCCESS").exists()
    monkeypatch.setattr(records, "local_path", lambda spark, path: None)
    want = written(tmp_path / "plain")
    assert list((tmp_path / "plain").glob("*/*/.part-*")) and got == want and len(got[0]) == len(names) and ("hospital=A/record=p1", "new\n") in got[1]


def test_exported_folders_are_listed_by_few_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("A", f"{i:06d}", 0, 60.0, 1.0) for i in range(150)], f"hospital string, record string, {HOUR} int, HR double, ICULOS double")
    records.write_records(rows, str(tmp_path / "out"))
    spark.sparkContext.setJobGroup("listing", "listing")
    files = records.list_exported(spark, str(tmp_path / "out"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(tasks) <= 64
    assert {r["record"] for r in files.select("record").collect()} == {f"{i:06d}" for i in range(150)}  # names stay as they are


def test_bootstrap_ranges_hold_a_bounded_number_of_cells(spark, monkeypatch):
    rows = spark.createDataFrame([(s, h, (s * 31 + h * 17) % 400 / 400, int((s + h) % 3 == 0)) for s in range(40) for h in range(30)], f"{KEY} long, {HOUR} int, score double, label int")
    cells = bootstrap.stay_cells(rows)
    want = {r["replicate"]: (r["auroc"], r["auprc"]) for r in bootstrap.ranked_replicates(cells, 5).collect()}
    sizes, plain = [], bootstrap.ranged

    def seen(*args):
        out = plain(*args)
        sizes.extend(r["count"] for r in out.groupBy("_range").count().collect())
        return out

    monkeypatch.setattr(bootstrap, "ranged", seen)
    monkeypatch.setattr(bootstrap, "RANGE_CELLS", 100)
    got = {r["replicate"]: (r["auroc"], r["auprc"]) for r in bootstrap.ranked_replicates(cells, 5).collect()}
    assert len(sizes) > 5 and max(sizes) < 300
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_features_are_computed_for_the_wanted_splits_only(spark, events, monkeypatch):
    p, seen = EventPanel(spark, events), []
    plain = queries_models.trailing_features
    monkeypatch.setattr(queries_models, "trailing_features", lambda panel, *a, **k: seen.append(panel.select(KEY).distinct().count()) or plain(panel, *a, **k))
    train, valid = queries_models.split_rows(p, "a_train", "a_validation")
    stays = [d.select(KEY).distinct().count() for d in (train, valid)]
    want = {r["split"]: r["count"] for r in queries_models.panel_splits(p).groupBy("split").count().collect()}
    assert stays == [want["a_train"], want["a_validation"]] and seen == [sum(stays)] and seen[0] < 40
    assert "split" not in train.columns and train.columns[:2] == [KEY, HOUR] and train.columns[-1] == "label"


def test_policies_of_short_stays_are_neither_chained_nor_merged(spark, monkeypatch):
    """Stays within one block get their rows where their runs are; stays of several blocks agree with them."""
    rows = [(s, h, "scored", ((s * 7 + h * h) % 11) / 10, int(h > 20 and s % 2)) for s in range(12) for h in range(30 + 9 * (s % 4))]
    scored = stored(spark.createDataFrame(rows, f"{KEY} long, {HOUR} int, status string, score double, label int"), "scored")
    thresholds = F.array(F.lit(0.3), F.lit(0.6))
    facts = stored(labels.onset(scored), "facts")
    plain, seen = alerts.alert_blocks, []

    def blocks(rows, *args, **kw):
        out = plain(rows, *args, **kw)
        seen.append((rows.select(KEY).distinct().count(), "Join" in out._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]))
        return out

    monkeypatch.setattr(alerts, "alert_blocks", blocks)

    def grid(block_hours):
        return sorted(map(str, alerts.policy_grid(scored, facts, thresholds, (1, 2), (0, 6), block_hours=block_hours).collect()))

    want = grid(64)
    assert seen == [(12, False), (0, True)]
    assert want == grid(20) == grid(40) and seen[2:] == [(0, False), (12, True), (6, False), (6, True)]
    assert any("alerts_emitted=0" not in r for r in want)


def test_a_replay_step_stores_and_joins_its_wide_columns_once(spark, events, monkeypatch):
    """No table of features, and contributions and hashes are kept once before the results."""
    written, plain = [], Scratch.stored
    monkeypatch.setattr(Scratch, "stored", lambda self, df: written.append(df.columns) or plain(self, df))
    panels, build = [], EventPanel.panel.func
    monkeypatch.setattr(EventPanel, "panel", property(lambda p: panels.append(1) or build(p)))
    got = entry.queries()["replay_stream"](spark, events)
    assert not [c for c in written if any("__" in n or "@low" in n or n.endswith("24h") for n in c)]
    assert len([c for c in written if "input_hash" in c]) == len([c for c in written if "contributions" in c]) == 3  # one for each arrival
    assert len(panels) == 1 and got.count() == got.select(KEY, HOUR).distinct().count() > 60
    assert got.filter("hash_length = 64 and n_contributions = 4").count() == got.count()
