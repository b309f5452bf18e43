import pytest
from pyspark.sql import functions as F

from tidewatch.operators import views
from tidewatch.spec import PanelSpec

SPEC = PanelSpec(vitals=("a",), labs=("b",), demographics=(), administrative=(), time_columns=(), units={"a": "x", "b": "y"})


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([(1, h, float(h), None if h % 2 else 0.5) for h in range(10)], "stay_id long, hour_index int, a double, b double")


def test_nothing_after_the_clock_is_shown(panel):
    assert views.limit_hour(4) == 4 == views.limit_hour(4, 4) and views.limit_hour(4, 2) == 2
    assert views.timeline(panel, 4, spec=SPEC).agg(F.max("hour_index")).first()[0] == 4
    assert views.timeline(panel, 4, until=2, spec=SPEC).agg(F.max("hour_index")).first()[0] == 2
    stays = panel.select("stay_id", F.lit(10).alias("n_hours")).distinct()
    for ask in (lambda: views.timeline(panel, 4, until=5, spec=SPEC), lambda: views.freshness(panel, stays, 4, until=9, spec=SPEC)):
        with pytest.raises(views.BeyondClock, match="after the clock"):
            ask()
    got = {r["variable"]: r["last_hour"] for r in views.freshness(panel, stays, 5, spec=SPEC).collect()}
    assert got == {"a": 5, "b": 4}


def test_alert_list_shows_reviews_up_to_the_clock(spark):
    steps = spark.createDataFrame([(1, 3, 0.9, "alerted", 1, "m1"), (1, 4, 0.8, "alerted", 0, "m1"), (2, 6, 0.7, "alerted", 1, "m2"), (2, 9, 0.9, "alerted", 1, "m2")],
                                  "stay_id long, hour_index int, score double, state string, alert int, model_version string")
    reviews = spark.createDataFrame([(1, 3, "x", 5, "late"), (1, 3, "y", 4, "first"), (2, 6, "x", 8, "too late")], "stay_id long, alert_hour int, reviewer string, reviewed_at_hour int, annotation string")
    rows = [tuple(r) for r in views.alert_list(steps, reviews, 7).collect()]
    assert rows == [(1, 3, 0.9, "alerted", "acknowledged", "y", 4, "first", "m1"), (2, 6, 0.7, "alerted", "open", None, None, None, "m2")]
    with pytest.raises(views.BeyondClock):
        views.alert_list(steps, reviews, 7, until=8)
