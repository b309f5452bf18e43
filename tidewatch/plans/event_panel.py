"""The ``events`` table as an entity-hour panel.

One panel hour is a six-hour bin of ``ts``; an entity is a user.  Readings are
bin averages per event type, and the grid is dense from a user's first to last
bin.  A user has at most one row per bin, so a group per user is bounded by the
table's time span however many events that user has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions import scoring
from tidewatch.operators.trailing import running_state, valid_for
from tidewatch.session import stored
from tidewatch.spec import HOUR, KEY, FeatureConfig, PanelSpec

BIN_SECONDS = 21600
SPEC = PanelSpec(
    vitals=("view", "click", "purchase"),
    labs=("signup", "error"),
    demographics=("Age", "Gender"),
    administrative=(),
    time_columns=(),
    units={"view": "points", "click": "points", "purchase": "points", "signup": "points", "error": "points",
           "Age": "years", "Gender": "source code (0/1)"},
)
CONFIG = FeatureConfig(feature_set="extended", windows=(3, 6, 12, 24), baseline_deltas=True)
MEASURES = SPEC.clinical
ONSET_LIMIT = 150.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class EventPanel:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def events(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "events")

    @cached_property
    def panel(self) -> DataFrame:
        """Inputs and label per (stay_id, hour_index)."""
        cells = (
            self.events.selectExpr(
                f"user_id as {KEY}", f"floor(unix_timestamp(ts) / {BIN_SECONDS}) as bin", "event_type", "value"
            )
            .groupBy(KEY, "bin")
            .agg(*[F.expr(f"avg(value) filter (where event_type = '{m}') as {m}") for m in MEASURES])
        )
        by_time = f"over (partition by {KEY} order by bin"
        cells = cells.selectExpr(
            "*",
            f"first(bin) {by_time}) as first_bin",
            f"coalesce(lead(bin) {by_time}) - 1, bin) as until",
            f"max(if(error > {ONSET_LIMIT}, 1, 0)) {by_time} rows between unbounded preceding and current row) as label",
        )
        # each cell also emits the empty bins up to the next one
        return cells.selectExpr("*", "explode(sequence(bin, until)) as at").selectExpr(
            KEY,
            f"int(at - first_bin) as {HOUR}",
            f"if({KEY} % 3 = 0, 'B', 'A') as hospital",
            *[f"if(at = bin, {m}, null) as {m}" for m in MEASURES],
            f"double(18 + {KEY} % 72) as Age",
            f"double({KEY} % 2) as Gender",
            "label",
        )

    @cached_property
    def inputs(self) -> DataFrame:
        return self.panel.drop("label")

    @cached_property
    def state(self) -> DataFrame:
        """Panel rows with the running state of each measure."""
        return running_state(self.panel, MEASURES)

    @cached_property
    def latest(self) -> dict[str, Column]:
        return {m: valid_for(m, CONFIG.expiry(m, SPEC)) for m in MEASURES}

    @cached_property
    def scored(self) -> DataFrame:
        """``stay_id, hour_index, hospital, Age, Gender, label, status, score`` of every hour."""
        expiry = {m: CONFIG.expiry(m, SPEC) for m in MEASURES}
        latest = [f"if({HOUR} - `{m}@seen` <= {expiry[m]}, `{m}@cur`, null) as l_{m}" for m in MEASURES]
        ids = [KEY, HOUR, "hospital", "Age", "Gender", "label"]
        rows = self.state.selectExpr(*ids, *latest).select(
            *ids, scoring.status([F.col(f"l_{v}") for v in SPEC.vitals]).alias("status"),
            F.expr("coalesce(l_view, 0) + coalesce(l_click, 0) + coalesce(l_purchase, 0) + coalesce(l_error, 0) as s"),
        )
        return rows.selectExpr(*ids, "status", "if(status = 'scored', round(s / (s + 200), 6), null) as score")

    @cached_property
    def scored_table(self) -> DataFrame:
        """``scored`` as a table, for jobs that read it more than once."""
        return stored(self.scored, "scored")
