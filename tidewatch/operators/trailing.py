"""Leakage-free trailing features: row t reads rows with hour <= t only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions import clinical
from tidewatch.operators.blocks import BLOCK_HOURS, with_blocks
from tidewatch.spec import HOUR, ICU, KEY, FeatureConfig, PanelSpec, feature_names

LABEL_COLUMNS = frozenset({"SepsisLabel", "label"})

def _over(start: str, end: str = "current row") -> str:
    return f"over (partition by {KEY}, block order by {HOUR} rows between {start} and {end})"


def refuse_labels(df: DataFrame) -> None:
    leaked = sorted(LABEL_COLUMNS & set(df.columns))
    if leaked:
        raise ValueError(f"label columns must stay out of the feature input: {leaked}")


def running_state(
    panel: DataFrame,
    variables: tuple[str, ...],
    frames: dict[str, tuple[str, int]] | None = None,
    block_hours: int = BLOCK_HOURS,
    past: DataFrame | None = None,
    stats: dict[str, tuple[str, str, int]] | None = None,
) -> DataFrame:
    """Per row and variable v: hour and value of the latest observation, the one before
    it, and the first one so far (columns ``v@seen``, ``v@cur``, ``v@prev``, ``v@first``),
    plus trailing ``frames`` {name: (SQL aggregate, rows)} and ``stats`` {name: (variable, statistic, rows)}.

    ``past`` holds these columns per entity for what came before the panel; the panel then has a
    column ``old`` that marks earlier rows which only feed the frames and are not returned.
    """
    frames, stats = frames or {}, stats or {}
    back = max([rows - 1 for *_, rows in (*frames.values(), *stats.values())], default=0)
    rows = with_blocks(panel, block_hours, back=back)
    if past is not None:
        rows = rows.withColumn("halo", F.col("halo") | F.col("old"))
    so_far, before = _over("unbounded preceding"), _over("unbounded preceding", "1 preceding")
    # halo rows feed the trailing frames only; running values belong to the block itself
    own = {v: f"if(halo, null, `{v}`)" for v in variables}
    rows = rows.selectExpr("*", *[f"last({own[v]}, true) {before} as `{v}@before`" for v in variables])
    running = []
    for v in variables:
        seen = f"{own[v]} is not null"
        running += [
            f"last(if({seen}, {HOUR}, null), true) {so_far} as `{v}@seen`",
            f"last({own[v]}, true) {so_far} as `{v}@cur`",
            f"last(if({seen}, `{v}@before`, null), true) {so_far} as `{v}@prev`",
            f"first({own[v]}, true) {so_far} as `{v}@first`",
        ]
    trailing = [f"{agg} {_over(f'{n - 1} preceding')} as `{name}`" for name, (agg, n) in frames.items()]
    kept = [f"`{c}`" for c in panel.columns if c != "old" or past is None]
    closing = f"lead(1) over (partition by {KEY}, block order by {HOUR}) is null as closing"
    if stats:
        trailing.append(f"row_number() over (partition by {KEY}, block order by {HOUR}) as `{PLACE}`")
    rows = rows.selectExpr(*kept, "block", "halo", closing, *running, *trailing)
    if not stats:
        return _carry_over(rows.filter("not halo"), kept, variables, list(frames), past).drop("block", "halo")
    # the windows have put the rows of a block in order and a join by stay and block leaves them so
    known = with_stats(_carry_over(rows, kept, variables, [*frames, PLACE], past), stats)
    return known.filter("not halo").drop("block", "halo", PLACE)


#: Number of a row in its block, from 1.
PLACE = "row@place"

STATE_PARTS = ("seen", "cur", "prev", "first")


def _carry_over(rows, kept, variables, frame_names, past) -> DataFrame:
    """Add what earlier blocks of the same entity know to each block's own state.

    A block's last row, whatever its hour, holds the block's summary: hours may be missing.
    """
    state = [f"`{v}@{part}`" for v in variables for part in STATE_PARTS]
    before = f"over (partition by {KEY} order by block rows between unbounded preceding and 1 preceding)"
    tails = rows.filter("closing and not halo").selectExpr(KEY, "block", *state)
    if past is not None:
        tails = tails.unionByName(past.selectExpr(KEY, "bigint(-1) as block", *state))
    tails = tails.selectExpr("*", *[
        f"if(`{v}@seen` is not null, coalesce(`{v}@prev`, last(`{v}@cur`, true) {before}), null) as `{v}@full`"
        for v in variables
    ])
    carried = {"seen": "last(`{v}@seen`, true)", "cur": "last(`{v}@cur`, true)", "prev": "last(`{v}@full`, true)",
               "first": "first(`{v}@first`, true)"}
    carry = tails.selectExpr(KEY, "block", *[
        f"{expr.format(v=v)} {before} as `{v}@past_{part}`" for v in variables for part, expr in carried.items()
    ])
    merged = []
    for v in variables:
        merged += [
            f"coalesce(`{v}@seen`, `{v}@past_seen`) as `{v}@seen`",
            f"coalesce(`{v}@cur`, `{v}@past_cur`) as `{v}@cur`",
            f"if(`{v}@seen` is not null, coalesce(`{v}@prev`, `{v}@past_cur`), `{v}@past_prev`) as `{v}@prev`",
            f"coalesce(`{v}@past_first`, `{v}@first`) as `{v}@first`",
        ]
    return rows.join(carry, [KEY, "block"], "left").selectExpr(*kept, "block", "halo", *merged, *[f"`{n}`" for n in frame_names])


def with_stats(rows: DataFrame, stats: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Adds trailing ``stats`` {name: (variable, mean, min, max, std or slope, rows)}; a stay's block lies together, in hour order.

    All rows of a batch are worked on together, one step for each row back: Spark's window frames read
    every row of a frame again for each row and statistic.
    """
    used = [PLACE, HOUR, *dict.fromkeys(v for v, _, _ in stats.values())]
    back = max(w for _, _, w in stats.values()) - 1
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[str, pa.Array] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            held = {c: pa.concat_arrays([before[c], batch.column(c)]) if before else batch.column(c) for c in used}
            found = trailing_stats(held, stats, batch.num_rows)
            before = {c: x.slice(max(len(x) - back, 0)) for c, x in held.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(found[n] for n in stats)], names=[*names, *stats])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in stats)]))


def trailing_stats(held: dict[str, pa.Array], stats: dict[str, tuple[str, str, int]], n_rows: int) -> dict[str, pa.Array]:
    """``stats`` of the last ``n_rows`` rows of ``held``; the rows before them only feed the frames."""
    hour, place = (held[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in (HOUR, PLACE))
    size = len(place)
    if ((place[1:] != 1) & (place[1:] != place[:-1] + 1)).any():
        raise ValueError("rows of a stay are out of order")
    place = place[size - n_rows :] - 1  # rows of the block before this one
    widest = max(w for _, _, w in stats.values())

    def steps(x: np.ndarray) -> list[np.ndarray]:
        """The rows' values 0, 1, 2 .. rows back; what lies in another block is anything."""
        padded = np.concatenate([np.zeros(widest, x.dtype), x])
        return [padded[widest + size - n_rows - k : widest + size - k] for k in range(widest)]

    inside, hours = [place >= k for k in range(widest)], [h - hour[size - n_rows :] for h in steps(hour)]
    wanted: dict[str, dict[int, list[tuple[str, str]]]] = {}
    for name, (v, stat, w) in stats.items():
        wanted.setdefault(v, {}).setdefault(w, []).append((stat, name))
    out = {}
    with np.errstate(all="ignore"):
        for v, widths in wanted.items():
            seen = [s & i for s, i in zip(steps(held[v].is_valid().to_numpy(zero_copy_only=False)), inside)]
            raw = steps(held[v].fill_null(0.0).to_numpy(zero_copy_only=False))
            x = [np.where(s, r, 0.0) for s, r in zip(seen, raw)]
            for w, asked in widths.items():
                kinds = {stat for stat, _ in asked}
                n, total = sum(s.astype(np.int64) for s in seen[:w]), np.zeros(n_rows)
                for k in reversed(range(w)):  # oldest first, as a window adds
                    total += x[k]
                mean = total / n
                got = {"mean": (mean, n < 1)}
                if "min" in kinds:
                    got["min"] = np.fmin.reduce([np.where(s, r, np.inf) for s, r in zip(seen[:w], raw)]), n < 1
                if "max" in kinds:
                    got["max"] = np.maximum.reduce([np.where(s, r, -np.inf) for s, r in zip(seen[:w], raw)]), n < 1
                if kinds & {"std", "slope"}:
                    away = [np.where(s, r - mean, 0.0) for s, r in zip(seen[:w], raw)]
                if "std" in kinds:
                    got["std"] = np.sqrt(sum(d * d for d in away) / (n - 1)), n < 2
                if "slope" in kinds:
                    h = [np.where(s, t, 0.0) for s, t in zip(seen[:w], hours)]
                    spread = sum(t * t for t in h) - sum(h) ** 2 / n
                    got["slope"] = sum(d * t for d, t in zip(away, h)) / spread, ~(spread > 1e-9)  # hours are whole
                for stat, name in asked:
                    out[name] = pa.array(got[stat][0], pa.float64(), mask=got[stat][1])
    return out


def valid_for(v: str, expiry: int, value: str = "`{v}@cur`") -> Column:
    """``value`` while the latest observation of ``v`` is at most ``expiry`` hours old."""
    return F.expr(f"if({HOUR} - `{v}@seen` <= {expiry}, {value.format(v=v)}, null)")


def trailing_features(
    panel: DataFrame,
    cfg: FeatureConfig = FeatureConfig(),
    spec: PanelSpec = ICU,
    block_hours: int = BLOCK_HOURS,
    as_float32: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``stay_id, hour_index, *keep`` and the features of ``cfg`` in declared order.

    Fails when it runs if a stay's hours are not contiguous: row frames count hours.
    """
    return features_of(feature_state(panel, cfg, spec, block_hours, keep), cfg, spec, as_float32, keep)


def static_inputs(cfg: FeatureConfig, spec: PanelSpec) -> list[str]:
    names = set(feature_names(cfg, spec))
    return [c for c in (*spec.demographics, *spec.administrative) if c in names]


def feature_state(
    panel: DataFrame, cfg: FeatureConfig, spec: PanelSpec = ICU, block_hours: int = BLOCK_HOURS, keep: tuple[str, ...] = (),
    past: DataFrame | None = None,
) -> DataFrame:
    """The inputs with running state and trailing frames: all that ``features_of`` reads."""
    refuse_labels(panel)
    values = panel.selectExpr(
        KEY, HOUR, *[f"`{c}`" for c in keep], *(["old"] if past is not None else []),
        *[f"double(`{c}`) as `{c}`" for c in (*spec.clinical, *static_inputs(cfg, spec))],
    )
    return running_state(values, spec.clinical, feature_frames(cfg, spec), block_hours, past, stat_frames(cfg, spec))


def stat_frames(cfg: FeatureConfig, spec: PanelSpec) -> dict[str, tuple[str, str, int]]:
    return {f"{v}__{s}_{w}h": (v, s, w) for v in spec.vitals for w in cfg.windows for s in cfg.stats}


def feature_frames(cfg: FeatureConfig, spec: PanelSpec) -> dict[str, tuple[str, int]]:
    frames = {}
    if cfg.extended:
        for group, members in (("vitals", spec.vitals), ("labs", spec.labs)):
            observed = " + ".join(f"double(`{v}` is not null)" for v in members)
            frames[f"{group}__count_{cfg.count_window_h}h"] = (f"sum({observed})", cfg.count_window_h)
    return frames | {"hour@low": (f"min({HOUR})", 2), "hour@rows": ("count(1)", 2)}


def features_of(state: DataFrame, cfg: FeatureConfig, spec: PanelSpec = ICU, as_float32: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    names, frames = feature_names(cfg, spec), feature_frames(cfg, spec) | stat_frames(cfg, spec)
    hour = F.expr(
        f"if({HOUR} - `hour@low` = `hour@rows` - 1, {HOUR}, "
        "raise_error('hour_index must be contiguous within each stay'))"
    ).cast(dict(state.dtypes)[HOUR]).alias(HOUR)

    latest = {v: valid_for(v, cfg.expiry(v, spec)) for v in spec.clinical}
    out: dict[str, Column] = {f"{v}__last": x for v, x in latest.items()}
    out |= {name: F.col(name) for name in frames if name in names}
    for v in spec.labs:
        out[f"{v}__delta"] = valid_for(v, cfg.expiry(v, spec), "`{v}@cur` - `{v}@prev`")
    if spec.has_pressures:
        out["ShockIndex"] = clinical.shock_index(latest["HR"], latest["SBP"])
        out["PulsePressure"] = clinical.pulse_pressure(latest["SBP"], latest["DBP"])
    for v in spec.clinical:
        if cfg.extended:
            out[f"{v}__observed"] = F.expr(f"`{v}` is not null")
            out[f"{v}__hours_since"] = F.expr(f"{HOUR} - `{v}@seen`")
        if cfg.baseline_deltas:
            out[f"{v}__from_first"] = valid_for(v, cfg.expiry(v, spec), "`{v}@cur` - `{v}@first`")
    if cfg.organ_scores:
        out |= clinical.organ_scores(latest)
    out |= {c: F.col(c) for c in static_inputs(cfg, spec)}
    width = "float" if as_float32 else "double"
    return state.select(KEY, hour, *keep, *[out[n].cast(width).alias(n) for n in names])


def latest_features(features: DataFrame, clock: int) -> DataFrame:
    """The newest feature row of every entity at or before ``clock``."""
    rest = [c for c in features.columns if c not in (KEY, HOUR)]
    newest = features.filter(F.col(HOUR) <= clock).groupBy(KEY).agg(
        F.max(HOUR).alias(HOUR), F.max_by(F.struct(*rest), F.col(HOUR)).alias("row")
    )
    return newest.select(KEY, HOUR, "row.*")
