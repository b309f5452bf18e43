"""ANSI SQL of the event panel, shared by the oracle queries.

Written from the definitions, with a grid join instead of gap filling and
plain per-entity windows, so that it checks the DataFrame code independently.
"""

from __future__ import annotations

from tidewatch.plans.event_panel import CONFIG, SPEC
from tidewatch.spec import feature_names

MEASURES = ("view", "click", "purchase", "signup", "error")
VITALS, LABS = MEASURES[:3], MEASURES[3:]
EXPIRY = {"view": 6, "click": 6, "purchase": 6, "signup": 48, "error": 48}

_cells = ", ".join(f"avg(value) FILTER (WHERE event_type = '{m}') AS \"{m}\"" for m in MEASURES)
_measures = ", ".join(f'c."{m}"' for m in MEASURES)

PANEL = f"""
cells AS (SELECT user_id, floor(epoch(ts) / 21600)::BIGINT AS b, {_cells} FROM events GROUP BY 1, 2),
spans AS (SELECT user_id, min(b) AS b0, max(b) AS b1 FROM cells GROUP BY 1),
grid AS (SELECT user_id, b0, unnest(range(b0, b1 + 1)) AS b FROM spans),
panel AS (
  SELECT g.user_id AS stay_id, (g.b - g.b0)::INT AS hour_index,
         CASE WHEN g.user_id % 3 = 0 THEN 'B' ELSE 'A' END AS hospital,
         {_measures},
         (18 + g.user_id % 72)::DOUBLE AS "Age", (g.user_id % 2)::DOUBLE AS "Gender",
         CASE WHEN max(CASE WHEN c.error > 150 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY g.user_id ORDER BY g.b) = 1 THEN 1 ELSE 0 END AS label
  FROM grid g LEFT JOIN cells c ON c.user_id = g.user_id AND c.b = g.b)"""

_latest = ", ".join(
    f'last_value("{m}" IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY hour_index '
    f"ROWS BETWEEN {EXPIRY[m]} PRECEDING AND CURRENT ROW) AS l_{m}"
    for m in MEASURES
)
LATEST = PANEL + f""",
latest AS (SELECT stay_id, hour_index, hospital, "Age", "Gender", label, {_latest} FROM panel)"""

SCORED = LATEST + """,
raw AS (SELECT *, coalesce(l_view, 0) + coalesce(l_click, 0) + coalesce(l_purchase, 0) + coalesce(l_error, 0) AS s
        FROM latest),
scored AS (SELECT stay_id, hour_index, hospital, "Age", "Gender", label,
                  CASE WHEN coalesce(l_view, l_click, l_purchase) IS NOT NULL THEN 'scored'
                       ELSE 'data_unavailable' END AS status,
                  CASE WHEN coalesce(l_view, l_click, l_purchase) IS NOT NULL
                       THEN round(s / (s + 200), 6) END AS score
           FROM raw)"""

STAYS = SCORED + """,
stays AS (SELECT stay_id, count(*) AS n_hours, min(hour_index) FILTER (WHERE label = 1) AS label_start
          FROM scored GROUP BY 1),
info AS (SELECT stay_id, n_hours, label_start, label_start IS NOT NULL AS septic,
                coalesce(label_start = 0, false) AS left_censored,
                CASE WHEN label_start > 0 THEN label_start + 6 END AS onset
         FROM stays)"""


# --- every declared feature, from the definitions ---

FEATURES = feature_names(CONFIG, SPEC)


def _trailing_sql(name):
    """A declared feature of the panel as SQL, from the definitions."""
    v, _, what = name.partition("__")
    if name in ("Age", "Gender"):
        return f'p."{name}"'
    if name.endswith("__count_24h"):
        members = {"vitals": SPEC.vitals, "labs": SPEC.labs}[v]
        return f"sum({' + '.join(f'(CASE WHEN p.{m} IS NULL THEN 0 ELSE 1 END)' for m in members)}) OVER w24"
    if what == "last":
        return f"l.l_{v}"
    if what == "observed":
        return f"CASE WHEN p.{v} IS NULL THEN 0.0 ELSE 1.0 END"
    if what == "hours_since":
        return f"p.hour_index - max(CASE WHEN p.{v} IS NOT NULL THEN p.hour_index END) OVER w"
    if what == "from_first":
        return f"l.l_{v} - first_value(p.{v} IGNORE NULLS) OVER w"
    if what == "delta":
        return f"l.l_{v} - l.prev_{v}"
    stat, window = what.split("_")
    fn = {"mean": "avg(p.{v})", "min": "min(p.{v})", "max": "max(p.{v})", "std": "stddev_samp(p.{v})", "slope": "regr_slope(p.{v}, p.hour_index)"}[stat]
    over = f"OVER w{window.removesuffix('h')}"
    value = f"{fn.format(v=v)} {over}"
    return f"CASE WHEN count(p.{v}) {over} > 1 THEN {value} END" if stat == "slope" else value


_WINDOWS = ", ".join(
    [f"w{n} AS (PARTITION BY p.stay_id ORDER BY p.hour_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in CONFIG.windows]
    + ["w AS (PARTITION BY p.stay_id ORDER BY p.hour_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"])
ALL_FEATURES_SQL = (
    ", ranks AS (SELECT *, " + ", ".join(f"count({m}) OVER (PARTITION BY stay_id ORDER BY hour_index) AS c_{m}" for m in SPEC.labs) + " FROM panel)"
    ", seen AS (SELECT stay_id, " + ", ".join(f"c_{m}" for m in SPEC.labs) + ", " + ", ".join(SPEC.labs) + " FROM ranks)"
    + "".join(f", o_{m} AS (SELECT stay_id, c_{m} AS k, {m} AS value FROM seen WHERE {m} IS NOT NULL)" for m in SPEC.labs)
    + ", lp AS (SELECT l.*, " + ", ".join(f"o_{m}.value AS prev_{m}" for m in SPEC.labs) + " FROM latest l JOIN ranks r USING (stay_id, hour_index) "
    + " ".join(f"LEFT JOIN o_{m} ON o_{m}.stay_id = l.stay_id AND o_{m}.k = r.c_{m} - 1" for m in SPEC.labs) + ")"
    ", features AS (SELECT p.stay_id, p.hour_index, p.hospital, "
    + ", ".join(f'({_trailing_sql(c)})::DOUBLE AS "{c}"' for c in FEATURES)
    + f" FROM panel p JOIN lp l USING (stay_id, hour_index) WINDOW {_WINDOWS})")


def with_panel(body: str) -> str:
    return f"WITH {PANEL} {body}"


def with_latest(body: str) -> str:
    return f"WITH {LATEST} {body}"


def with_scored(body: str) -> str:
    return f"WITH {SCORED} {body}"


def with_info(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{STAYS} {body}"
