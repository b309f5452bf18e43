"""Alert policy: threshold, consecutive hours, cooldown.

Rules per hour: an unavailable hour resets everything but the cooldown; after an
alert nothing fires until the score has dropped once; no counting happens while
the cooldown of the last alert runs.

Only *runs* matter: maximal stretches of scored hours at or above the threshold.
A run [s, e] fires at most once, at ``max(s, until) + k - 1`` if that is within
the run, where ``until`` is the end of the cooldown left by the previous alert.
So rows below the threshold are dropped before the shuffle, runs come from
gaps-and-islands in bounded time blocks, and the only state that crosses runs
(and blocks) is ``until``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.operators.blocks import BLOCK_HOURS, with_blocks
from tidewatch.operators.trailing import running_state
from tidewatch.spec import HOUR, KEY, AlertPolicy

# --- fixed values: matching windows in hours from onset ---
MATCH_WINDOWS = {"first_early": (-12, -1), "first_warning": (-12, -6), "first_match": (-12, 3)}
# ----------------------------------------------------------

POLICY = ("threshold", "consecutive", "cooldown_h")


def usable_score() -> Column:
    return F.when(F.col("status") == "scored", F.col("score"))


def runs_above(scored: DataFrame, thresholds: Column, reach: int, block_hours: int,
               carry: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Runs per (stay, threshold, block) as a sorted array of (s, e).

    ``thresholds`` is an ascending array column.  A run belongs to the block of its
    start; its end is exact up to ``reach`` hours beyond that block, which is all
    that the policy can look at.  ``carry`` names columns that are constant per stay.
    With ``tasks`` the rows go to that many tasks however few bytes they are.
    """
    carry = list(carry)
    rows = scored.select(KEY, HOUR, usable_score().alias("score"), *carry)
    rows = rows.filter(F.col("score") >= F.element_at(thresholds, 1))
    rows = with_blocks(rows, block_hours, back=1, ahead=reach)
    group = [KEY, "block"]
    # spread one entity's blocks even if rows arrive keyed by stay
    rows = rows.repartition(*group) if tasks is None else rows.repartition(tasks, *group)
    order = Window.partitionBy(*group).orderBy(HOUR)
    # the score of the hour before and after; absent hours are below every threshold
    low = F.lit(float("-inf"))
    before = F.when(F.lag(HOUR).over(order) == F.col(HOUR) - 1, F.lag("score").over(order))
    after = F.when(F.lead(HOUR).over(order) == F.col(HOUR) + 1, F.lead("score").over(order))
    rows = rows.select(*group, HOUR, "score", *carry, F.coalesce(before, low).alias("before"),
                       F.coalesce(after, low).alias("after"))
    # a row starts a run for the thresholds between its predecessor and itself, and ends one
    # for those between its successor and itself: copies follow the runs, not their hours
    rows = rows.withColumn("grid", thresholds)
    edge = F.filter("grid", lambda thr: (thr <= F.col("score")) & ((thr > F.col("before")) | (thr > F.col("after"))))
    edges = rows.select(*group, HOUR, "before", "after", *carry, F.explode(edge).alias("threshold"))
    # at most block_hours / 2 runs per group; sorted starts and ends pair up
    starts = F.array_sort(F.collect_list(F.when(F.col("threshold") > F.col("before"), F.col(HOUR))))
    ends = F.array_sort(F.collect_list(F.when(F.col("threshold") > F.col("after"), F.col(HOUR))))
    runs = edges.groupBy(KEY, "threshold", "block", *carry).agg(starts.alias("s"), ends.alias("e"))
    begin = F.col("block") * block_hours
    pairs = F.filter(F.arrays_zip("s", "e"), lambda run: (run["s"] >= begin) & (run["s"] < begin + block_hours))
    return runs.select(KEY, "threshold", "block", *carry, pairs.alias("runs"))


def fire(runs: Column, until: Column, k: Column, cooldown: Column) -> Column:
    """Alert hours of the runs, entering with a cooldown that ends at ``until``."""
    start = F.struct(until.cast("int").alias("until"), F.array().cast("array<int>").alias("hours"))

    def step(acc, run):
        at = (F.greatest(run["s"], acc["until"]) + k - 1).cast("int")
        fired = F.struct((at + cooldown).cast("int").alias("until"), F.array_append(acc["hours"], at).alias("hours"))
        return F.when(at <= run["e"], fired).otherwise(acc)

    return F.aggregate(runs, start, step)


def alert_blocks(
    scored: DataFrame,
    thresholds: Column,
    consecutive: Sequence[int],
    cooldowns: Sequence[int],
    block_hours: int = BLOCK_HOURS,
    carry: Sequence[str] = (),
    first_only: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """``stay_id, threshold, consecutive, cooldown_h, block, *carry, hours`` for every policy.

    ``hours`` are the alert hours that start in the block (blocks without alerts may be absent).
    ``first_only`` says that all hours lie in block 0, which nothing comes before: there is nothing to chain.
    """
    carry = list(carry)
    widest = max(cooldowns) + max(consecutive)
    runs = runs_above(scored, thresholds, widest, block_hours, carry, tasks)
    if first_only:
        runs = runs.filter((F.col("block") == 0) & F.col(KEY).isNotNull() & (F.size("runs") > 0))
    combos = F.array(*[
        F.struct(F.lit(int(k)).alias("consecutive"), F.lit(int(c)).alias("cooldown_h"))
        for k in consecutive for c in cooldowns
    ])
    each = runs.withColumn("p", F.explode(combos)).select(
        KEY, "threshold", F.col("p.consecutive").alias("consecutive"), F.col("p.cooldown_h").alias("cooldown_h"),
        "block", *carry, "runs",
    )
    k, cooldown = F.col("consecutive"), F.col("cooldown_h")
    if first_only:
        hours = fire(F.col("runs"), F.lit(0), k, cooldown)["hours"]
        return each.select(KEY, *POLICY, "block", *carry, hours.alias("hours")).filter(F.size("hours") > 0)
    # Play each block for every cooldown it may be entered with, then chain the blocks
    # through their (small) entry -> exit tables.  Nothing comes before block 0, and
    # without a cooldown nothing outlives its run: these are played once.
    begin = F.col("block") * block_hours
    entries = F.sequence(F.lit(0), F.when((F.col("block") == 0) | (cooldown == 0), 0).otherwise(2 * cooldown + k))
    played = each.withColumn(
        "played",
        F.transform(entries, lambda left: fire(F.col("runs"), begin + left, k, cooldown)),
    ).select(
        KEY, *POLICY, "block", *carry,
        F.transform("played", lambda p: F.greatest(F.lit(0), (p["until"] - begin - block_hours).cast("int"))).alias("exits"),
        F.transform("played", lambda p: p["hours"]).alias("choices"),
    )
    chains = played.groupBy(KEY, *POLICY).agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("chain"))
    nothing = F.array().cast("array<struct<block:bigint,left:int>>")
    state = F.struct(F.lit(None).cast("bigint").alias("block"), F.lit(0).alias("exit"), nothing.alias("entered"))

    def follow(acc, link):
        left = F.when(acc["block"] + 1 == link["block"], F.least(acc["exit"], F.size(link["exits"]) - 1)).otherwise(0)
        return F.struct(
            link["block"].alias("block"),
            F.element_at(link["exits"], left + 1).alias("exit"),
            F.array_append(acc["entered"], F.struct(link["block"].alias("block"), left.alias("left"))).alias("entered"),
        )

    entered = chains.select(KEY, *POLICY, F.explode(F.aggregate("chain", state, follow)["entered"]).alias("x"))
    entered = entered.select(KEY, *POLICY, "x.block", "x.left")
    hours = F.element_at("choices", F.col("left") + 1)
    return (
        played.join(entered, [KEY, *POLICY, "block"])
        .select(KEY, *POLICY, "block", *carry, hours.alias("hours"))
        .filter(F.size("hours") > 0)
    )


def alert_hours(scored: DataFrame, policy: AlertPolicy, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """``stay_id, alert_hour`` of one policy."""
    grid = F.array(F.lit(float(policy.threshold)))
    blocks = alert_blocks(scored, grid, [policy.consecutive], [policy.cooldown_h], block_hours)
    return blocks.select(KEY, F.explode("hours").alias("alert_hour"))


def state_name(score: Column, last_alert: Column, last_calm: Column, policy: AlertPolicy) -> Column:
    """State of an hour from the hours of the last alert and of the last hour that was not above the threshold."""
    armed = last_alert.isNotNull() & (F.coalesce(last_calm, F.lit(-1)) < last_alert)
    return (
        F.when(score.isNull(), "data_unavailable")
        .when(armed, "alerted")
        .when(F.col(HOUR) < last_alert + policy.cooldown_h, "cooldown")
        .otherwise("monitoring")
    )


def policy_states(scored: DataFrame, policy: AlertPolicy, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """State of every hour after its step, and whether it emitted an alert.

    An hour is *alerted* while nothing but scored hours at or above the threshold
    lies between the last alert and it; else *cooldown* while that alert's cooldown
    runs, else *monitoring*; unavailable hours say so.
    """
    fired = alert_hours(scored, policy, block_hours).withColumnRenamed("alert_hour", HOUR)
    # a stored panel is small as a file and large in memory: without the hint Spark may broadcast it
    rows = scored.select(KEY, HOUR, usable_score().alias("score")).hint("merge").join(
        fired.withColumn("fired", F.lit(1)), [KEY, HOUR], "left"
    )
    above = F.coalesce(F.col("score") >= policy.threshold, F.lit(False))
    rows = rows.withColumn("calm", F.when(~above, 1))
    state = running_state(rows, ("fired", "calm"), block_hours=block_hours)
    name = state_name(F.col("score"), F.col("fired@seen"), F.col("calm@seen"), policy)
    return state.select(KEY, HOUR, "score", name.alias("state"), F.coalesce("fired", F.lit(0)).alias("alert"))


def acknowledge(states: DataFrame, reviews: DataFrame, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Mark reviewed alerts.

    ``reviews``: stay_id, alert_hour, reviewed_at_hour.  From the review on, the hours
    still alerted by that alert read *acknowledged*; alert timing never changes.
    """
    alerts = states.filter(F.col("alert") == 1).select(KEY, F.col(HOUR).alias("alert_hour"))
    marks = alerts.join(reviews, [KEY, "alert_hour"]).select(
        KEY, F.col("alert_hour").alias("mark"), "reviewed_at_hour"
    )
    spell = states.withColumn("spell", F.when(F.col("alert") == 1, F.col(HOUR)))
    spell = running_state(spell, ("spell",), block_hours=block_hours).select(
        KEY, HOUR, "state", "alert", F.col("spell@cur").alias("mark")
    )
    seen = F.col("reviewed_at_hour") <= F.col(HOUR)
    return spell.join(marks, [KEY, "mark"], "left").select(
        KEY, HOUR,
        F.when((F.col("state") == "alerted") & F.coalesce(seen, F.lit(False)), "acknowledged")
        .otherwise(F.col("state")).alias("state"),
        "alert",
    )


# --- matching alerts with onsets -------------------------------------------------

def match_columns(hour: Column, onset: Column) -> dict[str, Column]:
    """Aggregates over a stay's alert hours (one partial row per map task and stay)."""
    d = hour - onset
    firsts = {n: F.min(F.when(d.between(a, b), hour)) for n, (a, b) in MATCH_WINDOWS.items()}
    return {"n_alerts": F.count(hour)} | firsts


def _first_between(a: int, b: int) -> Column:
    """First of the ascending ``hours`` within [onset + a, onset + b]."""
    hits = F.filter("hours", lambda h: (h - F.col("onset")).between(a, b))
    return F.when(F.col("onset").isNotNull(), F.get(hits, F.lit(0)))


def match_onsets(alerts: DataFrame, facts: DataFrame) -> DataFrame:
    """Per stay: alert count and first alert in each onset window.

    ``alerts``: stay_id, alert_hour.  ``facts``: output of ``labels.onset``.
    """
    firsts = match_columns(F.col("alert_hour"), F.col("onset"))
    per_stay = facts.join(alerts, KEY, "left").groupBy(
        KEY, "n_hours", "onset", "septic", "left_censored"
    ).agg(*[c.alias(n) for n, c in firsts.items()])
    return per_stay.withColumn("lead_h", F.col("onset") - F.col("first_early"))


def _ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


def _alert_sums() -> dict[str, Column]:
    """Sums over per-stay matches that any policy needs."""
    evaluable = F.col("septic") & ~F.col("left_censored")
    match, n = F.col("first_match"), F.col("n_alerts")
    pre = match.isNotNull() & (match < F.col("onset"))
    late = match.isNotNull() & (match >= F.col("onset"))
    spare = F.when(~F.col("septic"), n).when(F.col("left_censored"), 0).otherwise(n - match.isNotNull().cast("int"))
    return {
        "alerts_emitted": F.sum(n),
        "unmatched_alerts": F.sum(spare),
        "false_alerts_nonseptic": F.sum(F.when(~F.col("septic"), n).otherwise(0)),
        "alerts_in_left_censored_stays": F.sum(F.when(F.col("left_censored"), n).otherwise(0)),
        "detected_early": F.count_if(evaluable & F.col("first_early").isNotNull()),
        "warned": F.count_if(evaluable & F.col("first_warning").isNotNull()),
        "matched_pre_onset": F.count_if(pre),
        "matched_late": F.count_if(late),
        # leads are whole hours 1..12, so the percentile buffer stays tiny
        "lead": F.percentile(F.when(evaluable, F.col("lead_h")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))),
    }


def _stay_sums() -> dict[str, Column]:
    septic, censored, hours = F.col("septic"), F.col("left_censored"), F.col("n_hours")
    return {
        "stays": F.count(F.lit(1)),
        "septic_onset_evaluable_stays": F.count_if(septic & ~censored),
        "left_censored_positive_stays": F.count_if(septic & censored),
        "hours": F.sum(hours),
        "hours_nonseptic": F.sum(F.when(~septic, hours).otherwise(0)),
    }


def _alert_report() -> list[Column]:
    c = F.col
    days, days_non = c("hours") / 24.0, c("hours_nonseptic") / 24.0
    counted = c("alerts_emitted") - c("alerts_in_left_censored_stays")
    n_eval = c("septic_onset_evaluable_stays")
    return [
        c("stays"), n_eval, c("left_censored_positive_stays"),
        days.alias("patient_days"),
        c("alerts_emitted"),
        _ratio(100 * c("alerts_emitted"), days).alias("alerts_per_100_patient_days"),
        c("unmatched_alerts"),
        _ratio(100 * c("unmatched_alerts"), days).alias("unmatched_per_100_patient_days"),
        c("false_alerts_nonseptic"),
        _ratio(100 * c("false_alerts_nonseptic"), days_non).alias("false_alerts_nonseptic_per_100_patient_days"),
        c("alerts_in_left_censored_stays"),
        _ratio(c("detected_early"), n_eval).alias("early_sensitivity"),
        c("detected_early"),
        (n_eval - c("detected_early")).alias("missed"),
        _ratio(c("warned"), n_eval).alias("six_hour_warning_rate"),
        c("lead")[1].alias("lead_time_median_h"),
        c("lead")[0].alias("lead_time_q25_h"),
        c("lead")[2].alias("lead_time_q75_h"),
        c("matched_pre_onset"), c("matched_late"),
        _ratio(c("matched_pre_onset") + c("matched_late"), counted).alias("alert_precision"),
        _ratio(c("matched_pre_onset"), counted).alias("alert_precision_pre_onset"),
    ]


def alert_metrics(matches: DataFrame) -> DataFrame:
    """One row of alert metrics from ``match_onsets``."""
    sums = _stay_sums() | _alert_sums()
    return matches.agg(*[c.alias(n) for n, c in sums.items()]).select(*_alert_report())


# --- policy search ---------------------------------------------------------------

def policy_grid(
    scored: DataFrame,
    facts: DataFrame,
    thresholds: Column,
    consecutive: Sequence[int] = (1, 2, 3),
    cooldowns: Sequence[int] = (0, 6, 12),
    block_hours: int = BLOCK_HOURS,
) -> DataFrame:
    """Alert metrics of every policy in thresholds x consecutive x cooldowns.

    Rows under the lowest threshold never leave the scan side, a row is copied only
    to the thresholds it reaches, and stays without alerts are accounted for by
    totals, so the work follows the rows above threshold and not stays x policies.
    A stay within block 0 has one row per policy where its runs are; only the others chain and merge theirs.
    """
    outcome = ["onset", "septic", "left_censored"]
    lowest = F.element_at(thresholds, 1)
    candidates = scored.filter(usable_score() >= lowest).join(facts.select(KEY, *outcome), KEY)
    later = candidates.filter(F.col(HOUR) >= block_hours).select(KEY).distinct()
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but copied to every policy
    shape = (thresholds, consecutive, cooldowns, block_hours, outcome)
    one = alert_blocks(candidates.join(later, KEY, "left_anti"), *shape, first_only=True, tasks=tasks)
    several = alert_blocks(candidates.join(later, KEY, "left_semi"), *shape)

    def matched(blocks: DataFrame) -> DataFrame:
        return blocks.select(
            KEY, *POLICY, *outcome, F.size("hours").cast("long").alias("n_alerts"),
            *[_first_between(a, b).alias(n) for n, (a, b) in MATCH_WINDOWS.items()],
        )

    merged = matched(several).groupBy(KEY, *POLICY, *outcome).agg(
        F.sum("n_alerts").alias("n_alerts"), *[F.min(n).alias(n) for n in MATCH_WINDOWS]
    )
    per_stay = matched(one).unionByName(merged)
    per_stay = per_stay.withColumn("lead_h", F.col("onset") - F.col("first_early"))
    per_policy = per_stay.groupBy(*POLICY).agg(*[c.alias(n) for n, c in _alert_sums().items()])

    totals = facts.agg(F.struct(*[c.alias(n) for n, c in _stay_sums().items()])).scalar()
    grid = (
        facts.sparkSession.range(1)
        .select(F.explode(thresholds).alias("threshold"))
        .withColumn("consecutive", F.explode(F.array(*[F.lit(int(k)) for k in consecutive])))
        .withColumn("cooldown_h", F.explode(F.array(*[F.lit(int(c)) for c in cooldowns])))
        .withColumn("totals", totals)
    )
    full = grid.join(per_policy, list(POLICY), "left")
    counters = [n for n in _alert_sums() if n != "lead"]
    full = full.select(
        *POLICY, "totals.*", *[F.coalesce(n, F.lit(0)).alias(n) for n in counters], "lead"
    )
    return full.select(*POLICY, *_alert_report())


def best_per_budget(grid: DataFrame, budgets: Sequence[float] = (1, 2, 5, 10, 20)) -> DataFrame:
    """Most sensitive policy within each alert budget (per 100 patient-days).

    Ties: higher precision (unknown counts as 0), then the first in grid order.
    Budgets that no policy meets come back with ``feasible = false``.
    """
    asked = F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget")
    within = F.col("alerts_per_100_patient_days") <= F.col("budget")
    rank = F.struct(
        F.col("early_sensitivity"), F.coalesce("alert_precision", F.lit(0.0)),
        -F.col("threshold"), -F.col("consecutive"), -F.col("cooldown_h"),
    )
    shown = [*POLICY, "alerts_per_100_patient_days", "early_sensitivity", "six_hour_warning_rate",
             "alert_precision", "lead_time_median_h", "false_alerts_nonseptic_per_100_patient_days"]
    best = grid.select("*", asked).groupBy("budget").agg(
        F.max_by(F.when(within, F.struct(*shown)), F.when(within, rank)).alias("best")
    )
    return best.select("budget", F.col("best").isNotNull().alias("feasible"), "best.*")
