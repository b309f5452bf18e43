"""Tool-call linking for chat data, JVM expressions only.

Calls and results meet in a hash join on (conversation, call id).  Calls are put in
topological order by levels: level 0 waits for nothing, a call's level is one more than that
of the last call that it waits for.  Chains of calls that wait for one call each are passed by
pointer doubling, the others are levelled by rounds of joins.  Arguments are parsed as JSON and every member is
checked against the tool's schema.  The canonical form has sorted keys and no white
space.

Defined cases: the first call (by position) of an id that repeats is linked, the others
are ``duplicate``; a call without result is ``unanswered``; a result without call is an
``orphan`` row; calls on or behind a cycle have no level and status ``cycle``; a dependency
on an unknown call is an error and is not waited for.  Arguments that are null or no JSON
object are an error and null in the canonical form.  Null conversation and call ids are
values like any other.  Exact repeats of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.session import stored

KEY = ["conv_id", "call_id"]
SCHEMA_COLUMNS = "name string, property string, type string, required boolean"


def _chains(calls: DataFrame, edges: DataFrame, stops: DataFrame) -> DataFrame:
    """(conv_id, call_id, stop, dist): for calls that need exactly one call, the nearest stop up the chain.

    Pointers double their reach each round, so a chain of n calls takes log2(n) rounds; what
    has met no stop by then lies on or behind a cycle and is left out.
    """
    met = stops.select("conv_id", F.col("call_id").alias("at"), F.lit(True).alias("done"))
    first = edges.join(stops, KEY, "left_anti").select(*KEY, F.col("needs").alias("at"), F.lit(1).alias("dist"))
    now = stored(first.join(met, ["conv_id", "at"], "left").withColumn("done", F.coalesce("done", F.lit(False))), "chains")
    for _ in range(max(1, calls.count()).bit_length() + 1):
        going = now.where(~F.col("done"))
        if going.isEmpty():
            break
        far = now.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("at2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = going.join(far, ["conv_id", "at"]).select(*KEY, F.col("at2").alias("at"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"))
        now = stored(now.where("done").select(*KEY, "at", "dist", "done").unionByName(moved), "chains")
    return now.where("done").select(*KEY, F.col("at").alias("stop"), "dist")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for every call that no cycle holds up; edges are (conv_id, call_id, needs).

    Calls that need exactly one call are passed over by pointer doubling.  What is left, calls that
    need several or none (stops), is levelled round by round: as many rounds as several-need calls in one chain.
    """
    edges = stored(edges.distinct(), "edges")
    degree = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    stops = stored(calls.select(*KEY).join(degree.where("n = 1"), KEY, "left_anti"), "stops")
    chains = stored(_chains(calls, edges, stops), "chains")
    several = edges.join(degree.where("n > 1"), KEY).select(*KEY, "needs")
    over = chains.withColumnsRenamed({"call_id": "needs"})
    rest = several.join(over, ["conv_id", "needs"], "left").select(
        *KEY, F.coalesce("stop", "needs").alias("stop"), F.coalesce("dist", F.lit(0)).alias("dist"), F.lit(None).cast("int").alias("level"))
    rest = stored(rest, "waiting")
    now = stored(stops.join(degree, KEY, "left_anti").withColumn("level", F.lit(0)), "level")
    done = [now]
    while not rest.isEmpty() and not now.isEmpty():
        up = now.select("conv_id", F.col("call_id").alias("stop"), F.col("level").alias("up"))
        rest = rest.join(up, ["conv_id", "stop"], "left").select(*KEY, "stop", "dist", F.coalesce("level", F.col("up") + F.col("dist") + 1).alias("level"))
        rest = stored(rest, "waiting")
        open_ = rest.where("level is null").select(*KEY).distinct()
        now = stored(rest.join(open_, KEY, "left_anti").groupBy(*KEY).agg(F.max("level").alias("level")), "level")
        rest = stored(rest.join(now.select(*KEY), KEY, "left_anti"), "waiting")
        done.append(now)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    up = out.select("conv_id", F.col("call_id").alias("stop"), "level")
    passed = chains.join(up, ["conv_id", "stop"]).select(*KEY, (F.col("level") + F.col("dist")).alias("level"))
    return out.unionByName(passed)


def kind_of(value: Column) -> Column:
    """JSON type name of a parsed value."""
    t = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (t == "VOID"), "null").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer")
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number")
    )


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, error) for calls (conv_id, call_id, name, args variant)."""
    bad = calls.where(F.col("args").isNull()).select(*KEY, F.lit("arguments are no JSON object").alias("error"))
    good = calls.where(F.col("args").isNotNull())
    tools = schemas.select("name").distinct()
    unknown = good.join(tools, "name", "left_anti").select(*KEY, F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("null"))).alias("error"))
    spark = calls.sparkSession
    members = good.join(tools, "name").lateralJoin(spark.tvf.variant_explode(F.col("args").outer())).select(*KEY, "name", F.col("key").alias("property"), kind_of(F.col("value")).alias("kind"))
    members = members.where("property is not null")
    typed = members.join(schemas, ["name", "property"], "left")
    fits = (F.col("type") == F.col("kind")) | ((F.col("type") == "number") & (F.col("kind") == "integer"))
    wrong = typed.where(F.col("type").isNull() | ~fits).select(*KEY, F.when(
        F.col("type").isNull(), F.concat(F.lit("unexpected "), F.col("property"))).otherwise(F.concat("property", F.lit(" is "), "kind", F.lit(", not "), "type")).alias("error"))
    needed = good.join(schemas.where("required").select("name", "property"), "name").select(*KEY, "property")
    missing = needed.join(members.select(*KEY, "property"), [*KEY, "property"], "left_anti").select(*KEY, F.concat(F.lit("missing "), F.col("property")).alias("error"))
    return bad.unionByName(unknown).unionByName(wrong).unionByName(missing)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per orphan result.

    calls: conv_id, call_id, position, name, arguments (JSON text), needs (array of call ids);
    results: conv_id, call_id, position, content; schemas: name, property, type, required.
    Returns conv_id, call_id, position, name, level, place (order within the conversation), status, n_results,
    errors (sorted, "; " between), valid, canonical.
    """
    first = Window.partitionBy("conv_id", "call_id").orderBy("position", "arguments")
    calls = calls.select("conv_id", F.coalesce("call_id", F.lit("")).alias("call_id"), "position", "name", "arguments", "needs").distinct()
    calls = stored(calls.withColumn("nth", F.row_number().over(first)), "calls")
    results = results.select("conv_id", F.coalesce("call_id", F.lit("")).alias("call_id"), "position", "content").distinct()
    answers = results.groupBy(*KEY).agg(F.min_by("content", "position").alias("content"), F.min("position").alias("answered"), F.count(F.lit(1)).alias("n_results"))
    parsed = F.try_parse_json("arguments")
    once = calls.where("nth = 1").withColumn("args", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))
    needs = once.select(*KEY, F.explode("needs").alias("needs")).where("needs is not null")
    known = once.select("conv_id", F.col("call_id").alias("needs")).distinct()
    order = levels(once, needs.join(known, ["conv_id", "needs"], "left_semi"))
    absent = needs.join(known, ["conv_id", "needs"], "left_anti").select(*KEY, F.concat(F.lit("needs unknown call "), F.col("needs")).alias("error"))
    errors = argument_errors(once.select(*KEY, "name", "args"), schemas).unionByName(absent)
    errors = errors.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("error")), "; ").alias("errors"))
    joined = once.join(answers, KEY, "full_outer").join(order, KEY, "left").join(errors, KEY, "left")
    status = (
        F.when(F.col("nth").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    )
    record = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("content").alias("result")),
                       {"ignoreNullFields": "false"})
    rows = joined.select(
        *KEY, F.coalesce("position", "answered").alias("position"), "name", "level", status.alias("status"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.coalesce("errors", F.lit("")).alias("errors"), record.alias("canonical"),
    )
    again = calls.where("nth > 1").select(
        *KEY, "position", "name", F.lit(None).cast("int").alias("level"), F.lit("duplicate").alias("status"), F.lit(0).cast("long").alias("n_results"),
        F.lit("").alias("errors"), F.lit(None).cast("string").alias("canonical"),
    )
    place = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "position", "call_id", "status")
    out = rows.unionByName(again).withColumn("place", F.row_number().over(place))
    return out.withColumn("valid", (F.col("status") == "linked") & (F.col("errors") == "")).select(
        *KEY, "position", "name", "level", "place", "status", "n_results", "errors", "valid", "canonical")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain chat turns: every system and user turn is a call (``instruct``, ``reply``)
    that needs the call before it; an assistant turn is the result of the last call before it."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    asks = F.col("role").isin("system", "user")
    turns = conversations.select("conv_id", "turn", "role", "text").distinct()
    turns = turns.withColumn("own", F.when(asks, F.concat(F.lit("call-"), F.col("turn").cast("string"))))
    turns = turns.withColumn("last", F.last("own", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    body = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"), F.col("last").alias("after")))
    calls = turns.where(asks).select(
        "conv_id", F.col("own").alias("call_id"), F.col("turn").cast("long").alias("position"),
        F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"), body.alias("arguments"),
        F.when(F.col("last").isNotNull(), F.array("last")).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = turns.where(~asks | F.col("role").isNull()).select(
        "conv_id", F.coalesce("last", F.lit("none")).alias("call_id"), F.col("turn").cast("long").alias("position"), F.col("text").alias("content"))
    return calls, results


def chat_schemas(spark: SparkSession) -> DataFrame:
    """Schemas of the two tools above; ``instruct`` takes no ``after``."""
    return spark.createDataFrame([
        ("reply", "turn", "integer", True), ("reply", "text", "string", True), ("reply", "after", "string", False),
        ("instruct", "turn", "integer", True), ("instruct", "text", "string", True),
    ], SCHEMA_COLUMNS)
