"""Chat formatting: link tool calls to their results, order them, check arguments, write JSON.

Everything is DataFrame expressions. Input: one row an event, with ``conv_id``, ``turn``, ``role``,
``content``, ``call_id``, ``name`` and ``arguments`` (JSON text). A row with a name is a call; a row of role
``tool`` is a result; any other is a message.

* Linking: calls are reduced to one row per (conversation, id), the earliest turn, combined
  map-side, and results join it by that key. Rows of a group are never gathered: the formatted
  conversation is one row an event, in the order of (position, level, turn, kind), so a
  conversation that holds a third of all rows is spread like any other.
* Order: a call whose arguments have a string value ``$<id>`` uses the result of that call. Positions
  are topological: no call before the results it uses, no result before its call, otherwise by
  turn. Levels are found in rounds over the calls with references only. Chains and trees of n calls take
  some log2(n) rounds; where calls in a row each use several calls that wait too, a round may
  finish one of the row. Calls in a cycle, or behind one, are marked.
* Arguments are checked against a schema a tool: required names and JSON types.
* JSON is canonical: object keys sorted, no blanks, text as UTF-8.

``problem`` is null, ``orphan`` (result without a call), ``open`` (call without a result), ``duplicate``
(a later call of an id in use), ``unknown tool``, ``bad json``, ``bad arguments`` or ``cycle``; the first that holds.

Nulls: a null conversation or call id links to nothing; null content is JSON null; null arguments
are no JSON; a null turn counts as the lowest. Repeated rows are returned each (a repeated call is
linked once and not marked). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, prepare
from tessera.session import scratch_path

#: A tool's schema: JSON type of each argument, and the required names.
Schema = dict[str, tuple[dict[str, str], list[str]]]

# JSON types as Spark names the parsed value's type.
_TYPES = {"string": "^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
          "boolean": "^BOOLEAN$", "array": "^ARRAY<.*$", "object": "^OBJECT.*$", "null": "^VOID$"}


def _checked(arguments: Column, name: Column, schemas: Schema) -> Column:
    """The first fault of a call's arguments, or null."""
    parsed = F.try_parse_json(arguments)
    fault = F.when(~name.isin(*schemas) if schemas else F.lit(True), "unknown tool")
    fault = fault.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "bad json")
    for tool, (types, required) in schemas.items():
        bad = F.lit(False)
        for field, kind in types.items():
            found = F.schema_of_variant(F.try_variant_get(parsed, f"$['{field}']", "variant"))
            missing = F.lit(field in required) & found.isNull()
            bad = bad | missing | (found.isNotNull() & ~found.rlike(_TYPES[kind]))
        fault = fault.when((name == tool) & F.coalesce(bad, F.lit(True)), "bad arguments")
    return fault


def _json_text(c: Column) -> Column:
    j = F.to_json(F.struct(c.alias("s")))  # {"s":"..."}
    return F.when(c.isNull(), "null").otherwise(F.substring(j, 6, F.length(j) - 6))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, first, level, at, answer) of the calls: at is the turn before which a call can't stand.

    ``calls``: one row a call with ``first`` (its own turn), ``answer`` (the turn of its first result) and
    ``refs`` (ids whose results it uses). Level null: part of a cycle, or behind one.

    A call is ``level = max(base, level of ref + add)`` over its pending references. Each round replaces a
    reference to a finished call by its numbers, and a reference to a call that waits for one call only by
    a reference to that one, so chains and trees shrink by half a round. Rounds are stored, each call once
    finished in one of them.
    """
    spark = calls.sparkSession
    calls = materialise(calls, "chat-calls")
    key = ["conv_id", "call_id"]
    kept = [*key, "first", "answer"]
    plain = calls.where(F.size("refs") == 0).select(
        *kept, F.lit(0).cast("long").alias("level"), F.col("first").alias("at"))
    waiting = calls.where(F.size("refs") > 0)
    if waiting.isEmpty():
        return plain
    # references to calls that don't exist hold nothing up
    needs = waiting.select("conv_id", "call_id", F.explode("refs").alias("ref"))
    needs = needs.join(calls.select("conv_id", F.col("call_id").alias("ref"), F.size("refs").alias("_refs"),
                                    F.greatest("first", "answer").alias("_top")), ["conv_id", "ref"])
    step = F.lit(2).cast("long")  # a call, its result, the next call
    pending = F.col("_refs") > 0
    state = (needs.groupBy(*key).agg(
        F.max(F.when(~pending, step)).alias("_base"), F.max(F.when(~pending, F.col("_top"))).alias("_at"),
        F.collect_list(F.when(pending, F.struct("ref", step.alias("add")))).alias("refs")))
    state = waiting.select(*kept).join(state, key, "left").select(
        *kept, F.coalesce("_base", F.lit(0)).alias("base"), F.greatest("first", "_at").alias("at"),
        F.coalesce("refs", F.array().cast("array<struct<ref:string,add:bigint>>")).alias("refs"))

    folder = scratch_path(spark, "chat-rounds")
    fields = state.withColumns({"finished": F.lit(True), "round": F.lit(0)}).schema
    for n in count():
        state.withColumn("finished", F.size("refs") == 0).write.partitionBy("finished").parquet(f"{folder}/round={n}")
        state = spark.read.schema(fields).parquet(folder).where(F.col("round") == n).drop("round")
        left = {r["finished"] for r in state.select("finished").distinct().collect()}
        if left != {True, False}:  # nothing waits, or what waits is a cycle or behind one
            break
        finished, waiting = state.where("finished").drop("finished"), state.where("not finished").drop("finished")
        state = materialise(_replaced(waiting, finished), "chat-round")
        state = _replaced(state, state.where("size(refs) <= 1"))
    rounds = spark.read.schema(fields).parquet(folder)
    finished = F.col("finished")
    return plain.unionByName(rounds.where(finished | (F.col("round") == n)).select(
        *kept, F.when(finished, F.col("base")).alias("level"),
        F.when(finished, F.col("at")).otherwise(F.col("first")).alias("at")))


def _replaced(calls: DataFrame, target: DataFrame) -> DataFrame:
    """``calls`` with each reference to a row of ``target`` replaced by its numbers and its only reference, if any."""
    key = ["conv_id", "call_id"]
    only = F.get("refs", F.lit(0))
    target = target.select(
        "conv_id", F.col("call_id").alias("ref"), F.col("base").alias("_base"), F.greatest("at", "answer").alias("_top"),
        only["ref"].alias("_ref"), only["add"].alias("_add"))
    edges = calls.select(*key, F.explode("refs").alias("_edge")).select(
        *key, F.col("_edge.ref").alias("ref"), F.col("_edge.add").alias("add"))
    edges = edges.join(target, ["conv_id", "ref"], "left")

    def bounded(c):  # sums along a cycle double each round; they are never used
        return F.least(c, F.lit(1 << 40))

    replaced = F.col("_base").isNotNull()
    edges = (edges.select(*key, F.when(replaced, F.col("_ref")).otherwise(F.col("ref")).alias("ref"),
                          bounded(F.col("add") + F.coalesce("_add", F.lit(0))).alias("add"),
                          F.when(replaced, bounded(F.col("_base") + F.col("add"))).alias("_base"), "_top")
             .groupBy(*key, "ref").agg(F.max("add").alias("add"), F.max("_base").alias("_base"), F.max("_top").alias("_top")))
    found = edges.groupBy(*key).agg(
        F.max("_base").alias("_base"), F.max("_top").alias("_top"),
        F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("ref", "add"))).alias("_refs"))
    return calls.join(found, key, "left").select(
        *key, "first", "answer", F.greatest("base", "_base").alias("base"), F.greatest("at", "_top").alias("at"),
        F.coalesce("_refs", "refs").alias("refs"))


def format_chat(events: DataFrame, schemas: Schema) -> DataFrame:
    """Per event: conv_id, turn, kind, call_id, linked_turn, position, level, problem, json."""
    prepare(events.sparkSession)
    lowest = F.lit(-(1 << 62)).cast("long")
    rows = events.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "content", "call_id", "name", "arguments",
        F.when(F.col("name").isNotNull(), "call").when(F.col("role") == "tool", "result").otherwise("message").alias("kind"))
    at = F.coalesce(F.col("turn"), lowest)
    calls = (rows.where("kind = 'call' and conv_id is not null and call_id is not null")
             .groupBy("conv_id", "call_id")
             .agg(F.min(at).alias("first"), F.min_by("arguments", at).alias("_args")))
    answered = (rows.where("kind = 'result' and call_id is not null").groupBy("conv_id", "call_id")
                .agg(F.min(at).alias("answer")))
    refs = F.array_distinct(F.regexp_extract_all(F.col("_args"), F.lit(r'"\$([^"\\]+)"'), F.lit(1)))
    calls = (calls.select("conv_id", "call_id", "first", F.coalesce(refs, F.array().cast("array<string>")).alias("refs"))
             .join(answered, ["conv_id", "call_id"], "left"))
    linked = _levels(calls).select("conv_id", "call_id", F.col("first").alias("_first"), F.col("at").alias("_at"),
                                   F.col("level").cast("int").alias("_level"), F.col("answer").alias("_answer"))
    tied = rows.where("kind != 'message'").join(linked, ["conv_id", "call_id"], "left")
    none = [F.lit(None).cast(t).alias(n) for n, t in
            (("_first", "long"), ("_level", "int"), ("_at", "long"), ("_answer", "long"))]
    free = rows.where("kind = 'message'").select("*", *none)
    rows = tied.unionByName(free)

    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    has_call = F.col("_first").isNotNull()
    position = F.when(is_result & has_call, F.greatest(at, "_at")).when(is_call & has_call, F.greatest(at, "_at")).otherwise(at)
    level = (F.when(is_call, F.coalesce("_level", F.lit(0)))
             .when(is_result & has_call, F.coalesce(F.col("_level"), F.lit(0)) + 1).otherwise(F.lit(0)))
    problem = (F.when(is_result & ~has_call, "orphan")
               .when(is_call & (at > F.col("_first")), "duplicate")
               .when((is_call | is_result) & has_call & F.col("_level").isNull(), "cycle")
               .when(is_call, F.coalesce(_checked(F.col("arguments"), F.col("name"), schemas),
                                         F.when(F.col("_answer").isNull(), "open"))))
    content, call_id = _json_text(F.col("content")), _json_text(F.col("call_id"))
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), _json_text(F.col("arguments")))
    json = (F.when(is_call, F.concat(F.lit('{"role":"assistant","tool_calls":[{"arguments":'), arguments,
                                     F.lit(',"id":'), call_id, F.lit(',"name":'), _json_text(F.col("name")), F.lit("}]}")))
            .when(is_result, F.concat(F.lit('{"content":'), content, F.lit(',"role":"tool","tool_call_id":'), call_id,
                                      F.lit("}")))
            .otherwise(F.concat(F.lit('{"content":'), content, F.lit(',"role":'), _json_text(F.col("role")), F.lit("}"))))
    return rows.select("conv_id", "turn", "kind", "call_id",
                       F.when(is_result, F.col("_first")).alias("linked_turn"),
                       F.when(position == lowest, None).otherwise(position).alias("position"),
                       level.alias("level"), problem.alias("problem"), json.alias("json"))


# The given conversations have no tool calls, so the query reads each user turn as a call of one tool
# and each assistant turn as the result for the turn before it.
REPLY_TOOL: Schema = {"reply": ({"prompt": "string", "turn": "integer"}, ["prompt", "turn"])}


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Events of a (conv_id, turn, role, text) table."""
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    turn = F.col("turn").cast("long")
    call_id = F.when(user, turn).when(reply, turn - 1)
    arguments = F.concat(F.lit('{"turn":'), turn.cast("string"), F.lit(',"prompt":'), _json_text(F.col("text")), F.lit("}"))
    return conversations.select(
        "conv_id", turn.alias("turn"), F.when(reply, "tool").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"), F.concat(F.lit("call-"), call_id.cast("string")).alias("call_id"),
        F.when(user, "reply").alias("name"), F.when(user, arguments).alias("arguments"))
