"""Chat formatting with tool calls, in DataFrame and SQL functions only.

Calls and results meet in a hash join on conversation and call identifier. Messages are ordered topologically: a
result after its call, a call after the results it waits for; apart from that by turn. Arguments are validated
against the schema of their tool, and every message is serialised as canonical JSON: keys sorted, no blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import global_index, materialize

#: Types of a schema and the variant types that satisfy them.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}
Schema = dict[str, dict[str, dict]]


def _errors(schemas: Schema) -> Column:
    """Errors of the arguments ``_args`` (a variant) of the tool ``name``."""
    given = F.map_keys(F.coalesce(F.expr("try_variant_get(_args, '$', 'map<string,variant>')"), F.create_map().cast("map<string,variant>")))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, rule in fields.items():
            value = f"try_variant_get(_args, '$.{field}', 'variant')"
            kind = F.regexp_extract(F.expr(f"schema_of_variant({value})"), r"^[A-Z]+", 0)
            absent = F.expr(f"{value} is null") | (kind == "VOID")
            checks.append(F.when(absent, F.lit(f"missing {field}") if rule.get("required") else F.lit(None)).when(~kind.isin(TYPES[rule["type"]]), f"{field} is no {rule['type']}"))
            if "max_length" in rule:
                checks.append(F.when(F.length(F.expr(f"try_variant_get(_args, '$.{field}', 'string')")) > rule["max_length"], f"{field} is longer than {rule['max_length']}"))
        unknown = F.transform(F.array_sort(F.array_except(given, F.array(*[F.lit(f) for f in fields]))), lambda f: F.concat(F.lit("unknown "), f))
        found = F.concat(F.array_compact(F.array(*checks)), unknown)
        out = F.when(F.col("name") == tool, found).otherwise(out)
    shape = F.coalesce(F.expr("schema_of_variant(_args)"), F.lit(""))
    return F.when(~shape.startswith("OBJECT"), F.array(F.lit("arguments are no object"))).otherwise(out)


def _ordered(messages: DataFrame, waits: DataFrame) -> DataFrame:
    """(id, level, moment): level in the dependency graph, and the latest turn of a message and all before it.

    One round for each level, over written tables; messages on or behind a cycle stay without a level.
    """
    needs = waits.groupBy("child").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(messages.join(needs, F.col("id") == F.col("child"), "left_anti").select("id", F.lit(0).alias("level"), F.col("turn").alias("moment")), "chat-level")
    done, level = placed.df, 0
    while placed.rows:
        level += 1
        met = waits.join(done.withColumnRenamed("id", "parent"), "parent").groupBy("child").agg(F.count(F.lit(1)).alias("m"), F.max("level").alias("l"), F.max("moment").alias("before"))
        ready = met.join(needs, "child").where(f"m = n and l = {level - 1}")
        next_ = ready.join(messages.select(F.col("id").alias("child"), "turn"), "child")
        placed = materialize(next_.select(F.col("child").alias("id"), F.lit(level).alias("level"), F.greatest("turn", "before").alias("moment")), "chat-level")
        done = done.union(placed.df)
    return done


def linked_messages(messages: DataFrame, schemas: Schema) -> DataFrame:
    """Linked, ordered, validated and serialised messages.

    ``messages`` has (conv_id, turn, role, content, kind, call_id, name, arguments, after): kind is "call", "result" or
    null for plain messages, ``arguments`` a JSON text, ``after`` the call identifiers that a call waits for. The result
    has (conv_id, turn, role, call_id, status, errors, level, position, json), position from 1 within a conversation.

    Repeated rows count once. Of several calls or results with one identifier the first (turn, role, content) is
    linked, the others are "duplicate". A call without result is "open", a result without call is "orphan", plain
    messages are "plain"; identifiers link within one conversation only, and a null conversation or identifier links
    nothing. Null turns come first, null contents are left out of the JSON. Malformed arguments are an error and are
    left out. Messages on a cycle of waits have no level and come last. An empty table gives no rows.
    """
    cols = {"conv_id": "long", "turn": "long", "role": "string", "content": "string", "kind": "string", "call_id": "string", "name": "string", "arguments": "string", "after": "array<string>"}
    rows = messages.select(*[F.col(c).cast(t).alias(c) for c, t in cols.items()]).distinct()
    rows = rows.withColumn("id", F.sha2(F.to_json(F.struct(*cols)), 256))
    rows = materialize(rows, "chat").df
    key, first = ["conv_id", "call_id"], F.min(F.struct("turn", "role", "content", "id"))["id"]
    named = rows.where("conv_id is not null and call_id is not null")
    call = named.where("kind = 'call'").groupBy(*key).agg(first.alias("call"))
    result = named.where("kind = 'result'").groupBy(*key).agg(first.alias("result"))
    link = materialize(call.join(result, key, "full"), "chat-link").df
    waits = link.where("call is not null and result is not null").select(F.col("result").alias("child"), F.col("call").alias("parent"))
    asked = rows.where("kind = 'call'").select("conv_id", F.explode("after").alias("call_id"), F.col("id").alias("child"))
    ahead = link.select(*key, F.coalesce("result", "call").alias("parent"))
    waits = materialize(waits.union(asked.join(ahead, key).select("child", "parent")).distinct(), "chat-waits").df
    done = _ordered(rows, waits)
    part = link.select(F.explode(F.array("call", "result")).alias("id"), (F.col("call").isNotNull() & F.col("result").isNotNull()).alias("both")).where("id is not null")
    full = rows.join(part, "id", "left").join(done, "id", "left")
    status = (
        F.when(F.col("kind").isNull() | ~F.col("kind").isin("call", "result"), "plain")
        .when(F.col("both"), "linked")
        .when(F.col("both").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), "duplicate")
        .when(F.col("kind") == "call", "open")
        .otherwise("orphan")
    )
    is_call = F.col("kind") == "call"
    full = full.withColumn("status", status).withColumn("_args", F.expr("try_parse_json(arguments)"))
    full = full.withColumn("errors", F.when(is_call, _errors(schemas)).otherwise(F.array().cast("array<string>")))
    json = F.to_json(
        F.struct(
            F.when(is_call, F.col("_args")).alias("arguments"), "call_id", "content", F.when(is_call, F.col("name")).alias("name"), "role", F.col("turn").alias("turn")
        )
    )
    late = F.coalesce("level", F.lit(1 << 30))
    moment = F.coalesce("moment", "turn")
    out = full.select("conv_id", "turn", "role", "call_id", "status", "errors", "level", json.alias("json"), "id", late.alias("_l"), F.when(F.col("level").isNull(), F.lit((1 << 62))).otherwise(moment).alias("_m"))
    placed = global_index(out, "conv_id", "_m", "_l", "turn", "role", "json", "id")
    start = placed.groupBy("conv_id").agg(F.min("idx").alias("_s"))
    placed = placed.join(start, placed["conv_id"].eqNullSafe(start["conv_id"])).drop(start["conv_id"])
    return placed.select("conv_id", "turn", "role", "call_id", "status", "errors", "level", (F.col("idx") - F.col("_s") + 1).alias("position"), "json")


#: The tool that user turns stand for, in the query over plain conversations.
ASK: Schema = {"ask": {"text": {"type": "string", "required": True, "max_length": 400}, "turn": {"type": "integer", "required": True}}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic: a user turn calls the tool ``ask``, the assistant turn after it is the result."""
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    is_call, is_result = F.col("role") == "user", F.col("role") == "assistant"
    return c.select(
        "conv_id",
        "turn",
        "role",
        F.when(~F.coalesce(is_call, F.lit(False)), F.col("text")).alias("content"),
        F.when(is_call, "call").when(is_result, "result").alias("kind"),
        F.when(is_call, F.concat_ws("_", F.lit("ask"), "conv_id", "turn")).when(is_result, F.concat_ws("_", F.lit("ask"), "conv_id", F.col("turn") - 1)).alias("call_id"),
        F.when(is_call, "ask").alias("name"),
        F.when(is_call, F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text")))).alias("arguments"),
        F.lit(None).cast("array<string>").alias("after"),
    )
