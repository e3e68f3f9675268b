"""Tool calls in chats: linked to results, ordered, validated and serialised, with DataFrame functions only.

Calls and results meet in a hash join on conversation and identifier. A call may name an earlier
call whose result it uses; its level is the length of that chain, found by pointer doubling, so
a chain of n calls takes about log2(n) joins and no conversation is gathered in one task. Arguments
are checked against the tool's parameters. A message is written as canonical JSON: keys sorted, no
spaces, numbers in one form. In a conversation, (level, seq, kind) is a topological order: a call
follows the result it uses, a result follows its call.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattcell.session import materialize

Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call, as an array of texts; empty if it is valid.

    ``invalid_json``, ``not_an_object``, ``unknown_tool``, ``missing:<parameter>``, ``type:<parameter>`` and
    ``unknown:<parameter>``. ``schemas`` maps tools to parameters to (type, required).
    """
    value = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    found = F.array(F.lit("unknown_tool"))
    for tool, parameters in schemas.items():
        checks = []
        for key, (kind, required) in parameters.items():
            part = F.try_variant_get(value, f"$['{key}']", "variant")
            typed = F.schema_of_variant(part)
            fits = F.lit(False)
            for start in KINDS[kind]:
                fits = fits | F.startswith(typed, F.lit(start))
            absent = part.isNull() | (typed == "VOID")
            checks.append(F.when(absent, F.lit(f"missing:{key}") if required else F.lit(None)).when(~fits, F.lit(f"type:{key}")))
        extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(k) for k in parameters]) if parameters else none))
        checked = F.concat(F.array_compact(F.array(*checks)) if checks else none, F.transform(extra, lambda k: F.concat(F.lit("unknown:"), k)))
        found = F.when(name == tool, checked).otherwise(found)
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    return (
        F.when(value.isNull(), F.array(F.lit("invalid_json")))
        .when(~is_object, F.array(F.lit("not_an_object")))
        .otherwise(found)
    )


def levels(calls: DataFrame) -> DataFrame:
    """``conv, call_id, level, order_status`` of calls ``conv, call_id, after``.

    Level 0 uses no result. ``after`` that names no call of the conversation counts as none, with status
    ``missing``; calls on or behind a cycle get a null level and status ``cycle``.
    """
    known = calls.select("conv", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = calls.join(known, ["conv", "after"], "left")
    status = F.when(F.col("after").isNotNull() & F.col("known").isNull(), "missing").otherwise("ok")
    up = F.when(F.col("known"), F.col("after"))
    state = state.select("conv", "call_id", up.alias("up"), up.isNotNull().cast("long").alias("level"), status.alias("order_status"))
    state = materialize(state, "levels")
    most = state.count()
    while True:
        counts = state.agg(F.count("up").alias("open"), F.min(F.when(F.col("up").isNotNull(), F.col("level"))).alias("low")).first()
        # A chain that still goes on after as many steps as there are calls never ends.
        if not counts["open"] or counts["low"] > most:
            break
        ahead = state.select("conv", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = state.join(ahead, ["conv", "up"], "left").select(
            "conv", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), "order_status"
        )
        state = materialize(state, "levels")
    endless = F.col("up").isNotNull()
    return state.select(
        "conv", "call_id", F.when(~endless, F.col("level")).alias("level"), F.when(endless, "cycle").otherwise(F.col("order_status")).alias("order_status")
    )


def canonical_json(**fields: Column) -> Column:
    """Text fields and parsed JSON as one JSON object: keys sorted, no spaces, null fields left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def tool_messages(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and each result, in the form they are trained on.

    ``calls`` has ``conv, call_id, seq, name, arguments (JSON text), after``, ``results`` has
    ``conv, call_id, seq, content``. Returns ``conv, call_id, seq, kind, level, status, json``. Status of a
    call: ``ok``, ``no_result``, else what is wrong, joined by commas; of a result: ``ok`` or ``no_call``. Calls and
    results with a null conversation or identifier are left out. Of several calls or results with
    one identifier the first by seq and content counts, the others have status ``repeated`` and no level.
    """
    def first(rows: DataFrame, *order: str) -> DataFrame:
        ranked = W.partitionBy("conv", "call_id").orderBy("seq", *order)
        return rows.where("conv IS NOT NULL AND call_id IS NOT NULL").withColumn("nth", F.row_number().over(ranked))

    calls = materialize(first(calls, "name", "arguments", "after"), "calls")
    results = materialize(first(results, "content"), "results")
    own = calls.where("nth = 1")
    placed = own.join(levels(own.select("conv", "call_id", "after")), ["conv", "call_id"])
    answers = results.where("nth = 1").select("conv", "call_id", F.lit(True).alias("answered"))
    linked = placed.hint("shuffle_hash").join(answers.hint("shuffle_hash"), ["conv", "call_id"], "left")
    wrong = argument_errors(F.col("name"), F.col("arguments"), schemas)
    wrong = F.concat(wrong, F.array_compact(F.array(
        F.when(F.col("order_status") != "ok", F.concat(F.lit("after:"), F.col("order_status"))),
        F.when(F.col("answered").isNull(), F.lit("no_result")),
    )))
    status = F.when(F.size(wrong) > 0, F.array_join(wrong, ",")).otherwise("ok")
    linked = linked.select("conv", "call_id", "seq", (F.col("level") * 2).alias("level"), status.alias("status"), "name", "arguments", "after")
    twice = calls.where("nth > 1").select("conv", "call_id", "seq", F.lit(None).cast("long").alias("level"), F.lit("repeated").alias("status"), "name", "arguments", "after")
    rows = linked.unionByName(twice)
    parsed = F.try_parse_json("arguments")
    call_json = canonical_json(
        role=F.lit("assistant"), id=F.col("call_id"), name=F.col("name"), arguments=parsed,
        arguments_text=F.when(parsed.isNull(), F.col("arguments")), after=F.col("after"),
    )
    out = rows.select("conv", "call_id", "seq", F.lit("call").alias("kind"), "level", "status", call_json.alias("json"))
    asked = placed.select("conv", "call_id", (F.col("level") * 2 + 1).alias("level"), F.lit(True).alias("asked"))
    back = results.hint("shuffle_hash").join(asked.hint("shuffle_hash"), ["conv", "call_id"], "left")
    status = F.when(F.col("nth") > 1, "repeated").when(F.col("asked").isNull(), "no_call").otherwise("ok")
    level = F.when(F.col("nth") == 1, F.col("level"))
    result_json = canonical_json(role=F.lit("tool"), id=F.col("call_id"), content=F.col("content"))
    back = back.select("conv", "call_id", "seq", F.lit("result").alias("kind"), level.alias("level"), status.alias("status"), result_json.alias("json"))
    return out.unionByName(back)
