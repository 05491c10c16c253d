"""Chat formatting: links tool calls to results, orders them, validates arguments, writes canonical JSON.

Calls and results meet in a hash join on their identifier; a conversation is never gathered into
one task, so one with a third of all turns is no hot group.  The topological order is by levels
(Kahn): a call's level is one above the highest call whose result its arguments name, and rounds go
on while calls wait for others, as many as the longest chain of references.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import cut_lineage

#: An argument ``{"$result": "<call id>"}`` stands for the result of that call.
_REFERENCE = r'"\$result"\s*:\s*"([^"]+)"'
_EMBEDDED = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,content:string>"
EVENT = ("conv_id", "turn", "kind", "call_id", "name", "arguments", "content")

#: The schema of the call that a user's turn in a plain dialogue stands for.
REPLY_SCHEMA = {"reply": {"type": "object", "required": ["prompt"], "additionalProperties": False,
                          "properties": {"prompt": {"type": "string", "minLength": 1}}}}


def dialogue_events(turns: DataFrame) -> DataFrame:
    """Events of (conv_id, turn, role, text): calls, results and plain messages.

    A text that is a JSON object with ``tool_calls`` holds calls, one with ``tool_call_id`` a result.
    In other texts a user's turn is a call of ``reply`` with the text as its prompt, identified as
    ``conv_id:turn``; the assistant's next turn is its result; other roles are messages with the
    role as name.  Null texts count as empty, null ids and turns as the text ``null``.
    """
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    looks = F.ltrim("text").startswith("{")
    t = t.withColumn("e", F.when(looks, F.from_json("text", _EMBEDDED)))
    has_calls, has_result = F.coalesce(F.size("e.tool_calls") > 0, F.lit(False)), F.col("e.tool_call_id").isNotNull()
    none = F.lit(None).cast("string")

    def turn_id(turn: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.coalesce(turn.cast("string"), F.lit("null")))

    def event(kind, call_id, name, arguments, content):
        return F.struct(kind.alias("kind"), call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), content.alias("content"))

    prompt = F.to_json(F.struct(F.col("text").alias("prompt")))
    called = F.transform("e.tool_calls", lambda c: event(F.lit("call"), c["id"], c["name"], c["arguments"], none))
    one = (F.when(has_result, event(F.lit("result"), F.col("e.tool_call_id"), none, none, F.coalesce("e.content", F.lit(""))))
           .when(F.col("role") == "user", event(F.lit("call"), turn_id(F.col("turn")), F.lit("reply"), prompt, none))
           .when(F.col("role") == "assistant", event(F.lit("result"), turn_id(F.col("turn") - 1), none, none, F.col("text")))
           .otherwise(event(F.lit("message"), none, F.col("role"), none, F.col("text"))))
    return t.select("conv_id", "turn", F.explode(F.when(has_calls, called).otherwise(F.array(one))).alias("v")).select("conv_id", "turn", "v.*")


def _spread() -> Column:
    """The identifier to join on; events without one need no partner and are spread, so that they don't meet in one task."""
    alone = (F.col("kind") == "message") | F.col("call_id").isNull()
    return F.when(alone, F.concat(F.lit("\x00"), F.col("row_id").cast("string"))).otherwise(F.col("call_id"))


def link(events: DataFrame) -> DataFrame:
    """Events with ``row_id`` and ``status``: linked, open (a call without result), orphan (a result without call),
    repeated (an identifier's later calls or results, by conversation, turn and row), unnamed (no identifier), message.
    """
    e = events.select(*EVENT).withColumn("row_id", F.monotonically_increasing_id())
    e = cut_lineage(e, "chat-events")
    place = F.struct("conv_id", "turn", "row_id")
    ends = (e.filter("kind <> 'message' AND call_id IS NOT NULL").groupBy(F.col("call_id").alias("l_id"))
            .agg(F.min(F.when(F.col("kind") == "call", place)).alias("call"), F.min(F.when(F.col("kind") == "result", place)).alias("result")))
    own = F.when(F.col("kind") == "call", F.col("call.row_id")).otherwise(F.col("result.row_id"))
    status = (F.when(F.col("kind") == "message", "message").when(F.col("call_id").isNull(), "unnamed")
              .when(own != F.col("row_id"), "repeated").when(F.col("call").isNull(), "orphan")
              .when(F.col("result").isNull(), "open").otherwise("linked"))
    return e.withColumn("key", _spread()).join(ends, F.col("key") == F.col("l_id"), "left").withColumn("status", status).select(*e.columns, "status")


def levels(linked: DataFrame) -> DataFrame:
    """call_id, level of every call that can be ordered: not on a cycle, and not waiting for a call without result."""
    calls = linked.filter("kind = 'call' AND status IN ('linked', 'open')")
    named = F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(_REFERENCE), F.lit(1)))
    calls = calls.select("call_id", "status", named.alias("needs"))
    waits = cut_lineage(calls.filter("size(needs) > 0").select("call_id", F.size("needs").alias("n"), F.explode("needs").alias("need")), "chat-waits")
    done = calls.filter("size(needs) = 0").select("call_id", F.lit(0).cast("long").alias("level"))
    while not waits.isEmpty():
        done = cut_lineage(done, "chat-levels")
        ended = linked.filter("kind = 'call' AND status = 'linked'").select(F.col("call_id").alias("ended"))
        ready = done.join(ended, F.col("call_id") == F.col("ended"), "left_semi").select(F.col("call_id").alias("r_id"), "level")
        new = (waits.join(ready, F.col("need") == F.col("r_id")).groupBy("call_id", "n").agg(F.count("*").alias("met"), F.max("level").alias("top"))
               .filter("met = n").select("call_id", (F.col("top") + 1).alias("level")))
        new = cut_lineage(new, "chat-new")
        if new.isEmpty():
            break
        done = done.unionByName(new)
        waits = cut_lineage(waits.join(new.select(F.col("call_id").alias("n_id")), F.col("call_id") == F.col("n_id"), "left_anti"), "chat-waits")
    return done


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks a JSON schema (type, required, properties, additionalProperties, enum, bounds, items)."""
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
    want = schema.get("type")
    if want and (not isinstance(value, kinds[want]) or isinstance(value, bool) and want in ("integer", "number")):
        return [f"{at}: not of type {want}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the allowed values")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        found.append(f"{at}: length out of bounds")
    if isinstance(value, (int, float)) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        found.append(f"{at}: value out of bounds")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            found += [f"{at}.{k}: not allowed" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                found += violations(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    return found


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def serialise(kind: str, call_id, name, arguments, content, schemas: dict) -> tuple[list[str], str]:
    """(violations, canonical JSON) of one event; arguments that are no JSON stay as text and are a violation."""
    if kind == "message":
        return [], canonical({"content": content, "role": name})
    if kind == "result":
        return [], canonical({"content": content, "id": call_id})
    try:
        value = json.loads(arguments) if arguments is not None else None
        found = violations(value, schemas[name]) if name in schemas else ["$: unknown tool"]
    except (ValueError, RecursionError):
        value, found = arguments, ["$: no JSON"]
    return found, canonical({"arguments": value, "id": call_id, "name": name})


def format_chat(turns: DataFrame, schemas: dict = REPLY_SCHEMA) -> DataFrame:
    """One row per event: conv_id, turn, kind, call_id, name, status, level, step, errors, json.

    ``step`` orders a conversation topologically (ties by turn): twice a call's level, its result one
    later; it is null for calls on a cycle or waiting for what never comes, for their results, and
    for messages.  Repeated rows stay, marked ``repeated``; an empty table gives no rows; columns
    besides conv_id, turn, role and text are ignored.
    """
    linked = cut_lineage(link(dialogue_events(turns)), "chat-linked")
    order = levels(linked).withColumnRenamed("call_id", "o_id")
    rows = linked.withColumn("key", _spread()).join(order, F.col("key") == F.col("o_id"), "left")
    live = F.col("status").isin("linked", "open")
    rows = rows.withColumn("level", F.when(live, F.col("level")))
    rows = rows.withColumn("step", 2 * F.col("level") + (F.col("kind") == "result").cast("long"))

    def run(frames):
        for f in frames:
            made = [serialise(*v, schemas) for v in zip(f["kind"], f["call_id"], f["name"], f["arguments"], f["content"])]
            out = f[["conv_id", "turn", "kind", "call_id", "name", "status", "level", "step"]].copy()
            out["errors"] = [m[0] for m in made]
            out["json"] = [m[1] for m in made]
            yield out.astype({"level": "Int64", "step": "Int64", "conv_id": "Int64", "turn": "Int64"})

    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "kind", "call_id", "name", "arguments", "content", "status", "level", "step")
    return rows.mapInPandas(run, "conv_id long, turn long, kind string, call_id string, name string, status string, level long, step long, errors array<string>, json string")
