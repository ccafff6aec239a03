"""Chat formatting: links tool calls with their results, orders them, validates arguments and serialises.

A message may hold calls ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``, results
``<tool_result>{"id", "content"}</tool_result>`` and the tools of its conversation
``<tools>[{"name", "parameters"}]</tools>``, parameters being a JSON schema; ``after`` names calls whose results a call needs.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import stage, text_slices

_PART = re.compile(r"<tool(s|_call|_result)>(.*?)</tool\1>", re.DOTALL)
_SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces and characters as they are; halves of surrogate pairs are escaped."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def valid(value: Any, schema: dict[str, Any]) -> bool:
    """Whether a value fits a JSON schema of type (one or a list), enum, required, properties, additionalProperties and items.

    A schema may be true or false; a type that JSON doesn't have fits nothing.
    """
    if not isinstance(schema, dict):
        return schema is not False
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(k in _TYPES and isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(name not in value for name in schema.get("required", ())):
            return False
        if schema.get("additionalProperties", True) is False and any(name not in known for name in value):
            return False
        return all(valid(value[name], known[name]) for name in value if name in known)
    if isinstance(value, list) and "items" in schema:
        return all(valid(x, schema["items"]) for x in value)
    return True


def sound(schema: Any) -> bool:
    """Whether a schema is one that valid() can read; those of conversations may be anything."""
    if not isinstance(schema, dict):
        return isinstance(schema, bool)
    kinds, known, required = schema.get("type", []), schema.get("properties", {}), schema.get("required", [])
    if not isinstance(known, dict) or not isinstance(required, list) or not isinstance(schema.get("enum", []), list):
        return False
    if not all(isinstance(x, str) for x in [*(kinds if isinstance(kinds, list) else [kinds]), *required]):
        return False
    return all(sound(x) for x in [*known.values(), schema.get("items", True)])


def _number(digits: str) -> float:
    """A JSON number; one beyond what floats hold is no valid value."""
    value = float(digits)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


def parts(role: str | None, text: str, schemas: dict[str, dict[str, Any]]) -> tuple[str, list[dict[str, Any]], list[str], int, list[dict[str, str]]]:
    """(message, calls, ids of results, malformed parts, tools) of one message; broken parts stay in the content."""
    calls, results, kept, broken, at = [], [], [], 0, 0
    tools: dict[str, str] = {}
    message: dict[str, Any] = {"role": role}
    for m in _PART.finditer(text):
        try:
            held = json.loads(m[2], parse_float=_number, parse_constant=lambda _: 1 / 0)
            if m[1] == "s":
                if not isinstance(held, list) or not all(isinstance(t, dict) and isinstance(t.get("name"), str) and sound(t.get("parameters", True)) for t in held):
                    raise ValueError("no tools")
                told = [{"name": t["name"], "parameters": t.get("parameters", True)} for t in held]
                for tool in told:
                    tools.setdefault(canonical(tool["name"]), canonical(tool["parameters"]))
                message.setdefault("tools", []).extend(told)
                kept.append(text[at : m.start()])
                at = m.end()
                continue
            if not isinstance(held, dict) or not isinstance(held.get("id"), str):
                raise ValueError("no id")
            if m[1] == "_call":
                if not isinstance(held.get("name"), str) or not isinstance(held.get("after", []), list):
                    raise ValueError("no name")
                arguments = held.get("arguments", {})
                fits = held["name"] in schemas and valid(arguments, schemas[held["name"]])
                after = sorted({x for x in held.get("after", []) if isinstance(x, str)})
                calls.append({"id": held["id"], "fits": fits, "after": after, "tool": canonical(held["name"]), "arguments": canonical(arguments)})
                message.setdefault("tool_calls", []).append({"arguments": arguments, "id": held["id"], "name": held["name"]})
            else:
                results.append(held["id"])
                message.setdefault("tool_results", []).append({"content": held.get("content"), "id": held["id"]})
        except (ValueError, ZeroDivisionError, RecursionError):
            broken += 1
            continue
        kept.append(text[at : m.start()])
        at = m.end()
    message["content"] = "".join([*kept, text[at:]])
    return canonical(message), calls, results, broken, [{"tool": name, "parameters": schema} for name, schema in tools.items()]


def parse(role: str | None, text: str, schemas: dict[str, dict[str, Any]]) -> tuple[str, list[dict[str, Any]], list[str], int]:
    """(message, calls, ids of results, malformed parts) of one message; broken parts stay in the content."""
    return parts(role, text, schemas)[:4]


_schema = functools.lru_cache(256)(json.loads)


def _fits(arguments: str, parameters: str | None) -> bool:
    try:
        return parameters is not None and valid(json.loads(arguments), _schema(parameters))
    except RecursionError:
        return False


def _validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with fits, by the parameters that their conversation's tool of that name has."""
    names = [c for c in calls.columns if c not in ("tool", "arguments")]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [_fits(a, p) for a, p in zip(batch.column("arguments").to_pylist(), batch.column("parameters").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fits, pa.bool_()) if c == "fits" else batch.column(c) for c in names], names)

    return calls.join(tools, ["conv_id", "tool"], "left").mapInArrow(f, calls.select(*names).schema)


def format_chats(turns: DataFrame, schemas: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """One row per row of turns (conv_id, turn, role, text): conv_id, turn, role, order_turn, order_level, n_calls,
    n_linked, n_valid, n_results, n_orphans, n_cyclic, n_malformed and message, the canonical JSON.

    Calls and results of a conversation are joined by id, the first call and the first result of an id
    counting. Sorting a conversation by order_turn, order_level and turn puts each result after its call
    and each call after the results that it waits for, and else keeps the turns. Calls on a cycle, or behind
    one, keep their turn and count as cyclic; waiting for an unknown id is no wait. A call is valid if its
    tool is among schemas and its arguments fit; without schemas, if its conversation declares the tool, in whatever
    message, and its arguments fit the parameters declared first. Results without a call are orphans. Null text counts as
    empty, a null role stays null; null conv_ids and turns are formatted but linked with nothing. Repeated
    rows stay. Conversations are never gathered: the keys of joins are a conversation's call ids.
    """
    known, declared = schemas or {}, schemas is None
    names = ["row", "conv_id", "turn", "role", "message", "calls", "results", "malformed"]
    fields, kinds = [("id", pa.string()), ("fits", pa.bool_()), ("after", pa.list_(pa.string()))], [pa.list_(pa.string()), pa.int64()]
    call_ddl, tools_ddl = "id:string,fits:boolean,after:array<string>", ""
    if declared:
        names.append("tools")
        fields += [("tool", pa.string()), ("arguments", pa.string())]
        kinds.append(pa.list_(pa.struct([("tool", pa.string()), ("parameters", pa.string())])))
        call_ddl, tools_ddl = f"{call_ddl},tool:string,arguments:string", ", tools array<struct<tool:string,parameters:string>>"
    kinds = [pa.string(), pa.list_(pa.struct(fields)), *kinds]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches):
            parsed = [parts(role, text.decode(), known) for role, text in zip(piece.column("role").to_pylist(), texts, strict=True)]
            new = [pa.array([p[i] for p in parsed], k) for i, k in enumerate(kinds)]
            row = pa.array([random.getrandbits(63) for _ in parsed], pa.int64())
            yield pa.RecordBatch.from_arrays([row, piece.column("conv_id"), piece.column("turn"), piece.column("role"), *new], names)

    schema = f"row long, conv_id long, turn long, role string, message string, calls array<struct<{call_ddl}>>, results array<string>, malformed long{tools_ddl}"
    source = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = stage(source.mapInArrow(f, schema), "chat-messages")
    whole = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    calls = whole.select("row", "conv_id", "turn", F.explode("calls").alias("c")).select("row", "conv_id", "turn", "c.*")
    results = whole.select("row", "conv_id", "turn", F.explode("results").alias("id"))
    asked = ["tool", "arguments"] if declared else []
    call = calls.groupBy("conv_id", "id").agg(F.min_by(F.struct("row", "turn", "fits", "after", *asked), F.struct("turn", "row")).alias("c"))
    result = results.groupBy("conv_id", "id").agg(F.min_by(F.struct("row", "turn"), F.struct("turn", "row")).alias("r"))
    linked = call.join(result, ["conv_id", "id"], "left").select("conv_id", "id", "c.row", "c.turn", "c.fits", "c.after", F.col("r.row").alias("result_row"), F.col("r.turn").alias("result_turn"), *[f"c.{x}" for x in asked])
    if declared:
        tools = whole.select("conv_id", "turn", F.explode("tools").alias("t")).groupBy("conv_id", "t.tool").agg(F.min_by("t.parameters", F.struct("turn", "t.parameters")).alias("parameters"))
        linked = _validated(linked, tools)
    linked = stage(linked, "chat-calls")

    ordered = _ordered(linked)
    placed = linked.join(ordered, ["conv_id", "id"], "left")
    own = placed.groupBy("row").agg(
        F.max(F.struct("order_turn", "order_level")).alias("key"),
        F.count("result_row").alias("linked"),
        F.count_if("fits").alias("valid"),
        F.count_if(F.col("order_turn").isNull()).alias("cyclic"),
    )
    after = placed.where("result_row IS NOT NULL").groupBy(F.col("result_row").alias("row")).agg(
        F.max(F.struct(F.coalesce("order_turn", "turn").alias("order_turn"), (F.coalesce("order_level", F.lit(0)) + 1).alias("order_level"))).alias("after")
    )
    orphans = results.join(call.select("conv_id", "id"), ["conv_id", "id"], "left_anti").groupBy("row").agg(F.count("*").alias("orphans"))
    out = rows.join(own, "row", "left").join(after, "row", "left").join(orphans, "row", "left")
    key = F.greatest(F.struct(F.col("turn").alias("order_turn"), F.lit(0).alias("order_level")), F.col("key"), F.col("after"))
    out = out.withColumn("place", key)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("turn").isNotNull(), F.col("place.order_turn")).alias("order_turn"),
        F.col("place.order_level").cast("long").alias("order_level"),
        F.size("calls").cast("long").alias("n_calls"),
        count("linked").alias("n_linked"),
        count("valid").alias("n_valid"),
        F.size("results").cast("long").alias("n_results"),
        count("orphans").alias("n_orphans"),
        count("cyclic").alias("n_cyclic"),
        F.col("malformed").alias("n_malformed"),
        "message",
    )


def _ordered(linked: DataFrame) -> DataFrame:
    """(conv_id, id, order_turn, order_level) of calls, layer by layer of what they wait for; those on cycles have no row."""
    waits = linked.select("conv_id", "id", F.explode("after").alias("needs"))
    waits = stage(waits.join(linked.select("conv_id", F.col("id").alias("needs")), ["conv_id", "needs"], "left_semi"), "chat-waits")
    waiting = waits.select("conv_id", "id").distinct()
    done = linked.join(waiting, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"))
    ends = linked.select("conv_id", F.col("id").alias("needs"), "result_turn")
    while not waits.isEmpty():
        met = done.withColumnRenamed("id", "needs").join(ends, ["conv_id", "needs"])
        # a result comes at its own turn or right after its call
        met = met.select("conv_id", "needs", F.greatest(F.struct("order_turn", (F.col("order_level") + 1).alias("order_level")), F.struct(F.col("result_turn").alias("order_turn"), F.lit(0).alias("order_level"))).alias("end"))
        ready = waits.join(met, ["conv_id", "needs"], "left").groupBy("conv_id", "id").agg(F.max("end").alias("end"), F.count_if(F.col("end").isNull()).alias("open")).where("open = 0")
        ready = ready.join(linked.select("conv_id", "id", "turn"), ["conv_id", "id"])
        key = F.greatest(F.struct(F.col("turn").alias("order_turn"), F.lit(0).alias("order_level")), F.struct(F.col("end.order_turn").alias("order_turn"), (F.col("end.order_level") + 1).alias("order_level")))
        layer = stage(ready.select("conv_id", "id", key.alias("k")).select("conv_id", "id", "k.order_turn", "k.order_level"), "chat-layer")
        if layer.isEmpty():
            break
        done = done.unionByName(layer)
        waits = stage(waits.join(layer, ["conv_id", "id"], "left_anti"), "chat-waits")
    return done


def op10_tool_calls(turns: DataFrame) -> DataFrame:
    """Chats whose calls are validated by the schemas that their conversations declare."""
    return format_chats(turns)


#: Turns without calls in DuckDB; the tables hold no others.
ORACLE_SQL = """
SELECT conv_id, turn, role, turn AS order_turn, CAST(0 AS BIGINT) AS order_level,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_valid, CAST(0 AS BIGINT) AS n_results,
       CAST(0 AS BIGINT) AS n_orphans, CAST(0 AS BIGINT) AS n_cyclic, CAST(0 AS BIGINT) AS n_malformed,
       '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS message
FROM conversations
"""
