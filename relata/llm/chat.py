"""Chat formatting: tool calls and their results linked, ordered, validated and written as canonical JSON.

A message's text may hold calls, ``<tool_call>{"id": ..., "name": ..., "arguments": {...}, "after": [...]}</tool_call>``;
a message of role ``tool`` is a result, ``{"id": ..., "content": ...}``. Messages are parsed one by one; calls and
results are then joined on conversation and identifier, and their levels are found by joins, a call one above the
calls it comes after: chains of calls after one other by pointer doubling, the rest round by round. No conversation
is ever gathered into one task: the order is given as columns. from_turns() makes calls and results of plain turns.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, written
from .quality import words_of

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)

#: Schemas of known tools, a subset of JSON Schema: type, enum, minimum, maximum, minLength, maxLength, required,
#: properties, additionalProperties, items.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}, "method": {"enum": ["GET", "HEAD"]}}},
    "reply": {"type": "object", "required": ["text", "words"], "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 64}}, "additionalProperties": False},
}

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no white space and no escapes but the necessary ones; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What of a value its schema forbids."""
    kind = schema.get("type")
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if kind in ("integer", "number"):
        if not number or (kind == "integer" and value != int(value)):
            return [f"{at}: not {kind}"]
    elif kind in TYPES and not isinstance(value, TYPES[kind]):
        return [f"{at}: not {kind}"]
    if "enum" in schema and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        return [f"{at}: not in enum"]
    size = value if number else len(value) if isinstance(value, str) else None
    lower, upper = ("minimum", "maximum") if number else ("minLength", "maxLength")
    if size is not None and (size < schema.get(lower, size) or size > schema.get(upper, size)):
        return [f"{at}: not in bounds"]
    out = []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += faults(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in faults(v, schema["items"], f"{at}[{i}]")]
    return out


def _object(text: str) -> dict | None:
    def refuse(name):
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=refuse)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str, list[dict], str | None]:
    """(canonical message, its calls, the identifier that it answers)."""
    calls, answers = [], None
    content = text
    if role == "tool":
        value = _object(text or "")
        if value and isinstance(value.get("id"), str):
            answers, content = value["id"], value.get("content")
    elif text and "<tool_call>" in text:
        for raw in CALL.findall(text):
            value = _object(raw)
            name = value.get("name") if value else None
            arguments = value.get("arguments") if value else None
            if not value or not isinstance(value.get("id"), str) or not isinstance(name, str):
                calls.append({"id": None, "name": None, "after": [], "fault": "not a call", "json": raw})
                continue
            after = value.get("after") if isinstance(value.get("after"), list) else []
            found = faults(arguments, schemas[name]) if name in schemas else ["unknown tool"]
            calls.append({"id": value["id"], "name": name, "after": [x for x in after if isinstance(x, str)], "fault": found[0] if found else None, "json": canonical({"arguments": arguments, "id": value["id"], "name": name})})
        content = CALL.sub("", text)
    message = {"content": content, "role": role} | ({"tool_call_id": answers} if answers is not None else {}) | ({"tool_calls": [json.loads(c["json"]) if c["id"] is not None else c["json"] for c in calls]} if calls else {})
    return canonical(message), calls, answers


def from_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, turn, role and text, where every user turn is a call and every assistant turn a result.

    The user turn t calls ``reply`` with its text and number of words, under the identifier ``t`` and the turn's
    number, after the call of turn t - 2; the assistant turn t answers the call of turn t - 1. The identifier tells
    both ends of a link, so that no conversation has to be sorted. Where there is no such call the identifier points
    nowhere. A null text gives a call without the argument, which is invalid, and a result without content. Other
    roles stay as they are.
    """
    at = lambda back: F.concat(F.lit("t"), (F.col(turn) - back).cast("string"))
    json_of = lambda x: F.replace(F.to_json(x), F.lit("<"), F.lit("\\u003c"))  # noqa: E731  no text can end the call
    words = F.size(words_of(F.coalesce("text", F.lit(""))))
    call = F.struct(F.struct(F.col("text").alias("text"), words.alias("words")).alias("arguments"), F.array(at(2)).alias("after"), at(0).alias("id"), F.lit("reply").alias("name"))
    result = F.struct(at(1).alias("id"), F.col("text").alias("content"))
    text = F.when(F.col("role") == "user", F.concat(F.lit("<tool_call>"), json_of(call), F.lit("</tool_call>"))).when(F.col("role") == "assistant", json_of(result)).otherwise(F.col("text"))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return messages.select(conv, turn, role.alias("role"), text.alias("text"))


def format_messages(messages: DataFrame, schemas: dict[str, dict] = SCHEMAS, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row for each message: conv, turn, role, message_json, n_calls, n_invalid, answers, status, order_turn, level.

    n_invalid counts calls that are no objects with an identifier and a name, name no known tool, or have
    arguments against its schema. status is ``plain``, ``call``, ``linked`` (a result with its call) or
    ``orphan``. Of several calls with one identifier in a conversation the earliest counts. Ordered by
    (order_turn, level, turn) calls come before their results, and after the results of the calls in their
    ``after``; level is null for calls on a cycle, for those after them and for their results. A null role or text
    stays null in the JSON; rows with a null conversation link with nothing; repeated rows stay repeated, and of
    equal first turns any may give its ``after``. A text is parsed whole, however long; one message has to fit a
    worker's memory. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            parsed = [parse(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([p[0] for p in parsed], pa.string()), pa.array([p[2] for p in parsed], pa.string()), pa.array([len(p[1]) for p in parsed], pa.int32()), pa.array([sum(c["fault"] is not None for c in p[1]) for p in parsed], pa.int32()), pa.array([[{"id": c["id"], "after": c["after"]} for c in p[1]] for p in parsed], pa.list_(pa.struct([("id", pa.string()), ("after", pa.list_(pa.string()))])))],
                names=["conv_", "turn_", "role", "message_json", "answers", "n_calls", "n_invalid", "calls_"],
            )

    rows = messages.select(F.col(conv).alias("conv_"), F.col(turn).alias("turn_"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_", "turn_")]
    parsed = written(rows.mapInArrow(run, f"conv_ {kinds[0]}, turn_ {kinds[1]}, role string, message_json string, answers string, n_calls int, n_invalid int, calls_ array<struct<id:string,after:array<string>>>"), "messages")
    calls = parsed.where("conv_ IS NOT NULL AND n_calls > 0").select("conv_", "turn_", F.explode("calls_").alias("c")).where("c.id IS NOT NULL")
    calls = calls.groupBy("conv_", F.col("c.id").alias("id")).agg(F.min("turn_").alias("call_turn"), F.min_by("c.after", "turn_").alias("after"))
    levels = written(calls, "calls")
    edges = levels.select("conv_", "id", F.explode(F.array_distinct("after")).alias("before")).join(levels.select("conv_", F.col("id").alias("before")), ["conv_", "before"])
    if edges.isEmpty():
        levels = levels.select("conv_", "id", "call_turn", F.lit(0).alias("call_level"), F.col("call_turn").alias("order_turn"))
    else:
        edges = written(edges, "edges")
        nodes = levels.select("conv_", "id", "call_turn")
        waits = edges.groupBy("conv_", "id").agg(F.count("*").alias("n_"), F.min("before").alias("to_"))
        # calls after one other point to it; pointers are doubled until they reach a call after none or several
        jump = written(waits.where("n_ = 1").join(nodes, ["conv_", "id"]).select("conv_", "id", "to_", F.lit(1).cast("long").alias("steps_"), F.col("call_turn").alias("far_")), "jump")
        for _ in range(jump.count().bit_length() + 1):  # what still moves then is on a cycle or after one
            on = jump.select("conv_", F.col("id").alias("to_"), F.col("to_").alias("next_"), F.col("steps_").alias("more_"), F.col("far_").alias("then_"))
            if jump.join(on, ["conv_", "to_"], "left_semi").isEmpty():
                break
            moved = jump.join(on, ["conv_", "to_"], "left")
            jump = written(moved.select("conv_", "id", F.coalesce("next_", "to_").alias("to_"), (F.col("steps_") + F.coalesce("more_", F.lit(0))).alias("steps_"), F.greatest("far_", "then_").alias("far_")), "jump")
        # Kahn for the rest: a call gets its level when all it waits for have theirs; a level is two, a call's and its
        # results'. A round joins only the calls settled in the one before, and what some of them still wait for
        heads = jump.withColumnRenamed("id", "before")
        several = waits.where("n_ > 1").select("conv_", "id", "n_")
        rest = edges.join(several, ["conv_", "id"]).join(heads, ["conv_", "before"], "left")
        rest = written(rest.select("conv_", "id", "n_", F.coalesce("to_", "before").alias("head_"), (F.coalesce("steps_", F.lit(0)) + 1).alias("steps_"), "far_"), "rest")
        new = written(nodes.join(waits, ["conv_", "id"], "left_anti").select("conv_", "id", F.lit(0).cast("long").alias("call_level"), F.col("call_turn").alias("order_turn")), "level")
        partial, done = None, None
        while not new.isEmpty():
            done = appended(new, done)
            known = new.select("conv_", F.col("id").alias("head_"), F.col("call_level").alias("before_level"), F.col("order_turn").alias("before_turn"))
            gained = rest.join(known, ["conv_", "head_"]).select("conv_", "id", "n_", F.lit(1).cast("long").alias("done_"), (F.col("before_level") + 2 * F.col("steps_")).alias("call_level"), F.greatest("before_turn", "far_").alias("least_turn"))
            gained = gained if partial is None else gained.unionByName(partial)
            partial = written(gained.groupBy("conv_", "id", "n_").agg(F.sum("done_").alias("done_"), F.max("call_level").alias("call_level"), F.max("least_turn").alias("least_turn")), "partial")
            new = written(partial.where("done_ = n_").join(nodes, ["conv_", "id"]).select("conv_", "id", "call_level", F.greatest("call_turn", "least_turn").alias("order_turn")), "level")
            partial = partial.where("done_ < n_")
        done = done if done is not None else new
        ends = done.select("conv_", F.col("id").alias("to_"), "call_level", "order_turn")
        chains = jump.join(ends, ["conv_", "to_"]).select("conv_", "id", (F.col("call_level") + 2 * F.col("steps_")).alias("call_level"), F.greatest("order_turn", "far_").alias("order_turn"))
        levels = nodes.join(done.unionByName(chains).withColumn("call_level", F.col("call_level").cast("int")), ["conv_", "id"], "left")
    own = parsed.where("conv_ IS NOT NULL AND n_calls > 0").select("conv_", "turn_", F.explode("calls_.id").alias("id")).join(levels, ["conv_", "id"]).where(F.col("turn_") == F.col("call_turn"))
    own = own.groupBy(F.col("conv_").alias("c_"), F.col("turn_").alias("t_")).agg(F.when(F.max(F.col("call_level").isNull()), None).otherwise(F.max("call_level")).alias("own_level"), F.max("order_turn").alias("own_turn"))
    links = levels.select(F.col("conv_").alias("l_"), F.col("id").alias("link_id"), "call_turn", F.col("call_level").alias("link_level"), F.col("order_turn").alias("link_turn"))
    special = parsed.where("n_calls > 0 OR answers IS NOT NULL").join(own, (F.col("conv_") == F.col("c_")) & (F.col("turn_") == F.col("t_")), "left").join(links, (F.col("conv_") == F.col("l_")) & (F.col("answers") == F.col("link_id")), "left")
    linked = F.col("link_id").isNotNull()
    out = ["conv_", "turn_", "role", "message_json", "n_calls", "n_invalid", "answers"]
    special = special.select(*out, F.when(linked, "linked").when(F.col("answers").isNotNull(), "orphan").otherwise("call").alias("status"), F.when(linked, F.greatest("turn_", "link_turn", "call_turn")).otherwise(F.greatest("turn_", "own_turn")).alias("order_turn"), F.when(linked, F.col("link_level") + 1).when(F.col("c_").isNotNull(), F.col("own_level")).otherwise(0).alias("level"))
    plain = parsed.where("n_calls = 0 AND answers IS NULL").select(*out, F.lit("plain").alias("status"), F.col("turn_").alias("order_turn"), F.lit(0).alias("level"))
    return plain.unionByName(special).withColumnsRenamed({"conv_": conv, "turn_": turn})
