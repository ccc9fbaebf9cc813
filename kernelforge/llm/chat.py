"""Chat formatting with tool calls linked to their results.

Calls and results meet by a hash join on (conversation, identifier), where the
first call of an identifier counts. A result depends on the message that holds its call, a call
on the results (or calls) named in its depends_on. Levels order them: chains are followed by pointers of doubling
reach, and messages with several dependencies are peeled off level by level, each round a distributed step, so a long conversation
is never gathered into one task, and a chain of n messages takes log2(n) rounds. Arguments are checked against the tool's
JSON Schema (KEYWORDS), and every message is one line of canonical JSON as in RFC 8785:
keys in order of UTF-16, no spaces, numbers as ECMAScript writes them (integers keep all digits).

Edge cases: a result without a call, a call without a result, a repeated identifier, unknown tools,
unparsable or ill-typed arguments (NaN and infinite numbers and lone surrogates are no JSON) and cycles are reported in ``problems``, not
dropped; messages on or behind a cycle have level null; null texts are JSON null;
rows without conversation or turn take no part in links but are returned; repeated
rows stand at the same place and are returned each; extra columns play no part.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.llm.shared import table

CALL = "struct<id:string,name:string,arguments:string,depends_on:array<string>>"
_KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: What a schema may say; other keywords say nothing here.
KEYWORDS = ("type", "properties", "required", "additionalProperties", "items", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "pattern", "anyOf")


def _is(value: object, kind: str) -> bool:
    if kind not in _KINDS:
        raise ValueError(f"a schema names the unknown type {kind}")
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _KINDS[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def violations(value: object, schema: object, at: str = "") -> list[str]:
    """What is wrong with a value, with its path. A schema may be a bare type name; objects are closed unless additionalProperties is true or a schema."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at or 'value'} is not allowed"]
    schema, name, wrong = {"type": schema} if isinstance(schema, str) else schema, at or "value", []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return [f"{name} is not {' or '.join(kinds)}"]
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        wrong.append(f"{name} is not one of the values")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        wrong.append(f"{name} is not the value")
    if "anyOf" in schema and all(violations(value, x, at) for x in schema["anyOf"]):
        wrong.append(f"{name} fits no alternative")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            wrong.append(f"{name} is out of range")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            wrong.append(f"{name} has a wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            wrong.append(f"{name} does not match")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            wrong.append(f"{name} has a wrong length")
        if "items" in schema:
            wrong += [w for i, x in enumerate(value) for w in violations(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        fields, rest = schema.get("properties", {}), schema.get("additionalProperties", "properties" not in schema)
        path = f"{at}." if at else ""
        wrong += [f"missing {path}{k}" for k in sorted(schema.get("required", [])) if k not in value]
        if rest is False:
            wrong += [f"unknown {path}{k}" for k in sorted(value) if k not in fields]
        for k in sorted(value):
            if k in fields or not isinstance(rest, bool):
                wrong += violations(value[k], fields.get(k, rest), path + k)
    return wrong


def _refuse(name: str):
    raise ValueError(name)


def check(name: str | None, arguments: str | None, schemas: dict) -> tuple[object, list[str]]:
    """The parsed arguments and what is wrong with them; arguments that are no JSON stay text."""
    try:
        value = json.loads(arguments or "", parse_constant=_refuse)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return arguments, ["arguments are not JSON"]
    if name not in schemas:
        return value, ["unknown tool"]
    if not isinstance(value, dict):
        return value, ["arguments are not an object"]
    return value, violations(value, {"type": "object", "properties": {}} | schemas[name])


def number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if not math.isfinite(x):
        raise ValueError("no JSON number")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    n = len(text) + exponent
    text = text.rstrip("0")
    k, minus = len(text), "-" if sign else ""
    if k <= n <= 21:
        return minus + text + "0" * (n - k)
    if 0 < n <= 21:
        return f"{minus}{text[:n]}.{text[n:]}"
    if -6 < n <= 0:
        return f"{minus}0.{'0' * -n}{text}"
    return f"{minus}{text[0]}{'.' * (k > 1)}{text[1:]}e{'+' if n > 0 else '-'}{abs(n - 1)}"


def canonical(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, turn, level): the longest way to a message that depends on nothing, which has level 0; messages on or behind a cycle are left out.

    Messages with one dependency follow pointers that double their reach each round, to one that has none or several; only those with
    several are peeled off round by round, over edges that the pointers have shortened.
    """
    edges, place = table(edges.distinct(), "links"), ["conv", "turn"]
    degree = table(edges.groupBy(*place).agg(F.count("*").alias("n"), F.min("on").alias("to")), "degrees")
    single, many = degree.where("n = 1"), degree.where("n > 1").select(*place)
    jump = single.select(*place, "to", F.lit(1).cast("long").alias("dist"))
    for _ in range(single.count().bit_length() + 1):
        further = jump.select("conv", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"))
        moved = jump.join(further, ["conv", "to"], "left")
        jump = table(moved.select(*place, F.coalesce("next", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("open")), "pointers")
        if not jump.where("open").limit(1).count():
            break
    # After as many rounds as there are doublings, a pointer that still meets a single dependency goes round.
    good = table(jump.select(*place, "to", "dist").join(single.select("conv", F.col("turn").alias("to")), ["conv", "to"], "left_anti").select(*place, "to", "dist"), "reached")
    bound = degree.select("conv", F.col("turn").alias("to"), F.lit(True).alias("bound"))
    known = table(many.withColumn("level", F.lit(0).cast("long")).limit(0), "level")
    if many.limit(1).count():
        short = good.select("conv", F.col("turn").alias("on"), "to", "dist")
        state = edges.join(many, place, "left_semi").join(short, ["conv", "on"], "left").select(*place, F.coalesce("to", "on").alias("to"), (1 + F.coalesce("dist", F.lit(0))).cast("long").alias("w"))
        state = table(state.join(bound, ["conv", "to"], "left").select(*place, "to", "w", F.when(F.col("bound").isNull(), F.col("w")).alias("value")), "junctions")
        while True:
            ready = state.groupBy(*place).agg(F.max("value").alias("level"), F.sum(F.col("value").isNull().cast("int")).alias("open")).where("open = 0")
            ready = table(ready.select(*place, "level"), "level")
            if not ready.limit(1).count():
                break
            known = known.union(ready)
            left = state.join(ready.select(*place), place, "left_anti").join(ready.select("conv", F.col("turn").alias("to"), "level"), ["conv", "to"], "left")
            state = table(left.select(*place, "to", "w", F.coalesce("value", F.col("level") + F.col("w")).alias("value")), "junctions")
    ends = good.join(bound, ["conv", "to"], "left").join(known.select("conv", F.col("turn").alias("to"), "level"), ["conv", "to"], "left")
    ends = ends.where("bound is null or level is not null").select(*place, (F.col("dist") + F.coalesce("level", F.lit(0))).alias("level"))
    free = nodes.join(degree.select(*place), place, "left_anti").select(*place, F.lit(0).cast("long").alias("level"))
    return free.union(known).union(ends).select(*place, F.col("level").cast("int").alias("level"))


def link(messages: DataFrame, schemas: dict, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", calls: str = "calls", result_for: str = "result_for") -> DataFrame:
    """conv_id, turn, role, level, n_calls, linked, problems and json, a row for each message.

    calls is an array of CALL, result_for the identifier that a message answers.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(calls).cast(f"array<{CALL}>").alias("calls"), F.col(result_for).alias("result_for"))
    made = rows.select("conv", "turn", F.explode("calls").alias("c")).where("c.id is not null")
    first = made.groupBy("conv", F.col("c.id").alias("id")).agg(F.min("turn").alias("on"))
    answers = rows.where("result_for is not null").select("conv", "turn", F.col("result_for").alias("id"))
    linked = answers.join(first, ["conv", "id"])
    results = linked.groupBy("conv", "id").agg(F.min("turn").alias("result"))
    wants = made.select("conv", "turn", F.explode("c.depends_on").alias("id")).join(first, ["conv", "id"]).join(results, ["conv", "id"], "left")
    edges = linked.where("on <> turn").select("conv", "turn", "on").union(wants.select("conv", "turn", F.coalesce("result", "on").alias("on")))
    level = levels(edges, rows.where("conv is not null and turn is not null").select("conv", "turn").distinct())
    known = linked.select("conv", "turn", F.lit(True).alias("linked")).distinct()
    answered = made.join(results, [made["conv"] == results["conv"], made["c.id"] == results["id"]], "left").groupBy(made["conv"], made["turn"]).agg(F.sum(F.when(results["id"].isNull(), 1).otherwise(0)).alias("unanswered"))
    again = made.select("conv", "turn", F.col("c.id").alias("id")).join(first, ["conv", "id"]).where("turn > on").groupBy("conv", "turn").agg(F.sort_array(F.collect_set("id")).alias("again"))
    whole = rows.join(again, ["conv", "turn"], "left").join(known, ["conv", "turn"], "left").join(answered, ["conv", "turn"], "left").join(level, ["conv", "turn"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                problems, each, ids = [], [], set(r["again"] or [])
                for c in r["calls"] or []:
                    if c is None:
                        continue
                    if c["id"] in ids:
                        problems.append(f"{c['id']}: repeated identifier")
                    ids.add(c["id"])
                    value, wrong = check(c["name"], c["arguments"], schemas)
                    problems += [f"{c['id']}: {w}" for w in wrong]
                    each.append({"arguments": value, "id": c["id"], "name": c["name"]} | ({"depends_on": c["depends_on"]} if c["depends_on"] else {}))
                if r["result_for"] is not None and not r["linked"]:
                    problems.append("result without call")
                if r["unanswered"]:
                    problems.append(f"{r['unanswered']} calls without result")
                if r["level"] is None and r["conv"] is not None and r["turn"] is not None:
                    problems.append("cycle")
                body = {"content": r["text"], "role": r["role"]} | ({"tool_calls": each} if each else {}) | ({"tool_call_id": r["result_for"]} if r["result_for"] is not None else {})
                out.append((len(each), bool(r["linked"]), problems, canonical(body)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), batch.column("role"), batch.column("level"), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string())], [conv, turn, role, "level", "n_calls", "linked", "problems", "json"])

    kind = messages.schema[conv].dataType.simpleString()
    return whole.mapInArrow(write, f"{conv} {kind}, {turn} long, {role} string, level int, n_calls int, linked boolean, problems array<string>, json string")
