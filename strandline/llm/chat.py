"""Tool calls in chat logs: calls and results linked, ordered, checked against schemas and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored

CALL, RESULT = "call", "result"


def canonical(value) -> str:
    """JSON by the canonicalisation scheme of RFC 8785: keys by UTF-16 units, shortest numbers (all numbers are doubles), no
    spaces. Half a surrogate pair and numbers beyond a double's range have no such form and are a ``ValueError``."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, int | float) and not isinstance(value, bool):
        try:
            return _number(float(value))
        except OverflowError as e:
            raise ValueError("a number beyond a double's range") from e
    if isinstance(value, str):
        value.encode()  # an error if it isn't whole Unicode
    return json.dumps(value, ensure_ascii=False)


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    if x == 0:
        return "0"
    digits, _, power = repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    n, exponent = len(digits), point
    if n <= exponent <= 21:
        out = digits + "0" * (exponent - n)
    elif 0 < exponent <= 21:
        out = digits[:exponent] + "." + digits[exponent:]
    elif -6 < exponent <= 0:
        out = "0." + "0" * -exponent + digits
    else:
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{exponent - 1:+d}"
    return ("-" if x < 0 else "") + out


_KINDS = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
}


#: The keywords of JSON Schema that are tested, and those that only describe.
_TESTED = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "items", "minItems", "maxItems",
    "uniqueItems", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "anyOf", "allOf", "oneOf", "not", "$ref",
}
_DESCRIPTIVE = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "$defs", "definitions", "deprecated", "readOnly", "writeOnly", "format"}


def check_schema(schema: dict | bool, at: str = "$") -> None:
    """An error if a schema has a keyword that ``faults`` doesn't know, so that none passes untested."""
    if isinstance(schema, bool):
        return
    if unknown := sorted(set(schema) - _TESTED - _DESCRIPTIVE):
        raise ValueError(f"{at}: unknown keywords {unknown}")
    for key in ("properties", "$defs", "definitions"):
        for name, own in schema.get(key, {}).items():
            check_schema(own, f"{at}.{key}.{name}")
    for key in ("items", "additionalProperties", "not"):
        check_schema(schema.get(key, True), f"{at}.{key}")
    for key in ("anyOf", "allOf", "oneOf"):
        for k, own in enumerate(schema.get(key, ())):
            check_schema(own, f"{at}.{key}[{k}]")


def _same(a, b) -> bool:
    return canonical(a) == canonical(b)


def _referred(root: dict, pointer: str):
    if not pointer.startswith("#"):
        raise ValueError(f"reference to another document: {pointer}")
    out = root
    for name in pointer[1:].split("/")[1:]:
        out = out[name.replace("~1", "/").replace("~0", "~")]
    return out


def _bounds(value, schema: dict, at: str) -> Iterator[str]:
    """Numbers, texts and lists against limits."""
    if _KINDS["number"](value):
        low, high = value < schema.get("minimum", value), value > schema.get("maximum", value)
        if low or high or value <= schema.get("exclusiveMinimum", -math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            yield f"{at}: out of bounds"
        if (step := schema.get("multipleOf")) and Fraction(str(value)) % Fraction(str(step)):
            yield f"{at}: not a multiple of {step}"
    elif isinstance(value, str | list):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(low, 0) <= len(value) <= schema.get(high, len(value)):
            yield f"{at}: length {len(value)}"
        if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{at}: not of the pattern"
        if isinstance(value, list) and schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            yield f"{at}: items repeat"
    elif isinstance(value, dict) and not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
        yield f"{at}: {len(value)} properties"


def faults(value, schema: dict | bool, at: str = "$", root: dict | None = None, seen: frozenset[str] = frozenset()) -> Iterator[str]:
    """Where ``value`` breaks a JSON schema (the keywords of ``_TESTED``; references into the schema itself)."""
    if isinstance(schema, bool):
        if not schema:
            yield f"{at}: unknown"
        return
    root = schema if root is None else root
    if "$ref" in schema:
        if schema["$ref"] in seen:
            raise ValueError(f"{schema['$ref']} refers to itself")
        yield from faults(value, _referred(root, schema["$ref"]), at, root, seen | {schema["$ref"]})
    kinds = schema.get("type")
    if kinds is not None and not any(_KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield f"{at}: not {kinds}"
        return
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        yield f"{at}: not among the values"
    broken = lambda own: next(faults(value, own, at, root, seen), None) is not None
    for own in schema.get("allOf", ()):
        yield from faults(value, own, at, root, seen)
    if "anyOf" in schema and all(map(broken, schema["anyOf"])):
        yield f"{at}: none of the choices"
    if "oneOf" in schema and sum(not broken(x) for x in schema["oneOf"]) != 1:
        yield f"{at}: not just one of the choices"
    if "not" in schema and not broken(schema["not"]):
        yield f"{at}: excluded"
    yield from _bounds(value, schema, at)
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            yield from faults(x, schema["items"], f"{at}[{k}]", root)
    if isinstance(value, dict):
        own = schema.get("properties", {})
        yield from (f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value)
        for k in sorted(value):
            yield from faults(value[k], own[k] if k in own else schema.get("additionalProperties", True), f"{at}.{k}", root)


def _written(schemas: dict[str, dict]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, out = [], []
            for row in batch.select(["role", "call_id", "name", "arguments", "content", "broken"]).to_pylist():
                wrong, role = [row["broken"]] if row["broken"] else [], row["role"]
                if role == CALL:
                    arguments = row["arguments"] if row["arguments"] is not None else "{}"
                    try:
                        value = json.loads(arguments)
                        arguments = canonical(value)
                        found = list(faults(value, schemas[row["name"]])) if row["name"] in schemas else ["name: no such tool"]
                    except (ValueError, RecursionError):
                        found = ["arguments: not JSON"]
                    wrong += found
                    message = {"role": "assistant", "tool_calls": [{"id": row["call_id"], "type": "function", "function": {"name": row["name"], "arguments": arguments}}]}
                elif role == RESULT:
                    message = {"role": "tool", "tool_call_id": row["call_id"], "content": row["content"]}
                else:
                    message = {"role": role, "content": row["content"]}
                errors.append("; ".join(wrong))
                out.append(canonical(message))
            rest = ["conv_id", "turn", "role", "call_id", "level", "linked_turn", "status"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(errors, pa.string()), pa.array(out, pa.string())], names=[*rest, "errors", "json"])

    return work


def _depths(calls: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, depth) of distinct calls: how long a chain of earlier calls each waits for.

    A call that waits for just one other is led to the start of its chain, its reach doubling in each round. Only calls
    that wait for several are settled level by level. Calls in or behind a ring are left out.
    """
    key = ["conv_id", "call_id"]
    own = calls.select(*key)
    edges = calls.select(*key, F.explode("after").alias("waits")).distinct()
    edges = stored(edges.join(own.withColumnRenamed("call_id", "waits"), ["conv_id", "waits"]), "waits")
    needed = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("needed"), F.min("waits").alias("waits"))
    nodes = own.join(needed, key, "left").withColumn("open", F.coalesce(F.col("needed") == 1, F.lit(False)))
    top = F.when(F.col("open"), F.col("waits")).otherwise(F.col("call_id")).alias("top")
    chains = stored(nodes.select(*key, F.coalesce("needed", F.lit(0)).alias("needed"), top, F.col("open").cast("int").alias("far"), "open"), "chains")
    before = None
    while (left := chains.filter("open").count()) and left != before:  # what no longer closes is in or behind a ring
        before = left
        there = chains.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("far").alias("more"), F.col("open").alias("open2"))
        led = chains.filter("open").join(there, ["conv_id", "top"])
        led = led.select(*key, "needed", F.col("next").alias("top"), (F.col("far") + F.col("more")).alias("far"), F.col("open2").alias("open"))
        chains = stored(chains.filter("not open").union(led), "chains")
    known = chains.filter("needed = 0").select(*key, F.lit(0).alias("depth"))
    several = chains.filter("needed > 1").select(*key, "needed")
    if total := several.count():
        ends = chains.select("conv_id", F.col("call_id").alias("waits"), "top", "far")
        edges = stored(edges.join(several, key).join(ends, ["conv_id", "waits"]), "waits")
        known, now, before = stored(known, "depths"), 0, -1
        while before < now < total:
            before = now
            met = edges.join(known.withColumnRenamed("call_id", "top"), ["conv_id", "top"])
            met = met.groupBy(*key).agg(F.count(F.lit(1)).alias("met"), F.max("needed").alias("needed"), F.max(F.col("depth") + F.col("far") + 1).alias("depth"))
            settled = met.filter("met = needed").select(*key, "depth").join(known, key, "left_anti")
            known = stored(known.union(settled), "depths")
            now = known.join(several, key, "left_semi").count()
    starts = known.select("conv_id", F.col("call_id").alias("top"), "depth")
    return chains.filter("not open").join(starts, ["conv_id", "top"]).select(*key, (F.col("depth") + F.col("far")).alias("depth"))


def link_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each of ``messages``: conv_id, turn, role, call_id, level, linked_turn, status, errors, json.

    ``messages`` has conv_id, turn (long), role, call_id, name, arguments (JSON), after (ids of calls that a call waits
    for) and content. Roles call and result are linked by conversation and id; all others are plain. Of calls with one id
    the earliest counts, and of results the earliest after linking; the later ones have status duplicate, equal rows are
    alike. status: answered, unanswered, linked, orphan, duplicate or message. Sorting a conversation by level, then turn,
    puts every call after the results it waits for and every result after its call. Waits for unknown calls don't count;
    a call in or behind a ring of waits has level null and an error, as has its result. A null id links to nothing. Null
    arguments are an empty object; those that aren't JSON or have no canonical form (half a surrogate pair, a number beyond
    a double) stay as they are, with an error. A schema with an unknown keyword is an error. An empty table gives an empty table.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    messages = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "call_id", "name", "arguments", "after", "content")
    earliest = F.min(F.struct("turn", "name", F.coalesce("after", F.array().cast("array<string>")).alias("after"))).alias("m")
    usable = messages.filter("conv_id is not null and call_id is not null")
    calls = stored(usable.filter(F.col("role") == CALL).groupBy("conv_id", "call_id").agg(earliest).select("conv_id", "call_id", F.col("m.turn").alias("call_turn"), F.col("m.after").alias("after")), "calls")
    results = usable.filter(F.col("role") == RESULT).groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"))
    known = calls.drop("after").join(_depths(calls), ["conv_id", "call_id"], "left").join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    known = known.withColumn("is_call", F.lit(True))
    met = messages.join(known.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    call, result, found = F.col("role") == CALL, F.col("role") == RESULT, F.coalesce("is_call", F.lit(False))
    met = met.withColumns(
        {
            "level": F.when(~(call | result), F.lit(0)).when(~found, F.lit(0)).when(call, 2 * F.col("depth")).otherwise(2 * F.col("depth") + 1),
            "linked_turn": F.when(call, F.col("result_turn")).when(result, F.col("call_turn")),
            "status": F.when(call & F.coalesce(F.col("turn") > F.col("call_turn"), F.lit(False)), "duplicate")
            .when(call, F.when(F.col("result_turn").isNull(), "unanswered").otherwise("answered"))
            .when(result & ~found, "orphan")
            .when(result, F.when(F.col("turn") > F.col("result_turn"), "duplicate").otherwise("linked"))
            .otherwise("message"),
            "broken": F.when((call | result) & found & F.col("depth").isNull(), "after: waits in a ring"),
        }
    )
    kind = messages.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "turn", "role", "call_id", "level", "linked_turn", "status", "name", "arguments", "content", "broken"]
    return met.select(*columns).mapInArrow(_written(schemas), f"conv_id {kind}, turn long, role string, call_id string, level int, linked_turn long, status string, errors string, json string")


#: The one tool of ``as_calls``.
REPLY = {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}


def as_calls(conversations: DataFrame) -> DataFrame:
    """A table of plain turns (conv_id, turn, role, text) as messages: what a user says is a call of the tool ``reply`` with
    turn and text as arguments, waiting for the user's call before it; what the assistant says is the result of the call
    one turn earlier; others stay plain."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(user, CALL).when(assistant, RESULT).otherwise(F.col("role")).alias("role"),
        F.when(user, name(0)).when(assistant, name(1)).alias("call_id"),
        F.when(user, "reply").alias("name"),
        F.when(user, F.to_json(F.struct("turn", "text"))).alias("arguments"),
        F.when(user, F.array(name(2))).alias("after"),
        F.when(~user | F.col("role").isNull(), F.col("text")).alias("content"),
    )
