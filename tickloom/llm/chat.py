"""Tool calls of conversations: linked with results, ordered, validated, serialised.

Calls and results meet in a hash join on (conversation, call id).  A call may name
calls it comes after; ``place`` is its position in a topological order of its
conversation.  Where every such reference goes to an earlier turn the turns already
are that order.  Conversations with references to later turns are sorted by peeling
calls whose references are done: in one task while a conversation's calls fit
``GROUP_CALLS``, by joins, one round per level, beyond.  Arguments are validated
against the tool's JSON schema and written as canonical JSON: keys by UTF-16 code
units, no blanks, whole floats as integers.

Defined results: of calls with one id the first by (turn, name, arguments) counts,
of results likewise, the numbers of both are kept; a null id or conversation links
with nothing (``no_id``); results without a call are rows of their own
(``orphan_result``); calls in or behind a circle come last in turn order (``cycle``);
unknown references are ignored; arguments that are no JSON object, and calls of
tools without a schema, are invalid; empty tables give no rows.  Arguments and schemas of
any text are given an error of their own: no JSON, nested deeper than ``DEPTH``, numbers
beyond a double or ``DIGITS``, lone surrogates; a schema that is malformed is ``bad schema``
and one with a word that is not checked ``unsupported``, so that no call passes unchecked.
A very long text takes the memory of its JSON value in one task.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import ranged, with_position
from .common import lookup, settled

GROUP_CALLS = 20_000

DEPTH = 100    # levels of nesting that are read
DIGITS = 4000  # of an integer

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
KINDS = {*TYPES, "integer", "number"}


def _plain(value):
    """Whole floats as integers; keys in order of their UTF-16 code units."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    return json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"), allow_nan=False)


class Fault(ValueError):
    """A named reason why a text is no usable JSON."""


def _no(constant: str):
    raise Fault("not json")


def _float(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise Fault("number out of range")
    return value


def _int(digits: str) -> int:
    if len(digits) > DIGITS:
        raise Fault("number out of range")
    return int(digits)


def parse(text: str):
    """The JSON value of a text; ``Fault`` names what is wrong with it."""
    try:
        value = json.loads(text, parse_constant=_no, parse_float=_float, parse_int=_int)
    except RecursionError:
        raise Fault("too deep") from None
    except Fault:
        raise
    except ValueError:
        raise Fault("not json") from None
    level, here = 0, [value]
    while here:
        level += 1
        if level > DEPTH:
            raise Fault("too deep")
        here = [v for x in here if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x) if isinstance(v, (dict, list))]
    try:
        json.dumps(value, ensure_ascii=False).encode()
    except UnicodeEncodeError:
        raise Fault("lone surrogate") from None
    return value


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES[kind])


def same_json(a, b) -> bool:
    """Equality of JSON values: numbers by value, and no number equals true or false."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same_json(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_json, a, b))
    return type(a) is type(b) and a == b or _is(a, "number") and _is(b, "number") and a == b


def _count(x) -> bool:
    return _is(x, "integer") and x >= 0


def _schemas(x) -> bool:
    return isinstance(x, list) and bool(x)


#: schema words and what their values must be
_WORDS = {
    "type": lambda x: isinstance(x, str) and x in KINDS or isinstance(x, list) and bool(x) and all(isinstance(k, str) and k in KINDS for k in x),
    "enum": lambda x: isinstance(x, list), "const": lambda x: True,
    "required": lambda x: isinstance(x, list) and all(isinstance(n, str) for n in x),
    "properties": lambda x: isinstance(x, dict), "additionalProperties": lambda x: isinstance(x, (bool, dict)), "items": lambda x: isinstance(x, (bool, dict)),
    "minimum": lambda x: _is(x, "number"), "maximum": lambda x: _is(x, "number"), "exclusiveMinimum": lambda x: _is(x, "number"), "exclusiveMaximum": lambda x: _is(x, "number"),
    "multipleOf": lambda x: _is(x, "number") and x > 0, "minLength": _count, "maxLength": _count, "minItems": _count, "maxItems": _count,
    "minProperties": _count, "maxProperties": _count, "uniqueItems": lambda x: isinstance(x, bool),
    "anyOf": _schemas, "oneOf": _schemas, "allOf": _schemas, "not": lambda x: isinstance(x, (bool, dict)),
}
#: words that say nothing about a value
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}


def schema_fault(schema) -> str | None:
    """Why a schema cannot be checked against: ``bad schema: <word>`` or ``unsupported: <word>``; else null."""
    if isinstance(schema, bool):
        return None
    if not isinstance(schema, dict):
        return "bad schema: no object"
    for word in sorted(schema):
        if word in _NOTES:
            continue
        if word not in _WORDS:
            return f"unsupported: {word}"
        if not _WORDS[word](schema[word]):
            return f"bad schema: {word}"
        inner = schema[word]
        parts = inner.values() if word == "properties" else inner if word in ("anyOf", "oneOf", "allOf") else [inner] if word in ("additionalProperties", "items", "not") else ()
        for part in parts:
            if found := schema_fault(part):
                return found
    return None


def problem(value, schema, path: str = "$") -> str | None:
    """The first way in which ``value`` breaks a schema without ``schema_fault``, or null."""
    if isinstance(schema, bool):
        return None if schema else f"{path}: nothing allowed"
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{path}: type"
    if "enum" in schema and not any(same_json(value, x) for x in schema["enum"]):
        return f"{path}: enum"
    if "const" in schema and not same_json(value, schema["const"]):
        return f"{path}: const"
    if _is(value, "number"):
        low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value) or low is not None and value <= low or high is not None and value >= high:
            return f"{path}: range"
        if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            return f"{path}: multiple"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{path}: length"
    if isinstance(value, dict):
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return f"{path}: size"
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: required"
        for name in sorted(value):
            if name in known:
                if found := problem(value[name], known[name], f"{path}.{name}"):
                    return found
            elif other is False:
                return f"{path}.{name}: unknown"
            elif found := problem(value[name], other, f"{path}.{name}"):
                return found
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{path}: size"
        if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
            return f"{path}: repeated"
        for i, v in enumerate(value if "items" in schema else ()):
            if found := problem(v, schema["items"], f"{path}[{i}]"):
                return found
    for word, wanted in (("allOf", None), ("anyOf", 1), ("oneOf", 1)):
        if word in schema:
            fits = sum(problem(value, s, path) is None for s in schema[word])
            if word == "allOf" and fits < len(schema[word]) or word == "anyOf" and not fits or word == "oneOf" and fits != wanted:
                return f"{path}: {word}"
    if "not" in schema and problem(value, schema["not"], path) is None:
        return f"{path}: not"
    return None


def _schema_of(text: str) -> tuple[object, str | None]:
    try:
        schema = parse(text)
    except Fault as f:
        return None, f"bad schema: {f}"
    return schema, schema_fault(schema)


def check_arguments(raw: str | None, schema: object, fault: str | None) -> tuple[bool, str | None, str | None]:
    """Whether the arguments are valid, else why not, and their canonical form where they are JSON."""
    try:
        value = parse(raw) if raw is not None else None
    except Fault as f:
        return False, f"$: {f}", None
    error = fault or (problem(value, schema) if isinstance(value, dict) else "$: type")
    return error is None, error, canonical(value)


def _checked(arguments: pd.Series, schema: pd.Series) -> pd.DataFrame:
    out, known = [], {None: (None, "no schema")}
    for raw, text in zip(arguments, schema):
        if text not in known:
            known[text] = _schema_of(text)
        out.append(check_arguments(raw, *known[text]))
    return pd.DataFrame(out, columns=["valid", "error", "arguments"])


def _record(call_id: pd.Series, name: pd.Series, arguments: pd.Series, raw: pd.Series, after: pd.Series, content: pd.Series) -> pd.Series:
    rows = []
    for i, n, a, r, x, c in zip(call_id, name, arguments, raw, after, content):
        rows.append(canonical({"id": i, "name": n, "arguments": json.loads(a) if a is not None else r, "after": [] if x is None else list(x), "content": c}))
    return pd.Series(rows)


def peel(pdf: pd.DataFrame) -> pd.DataFrame:
    """``rank`` of each call of one conversation: rounds of calls whose references are done; null in or behind a circle."""
    pdf = pdf.sort_values(["turn", "call_id"], ignore_index=True)
    known = set(pdf["call_id"])
    waits = {c: {p for p in ([] if a is None else a) if p in known} for c, a in zip(pdf["call_id"], pdf["after"])}
    behind = defaultdict(list)
    for c, parents in waits.items():
        for p in parents:
            behind[p].append(c)
    rank, ready, level = {}, [c for c in pdf["call_id"] if not waits[c]], 0
    while ready:
        rank.update(dict.fromkeys(ready, level))
        nxt = []
        for c in ready:
            for b in behind[c]:
                waits[b].discard(c)
                if not waits[b]:
                    nxt.append(b)
        ready, level = nxt, level + 1
    return pd.DataFrame({"_c": pdf["_c"], "call_id": pdf["call_id"], "rank": pd.array([rank.get(c) for c in pdf["call_id"]], "Int64")})


def _peel_by_joins(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """The same ranks for conversations too large for one task."""
    done = None
    pending, level = settled(calls.select("_c", "call_id"), "pending"), 0
    while not pending.isEmpty():
        open_edges = edges.join(pending.withColumnRenamed("call_id", "parent"), ["_c", "parent"], "left_semi")
        ready = settled(pending.join(open_edges, ["_c", "call_id"], "left_anti").withColumn("rank", F.lit(level).cast("long")), "ready")
        if ready.isEmpty():
            ready = pending.withColumn("rank", F.lit(None).cast("long"))
            return ready if done is None else done.unionByName(ready)
        done = ready if done is None else done.unionByName(ready)
        pending, level = settled(pending.join(ready, ["_c", "call_id"], "left_anti"), "pending"), level + 1
    return done


def _firsts(rows: DataFrame, fields: list[str], order: list[str], count: str) -> DataFrame:
    """One row per (_c, call_id): the first by ``order``, and how many there are."""
    rest = [f for f in fields if f not in order]
    got = rows.groupBy("_c", "call_id").agg(F.min(F.struct(*order, *rest)).alias("_f"), F.count(F.lit(1)).alias(count))
    return got.select("_c", "call_id", *[F.col(f"_f.{f}").alias(f) for f in fields], count)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, group_calls: int = GROUP_CALLS) -> DataFrame:
    """One row per call, and per result without a call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), after (ids); ``results``:
    conv_id, call_id, turn, content; ``schemas``: name, schema (JSON).  Gives conv_id,
    call_id, turn, place, status, valid, error, n_calls, n_results and json.
    """
    key = F.col("conv_id").cast("string").alias("_c")
    kind = dict(calls.dtypes)["conv_id"]
    good = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    asked = calls.where(good).select(key, "call_id", "turn", "name", "arguments", F.array_sort(F.array_distinct(F.coalesce("after", F.array().cast("array<string>")))).alias("after"))
    asked = settled(_firsts(asked, ["turn", "name", "arguments", "after"], ["turn", "name", "arguments", "after"], "n_calls"), "calls")
    given = _firsts(results.where(good).select(key, "call_id", "turn", "content"), ["turn", "content"], ["turn", "content"], "n_results")
    given = given.withColumnRenamed("turn", "r_turn").hint("shuffle_hash")
    both = asked.join(given, ["_c", "call_id"], "full")

    edges = settled(asked.select("_c", "call_id", "turn", F.explode("after").alias("parent")).join(
        asked.select("_c", F.col("call_id").alias("parent"), F.col("turn").alias("p_turn")), ["_c", "parent"]), "references")
    later = edges.groupBy("_c").agg(F.max((F.col("p_turn").isNull() | F.col("turn").isNull() | (F.col("p_turn") >= F.col("turn")))).alias("later")).where("later")
    sizes = settled(asked.groupBy("_c").agg(F.count(F.lit(1)).alias("size")).join(later, "_c").select("_c", "size"), "to-sort")
    thin = asked.select("_c", "call_id", "turn", "after")
    small = thin.join(sizes.where(F.col("size") <= group_calls), "_c", "left_semi")
    ranks = small.groupBy("_c").applyInPandas(peel, "_c string, call_id string, rank long")
    large = sizes.where(F.col("size") > group_calls)
    if not large.isEmpty():
        ranks = ranks.unionByName(_peel_by_joins(thin.join(large, "_c", "left_semi"), edges.join(large, "_c", "left_semi").select("_c", "call_id", "parent")))
    sorted_ = settled(ranks.withColumn("sorted", F.lit(True)), "ranks")

    placed = asked.select("_c", "call_id", "turn").join(sorted_, ["_c", "call_id"], "left").withColumn("cycle", F.col("sorted").isNotNull() & F.col("rank").isNull())
    placed = placed.withColumn("_o", F.when(F.col("cycle"), F.lit((1 << 62))).when(F.col("sorted").isNotNull(), F.col("rank")).otherwise(F.coalesce(F.col("turn").cast("long"), F.lit(0))))
    order = ["_o", "turn", "call_id"]
    placed = with_position(ranged(placed.select("_c", *order, "cycle"), ["_c"], order), ["_c"], order, F.col("_rb"), "place")
    both = both.join(placed.select("_c", "call_id", "place", "cycle"), ["_c", "call_id"], "left")

    status = F.when(F.col("n_calls").isNull(), "orphan_result").when(F.col("cycle"), "cycle").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    told = lookup(settled(both.withColumn("status", status), "linked-calls"), settled(schemas.groupBy("name").agg(F.min("schema").alias("schema")), "schemas"), ["name"], ["schema"], F.xxhash64("_c", "call_id"))
    lost = calls.where(~good).select(key, "call_id", "turn", "name", "arguments", "after", F.lit(1).cast("long").alias("n_calls"), F.lit("no_id").alias("status"))
    lost = lookup(lost, settled(schemas.groupBy("name").agg(F.min("schema").alias("schema")), "schemas"), ["name"], ["schema"], F.xxhash64("turn", "arguments"))
    told = told.unionByName(lost, allowMissingColumns=True).unionByName(
        results.where(~good).select(key, "call_id", F.col("turn").alias("r_turn"), "content", F.lit(1).cast("long").alias("n_results"), F.lit("orphan_result").alias("status")), allowMissingColumns=True)
    made = told.withColumn("_v", F.when(F.col("n_calls").isNotNull(), F.pandas_udf(_checked, "struct<valid boolean, error string, arguments string>")("arguments", "schema")))
    record = F.pandas_udf(_record, "string")("call_id", "name", F.col("_v.arguments"), "arguments", "after", "content")
    return made.select(F.col("_c").cast(kind).alias("conv_id"), "call_id", F.coalesce("turn", "r_turn").alias("turn"), "place", "status", F.col("_v.valid").alias("valid"), F.col("_v.error").alias("error"),
                       F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), record.alias("json"))


# Tools that the conversations table is read as calling, with their schemas.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 200}}},
    "note": {"type": "object", "required": ["text", "size"], "properties": {"text": {"type": "string", "maxLength": 1500}, "size": {"type": "number"}}},
}


def _call(turn: Column) -> Column:
    return F.concat(F.lit("call_"), turn.cast("string"))


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas read from plain turns: an assistant turn calls a tool, the next user turn answers it.

    The tool, its arguments and the calls it comes after follow from the turn's words.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")).cast("long")
    says = rows.where("role = 'assistant'").withColumn("n", n)
    search = F.to_json(F.struct(F.col("text").alias("query"), F.col("n").alias("limit")))
    note = F.to_json(F.struct(F.col("n").cast("double").alias("size"), F.col("text").alias("text")))
    after = F.filter(F.array(F.when(F.col("n") % 5 != 1, _call(F.col("turn") - 2)), F.when(F.col("n") % 7 == 0, _call(F.col("turn") + 2))), lambda x: x.isNotNull())
    calls = says.select("conv_id", _call(F.col("turn")).alias("call_id"), "turn", F.when(F.col("n") % 2 == 0, "search").when(F.col("n") % 11 == 0, "unknown").otherwise("note").alias("name"),
                        F.when(F.col("n") % 2 == 0, search).otherwise(note).alias("arguments"), after.alias("after"))
    results = rows.where("role = 'user' AND turn > 0").select("conv_id", _call(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = conversations.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in TOOLS.items()], "name string, schema string")
    return calls, results, schemas


def tool_digest(conversations: DataFrame) -> DataFrame:
    return link_calls(*derived(conversations))
