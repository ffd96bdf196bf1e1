"""Tool calls: calls and results joined by identifier, ordered topologically, validated, as canonical JSON.

Calls carry the identifiers of the calls that they need. A call's level is 0 without needs, else one more than the
highest level of its needs; it is found for all conversations together, a level a round, by joins on (conv_id,
call_id), so a conversation may be of any size. Sorted by (level, position) the calls of a conversation are in
topological order. Arguments are held against the schema of the call's name: type, properties, required,
additionalProperties, items, enum, minimum, maximum, minLength, maxLength and pattern of JSON Schema.

Defined cases: of calls that repeat an identifier in a conversation the first by position counts, the others get
status "repeated"; of results for one identifier the first by position counts; results for no call of the conversation, or
with a null identifier, give no rows; a need that is no call of the conversation is ignored and listed; calls on a cycle, or
that need one, get no level and status "cycle"; null or malformed arguments, and names without a schema, are errors
(malformed: not JSON, NaN or infinities, lone surrogates, integers of over 4,300 digits, nesting beyond the parser's
depth); a call with a null identifier joins nothing; no calls give no rows.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from steadyframes.llm.components import cut_lineage

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and plain characters; floats of whole value as integers."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parse(text: str):
    """A JSON value; ValueError for what isn't one, for NaN and infinities, surrogates without a partner and nesting beyond
    what Python's parser takes."""
    try:
        value = json.loads(text)
        canonical(value).encode()
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def of_type(value, kind: str) -> bool:
    """Whether a JSON value has a type that a schema names; unknown names hold for every value."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("number", "integer"):
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, object))


def violations(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What of a value breaks a schema, as "place: rule". A schema may be true (all values fit) or false (none does)."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: false"]
    out = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(of_type(value, k) for k in kinds):
            return [f"{at}: type {' or '.join(kinds)}"]
    # JSON tells 1 from true, and not 1 from 1.0.
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: minimum"] * (value < schema.get("minimum", value)) + [f"{at}: maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: minLength"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: maxLength"] * (len(value) > schema.get("maxLength", len(value)))
        out += [f"{at}: pattern"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    if isinstance(value, dict):
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}: required {k}" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif rest is False:
                out.append(f"{at}: additional {k}")
            else:
                out += violations(value[k], rest, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


EDGES_PER_TASK = 25_000


def levels(nodes: DataFrame, most: int) -> DataFrame:
    """(conv_id, call_id, level, cyclic, missing) of the calls that need any, a row each: level is null where cyclic, that is on a cycle or
    in need of one; missing has the needs without a call.

    nodes has a row for each (conv_id, call_id), with needs, of which there are at most `most`. A need is open while its
    call has open needs itself; a round finds those that no longer are, and all are written once a round. Files are as few as
    the needs' number asks for, since Hadoop starts child processes of the executor for each file's permissions.
    """

    def tell(df: DataFrame, level: int | None, cyclic: bool, missing=F.lit(None)) -> DataFrame:
        return df.select("conv_id", "call_id", F.lit(level).cast("int").alias("level"), F.lit(cyclic).alias("cyclic"), missing.cast("string").alias("missing"))

    nodes = nodes.where("conv_id is not null and call_id is not null")
    needs = nodes.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need")).where("need is not null")
    keys = nodes.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("open"))
    now = cut_lineage(needs.join(keys, ["conv_id", "need"], "left").coalesce(most // EDGES_PER_TASK + 1))
    told = tell(now.where("open is null"), 0, False, F.col("need"))
    last, level = None, 0
    while (left := (now := now.where("open").drop("open")).count()) and left != last:
        keys = now.select("conv_id", F.col("call_id").alias("need")).distinct().withColumn("open", F.lit(True))
        now = cut_lineage(now.join(keys, ["conv_id", "need"], "left").coalesce(left // EDGES_PER_TASK + 1))
        last, level = left, level + 1
        told = told.unionByName(tell(now.where("open is null"), level, False))
    told = told.unionByName(tell(now, None, True))
    told = told.groupBy("conv_id", "call_id").agg(F.max("level").alias("level"), F.max("cyclic").alias("cyclic"), F.array_sort(F.collect_set("missing")).alias("missing"))
    return told.withColumn("level", F.when(~F.col("cyclic"), F.col("level")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call, in the order of (conv_id, level, position), those without a level last of their conversation:
    conv_id, call_id, position, level, status, errors, json.

    calls: conv_id, call_id, position, name, arguments (JSON), needs (array of call_id). results: conv_id, call_id,
    position, content. status: ok, invalid, unanswered, repeated or cycle, the last that holds of these.
    """
    calls = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), F.col("position").cast("long").alias("position"), "name", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    # The first row of each identifier, by an aggregate that combines before the shuffle.
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "name", "arguments", "needs")).alias("f"))
    own = first.select("conv_id", "call_id", "f.*")
    count = calls.groupBy("conv_id", "call_id", "position", "name", "arguments", "needs").count()
    numbered = count.join(first.select("conv_id", "call_id", F.col("f.position").alias("p0"), F.col("f.name").alias("n0"), F.col("f.arguments").alias("a0"), F.col("f.needs").alias("d0")).where("call_id is not null"), ["conv_id", "call_id"], "left")
    is_first = F.col("position").eqNullSafe(F.col("p0")) & F.col("name").eqNullSafe(F.col("n0")) & F.col("arguments").eqNullSafe(F.col("a0")) & F.col("needs").eqNullSafe(F.col("d0"))
    every = numbered.select("conv_id", "call_id", "position", "name", "arguments", "needs", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"), is_first.alias("same"))
    every = every.withColumn("repeated", F.col("call_id").isNotNull() & ~(F.coalesce("same", F.lit(False)) & (F.col("copy") == 1)))
    answered = results.where("call_id is not null").groupBy("conv_id", F.col("call_id").cast("string").alias("call_id")).agg(F.min(F.struct("position", "content")).alias("r")).select("conv_id", "call_id", F.col("r.content").alias("result"), F.lit(True).alias("answered"))
    told = levels(own, calls.agg(F.sum(F.size("needs"))).first()[0] or 0)
    joined = every.join(answered, ["conv_id", "call_id"], "left").join(told, ["conv_id", "call_id"], "left")
    level = F.when(F.col("cyclic"), None).when(F.expr("conv_id is not null and call_id is not null"), F.coalesce("level", F.lit(0))).alias("level")
    joined = joined.select("conv_id", "call_id", "position", "name", "arguments", "needs", "repeated", F.coalesce("answered", F.lit(False)).alias("answered"), "result", level, "missing")
    joined = joined.orderBy("conv_id", F.col("level").asc_nulls_last(), "position", "call_id")

    def run(batches):
        for batch in batches:
            status, errors, out = [], [], []
            for r in batch.to_pylist():
                try:
                    arguments = parse(r["arguments"]) if r["arguments"] is not None else None
                    wrong = ["$: null arguments"] if r["arguments"] is None else [f"no schema for {r['name']}"] if r["name"] not in schemas else violations(arguments, schemas[r["name"]])
                    body = canonical(arguments)
                except ValueError:
                    arguments, wrong, body = None, ["$: malformed"], "null"
                cyclic = r["level"] is None and r["call_id"] is not None
                status.append("cycle" if cyclic else "repeated" if r["repeated"] else "unanswered" if not r["answered"] else "invalid" if wrong else "ok")
                errors.append(wrong)
                head = {"id": r["call_id"], "level": r["level"], "missing": r["missing"] or [], "name": r["name"], "needs": sorted(x for x in r["needs"] if x is not None), "result": r["result"]}
                out.append('{"arguments":' + body + "," + canonical(head)[1:])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 2, 9)], pa.array(status, pa.string()), pa.array(errors, pa.list_(pa.string())), pa.array(out, pa.string())], names=["conv_id", "call_id", "position", "level", "status", "errors", "json"])

    fields = [joined.schema[c] for c in ("conv_id", "call_id", "position", "level")]
    return joined.mapInArrow(run, StructType(fields + StructType.fromDDL("status string, errors array<string>, json string").fields))


# The shape of what conversations hold when they are read as calls and results.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}}},
    "note": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "maxLength": 400}, "limit": {"type": "integer"}}},
}


def digest(conversations: DataFrame) -> DataFrame:
    """Turns of users as calls, each followed by the assistant's answer as its result.

    Call turn t needs turn 2 floor(t / 4) of its conversation, where t > 0.
    """
    conv, turn = F.col("conv_id"), F.col("turn").cast("long")
    ident = lambda t: F.concat_ws(":", conv.cast("string"), t.cast("string"))
    calls = conversations.where("role = 'user'").select(
        "conv_id", ident(turn).alias("call_id"), turn.alias("position"), F.when(F.length("text") % 3 == 0, "note").otherwise("search").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), (F.length("text") % 50).alias("limit"))).alias("arguments"),
        F.when(turn > 0, F.array(ident(F.floor(turn / 4) * 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = conversations.where("role = 'assistant'").select("conv_id", ident(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    return link(calls, results, SCHEMAS)
