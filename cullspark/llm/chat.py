"""Tool calls of conversations: linked to their results, ordered by dependency, validated and written as canonical JSON.

DataFrame functions only. A message's tool calls and results are read as variants, whose objects keep
their keys sorted, so writing them gives canonical JSON. Calls and results meet by a hash join on
conversation and identifier. A call may name calls it comes after, in any order of turns: it waits for the
latest place among those it depends on, and among calls that wait for one place the one that others
depend on comes first. What a cycle holds up keeps its own turn's order and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

#: Variant types that stand for the types of a schema.
TYPES = {"string": ["STRING"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}
NONE = "array<string>"


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def _is(value: Column, kind: str) -> Column:
    """Whether a variant has a schema's type; whole numbers of any size are integers, however they are written."""
    if kind != "integer":
        return _kind(value).isin(*TYPES[kind])
    whole = F.try_variant_get(value, "$", "double")
    return (_kind(value) == "BIGINT") | (_kind(value).isin("DECIMAL", "DOUBLE", "FLOAT") & F.coalesce(whole == F.rint(whole), F.lit(False)))


def _wrong(value: Column, schema: dict, path: str) -> Column:
    """What is wrong with a variant under a schema of type, enum, properties, required, additionalProperties and items; null if nothing is given."""
    kind, found = schema.get("type"), []
    name = path or "arguments"
    if kind:
        found.append(F.when(~_is(value, kind), F.array(F.lit(f"{name} is not {kind}"))))
    if "enum" in schema:
        found.append(F.when(~F.coalesce(F.to_json(value).isin(*(F.to_json(F.parse_json(F.lit(_json(x)))) for x in schema["enum"])), F.lit(False)), F.array(F.lit(f"{name} is not one of the values"))))
    fields = schema.get("properties", {})
    if fields or "required" in schema or schema.get("additionalProperties") is False:
        members = F.try_variant_get(value, "$", "map<string,variant>")
        dot = f"{path}." if path else ""
        for field in dict.fromkeys((*fields, *schema.get("required", ()))):
            member = F.try_element_at(members, F.lit(field))
            there = F.array_contains(F.map_keys(members), F.lit(field))
            if field in schema.get("required", ()):
                found.append(F.when(~there, F.array(F.lit(f"{dot}{field} is missing"))))
            if field in fields:
                inner = fields[field] if isinstance(fields[field], dict) else {"type": fields[field]}
                found.append(F.when(there, _wrong(member, inner, f"{dot}{field}")))
        if schema.get("additionalProperties") is False:
            extra = F.array_sort(F.array_except(F.map_keys(members), F.array(*map(F.lit, fields)).cast(NONE)))
            found.append(F.transform(extra, lambda k: F.concat(F.lit(dot), k, F.lit(" is not known"))))
    if "items" in schema:
        inner = schema["items"]
        listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _wrong(x, inner, f"{name}[]"))
        found.append(F.array_distinct(F.flatten(listed)))
    none = F.array().cast(NONE)
    return F.concat(*(F.coalesce(x, none) for x in found)) if found else none


def _json(value) -> str:
    import json

    return json.dumps(value)


def _errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with the arguments under the tool's schema."""
    out = F.when(name.isNull(), F.array(F.lit("no name"))).otherwise(F.array(F.lit("unknown tool")))
    for tool, schema in schemas.items():
        bad = F.when(F.coalesce(_kind(arguments) != "OBJECT", F.lit(True)), F.array(F.lit("arguments are not an object")))
        out = F.when(name == tool, bad.otherwise(_wrong(arguments, {k: v for k, v in schema.items() if k != "type"}, ""))).otherwise(out)
    return out


def _order(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """cid, ready (a place), depth and cyclic of the calls (cid, turn, place) that wait, given refs (cid, needs) to other calls.

    Both loops end when nothing changes; calls that only depend on earlier ones don't take part.
    """
    place = F.struct("turn", "place")
    ready = cut(calls.select("cid", place.alias("own"), place.alias("ready")), "ready")
    moved = refs.join(ready.select("cid", "ready"), "cid").join(ready.select(F.col("cid").alias("needs"), F.col("ready").alias("after")), "needs")
    late = cut(moved.where(F.col("after") > F.col("ready")).groupBy("cid").agg(F.max("after").alias("after")), "late")
    while not late.isEmpty():
        ready = cut(ready.join(late, "cid", "left").select("cid", "own", F.greatest("ready", F.coalesce("after", "ready")).alias("ready")), "ready")
        touched = refs.join(late.select(F.col("cid").alias("needs"), F.col("after").alias("to")), "needs").join(ready.select("cid", "ready"), "cid")
        late = cut(touched.where(F.col("to") > F.col("ready")).groupBy("cid").agg(F.max("to").alias("after")), "late")
    # among calls ready at one place: those whose needs are all placed get the next depth, again and again
    waits = ready.where(F.col("ready") != F.col("own"))
    here = refs.join(ready.select("cid", "ready"), "cid").join(ready.select(F.col("cid").alias("needs"), F.col("ready").alias("r")), "needs").where(F.col("r") == F.col("ready")).select("cid", "needs")
    here = cut(here, "here")
    left = cut(here.select("cid").unionByName(waits.select("cid")).distinct(), "left")
    placed, depth = None, 0
    while not left.isEmpty():
        held = here.join(left.select(F.col("cid").alias("needs")), "needs", "left_semi").select("cid").distinct()
        free = cut(left.join(held, "cid", "left_anti").withColumn("depth", F.lit(depth + 1)), "free")
        if free.isEmpty():
            break
        placed = free if placed is None else placed.unionByName(free)
        left, depth = cut(left.join(free, "cid", "left_anti"), "left"), depth + 1
    cyclic = left.select("cid", F.lit(depth + 1).alias("depth"), F.lit(True).alias("cyclic"))
    every = cyclic if placed is None else placed.withColumn("cyclic", F.lit(False)).unionByName(cyclic)
    return cut(every.join(ready.select("cid", "ready"), "cid"), "ordered")


def linked(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every message, call and result in its place: conv_id, turn, position, kind, call_id, linked, errors, json.

    messages: conv_id, turn, role, text. Text of an assistant that is an object with tool_calls (objects
    with id, name, arguments and after, a list of identifiers) gives a row for each call, with its
    result, text of role tool with tool_call_id a result; anything else is a message. A call that has no
    result and a result that has no call are rows with linked false. Where an identifier comes again in a
    conversation, the first call and the first result count as linked and every other one is an unlinked
    row with an error; first is by turn, then place in the message, then content. Names in after that no
    call has, and cycles of them, are errors. Null or empty texts are messages with null or empty content;
    rows without conv_id or turn are messages, calls and results of a null conversation or turn, which
    come first, and those without conv_id are only messages. Position counts from 0 in the order of turn
    and place in the message, save that a call comes after those it depends on; rows that are alike take
    neighbouring positions. Other columns are not read. No rows in, no rows out.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    looks = F.col("role").isin("assistant", "tool") & F.ltrim(F.col("text"), F.lit(" \t\r\n")).startswith("{")
    rows = rows.withColumn("v", F.when(looks, F.try_parse_json("text")))
    listed = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    rows = rows.withColumn("calls", F.when((F.col("role") == "assistant") & F.col("conv_id").isNotNull(), listed))
    rows = rows.withColumn("of", F.when((F.col("role") == "tool") & F.col("conv_id").isNotNull(), F.try_variant_get("v", "$.tool_call_id", "string")))
    rows = rows.withColumn("is_call", F.coalesce(F.size("calls") > 0, F.lit(False)))
    calls = rows.where("is_call").select("conv_id", "turn", F.posexplode("calls").alias("place", "call"))
    get = lambda path, kind: F.try_variant_get("call", path, kind)
    arguments = get("$.arguments", "variant")
    arguments = F.when(_kind(arguments) == "STRING", F.try_parse_json(get("$.arguments", "string"))).otherwise(arguments)
    calls = calls.select("conv_id", "turn", "place", get("$.id", "string").alias("call_id"), get("$.name", "string").alias("name"), arguments.alias("arguments"), get("$.after", "array<string>").alias("after"))
    calls = calls.withColumn("errors", _errors(F.col("name"), F.col("arguments"), schemas)).withColumn("cid", F.monotonically_increasing_id())
    calls = cut(calls.withColumn("arguments_json", F.to_json("arguments")).drop("arguments"), "calls")
    result = F.to_json(F.try_variant_get("v", "$.content", "variant"))
    results = rows.where(F.col("of").isNotNull()).select("conv_id", F.col("of").alias("call_id"), F.col("turn").alias("result_turn"), result.alias("result_json"), F.monotonically_increasing_id().alias("rid"))
    results = cut(results, "results")
    firsts = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", "name", "arguments_json", "cid")).alias("first"))
    first_results = cut(results.groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "result_json", "rid")).alias("won")), "first_results")
    known = firsts.select("conv_id", "call_id", F.col("first.cid").alias("first_cid"), F.col("first.turn").alias("first_turn")).join(first_results.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    known = cut(known, "known")
    named = calls.select("cid", "conv_id", F.explode(F.array_distinct("after")).alias("call_id")).join(known.select("conv_id", "call_id", F.col("first_cid").alias("needs")), ["conv_id", "call_id"], "left")
    named = cut(named, "named")
    order = _order(calls.select("cid", "turn", "place"), named.where("needs is not null").select("cid", "needs"))
    bad = named.where("needs is null").groupBy("cid").agg(F.sort_array(F.collect_set(F.concat(F.lit("after "), F.coalesce("call_id", F.lit("null")), F.lit(" is no call")))).alias("bad"))
    main = calls.join(known, ["conv_id", "call_id"], "left").join(bad, "cid", "left").join(order, "cid", "left")
    again = F.col("call_id").isNotNull() & (F.col("cid") != F.col("first_cid"))
    main = main.withColumn("again", again).withColumn("won", F.when(~F.col("again"), F.col("won")))
    late = F.array(F.when(F.col("won.result_turn") <= F.col("turn"), F.lit("result before call")), F.when(F.col("again"), F.lit("identifier comes again")), F.when(F.col("call_id").isNull(), F.lit("no identifier")), F.when(F.col("cyclic"), F.lit("after goes round")))
    nothing = F.array().cast(NONE)
    errors = F.concat("errors", F.coalesce("bad", nothing), F.array_compact(late))
    raw = lambda c: F.coalesce(F.col(c), F.lit("null"))
    call_json = F.concat(F.lit('{"arguments":'), raw("arguments_json"), F.lit(',"id":'), _quote("call_id"), F.lit(',"name":'), _quote("name"), F.lit(',"result":'), raw("won.result_json"), F.lit("}"))
    where = [F.coalesce("ready.turn", "turn").alias("at_turn"), F.coalesce("ready.place", "place").alias("at_place"), F.coalesce("depth", F.lit(0)).alias("depth")]
    done_calls = main.select("conv_id", "turn", "place", *where, F.lit("call").alias("kind"), "call_id", F.col("won").isNotNull().alias("linked"), errors.alias("errors"), call_json.alias("json"))
    still = [F.col("turn").alias("at_turn"), F.lit(0).alias("at_place"), F.lit(0).alias("depth")]
    orphan = results.withColumnRenamed("result_turn", "turn").join(known.select("conv_id", "call_id", "won", "first_cid"), ["conv_id", "call_id"], "left").where(F.col("first_cid").isNull() | (F.col("rid") != F.col("won.rid")))
    why = F.when(F.col("first_cid").isNull(), F.lit("no such call")).otherwise("second result")
    result_json = F.concat(F.lit('{"id":'), _quote("call_id"), F.lit(',"result":'), raw("result_json"), F.lit("}"))
    done_results = orphan.select("conv_id", "turn", F.lit(0).alias("place"), *still, F.lit("result").alias("kind"), "call_id", F.lit(False).alias("linked"), F.array(why).alias("errors"), result_json.alias("json"))
    plain = rows.where(~F.col("is_call") & F.col("of").isNull())
    message_json = F.concat(F.lit('{"content":'), _quote("text"), F.lit(',"role":'), _quote("role"), F.lit("}"))
    done_rest = plain.select("conv_id", "turn", F.lit(0).alias("place"), *still, F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), nothing.alias("errors"), message_json.alias("json"))
    rows = done_calls.unionByName(done_results).unionByName(done_rest).withColumn("hash", F.xxhash64("json"))
    rows = cut(rows, "rows")
    order_by = [F.asc_nulls_first("at_turn"), F.asc("at_place"), F.asc("depth"), F.asc_nulls_first("turn"), F.asc("place"), F.asc("kind"), F.asc("hash")]
    out = numbered(rows, ["conv_id"], order_by, "position")
    return out.select("conv_id", "turn", "position", "kind", "call_id", "linked", F.concat_ws("; ", "errors").alias("errors"), "json")


def _quote(column: str) -> Column:
    """A string as JSON, null as null."""
    whole = F.to_json(F.struct(F.col(column).alias("x")))
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))


#: The tool that a user's turn is read as a call of.
REPLY = {"reply": {"properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}


def as_tool_calls(conversations: DataFrame) -> DataFrame:
    """Conversations without tools as messages with them: a user's turn calls reply, the next turn is the result."""
    call = F.struct(F.when(F.col("turn") >= 2, F.array(F.concat_ws(":", "conv_id", F.col("turn") - 2))).alias("after"), F.struct(F.col("text").alias("prompt"), F.col("turn")).alias("arguments"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("reply").alias("name"))
    result = F.struct(F.col("text").alias("content"), F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("tool_call_id"))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    text = F.when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(F.col("role") == "assistant", F.to_json(result)).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
