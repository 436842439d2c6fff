"""Chat formatting: tool calls linked to results, ordered, validated and serialised as canonical JSON.

Calls and results meet in a shuffled hash join on the call's identifier, which is
unique on both sides by then. A call may name
the call whose result it uses; its depth in that forest is its place in a
topological order and is found by pointer doubling, in rounds that grow with the
logarithm of the longest chain. Calls on a cycle, or that hang from one, have no
depth. No conversation is ever gathered: one call is one row throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import Scratch

#: tool -> argument -> (type, required, least, most); bounds are of length for strings, of value for numbers, and of the
#: number of elements for arrays; objects have none. Types: string, integer, number, boolean, array, object.
SCHEMAS = {
    "answer": {"text": ("string", True, 1, 4000), "turn": ("integer", True, 0, 1_000_000)},
    "configure": {"text": ("string", True, 1, 2000), "turn": ("integer", True, 0, 0)},
}


def quoted(s: Column) -> Column:
    """A string as JSON; null as null."""
    out = F.to_json(F.struct(s.alias("v")))
    return F.when(s.isNull(), F.lit("null")).otherwise(F.substring(out, F.lit(6), F.length(out) - 6))


def _is(kind: str, value: Column) -> Column:
    if kind == "integer":
        return value.rlike("^-?[0-9]{1,18}$")
    if kind == "number":
        return value.try_cast("double").isNotNull()
    if kind == "boolean":
        return value.isin("true", "false")
    if kind in ("array", "object"):
        return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith(kind.upper()), F.lit(False))
    return F.lit(True)


def _size(kind: str, value: Column) -> Column:
    if kind == "string":
        return F.length(value)
    if kind == "array":
        return F.json_array_length(value)
    return value.try_cast("double") if kind in ("integer", "number") else F.lit(None)


def problems(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments, in order of tool and argument name."""
    out = F.when(~F.coalesce(name.isin(*sorted(schemas)), F.lit(False)), F.array(F.lit("unknown tool")))
    for tool, wanted in sorted(schemas.items()):
        checks = []
        for arg, (kind, required, least, most) in sorted(wanted.items()):
            value = F.element_at(arguments, F.lit(arg))
            size = _size(kind, value)
            missing = F.lit(f"missing:{arg}") if required else F.lit(None)
            bad = F.when(~_is(kind, value), F.lit(f"type:{arg}")).when(F.coalesce((size < least) | (size > most), F.lit(False)), F.lit(f"range:{arg}"))
            checks.append(F.when(value.isNull(), missing).otherwise(bad))
        extra = F.transform(F.array_sort(F.array_except(F.map_keys(arguments), F.array(*map(F.lit, sorted(wanted))))), lambda k: F.concat(F.lit("unexpected:"), k))
        out = out.when(name == tool, F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.expr("cast(array() as array<string>)"))))
    return out


def canonical(name: Column, arguments: Column, schemas: dict) -> Column:
    """Arguments as JSON: keys in code point order, no blanks, values of the schema's type where they are of it, strings otherwise.

    Arrays and objects are serialised anew, so that keys at every depth are in order.
    """

    def shown(key: Column) -> Column:
        value = F.element_at(arguments, key)
        out = quoted(value)
        for tool, wanted in sorted(schemas.items()):
            for arg, (kind, *_) in sorted(wanted.items()):
                if kind != "string":
                    if kind in ("array", "object"):
                        plain = F.to_json(F.try_parse_json(value))
                    else:
                        plain = value.cast("string") if kind != "integer" else value.try_cast("long").cast("string")
                    out = F.when((name == tool) & (key == arg) & value.isNotNull() & _is(kind, value), plain).otherwise(out)
        return F.concat(quoted(key), F.lit(":"), out)

    body = F.concat_ws(",", F.transform(F.array_sort(F.map_keys(arguments)), shown))
    return F.concat(F.lit("{"), F.coalesce(body, F.lit("")), F.lit("}"))


def depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """call_id, depth of calls (call_id, parent_id) with unique identifiers; a parent that isn't there counts as none."""
    ids = calls.select(F.col("call_id").alias("up")).hint("shuffle_hash")
    state = calls.join(ids, F.col("parent_id") == F.col("up"), "left").select("call_id", "up", F.col("up").isNotNull().cast("long").alias("depth"))
    state = scratch.write("depth-0", state)
    n, rounds = state.count(), 0
    while state.filter("up is not null").limit(1).count() and (1 << rounds) <= n:
        rounds += 1
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = state.join(above.hint("shuffle_hash"), "up", "left").select("call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = scratch.write(f"depth-{rounds}", moved)
        scratch.drop(f"depth-{rounds - 1}")
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row per identifier: call_id, conv_id, turn, name, parent_id, depth, result_turn, n_calls, n_results, linked, valid, problems, json.

    ``calls`` has call_id, conv_id, turn, name, parent_id, arguments (map of
    strings); ``results`` has call_id, turn, text. Of calls or results that repeat an
    identifier the first by turn, then by content, stands for all and they are
    counted. Results without a call have n_calls 0 and are not valid; calls without
    a result are not linked. Rows without an identifier are left out: nothing can
    refer to them. Texts of any length are serialised whole. Extra columns are not
    read, whatever their names; empty tables give no rows.
    """
    schemas = SCHEMAS if schemas is None else schemas
    scratch = Scratch(calls.sparkSession, "tool-calls")
    shaped = calls.filter("call_id is not null").select("call_id", F.struct("turn", "conv_id", "name", "parent_id", F.array_sort(F.map_entries("arguments")).alias("entries")).alias("c"))
    first = scratch.write("calls", shaped.groupBy("call_id").agg(F.min("c").alias("c"), F.count("*").alias("n_calls")))
    answers = results.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "text")).alias("r"), F.count("*").alias("n_results"))
    order = depths(first.select("call_id", "c.parent_id"), scratch)
    both = first.join(order.hint("shuffle_hash"), "call_id").join(answers.hint("shuffle_hash"), "call_id", "full_outer")
    both = both.select("call_id", "c.conv_id", "c.turn", "c.name", "c.parent_id", "depth", F.map_from_entries("c.entries").alias("arguments"), F.col("r.turn").alias("result_turn"), F.col("r.text").alias("result"), "n_calls", "n_results")
    counted = both.withColumns({"n_calls": F.coalesce("n_calls", F.lit(0)).cast("long"), "n_results": F.coalesce("n_results", F.lit(0)).cast("long")})
    wrong = F.when(F.col("n_calls") == 0, F.array(F.lit("no call"))).otherwise(problems(F.col("name"), F.col("arguments"), schemas))
    counted = counted.withColumn("problems", F.concat_ws(",", wrong))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    json = F.concat(
        F.lit('{"arguments":'), F.when(F.col("arguments").isNull(), F.lit("null")).otherwise(canonical(F.col("name"), F.col("arguments"), schemas)),
        F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"parent":'), quoted(F.col("parent_id")),
        F.lit(',"result":'), quoted(F.col("result")), F.lit(',"turn":'), number("turn"), F.lit("}"),
    )
    linked = (F.col("n_calls") > 0) & (F.col("n_results") > 0)
    return counted.select("call_id", "conv_id", "turn", "name", "parent_id", "depth", "result_turn", "n_calls", "n_results", linked.alias("linked"), (F.col("problems") == "").alias("valid"), "problems", json.alias("json"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns (conv_id, turn, role, text) as calls and results.

    A turn that isn't the assistant's asks for a call, named configure for the
    system and answer otherwise; it builds on the request two turns before, or else
    one turn before. An assistant's turn is the result of the turn before it. Turns
    without conversation or number have no identifier.
    """
    key = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    asked = turns.filter(~F.coalesce(F.col("role") == "assistant", F.lit(False)))
    ids = asked.select(key(0).alias("call_id")).filter("call_id is not null").distinct()
    calls = asked.select(
        key(0).alias("call_id"), "conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("role") == "system", "configure").otherwise("answer").alias("name"),
        key(2).alias("two"), key(1).alias("one"), F.create_map(F.lit("text"), F.col("text"), F.lit("turn"), F.col("turn").cast("string")).alias("arguments"),
    )
    calls = calls.join(ids.select(F.col("call_id").alias("two"), F.lit(True).alias("has_two")).hint("shuffle_hash"), "two", "left").join(ids.select(F.col("call_id").alias("one"), F.lit(True).alias("has_one")).hint("shuffle_hash"), "one", "left")
    calls = calls.withColumn("parent_id", F.when(F.col("has_two"), F.col("two")).when(F.col("has_one"), F.col("one")))
    results = turns.filter(F.col("role") == "assistant").select(key(1).alias("call_id"), F.col("turn").cast("long").alias("turn"), "text")
    return calls.select("call_id", "conv_id", "turn", "name", "parent_id", "arguments"), results


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages whose text is JSON as calls and results.

    An assistant's ``{"tool_calls": [{"id", "name", "parent", "arguments": {}}]}`` has
    calls, a tool's ``{"tool_call_id", "content"}`` is a result; other texts have neither.
    """
    schema = "tool_calls array<struct<id string, name string, parent string, arguments map<string, string>>>"
    calls = messages.filter("role = 'assistant'").select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(F.from_json("text", schema)["tool_calls"]).alias("c"))
    results = messages.filter("role = 'tool'").select(F.from_json("text", "tool_call_id string, content string").alias("r"), F.col("turn").cast("long").alias("turn"))
    return calls.select(F.col("c.id").alias("call_id"), "conv_id", "turn", "c.name", F.col("c.parent").alias("parent_id"), "c.arguments"), results.select(F.col("r.tool_call_id").alias("call_id"), "turn", F.col("r.content").alias("text"))
