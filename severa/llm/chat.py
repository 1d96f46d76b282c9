"""Chat formatting: tool calls linked to results, ordered, validated and serialised as canonical JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.llm.common import written

#: Calls in a text: {"tool_calls": [{"id": ..., "name": ..., "arguments": {...}, "after": [ids]}]}; arguments stay JSON text.
CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
#: A result in a text: {"tool_call_id": ..., "content": ...}.
RESULT = "tool_call_id string, content string"
#: A string in JSON may be as long as a text can be.
LONG = {"maxStringLen": str((1 << 31) - 1)}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _calls(text: Column) -> Column:
    """The calls of an assistant's text; null for a text that holds none, also if it only speaks of tool_calls."""
    return F.when(F.contains(text, F.lit('"tool_calls"')), F.from_json(text, CALLS, LONG)["tool_calls"])


def calls_of(messages: DataFrame, implicit: bool = True) -> DataFrame:
    """(conv_id, turn, call, name, arguments, checked, after): a row per tool call of an assistant's turn.

    arguments are canonical; checked is what their check needs to see of them. With implicit, a user's turn is a call too: of
    the tool `reply`, by the identifier turn:N, with the text as its argument. A call without an identifier can't be
    linked and has none.
    """
    made = messages.where(F.col("role") == "assistant").select("conv_id", "turn", F.explode(_calls(F.col("text"))).alias("c"))
    made = made.select("conv_id", "turn", F.col("c.id").alias("call"), "c.name", F.coalesce(canonical(F.col("c.arguments")), "c.arguments").alias("arguments"), F.col("c.arguments").alias("checked"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    if not implicit:
        return made
    asked = messages.where(F.col("role") == "user").select(
        "conv_id", "turn", F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("call"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"), F.to_json(F.struct(F.when(F.col("text").isNotNull(), F.lit("")).alias("prompt"))).alias("checked"), F.array().cast("array<string>").alias("after"),
    )
    return made.union(asked)


def results_of(messages: DataFrame, implicit: bool = True) -> DataFrame:
    """(conv_id, turn, call, content): a row per result. With implicit, an assistant's turn without calls answers the turn before it."""
    parsed = F.from_json("text", RESULT, LONG)
    told = messages.where(F.col("role") == "tool").select("conv_id", "turn", parsed["tool_call_id"].alias("call"), parsed["content"].alias("content"))
    if not implicit:
        return told
    answer = messages.where((F.col("role") == "assistant") & _calls(F.col("text")).isNull())
    return told.union(answer.select("conv_id", "turn", F.concat(F.lit("turn:"), (F.col("turn") - 1).cast("string")).alias("call"), F.col("text").alias("content")))


#: Schemas of tools: tool -> {argument: (type, required)}; types as in JSON.
SCHEMAS = {"reply": {"prompt": ("string", True)}}


def faults(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments: an array of texts, empty for a valid call.

    schemas are of a bounded, given number of tools and become one expression. An object of over 100 MB is more than a
    parsed value holds; it is passed on whole, and told to be unchecked.
    """
    value = F.try_parse_json(arguments)
    kinds = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$"}
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        tests = []
        for field, (kind, required) in fields.items():
            got = F.schema_of_variant(F.variant_get(value, f"$['{field}']", "variant"))
            if required:
                tests.append(F.when(got.isNull() | (got == "VOID"), F.lit(f"{field} is missing")))
            tests.append(F.when(got.isNotNull() & (got != "VOID") & ~got.rlike(kinds[kind]), F.lit(f"{field} is no {kind}")))
        listed = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
        out = F.when(name == tool, listed).otherwise(out)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    huge = value.isNull() & arguments.startswith("{") & (F.octet_length(arguments) > 100_000_000)
    return F.when(is_object, out).when(huge, F.array(F.lit("arguments are too large to check"))).otherwise(F.array(F.lit("arguments are no object")))


def _anchors(waits: DataFrame) -> DataFrame:
    """(conv_id, call, anchor, steps) of calls that wait for exactly one other: the first call up their chain that waits for
    none or for several, and how far it is. Pointers double, so rounds grow with the logarithm of a chain's length.
    Calls whose chain runs in a circle don't come back."""
    one = written(waits.groupBy("conv_id", "call").agg(F.count("*").alias("n"), F.min("needs").alias("anchor")).where("n = 1").select("conv_id", "call", "anchor", F.lit(1).cast("long").alias("steps")), "chains")
    single = one.select("conv_id", F.col("call").alias("anchor"), F.lit(True).alias("more"))
    n, longest, at = one.count(), 1, one
    while longest <= n:  # after so many doublings, what still has a way up goes round in a circle
        up = at.select("conv_id", F.col("call").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("further"))
        joined = at.join(up, ["conv_id", "anchor"], "left")
        moved = joined.select("conv_id", "call", F.coalesce("next", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"))
        after = written(moved, "chains")
        settled = after.where("moved").isEmpty()
        at, longest = after.drop("moved"), 2 * longest
        if settled:
            break
    return at.join(single, ["conv_id", "anchor"], "left_anti").select("conv_id", "call", "anchor", "steps")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call, level): the topological order of calls by their `after` lists, 0 for those that wait for none.

    A call stands one level above the highest it waits for; identifiers that no call has don't count. Chains, of calls
    that each wait for one other, are followed by doubling pointers to where they begin. The calls that wait for several
    are then ordered in Kahn's rounds, of all conversations at once, as many as they stand on top of each other, and
    only what still waits is written again. Calls in cycles, and those that wait for them, don't come back.
    """
    known = calls.where("call is not null").select("conv_id", "call").distinct()
    waits = calls.where("call is not null and size(after) > 0").select("conv_id", "call", F.explode("after").alias("needs")).distinct()
    waits = written(waits.join(known.withColumnRenamed("call", "needs"), ["conv_id", "needs"], "left_semi"), "waits")
    zero = F.lit(0).cast("long")
    if waits.isEmpty():
        return known.withColumn("level", zero.cast("int"))
    chain = written(_anchors(waits), "anchors")
    # what a call with several waits for, as the begin of its chain and the steps from there
    several = waits.groupBy("conv_id", "call").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", "call")
    begun = chain.select("conv_id", F.col("call").alias("needs"), "anchor", "steps")
    left = waits.join(several, ["conv_id", "call"], "left_semi").join(begun, ["conv_id", "needs"], "left")
    left = written(left.select("conv_id", "call", F.coalesce("anchor", "needs").alias("needs"), F.coalesce("steps", zero).alias("steps")), "several")
    ready = written(known.join(waits.select("conv_id", "call").distinct(), ["conv_id", "call"], "left_anti").withColumn("level", zero), "ready")
    pieces, met = [ready], left.select("conv_id", "call", F.lit(None).cast("long").alias("reached")).limit(0)
    while not left.isEmpty():
        done = left.join(ready.select("conv_id", F.col("call").alias("needs"), "level"), ["conv_id", "needs"], "left")
        done = written(done.select("conv_id", "call", "needs", "steps", (F.col("level") + F.col("steps") + 1).alias("reached")), "done", (left,))
        met = written(met.union(done.where("reached is not null").select("conv_id", "call", "reached")).groupBy("conv_id", "call").agg(F.max("reached").alias("reached")), "met")
        left = done.where("reached is null").select("conv_id", "call", "needs", "steps")
        waiting = left.select("conv_id", "call").distinct()
        ready = written(met.join(waiting, ["conv_id", "call"], "left_anti").select("conv_id", "call", F.col("reached").alias("level")), "ready")
        if ready.isEmpty():
            break
        left = written(left, "several")
        met = met.join(ready, ["conv_id", "call"], "left_anti")
        pieces.append(ready)
    fixed = reduce(DataFrame.union, pieces)
    tops = fixed.select("conv_id", F.col("call").alias("anchor"), "level")
    along = chain.join(tops, ["conv_id", "anchor"]).select("conv_id", "call", (F.col("level") + F.col("steps")).alias("level"))
    return fixed.union(along).select("conv_id", "call", F.col("level").cast("int").alias("level"))


def link(messages: DataFrame, schemas: dict | None = None, implicit: bool = True) -> DataFrame:
    """One row per message, call and result of messages (conv_id, turn, role, text), with its canonical JSON.

    conv_id, turn, kind (message, call or result), call (identifier), linked (a call has a result in its
    conversation, a result a call), level (topological; null for calls in a cycle, those that wait for them and their
    results), cyclic (whether that is why), faults (of a call's arguments) and json: sorted keys, no white space, nulls left out.
    Texts of any length stay whole: nothing is parsed again only to be written. Calls and results meet in a hash join by conversation and identifier,
    a side of which is reduced to distinct identifiers first, so repeated ones link but never multiply rows.
    Null conversations and identifiers link nothing. Repeated rows come back repeated; an empty table gives an
    empty one; other columns are ignored.
    """
    slim = messages.select("conv_id", "turn", "role", "text")
    calls, results = calls_of(slim, implicit), results_of(slim, implicit)
    answered = results.select("conv_id", "call").where("call is not null").distinct().withColumn("answered", F.lit(True))
    asked = calls.select("conv_id", "call").where("call is not null").distinct().withColumn("asked", F.lit(True))
    order = levels(calls)
    none = F.array().cast("array<string>")
    c = calls.join(answered, ["conv_id", "call"], "left").join(order, ["conv_id", "call"], "left")
    c = c.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call", F.col("answered").isNotNull().alias("linked"), F.when(F.col("call").isNull(), 0).otherwise(F.col("level")).alias("level"),
        (F.col("call").isNotNull() & F.col("level").isNull()).alias("cyclic"), faults(F.col("name"), F.col("checked"), SCHEMAS if schemas is None else schemas).alias("faults"),
        F.to_json(F.struct("arguments", F.col("call").alias("id"), "name")).alias("json"),
    )
    r = results.join(asked, ["conv_id", "call"], "left").join(order, ["conv_id", "call"], "left")
    r = r.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call", F.col("asked").isNotNull().alias("linked"), "level", (F.col("asked").isNotNull() & F.col("level").isNull()).alias("cyclic"), none.alias("faults"),
        F.to_json(F.struct("content", F.col("call").alias("tool_call_id"))).alias("json"),
    )
    m = slim.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call"), F.lit(True).alias("linked"), F.lit(0).alias("level"), F.lit(False).alias("cyclic"), none.alias("faults"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    return m.unionByName(c).unionByName(r)
