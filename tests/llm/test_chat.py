import json
import random
import time

from pyspark.sql import functions as F

from severa.llm import chat

SCHEMAS = {"find": {"q": ("string", True), "n": ("integer", False), "deep": ("object", False)}, "reply": {"prompt": ("string", True)}, "ping": {}}


def calls(*xs):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), x)) for x in xs]})


ROWS = [
    (1, 0, "user", "Please, \"now\"\n/é"),
    (1, 1, "assistant", calls(("b", "find", {"q": "x", "n": 2, "deep": {"z": 1, "a": [1, {"y": None, "b": True}]}}, ["a"]), ("a", "find", {"n": "2"}, []), ("c", "what", {}, ["b", "nobody"]))),
    (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "1"})),
    (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "2"})),
    (1, 4, "assistant", "Done"),
    (2, 0, "system", "hello"),
    (2, 1, "assistant", calls(("a", "ping", {}, ["b"]), ("b", "ping", {}, ["a"]), (None, "ping", [], []))),
    (2, 2, "tool", "no json"),
    (None, None, None, None),
    (3, 0, "user", None),
    (3, 0, "user", None),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, call string")


def test_links(spark):
    got = chat.link(frame(spark, ROWS), SCHEMAS).collect()
    calls_ = {(r.conv_id, r.call): r for r in got if r.kind == "call"}
    assert len([r for r in got if r.kind == "message"]) == len(ROWS)
    assert [calls_[1, x].level for x in "abc"] == [0, 1, 2]
    assert [calls_[1, x].linked for x in "abc"] == [True, False, False]
    assert calls_[1, "a"].faults == ["q is missing", "n is no integer"]
    assert calls_[1, "b"].faults == [] and calls_[1, "c"].faults == ["unknown tool"]
    assert calls_[2, "a"].level is calls_[2, "b"].level is None
    assert calls_[2, None].faults == ["arguments are no object"] and calls_[2, None].linked is False
    assert calls_[3, "turn:0"].faults == ["prompt is missing"]
    assert json.loads(calls_[1, "b"].json)["arguments"] == '{"deep":{"a":[1,{"b":true,"y":null}],"z":1},"n":2,"q":"x"}'
    assert len([r for r in got if r.conv_id == 3]) == 4
    results = {(r.conv_id, r.turn): r for r in got if r.kind == "result"}
    assert results[1, 2].linked and not results[1, 3].linked and results[2, 2].call is None


def test_long_chain(spark):
    chain = [(f"c{i}", "ping", {}, [f"c{i - 1}"] if i else []) for i in range(70)]
    rows = [(1, 0, "assistant", calls(*chain[::-1])), (1, 1, "tool", json.dumps({"tool_call_id": "c69", "content": ""})), (2, 0, "assistant", calls(("a", "ping", {}, ["b"]), ("b", "ping", {}, ["a"]), ("c", "ping", {}, ["b"])))]
    got = {(r.conv_id, r.kind, r.call): r.level for r in chat.link(frame(spark, rows), SCHEMAS).collect() if r.kind != "message"}
    assert got == {**{(1, "call", f"c{i}"): i for i in range(70)}, (1, "result", "c69"): 69, **{(2, "call", x): None for x in "abc"}}


def brute_levels(after):
    """Levels by relaxation; None for what a cycle holds up."""
    out = {x: 0 for x, ys in after.items() if not [y for y in ys if y in after]}
    moved = True
    while moved:
        moved = False
        for x, ys in after.items():
            ys = [y for y in ys if y in after]
            if x not in out and all(y in out for y in ys):
                out[x], moved = 1 + max(out[y] for y in ys), True
    return {x: out.get(x) for x in after}


def test_orders_of_any_shape(spark):
    rng = random.Random(4)
    want, rows = {}, []
    for c in range(12):
        n = rng.choice([3, 20, 60])
        after = {f"k{i}": [f"k{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3])) if i] + (["nobody"] if rng.random() < 0.1 else []) for i in range(n)}
        if c % 3 == 0:
            after["k0"] = [f"k{n - 1}"]
        want |= {(c, x): v for x, v in brute_levels(after).items()}
        rows.append((c, 0, "assistant", calls(*[(x, "ping", {}, ys) for x, ys in after.items()])))
    got = {(r.conv_id, r.call): r for r in chat.link(frame(spark, rows), SCHEMAS).collect() if r.kind == "call"}
    assert {k: r.level for k, r in got.items()} == want
    assert {k: r.cyclic for k, r in got.items()} == {k: v is None for k, v in want.items()}


def test_chain_of_thousands(spark):
    rows = [(1, 0, "assistant", calls(*[(f"c{i}", "ping", {}, [f"c{i - 1}"] if i else []) for i in range(3000)]))]
    began = time.perf_counter()
    got = {r.call: r.level for r in chat.link(frame(spark, rows), SCHEMAS).collect() if r.kind == "call"}
    assert got == {f"c{i}": i for i in range(3000)} and time.perf_counter() - began < 60


def test_long_texts_stay_whole(spark):
    big = 140_000_000
    text = F.repeat(F.lit("a"), (F.col("id") + big).cast("int"))  # made row by row
    one = lambda role, t, turn: spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), t.alias("text"))
    tool = F.concat(F.lit('{"tool_call_id": "turn:0", "content": "'), text, F.lit('"}'))
    rows = one("user", text, 0).union(one("assistant", text, 1)).union(one("tool", tool, 2))
    got = chat.link(rows).select("kind", "turn", "linked", "faults", F.length("json").alias("n")).collect()
    assert all(r.n >= big and r.linked and r.faults == [] for r in got) and len(got) == 6


def test_talk_of_calls_is_an_answer(spark):
    rows = [(1, 0, "user", "how?"), (1, 1, "assistant", 'Write {"tool_calls": ...} like "tool_calls".'), (2, 0, "user", "x"), (2, 1, "assistant", calls(("a", "ping", {}, [])))]
    got = {(r.conv_id, r.turn, r.kind): r.linked for r in chat.link(frame(spark, rows)).collect() if r.kind != "message"}
    assert got == {(1, 0, "call"): True, (1, 1, "result"): True, (2, 0, "call"): False, (2, 1, "call"): False}


def test_requests_and_replies(spark):
    rows = [(7, 0, "user", "a"), (7, 1, "assistant", "b"), (7, 2, "user", "c"), (8, 1, "assistant", "d")]
    got = chat.link(frame(spark, rows)).collect()
    assert {(r.conv_id, r.turn, r.kind): r.linked for r in got if r.kind != "message"} == {(7, 0, "call"): True, (7, 1, "result"): True, (7, 2, "call"): False, (8, 1, "result"): False}
    assert chat.link(frame(spark, rows).limit(0)).count() == 0


def test_canonical(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"d": [1, 2], "c": "é\\u00e9\\n"}}',), ("nope",), (None,)], "x string")
    assert [r[0] for r in df.select(chat.canonical(df["x"])).collect()] == ['{"a":{"c":"éé\\n","d":[1,2]},"b":1}', None, None]
