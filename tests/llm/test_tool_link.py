import json
import random

from pyspark.sql import functions as F

from graphloom.llm import tool_link as T

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, level int"
SCHEMAS = {"find": {"q": ("string", True), "n": ("integer", False)}, "stop": {}}


def link(spark, calls, results):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, 9) for x in results], RESULTS)
    return T.link_calls(c, r, SCHEMAS).collect()


def test_links_levels_and_validity(spark):
    args = ['{"n":1,"q":"a"}', '{"q": "b"}', '{"q":1}', '{"n":2}', '{"q":"a","x":1}', "{bad", None, "[1]", '{"q":null}']
    calls = [(1, i, f"c{i}", "find", a, [f"c{i - 1}"] if i else None) for i, a in enumerate(args)]
    calls += [(2, 0, "s", "stop", "{}", []), (2, 1, "t", "stop", '{"a":1}', ["s", "nowhere"]), (2, 2, "u", "other", "{}", ["t", "s"]), (2, 3, None, "stop", "{}", None), (2, 4, "s", "stop", "{}", [])]
    calls += [(3, 0, "x", "stop", "{}", ["y"]), (3, 1, "y", "stop", "{}", ["x"]), (3, 2, "z", "stop", "{}", ["y"]), (3, 3, "w", "stop", "{}", ["w"])]
    results = [(1, 5, "c0", "one"), (1, 6, "c0", "two"), (2, 9, "s", None), (2, 9, "ghost", "?"), (2, 9, None, "?")]
    rows = link(spark, calls, results)
    assert len(rows) == len(calls) + len(results)
    call = {(r.call_id, r.turn): r for r in rows if r.kind == "call"}
    assert [call[f"c{i}", i].valid for i in range(len(args))] == [True, True, False, False, False, False, False, False, False]
    assert [call[f"c{i}", i].level for i in range(len(args))] == [2 * i for i in range(len(args))]
    assert (call["s", 0].status, call["s", 4].status, call["c0", 0].status, call["c1", 1].status) == ("linked", "repeated", "linked", "unanswered")
    assert (call["s", 0].valid, call["t", 1].valid, call["u", 2].valid) == (True, False, False)
    assert (call["t", 1].level, call["u", 2].level) == (2, 4)
    assert all(call[k].level is None for k in (("x", 0), ("y", 1), ("z", 2), ("w", 3)))
    assert sorted(r.status for r in rows if r.kind == "result") == ["linked", "linked", "linked", "orphan", "orphan"]
    assert call["c0", 0].message == json.dumps({"arguments": {"n": 1, "q": "a"}, "id": "c0", "name": "find", "type": "call"}, separators=(",", ":"), sort_keys=True)


def test_canonical(spark):
    rows = spark.createDataFrame([('{ "b": [1, {"z": 1, "y": null}], "a": "x\\n\\u00e9" }',), ("nope",), (None,)], "j string")
    assert [r[0] for r in rows.select(T.canonical(rows.j)).collect()] == ['{"a":"x\\né","b":[1,{"y":null,"z":1}]}', None, None]


def test_conversations_and_empty(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", None), (2, 2, "assistant", "late"), (3, 0, None, "x")], "conv_id long, turn long, role string, text string")
    rows = T.link_calls(*T.conversation_calls(turns), T.SCHEMAS).collect()
    got = {(r.conv_id, r.turn): (r.kind, r.level, r.status, r.valid) for r in rows}
    assert got.pop((3, 0)) == ("result", None, "orphan", False)  # no role: read as an answer
    assert got == {(1, 0): ("call", 0, "unanswered", True), (1, 1): ("call", 2, "linked", True), (1, 2): ("result", 3, "linked", True), (2, 0): ("call", 0, "unanswered", False), (2, 2): ("result", None, "orphan", False)}
    assert T.link_calls(*T.conversation_calls(turns.limit(0)), T.SCHEMAS).count() == 0


def test_long_chains_and_diamonds(spark):
    """Levels are longest ways, positions topological; a chain of 300 calls takes few rounds."""
    rng = random.Random(2)
    calls = [(1, i, f"a{i}", "stop", "{}", [f"a{i - 1}"] if i else []) for i in range(300)]
    deps = {}
    for i in range(60):
        deps[f"b{i}"] = [f"b{j}" for j in sorted(rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3]))))]
        calls.append((2, rng.randrange(9), f"b{i}", "stop", "{}", deps[f"b{i}"]))
    calls += [(3, 0, "x", "stop", "{}", ["x"]), (3, 1, "y", "stop", "{}", ["x", "a0"]), (3, 2, "z", "stop", "{}", ["y"])]
    rows = link(spark, calls, [(1, 500, "a7", "r"), (1, 0, "a299", "r")])
    level = {f"a{i}": i for i in range(300)} | {"x": None, "y": None, "z": None}
    for b, of in deps.items():
        level[b] = 1 + max((level[x] for x in of), default=-1)
    assert all(r.level == (None if level[r.call_id] is None else 2 * level[r.call_id] + (r.kind == "result")) for r in rows)
    for conv in (1, 2, 3):
        mine = sorted((r for r in rows if r.conv_id == conv), key=lambda r: (r.level is None, r.level, r.turn, r.kind, r.call_id))
        assert [r.position for r in mine] == list(range(len(mine)))


def test_bounds(spark):
    schemas = {"f": {"s": T.Param("string", True, 2, 4), "n": T.Param("number", False, 0, 1.5)}}
    args = {'{"s":"ab"}': True, '{"s":"日本語日"}': True, '{"s":"a"}': False, '{"s":"abcde"}': False, '{"s":"abc","n":1.5}': True, '{"s":"abc","n":2}': False, '{"s":"abc","n":-1}': False, '{"n":1}': False}
    rows = spark.createDataFrame([(a,) for a in args], "a string")
    got = {r.a: r.ok for r in rows.select("a", T.valid_arguments(F.lit("f"), F.col("a"), schemas).alias("ok")).collect()}
    assert got == args
