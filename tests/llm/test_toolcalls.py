from __future__ import annotations

import json
import random

import pytest

from tessera.llm import toolcalls

CALLS = "conv_id long, call_id string, at long, name string, arguments string, needs array<string>, lost string"
RESULTS = "conv_id long, call_id string, content string, called boolean"
SCHEMAS = {"sum": {"a": ("integer", True), "b": ("number", False), "note": ("string", False)}, "noop": {}}


def linked(spark, calls, results):
    a = spark.createDataFrame([(*c, "clash") for c in calls], CALLS)
    b = spark.createDataFrame([(*r, True) for r in results], RESULTS)
    return {(r.conv_id, r.call_id): r for r in toolcalls.link(a, b, SCHEMAS).collect()}


def test_links_order_and_json(spark):
    calls = [
        (1, "a", 0, "sum", '{"b": 1.5, "a": 2}', []),
        (1, "b", 1, "sum", '{"a": "x", "z": 1}', ["a", "gone"]),
        (1, "c", 2, "noop", "{}", ["b", None]),
        (1, "c", 3, "sum", "{}", []),
        (2, "a", 0, "other", "[1]", None),
        (2, "b", 1, "noop", 'not "json"', []),
        (None, "a", 0, "noop", "{}", []),
        (3, None, 0, "noop", "{}", []),
    ]
    results = [(1, "a", 'say "hi"\n'), (1, "a", "zzz"), (1, "q", "é"), (2, "a", None), (None, "a", "x")]
    got = linked(spark, calls, results)
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "q"), (2, "a"), (2, "b")}
    assert [got[1, k].position for k in "abc"] == [0, 1, 2] and got[1, "q"].position is None
    assert [got[1, k].status for k in "abcq"] == ["linked", "no_result", "no_result", "no_call"]
    assert got[1, "a"].json == '{"arguments":{"a":2,"b":1.5},"content":"say \\"hi\\"\\n","id":"a","name":"sum"}'
    assert got[1, "b"].problems == "type:a,unknown:z,needs:gone"
    assert got[1, "a"].valid and got[1, "c"].valid and not got[1, "b"].valid and not got[1, "q"].valid
    assert got[2, "a"].problems == "not_an_object" and got[2, "b"].problems == "not_an_object"
    for r in got.values():
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_topological_order_of_misplaced_calls(spark):
    calls = [(1, f"c{i}", i, "noop", "{}", [f"c{i + 1}"] if i < 4 else []) for i in range(5)]
    calls += [(2, "x", 0, "noop", "{}", ["y"]), (2, "y", 1, "noop", "{}", ["x"]), (2, "z", 2, "noop", "{}", [])]
    got = linked(spark, calls, [])
    assert [got[1, f"c{i}"].position for i in range(5)] == [4, 3, 2, 1, 0]
    assert not any(got[1, f"c{i}"].circle for i in range(5))
    assert got[2, "x"].circle and got[2, "y"].circle and not got[2, "z"].circle
    assert [got[2, k].position for k in "zxy"] == [0, 1, 2]


def test_levels_of_any_graph(spark):
    """Random needs, several and one, forwards and backwards, circles: levels by brute force."""
    rng = random.Random(3)
    calls, needs = [], {}
    for conv in range(12):
        n = rng.randint(2, 25)
        for i in range(n):
            few = rng.choice([0, 1, 1, 1, 2, 3]) if conv % 3 else 1
            pick = [f"c{rng.randrange(n) if rng.random() < 0.15 else rng.randrange(i + 1, n + 1)}" for _ in range(few)] if conv % 3 else [f"c{i + 1}"]
            needs[conv, f"c{i}"] = {x for x in pick if int(x[1:]) < n}
            calls.append((conv, f"c{i}", i, "noop", "{}", pick))

    def level(c, path=()):
        if c in path:
            return None
        below = [level((c[0], x), (*path, c)) for x in needs[c]]
        return None if None in below else max((b + 1 for b in below), default=0)

    df = spark.createDataFrame([c[:5] for c in calls], "conv_id long, call_id string, at long, name string, arguments string")
    edges = spark.createDataFrame([(c[0], c[1], x) for c in calls for x in c[5]], "conv_id long, call_id string, need string")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(df, edges).collect()}
    odd = {c[0] for c in calls if any(int(x[1:]) >= c[2] for x in needs[c[0], c[1]])}
    assert got == {c: level(c) for c in needs if c[0] in odd}
    assert None in got.values() and max(x for x in got.values() if x is not None) > 5


def test_long_conversations_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "PIECE", 4)
    got = linked(spark, [(1, f"c{i}", i * 3, "noop", "{}", []) for i in range(30)], [])
    assert [got[1, f"c{i}"].position for i in range(30)] == list(range(30))


@pytest.mark.parametrize("args,said", [('{"a": 1}', ""), ('{"a": null}', "type:a"), ('{"a": 1, "b": "x"}', "type:b"), ("{}", "missing:a"), ("", "not_an_object"), ('{"a": true, "note": 3}', "type:a,type:note"), ('{"a": 99999999999999999999}', ""), ('{"a": 1.0}', ""), ('{"a": 1e3}', ""), ('{"a": 1.5}', "type:a")])
def test_schemas(spark, args, said):
    assert linked(spark, [(1, "a", 0, "sum", args, [])], [])[1, "a"].problems == said


def test_parameters_with_odd_names(spark):
    schemas = {"f": {"a.b": ("string", True), "c d": ("integer", True), "e'f": ("boolean", True)}}
    a = spark.createDataFrame([(1, "a", 0, "f", '{"a.b": "x", "c d": 2, "e\'f": true}', [], "clash")], CALLS)
    assert toolcalls.link(a, spark.createDataFrame([], RESULTS), schemas).head().problems == ""


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", "xy"), (1, None, "user", "x"), (None, 0, "user", "x"), (2, 5, "user", "too late"), (3, 1, None, "x"), (4, 0, "user", None), (4, 2, "user", "ab")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS call_id", "2 AS at")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(*toolcalls.from_conversations(df), toolcalls.REPLY).collect()}
    assert set(got) == {(1, "c0"), (1, "c2"), (2, "c5"), (4, "c0"), (4, "c2")}
    assert got[1, "c0"].status == "linked" and got[1, "c2"].valid and got[2, "c5"].problems == "needs:c7"
    assert got[4, "c0"].circle and got[4, "c2"].circle and not got[1, "c2"].circle
    assert toolcalls.link(*toolcalls.from_conversations(df.where("false")), toolcalls.REPLY).count() == 0


NESTED = {
    "f": {
        "type": "object",
        "properties": {
            "a": {
                "type": "object",
                "properties": {"b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": ["integer", "null"]}}, "required": ["c"], "additionalProperties": False}}},
                "required": ["b"],
            },
            "e": {"enum": ["x", 2, {"k": [1]}]},
            "n": {"type": "number", "minimum": 1, "maximum": 2.5},
            "s": {"type": "string", "minLength": 1, "maxLength": 2},
            "l": {"type": "array", "minItems": 1, "maxItems": 2},
        },
    }
}


@pytest.mark.parametrize(
    "args,said",
    [
        ('{"a": {"b": [{"c": 1}, {"c": null}]}, "free": 1}', ""),
        ('{"a": {"b": [{"c": "x"}, {"c": "y"}, {}]}}', "missing:a.b[].c,type:a.b[].c"),
        ('{"a": {"b": [{"c": 1, "d": 2}, 5], "z": 1}}', "type:a.b[],unknown:a.b[].d"),
        ('{"a": {"b": {}}}', "type:a.b"),
        ('{"a": {}}', "missing:a.b"),
        ('{"a": []}', "type:a"),
        ('{"a": {"b": []}, "e": "x"}', ""),
        ('{"e": 2}', ""),
        ('{"e": {"k": [ 1 ]}}', ""),
        ('{"e": "y"}', "enum:e"),
        ('{"n": 0.5, "s": "", "l": []}', "minItems:l,minLength:s,minimum:n"),
        ('{"n": 2.6, "s": "äöü", "l": [1, 2, 3]}', "maxItems:l,maxLength:s,maximum:n"),
        ('{"n": 2.5, "s": "äö", "l": [null]}', ""),
        ('{"n": "2", "s": 1, "l": "x"}', "type:l,type:n,type:s"),
    ],
)
def test_nested_schemas(spark, args, said):
    a = spark.createDataFrame([(1, "a", 0, "f", args, [], "clash")], CALLS)
    assert toolcalls.link(a, spark.createDataFrame([], RESULTS), NESTED).head().problems == said


def test_the_query_has_every_kind_of_problem(spark):
    """Each remainder of the text's length, and calls that need two others."""
    rows = [(1, 2 * i, "user", "x" * (12 * 7 + i)) for i in range(14)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.from_conversations(df)
    got = {r.call_id: r for r in toolcalls.link(calls, results, toolcalls.REPLY).collect()}
    said = {3: "type:turn", 4: "missing:question", 5: "minimum:options.limit,unknown:mood", 6: "enum:options.tone,type:options.tags[]"}
    for i in range(14):
        assert [p for p in got[f"c{2 * i}"].problems.split(",") if not p.startswith("needs:")] == said.get(i % 7, "").split(","), i
    assert {len(r.needs) for r in calls.collect()} == {0, 1, 2}
    assert {r.valid for r in got.values()} == {True, False}
