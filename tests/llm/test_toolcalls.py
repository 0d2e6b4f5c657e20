import json
import random

from pyspark.sql import functions as F

from tapeloom.llm.common import table
from tapeloom.llm.toolcalls import ToolCallConfig, link_conversations, link_tool_calls, orphan_results, whole_conversations

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, level int"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = "name string, param string, type string, required boolean"


def frames(spark, calls, results=(), schemas=()):
    return spark.createDataFrame([(*c, 9) for c in calls], CALLS), spark.createDataFrame(list(results), RESULTS), spark.createDataFrame(list(schemas), SCHEMAS)


def topological(rows, after):
    place = {r.call_id: i for i, r in enumerate(sorted((r for r in rows if r.level is not None), key=lambda r: (r.level, r.turn, r.call_id)))}
    return all(place[d] < place[c] for c, ds in after.items() for d in ds if c in place and d in place)


def test_order_puts_every_call_after_its_dependencies(spark):
    after = {"a": ["c"], "b": ["a"], "c": [], "d": ["b", "c"], "e": ["f"], "f": ["d"], "g": []}
    turns = {x: i for i, x in enumerate("abcdefg")}
    calls = [(1, c, turns[c], "t", "{}", ds) for c, ds in after.items()]
    loop = [(2, "x", 1, "t", "{}", ["z"]), (2, "y", 2, "t", "{}", ["x"]), (2, "z", 3, "t", "{}", ["y"]), (2, "w", 4, "t", "{}", ["z"]), (2, "v", 0, "t", "{}", []), (2, "u", 5, "t", "{}", ["u"])]
    plain = [(3, "p", 1, "t", "{}", []), (3, "q", 2, "t", "{}", ["p", "nowhere"])]
    got = link_tool_calls(*frames(spark, calls + loop + plain)).collect()
    assert topological([r for r in got if r.conv_id == 1], after) and all(r.level is not None for r in got if r.conv_id == 1)
    by = {(r.conv_id, r.call_id): r for r in got}
    assert {c for (v, c), r in by.items() if "cycle" in r.errors} == {"x", "y", "z", "w", "u"}
    assert by[2, "v"].level == 0 and by[3, "q"].level == 0 and "lost_dependency" in by[3, "q"].errors


def test_arguments_are_checked_and_canonical(spark):
    schemas = [("f", "a", "integer", True), ("f", "b", "number", False), ("f", "c", "string", False), ("f", "d", "object", False), ("f", "e", "array", False), ("f", "g", "boolean", False), ("f", "h", "null", None), ("f", None, "string", True)]
    args = {
        "ok": ('{ "d": {"z": 1, "a": [1, {"y": null, "b": "é\\u00e9\\n\\"/"}]}, "a": 3, "b": 2, "c": "x", "e": [], "g": true, "h": null }', []),
        "types": ('{"a": "3", "b": "x", "c": 1, "d": [], "e": {}, "g": 0, "h": 1}', ["type:a", "type:b", "type:c", "type:d", "type:e", "type:g", "type:h"]),
        "float": ('{"a": 3.5, "b": 3.5}', ["type:a"]),
        "more": ('{"b": 1, "zz": 2}', ["missing:a", "unknown:zz"]),
        "list": ("[1]", ["invalid_json"]),
        "bad": ('{"a": ', ["invalid_json"]),
        "none": (None, ["invalid_json"]),
    }
    calls = [(1, k, 1, "f", a, None) for k, (a, _) in args.items()] + [(1, "tool", 1, "g", "{}", None), (1, "anon", 1, None, "{}", None)]
    results = [(1, k, 2, 'say "hi"\n') for k in (*args, "tool", "anon")]
    got = {r.call_id: r for r in link_tool_calls(*frames(spark, calls, results, schemas)).collect()}
    for k, (a, errors) in args.items():
        assert got[k].errors == errors, k
        if errors != ["invalid_json"]:
            body = json.loads(got[k].json)
            assert body["arguments"] == json.loads(a) and body["result"] == 'say "hi"\n' and body["id"] == k
            assert got[k].json == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        else:
            assert json.loads(got[k].json)["arguments"] == (a or "")
    assert got["tool"].errors == ["unknown_tool"] and got["anon"].errors == ["unknown_tool"]


def test_links_repeats_nulls_and_orphans(spark):
    calls = [(1, "a", 3, "f", '{"x":1}', None), (1, "a", 2, "f", '{"x":2}', [None]), (1, None, 1, "f", "{}", None), (None, "a", 1, "f", '{"x":1}', None), (2, "a", 5, "f", '{"x":1}', None), (2, "b", 1, "f", '{"x":1}', None)]
    results = [(1, "a", 9, "late"), (1, "a", 4, "z"), (1, "a", 4, "b"), (None, "a", 2, None), (2, "a", 5, "same turn"), (2, "zz", 1, "orphan"), (2, None, 1, "no id")]
    c, r, s = frames(spark, calls, results, [("f", "x", "integer", True)])
    got = {(x.conv_id, x.call_id): x for x in link_tool_calls(c, r, s).collect()}
    assert set(got) == {(1, "a"), (None, "a"), (2, "a"), (2, "b")}
    assert got[1, "a"].errors == ["repeated_call", "repeated_result"] and json.loads(got[1, "a"].json)["arguments"] == {"x": 2} and json.loads(got[1, "a"].json)["result"] == "b"
    assert got[None, "a"].errors == [] and json.loads(got[None, "a"].json)["result"] == ""
    assert got[2, "a"].errors == ["early_result"] and got[2, "b"].errors == ["no_result"] and got[2, "b"].result_turn is None
    assert {x.content for x in orphan_results(c, r).collect()} == {"orphan", "no id"}
    assert link_tool_calls(c.limit(0), r, s).collect() == []
    assert all("unknown_tool" in x.errors for x in link_tool_calls(c, r.limit(0), s.limit(0)).collect())


def test_paths_beyond_the_rounds_are_reported(spark):
    calls = [(1, "c%d" % i, i, "f", "{}", ["c%d" % (i + 1)] if i < 6 else []) for i in range(7)]
    got = link_tool_calls(*frames(spark, calls), ToolCallConfig(rounds=3)).collect()
    assert any("deep" in r.errors for r in got)
    full = sorted((r.turn, r.level) for r in link_tool_calls(*frames(spark, calls)).collect())
    assert full == [(i, 6 - i) for i in range(7)]


def test_json_of_conversations_is_canonical(spark):
    conv = table(spark, "/root/testdata/sf0.01", "conversations")
    rows = link_conversations(conv).collect()
    assert len(rows) == conv.where(F.col("role") == "user").count()
    for r in rows:
        body = json.loads(r.json)
        assert r.json == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert body["errors"] == r.errors and body["level"] == r.level


def levels(calls):
    """(level or None) by id of ``{id: (turn, after)}``, call by call."""
    out, todo = {}, dict(calls)
    while ready := [c for c, (_, after) in todo.items() if all(d in out for d in after if d in calls)]:
        for c in ready:
            t, after = todo.pop(c)
            out[c] = max((out[d] + ((calls[d][0], d) >= (t, c)) for d in after if d in calls), default=0)
    return {**out, **dict.fromkeys(todo)}


def test_levels_are_exact_however_long_the_paths_and_many_the_cycles(spark):
    rng = random.Random(4)
    chain = {"c%03d" % i: (i, ["c%03d" % (i - 1)] if i > 1 else ["c999"] if i else []) for i in range(300)} | {"c999": (999, [])}
    pairs = {f"p{i}": (i, [f"p{i ^ 1}"]) for i in range(240)}  # 120 cycles, each with one late dependency
    shapes = [chain, pairs]
    for forks in (1, 2):
        ids = [f"n{i}" for i in range(12)]
        shapes.append({c: (rng.randrange(9), rng.sample(ids, rng.randrange(forks + 1))) for c in ids})
        order = rng.sample(range(12), 12)  # no cycles, but turns in any order
        shapes.append({ids[i]: (order[i], [ids[j] for j in rng.sample(range(i), min(i, rng.randrange(forks + 1)))]) for i in range(12)})
    calls = [(v, c, t, "t", "{}", after) for v, shape in enumerate(shapes) for c, (t, after) in shape.items()]
    got = {(r.conv_id, r.call_id): r for r in link_tool_calls(*frames(spark, calls)).collect()}
    for v, shape in enumerate(shapes):
        for c, level in levels(shape).items():
            assert got[v, c].level == level and ("cycle" in got[v, c].errors) == (level is None) and "deep" not in got[v, c].errors, (v, c)
    assert got[0, "c299"].level == 1 and got[1, "p0"].level is None


def test_whole_texts_and_every_turn_are_in_the_rows(spark):
    long = 'long "text" \\ é\n' * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 3, "user", long + "x"), (1, 5, "assistant", "no call"), (1, 6, "system", None), (2, None, "user", "no turn"), (2, 2, None, "no role"), (2, 8, "user", long + "xy"), (None, 0, "user", "q")]
    conv = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    got = whole_conversations(conv).collect()
    bodies = {(r.kind, r.conv_id, r.turn if r.kind != "orphan_result" else r.result_turn): json.loads(r.json) for r in got if r.turn is not None or r.kind != "call"}
    assert bodies["call", 1, 0]["arguments"]["query"] == long and bodies["call", 1, 0]["result"] == long
    assert bodies["call", 1, 3]["arguments"]["query"] == long + "x"
    assert bodies["orphan_result", 1, 5]["result"] == "no call" and bodies["turn", 1, 6] == {"role": "system", "text": ""}
    assert bodies["turn", 2, 2]["role"] == "" and bodies["turn", 2, None]["text"] == "no turn" and ("call", None, 0) in bodies
    count = bodies["call", 2, 8]["arguments"]
    assert (count if isinstance(count, str) else count["text"]).strip("{").replace('"', "").replace("\\", "") == (long + "xy").replace('"', "").replace("\\", "")
    assert len(got) == 8 and whole_conversations(conv.limit(0)).collect() == []
