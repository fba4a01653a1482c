from __future__ import annotations

import json
import random

import pytest

from tessera.llm import chat

EVENTS = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string"
TOOLS = {"add": ({"a": "number", "b": "integer", "note": "string"}, ["a", "b"]), "noop": ({}, [])}


def formatted(spark, rows, tools=TOOLS):
    df = spark.createDataFrame(rows, EVENTS).selectExpr("*", "'own' as json", "'own' as level", "'own' as _first")
    return chat.format_chat(df, tools).collect()


def call(turn, call_id, arguments, name="add", conv=1):
    return (conv, turn, "assistant", None, call_id, name, arguments)


def result(turn, call_id, content="done", conv=1):
    return (conv, turn, "tool", content, call_id, None, None)


def one(rows, turn, kind):
    found = [r for r in rows if r.turn == turn and r.kind == kind]
    assert len(found) == 1
    return found[0]


def test_linking_and_problems(spark):
    rows = formatted(spark, [
        (1, 0, "user", "add é\n\"2\"", None, None, None),
        call(1, "x", '{"b": 2, "a": 1.5}'), result(2, "x"),
        call(3, "bad", '{"a": "1", "b": 2}'), result(4, "bad"),
        call(5, "json", "{a}"), result(6, "json"),
        call(7, "who", "{}", "unknown"), call(8, "left", '{"a":1,"b":2}'),
        result(9, "nobody"), call(10, "x", '{"a":1,"b":1}'),
        call(1, "x", '{"a":1,"b":1}', conv=2), result(3, None),
    ])
    assert one(rows, 2, "result").linked_turn == 1
    problems = {(r.conv_id, r.turn, r.kind): r.problem for r in rows if r.problem}
    assert problems == {(1, 3, "call"): "bad arguments", (1, 5, "call"): "bad json", (1, 7, "call"): "unknown tool",
                        (1, 8, "call"): "open", (1, 9, "result"): "orphan", (1, 10, "call"): "duplicate",
                        (2, 1, "call"): "open", (1, 3, "result"): "orphan"}


def test_canonical_json(spark):
    rows = formatted(spark, [(1, 0, "user", "add é\n\"2\"\t", None, None, None),
                             call(1, "x", '{"b":  2, "a": {"z": [1, "é"], "k": null}, "B": true}'), result(2, "x", None)])
    assert one(rows, 0, "message").json == '{"content":"add é\\n\\"2\\"\\t","role":"user"}'
    assert one(rows, 1, "call").json == ('{"role":"assistant","tool_calls":[{"arguments":{"B":true,"a":{"k":null,"z":[1,"é"]},"b":2},'
                                         '"id":"x","name":"add"}]}')
    assert one(rows, 2, "result").json == '{"content":null,"role":"tool","tool_call_id":"x"}'
    assert all(json.loads(r.json) for r in rows)


def in_order(rows):
    return [(r.kind, r.call_id) for r in sorted(rows, key=lambda r: (r.position, r.level, r.turn, r.kind))]


def test_order_follows_use(spark):
    # c uses b's result, b uses a's; the log has them the wrong way round
    rows = formatted(spark, [call(1, "c", '{"a":"$b"}', "noop"), result(2, "c"), call(3, "b", '{"q":["$a"]}', "noop"),
                             result(4, "a"), call(5, "a", "{}", "noop"), result(6, "b")])
    order = in_order(rows)
    for first, then in [(("call", "a"), ("result", "a")), (("result", "a"), ("call", "b")), (("call", "b"), ("result", "b")),
                        (("result", "b"), ("call", "c")), (("call", "c"), ("result", "c"))]:
        assert order.index(first) < order.index(then)
    assert not any(r.problem for r in rows)


def test_cycles_are_marked(spark):
    rows = formatted(spark, [call(1, "a", '{"x":"$b"}', "noop"), call(2, "b", '{"x":"$a"}', "noop"),
                             call(3, "c", '{"x":"$b"}', "noop"), call(4, "d", '{"x":"$gone"}', "noop"), result(5, "d"),
                             call(6, "e", '{"x":"$e"}', "noop")])
    assert {r.call_id: r.problem for r in rows if r.kind == "call"} == {
        "a": "cycle", "b": "cycle", "c": "cycle", "d": None, "e": "cycle"}


def test_nulls_repeats_and_empty(spark):
    rows = formatted(spark, [(None,) * 7, call(None, "x", None), result(None, "x"), call(1, "y", "{}", "noop"),
                             call(1, "y", "{}", "noop"), result(2, "y"), (None, 1, "assistant", None, "z", "noop", "{}")])
    assert len(rows) == 7
    assert [r.problem for r in rows if r.call_id == "y"] == [None] * 3
    assert next(r for r in rows if r.call_id == "x" and r.kind == "call").problem == "bad json"
    assert next(r for r in rows if r.kind == "message").json == '{"content":null,"role":null}'
    assert formatted(spark, []) == []


def test_one_conversation_of_most_rows(spark):
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(chat.conversation_events(df), chat.REPLY_TOOL).collect()
    assert len(out) == 2000 and not any(r.problem for r in out)
    assert all(r.linked_turn == r.turn - 1 for r in out if r.kind == "result")


def levels_of(uses):
    """Independent statement: level of each call by the calls it uses; None in a cycle or behind one."""
    level = {}
    while True:
        ready = {c for c, used in uses.items() if c not in level and all(u in level for u in used if u in uses)}
        if not ready:
            return {c: level.get(c) for c in uses}
        level.update({c: max((level[u] + 2 for u in uses[c] if u in uses), default=0) for c in ready})


def checked_levels(spark, convs):
    """Formats conversations of {call: used calls}, checks levels, order and marks; returns the number of rounds."""
    rows = []
    for conv, uses in convs.items():
        for i, (c, used) in enumerate(uses.items()):
            rows.append(call(2 * i, c, json.dumps({f"k{j}": f"${u}" for j, u in enumerate(used)}), "noop", conv))
            rows.append(result(2 * i + 1, c, conv=conv))
    out = formatted(spark, rows)
    assert len(out) == len(rows)
    for conv, uses in convs.items():
        want = levels_of(uses)
        own = [r for r in out if r.conv_id == conv]
        assert {r.call_id: r.level for r in own if r.kind == "call"} == {c: v or 0 for c, v in want.items()}
        assert {r.call_id for r in own if r.problem == "cycle"} == {c for c, v in want.items() if v is None}
        at = {p: i for i, p in enumerate(in_order(own))}
        assert all(at["result", u] < at["call", c] for c, used in uses.items() if want[c] is not None
                   for u in used if u in uses)


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_uses(spark, seed):
    rng = random.Random(seed)
    convs = {}
    for conv in range(40):
        n = rng.randint(1, 14)
        names = [f"c{i}" for i in range(n)]
        rng.shuffle(names)
        back = rng.random() < 0.3  # may have cycles
        convs[conv] = {c: rng.sample([*(names if back else names[:i]), "gone"], rng.randint(0, min(3, i)))
                       for i, c in enumerate(names)}
        if rng.random() < 0.5:
            convs[conv] = dict(sorted(convs[conv].items(), key=lambda _: rng.random()))
    checked_levels(spark, convs)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    plain = chat._replaced
    monkeypatch.setattr(chat, "_replaced", lambda *a: rounds.append(1) or plain(*a))
    n = 1000
    chain = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(n)}
    ring = {f"r{i}": [f"r{(i + 1) % 7}"] for i in range(7)} | {"behind": ["r3"]}
    tree = {f"t{i}": [f"t{j}" for j in (2 * i + 1, 2 * i + 2) if j < 600] for i in range(600)}
    checked_levels(spark, {1: dict(reversed(chain.items())), 2: ring, 3: tree})
    assert len(rounds) // 2 <= 12
