import json

from parchment.llm.chat import DEPTH, argument_errors, format_tool_calls

SCHEMA = "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, content string, after array<string>"
TOOLS = "name string, required array<string>, types map<string,string>"


def call(conv, turn, i, args="{}", after=(), name="f"):
    return (conv, turn, "call", "assistant", i, name, args, None, list(after))


def result(conv, turn, i, content="r"):
    return (conv, turn, "result", "tool", i, None, None, content, [])


def text(conv, turn, content):
    return (conv, turn, "text", "user", None, None, None, content, None)


def tools(spark):
    return spark.createDataFrame([("f", ["x"], {"x": "integer", "y": "number", "z": "string"})], TOOLS)


def run(spark, rows):
    out = format_tool_calls(spark.createDataFrame(rows, SCHEMA), tools(spark)).collect()
    return sorted(out, key=lambda r: (r.conv_id is None, r.conv_id, r.position))


def test_links_orders_and_serialises(spark):
    rows = [text(1, 0, 'say "é"\n'), call(1, 3, "a", '{"y":1.50,"x":1}'), result(1, 1, "a"), call(1, 2, "b", after=["a"]), result(1, 9, "zz"), call(1, 9, "c"), call(1, 10, "c"), result(2, 0, "a")]
    out = run(spark, rows)
    first = [r for r in out if r.conv_id == 1]
    assert [r.position for r in first] == list(range(7))
    order = [(r.kind, r.call_id) for r in first]
    assert order.index(("call", "a")) < order.index(("result", "a")) < order.index(("call", "b"))
    status = {(r.conv_id, r.kind, r.call_id, r.position): r.status for r in out}
    assert sorted(s for (c, *_), s in status.items() if c == 1) == ["linked", "linked", "orphan", "repeated", "text", "unanswered", "unanswered"]
    assert [r.status for r in out if r.conv_id == 2] == ["orphan"]
    for r in out:
        value = json.loads(r.json)
        assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert value["kind"] == r.kind and value["position"] == r.position
    assert json.loads(first[order.index(("call", "a"))].json)["arguments"] == {"x": 1, "y": 1.5}


def test_argument_errors(spark):
    given = ['{"x":1,"y":2,"z":"s"}', '{"y":"2"}', '{"x":null,"w":1}', "[1]", None, "{", '{"x":1,"x":2}', '{"x":1.5}']
    rows = [(k, "f", a) for k, a in enumerate(given)] + [(99, "g", "{}")]
    out = {r.k: r.errors for r in argument_errors(spark.createDataFrame(rows, "k int, name string, arguments string"), tools(spark)).collect()}
    assert out[0] == [] and out[1] == ["missing: x", "type: y"] and out[2] == ["type: x", "unknown: w"]
    assert out[3] == out[4] == out[5] == out[6] == ["no object"] and out[7] == ["type: x"] and out[99] == ["unknown tool"]


def test_cycle_nulls_repeats_and_empty(spark):
    rows = [call(1, 0, "a", '{"x":1}', ["b"]), result(1, 1, "a"), call(1, 2, "b", '{"x":1}', ["a"]), result(1, 3, "b"), text(None, None, None), text(None, None, None), call(3, None, None), (4, 1, None, None, None, None, None, None, None)]
    assert DEPTH >= 10
    out = run(spark, rows)
    assert len(out) == len(rows)
    assert any("cycle" in r.errors for r in out if r.conv_id == 1)
    assert [r.position for r in out if r.conv_id is None] == [0, 1]
    assert [r.status for r in out if r.conv_id == 3] == ["text"]
    assert run(spark, []) == []


def test_long_chains_whole_cycles_and_null_conversations(spark):
    n = 130  # each call needs the one written after it
    rows = [call(1, n - k, f"c{k}", '{"x":1}', [f"c{k - 1}"] if k else []) for k in range(n)] + [result(1, n - k, f"c{k}") for k in range(n)]
    rows += [call(2, 0, "a", '{"x":1}', ["b"]), result(2, 1, "a"), call(2, 2, "b", '{"x":1}', ["a"]), result(2, 3, "b"), text(2, 4, "t"), call(2, 0, "d", '{"x":1}', ["b"]), result(2, 0, "d")]
    rows += [result(None, 1, "a"), call(None, 2, "a", '{"x":1}'), call(None, 0, "b", '{"x":1}', ["a"])]
    out = run(spark, rows)
    first = [(r.kind, r.call_id) for r in out if r.conv_id == 1]
    assert first == [(kind, f"c{k}") for k in range(n) for kind in ("call", "result")]
    assert not any(r.errors for r in out if r.conv_id in (1, None))
    second = [(r.kind, r.call_id, r.errors) for r in out if r.conv_id == 2]
    assert [x[:2] for x in second[:4]] == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    assert all(("cycle" in e) == (i in ("a", "b")) for _, i, e in second)
    assert [x[:2] for x in second if x[1] == "d"] == [("call", "d"), ("result", "d")]
    assert [(r.kind, r.call_id) for r in out if r.conv_id is None] == [("call", "a"), ("result", "a"), ("call", "b")]


def test_query_keeps_every_turn(spark, sf):
    from parchment.llm.queries import QUERIES

    out = QUERIES["op8_tool_calls"](spark, sf).collect()
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert len(out) == len(turns)
    got = {(r.conv_id, r.position): json.loads(r.json) for r in out}
    for t in turns:
        m = got[t.conv_id, t.turn - min(x.turn for x in turns if x.conv_id == t.conv_id)]
        assert t.text in (m.get("content"), m.get("arguments", {}).get("text"))
