import json

from tarmac.llm import tool_calls as tc

CALL = "call_id string, conv_id long, turn long, name string, parent_id string, arguments map<string,string>"
RESULT = "call_id string, turn long, text string"


def test_links_orders_and_validates(spark):
    calls = spark.createDataFrame(
        [
            ("a", 1, 0, "answer", None, {"text": 'say "hi"\n', "turn": "0"}),
            ("b", 1, 2, "answer", "a", {"text": "x", "turn": "two"}),
            ("c", 1, 4, "answer", "b", {"turn": "4"}),
            ("c", 1, 5, "answer", "b", {"text": "later copy", "turn": "5"}),
            ("d", 1, 6, "other", "gone", {}),
            ("e", 1, 8, "answer", "f", {"text": "", "turn": "8", "z": "1"}),
            ("f", 1, 9, "answer", "e", {"text": "y", "turn": "9"}),
            ("g", 1, 10, "answer", "e", None),
            (None, 1, 11, "answer", None, {"text": "y", "turn": "9"}),
        ],
        CALL,
    )
    results = spark.createDataFrame([("a", 1, "fine"), ("a", 3, "again"), ("zz", 4, "orphan"), (None, 5, "x")], RESULT)
    out = {r.call_id: r for r in tc.link(calls, results).collect()}
    assert {k: r.depth for k, r in out.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": None, "zz": None}
    assert {k: r.problems for k, r in out.items()} == {
        "a": "", "b": "type:turn", "c": "missing:text", "d": "unknown tool", "e": "range:text,unexpected:z", "f": "", "g": "missing:text,missing:turn", "zz": "no call",
    }
    assert out["a"].linked and out["a"].n_results == 2 and out["a"].result_turn == 1 and out["c"].n_calls == 2 and out["c"].turn == 4
    assert out["a"].json == json.dumps({"arguments": {"text": 'say "hi"\n', "turn": 0}, "id": "a", "name": "answer", "parent": None, "result": "fine", "turn": 0}, separators=(",", ":"), sort_keys=True)
    for r in out.values():
        json.loads(r.json)


def test_depth_of_a_long_chain(spark):
    calls = spark.createDataFrame([(str(k), 1, k, "answer", str(k - 1), {"text": "x", "turn": str(k)}) for k in range(70)], CALL)
    out = tc.link(calls, spark.createDataFrame([], RESULT)).collect()
    assert {int(r.call_id): r.depth for r in out} == {k: k for k in range(70)}


def test_turns_with_nulls_and_empty(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", None), (None, 0, "user", "x"), (2, None, "assistant", "y"), (3, 0, None, "z"), (3, 0, None, "z")], "conv_id long, turn int, role string, text string")
    out = {r.call_id: r for r in tc.link(*tc.from_turns(turns)).collect()}
    assert set(out) == {"1-0", "1-2", "3-0"} and out["1-0"].linked and out["1-2"].parent_id == "1-0" and out["3-0"].n_calls == 2
    assert tc.link(*tc.from_turns(turns.limit(0))).count() == 0


def test_messages(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"k","name":"answer","arguments":{"text":"t","turn":"0"}}]}'), (1, 1, "tool", '{"tool_call_id":"k","content":"done"}'), (1, 2, "assistant", "plain"), (1, 3, "tool", None)]
    out = tc.link(*tc.from_messages(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()
    assert [(r.call_id, r.linked, r.valid, json.loads(r.json)["result"]) for r in out] == [("k", True, True, "done")]


def test_nested_arguments_are_canonical(spark):
    schemas = {"search": {"filter": ("object", True, None, None), "tags": ("array", False, 1, 3), "deep": ("boolean", False, None, None)}}
    text = '{"tool_calls":[{"id":"%s","name":"search","arguments":{"tags":%s,"filter":%s,"deep":true}}]}'
    rows = [(1, 0, "assistant", text % ("a", '["x", {"q": 2, "b": 1}]', '{"z": {"k": [1, 2.5], "a": null}, "b": "é \\"q\\""}'))]
    rows += [(1, 1, "assistant", text % ("b", "[]", "[1]")), (1, 2, "assistant", text % ("c", '"[x"', "{}"))]
    out = {r.call_id: r for r in tc.link(*tc.from_messages(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), schemas).collect()}
    want = {"tags": ["x", {"q": 2, "b": 1}], "filter": {"z": {"k": [1, 2.5], "a": None}, "b": 'é "q"'}, "deep": True}
    shown = json.dumps(want, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    assert out["a"].valid and out["a"].json.startswith('{"arguments":' + shown)
    assert {k: out[k].problems for k in "bc"} == {"b": "type:filter,range:tags", "c": "type:tags"}


def test_long_texts_and_clashing_columns(spark):
    calls = spark.createDataFrame([("a", 1, 0, "answer", None, {"text": "x" * 500_000, "turn": "0"}, "mine", 3, "r")], CALL + ", up string, depth int, n_results string")
    results = spark.createDataFrame([("a", 1, "y" * 500_000, "mine")], RESULT + ", problems string")
    (r,) = tc.link(calls, results).collect()
    assert r.depth == 0 and r.problems == "range:text" and json.loads(r.json)["result"] == "y" * 500_000
