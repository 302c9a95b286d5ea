"""Shredding of nested stacks."""

import json

import pytest

from stackweave.operators.dewey import _parse_deep, decode, frame_table, shred, stack_table

S = {"exception": "a.BException", "message": "m", "frames": [{"depth": 0, "function": "f"}, None, {"depth": 1}], "nested": []}


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, js string, path string")
    return {(r.row_id, r.path, r.parent_path, r.n_frames) for r in shred(df, "id", "js", frames=False, attributes=False).collect()}


def test_shapes(spark):
    inner = {"frames": [{"function": "g"}], "nested": [None, {"frames": None}]}
    texts = [
        json.dumps(S),
        json.dumps([S, None, {"frames": []}, 5]),
        json.dumps(json.dumps(json.dumps([S]))),
        json.dumps({"frames": [], "nested": json.dumps(inner)}),
        json.dumps({"nested": [inner]}),
        json.dumps(S)[:-5], "", "  ", "<none>", "null", "5", '"plain"', "{\"frames\": NaN}", None,
        json.dumps({"frames": {"function": "only"}, "nested": "{broken"}),
    ]
    assert found(spark, texts) == {
        (0, "0", None, 2), (1, "0", None, 2), (1, "2", None, 0), (2, "0", None, 2), (3, "0", None, 0), (3, "0.0", "0", 1), (3, "0.0.1", "0.0", 0),
        (4, "0", None, 0), (4, "0.0", "0", 1), (4, "0.0.1", "0.0", 0), (14, "0", None, 1),
    }


def test_depth_without_recursion(spark):
    deep = '{"frames":[{}]}'
    for _ in range(20_000):
        deep = '{"nested":[' + deep + "]}"
    got = found(spark, [deep])
    assert len(got) == 20_001
    assert max(p.count(".") for _, p, _, _ in got) == 20_000


@pytest.mark.parametrize("text", ['{"a":[1,2.5e3,-0,"x\\n\\u00e9",true,false,null,{}],"b":{"c":[]}}', "[]", "[[],[{}]]", ' {"a" : "b"} ', "12", '"s"'])
def test_own_parser_agrees(text):
    assert _parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "", "nul", "01", '["\n"]', "{} {}", '{"a":1]'])
def test_own_parser_rejects(text):
    with pytest.raises((ValueError, IndexError)):
        _parse_deep(text)
    assert decode(text) is None


def test_tables(spark):
    df = spark.createDataFrame([(7, json.dumps([S | {"nested": [{"exception": "N", "frames": [{"function": "h", "fileline": 3}]}]}]))] * 2, "id long, js string")
    nodes = shred(df, "id", "js")
    assert {(r.stack_path, r.parent_stack, r.exception) for r in stack_table(nodes).collect()} == {("0", None, "a.BException"), ("0.0", "0", "N")}
    assert {(r.stack_path, r.position, r.function, r.fileline) for r in frame_table(nodes).collect()} == {("0", 0, "f", None), ("0", 2, None, None), ("0.0", 0, "h", "3")}


def test_empty(spark):
    assert shred(spark.createDataFrame([], "id long, js string"), "id", "js").count() == 0
