"""Ranges of JSON files against the whole parse."""

import json
import pickle

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from gaugeframe.sources import coco as CO, json_arrays as J

TEXT = st.lists(st.sampled_from(['"', "\\", "{", "}", "[", "]", ":", ",", "a", "é", " ", "\n", "annotations", '": [{']), max_size=8).map("".join)
VALUE = st.recursive(TEXT | st.sampled_from([1, 2.5, -3e10, None, True]), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.sampled_from(["a", "annotations", "images"]), v, max_size=3), max_leaves=12)
ROWS = st.lists(st.fixed_dictionaries({"id": st.integers(0, 9), "v": VALUE, "w": VALUE}), max_size=5)
DOCUMENT = st.permutations(["info", "images", "annotations", "categories", "x"]).flatmap(
    lambda names: st.fixed_dictionaries({n: ROWS if n in ("images", "annotations", "categories") else VALUE for n in names}))


def in_ranges(data, size, level, wanted):
    ranges = [("f", a, min(a + size, len(data))) for a in range(0, len(data), size)]
    said = {}
    for p, a, b in ranges:
        slashes = len(data[:a]) - len(data[:a].rstrip(b"\\"))
        escaped = bool(slashes % 2)
        said[p, a] = (escaped, *[J.summary(data[a : b + J.AHEAD], b - a, inside, escaped) for inside in (False, True)])
    out = []
    for span, names in J.chained(ranges, said, level):
        found = list(J.elements(lambda start, n: data[start : start + n], span, level, wanted))
        assert not found or level == 1 or wanted in names
        out += found
    return out


@given(DOCUMENT, st.integers(1, 300), st.booleans(), st.sampled_from([None, 1]), st.sampled_from([200, 1 << 16]))
@settings(max_examples=150, deadline=None)
def test_ranges_of_sections_equal_the_whole(document, size, escape, indent, ahead):
    data = json.dumps(document, ensure_ascii=escape, indent=indent).encode()
    before, J.AHEAD = J.AHEAD, ahead
    try:
        for name in ("images", "annotations"):
            assert in_ranges(data, size, 2, name) == document[name]
    finally:
        J.AHEAD = before


@given(ROWS, st.integers(1, 200))
@settings(max_examples=80, deadline=None)
def test_ranges_of_one_array_equal_the_whole(rows, size):
    assert in_ranges(json.dumps(rows).encode(), size, 1, None) == rows


def test_values_that_do_not_fit_are_null(spark):
    schema = T.StructType.fromDDL("a long, b int, c double, d string, e array<double>, f struct<x:double>, g boolean")
    assert J._fit({"a": 3.0, "b": 1 << 40, "c": 2, "d": {"k": [1]}, "e": [1, "x"], "f": 5, "g": 1}, schema) == {
        "a": 3, "b": None, "c": 2.0, "d": '{"k": [1]}', "e": [1.0, None], "f": None, "g": None}


def test_file_of_many_ranges_is_many_tasks(spark, tmp_path):
    notes = [{"id": i, "image_id": i % 7, "category_id": 1, "bbox": [1, 2, 3, 4], "segmentation": [[0, 0, 1, 0, 1, 1]], "area": 1.5, "note": '}],"annotations":[{' * (i % 3)} for i in range(500)]
    doc = {"info": {"x": [{"id": -1}]}, "annotations": notes, "images": [{"id": i, "width": 9, "height": 9, "file_name": f"\\\"[{i}"} for i in range(7)], "categories": []}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    t = CO.read_coco(spark, str(tmp_path), range_bytes=4000)
    assert t["annotations"].rdd.getNumPartitions() > 5
    assert sorted(r.id for r in t["annotations"].collect()) == list(range(500))
    assert {r.file_name for r in t["images"].collect()} == {f"\\\"[{i}" for i in range(7)}
    assert t["categories"].count() == 0
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "r.json").write_text(json.dumps([{"image_id": i, "category_id": 1, "score": 0.5, "bbox": [1, 1, 2, 2]} for i in range(300)]))
    assert sorted(r.image_id for r in CO.read_coco_results(spark, str(tmp_path / "r"), range_bytes=1000).collect()) == list(range(300))


def test_cut_off_file_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"annotations": [{"id": 1}, {"id": ')
    with pytest.raises(Exception, match="ends inside an element"):
        CO.read_coco(spark, str(tmp_path))["annotations"].collect()


def test_tasks_carry_their_own_ranges_only(spark):
    size = 1000
    options = {"level": "2", "section": "a", "spans": json.dumps([{"path": "f", "start": i * size, "end": (i + 1) * size} for i in range(5000)])}
    reader = J.JsonArrayReader(T.StructType.fromDDL("id long"), options)
    parts = reader.partitions()
    assert [s.start for p in parts for s in p.spans] == [i * size for i in range(5000)]
    assert J.TASKS <= len(parts) <= 2 * J.TASKS and len(pickle.dumps(reader)) < 2000
    # beyond, tasks grow in number and not in size
    assert len(J.dealt(list(range(1000)), [J.RANGE_BYTES] * 1000)) == 1000


def test_objects_between_other_values():
    data = '{"a": [{"k": "é]"}, {"k": 2}, null, {"k": 3}, [4], {"k": {"a": [{"k": 5}]}} , {"k": 6}], "b": [{"k": 7}]}'.encode()
    for size in (7, 20, 45, 200):
        assert [e["k"] for e in in_ranges(data, size, 2, "a")] == ["é]", 2, 3, {"a": [{"k": 5}]}, 6]


def test_neighbouring_objects_are_parsed_at_once(monkeypatch):
    data = json.dumps({"a": [{"id": i, "v": ["x", {"y": 'é"['}]} for i in range(200)]}, ensure_ascii=False).encode()
    tokens = []
    monkeypatch.setattr(J, "TOKEN", type("T", (), {"finditer": staticmethod(lambda b, at, t=J.TOKEN: (tokens.append(1) or m for m in t.finditer(b, at)))}))
    found = list(J.elements(lambda start, n: data[start : start + n], J.Span("f", 0, len(data)), 2, "a"))
    assert [e["id"] for e in found] == list(range(200)) and len(tokens) < 20
