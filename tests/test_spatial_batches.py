"""Keys of few shapes are shuffled once and worked on in batches, with the results of the joins that crowded keys take."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import matching, sequences
from gaugeframe.plans import spatial, spatial_batches
from gaugeframe.session import stored

BOX = "id string, k int, x double, y double, w double, h double"
SHAPE = BOX + ", points array<struct<x:double,y:double>>, rle struct<size:array<int>,counts:array<int>>"


def boxes(n, seed):
    rng = random.Random(seed)
    return [(f"{seed}-{i:03d}", rng.choice([0, 1, 2, None]), *(rng.randrange(6) / 10 for _ in "xy"), *(rng.randrange(1, 5) / 10 for _ in "wh")) for i in range(n)]


def odd_boxes(seed):
    rows = boxes(120, seed)
    # copies, ids that repeat, a missing place, no area, nothing at all
    return [*rows, *[(f"copy-{r[0]}", *r[1:]) for r in rows[:20]], *rows[:5], ("nowhere", 0, None, 0.1, 0.3, 0.3), ("nowhere too", 0, None, 0.1, 0.3, 0.3),
            ("flat", 1, 0.1, 0.1, 0.0, 0.3), ("none", 1, None, None, None, None)]


def shapes(n, seed):
    """Boxes, triangles, polygons that cross themselves, masks, and rows without a shape or with a hole in it."""
    rng = random.Random(seed)
    out = []
    for name, k, x, y, w, h in boxes(n, seed):
        kind = rng.randrange(6)
        corners = {1: [(x, y), (x + w, y), (x, y + h)], 2: [(x, y), (x + w, y + h), (x + w, y), (x, y + h / 2)], 3: [(x, y), (x + w, None), (x, y + h)]}.get(kind)
        rows, across, down = int(y * 10), int(w * 10), int(h * 10)
        runs = [rows * 10 + int(x * 10), *[across, 10 - across] * (down - 1), across]
        mask = ([10, 10], runs if rng.random() < 0.8 else [*runs[:1], None, *runs[2:]]) if kind == 4 else None
        out.append((name, k, *((x, y, w, h) if kind in (0, 5) else [None] * 4), [*corners] if corners else None, mask))
    return [*out, ("lost", 0, None, None, None, None, None, None)]


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def shuffles(df):
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


@pytest.mark.parametrize("ids", [False, True])
def test_best_other_of_few_is_that_of_many(spark, monkeypatch, ids):
    monkeypatch.setattr(spatial_batches, "PAIRS", 50)
    rows = odd_boxes(3) + ([(None, 0, 0.1, 0.1, 0.2, 0.2), (None, 0, 0.1, 0.1, 0.2, 0.2), (None, 2, 0.4, 0.1, 0.2, 0.2)] if ids else [])
    df = spark.createDataFrame(rows, BOX)
    columns = ["id", "k", "x", "y", "w", "h", "partner", "iou"]
    few, many = spatial.best_other(df, ["k"], "id"), spatial._best_other_of_many(df, ["k"], "id", 0.25, spatial._crowded(df, df, ["k"]))
    assert told(few, *columns) == told(many, *columns)
    monkeypatch.setattr(spatial, "CROWDED", 10)
    assert told(spatial.best_other(df, ["k"], "id", 0.07), *columns) == told(many, *columns)


def test_endless_boxes_take_the_join(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([*boxes(40, 5), ("n", 1, nan, 0.1, 0.2, 0.2), ("i", 2, 0.1, 0.1, inf, 0.2)], BOX)
    assert {r.k for r in spatial._uneven(df, df, ["k"], F.lit(False)).collect()} == {1, 2}
    many = spatial._best_other_of_many(df, ["k"], "id", 0.25, spatial._crowded(df, df, ["k"]))
    assert told(spatial.best_other(df, ["k"], "id"), "id", "partner", "iou") == told(many, "id", "partner", "iou")


def test_duplicates_are_found_in_two_shuffles(spark):
    df = spark.createDataFrame(odd_boxes(4), BOX).withColumnRenamed("id", "obj_id")
    assert shuffles(matching.annotation_duplicates(df, ["k"])) == 2


@pytest.mark.parametrize("least", [0.0, 0.4])
def test_shapes_of_few_are_matched_as_those_of_many(spark, monkeypatch, least):
    monkeypatch.setattr(spatial_batches, "PAIRS", 50)
    left, right = (spatial.stored_bounds(spark.createDataFrame(shapes(150, s), SHAPE)) for s in (6, 7))
    right = right.withColumn("extra", F.length("id"))
    columns = ["id", "k", "x", F.size("points"), "rle", "best_id", "best_extra", "iou"]
    many = spatial._best_of_many(left, right, ["k"], "id", 0.25, ["extra"], least, spatial._crowded(left, right, ["k"]))
    few = spatial.best_overlap(left, right, ["k"], "id", carry=["extra"], least=least)
    assert shuffles(few) == 1
    got, wanted = told(few, *columns), told(many, *columns)
    assert got == wanted and sum(r[-1] > 0 for r in got) > 50
    monkeypatch.setattr(spatial, "CROWDED", 10)
    assert told(spatial.best_overlap(left, right, ["k"], "id", 0.07, ["extra"], least), *columns) == wanted


@pytest.mark.parametrize("span", [1, 4])
def test_neighbouring_places_travel_once(spark, monkeypatch, span):
    monkeypatch.setattr(spatial, "SPAN", span)
    rng = random.Random(8)
    rows = []
    for r in shapes(150, 8):  # everything but masks, seen in two frames, mostly neighbours
        seq, frame = rng.choice([1, 2, None]), rng.randrange(14)
        rows += [(f"{r[0]}-{n}", seq, frame + n, rng.randrange(4), rng.choice("ab"), *r[2:-1]) for n in range(2) if r[-1] is None]
    df = spark.createDataFrame(rows, "obj_id string, seq_id int, frame int, track_id int, feature string, x double, y double, w double, h double, points array<struct<x:double,y:double>>")
    columns = ["seq_id", "frame", "obj_id", "score", "description"]
    got = told(sequences.track_consistency(df), *columns)
    monkeypatch.setattr(spatial, "CROWDED", 0)
    assert got == told(sequences.track_consistency(df), *columns)
    assert {r[4] for r in got} == {"", "different track ids", "overlaps with another class", "Invalid polygon"}


def test_rows_are_stored_in_fewer_bytes_than_a_checkpoint(spark, tmp_path):
    import os

    def size(at):
        return sum(os.path.getsize(f"{p}/{f}") for p, _, names in os.walk(at) for f in names)

    kept, top = spark.sparkContext.getCheckpointDir(), "file:" + str(tmp_path)
    df = spark.range(20000).select("id", F.array(*[F.struct((F.col("id") % n).alias("x"), F.lit(0.5).alias("y")) for n in (7, 11, 13, 17, 19)]).alias("points"), F.lit(None).alias("none"))
    spark.sparkContext.setCheckpointDir(top)
    try:
        before = size(tmp_path)
        assert told(stored(df.drop("none")), "id", "points") == told(df, "id", "points")
        after = size(tmp_path)
        df.drop("none").checkpoint()
        assert 0 < after - before < (size(tmp_path) - after) / 3
        assert stored(df).columns == df.columns
    finally:
        spark._jsc.sc().setCheckpointDir(kept) if kept else None


def test_whole_keys_cut_batches_where_a_key_begins():
    import pyarrow as pa

    begin = [True, False, True, False, False, False, True, False]
    batches = [pa.record_batch({"_begin": begin[a:b], "n": list(range(a, b))}) for a, b in ((0, 3), (3, 5), (5, 8))]
    assert [t["n"].to_pylist() for t in spatial_batches.whole_keys(iter(batches))] == [[0, 1, 2, 3, 4, 5], [6, 7]]
    key = np.array([1, 1, 2, 4])
    assert [(a.tolist(), b.tolist()) for a, b in spatial_batches.pairs(key, np.array([2, 3]), np.arange(4), 1)] == [([2, 2], [0, 1])]
