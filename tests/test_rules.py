"""Rules that hold at every size and for missing values: NULL keys, NaN, long numbers, one read per filter chain."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import boxes as B, polygons as PG, scalar as S
from gaugeframe.operators import density as D, evaluation as E, filters as X, matching as M, sequences as Q, summary as A
from gaugeframe.plans.quantiles import linear_quantiles, order_statistics
from gaugeframe.plans.scan import running
from gaugeframe.plans.spatial import best_other, with_bounds


def test_running_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [("a", i) for i in range(3)], "k string, v int")
    got = running(df, ["k"], [F.asc("v")], {"n": F.lit(1).cast("long")})
    assert sorted((r.k or "", r.n) for r in got.collect()) == [("", 1), ("", 2), ("", 3), ("", 4), ("", 5), ("a", 1), ("a", 2), ("a", 3)]


def test_curves_keep_the_null_class(spark):
    rows = [(None, "p1", 0.9, 0.8, -1.0, "f"), (None, "p2", 0.7, 0.1, 1.0, "f"), ("car", "p3", 0.6, 0.9, -1.0, "f")]
    evaluated = spark.createDataFrame(rows, "feature string, pred_id string, confidence double, iou double, match_duplicate_iou double, frame_id string")
    fns = spark.createDataFrame([(None, "f", -1.0), ("car", "f", 0.9)], "feature string, frame_id string, iou_threshold double")
    counts = E.confusion_counts(evaluated, fns, 0.5)
    curve = E.pr_curve(evaluated, counts, 0.5)
    assert {r.feature for r in curve.collect()} == {None, "car"}
    assert {r.feature: r.average_precision for r in E.average_precision_11pt(curve).collect()}[None] > 0
    summary = E.prediction_summary(evaluated, fns, 0.5).first()
    assert summary.mAP > 0.5  # the NULL class adds to the mean


def test_null_track_is_a_track(spark):
    df = spark.createDataFrame([(None, i, [1.0, float(i)]) for i in range(4)], "t string, i int, v array<double>")
    assert Q.shape_similarity(df, ["t"], [F.asc("i")], "v", 2).count() == 4


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)] + [(99, float("nan"))], "id int, m double")
    assert A.unique_outlier_items(df, ["m"], ["id"]).first().asDict() == A.unique_outlier_items(df.where("id < 99"), ["m"], ["id"]).first().asDict()
    row = A.metric_catalog(df, ["m"]).first()
    assert (row["count"], row["max"]) == (50, 6.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 10, 101, 5000])
def test_quantiles_have_one_branch(spark, n):
    values = [float((i * 7919) % n) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    row, s = order_statistics(df, ["m"]).first(), sorted(values)
    assert (row.q1, row.median, row.q3) == (s[n // 4], s[n // 2], s[3 * n // 4])
    lin = linear_quantiles(df, ["m"], {"a": 0.1, "b": 0.75}).first()
    for got, p in ((lin.a, 0.1), (lin.b, 0.75)):
        at = (n - 1) * p
        lo, hi = s[int(at)], s[min(int(at) + (at > int(at)), n - 1)]
        assert got == pytest.approx(lo + (hi - lo) * (at - int(at)))


def test_iou_of_equal_boxes_is_one(spark):
    df = spark.createDataFrame([(0.1 * i, 0.37 * i, 0.1 + 0.013 * i, 0.7 / (i + 1)) for i in range(200)], "x double, y double, w double, h double")
    box = tuple(F.col(c) for c in "xywh")
    assert df.select(F.max(B.box_iou(box, box)).alias("m")).first().m <= 1.0


def test_long_numbers_sort(spark):
    names = ["a" + "9" * 30, "a1" + "0" * 30, "a" + "9" * 29 + "8", "a007", "a8"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", S.natural_key(F.col("n")))
    assert [r.n for r in df.orderBy("k").collect()] == ["a007", "a8", "a" + "9" * 29 + "8", "a" + "9" * 30, "a1" + "0" * 30]


def test_filter_chain_reads_each_table_once(spark, tmp_path):
    schema = "frame_id int, obj_id string, object_class string, label_score double"
    path = str(tmp_path / "rows")
    spark.createDataFrame([(1, None, None, None), (1, "a", "R", 3.0), (2, None, None, None), (2, "b", "S", 9.0), (None, None, None, None), (None, "c", "R", 3.0)], schema).write.parquet(path)
    spark.createDataFrame([(1, "x")], "frame_id int, tag string").write.parquet(path + "f")
    spark.createDataFrame([("b", "y")], "obj_id string, tag string").write.parquet(path + "l")
    read = spark.read.parquet
    out = X.apply_filters(read(path), [
        lambda d: X.filter_range_keep_na(d, "label_score", 1.0, 5.0, ["frame_id"]),
        lambda d: X.filter_categorical_keep_na(d, "object_class", ["R"], ["frame_id"]),
        lambda d: X.filter_object_class(d, ["R", X.NO_CLASS], ["frame_id"]),
        lambda d: X.filter_tags_grouped(d, read(path + "f"), read(path + "l"), ["x", X.UNTAGGED_FRAMES], [X.UNTAGGED_ANNOTATIONS], "frame_id", "obj_id"),
        lambda d: d.where("frame_id is null or frame_id < 9"),
    ])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3
    assert sorted((r.frame_id or 0, r.obj_id or "") for r in out.collect()) == [(0, "c"), (1, "a")]


def _star(rng, n):
    turns = sorted(rng.random() for _ in range(n))
    size = [0.2 + rng.random() for _ in range(n)]
    cx, cy = rng.random(), rng.random()
    return [(cx + r * math.cos(2 * math.pi * t), cy + r * math.sin(2 * math.pi * t)) for t, r in zip(turns, size)]


def test_concave_overlap_agrees_with_the_union():
    rng = random.Random(5)
    checked = 0
    while checked < 60:
        p, q = _star(rng, 7), _star(rng, 9)
        if PG.is_simple(p) and PG.is_simple(q):
            inter = abs(PG._area(p)) + abs(PG._area(q)) - PG.union_area([p, q])
            assert PG.overlap(p, q) == pytest.approx(inter / PG.union_area([p, q]), abs=1e-9)
            assert PG.covered([p, q], -2, -2, 3, 3, edges=4) == pytest.approx(PG.union_area([p, q]), abs=1e-9)
            checked += 1


def test_objects_without_box_or_class_stay(spark):
    square = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5))]
    tri = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5))]
    rows = [("f", None, "a", None, square), ("f", None, "b", 0.0, None), ("f", "c", "c", None, tri), ("f", "c", "d", None, tri), ("f", "c", "e", None, None)]
    rows = [(f, c, i, x, x, None if x is None else 0.5, None if x is None else 0.5, p) for f, c, i, x, p in rows]
    df = spark.createDataFrame(rows, "frame_id string, feature string, obj_id string, x double, y double, w double, h double, points array<struct<x:double,y:double>>")
    got = {r.obj_id: (r.partner, r.score) for r in M.annotation_duplicates(df).collect()}
    assert got == {"a": ("b", 1.0), "c": ("d", 1.0), "e": (None, 0.0)}
    placed = df.select(F.lit("s").alias("seq_id"), F.lit(1).alias("frame"), "obj_id", F.lit(1).alias("track_id"), "feature", *"xywh", "points")
    placed = placed.unionByName(placed.withColumns({"frame": F.lit(2), "obj_id": F.concat("obj_id", F.lit("2"))}))
    scored = {r.obj_id: r.score for r in Q.track_consistency(placed).collect()}
    assert scored == {"a2": 1.0, "b2": 1.0, "c2": 1.0, "d2": 1.0, "e": 0.0, "e2": 0.0}
    assert D.frame_object_density(df.select("frame_id").distinct(), df, ["frame_id"]).first().density == pytest.approx(25.0)


def test_overlaps_of_exactly_a_half_and_a_quarter(spark):
    """Ties and limits do not hang on the shape's kind or on the order of clipping."""
    def shape(i, frame, track, pts=None, box=None):
        return (0, frame, i, track, "c", *(box or (None,) * 4), None if pts is None else [{"x": x, "y": y} for x, y in pts])

    box = (0.1, 0.1, 0.3, 0.3)
    ell = [(0.1, 0.1), (0.4, 0.1), (0.4, 0.25), (0.25, 0.25), (0.25, 0.4), (0.1, 0.4)]  # three quarters of the box
    half = (0.1, 0.1, 0.3, 0.15)
    quarter = (0.1, 0.1, 0.15, 0.15)
    schema = "seq_id int, frame int, obj_id string, track_id int, feature string, x double, y double, w double, h double, points array<struct<x:double,y:double>>"
    rows = [shape("old", 0, 1, box=box), shape("mid", 1, 1, box=half), shape("ell", 1, 2, pts=ell), shape("now", 2, 1, box=box)]
    got = {r.obj_id: r.score for r in Q.missing_or_broken_tracks(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"now": 0.5}  # the L bridges with 0.75, on another track
    exact = [shape("old", 0, 1, box=box), shape("mid", 1, 1, box=half), shape("now", 2, 1, box=box)]
    assert {r.obj_id: r.score for r in Q.missing_or_broken_tracks(spark.createDataFrame(exact, schema)).collect()} == {"old": 0.0}  # exactly a half bridges nothing
    edge = [shape("old", 0, 1, box=quarter), shape("mid", 1, 1, box=box), shape("now", 2, 1, box=box)]
    assert {r.obj_id: r.score for r in Q.missing_or_broken_tracks(spark.createDataFrame(edge, schema)).collect()} == {"now": 1.0}  # exactly a quarter is similar
    thirds = [(0.1, 0.1), (0.4, 0.1), (0.4, 0.2), (0.1, 0.2)]
    pairs = spark.createDataFrame([shape("a", 0, 1, box=half), shape("b", 0, 2, pts=thirds), shape("c", 0, 3, pts=ell)], schema)
    for r in best_other(with_bounds(pairs), ["seq_id", "frame"], "obj_id").collect():
        assert r.iou == round(r.iou, 9)


def test_tracks_of_polygons_judge_every_shape_once(spark):
    """Computed points are stored with their verdict; no filter or join holds their terms again."""
    def ring(*corners):
        return F.array(*[F.struct(F.lit(x).alias("x"), (F.lit(y) + F.col("dy")).alias("y")) for x, y in corners])

    ell = ring((0.0, 0.0), (0.4, 0.0), (0.4, 0.2), (0.2, 0.2), (0.2, 0.4), (0.0, 0.4))
    crossed = ring((0.0, 0.0), (0.4, 0.4), (0.4, 0.0), (0.0, 0.4))
    rows = spark.createDataFrame([(0, 0, "a", 1, 0.0, True), (0, 1, "b", 1, 0.01, True), (0, 2, "c", 2, 0.01, True), (0, 2, "d", 1, 0.0, False)], "seq_id int, frame int, obj_id string, track_id int, dy double, plain boolean")
    objects = rows.select("seq_id", "frame", "obj_id", "track_id", F.lit("c").alias("feature"), *[F.lit(None).cast("double").alias(c) for c in "xywh"],
                          F.when(F.col("plain"), ell).otherwise(crossed).alias("points"))
    tracks, missing = Q.track_consistency(objects), Q.missing_or_broken_tracks(objects)
    for out in (tracks, missing):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "_simple" not in plan and "dy" not in plan
    assert {r.obj_id: r.score for r in tracks.collect()} == {"b": 1.0, "c": 0.0, "d": 0.0}
    assert {r.obj_id: r.score for r in missing.collect()} == {"c": 0.5, "d": 0.0}


def test_density_of_crowded_and_other_frames(spark, monkeypatch):
    """The sweep over whole frames and the one over cells agree, on boxes and on mixed shapes, for NULL keys and over batch borders."""
    rng = random.Random(3)
    rows = []
    for i in range(160):
        x, y, w, h = (rng.randrange(0, 8) / 8 for _ in range(4))
        frame = (None if i % 5 == 4 else f"f{i % 5}", i % 2)
        ring = [{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x + w / 3, y + h / 2))]
        rows.append((*frame, *((x, y, w, h, None) if i % 3 else (None, None, None, None, ring))))
    shapes = spark.createDataFrame(rows, "g string, k int, x double, y double, w double, h double, points array<struct<x:double,y:double>>")
    for objects in (shapes, shapes.drop("points")):
        frames = objects.select("g", "k").distinct()
        seen = []
        for crowded in (1024, 16, 0):
            monkeypatch.setattr(D, "CROWDED", crowded)
            seen.append({(r.g, r.k): r.density for r in D.frame_object_density(frames, objects, ["g", "k"]).collect()})
        assert len(seen[0]) == 10 and min(seen[0].values()) > 0
        assert seen[1] == pytest.approx(seen[0]) and seen[2] == pytest.approx(seen[0])
