"""Matching intervals, curves, tracks, filters, tags and selection on hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import density as D, embeddings as EM, evaluation as E, filters as X, matching as M, selection as T, sequences as Q, tables as P, tags as G
from gaugeframe.registry import ANNOTATION_REGISTRY, DATA_REGISTRY, UnknownMetricError


def matched_frame(spark, rows):
    return spark.createDataFrame(rows, "pred_id string, match_id string, feature string, confidence double, iou double")


def test_intervals_equal_greedy_matching_at_every_threshold(spark):
    rng = random.Random(7)
    rows = []
    for label in range(120):
        for j in range(rng.randrange(1, 9)):
            rows.append((f"p{label:03d}-{j}", f"l{label:03d}", "c", rng.randrange(5) / 4, rng.randrange(1, 11) / 10))
    got = {r["pred_id"]: (r["iou"], r["match_duplicate_iou"]) for r in M.match_duplicate_iou(matched_frame(spark, rows)).collect()}
    for t in [i / 100 for i in range(1, 101)]:
        for label in {r[1] for r in rows}:
            reach = [r for r in rows if r[1] == label and r[4] >= t]
            winner = max(reach, key=lambda r: (r[3], r[4], r[0]))[0] if reach else None
            tps = [r[0] for r in rows if r[1] == label and got[r[0]][0] >= t and got[r[0]][1] < t]
            assert tps == ([winner] if winner else [])


def test_unmatched_predictions_and_labels(spark):
    m = matched_frame(spark, [("a", None, "c", 0.9, 0.0), ("b", "l1", "c", 0.5, 0.6)])
    labels = spark.createDataFrame([("l1", "c"), ("l2", "c")], "label_id string, feature string")
    ev, fn = M.match_duplicate_iou(m), M.fn_threshold(labels, m)
    assert {r["pred_id"]: r["match_duplicate_iou"] for r in ev.collect()} == {"a": 1.0, "b": -1.0}
    assert {r["label_id"]: r["iou_threshold"] for r in fn.collect()} == {"l1": 0.6, "l2": -1.0}
    at = {r["feature"]: r for r in E.confusion_counts(ev, fn, 0.6).collect()}["c"]
    assert (at["tp"], at["fp"], at["fn"]) == (1, 1, 1)  # IoU exactly at the threshold matches
    reasons = {r["pred_id"]: r["fp_reason"] for r in M.greedy_tp(m, 0.7).collect()}
    assert reasons == {"a": "No overlapping label of class `c`.", "b": "IOU too low."}


def test_zero_threshold_is_not_the_default(spark):
    m = matched_frame(spark, [("a", "l", "c", 0.9, 0.1)])
    assert M.greedy_tp(m, 0.0).collect()[0]["tp"] is True
    assert M.greedy_tp(m, None).collect()[0]["tp"] is False


def test_101_point_precision_against_arrays(spark):
    rng = random.Random(2)
    rows = [(f"p{i:03d}", f"l{i}" if rng.random() < 0.6 else None, "c", rng.randrange(1000) / 1000, 0.9) for i in range(200)]
    rows = [(a, b, c, d, 0.9 if b else 0.0) for a, b, c, d, _ in rows]
    n = 150
    labels = spark.createDataFrame([(f"l{i}", "c", 0) for i in range(n)] + [("x", "empty", 0)], "label_id string, feature string, frame_id int")
    g = M.greedy_tp(matched_frame(spark, rows), 0.5).withColumn("frame_id", F.lit(0))
    got = {r["class_name"]: r for r in E.map_mar_101pt(g, labels).collect()}
    tp = np.array([b is not None for _, b, *_ in sorted(rows, key=lambda r: (-r[3], r[0]))], dtype=float)
    eps = np.finfo(float).eps
    rc, pr = tp.cumsum() / (n + eps), tp.cumsum() / (np.arange(1, 201) + eps)
    env = np.maximum.accumulate(pr[::-1])[::-1]
    at = np.searchsorted(rc, np.linspace(0, 1, 101), side="left")
    want = np.mean([env[i] if i < 200 else 0.0 for i in at])
    assert got["c"]["ap"] == pytest.approx(want, abs=1e-9) and got["c"]["ar"] == pytest.approx(rc[-1])
    assert got["empty"]["ap"] == 0 and got["Mean"]["ap"] == pytest.approx(want / 2, abs=1e-9)


def test_envelope_is_closed_to_recall_one(spark):
    curve = spark.createDataFrame([("c", 0.5, 0.4), ("c", 0.2, 0.3), ("d", 1.0, 0.5), ("e", 0.0, 0.0)], "feature string, recall double, precision double")
    rows = {(r["feature"], round(r["recall"], 2)): r["precision"] for r in E.pr_envelope(curve).collect()}
    assert rows == {("c", 0.5): 0.4, ("c", 0.2): 0.4, ("c", 1.0): 0.0, ("c", 0.51): 0.0, ("d", 1.0): 0.5, ("e", 0.0): 0.0}


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(0.9, -1.0, 1.0), (0.9, -1.0, 2.0)], "iou double, match_duplicate_iou double, m double")
    assert E.metric_correlation(df, ["m"], 0.5).collect()[0]["correlation"] is None


def track_rows(spark, rows):
    return spark.createDataFrame(rows, "seq_id int, frame int, obj_id string, track_id string, feature string, x double, y double, w double, h double")


def test_track_consistency_cases(spark):
    box = (0.1, 0.1, 0.2, 0.2)
    rows = [
        (1, 0, "a0", "a", "c", *box), (1, 3, "a1", "a", "c", *box), (1, 4, "b2", "b", "c", *box), (1, 5, "c3", "c", "d", *box),
        (1, 5, "f3", "f", "d", 0.7, 0.7, 0.1, 0.1), (1, 5, "flat", "g", "d", 0.1, 0.1, 0.0, 0.2), (2, 6, "n", "n", "c", *box),
    ]
    got = {r["obj_id"]: (r["score"], r["description"]) for r in Q.track_consistency(track_rows(spark, rows)).collect()}
    assert "a0" not in got and "n" not in got  # first frames say nothing, sequences do not leak
    assert got["a1"] == (1.0, "") and got["f3"] == (1.0, "")
    assert got["b2"][0] == pytest.approx(0) and got["b2"][1] == "different track ids"
    assert got["c3"][1] == "overlaps with another class" and got["flat"] == (0.0, "Invalid polygon")


def test_missing_and_broken_tracks(spark):
    box = (0.1, 0.1, 0.2, 0.2)
    rows = [
        (1, 0, "a0", "a", "c", *box), (1, 1, "x1", "x", "d", *box), (1, 2, "a2", "a", "c", *box),  # gap in class c
        (2, 0, "b0", "b", "c", *box), (2, 1, "b1", "b", "c", *box), (2, 2, "b2", "b", "c", *box), (2, 3, "z3", "z", "c", *box),
        (2, 4, "far", "q", "c", 0.8, 0.8, 0.1, 0.1),
    ]
    got = {r["obj_id"]: r["score"] for r in Q.missing_or_broken_tracks(track_rows(spark, rows)).collect()}
    assert got == {"a0": 0.0, "b2": 1.0, "z3": 0.5, "far": 1.0}


@pytest.mark.parametrize("decay", [0.5, 0.9])
def test_shape_similarity_over_chunks(spark, decay):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9000, 3)) + 2
    df = spark.createDataFrame([("t", i, [float(x) for x in r]) for i, r in enumerate(v)], "t string, i int, v array<double>")
    got = {r["i"]: r["score"] for r in Q.shape_similarity(df, ["t"], [F.asc("i")], "v", 3, decay).collect()}
    m = v[0]
    for i in range(1, len(v)):
        want = m @ v[i] / np.linalg.norm(m) / np.linalg.norm(v[i])
        assert got[i] == pytest.approx(want, abs=1e-9)
        m = decay * m + (1 - decay) * v[i]
    assert got[0] == 1.0 and len(got) == 9000


def test_density_of_nested_touching_and_repeated_boxes(spark):
    frames = spark.createDataFrame([(1,), (2,), (3,)], "f int")
    rows = [(1, 0.0, 0.0, 0.5, 0.5), (1, 0.1, 0.1, 0.2, 0.2), (1, 0.5, 0.0, 0.25, 0.5), (1, 0.0, 0.0, 0.5, 0.5), (2, 0.1, 0.1, 0.3, 0.3), (2, 0.3, 0.3, 0.3, 0.3)]
    objects = spark.createDataFrame(rows, "f int, x double, y double, w double, h double")
    got = {r["f"]: r["density"] for r in D.frame_object_density(frames, objects, ["f"]).collect()}
    assert got[1] == pytest.approx(37.5) and got[2] == pytest.approx(17.0) and got[3] == 0


def test_unknown_metric_and_filter_shapes(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, m double")
    assert [r["id"] for r in X.filter_metric_range(df, {"m": (0.5, 0.5)}).collect()] == [1]
    with pytest.raises(UnknownMetricError):
        X.filter_metric_range(df, {"nope": (0, 1)})
    with pytest.raises(UnknownMetricError):
        T.search(df, ["id"], "nope", limit=5)
    data = X.Domain("data", df, ("id",), DATA_REGISTRY)
    with pytest.raises(ValueError):
        X.apply_search(data, data, annotation_filters=X.Filters())


def test_search_pages(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, m double")
    page = T.search(df, ["id"], "m", True, 2, limit=3).orderBy("position").collect()
    assert [r["id"] for r in page] == [7, 6, 5] and page[0]["truncated"]
    last = T.search(df, ["id"], "m", False, 7, limit=3).collect()
    assert len(last) == 3 and not last[0]["truncated"]


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_partition_sizes(spark, n):
    parts = T.partition_dataset(spark.range(n), "id", {"a": 33, "b": 33, "c": 34}).groupBy("partition").count().collect()
    sizes = {r["partition"]: r["count"] for r in parts}
    assert sum(sizes.values()) == n and sizes.get("a", 0) == n * 33 // 100 and sizes.get("b", 0) == n * 33 // 100


def test_active_learning_round_takes_the_best_unlabelled(spark):
    pool = spark.createDataFrame([(i, None if i % 10 == 9 else i / 30) for i in range(30)], "id long, s double")
    labeled = spark.createDataFrame([(27,), (28,), (500,)], "id long")
    got = [tuple(r) for r in T.active_learning_round(pool, labeled, "id", F.col("s"), 4).collect()]
    assert [i for i, _ in got] == [26, 25, 24, 23]
    assert [r.id for r in T.active_learning_round(pool, labeled, "id", F.col("s"), 2, ascending=True).collect()] == [0, 1]
    every = T.active_learning_round(pool, labeled, "id", F.col("s"), 99).collect()
    assert len(every) == 28 and {r.id for r in every[-3:]} == {9, 19, 29}


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("img10", "img2", "Img1", "a")], "n string")
    assert [r["n"] for r in T.natural_sort(df, "n").collect()] == ["a", "Img1", "img2", "img10"]


def test_scores_scale_clamp_and_skip(spark):
    rows = [("a_b_00001", "Frame object density", 55.0), ("a_b_00001", "Sharpness", 10000.0), ("a_b_00001", "Blur", 3.0), ("a_b_00001", "Brightness", 1.7)]
    r = P.scores_to_analytics(spark.createDataFrame(rows, "identifier string, metric string, score double"), DATA_REGISTRY).collect()[0]
    assert r["metric_object_density"] == 0.55 and r["metric_sharpness"] == 100 / 2040 and r["metric_brightness"] == 1.0
    assert P.duplicate_assignments(spark.createDataFrame(rows + rows[:1], "identifier string, metric string, score double")).count() == 1
    assert "metric_area" in ANNOTATION_REGISTRY.schema(["du_hash"]).names


def test_normalize_constant_metric(spark):
    df = spark.createDataFrame([("a", "m", 3.0), ("b", "m", 3.0)], "identifier string, metric string, score double")
    assert {r["score"] for r in P.normalize_scores(df).collect()} == {0.0}


def test_identifier_remap_is_invertible(spark):
    ids = spark.createDataFrame([("l1_d1_00000",), ("l2_d2_00003_o1_o2",)], "identifier string")
    m = spark.createDataFrame([("l1", "L"), ("d2", "D")], "old string, new string")
    there = P.remap_identifiers(ids, m)
    assert {r[0] for r in there.collect()} == {"L_d1_00000", "l2_D_00003_o1_o2"}
    assert {r[0] for r in P.remap_identifiers(there, P.invert(m)).collect()} == {r[0] for r in ids.collect()}


def test_tag_diff_and_answers(spark):
    have = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "id int, tag string")
    want = spark.createDataFrame([(1, "b"), (1, "c")], "id int, tag string")
    assert {(r["id"], r["tag"], r["action"]) for r in G.tag_diff(have, want, ["id"]).collect()} == {(1, "c", "add"), (1, "a", "remove")}
    j = spark.createDataFrame([('[{"name":"x"}]',), ('"plain"',), ("{}",), ("[]",)], "j string")
    assert [r[0] for r in j.select(G.radio_answer(F.col("j"))).collect()] == ["x", "plain", None, None]


def test_reduction_from_merged_sketches(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 5)) * [3, 1, 2, 0.5, 0.1] + [5, 0, -3, 1, 1]
    rows = [(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows + [(900, "a", None), (901, "a", [1.0, None, 1.0, 1.0, 1.0])], "id int, part string, v array<double>").repartition(5)
    sketches = EM.covariance_sketches(df, "v", ["part"])
    for wanted in ("a", "b", "ab"):
        own = v[[x[1] in wanted for x in rows]]
        n, mean, scatter = EM.merged_sketch(sketches.where(F.col("part").isin(list(wanted))))
        assert n == len(own) and mean == pytest.approx(own.mean(axis=0)) and scatter / n == pytest.approx(np.cov(own.T, bias=True))
    some = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "id int")
    got = {r.id: (r.x, r.y) for r in EM.subset_reduction(df, some, ["id"], "id", "v").collect()}
    own = v[::3] - v[::3].mean(axis=0)
    values, axes = np.linalg.eigh(own.T @ own)
    for k, axis in ((0, axes[:, -1]), (1, axes[:, -2])):
        have = np.array([got[i][k] for i in range(0, 300, 3)])
        assert np.abs(have) == pytest.approx(np.abs(own @ axis), abs=1e-9)
    with pytest.raises(ValueError):
        EM.subset_reduction(df, some.where("id < 9"), ["id"], "id", "v")
