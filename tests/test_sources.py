"""File readers, exports, masks, polygons, pixels and streams."""

import gzip
import json
import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeframe.functions import masks as K, planar, polygon_batches, polygons as PG
from gaugeframe.functions.images import image_metrics
from gaugeframe.operators import matching as M
from gaugeframe.operators.extensions import apply_label_transformer
from gaugeframe.sources import coco as CO, export as EX, kitti as KI, label_rows as LR, masks as MK, tables as ST
from gaugeframe.streaming import jobs as SJ


def test_label_rows_of_every_kind(spark, tmp_path):
    box = {"objectHash": "o1", "featureHash": "f", "name": "n", "shape": "bounding_box", "boundingBox": {"x": 0.1, "y": 0.2, "w": 0.3, "h": 0.4}}
    poly = {"objectHash": "o2", "featureHash": "g", "name": "p", "shape": "polygon", "polygon": {str(i): {"x": i / 20, "y": 0.0} for i in range(12)}}
    docs = [
        {"project_hash": "p", "label_hash": "l1", "data_type": "image", "data_units": {"d1": {"data_hash": "d1", "data_sequence": "0", "width": 10, "height": 5, "labels": {"objects": [box], "classifications": []}}}},
        {"project_hash": "p", "label_hash": "l2", "data_type": "img_group", "data_units": {k: {"data_hash": k, "data_sequence": i, "labels": {"objects": [poly]}} for i, k in enumerate("ab")}},
        {"project_hash": "p", "label_hash": "l3", "data_type": "video", "data_units": {"v": {"data_hash": "v", "data_fps": 25, "labels": {"0": {"objects": [box, poly]}, "7": {"classifications": [{"classificationHash": "c"}]}}}}},
        {"project_hash": "p", "label_hash": "l4", "data_type": "dicom", "data_units": {}},
    ]
    (tmp_path / "rows.json").write_text("\n".join(json.dumps(x) for x in docs))
    frames = LR.scan_frames(LR.read_label_rows(spark, str(tmp_path)))
    assert {(r["label_hash"], r["du_hash"], r["frame"]) for r in frames.collect()} == {("l1", "d1", 0), ("l2", "a", 0), ("l2", "b", 1), ("l3", "v", 0), ("l3", "v", 7)}
    objects = LR.scan_objects(frames).collect()
    assert len(objects) == 5
    points = next(r["points"] for r in objects if r["object_hash"] == "o2")
    assert [p["x"] for p in points] == [i / 20 for i in range(12)]  # by index, not by text
    assert LR.scan_classifications(frames).count() == 1


def test_coco_file(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "width": 100, "height": 50, "file_name": "a.jpg"}], "categories": [{"id": 3, "name": "cat", "supercategory": "x"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 3, "bbox": [90, 10, 20, 10], "segmentation": [], "area": 1, "iscrowd": 0},
            {"id": 2, "image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1], "segmentation": [[0, 0, 50, 0, 50, 25], [1, 1, 2, 1, 2, 2]], "area": 1, "iscrowd": 0},
            {"id": 3, "image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1], "segmentation": {"size": [1, 1], "counts": [1]}, "area": 1, "iscrowd": 1},
            {"id": 4, "image_id": 1, "category_id": 3, "bbox": [120, 0, 5, 5], "area": 1, "iscrowd": 0},
            {"id": 5, "image_id": 1, "category_id": 4, "bbox": [-10, 0, 30, 5], "area": 1, "iscrowd": 0, "attributes": {"rotation": 30}},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    t = CO.read_coco(spark, str(tmp_path))
    rows = CO.scan_coco_annotations(t["annotations"], t["images"]).collect()
    assert sorted((r["id"], r["shape"]) for r in rows) == [(1, "bounding_box"), (2, "polygon"), (2, "polygon"), (5, "bounding_box")]
    one = {r["id"]: r for r in rows}
    assert one[1]["w"] == pytest.approx(0.1) and (one[5]["x"], one[5]["w"]) == (0.0, pytest.approx(0.2))
    shapes = {r["category_id"]: r for r in CO.coco_category_shapes(t["annotations"]).collect()}
    assert shapes[3]["polygon"] and shapes[3]["bounding_box"] and shapes[4]["rotatable_bounding_box"] and not shapes[4]["bounding_box"]


def packed(runs):
    """Run lengths as COCO text, by the format's definition."""
    out = ""
    for i, run in enumerate(runs):
        value = run - runs[i - 2] if i > 2 else run
        while True:
            bits, value = value & 31, value >> 5
            more = value != (-1 if bits & 16 else 0)
            out += chr(48 + bits + 32 * more)
            if not more:
                break
    return out


def test_coco_run_lengths():
    rng = np.random.default_rng(3)
    for _ in range(50):
        runs = rng.integers(0, 5000, rng.integers(1, 12)).tolist()
        assert CO.run_lengths(packed(runs)) == runs and CO.run_lengths(runs) == runs
    mask = rng.random((7, 5)) < 0.5
    flat = mask.T.ravel()
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], edges, [35]])).tolist()
    runs = [0, *runs] if flat[0] else runs
    for counts in (runs, packed(runs)):
        assert (CO.decode_rle(json.dumps({"size": [7, 5], "counts": counts})) == mask).all()
    assert all(CO.decode_rle(t) is None for t in ("{", "{}", '{"size":[2,2],"counts":[3]}', '{"size":[2,2],"counts":[-1,5]}'))


def test_outlines():
    def of(*rows):
        return MK.outline(np.array([[c == "#" for c in r] for r in rows]))

    assert of(".....", ".###.", ".###.") == [(1, 1), (1, 2), (3, 2), (3, 1)]
    assert of("#") == [(0, 0)] and of("###") == [(0, 0), (2, 0)]
    assert of(".#.", "###", ".#.") == [(1, 0), (0, 1), (1, 2), (2, 1)]
    rng = np.random.default_rng(5)
    for _ in range(40):
        labelled = MK.regions(rng.random((9, 11)) < 0.6, diagonal=True)
        for k in np.unique(labelled[labelled > 0]):
            region = labelled == k
            ring = MK.outline(region)
            xs, ys = np.array(ring).T
            rows, cols = np.nonzero(region)
            assert (xs.min(), xs.max(), ys.min(), ys.max()) == (cols.min(), cols.max(), rows.min(), rows.max())
            assert region[ys, xs].all()
            area = abs(np.dot(xs, np.roll(ys, -1)) - np.dot(ys, np.roll(xs, -1))) / 2
            assert area == MK.contour_area(MK.fill_holes(region))


def test_coco_masks_and_results(spark, tmp_path):
    square = {"size": [4, 6], "counts": packed([5, 2, 2, 2, 2, 2, 9])}  # rows 1-2, columns 1-3
    two = {"size": [4, 6], "counts": [0, 2, 2, 2, 6, 2, 2, 2, 6]}  # columns 0-1 and 3-4
    doc = {"images": [{"id": 1, "width": 6, "height": 4, "file_name": "a"}], "categories": [], "annotations": [
        {"id": i, "image_id": 1, "category_id": 1, "bbox": b, "segmentation": m, "area": 6, "iscrowd": 0}
        for i, (b, m) in enumerate([([1, 1, 3, 2], square), ([1.4, 1.2, 3, 2], square), ([0, 1, 3, 2], square), ([0, 0, 5, 2], two), ([0, 0, 1, 1], {"size": [4, 6]}), (None, square)])]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "c.json").write_text(json.dumps(doc))
    t = CO.read_coco(spark, str(tmp_path / "a"))
    got = {}
    for r in CO.scan_coco_annotations(t["annotations"], t["images"]).collect():
        got.setdefault(r["id"], []).append((r["shape"], len(r["points"])))
    assert got == {0: [("polygon", 4)], 1: [("polygon", 4)], 3: [("polygon", 4)] * 2, 5: [("polygon", 4)]}
    results = [{"image_id": 1, "category_id": 1, "score": 0.5, "segmentation": square}, {"image_id": 1, "category_id": 1, "score": 0.25, "bbox": [0, 0, 3, 2]},
               {"image_id": 1, "category_id": 1, "score": 0.1, "bbox": [3, 3, 1, 1], "segmentation": square}]
    (tmp_path / "r.json").write_text(json.dumps(results))
    mapping = spark.createDataFrame([(1, "polygon", "p"), (1, "bounding_box", "b")], "category_id int, shape string, feature_hash string")
    rows = {r["confidence"]: r for r in CO.scan_coco_results(CO.read_coco_results(spark, str(tmp_path / "r.json")), t["images"], mapping).collect()}
    assert set(rows) == {0.5, 0.25} and rows[0.5]["feature_hash"] == "p" and rows[0.25]["w"] == 0.5
    assert [(round(p["x"] * 6), round(p["y"] * 4)) for p in rows[0.5]["points"]] == [(1, 1), (1, 2), (3, 2), (3, 1)]


def test_masks_meet_masks_only(spark):
    """Random masks and boxes of one class: brute force over the pixels."""
    rng = np.random.default_rng(9)
    masks = rng.random((14, 6, 8)) < 0.35
    flat = [m.ravel() for m in masks]
    runs = [MK._counts(f.astype(np.int8)) for f in flat]
    rle = "struct<size:array<int>,counts:array<int>>"
    rows = [(f"m{i}", 1, "a", None, None, None, None, {"size": [6, 8], "counts": r}) for i, r in enumerate(runs)]
    rows += [("empty", 1, "a", None, None, None, None, {"size": [6, 8], "counts": [48]}), ("box", 1, "a", 0.0, 0.0, 1.0, 1.0, None)]
    cols = f"frame_id int, feature string, x double, y double, w double, h double, rle {rle}"
    left = spark.createDataFrame(rows, "pred_id string, " + cols).where("pred_id in ('m0', 'm1', 'm2', 'm3', 'm4', 'empty', 'box')")
    right = spark.createDataFrame(rows, "label_id string, " + cols).where("label_id not in ('m0', 'm1', 'm2', 'm3', 'm4')")
    got = {r["pred_id"]: r for r in M.iou_match(left, right, cell=0.5).collect()}
    for i in range(5):
        ious = {f"m{j}": (flat[i] & flat[j]).sum() / (flat[i] | flat[j]).sum() for j in range(5, 14)}
        assert got[f"m{i}"]["iou"] == pytest.approx(max(ious.values())) and ious[got[f"m{i}"]["match_id"]] == pytest.approx(max(ious.values()))
    assert got["box"]["match_id"] == "box" and got["empty"]["match_id"] is None and got["empty"]["iou"] == 0


def test_duplicate_masks(spark):
    def mask(*counts):
        return {"size": [4, 4], "counts": list(counts)}

    rows = [("a", mask(0, 4, 12)), ("b", mask(0, 4, 12)), ("c", mask(0, 3, 13)), ("d", mask(12, 4)), ("e", mask(16)), ("f", None)]
    df = spark.createDataFrame([(1, "k", i, m) for i, m in rows], "frame_id int, feature string, obj_id string, rle struct<size:array<int>,counts:array<int>>")
    got = {r["obj_id"]: (r["partner"], r["score"]) for r in M.annotation_duplicates(df).collect()}
    assert got == {"a": ("b", 1.0), "c": ("a", 0.75), "d": (None, 0.0), "e": (None, 0.0), "f": (None, 0.0)}


def test_export_of_every_shape(spark):
    frames = spark.createDataFrame([(1, "a.png", 100, 50)], "frame_id int, file_name string, width int, height int")
    cats = spark.createDataFrame([("f", "F", "o")], "feature string, name string, supercategory string")
    p = [{"x": 0.1, "y": 0.2}, {"x": 0.3, "y": 0.2}, {"x": 0.3, "y": 0.6}]
    rows = [("a", "bounding_box", 0.1, 0.2, 0.3, 0.4, None, None), ("b", "rotatable_bounding_box", 0.1, 0.2, 0.3, 0.4, 30.0, None), ("c", "polygon", None, None, None, None, None, p),
            ("d", "polyline", None, None, None, None, None, p), ("e", "point", None, None, None, None, None, p[:1]), ("f", "skeleton", None, None, None, None, None, p),
            ("g", "polygon", None, None, None, None, None, p[:2]), ("h", "polyline", None, None, None, None, None, p[:1]), ("i", "bounding_box", 0.1, 0.2, None, 0.4, None, None),
            ("j", "skeleton", None, None, None, None, None, None), ("k", None, 0.1, 0.2, 0.3, 0.4, None, None)]
    objects = spark.createDataFrame([(1, o, "t", "f", x, y, w, h, s, t, q) for o, s, x, y, w, h, t, q in rows],
                                    "frame_id int, obj_id string, track string, feature string, x double, y double, w double, h double, shape string, theta double, points array<struct<x:double,y:double>>")
    out = [json.loads(r["json"]) for r in EX.coco_tables(frames, objects, cats)["annotations"].orderBy("id").collect()]
    assert len(out) == 7 and [r["id"] for r in out] == list(range(1, 8))
    assert [r["area"] for r in out] == pytest.approx([600, 600, 200, 0, 0, 0, 600])
    assert out[1]["attributes"]["rotation"] == 30 and "rotation" not in out[0]["attributes"]
    assert out[2]["bbox"] == pytest.approx([10, 10, 20, 20]) and out[2]["segmentation"][0] == pytest.approx([10, 10, 30, 10, 30, 30])
    assert out[3]["segmentation"][0] == pytest.approx([10, 10, 30, 10, 30, 30, 30, 30, 30, 10, 10, 10])
    assert (out[4]["keypoints"], out[4]["num_keypoints"], out[4]["bbox"][2:]) == ([10, 10, 2], 1, [0, 0])
    assert out[5]["num_keypoints"] == 3 and out[5]["segmentation"] == [] and out[5]["bbox"] == pytest.approx([10, 10, 20, 20])


def test_area_of_crossing_polygons(spark):
    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    inner = math.sin(math.radians(18)) / math.sin(math.radians(126))  # where the star's lines cross
    loop = [(0, 0), (4, 0), (4, 3), (1, 3), (1, 1), (3, 1), (3, 4), (0, 4)]  # a band whose end runs over its own beginning
    cases = {
        "bow": ([(0, 0), (1, 1), (1, 0), (0, 1)], 0.5), "square": ([(0, 0), (1, 0), (1, 1), (0, 1)], 1), "dart": ([(0, 0), (2, 0), (2, 2), (1, 0.5)], 1.5),
        "star": (star, 5 * inner * math.sin(math.radians(36))), "two": ([(0, 0), (1, 1)], 0), "none": ([], 0), "flat": ([(0, 0), (1, 1), (2, 2)], 0),
        "twice": ([(0, 0), (1, 0), (1, 1), (0, 1)] * 2, 1), "loop": (loop, 4 * 3 + 3 * 1), "flat crossing": ([(0, 0), (3, 3), (1, 1), (2, 2)], 0),
    }
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, (p, _) in cases.items()], "k string, p array<struct<x:double,y:double>>")
    got = {r["k"]: r["a"] for r in df.select("k", PG.repaired_area(F.col("p")).alias("a")).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, (_, v) in cases.items()}


def _ring(n, seed=0, noise=0.2):
    rng = np.random.default_rng(seed)
    angle = np.arange(n) * 2 * np.pi / n
    radius = 1 + noise * rng.random(n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)


def test_planar_edges_agree_with_all_pairs():
    rng = np.random.default_rng(3)
    for n in (4, 9, 40, 90):
        for seed in range(6):
            p = _ring(n, seed, 0.5)
            if seed % 2:
                i, j = rng.integers(0, n, 2)
                p[[i, j]] = p[[j, i]]
            if seed == 4:
                p = np.round(rng.random((n, 2)) * 6)
            q = [tuple(x) for x in p.tolist()]
            e = list(PG._edges(q))
            every = any(PG._meet(*e[i], *e[j]) for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1))
            assert planar.crosses_itself(p) == every
            if not every:
                assert planar.covered_area(p) == pytest.approx(abs(PG._area(q)))
            else:  # winding numbers at random places
                lo, hi = p.min(axis=0), p.max(axis=0)
                at = lo + rng.random((4000, 2)) * (hi - lo)
                after = np.roll(p, -1, axis=0)
                up = (p[:, 1] <= at[:, None, 1]) & (after[:, 1] > at[:, None, 1])
                down = (after[:, 1] <= at[:, None, 1]) & (p[:, 1] > at[:, None, 1])
                side = (after[:, 0] - p[:, 0]) * (at[:, None, 1] - p[:, 1]) - (at[:, None, 0] - p[:, 0]) * (after[:, 1] - p[:, 1])
                winding = (up & (side > 0)).sum(axis=1) - (down & (side < 0)).sum(axis=1)
                assert planar.covered_area(p) == pytest.approx((winding != 0).mean() * np.prod(hi - lo), abs=0.05 * np.prod(hi - lo))


def test_batches_of_small_polygons_equal_single_ones():
    rng = np.random.default_rng(8)
    for n, m in ((3, 3), (4, 4), (4, 6), (7, 5), (9, 9)):
        px, py, qx, qy = (np.round(rng.random((200, k)) * 4) / 2 if seed else rng.random((200, k)) for seed, k in ((0, n), (0, n), (1, m), (1, m)))
        ring_p, ring_q = _ring(n, 1, 0.6), _ring(m, 2, 0.6)
        px[:100], py[:100] = ring_p[:, 0] + rng.random((100, 1)), ring_p[:, 1] + rng.random((100, 1))
        qx[:100], qy[:100] = ring_q[:, 0], ring_q[:, 1]
        p, q = ([list(zip(a, b)) for a, b in zip(x.tolist(), y.tolist())] for x, y in ((px, py), (qx, qy)))
        assert polygon_batches.simple(px, py).tolist() == [PG.is_simple(x) for x in p]
        assert polygon_batches.ious(px, py, qx, qy) == pytest.approx([PG.overlap(a, b) for a, b in zip(p, q)], abs=1e-12)


def test_overlap_of_large_polygons():
    a, b = _ring(2000, 1, 0.002), _ring(1500, 2, 0.002) + [0.7, 0.1]
    points = [[tuple(x) for x in r.tolist()] for r in (a, b)]
    common = planar.covered_area(a, b)
    assert planar.covered_area(a, a) == pytest.approx(planar.covered_area(a))
    assert PG.overlap(*points) == pytest.approx(common / (planar.covered_area(a) + planar.covered_area(b) - common))
    small = [[tuple(x) for x in _ring(k, k, 0.4).tolist()] for k in (20, 23)]
    assert planar.covered_area(*[np.array(p) for p in small]) == pytest.approx(abs(PG._fan_overlap(*small)))


def test_planar_work_grows_below_the_square():
    def pairs(n):
        p = _ring(n, 1, 20 / n)
        assert not planar.crosses_itself(p) and planar.covered_area(p) == pytest.approx(abs(PG._area([tuple(x) for x in p.tolist()])))
        return sum(len(i) for i, _ in planar.neighbours(*planar._edges(p)))

    small, large = pairs(1250), pairs(10_000)
    assert large < 16 * small  # eight times the corners; all pairs would be 64 times as many


def test_mask_moments_equal_those_of_the_pixels(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k, (h, w) in enumerate([(5, 7), (12, 3), (1, 9), (20, 20), (4, 4)]):
        mask = (rng.random((h, w)) < 0.5) if k != 4 else np.zeros((h, w), dtype=bool)
        flat = mask.ravel().astype(int)
        edges = np.flatnonzero(np.diff(np.r_[0, flat]))
        runs = np.diff(np.r_[0, edges, len(flat)]).tolist()
        rows.append((k, ([h, w], runs), mask))
    df = spark.createDataFrame([(k, r) for k, r, _ in rows], "k int, rle struct<size:array<int>, counts:array<int>>")
    got = {r.k: r.hu for r in PG.with_mask_hu_moments(df, "rle").collect()}
    assert got[4] is None
    for k, _, mask in rows[:4]:
        y, x = np.nonzero(mask)
        n = len(x)
        x, y = x - x.mean(), y - y.mean()
        eta = {(p, q): (x**p * y**q).sum() / n ** (1 + (p + q) / 2) for p in range(4) for q in range(4 - p)}
        first = eta[2, 0] + eta[0, 2]
        second = (eta[2, 0] - eta[0, 2]) ** 2 + 4 * eta[1, 1] ** 2
        third = (eta[3, 0] - 3 * eta[1, 2]) ** 2 + (3 * eta[2, 1] - eta[0, 3]) ** 2
        assert got[k][:3] == pytest.approx([first, second, third], rel=1e-6, abs=1e-9)


def test_kitti_names_and_units_are_parameters(spark):
    row = "car 0.0 1 -1.5 10 20 30 60 0 0 0 0 0 0 0 0.75"
    lines = spark.createDataFrame([(row, "cam-A.txt"), (row, "cam-B.txt"), (row, "other.txt")], "line string, file_name string")
    units = spark.createDataFrame([("A", 0, "ha"), ("B", 0, "hb"), ("B", 1, "hb")], "data_title string, frame int, du_hash string").withColumns({"img_width": F.lit(100), "img_height": F.lit(200)})
    mapping = spark.createDataFrame([("car", "f")], "class_name string, feature_hash string")
    named = KI.scan_kitti(lines, units, mapping, file_name=r"^cam-(.*)\.txt$").collect()
    assert [(r["du_hash"], r["frame"]) for r in named] == [("ha", 0)]  # B names two units
    found = KI.scan_kitti(lines, units, mapping, unit_of=lambda n: (
        F.when(n.startswith("cam-"), F.concat(F.lit("h"), F.lower(F.substring(n, 5, 1)))), F.when(n.contains("B"), 1))).collect()
    assert sorted((r["du_hash"], r["frame"]) for r in found) == [("ha", 0), ("hb", 1)]


def test_kitti_lines_are_split_once(spark):
    lines = spark.range(20).select(F.concat_ws(" ", F.lit("car"), F.col("id").cast("string")).alias("line"), F.concat(F.lit("a__"), (F.col("id") - F.col("id") + 1).cast("string"), F.lit(".txt")).alias("file_name"))
    units = spark.createDataFrame([("a", 1, "u"), ("a", None, "none"), ("b", 1, "v")], "data_title string, frame int, du_hash string").withColumns({"img_width": F.lit(1), "img_height": F.lit(1)})
    out = KI.scan_kitti(lines, units, spark.createDataFrame([("car", "f")], "class_name string, feature_hash string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract(") == 2
    assert [(r.du_hash, r.frame) for r in out.collect()] == [("u", 1)] * 20


def test_kitti_files(spark, tmp_path):
    row = "car 0.0 1 -1.5 10 20 30 60 0 0 0 0 0 0 0 0.75"
    for name, text in {"a.jpg__2.txt": row, "b.csv": row + "\n\n", "c.txt": "", "twice.txt": row, "notes.md": row}.items():
        (tmp_path / name).write_text(text)
    units = spark.createDataFrame([("a.jpg", 2, "A"), ("a.jpg", 3, "A3"), ("b", 0, "B"), ("twice", 0, "T"), ("twice", 1, "T")], "data_title string, frame int, du_hash string")
    units = units.withColumns({"img_width": F.lit(100), "img_height": F.lit(200)})
    got = KI.scan_kitti(KI.read_kitti(spark, str(tmp_path)), units, spark.createDataFrame([("car", "f")], "class_name string, feature_hash string")).collect()
    assert {(r["du_hash"], r["frame"]) for r in got} == {("A", 2), ("B", 0)}
    assert (got[0]["x"], got[0]["y"], got[0]["w"], got[0]["h"], got[0]["confidence"]) == (0.1, 0.1, 0.2, 0.2, 0.75)


def test_coco_export_is_one_document(spark, tmp_path):
    frames = spark.createDataFrame([(7, "a.png", 100, 50), (9, "b.png", 10, 10)], "frame_id int, file_name string, width int, height int")
    objects = spark.createDataFrame([(7, "o2", "t", "cat", 0.1, 0.2, 0.5, 0.5), (9, "o1", "t", "dog", 0.0, 0.0, 1.0, 1.0)], "frame_id int, obj_id string, track string, feature string, x double, y double, w double, h double")
    cats = spark.createDataFrame([("cat", "Cat", "animal"), ("dog", "Dog", "animal")], "feature string, name string, supercategory string")
    parts = spark.createDataFrame([(7, "train"), (9, "Unassigned")], "frame_id int, partition string")
    EX.write_coco(EX.coco_tables(frames, objects, cats), str(tmp_path / "all"))
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*"))))
    assert [c["id"] for c in doc["categories"]] == [1, 2] and len(doc["images"]) == 2
    assert doc["annotations"][0]["bbox"] == [10.0, 10.0, 50.0, 25.0] and doc["annotations"][1]["image_id"] == 2
    EX.export_partitions(frames, objects, cats, parts, ["train", "Unassigned"], str(tmp_path / "parts"))
    assert [p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()] == ["partition=train"]
    several = spark.createDataFrame([(7, "x"), (9, "y")], "frame_id int, partition string")
    EX.export_partitions(frames, objects, cats, several, ["x", "y", "empty"], str(tmp_path / "three"))
    for name, image, box in (("x", "a.png", [10.0, 10.0, 50.0, 25.0]), ("y", "b.png", [0.0, 0.0, 10.0, 10.0]), ("empty", None, None)):
        own = json.loads("".join(p.read_text() for p in sorted((tmp_path / "three" / f"partition={name}").glob("part-*"))))
        assert len(own["categories"]) == 2 and [i["file_name"] for i in own["images"]] == ([image] if image else [])
        assert [(a["id"], a["image_id"], a["attributes"]["track_id"], a["bbox"]) for a in own["annotations"]] == ([(1, 1, 0, box)] if image else [])
    split = json.loads("".join(p.read_text() for p in sorted((tmp_path / "parts" / "partition=train").glob("part-*"))))
    assert [i["file_name"] for i in split["images"]] == ["a.png"]


def test_nested_parts_of_a_crowded_frame(spark):
    frames = spark.createDataFrame([(1, 0.5), (2, 0.1)], "f int, m double")
    objects = spark.range(95).select(F.lit(1).alias("f"), F.col("id").cast("string").alias("o"), F.col("id").alias("s"))
    got = EX.nest_metrics(frames, objects, ["f"], ["m"], ["s"], "o", chunk=30).collect()
    assert sum(len(r["objects"] or {}) for r in got) == 95 and len([r for r in got if r["f"] == 1]) > 1


def test_scores_round_trip_as_csv(spark, tmp_path):
    rows = [("a", 2.0), ("b", 1.0), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "identifier string, score double").withColumns({c: F.lit(None).cast("string") for c in ("description", "object_class", "annotator", "url")} | {"frame": F.lit(1)})
    for fmt in ("csv", "parquet"):
        ST.write_scores(df, str(tmp_path / fmt), fmt)
        assert [(r["identifier"], r["score"]) for r in ST.scan_scores(spark, str(tmp_path / fmt), fmt).collect()] == [("c", None), ("b", 1.0), ("a", 2.0)]


@given(st.lists(st.lists(st.integers(0, 1), min_size=1, max_size=30), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_rle_round_trip(spark, masks):
    df = spark.createDataFrame([(m,) for m in masks], "m array<int>")
    e = df.select("m", K.rle_encode(F.col("m"), F.lit(1), F.size("m")).alias("r"))
    for r in e.select("m", "r", K.rle_decode(F.col("r")).alias("back"), K.rle_iou(F.col("r"), F.col("r")).alias("same")).collect():
        assert r["back"] == r["m"] and sum(r["r"]["counts"]) == len(r["m"]) and r["same"] == (1.0 if 1 in r["m"] else 0.0)


def test_mask_regions_and_holes(spark):
    m = np.zeros((12, 14), dtype=np.uint8)
    m[1:6, 1:6] = 1
    m[2:5, 2:5] = 0  # ring: the hole is filled
    m[6, 6] = 1  # touches the ring diagonally: same object
    m[8:10, 1:4] = 1  # area 2: too small
    m[0:4, 8:12] = 2
    df = spark.createDataFrame([(1, 12, 14, bytes(m.tobytes()))], "id int, height int, width int, data binary")
    got = sorted((r["class_id"], r["x"], r["y"], r["w"], r["h"], r["area"]) for r in MK.masks_to_objects(df, ["id"]).collect())
    assert got == [(1, 1, 1, 6, 6, 16.0), (2, 8, 0, 4, 4, 9.0)]


def test_polygon_overlap_and_validity(spark):
    square, shifted = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    bow, ell = [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    assert PG.overlap(square, shifted) == pytest.approx(1 / 7) and PG.overlap(square, square) == pytest.approx(1)
    assert PG.overlap(square, square[::-1]) == pytest.approx(1) and PG.overlap(bow, square) == 0.0
    assert PG.overlap(ell, square) == pytest.approx(3 / 4) and PG.overlap(ell, ell) == pytest.approx(1, abs=0.01)
    assert PG.is_simple(ell) and not PG.is_simple(bow) and not PG.is_simple(square[:2])
    pts = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0)],), ([(0.0, 0.0), (1.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    a, b = [r["hu"] for r in PG.with_hu_moments(pts, "p").collect()]
    assert a[0] == pytest.approx(4 / 12 + 1 / 48) and a[2] == pytest.approx(0, abs=1e-12) and b is None


def bmp(path, bgr):
    h, w, _ = bgr.shape
    rows = b"".join(r.tobytes() + b"\0" * (-3 * w % 4) for r in bgr[::-1])
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows)


def test_pixel_metrics_of_written_bitmaps(spark, tmp_path):
    solid = {"grey": (128, 128, 128), "red": (0, 0, 255), "green": (0, 255, 0), "blue": (255, 0, 0)}
    for n, c in solid.items():
        bmp(tmp_path / f"{n}.bmp", np.full((8, 8, 3), c, dtype=np.uint8))
    board = np.indices((8, 8)).sum(0) % 2 * 255
    bmp(tmp_path / "board.bmp", np.repeat(board[:, :, None], 3, axis=2).astype(np.uint8))
    (tmp_path / "broken.bmp").write_bytes(b"no image")
    rows = {r["uri"].rsplit("/", 1)[1][:-4]: r for r in image_metrics(ST.scan_images(spark, str(tmp_path)), ["uri"]).collect()}
    assert set(rows) == {*solid, "board"}
    assert rows["grey"]["brightness"] == pytest.approx(128 / 255) and rows["grey"]["contrast"] == 0 and rows["grey"]["sharpness"] == 0 and rows["grey"]["blur"] == 1
    for n in ("red", "blue"):
        assert [rows[n][c] for c in ("red", "green", "blue")] == [float(c == n) for c in ("red", "green", "blue")]
    assert rows["green"]["green"] == 1.0 and rows["grey"]["red"] == 0
    assert rows["board"]["sharpness"] == pytest.approx((4 * 255) ** 2) and rows["board"]["brightness"] == pytest.approx(0.5)


def test_label_transformer_schema_is_checked(spark):
    files = spark.createDataFrame([("a",)], "path string")
    with pytest.raises(ValueError):
        apply_label_transformer(files, lambda f: f, files)


def test_streams_over_several_batches(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "id long, k string, v double, vec array<double>"
    batches = [[(1, "a", 1.0, [1.0, 0.0]), (2, "b", 5.0, [0.0, 1.0])], [(3, "a", 3.0, [1.0, 1.0])], [(4, "a", -1.0, [0.0, 1.0])]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(str(src / f"b{i}"))

    def drain(df, writer, name):
        q = writer(df).option("checkpointLocation", str(out / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{src}/*")
    drain(SJ.stream_running_stats(stream, "k", "v"), lambda d: d.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(out / "stats"))), "stats")
    stats = {r["k"]: (r["min"], r["max"], r["mean"], r["count"]) for r in spark.read.parquet(str(out / "stats")).collect()}
    assert stats == {"a": (-1.0, 3.0, 1.0, 3), "b": (5.0, 5.0, 5.0, 1)}
    drain(SJ.stream_shape_similarity(stream, "k", "id", ["id"], "vec"), lambda d: d.writeStream.outputMode("append").format("parquet").option("path", str(out / "sim")), "sim")
    sim = {r["id"]: r["score"] for r in spark.read.parquet(str(out / "sim")).collect()}
    assert len(sim) == 4 and sim[2] == 1.0
    q = SJ.stream_sync(stream.select("k", "id", "v"), str(out / "log")).option("checkpointLocation", str(out / "log-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["id"]) for r in SJ.synced(spark.read.parquet(str(out / "log")), "k", "id").collect()} == {("a", 4), ("b", 2)}


def test_polygon_overlaps_by_places_in_arrow_values(spark):
    """Missing, empty, small and large polygons of one batch, cut out of a longer one by a filter."""
    n = 30
    disc = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    square, tri = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    shapes = [None, [], tri, square, disc]
    rows = [(i * 5 + j, *[None if s is None else [{"x": x, "y": y} for x, y in s] for s in (a, b)]) for i, a in enumerate(shapes) for j, b in enumerate(shapes)]
    df = spark.createDataFrame(rows, "k int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>").coalesce(1)
    got = {r.k: (r.v, r.ok) for r in df.where("k % 7 <> 3").select("k", PG.polygon_iou(F.col("a"), F.col("b")).alias("v"), PG.simple_polygon_check(F.col("a")).alias("ok")).collect()}
    for k, (v, ok) in got.items():
        a, b = shapes[k // 5], shapes[k % 5]
        assert ok == (k // 5 > 1)
        assert v == pytest.approx(PG.overlap(a, b) if a and b else 0.0)


def test_areas_of_small_crossing_polygons_in_batches(spark):
    rng = np.random.default_rng(8)
    for n in range(3, 13):
        x, y = rng.integers(0, 6, (40, n)).astype(float) + rng.choice([0.0, 0.1], (40, 1)), rng.integers(0, 6, (40, n)).astype(float)
        want = [planar.covered_area(np.stack(p, axis=1)) for p in zip(x, y)]
        assert polygon_batches.covered(x, y) == pytest.approx(want, abs=1e-9)
    calls = []
    lists = [pa.array([[0.0, 1.0, 1.0, 0.0]] * 9 + [None]), pa.array([[0.0, 1.0, 0.0, 1.0]] * 9 + [None])]
    got = polygon_batches.in_groups(lists, lambda x, y: calls.append(len(x)) or polygon_batches.covered(x, y), None, np.nan)
    assert calls == [9] and got[:9] == pytest.approx([0.5] * 9) and np.isnan(got[9])
    bow = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0))]
    df = spark.createDataFrame([(0, bow), (1, None), (2, bow[:2])], "k int, p array<struct<x:double,y:double>>")
    assert {r.k: r.a for r in df.select("k", PG.repaired_area(F.col("p")).alias("a")).collect()} == {0: 0.5, 1: None, 2: 0.0}


def test_union_of_many_groups_at_once():
    rng = np.random.default_rng(9)
    groups, edges = [], []
    for g in range(30):
        shapes = []
        for _ in range(int(rng.integers(1, 6))):
            if rng.random() < 0.5:  # a box
                x, y, w, h = rng.integers(0, 5, 4) + [0, 0, 1, 1]
                shapes.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
            else:
                shapes.append([tuple(p) for p in rng.random((int(rng.integers(3, 6)), 2)) * 6])
        shapes = [[(float(x), float(y)) for x, y in s] for s in shapes]
        groups.append(shapes)
        for s in shapes:
            owner = edges[-1][4] + 1 if edges else 0
            edges += [(*a, *b, owner, g) for a, b in zip(s, s[1:] + s[:1])]
    x0, y0, x1, y1, owner, group = (np.array(c) for c in zip(*edges))
    for parts in (1 << 20, 50):
        polygon_batches.PARTS, kept = parts, polygon_batches.PARTS
        try:
            assert polygon_batches.union_areas(x0, y0, x1, y1, owner, group) == pytest.approx([PG.union_area(s) for s in groups], abs=1e-9)
        finally:
            polygon_batches.PARTS = kept


def test_masks_are_outlined_before_they_meet_their_image(spark):
    rng = np.random.default_rng(4)
    seen, rows = [], []
    for i in range(60):
        mask = rng.random((7, 9)) < (1.0 if i == 0 else 0.55)
        flat = mask.T.ravel()
        runs = MK._counts(flat.astype(np.int8))
        labelled = MK.regions(mask, diagonal=True)
        rings = [MK.outline(labelled == k) for k in np.unique(labelled[labelled > 0])]
        seen += [(i, [(x / 9, y / 7) for x, y in ring]) for ring in rings if len(ring) >= 3]
        rows.append((i, 1, 2, None, json.dumps({"size": [7, 9], "counts": runs}), 1.0, 0, None))
    notes = spark.createDataFrame(rows, CO.ANNOTATION)
    images = spark.createDataFrame([(1, 7, 9, "a")], CO.IMAGE)
    out = CO.scan_coco_annotations(notes, images)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("ArrowEvalPython")  # the plan lists the join above the outlines
    got = [(r.id, [(p.x, p.y) for p in r.points]) for r in out.collect()]
    assert sorted(got) == sorted(seen)


def test_label_rows_are_parsed_where_they_are_dealt(spark):
    """No filter on a parsed column goes below the partitions that the documents were dealt over."""
    unit = {"d": {"data_hash": "d", "labels": {"classifications": [{"classificationHash": "c"}]}}}
    docs = [json.dumps({"label_hash": t or "none", "data_type": t, "data_units": unit}) for t in ("image", "img_group", "dicom", None)]
    dealt = spark.createDataFrame([(d,) for d in docs], "value string").repartition(3)
    frames = LR.scan_frames(dealt.select(F.from_json("value", LR.LABEL_ROW).alias("r")).select("r.*"))
    plan = LR.scan_classifications(frames)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan[plan.index("Repartition"):]
    assert sorted(r.label_hash for r in LR.scan_classifications(frames).collect()) == ["image", "img_group"]


def test_masks_of_a_batch_by_places_in_arrow_values(spark):
    """Extents, overlaps and pixel sums of missing, empty, full and random masks, against their pixels."""
    rng = np.random.default_rng(6)
    masks = [None, np.zeros((4, 5), bool), np.ones((4, 5), bool)] + [rng.random((4, 5)) < p for p in (0.2, 0.5, 0.8) for _ in range(4)]
    runs = [None if m is None else MK._counts(m.ravel().astype(np.int8)) for m in masks]
    pairs = [(i, j) for i in range(len(masks)) for j in range(len(masks))]
    # a slice of a longer array begins in the middle of its values
    a, b = (pa.array([[9, 9]] + [runs[p[k]] for p in pairs], pa.list_(pa.int32())).slice(1) for k in (0, 1))
    want = [np.nan if masks[i] is None or masks[j] is None else (masks[i] & masks[j]).sum() / max((masks[i] | masks[j]).sum(), 1) for i, j in pairs]
    assert K.overlaps(a, b) == pytest.approx(want, nan_ok=True)
    rows = spark.createDataFrame([(k, None if r is None else ([4, 5], r)) for k, r in enumerate(runs)], "k int, rle struct<size:array<int>,counts:array<int>>").coalesce(1)
    for r in rows.select("k", K.rle_bounds(F.col("rle")).alias("b"), K.rle_moments(F.col("rle")).alias("m")).collect():
        mask = masks[r.k]
        ys, xs = np.nonzero(mask) if mask is not None else (np.zeros(0, int),) * 2
        assert r.m == (None if mask is None else pytest.approx([float((xs**p * ys**q).sum()) for p, q in K.POWERS]))
        if not len(ys):
            assert r.b is None or set(r.b.asDict().values()) == {None}
            continue
        wraps = any(u % 5 + v > 5 for u, v in zip(np.cumsum([0, *runs[r.k]])[1::2], runs[r.k][1::2]))
        assert (r.b.y, r.b.y2) == (ys.min(), ys.max() + 1) and (r.b.x, r.b.x2) == ((0, 5) if wraps else (xs.min(), xs.max() + 1))


def test_compressed_parts_are_one_document(spark, tmp_path):
    frames = spark.createDataFrame([(i, f"{i}.png", 10, 20) for i in range(6)], "frame_id int, file_name string, width int, height int")
    objects = spark.createDataFrame([(i % 6, f"o{i}", i % 3, "c", 0.1, 0.1, 0.5, 0.5) for i in range(30)], "frame_id int, obj_id string, track int, feature string, x double, y double, w double, h double")
    cats = spark.createDataFrame([("c", "class c", "object")], "feature string, name string, supercategory string")
    EX.write_coco(EX.coco_tables(frames, objects, cats), str(tmp_path / "d"), compression="gzip")
    doc = json.loads(gzip.decompress(b"".join(p.read_bytes() for p in sorted((tmp_path / "d").glob("part-*.gz")))))
    assert [a["id"] for a in doc["annotations"]] == list(range(1, 31)) and len(doc["images"]) == 6 and len(doc["categories"]) == 1


def test_missing_runs_and_coordinates_stay_in_their_row(spark):
    full = [0, 20]
    lists = [full, [None, 3, 17], [2, None, 10], [2, 3, None], full]
    rows = spark.createDataFrame([(k, ([4, 5], c)) for k, c in enumerate(lists)], "k int, rle struct<size:array<int>,counts:array<int>>").coalesce(1)
    got = {r.k: r for r in rows.select("k", K.rle_bounds(F.col("rle")).alias("b"), K.rle_moments(F.col("rle"))[0].alias("m"), K.rle_iou(F.col("rle"), F.col("rle")).alias("v")).collect()}
    assert [got[k].m for k in range(5)] == [20.0, None, None, 3.0, 20.0]
    assert [got[k].b.x2 for k in range(5)] == [5, None, None, 5, 5]
    assert [got[k].v for k in range(5)] == [1.0, None, None, None, 1.0]
    bow = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]
    rings = [bow, [(x, None) for x, _ in bow], [(None, y) for _, y in bow], bow]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in enumerate(rings)], "k int, p array<struct<x:double,y:double>>").coalesce(1)
    assert {r.k: r.a for r in df.select("k", PG.repaired_area(F.col("p")).alias("a")).collect()} == {0: 0.5, 1: None, 2: 0.0, 3: 0.5}


@pytest.mark.parametrize("opened", [True, False])
def test_joined_parts_are_one_file_without_a_sort(spark, tmp_path, monkeypatch, opened):
    from gaugeframe.sources import export

    monkeypatch.setattr(export, "BLOCK", 1000)
    if not opened:
        monkeypatch.setattr(export, "OPENED", ())
    rows = [spark.range(n).repartition(p).selectExpr("case when id % 50 = 7 then null when id % 50 = 8 then '' else concat('é', repeat('x', id % 300), id) end as value") for n, p in ((2000, 3), (0, 1), (900, 4))]
    parts = ["head", rows[0], "between", rows[1], rows[2], "end"]
    asked = []
    plain = type(rows[0]).sortWithinPartitions
    monkeypatch.setattr(type(rows[0]), "sortWithinPartitions", lambda self, *a, **k: asked.append(a) or plain(self, *a, **k))
    export.write_joined(spark, f"{tmp_path}/one", parts)
    assert bool(asked) != opened
    assert [f.name for f in tmp_path.iterdir()] == ["one"]
    (file,) = (tmp_path / "one").glob("part-*")
    lines = file.read_text().split("\n")
    assert lines.pop() == "" and len(lines) == 2903
    assert (lines[0], lines[2001], lines[-1]) == ("head", "between", "end")
    for got, wanted in ((lines[1:2001], rows[0]), (lines[2002:-1], rows[2])):
        assert sorted(got) == sorted(r.value or "" for r in wanted.collect())


def test_label_rows_are_parsed_as_characters_with_the_rows_of_the_byte_parser(spark, tmp_path):
    good = json.dumps({"label_hash": "é ", "data_type": "video", "data_units": {"u": {"data_hash": "h", "data_fps": 2, "labels": {"0": {"objects": []}, "3": {}}}}}, ensure_ascii=False).encode()
    lines = [b"\xef\xbb\xbf" + good, good, b"", b"  ", b"{broken", b'{"label_hash": "\xff\xfe"}', b'{"label_hash": 5, "data_units": []}', b"[" + good + b"," + good + b"]", b"[]", b"null", good + b" tail", b'"text"', good]
    (tmp_path / "rows.json").write_bytes(b"\n".join(lines))
    found = LR.read_label_rows(spark, str(tmp_path))
    assert found._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().options().get("encoding").get() == "UTF-8"
    by_bytes = spark.read.schema(LR.LABEL_ROW).json(str(tmp_path))
    # nested text comes without the blanks of its line
    plain = [r.replace(": ", ":").replace(", ", ",") for r in map(str, by_bytes.collect())]
    assert sorted(r.replace(": ", ":").replace(", ", ",") for r in map(str, found.collect())) == sorted(plain)
    assert LR.scan_frames(found).count() == LR.scan_frames(by_bytes).count() >= 8
