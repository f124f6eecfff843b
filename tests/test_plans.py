"""Sliced scans, order statistics, spatial joins and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeframe.functions.boxes import box_iou
from gaugeframe.operators import evaluation as E, matching as M, summary as A
from gaugeframe.operators.embeddings import label_quality, singularity
from gaugeframe.plans.neighbours import knn_join
from gaugeframe.plans import ann, neighbours, quantiles, scan, spatial
from gaugeframe.plans.joins import null_safe_join
from gaugeframe.plans.quantiles import linear_quantiles, order_statistics
from gaugeframe.plans.scan import ranked, running
from gaugeframe.plans.spatial import best_other, best_overlap
from gaugeframe.registry import DATA_REGISTRY, Metric, MetricRegistry, NORMAL
from gaugeframe.session import cut_lineage


def test_running_matches_a_window_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.randrange(6), i, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, id int, v double")
    got = running(df, ["k"], [F.desc("o"), F.asc("id")], {"n": F.lit(1), "s": F.col("id")}, {"m": F.col("v")}, slices=7).collect()
    want = {}
    for k in {r[0] for r in rows}:
        n = s = 0
        m = None
        for _, o, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])):
            n, s = n + 1, s + i
            want[i] = (n, s, m)
            m = v if m is None else max(m, v)
    assert {r["id"]: (r["n"], r["s"], r["m"]) for r in got} == want


def test_rank_without_keys(spark):
    df = spark.range(500).withColumn("h", F.xxhash64("id"))
    got = [r["rank"] for r in ranked(df, [], [F.asc("h")]).orderBy("h").collect()]
    assert got == list(range(1, 501))


@pytest.mark.parametrize("n", range(1, 10))
def test_index_quartiles_of_few_rows(spark, n):
    df = spark.createDataFrame([(float((i * 7) % n),) for i in range(n)], "m double")
    r = order_statistics(df, ["m"]).collect()[0]
    s = sorted(float((i * 7) % n) for i in range(n))
    assert (r["n"], r["q1"], r["median"], r["q3"]) == (n, s[n // 4], s[n // 2], s[3 * n // 4])


def test_order_statistics_are_exact(spark):
    rng = random.Random(3)
    a = [rng.gauss(0, 1) for _ in range(6000)]
    b = [5.0 if rng.random() < 0.4 else float(rng.randrange(1000)) for _ in range(6000)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    got = {r["metric"]: r for r in order_statistics(df, ["a", "b"]).collect()}
    for name, values in (("a", sorted(a)), ("b", sorted(b))):
        assert [got[name][q] for q in ("q1", "median", "q3")] == [values[1500], values[3000], values[4500]]
    lin = {r["metric"]: r for r in linear_quantiles(df, ["a", "b"], {"p": 0.37}).collect()}
    assert lin["a"]["p"] == pytest.approx(np.quantile(a, 0.37), abs=1e-12)
    assert lin["b"]["p"] == pytest.approx(np.quantile(b, 0.37), abs=1e-12)


@pytest.mark.parametrize("cells", [4, 64, 1 << 16])
def test_order_statistics_in_several_passes(spark, monkeypatch, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    rng = random.Random(cells)
    columns = {
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(3000)], "near": [1.0 + i * 2.0**-52 for i in range(3000)],
        "ties": [rng.choice([0.0, -0.0, 5e-324, -1.5, 7.25, float("inf")]) for _ in range(3000)], "normal": [rng.gauss(3, 1) for _ in range(3000)],
    }
    for values in columns.values():
        rng.shuffle(values)
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    marks = {f"p{k}": quantiles.index_mark(k, 40) for k in range(40)}
    if cells < 1 << 16:
        # four passes narrow a cell of 2 ** 48 doubles only with all 2 ** 16 cells; fewer ones do for narrower data
        df = df.drop("wide", "normal")
    got = {r["metric"]: r for r in order_statistics(df, df.columns, marks).collect()}
    for name in df.columns:
        s = sorted(columns[name])
        assert [got[name][f"p{k}"] for k in range(40)] == [s[3000 * k // 40] for k in range(40)]


def test_order_statistics_give_no_task_many_rows(spark):
    """Rows that a window task sees: cells, never values."""
    n = 400_000
    df = spark.range(n).select((F.rand(3) * F.col("id")).alias("m"))
    values = quantiles.long_metrics(df, ["m"]).withColumn("c0", quantiles._logarithmic(F.col("value")))
    cells = values.groupBy("c0").agg(F.count(F.lit(1)).alias("n"))
    assert cells.count() < n / 500
    widest = cells.orderBy(F.desc("n")).first()
    left = values.where(F.col("c0") == widest.c0)
    lo, hi = left.agg(F.min("value"), F.max("value")).first()
    assert left.withColumn("c1", quantiles._linear(F.col("value"), F.lit(lo), F.lit(hi))).select("c1").distinct().count() <= quantiles.CELLS + 1


def test_summary_of_empty_null_constant_and_nan_columns(spark):
    df = spark.createDataFrame([(None, 2.0, 1.0), (None, 2.0, float("nan"))], "x double, y double, z double")
    rows = {r["metric"]: r for r in A.metric_summary(df, ["x", "y", "z"]).collect()}
    assert set(rows) == {"y", "z"}
    assert rows["y"]["q1"] == rows["y"]["max"] == 2.0 and rows["y"]["severe"] == 0
    assert rows["z"]["count"] == 1
    assert A.metric_summary(df.where("false"), ["x", "y"]).count() == 0


def test_value_on_the_fence_is_moderate(spark):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 16.0, 16.5]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    q1, q3 = sorted(values)[2], sorted(values)[7]
    r = A.metric_summary(df, ["m"]).collect()[0]
    hi, top = q3 + 1.5 * (q3 - q1), q3 + 2.5 * (q3 - q1)
    assert r["moderate"] == sum(hi < v <= top for v in values) and r["severe"] == sum(v > top for v in values)


def test_rank_metrics_return_positions_and_random_has_no_outliers(spark):
    df = spark.createDataFrame([(float(i) ** 3, float(i) ** 6) for i in range(10)], "metric_image_difficulty double, metric_random double")
    rows = {r["metric"]: r for r in A.metric_summary(df, ["metric_image_difficulty", "metric_random"], DATA_REGISTRY).collect()}
    d = rows["metric_image_difficulty"]
    assert (d["min"], d["q1"], d["median"], d["q3"], d["max"]) == (0, 2, 5, 7, 10)
    assert rows["metric_random"]["severe"] == 0


def test_ks_bounds(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("b", 11.0)], "s string, m double")
    assert A.ks_dissimilarity(df, ["m"], F.col("s") == "a").collect()[0]["ks"] == 1.0
    assert A.ks_dissimilarity(df.where("s = 'a'"), ["m"], F.col("s") == "a").count() == 0


def test_registry_rejects_duplicates():
    r = MetricRegistry.of([Metric("m", NORMAL, "M")])
    with pytest.raises(ValueError):
        r.register(Metric("m", NORMAL, "M"))
    with pytest.raises(KeyError):
        r.require(["other"])


def iou(a, b):
    ix = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    iy = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return ix * iy / (a[2] * a[3] + b[2] * b[3] - ix * iy) if ix > 0 and iy > 0 else 0.0


def boxes(n, seed):
    rng = random.Random(seed)
    return [(f"{seed}-{i:03d}", rng.randrange(3), rng.randrange(9) / 10, rng.randrange(9) / 10, rng.randrange(1, 5) / 10, rng.randrange(1, 5) / 10) for i in range(n)]


@pytest.mark.parametrize("cell", [0.07, 0.25, 2.0])
def test_best_overlap_against_brute_force(spark, cell):
    left, right = boxes(150, 1), boxes(150, 2) + [("2-flat", 0, 0.1, 0.1, 0.0, 0.3)]
    schema = "id string, k int, x double, y double, w double, h double"
    got = best_overlap(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "id", cell).collect()
    assert len(got) == len(left)
    for r in got:
        scored = sorted((-iou((r["x"], r["y"], r["w"], r["h"]), b[2:]), b[0]) for b in right if b[1] == r["k"])
        assert r["iou"] == pytest.approx(round(-scored[0][0], 9), abs=1e-12)  # an IoU has nine digits
        assert (r["best_id"] is None) == (scored[0][0] == 0)


def test_best_other_with_many_copies(spark):
    rows = [(f"c{i:03d}", 0, 0.1, 0.1, 0.2, 0.2) for i in range(200)] + [("z", 0, 0.15, 0.1, 0.2, 0.2), ("far", 0, 0.8, 0.8, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "id string, k int, x double, y double, w double, h double")
    got = {r["id"]: (r["partner"], r["iou"]) for r in best_other(df, ["k"], "id").collect()}
    assert len(got) == 202
    assert got["c000"] == ("c001", 1.0) and got["c150"] == ("c000", 1.0)
    assert got["z"][0] == "c000" and got["far"] == (None, 0.0)


@given(st.lists(st.tuples(*[st.integers(0, 20)] * 4, *[st.integers(0, 20)] * 4), min_size=1, max_size=40))
@settings(max_examples=10, deadline=None)
def test_box_iou_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame([tuple(float(v) for v in p) for p in pairs], ", ".join(f"c{i} double" for i in range(8)))
    a, b = [F.col(f"c{i}") for i in range(4)], [F.col(f"c{i}") for i in range(4, 8)]
    for r in df.select(box_iou(a, b).alias("p"), box_iou(b, a).alias("q")).collect():
        assert r["p"] == r["q"] and 0 <= r["p"] <= 1 + 1e-12


def vectors(n, d, seed):
    return np.random.default_rng(seed).normal(size=(n, d))


def frame(spark, v, labels=None):
    return spark.createDataFrame([(i, [float(x) for x in row], int(labels[i]) if labels is not None else 0) for i, row in enumerate(v)], "id long, v array<double>, label int")


def brute(v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    return d, {i: [int(j) for j in np.lexsort((np.arange(len(v)), np.round(d[i], 12)))[:k]] for i in range(len(v))}


@pytest.mark.parametrize("block_rows", [16, 500])
def test_knn_with_clusters_and_a_hot_copy_group(spark, block_rows):
    v = vectors(120, 6, 5)
    v[:60] += 9 * np.eye(6)[0]
    v[30:70] = v[30]  # a third of all rows are copies
    got = {}
    for r in knn_join(frame(spark, v), "id", "v", 5, block_rows=block_rows).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == brute(v, 5)[1]


def test_knn_with_fewer_rows_than_k_and_a_zero_vector(spark):
    v = np.vstack([vectors(3, 4, 2), np.zeros((1, 4))])
    rows = knn_join(frame(spark, v), "id", "v", 10).collect()
    assert len(rows) == 6 and all(r["id"] != r["neighbor"] and 3 not in (r["id"], r["neighbor"]) for r in rows)


def test_singularity_with_copies_near_copies_and_chains(spark):
    base = vectors(40, 8, 11)
    near = base[7] / np.linalg.norm(base[7])
    side = base[8] - (base[8] @ near) * near
    side /= np.linalg.norm(side)

    def turned(distance):
        angle = np.arccos(1 - distance)
        return np.cos(angle) * near + np.sin(angle) * side

    # 40-44 exact copies of 3; 45 near copy of 7; 46 and 47 form a chain 7 ~ 46 ~ 47 with 47 not next to 7
    step = np.arccos(1 - 0.8e-5)
    chain = [np.cos(step * i) * near + np.sin(step * i) * side for i in (1, 2)]
    v = np.vstack([base, np.repeat(base[3:4], 5, axis=0), turned(0.02)[None], chain])
    got = {r["id"]: r for r in singularity(frame(spark, v), "id", "v", 16).collect()}
    assert len(got) == 48
    assert all(got[i]["score"] == 0 and got[i]["original"] == 3 for i in range(40, 45))
    assert got[45]["description"] == "Near duplicate image"
    assert got[46]["score"] == 0 and got[46]["original"] == 7
    assert got[47]["original"] is None and got[47]["score"] == pytest.approx(1 - np.cos(2 * step), rel=1e-3)
    assert got[3]["original"] is None and got[3]["score"] > 1e-5


def test_label_quality_verdicts(spark):
    v = vectors(40, 4, 3)
    v[:20] += [20, 0, 0, 0]
    v[20:] += [0, 20, 0, 0]
    labels = [0] * 20 + [1] * 20
    labels[0] = 1
    rows = {r["id"]: r for r in label_quality(frame(spark, v, labels), "id", "v", "label", block_rows=16).collect()}
    assert rows[0]["verdict"] == "wrong" and rows[0]["score"] == 0
    assert rows[25]["verdict"] == "correct" and rows[25]["score"] == 1
    small = frame(spark, v[:5], labels[:5]).withColumn("q", F.lit(1))
    assert {(r.score, r.verdict) for r in label_quality(small, "id", "v", "label", group="q").collect()} == {(None, None)}


def test_singularity_visits_few_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((24, 16))
    v = np.concatenate([c + 0.05 * rng.standard_normal((50, 16)) for c in centres])
    blocks = neighbours.place(neighbours.unit_vectors(frame(spark, v), "id", "v"), 50)
    asked = neighbours.queries(blocks, neighbours._beyond(1e-5))
    cells = blocks.rows.select("cell").distinct().count()
    met = asked.select("i", F.explode("cells").alias("j")).distinct().count()
    assert cells > 12 and met <= cells * cells / 2
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = 1 - u @ u.T
    d[d < 1e-5] = np.inf
    got = {r.rid: r.distance for r in neighbours.nearest_beyond(blocks, 1e-5).collect()}
    assert np.allclose([got[i] for i in range(len(v))], d.min(axis=1), atol=1e-9)


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((40, dims))[rng.integers(0, 40, n)] + 0.4 * rng.standard_normal((n, dims))


def test_stored_index_reaches_its_recall(spark, tmp_path):
    v = clustered(3000, 32, 1)
    v[100:140] = v[100]
    df = frame(spark, v)
    index = ann.build(df, "id", "v", str(tmp_path / "index"), tables=6, bucket_rows=64)
    probes = ann.tuned_probes(index, 10, 0.9)
    assert probes < (1 << index.bits) - 1
    got = {}
    for r in ann.search(ann.Index(spark, index.path), df, "id", "v", 10, probes).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbor, r.distance)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    hits = 0
    for i in range(len(v)):
        kth = np.sort(d[i])[9]
        near = got[i]
        assert list(near) == sorted(near) and all(abs(x - max(d[i, n], 0)) < 1e-9 for n, x in near.values())
        hits += sum(x <= kth + 1e-9 for _, x in near.values())
    assert hits / (10 * len(v)) >= 0.9


def test_index_with_all_codes_is_exact(spark, tmp_path):
    v = np.vstack([vectors(90, 6, 4), np.zeros((1, 6))])
    v[20:50] = v[20]
    index = ann.build(frame(spark, v), "id", "v", str(tmp_path / "i"), tables=1, bucket_rows=16)
    got = {}
    for r in ann.search(index, frame(spark, v), "id", "v", 5, probes=(1 << index.bits) - 1).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    assert got == brute(v[:90], 5)[1]


def test_probe_sets_come_by_rising_margin():
    rng = np.random.default_rng(2)
    margins = np.sort(rng.random(7))
    weights = np.int64(1) << np.arange(7)
    every = sorted(range(1 << 7), key=lambda s: sum(margins[i] ** 2 for i in range(7) if s >> i & 1))
    assert ann._flips(margins, weights, 127) == every


def test_search_ships_no_vector_once_per_block_it_meets(spark, monkeypatch):
    """Vectors without clusters, where every block meets every other: rows that are shuffled or stored do not grow with the number of blocks."""
    monkeypatch.setattr(neighbours, "SLAB_ROWS", 32)
    v = vectors(300, 6, 8)
    written = []
    monkeypatch.setattr(neighbours, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    got = {}
    for r in neighbours.knn_join(frame(spark, v), "id", "v", 4, block_rows=16).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    slabs = [w for w in written if "reach" in w.columns]
    assert [w.agg(F.sum(F.size("rid"))).first()[0] for w in slabs] == [300, 300] and all(w.count() > 4 for w in slabs)
    assert all(w.count() == 300 for w in written if "reach" not in w.columns)
    assert got == brute(v, 4)[1]


def test_neighbours_of_some_rows_are_looked_for_among_all(spark):
    v = vectors(90, 6, 4)
    v[20:50] = v[20]
    df = frame(spark, v)
    got = {}
    for r in knn_join(df, "id", "v", 5, block_rows=16, only=df.where("id in (3, 31, 77)")).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    want = brute(v, 5)[1]
    assert got == {i: want[i] for i in (3, 31, 77)}


def test_index_deals_crowded_buckets_out(spark, tmp_path, monkeypatch):
    """More groups, parts and pieces than one, with all codes probed: the search is exact, and the sample's recall is measured on codes."""
    monkeypatch.setattr(ann, "GROUP_ROWS", 32)
    monkeypatch.setattr(ann, "PIECE", 5)
    v = vectors(200, 6, 12)
    v[:120] += 30 * np.eye(6)[0]  # near one another, so most codes are the same
    index = ann.build(frame(spark, v), "id", "v", str(tmp_path / "i"), tables=2, bucket_rows=16)
    got = {}
    for r in ann.search(index, frame(spark, v), "id", "v", 5, probes=(1 << index.bits) - 1).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    assert got == brute(v, 5)[1]
    asked = index.vectors.select(F.col("rid").alias("qid"), "u").orderBy("qid").limit(20)
    assert ann.recall(index, asked, 5, (1 << index.bits) - 1) == 1.0


def test_few_boxes_travel_once_and_crowded_keys_by_cells(spark, monkeypatch):
    left, right = boxes(150, 1), boxes(150, 2) + [("2-none", None, 0.1, 0.1, 0.3, 0.3), ("2-flat", 0, 0.1, 0.1, 0.0, 0.3)]
    schema = "id string, k int, x double, y double, w double, h double"
    ldf, rdf = spark.createDataFrame([*left, ("1-none", None, 0.1, 0.1, 0.3, 0.3), ("1-nowhere", 0, None, 0.1, 0.3, 0.3)], schema), spark.createDataFrame(right, schema)

    def run():
        crowded = spatial._crowded(ldf, rdf, ["k"])
        rows = spatial._cells(ldf, ["k"], crowded, 0.07).count()
        found = {r.id: (r.best_id, r.iou) for r in best_overlap(ldf, rdf, ["k"], "id", 0.07).collect()}
        return rows, found, {r.id: (r.partner, r.iou) for r in best_other(ldf, ["k"], "id", 0.07).collect()}

    once = run()
    monkeypatch.setattr(spatial, "CROWDED", 10)
    dealt = run()
    assert once[0] == 151 and dealt[0] > 5 * 151
    assert once[1:] == dealt[1:] and once[1]["1-none"] == ("2-none", 1.0) and once[1]["1-nowhere"] == once[2]["1-nowhere"] == (None, 0.0)


def test_running_carries_only_keys_that_cross_slices(spark, monkeypatch):
    rows = [(None if i % 50 < 3 else f"k{i % 50:02d}" if i % 3 else "hot", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int")
    joined = []
    monkeypatch.setattr(scan, "null_safe_join", lambda *a: joined.append(a[1]) or null_safe_join(*a))
    got = {r.id: (r.n, r.m) for r in running(df, ["k"], [F.asc("id")], {"n": F.lit(1)}, {"m": F.col("id")}, slices=6).collect()}
    seen, last, want = {}, {}, {}
    for k, i in rows:
        seen[k] = seen.get(k, 0) + 1
        want[i], last[k] = (seen[k], last.get(k)), i
    assert got == want
    assert 0 < joined[0].count() <= 6 and joined[1].count() <= 12


def test_one_row_per_metric_or_class_is_broadcast(spark):
    from gaugeframe.operators.tables import normalize_scores, object_dataset

    scores = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 3.0), ("c", "n", 5.0)], "identifier string, metric string, score double")
    objects = spark.createDataFrame([(1, "o1", "A"), (1, "o2", "N")], "key int, obj_id string, feature string")
    frames = spark.createDataFrame([(1, "u")], "key int, uri string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, by in ((normalize_scores(scores), "metric"), (object_dataset(frames, objects, objects.select("feature").where("feature = 'A'"), ["key"]), "feature")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and f"SortMergeJoin [{by}#" not in plan
            assert df.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_boxes_travel_once_to_their_match(spark, monkeypatch):
    rng = random.Random(5)

    def boxes(n, name):
        rows = [(rng.choice([0, 0, 1, None]), rng.choice(["a", "b", None]), f"{name}{i % (n - 3):03d}", *(None if rng.random() < 0.03 else rng.randrange(-1, 12) / 10 for _ in "xywh")) for i in range(n)]
        return spark.createDataFrame(rows, f"frame_id int, feature string, {name}_id string, x double, y double, w double, h double")

    preds, labels = boxes(300, "pred").withColumn("confidence", F.lit(1.0)), boxes(200, "label")
    out = M.iou_match(preds, labels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    few = sorted(map(str, out.collect()))
    assert any("match_id='" in r for r in few) and any("match_id=None" in r for r in few)
    for crowded in (20, 0):  # some keys, all keys
        monkeypatch.setattr(spatial, "CROWDED", crowded)
        assert sorted(map(str, M.iou_match(preds, labels).collect())) == few


def test_keys_meet_whole_unless_large(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 == 0 else f"k{i % 40}", rng.randrange(9), rng.random(), f"p{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "match_id string, confidence int, iou double, pred_id string")
    out = M.match_duplicate_iou(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    want = {}
    for k in {r[0] for r in rows}:
        best = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2], r[3]), reverse=True):
            want[r[3]] = 1.0 if k is None or (best is not None and r[2] <= best) else -1.0 if best is None else best
            best = r[2] if best is None else max(best, r[2])
    assert {r.pred_id: r.match_duplicate_iou for r in out.collect()} == want
    monkeypatch.setattr(scan, "WHOLE", 100)
    assert {r.pred_id: r.match_duplicate_iou for r in M.match_duplicate_iou(df).collect()} == want


def test_curve_numbers_true_positives_where_they_are_sorted(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), f"p{i}", float(rng.randrange(30)), rng.choice([0.3, 0.9]), -1.0) for i in range(1500)] + [("fp", "q", 1.0, 0.1, -1.0), ("tp", "r", 1.0, 0.9, -1.0)]
    ev = spark.createDataFrame(rows, "feature string, pred_id string, confidence double, iou double, match_duplicate_iou double")
    hits, totals = scan.marked_positions(ev, ["feature"], [F.desc("confidence"), F.asc("pred_id")], M.is_tp(0.5))
    want, whole = [], []
    for k in {r[0] for r in rows}:
        nth = 0
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        for rn, r in enumerate(own, 1):
            if r[3] >= 0.5:
                nth += 1
                want.append((k, rn, nth))
        whole.append((k, len(own), nth))
    assert sorted(map(str, map(tuple, hits.collect()))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, totals.collect()))) == sorted(map(str, whole))
    stored = []
    monkeypatch.setattr(scan, "cut_lineage", lambda df: stored.append(df.columns) or cut_lineage(df))
    E.pr_curve(ev, spark.createDataFrame([(k, 900, 0) for k in ("a", "b", None, "fp", "tp")], "feature string, tp long, fn long"), 0.5).collect()
    assert len(stored) == 1 and "pred_id" not in stored[0] and "confidence" not in stored[0]
