"""Similarity search and quality metrics over embedding tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gaugeframe.functions.vectors import cosine_similarity, entropy, least_confidence, margin, max_prob, variance
from gaugeframe.plans.neighbours import adjacent_earlier, knn_join, nearest_beyond, place, unit_vectors
from gaugeframe.plans.scan import ranked
from gaugeframe.session import cut_lineage

# Duplicate and near-duplicate cosine distances, neighbours and certainty of the label vote,
# default cluster count.
DUPLICATE_DISTANCE, NEAR_DUPLICATE_DISTANCE = 1e-5, 0.03
QUALITY_NEIGHBOURS, CERTAINTY_RATIO = 9, 0.6
DEFAULT_CLUSTERS = 10


def similarity_search(df: DataFrame, id_col: str, vector: str, item, limit: int | None = None) -> DataFrame:
    """The items most similar to one item, itself excluded; all of them in order unless ``limit`` is given."""
    target = df.where(F.col(id_col) == F.lit(item)).select(vector).limit(1)
    others = df.where(F.col(id_col) != F.lit(item)).withColumn("_q", target.scalar())
    scored = others.select(id_col, cosine_similarity(F.col(vector), F.col("_q")).alias("similarity")).where("similarity is not null")
    ordered = scored.orderBy(F.desc("similarity"), id_col)
    return ordered if limit is None else ordered.limit(limit)


def semantic_rank(df: DataFrame, id_col: str, vector: str, query: Sequence[float], allowed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Rank (allowed) items by similarity to a supplied text or image vector."""
    q = F.array(*[F.lit(float(v)) for v in query])
    pool = df if allowed is None else df.join(allowed.select(id_col), id_col, "left_semi")
    scored = pool.select(id_col, cosine_similarity(F.col(vector), q).alias("similarity")).where("similarity is not null")
    ordered = scored.orderBy(F.desc("similarity"), id_col)
    return ordered if limit is None else ordered.limit(limit)


def singularity(df: DataFrame, id_col: str, vector: str, block_rows: int = 2048) -> DataFrame:
    """0 for duplicates of an earlier kept item, else the distance to the nearest item that is no duplicate.

    Kept items are decided in id order: an item without an earlier neighbour below the duplicate distance is
    kept, an item next to an earlier kept one is a duplicate, and what remains goes another round.
    """
    units = unit_vectors(df, id_col, vector)
    blocks = place(units, block_rows)
    ids = blocks.rows.select("rid")
    close = cut_lineage(adjacent_earlier(blocks, DUPLICATE_DISTANCE))
    kept = ids.join(close, "rid", "left_anti")
    claimed = None
    undecided = close.select("rid")
    # two rounds unless near duplicates form chains
    while not undecided.isEmpty():
        now = cut_lineage(adjacent_earlier(blocks, DUPLICATE_DISTANCE, undecided, kept))
        claimed = now if claimed is None else claimed.unionByName(now)
        rest = cut_lineage(undecided.join(now, "rid", "left_anti"))
        again = cut_lineage(adjacent_earlier(blocks, DUPLICATE_DISTANCE, rest, rest))
        kept = cut_lineage(kept.unionByName(rest.join(again, "rid", "left_anti")))
        undecided = again.select("rid")
    far = nearest_beyond(blocks, DUPLICATE_DISTANCE)
    rep = blocks.rows.select("g", "u", "rid")
    owned = units.join(rep, ["g", "u"]).select("id", "rid").join(far, "rid", "left")
    if claimed is not None:
        owned = owned.join(claimed, "rid", "left")
    else:
        owned = owned.withColumn("original", F.lit(None).cast(units.schema["id"].dataType))
    original = F.coalesce("original", F.when(F.col("id") != F.col("rid"), F.col("rid")))
    out = owned.withColumn("original", original)
    score = F.when(F.col("original").isNotNull(), F.lit(0.0)).otherwise(F.col("distance"))
    note = (
        F.when(F.col("original").isNotNull(), "Duplicate image")
        .when(F.col("distance") <= F.lit(NEAR_DUPLICATE_DISTANCE), "Near duplicate image").otherwise("")
    )
    return out.select(F.col("id").alias(id_col), score.alias("score"), note.alias("description"), "original")


def label_quality(df: DataFrame, id_col: str, vector: str, label: str, k: int = QUALITY_NEIGHBOURS, group: str | None = None, block_rows: int = 2048) -> DataFrame:
    """Share of the k nearest items (within ``group``, e.g. a question) carrying the same label, and a verdict.

    correct / wrong when one label holds more than int(k * 0.6) neighbours, else unsure.  Rows of groups of at most k
    rows, which have fewer neighbours, get a NULL score and verdict, and so do rows of no group.
    """
    rows = df
    if group is not None:
        big = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > k).select(group)
        rows = df.join(big, group, "left_semi")
    near = knn_join(rows, id_col, vector, k, group, block_rows).select(id_col, "neighbor")
    names = rows.select(id_col, F.col(label).alias("label"))
    votes = near.join(names.select(F.col(id_col).alias("neighbor"), F.col("label").alias("vote")), "neighbor")
    tally = votes.groupBy(id_col, "vote").agg(F.count("*").alias("c"))
    top = tally.groupBy(id_col).agg(
        F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("neg"), F.col("vote"))).alias("t"),
        F.map_from_entries(F.collect_list(F.struct("vote", "c"))).alias("counts"),
    )
    same = F.coalesce(F.element_at("counts", F.col("label")), F.lit(0))
    sure = -F.col("t.neg") > F.floor(F.col("n") * F.lit(CERTAINTY_RATIO))
    verdict = F.when(~sure, "unsure").when(F.col("t.vote") == F.col("label"), "correct").otherwise("wrong")
    scored = top.join(names, id_col).select(id_col, "label", (same / F.col("n")).alias("score"), verdict.alias("verdict"))
    if group is None:
        return scored
    few = df.join(big, group, "left_anti").select(id_col, F.col(label).alias("label"))
    return scored.unionByName(few.withColumns({"score": F.lit(None).cast("double"), "verdict": F.lit(None).cast("string")}))


def diversity_clusters(df: DataFrame, id_col: str, vector: str, k: int | None = None, seed: int = 0) -> DataFrame:
    """K-means cluster of every vector and its distance to the centre; k is the number of classes, else 10."""
    data = df.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k or DEFAULT_CLUSTERS, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    # bounded: k centres
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(data).withColumn("v", vector_to_array("features"))
    gap = F.zip_with("v", F.element_at(centres, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b))
    return placed.select(id_col, "cluster", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v)).alias("distance"))


def diversity_rank(clusters: DataFrame, id_col: str) -> DataFrame:
    """Interleave clusters round-robin, nearest to the centre first: rank 1..n."""
    inner = ranked(clusters, ["cluster"], [F.asc("distance"), F.asc(id_col)], "turn")
    return ranked(inner.select(id_col, "cluster", "turn"), [], [F.asc("turn"), F.asc("cluster")], "rank").select(id_col, "cluster", "rank")


def reduce_2d(df: DataFrame, id_col: str, vector: str, keep: Sequence[str] = ()) -> DataFrame:
    """2-D coordinates per vector by PCA; fewer than four rows give no reduction."""
    data = df.select(id_col, *keep, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if data.limit(4).count() < 4:
        raise ValueError("a 2-D reduction needs at least four embeddings")
    out = PCA(k=2, inputCol="features", outputCol="xy").fit(data).transform(data).withColumn("xy", vector_to_array("xy"))
    return out.select(id_col, *keep, F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def covariance_sketches(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean, scatter): count, mean and centred scatter matrix (flat) of the vectors, one row per key of ``by`` and map task.

    Sketches of disjoint rows merge (:func:`merged_sketch`), so the reduction of any union of keys needs no second look at the vectors.  Vectors that are
    NULL, hold NULL, or differ in length from the first of their task are left out.
    """
    by = list(by)
    c = F.col(vector).cast("array<double>")
    rows = df.where(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull())).select(*by, c.alias("_v"))
    schema = StructType([*rows.select(*by).schema.fields, *StructType.fromDDL("n long, mean array<double>, scatter array<double>").fields])

    def run(batches):
        kept: dict[tuple, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = list(zip(*[batch[c].to_pylist() for c in by])) if by else [()] * batch.num_rows
            offsets, flat = batch["_v"].offsets.to_numpy(), batch["_v"].values.to_numpy(zero_copy_only=False)
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
            for k, members in at.items():
                d = len(kept[k][1]) if k in kept else offsets[members[0] + 1] - offsets[members[0]]
                x = np.array([flat[offsets[i] : offsets[i + 1]] for i in members if offsets[i + 1] - offsets[i] == d])
                mean = x.mean(axis=0)
                found = (len(x), mean, (x - mean).T @ (x - mean))
                kept[k] = merged(kept[k], found) if k in kept else found
        if kept:
            columns = [pa.array([k[i] for k in kept], schema_arrow.field(i).type) for i in range(len(by))]
            n, mean, scatter = zip(*kept.values())
            yield pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array([m.tolist() for m in mean]), pa.array([m.ravel().tolist() for m in scatter])], schema=schema_arrow)

    schema_arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Sketch of the rows of both; sketches of different lengths do not merge, the larger one stays."""
    if len(a[1]) != len(b[1]):
        return max(a, b, key=lambda s: s[0])
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def merged_sketch(sketches: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """One sketch of all rows of a sketch table, merged in a tree of Spark aggregations."""
    def run(rows):
        total = None
        for n, mean, scatter in zip(rows["n"].to_pylist(), rows["mean"].to_pylist(), rows["scatter"].to_pylist()):
            one = (n, np.array(mean), np.array(scatter).reshape(len(mean), -1))
            total = one if total is None else merged(total, one)
        return pa.table({"n": [total[0]], "mean": [total[1].tolist()], "scatter": [total[2].ravel().tolist()]})

    ddl = "n long, mean array<double>, scatter array<double>"
    level = sketches.select("n", "mean", "scatter")
    # a few hundred sketches a group: the first level leaves one row per bucket, the second one row
    for buckets in (64, 1):
        level = level.withColumn("bucket", F.pmod(F.xxhash64("n", "mean"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, ddl)
    rows = level.collect()
    return (rows[0].n, np.array(rows[0].mean), np.array(rows[0].scatter).reshape(len(rows[0].mean), -1)) if rows else None


def reduce_from_sketch(df: DataFrame, id_col: str, vector: str, sketch: tuple[int, np.ndarray, np.ndarray] | None, keep: Sequence[str] = ()) -> DataFrame:
    """2-D principal coordinates (x, y), centred, of the rows of ``df`` by the two leading axes of a sketch; an axis points to its largest entry."""
    if sketch is None or sketch[0] < 4:
        raise ValueError("a 2-D reduction needs at least four embeddings")
    values, axes = np.linalg.eigh(sketch[2] / sketch[0])
    lead = axes[:, np.argsort(-values, kind="stable")[:2]]
    lead = lead * np.sign(lead[np.abs(lead).argmax(axis=0), np.arange(lead.shape[1])])
    # bounded: the dimension of the vectors
    mean = F.array(*[F.lit(float(m)) for m in sketch[1]])

    def along(axis: np.ndarray) -> Column:
        parts = F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), mean, lambda v, m: v - m), F.array(*[F.lit(float(a)) for a in axis]), lambda v, a: v * a)
        return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)

    second = along(lead[:, 1]) if lead.shape[1] > 1 else F.lit(0.0)
    return df.select(id_col, *keep, along(lead[:, 0]).alias("x"), second.alias("y"))


def subset_reduction(df: DataFrame, subset: DataFrame, keys: Sequence[str], id_col: str, vector: str) -> DataFrame:
    """The 2-D reduction of a subset, computed anew from its own vectors."""
    rows = subset_embeddings(df, subset, keys)
    return reduce_from_sketch(rows, id_col, vector, merged_sketch(covariance_sketches(rows, vector)))


def subset_embeddings(df: DataFrame, subset: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(subset.select(*keys), list(keys), "left_semi")


def label_embeddings(vectors: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach vectors to frames, objects, or classification answers by key (never by position)."""
    return labels.join(vectors, list(keys))


def embedding_scores(points: DataFrame, predictions: DataFrame, fns: DataFrame, frame: str, tp: Column) -> DataFrame:
    """2-D points joined with the frame mean of TP flags and zeros for missed labels; missing scores are 0."""
    flags = predictions.select(frame, tp.cast("double").alias("s")).unionByName(fns.select(frame, F.lit(0.0).alias("s")))
    per = flags.groupBy(frame).agg(F.avg("s").alias("score"))
    return points.join(per, frame, "full").withColumn("score", F.coalesce("score", F.lit(0.0)))


ACQUISITION = {"entropy": entropy, "least_confidence": least_confidence, "margin": margin, "variance": variance, "max_prob": max_prob}


def frame_acquisition(frames: DataFrame, predictions: DataFrame, frame: str, probs: str) -> DataFrame:
    """Frame means of every acquisition score over its predicted objects; an empty frame has confidence 0 and no others."""
    per = predictions.groupBy(frame).agg(*[F.avg(fn(F.col(probs))).alias(name) for name, fn in ACQUISITION.items()])
    return frames.select(frame).join(per, frame, "left").withColumn("max_prob", F.coalesce("max_prob", F.lit(0.0)))
