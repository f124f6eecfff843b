"""Metrics over ordered frames of a sequence and over tracks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeframe.functions.polygons import simple_polygon_check
from gaugeframe.plans.joins import null_safe_join
from gaugeframe.plans.scan import ranked
from gaugeframe.plans.spatial import DEFAULT_CELL, best_before, best_overlap, geometry, has_area, with_bounds
from gaugeframe.session import cut_lineage, stored

# IoU limits of the track metrics and distance limits of the occlusion levels.
TRACK_IOU, MISSING_IOU = 0.8, 0.5
OCCLUSION_LOW, OCCLUSION_MEDIUM, OCCLUSION_HIGH, OCCLUSION_MIN_SAMPLES = 0.3, 0.4, 0.7, 5
NO_OCCLUSION_SCORE = 100.0


def frame_positions(frames: DataFrame, seq: str = "seq_id", frame: str = "frame") -> DataFrame:
    """Dense 1-based position of every distinct frame inside its sequence."""
    return ranked(frames.select(seq, frame).distinct(), [seq], [F.asc(frame)], "pos")


def _valid(shape: Sequence[str]) -> Column:
    """A box or polygon with area; polygons must not cross themselves.  Never NULL, so no object is lost."""
    if "points" not in shape:
        return has_area()
    return has_area() & (F.col("points").isNull() | simple_polygon_check(F.coalesce("points", F.array().cast("array<struct<x:double,y:double>>"))))


def track_consistency(objects: DataFrame, frames: DataFrame | None = None, seq: str = "seq_id", frame: str = "frame", id_col: str = "obj_id", track: str = "track_id", cls: str = "feature", cell: float = DEFAULT_CELL) -> DataFrame:
    """Best-overlapping object of the previous frame decides: same track or weak overlap is 1, a strong overlap with
    another track or class is 1 - IoU. Degenerate boxes score 0; the first frame of a sequence scores nothing else.

    ``frames`` lists all frames when some hold no objects.
    """
    pos = frame_positions(objects if frames is None else frames, seq, frame)
    shaped = with_bounds(objects)
    shape = geometry(shaped)
    # stored with the verdict: the overlap join reads these rows several times, and filters would be planned below the bounds with all their terms
    placed = stored(null_safe_join(shaped, pos, [seq, frame]).select(seq, frame, "pos", id_col, track, cls, *shape, _valid(shape).alias("_ok")))
    hit = best_before(placed.where("_ok").drop("_ok"), seq, "pos", id_col, cell, carry=[track, cls], least=TRACK_IOU)
    suspicious = (F.col("iou") > F.lit(TRACK_IOU)) & (F.col(f"best_{track}") != F.col(track))
    note = F.when(~suspicious, "").when(F.col(f"best_{cls}") != F.col(cls), "overlaps with another class").otherwise("different track ids")
    scored = hit.select(
        seq, frame, id_col, F.when(F.coalesce(suspicious, F.lit(False)), 1 - F.col("iou")).otherwise(F.lit(1.0)).alias("score"),
        F.coalesce(note, F.lit("")).alias("description"),
    )
    invalid = placed.where("not _ok").select(seq, frame, id_col, F.lit(0.0).alias("score"), F.lit("Invalid polygon").alias("description"))
    return scored.unionByName(invalid)


def missing_or_broken_tracks(objects: DataFrame, seq: str = "seq_id", frame: str = "frame", id_col: str = "obj_id", track: str = "track_id", cls: str = "feature", cell: float = DEFAULT_CELL) -> DataFrame:
    """Lowest score per object over three consecutive non-empty frames.

    A same-class object two frames back (IoU >= 0.25) without one in between (IoU > 0.5) is marked 0 as missing on
    the next frame; with one in between, three equal track ids score 1 and any break 0.5; no object two back is 1.
    """
    shaped = with_bounds(objects)
    shape = geometry(shaped)
    # stored with the verdict, else filters would be planned below the bounds with all their terms
    all_objects = stored(shaped.select(seq, frame, id_col, track, cls, *shape, _valid(shape).alias("_ok")))
    valid = all_objects.where("_ok").drop("_ok")
    # both overlap joins read these rows several times
    placed = stored(null_safe_join(valid, frame_positions(valid, seq, frame), [seq, frame]))
    keys = [seq, cls, "_ref"]

    def at(df: DataFrame, back: int, name: str) -> DataFrame:
        found = best_overlap(
            df.withColumn("_ref", F.col("pos") - back),
            placed.select(seq, cls, F.col("pos").alias("_ref"), id_col, track, *shape), keys, id_col, cell, carry=[track], least=MISSING_IOU / 2,
        )
        renames = {"iou": f"{name}_iou", f"best_{id_col}": f"{name}_id", f"best_{track}": f"{name}_track"}
        return found.drop("_ref").withColumnsRenamed(renames)

    seen = at(cut_lineage(at(placed.where("pos > 2"), 2, "old")), 1, "mid")
    similar = (F.col("old_iou") > 0) & (F.col("old_iou") >= F.lit(MISSING_IOU / 2))
    bridged = F.col("mid_iou") > F.lit(MISSING_IOU)
    whole = (F.col("old_track") == F.col(track)) & (F.col("mid_track") == F.col(track))
    own = seen.select(
        F.when(similar & ~bridged, F.col("old_id")).otherwise(F.col(id_col)).alias(id_col),
        F.when(~similar, 1.0).when(~bridged, 0.0).when(whole, 1.0).otherwise(0.5).alias("score"),
    )
    invalid = all_objects.where("not _ok").select(id_col, F.lit(0.0).alias("score"))
    return own.unionByName(invalid).groupBy(id_col).agg(F.min("score").alias("score"))


def shape_similarity(vectors: DataFrame, keys: Sequence[str], order: Sequence[Column], vector: str, dims: int, decay: float = 0.5) -> DataFrame:
    """Cosine between each vector of a track and the decaying average of the ones before; the first scores 1.

    The average is a geometric series and cosine ignores scale, so it is a running sum of vectors weighted by
    growing powers.  Tracks are cut into chunks of positions, each preceded by the tail of the chunk before whose
    older terms are below double precision; a track of any length is thus spread over tasks.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie strictly between 0 and 1")
    halo = math.ceil(64 * math.log(2) / -math.log(decay))
    # weights stay below 2^480 so that their squares are finite
    chunk = max(1, min(4096, int(480 * math.log(2) / -math.log(decay)) - halo))
    pos = ranked(vectors, keys, order, "_pos").withColumn("_p", F.col("_pos") - 1)
    inside = (F.col("_p") % chunk).cast("int")
    home = F.floor(F.col("_p") / chunk)
    placed = pos.withColumn(
        "_s",
        F.explode(
            F.when(
                inside >= max(chunk - halo, 0),
                F.array(
                    F.struct(home.alias("c"), (inside + halo).alias("e"), F.lit(True).alias("own")),
                    F.struct((home + 1).alias("c"), (inside + halo - chunk).alias("e"), F.lit(False).alias("own")),
                ),
            ).otherwise(F.array(F.struct(home.alias("c"), (inside + halo).alias("e"), F.lit(True).alias("own"))))
        ),
    ).select("*", "_s.*")
    # the first vector seeds the average and so weighs as if the series before it were constant
    first = F.when(F.col("_p") == 0, F.lit(1.0 / (1.0 - decay))).otherwise(F.lit(1.0))
    weight = F.pow(F.lit(1.0 / decay), F.col("e")) * first
    before = W.partitionBy(*keys, "c").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.sum(F.col(vector)[i].cast("double") * weight).over(before).alias(f"_m{i}") for i in range(dims)]
    rows = placed.select("*", *sums).where("own")
    v = [F.col(vector)[i].cast("double") for i in range(dims)]
    m = [F.col(f"_m{i}") for i in range(dims)]

    def dot(a, b):
        terms = [x * y for x, y in zip(a, b)]
        return sum(terms[1:], terms[0])

    cosine = F.try_divide(dot(m, v), F.sqrt(dot(m, m)) * F.sqrt(dot(v, v)))
    score = F.when(F.col("_p") == 0, F.lit(1.0)).otherwise(cosine)
    helpers = ["_pos", "_p", "_s", "c", "e", "own", *[f"_m{i}" for i in range(dims)]]
    return rows.withColumn("score", score).drop(*helpers)


def occlusion(boxes: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Per track with at least five boxes: distance of the scaled (area, aspect ratio) to the track mean.

    Far and small boxes count as occluded and score 1 / distance, others 100.
    """
    shaped = boxes.where("h <> 0").select(*keys, id_col, (F.col("h") * F.col("w")).alias("_a"), (F.col("w") / F.col("h")).alias("_r"))
    track = shaped.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        *[f(c).alias(f"{c}_{n}") for c in ("_a", "_r") for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))],
    ).where(F.col("_n") >= OCCLUSION_MIN_SAMPLES)

    def scaled(c: str, value: Column) -> Column:
        span = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        return (value - F.col(f"{c}_lo")) / F.when(span == 0, 1.0).otherwise(span)

    j = shaped.join(track, list(keys))
    da = scaled("_a", F.col("_a")) - scaled("_a", F.col("_a_mean"))
    dr = scaled("_r", F.col("_r")) - scaled("_r", F.col("_r_mean"))
    j = j.withColumns({"_d": F.sqrt(da * da + dr * dr), "_small": da < 0})
    hidden = (F.col("_d") > F.lit(OCCLUSION_LOW)) & F.col("_small")
    # The texts of the levels.
    level = (
        F.when(~hidden, "There is no occlusion")
        .when(F.col("_d") > F.lit(OCCLUSION_HIGH), "There is a high probability of occlusion")
        .when(F.col("_d") > F.lit(OCCLUSION_MEDIUM), "There is a moderate probability of occlusion")
        .otherwise("There is a low probability of occlusion")
    )
    return j.select(*keys, id_col, F.when(hidden, 1 / F.col("_d")).otherwise(F.lit(NO_OCCLUSION_SCORE)).alias("score"), level.alias("description"))


def shape_outlier(vectors: DataFrame, id_col: str, cls: str, vector: str, dims: int) -> DataFrame:
    """1 / distance of the standardised vector to its class centroid; zero distances take the smallest other one."""
    v = [F.col(vector)[i].cast("double") for i in range(dims)]
    flat = vectors.select(id_col, cls, *[c.alias(f"v{i}") for i, c in enumerate(v)])
    stats = flat.agg(F.struct(*[F.stddev_pop(f"v{i}").alias(f"s{i}") for i in range(dims)]).alias("s"))
    # the overall mean cancels in a distance between standardised points
    centre = flat.groupBy(cls).agg(*[F.avg(f"v{i}").alias(f"c{i}") for i in range(dims)])
    j = flat.join(centre, cls).withColumn("_s", stats.scalar())
    # a component that never varies adds nothing
    parts = [F.coalesce(F.try_divide(F.col(f"v{i}") - F.col(f"c{i}"), F.col("_s")[f"s{i}"]), F.lit(0.0)) for i in range(dims)]
    squares = [p * p for p in parts]
    dist = j.select(id_col, cls, F.sqrt(sum(squares[1:], squares[0])).alias("_d"))
    floor = dist.where("_d > 0").agg(F.min("_d"))
    return dist.select(id_col, cls, (1 / F.when(F.col("_d") == 0, floor.scalar()).otherwise(F.col("_d"))).alias("score"))


def track_ids(objects: DataFrame, object_hash: str, annotation_key: Sequence[str]) -> DataFrame:
    """Dense integer per object hash (ordered by hash) and a sequential annotation id, both from 0."""
    tracks = ranked(objects.select(object_hash).distinct(), [], [F.asc(object_hash)], "track_id")
    numbered = ranked(objects, [], [F.asc(k) for k in annotation_key], "annotation_id")
    out = numbered.join(tracks, object_hash)
    return out.withColumns({"track_id": F.col("track_id") - 1, "annotation_id": F.col("annotation_id") - 1})
