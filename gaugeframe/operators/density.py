"""Share of a frame covered by the union of its objects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from gaugeframe.functions.boxes import box_points
from gaugeframe.functions.polygon_batches import list_rows, union_areas
from gaugeframe.functions.polygons import covered
from gaugeframe.plans.joins import null_safe_join
from gaugeframe.plans.spatial import BOX, CROWDED, has_area, with_bounds
from gaugeframe.session import cut_lineage


def frame_object_density(frames: DataFrame, objects: DataFrame, keys: Sequence[str], cell: float = 0.125) -> DataFrame:
    """Per cent of each frame under at least one box or polygon (``points``), exact.

    The rows of a frame meet in one task, which sums the area over vertical slabs between neighbouring edges, for many frames at once.
    Frames of more than ``CROWDED`` objects are cut at grid cells before.
    """
    keys = list(keys)
    polygons = "points" in objects.columns
    shaped = with_bounds(objects).select(*keys, *BOX, *(["points"] if polygons else []))
    if polygons:
        # else the filter and its readers would be planned below the bounds with all their terms
        shaped = cut_lineage(shaped)
    shaped = shaped.where(has_area() & F.col("x").isNotNull() & F.col("y").isNotNull())
    crowded = shaped.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED).select(*keys)
    few = null_safe_join(shaped, F.broadcast(crowded), keys, "left_anti")
    many = null_safe_join(shaped, F.broadcast(crowded), keys, "left_semi")
    total = _swept(few, keys).unionByName(_polygon_cells(many, keys, cell) if polygons else _box_cells(many, keys, cell))
    joined = null_safe_join(frames.select(*keys), total, keys, "left")
    return joined.select(*keys, (F.coalesce("area", F.lit(0.0)) * 100).alias("density"))


def _group_begins(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places at which the keys differ from those of the row before."""
    codes = [pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy() for k in keys]
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in codes])])


def _edges(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """x0, y0, x1, y1 and the row of every edge; of a box the lower and the upper one are enough."""
    x, y, w, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in BOX)
    row = np.arange(len(x))
    if "xs" not in batch.schema.names:
        return np.r_[x, x + w], np.r_[y, y + h], np.r_[x + w, x], np.r_[y, y + h], np.r_[row, row]
    drawn = batch.column("xs").is_valid().to_numpy(zero_copy_only=False)
    box = row[~drawn]
    x, y, w, h = x[box], y[box], w[box], h[box]
    begin, size, px = list_rows(batch.column("xs"))
    py = list_rows(batch.column("ys"))[2]
    own = np.repeat(row[drawn], size[drawn])
    at = np.arange(len(own)) - np.repeat(np.cumsum(size[drawn]) - size[drawn], size[drawn])
    here, there = begin[own] + at, begin[own] + (at + 1) % size[own]
    return tuple(np.concatenate(c) for c in (
        (x, x + w, px[here]), (y, y + h, py[here]), (x + w, x, px[there]), (y, y + h, py[there]), (box, box, own)))


def _swept(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area): the rows of a frame lie together, and the frames of a batch are worked on at once."""
    rings = {"xs": F.transform("points", lambda p: p["x"]), "ys": F.transform("points", lambda p: p["y"])} if "points" in shapes.columns else {}
    rows = shapes.select(*keys, *BOX, *[c.alias(n) for n, c in rings.items()]).repartition(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*rows.select(*keys).schema, T.StructField("area", T.DoubleType())])

    def areas(batch: pa.RecordBatch) -> pa.RecordBatch:
        begins = _group_begins(batch, keys)
        group = np.zeros(batch.num_rows, dtype=np.int64)
        group[begins[1:]] = 1
        *ends, row = _edges(batch)
        found = union_areas(*ends, row, np.cumsum(group)[row])
        return batch.select(keys).take(pa.array(begins)).append_column("area", pa.array(found, pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.concat_batches(held)
            last = int(_group_begins(whole, keys)[-1])  # this frame may go on in the next batch
            if last:
                yield areas(whole.slice(0, last))
            held = [whole.slice(last)]
        if held:
            yield areas(held[0])

    return rows.mapInArrow(run, schema)


def _box_cells(objects: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, area) of crowded frames.

    Boxes are clipped to grid cells and de-duplicated there: everything that covers a cell whole becomes one row,
    so a crowded frame is spread over its cells and shrinks to their partly covered rims.  Inside a cell the area
    is summed over vertical slabs between neighbouring box edges.
    """
    size = F.lit(cell)

    def span(lo: str, extent: str):
        return F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(lo) + F.col(extent)) / size))

    boxes = objects.select(*keys, *BOX).distinct()
    split = boxes.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    clipped = (
        split.select(
            *keys, "cx", "cy",
            F.greatest(F.col("x"), F.col("cx") * size).alias("x0"), F.least(F.col("x") + F.col("w"), (F.col("cx") + 1) * size).alias("x1"),
            F.greatest(F.col("y"), F.col("cy") * size).alias("y0"), F.least(F.col("y") + F.col("h"), (F.col("cy") + 1) * size).alias("y1"),
        )
        .where("x1 > x0 and y1 > y0")
        .distinct()
    )
    tile = [*keys, "cx", "cy"]
    full = (F.col("x1") - F.col("x0") >= size) & (F.col("y1") - F.col("y0") >= size)
    covered = clipped.groupBy(*tile).agg(F.max(full).alias("covered"))
    whole = covered.where("covered").groupBy(*keys).agg((F.count("*") * size * size).alias("area"))
    partial = null_safe_join(clipped, covered.where("not covered").select(*tile), tile)
    edges = partial.select(*tile, F.explode(F.array("x0", "x1")).alias("xa")).distinct()
    slabs = edges.withColumn("xb", F.lead("xa").over(W.partitionBy(*tile).orderBy("xa"))).where("xb is not null")
    active = null_safe_join(partial, slabs, tile).where("xa >= x0 and xb <= x1")
    above = W.partitionBy(*tile, "xa").orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(above), F.col("y0")))
    rows = active.withColumn("len", F.greatest(F.col("y1") - reach, F.lit(0.0)))
    rims = rows.groupBy(*keys).agg(F.sum(F.col("len") * (F.col("xb") - F.col("xa"))).alias("area"))
    return whole.unionByName(rims).groupBy(*keys).agg(F.sum("area").alias("area"))


def _polygon_cells(shaped: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """The same over shapes: distinct shapes are cut at grid cells, and each cell's union is one small task group."""
    size = F.lit(cell)
    outline = F.coalesce("points", box_points(*[F.col(c) for c in BOX]))
    shapes = shaped.select(*keys, *BOX, F.transform(outline, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("outline")).distinct()

    def span(lo: str, extent: str):
        return F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(lo) + F.col(extent)) / size))

    split = shapes.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h"))).select(*keys, "cx", "cy", "outline")
    fields = split.select(*keys).schema
    schema = T.StructType([*fields, T.StructField("area", T.DoubleType())])

    def area(rows):
        cx, cy = rows["cx"][0].as_py(), rows["cy"][0].as_py()
        polygons = [[(p["x"], p["y"]) for p in o] for o in rows["outline"].to_pylist()]
        found = covered(polygons, cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell)
        return rows.select(keys).slice(0, 1).append_column("area", pa.array([found], pa.float64()))

    return split.groupBy(*keys, "cx", "cy").applyInArrow(area, schema).groupBy(*keys).agg(F.sum("area").alias("area"))
