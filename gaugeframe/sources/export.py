"""COCO export, one document per partition, and nested metrics."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeframe.functions.boxes import polygon_area, polygon_bounds
from gaugeframe.plans.scan import ranked
from gaugeframe.session import cut_lineage
from gaugeframe.sources.coco import OPENED
from gaugeframe.sources.json_arrays import open_file

# Fixed value: rows of this partition are not exported.
UNASSIGNED = "Unassigned"
# Shapes given by points, and the fewest points each needs.
LEAST_POINTS = {"polygon": 3, "polyline": 2, "point": 1, "skeleton": 1}


def _drawn(objects: DataFrame) -> DataFrame:
    """Objects with enough geometry to be drawn, and all of ``shape``, ``theta`` and ``points``."""
    missing = {"points": "array<struct<x:double,y:double>>", "theta": "double"}
    out = objects.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in objects.columns})
    if "shape" not in objects.columns:
        out = out.withColumn("shape", F.when(F.col("points").isNotNull(), "polygon").otherwise("bounding_box"))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    enough = F.coalesce(*[F.when(F.col("shape") == s, F.coalesce(F.size("points"), F.lit(0)) >= n) for s, n in LEAST_POINTS.items()], placed)
    return out.where(enough)


def _measures(objects: DataFrame) -> DataFrame:
    """``_bbox``, ``_area``, ``_segmentation``, ``_keypoints`` and ``_rotation`` in pixels.

    A polyline is drawn forth and back, so its polygon has no area; points and skeletons are key points, all visible.
    """
    of = {s: F.col("shape") == s for s in (*LEAST_POINTS, "rotatable_bounding_box")}
    pointed = F.col("shape").isin(*LEAST_POINTS)
    scaled = F.transform("points", lambda p: F.struct((p["x"] * F.col("width")).alias("x"), (p["y"] * F.col("height")).alias("y")))
    px = objects.withColumn("_px", F.when(of["point"], F.slice(scaled, 1, 1)).when(pointed, scaled))
    at = F.col("_px")
    b = polygon_bounds(at)
    x, y, w, h = F.col("x") * F.col("width"), F.col("y") * F.col("height"), F.col("w") * F.col("width"), F.col("h") * F.col("height")
    right, low = (F.col("x") + F.col("w")) * F.col("width"), (F.col("y") + F.col("h")) * F.col("height")

    def flat(points: Column) -> Column:
        return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))

    ring = flat(at)
    drawn = (
        F.when(of["polyline"], F.array(F.concat(ring, flat(F.reverse(at)))))
        .when(of["skeleton"], F.array().cast("array<array<double>>"))
        .when(pointed, F.array(ring))
        .otherwise(F.array(F.array(x, y, right, y, right, low, x, low))))
    return px.withColumns({
        "_bbox": F.when(pointed, F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])).otherwise(F.array(x, y, w, h)),
        "_area": F.when(of["polygon"], polygon_area(at)).when(pointed, 0.0).otherwise(w * h),
        "_segmentation": drawn,
        "_keypoints": F.when(of["point"] | of["skeleton"], F.flatten(F.transform(at, lambda p: F.array(p["x"], p["y"], F.lit(2.0))))),
        "_rotation": F.when(of["rotatable_bounding_box"], F.col("theta")),
    })


def coco_tables(frames: DataFrame, objects: DataFrame, categories: DataFrame, frame_metrics: Sequence[str] = (), object_metrics: Sequence[str] = (), within: str | None = None) -> dict[str, DataFrame]:
    """categories, images and annotations as rows of (id, json).

    ``within`` names a column of frames and objects that tells documents apart: image, annotation and track ids then run inside each of them, and
    images and annotations keep the column.

    ``frames``: frame_id, file_name, width, height, metrics; ``objects``: frame_id, obj_id, track, feature, x, y, w, h
    (relative), optional shape, points and theta, metrics; ``categories``: feature, name, supercategory.  Categories count from 1 in
    feature order, images and annotations from 1 in key order; track ids from 0.  Without ``shape`` an object with points is a polygon and
    any other a box; objects with too few points or an incomplete box are left out.
    """
    objects = _drawn(objects)
    doc = [] if within is None else [within]
    cats = cut_lineage(ranked(categories, [], [F.asc("feature")], "id"))
    imgs = cut_lineage(ranked(frames, doc, [F.asc("frame_id")], "id"))
    anns = ranked(objects, doc, [F.asc("frame_id"), F.asc("obj_id")], "id")
    tracks = ranked(objects.select(*doc, "track").distinct(), doc, [F.asc("track")], "track_no")
    sized = anns.join(imgs.select(*doc, "frame_id", F.col("id").alias("image_id"), "width", "height"), [*doc, "frame_id"])
    named = _measures(sized.join(cats.select("feature", F.col("id").alias("category_id")), "feature").join(tracks, [*doc, "track"]))
    metrics = [F.struct(*object_metrics).alias("metrics")] if object_metrics else []
    ann_json = F.to_json(F.struct(
        "id", "image_id", "category_id", F.col("_bbox").alias("bbox"), F.col("_area").alias("area"),
        F.col("_segmentation").alias("segmentation"), F.lit(0).alias("iscrowd"), F.col("_keypoints").alias("keypoints"),
        F.when(F.col("_keypoints").isNotNull(), (F.size("_keypoints") / 3).cast("int")).alias("num_keypoints"),
        F.struct((F.col("track_no") - 1).alias("track_id"), F.col("_rotation").alias("rotation"), *metrics).alias("attributes"),
    ))
    img_metrics = [F.struct(*frame_metrics).alias("metrics")] if frame_metrics else []
    img_json = F.to_json(F.struct("id", "file_name", "width", "height", *img_metrics))
    cat_json = F.to_json(F.struct("id", "name", "supercategory"))
    return {
        "categories": cats.select("id", cat_json.alias("json")),
        "images": imgs.select(*doc, "id", img_json.alias("json")),
        "annotations": named.select(*doc, "id", ann_json.alias("json")),
    }


def coco_lines(tables: dict[str, DataFrame], info: str = "{}", within: DataFrame | None = None) -> DataFrame:
    """Ordered text lines whose concatenation is one COCO document; the element with id 1 carries no comma.

    ``within`` lists the documents where the tables hold several; its columns stay.
    """
    spark = tables["images"].sparkSession
    parts = ["categories", "images", "annotations"]
    opening = [f'{{"info":{info},"categories":[', '],"images":[', '],"annotations":[']
    marks = [(i, 0, text) for i, text in enumerate(opening)] + [(len(parts), 0, "]}")]
    lines = spark.createDataFrame(marks, "section int, id long, line string")
    doc = [] if within is None else within.columns
    lines = lines if within is None else lines.join(F.broadcast(within))  # four marks for each
    for i, p in enumerate(parts):
        comma = F.when(F.col("id") == 1, F.col("json")).otherwise(F.concat(F.lit(","), F.col("json")))
        lines = lines.unionByName(tables[p].select(F.lit(i).alias("section"), F.col("id").cast("long"), comma.alias("line"), *doc))
    return lines


def write_coco(tables: dict[str, DataFrame], path: str, compression: str | None = None) -> None:
    """Part files that, concatenated in name order, are the document; range-partitioned, so nothing passes the driver.

    That holds for gzip too, whose parts may follow one another.
    """
    coco_lines(tables).orderBy("section", "id").select("line").write.mode("overwrite").text(path, compression=compression or "none")


#: Bytes of text that are in memory at a time where files are joined.
BLOCK = 1 << 20


def _blocks(path: str) -> Iterator[str]:
    """Whole lines of a compressed file, many at a time, without the last line feed."""
    rest = b""
    with open_file(path) as f, gzip.open(f) as lines:
        while more := lines.read(BLOCK):
            block, feed, rest = (rest + more).rpartition(b"\n")
            if feed:
                yield block.decode()
    if rest:
        yield rest.decode()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in (p for row in batch["pieces"].to_pylist() for p in row):
            for block in _blocks(piece["path"]) if piece["path"] else [piece["text"]]:
                yield pa.record_batch([pa.array([block])], names=["value"])


def write_joined(spark: SparkSession, path: str, parts: Sequence[str | DataFrame]) -> None:
    """``parts``, lines of text and frames of one text column, as one file in their order.

    Tasks write the frames as compressed files, one task unpacks these into the file block by block, and they are removed: no line is sorted or shuffled.
    Where Python workers cannot open the files, the task sorts the lines.
    """
    own = f"{path}-{uuid.uuid4().hex}"
    pieces: list[tuple[str | None, str | None]] = []
    for n, part in enumerate(parts):
        if isinstance(part, str):
            pieces.append((part, None))
        else:
            part.write.text(f"{own}/{n}", compression="gzip")
            files = spark.read.format("binaryFile").load(f"{own}/{n}").select("path").orderBy("path").collect()
            pieces += [(None, f.path) for f in files]
    if all(at is None or at.split(":", 1)[0] in OPENED for _, at in pieces):
        joined = spark.createDataFrame([(pieces,)], "pieces array<struct<text:string,path:string>>").coalesce(1).mapInArrow(_unpacked, "value string")
    else:
        lines = [spark.createDataFrame([(p,)], "value string") if isinstance(p, str) else spark.read.text(f"{own}/{n}") for n, p in enumerate(parts)]
        joined = reduce(DataFrame.unionByName, [x.withColumn("at", F.lit(n)) for n, x in enumerate(lines)]).repartition(1).sortWithinPartitions("at").select("value")
    joined.write.text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def export_partitions(frames: DataFrame, objects: DataFrame, categories: DataFrame, partitions: DataFrame, names: Sequence[str], path: str) -> None:
    """One COCO document per named partition (frame_id, partition), in one job for any number of names; unassigned frames are left out.

    Each document is the part files of a folder ``partition=<name>``, which concatenated in name order are the document.
    """
    wanted = [n for n in names if n != UNASSIGNED]
    assigned = cut_lineage(partitions.where(F.col("partition").isin(wanted)).select("frame_id", "partition"))
    tables = coco_tables(frames.join(assigned, "frame_id"), objects.join(assigned, "frame_id"), categories, within="partition")
    documents = frames.sparkSession.createDataFrame([(n,) for n in wanted], "partition string")
    tables["categories"] = tables["categories"].join(F.broadcast(documents))  # one row per name given
    lines = coco_lines(tables, within=documents)
    lines.orderBy("partition", "section", "id").select("line", "partition").write.mode("overwrite").partitionBy("partition").text(path)


def nest_metrics(frames: DataFrame, objects: DataFrame, keys: Sequence[str], frame_metrics: Sequence[str], object_metrics: Sequence[str], id_col: str, chunk: int = 10_000) -> DataFrame:
    """(keys, part, frame_level STRUCT, objects MAP<id, STRUCT>): flat metrics nested per frame.

    A frame with more than ``chunk`` objects spreads its map over several parts, so no row is unbounded.
    """
    keys = list(keys)
    sizes = objects.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("_parts"))
    placed = objects.join(sizes, keys).withColumn("part", F.expr(f"cast(pmod(xxhash64({id_col}), _parts) as int)"))
    entry = F.struct(F.col(id_col).alias("key"), F.struct(*object_metrics).alias("value"))
    nested = placed.groupBy(*keys, "part").agg(F.map_from_entries(F.collect_list(entry)).alias("objects"))
    level = frames.select(*keys, F.struct(*frame_metrics).alias("frame_level"))
    return level.join(nested, keys, "left").withColumn("part", F.coalesce("part", F.lit(0)))
