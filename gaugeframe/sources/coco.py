"""COCO ground truth and results.

A run-length segmentation becomes the outline of its regions, one label per region as for several segments.  Where the annotation's box and the
extent of its mask differ in whole pixels, or no region has three corners, the annotation is invalid and dropped.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gaugeframe.functions.boxes import crop_box
from gaugeframe.sources.json_arrays import RANGE_BYTES, read_arrays, spans
from gaugeframe.sources.masks import outline, regions

# ``segmentation`` stays JSON text: it is a flat list, a list of lists or an RLE object
ANNOTATION = (
    "id long, image_id long, category_id int, bbox array<double>, segmentation string, area double, iscrowd int, "
    "attributes struct<rotation:double>"
)
IMAGE = "id long, height int, width int, file_name string"
CATEGORY = "id int, name string, supercategory string"
RESULT = "image_id long, category_id int, score double, bbox array<double>, segmentation string"


def _as_struct(ddl: str) -> str:
    return "struct<" + ",".join(":".join(c.strip().split(" ", 1)) for c in ddl.split(", ")) + ">"


#: Stores that Python workers can open by themselves; files of others are read whole, one task each.
OPENED = ("file", "hdfs", "s3", "gs")


def _in_ranges(spark: SparkSession, path: str) -> bool:
    found = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    return all(f.path.split(":", 1)[0] in OPENED and not f.path.endswith((".gz", ".bz2", ".zst")) for f in found)


def read_coco(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> dict[str, DataFrame]:
    """images, categories and annotations of one or many annotation files; a large file is read by one task per ``range_bytes``."""
    kinds = {"images": IMAGE, "categories": CATEGORY, "annotations": ANNOTATION}
    if _in_ranges(spark, path):
        found = spans(spark, path, 2, range_bytes)
        return {name: read_arrays(spark, found, schema, 2, name) for name, schema in kinds.items()}
    doc = spark.read.schema(", ".join(f"{n} array<{_as_struct(k)}>" for n, k in kinds.items())).option("multiLine", True).json(path)
    return {name: doc.select(F.explode(name).alias("r")).select("r.*") for name in kinds}


def read_coco_results(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Detections of result files, each one array; cut into ranges likewise."""
    if _in_ranges(spark, path):
        return read_arrays(spark, spans(spark, path, 1, range_bytes), RESULT, 1)
    return spark.read.schema(RESULT).option("multiLine", True).json(path)


def segments(segmentation: Column) -> Column:
    """List of flat coordinate lists; null for a missing or run-length segmentation."""
    nested = F.from_json(segmentation, "array<array<double>>")
    flat = F.from_json(segmentation, "array<double>")
    is_nested = segmentation.rlike(r"^\s*\[\s*\[")
    is_flat = segmentation.rlike(r"^\s*\[\s*[-0-9]")
    return F.when(is_nested, nested).when(is_flat, F.array(flat))


def is_rle(segmentation: Column) -> Column:
    return F.coalesce(segmentation.rlike(r"^\s*\{"), F.lit(False))


def run_lengths(counts: str | list[int]) -> list[int]:
    """Run lengths of a COCO mask; text holds five bits a character, from the fourth run on as differences to the run before the last."""
    if not isinstance(counts, str):
        return counts
    runs: list[int] = []
    value = shift = 0
    for ch in counts.encode():
        bits = ch - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            value -= 1 << shift if bits & 16 else 0
            runs.append(value + (runs[-2] if len(runs) > 2 else 0))
            value = shift = 0
    return runs


def decode_rle(segmentation: str) -> np.ndarray | None:
    """Boolean (height, width) array; runs go down the columns. None if the object is malformed."""
    try:
        rle = json.loads(segmentation)
        height, width = map(int, rle["size"])
        runs = np.asarray(run_lengths(rle["counts"]), dtype=np.int64)
    except (ValueError, KeyError, TypeError):
        return None
    if (runs < 0).any() or runs.sum() != height * width:
        return None
    return np.repeat(np.arange(len(runs)) % 2 == 1, runs).reshape(width, height).T


OUTLINE = StructType([StructField("box", ArrayType(LongType())), StructField("parts", ArrayType(ArrayType(DoubleType())))])
_OUTLINE_ARROW = pa.struct([("box", pa.list_(pa.int64())), ("parts", pa.list_(pa.list_(pa.float64())))])


def _outline_of(text: str | None) -> dict | None:
    mask = None if text is None else decode_rle(text)
    if mask is None or not mask.any():
        return None
    columns, rows = np.flatnonzero(mask.any(axis=0)), np.flatnonzero(mask.any(axis=1))
    left, top, right, low = int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1
    crop = mask[top:low, left:right]
    # a filled extent is one region, whatever its size
    labelled = np.ones(crop.shape, dtype=np.int64) if crop.all() else regions(crop, diagonal=True)
    numbers = np.unique(labelled[labelled > 0])
    rings = (outline(labelled == k if len(numbers) > 1 else crop) for k in numbers)
    return {
        "box": [left, top, right - left, low - top],
        "parts": [[float(v) for x, y in ring for v in (x + left, y + top)] for ring in rings if len(ring) >= 3],
    }


@F.arrow_udf(OUTLINE)
def _outlined(segmentation: pa.Array) -> pa.Array:
    """Box and outlines of the masks; a batch without any costs nothing."""
    if segmentation.null_count == len(segmentation):
        return pa.nulls(len(segmentation), _OUTLINE_ARROW)
    return pa.array([_outline_of(t) for t in segmentation.to_pylist()], _OUTLINE_ARROW)


def _outlines(rows: DataFrame) -> DataFrame:
    """``rows`` with the outlined mask in ``_mask``, whose text goes; ``_coded`` tells masks from other segmentations."""
    coded = is_rle(F.col("segmentation"))
    return rows.withColumns({"_coded": coded, "_mask": _outlined(F.when(coded, F.col("segmentation")))}).withColumn(
        "segmentation", F.when(~F.col("_coded"), F.col("segmentation")))


def _segmented(out: DataFrame) -> DataFrame:
    """Rows of :func:`_outlines` once per segment of their polygon or mask (column ``segment``, NULL without); ``bbox`` of a mask without one is its extent."""
    coded = F.col("_coded")
    corner = F.transform("bbox", lambda v: v.cast("long"))
    valid = F.coalesce((F.size("_mask.parts") > 0) & (F.col("bbox").isNull() | (corner == F.col("_mask.box"))), F.lit(False))
    kept = out.where(~coded | valid).withColumns({
        "bbox": F.when(coded, F.coalesce("bbox", F.col("_mask.box").cast("array<double>"))).otherwise(F.col("bbox")),
        "_parts": F.when(coded, F.col("_mask.parts")).otherwise(segments(F.col("segmentation")))})
    return kept.withColumn("segment", F.explode_outer("_parts")).drop("_mask", "_parts", "_coded")


def _points(segment: Column, width: Column, height: Column) -> Column:
    pairs = F.sequence(F.lit(0), (F.size(segment) / 2 - 1).cast("int"))
    return F.transform(pairs, lambda i: F.struct((F.get(segment, i * 2) / width).alias("x"), (F.get(segment, i * 2 + 1) / height).alias("y")))


def scan_coco_annotations(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """One label per polygon segment, or per box without segmentation, in relative coordinates.

    Crowds are dropped; a box is clipped to its image and dropped when it starts outside.
    """
    # masks are outlined where their rows lie, since the join brings all of an image to one task
    drawn = _outlines(annotations.where(F.coalesce("iscrowd", F.lit(0)) != 1))
    parts = _segmented(drawn.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id"))
    polygon = F.col("segment").isNotNull() & (F.size("segment") >= 6)
    box = crop_box(*[F.get("bbox", F.lit(i)) for i in range(4)], F.col("width").cast("double"), F.col("height").cast("double"))
    shaped = parts.withColumns({
        "points": F.when(polygon, _points(F.col("segment"), F.col("width"), F.col("height"))),
        "box": F.when(~polygon & (F.size("bbox") == 4), box),
        "rotation": F.col("attributes.rotation"),
    })
    kept = shaped.where("points is not null or box is not null")
    return kept.select(
        "id", "image_id", "category_id", F.when(F.col("points").isNotNull(), "polygon").otherwise("bounding_box").alias("shape"), "points",
        (F.col("box.x") / F.col("width")).alias("x"), (F.col("box.y") / F.col("height")).alias("y"),
        (F.col("box.w") / F.col("width")).alias("w"), (F.col("box.h") / F.col("height")).alias("h"), "rotation", "area",
    )


def coco_category_shapes(annotations: DataFrame) -> DataFrame:
    """Shapes each category needs: polygon, and a plain or rotatable box."""
    seg = F.coalesce(F.size(segments(F.col("segmentation"))) > 0, F.lit(False)) | is_rle(F.col("segmentation"))
    has_box = F.coalesce(F.size("bbox") == 4, F.lit(False))
    turned = F.coalesce(F.col("attributes.rotation") != 0, F.lit(False))
    flags = annotations.where(F.coalesce("iscrowd", F.lit(0)) != 1).groupBy("category_id").agg(
        F.bool_or(seg).alias("polygon"), F.bool_or(has_box).alias("_box"), F.bool_or(turned).alias("_turned"))
    return flags.select("category_id", "polygon", (F.col("_box") & ~F.col("_turned")).alias("bounding_box"), (F.col("_box") & F.col("_turned")).alias("rotatable_bounding_box"))


def scan_coco_results(results: DataFrame, images: DataFrame, mapping: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Predictions with the feature hash of (category, shape); unmapped categories and unknown images are dropped.

    ``mapping`` is (category_id, shape, feature_hash); ``units`` restricts images and adds its own columns by image_id.
    """
    parts = _segmented(_outlines(results).join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id"))
    polygon = F.col("segment").isNotNull() & (F.size("segment") >= 6)
    rows = parts.withColumns({
        "shape": F.when(polygon, "polygon").otherwise("bounding_box"),
        "points": F.when(polygon, _points(F.col("segment"), F.col("width"), F.col("height"))),
    }).join(mapping, ["category_id", "shape"])
    if units is not None:
        rows = rows.join(units, "image_id")
    side = [c for c in (units.columns if units is not None else []) if c != "image_id"]
    return rows.select(
        "image_id", *side, "feature_hash", "shape", F.col("score").alias("confidence"), "points",
        *[F.when(~(F.col("shape") == "polygon"), F.get("bbox", F.lit(i)) / F.col(s)).alias(n) for i, (n, s) in enumerate((("x", "width"), ("y", "height"), ("w", "width"), ("h", "height")))],
    )
