"""KITTI label files: one space-separated row per object, the unit named by the file."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Column order and types of a row; further columns follow, the first of them the confidence.
COLUMNS = (
    ("class_name", "string"), ("truncation", "double"), ("occlusion", "int"), ("alpha", "double"), ("xmin", "double"), ("ymin", "double"),
    ("xmax", "double"), ("ymax", "double"), ("height", "double"), ("width", "double"), ("length", "double"), ("location_x", "double"),
    ("location_y", "double"), ("location_z", "double"), ("rotation_y", "double"),
)
# Fixed value: file names are "<unit title>[__<frame>].txt|csv".
FILE_NAME = r"^(.*?)(?:__(\d+))?\.(?:txt|csv)$"


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """(line, file_name) of every .txt / .csv below the path."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"))
    return lines.where(F.lower("file_name").rlike(r"\.(txt|csv)$"))


def parse_kitti(lines: DataFrame, file_name: str = FILE_NAME) -> DataFrame:
    """Typed columns, confidence, and unit title and frame from the file name; empty lines and other files are dropped.

    ``file_name`` is a pattern whose first group is the unit's title and whose second, if it has one, is the frame.
    """
    keep = [c for c in lines.columns if c not in ("line", "file_name")]
    frame = F.regexp_extract("file_name", file_name, 2) if re.compile(file_name).groups > 1 else F.lit("")
    # a generated row is made once, whatever is asked of its fields; as plain columns, later filters would split the line and match the name again
    read = F.struct(F.split(F.trim("line"), " +").alias("_p"), F.col("file_name").rlike(file_name).alias("_named"), F.regexp_extract("file_name", file_name, 1).alias("data_title"), frame.alias("_frame"))
    # the first part of an empty line is empty
    rows = lines.select(*keep, F.inline(F.array(read))).where(F.col("_named") & (F.get("_p", F.lit(0)) != ""))
    cols = [F.get("_p", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(COLUMNS)]
    return rows.select(
        *keep, *cols, F.get("_p", F.lit(len(COLUMNS))).try_cast("double").alias("confidence"),
        "data_title", F.when(F.col("_frame") != "", F.col("_frame").cast("int")).alias("frame"),
    )


def scan_kitti(lines: DataFrame, units: DataFrame, mapping: DataFrame, file_name: str = FILE_NAME, unit_of: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Box predictions in relative coordinates. ``units`` is (data_title, frame, du_hash, img_width, img_height); a file
    matching no unit or several is skipped. ``mapping`` is (class_name, feature_hash).

    ``unit_of`` turns the file name into (du_hash, frame or NULL) and then finds the unit instead of the title in the name.
    """
    if unit_of is None:
        rows, name = parse_kitti(lines, file_name), "data_title"
    else:
        du, frame = unit_of(F.col("file_name"))
        named = lines.withColumns({"_unit": du, "_unit_frame": frame.cast("int")}).where("_unit is not null")
        rows, name = parse_kitti(named, r"^(.*)$").withColumns({"du_hash": F.col("_unit"), "frame": F.col("_unit_frame")}).drop("_unit", "_unit_frame"), "du_hash"
    unit = F.struct("du_hash", F.col("frame").alias("unit_frame"), "img_width", "img_height")
    titled = units.groupBy(name).agg(F.count("*").alias("_n"), F.min(unit).alias("_u"))
    framed = units.groupBy(name, "frame").agg(F.count("*").alias("_n"), F.min(unit).alias("_u"))
    # a file of a whole unit is one without a frame, so the lines are read once and meet both kinds of units
    found = titled.where("_n = 1").select(F.col(name).alias("_name"), F.lit(None).cast("int").alias("_of"), "_u").unionByName(
        framed.where("_n = 1 and frame is not null").select(F.col(name).alias("_name"), F.col("frame").alias("_of"), "_u"))
    both = rows.join(found, (F.col(name) == F.col("_name")) & F.col("frame").eqNullSafe(F.col("_of"))).join(mapping, "class_name")
    keep = [c for c in lines.columns if c not in ("line", "file_name")]
    w, h = F.col("_u.img_width"), F.col("_u.img_height")
    return both.select(
        *keep, "_u.du_hash", F.col("_u.unit_frame").alias("frame"), "feature_hash", "confidence",
        (F.col("xmin") / w).alias("x"), (F.col("ymin") / h).alias("y"),
        ((F.col("xmax") - F.col("xmin")) / w).alias("w"), ((F.col("ymax") - F.col("ymin")) / h).alias("h"),
    )
