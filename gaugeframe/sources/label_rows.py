"""Nested label-row JSON to flat frames, objects and classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BOX = "struct<x:double,y:double,w:double,h:double,theta:double>"
OBJECT = (
    "struct<name:string,value:string,shape:string,objectHash:string,featureHash:string,confidence:double,createdBy:string,"
    f"lastEditedBy:string,manualAnnotation:boolean,boundingBox:{BOX},rotatableBoundingBox:{BOX},polygon:map<string,struct<x:double,y:double>>>"
)
CLASSIFICATION = (
    "struct<name:string,value:string,classificationHash:string,featureHash:string,createdBy:string,confidence:double,manualAnnotation:boolean>"
)
LABELS = f"struct<objects:array<{OBJECT}>,classifications:array<{CLASSIFICATION}>>"
UNIT = (
    "struct<data_hash:string,data_title:string,data_type:string,data_sequence:string,width:int,height:int,data_fps:double,labels:string>"
)
LABEL_ROW = (
    "project_hash string, label_hash string, data_hash string, dataset_hash string, dataset_title string, data_title string, "
    f"data_type string, last_edited_at string, data_units map<string,{UNIT}>, classification_answers string"
)


def read_label_rows(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line; the labels of a unit stay text because images and videos nest them differently.

    Units and answers are keyed by hashes, new ones in every document.  Where lines are parsed as bytes, each new name has the parser's whole table of names
    copied; with the encoding named they are parsed as characters, whose table costs about half.  Text of nested values comes without blanks then, and a
    line with bytes that are no UTF-8 is NULL throughout, wherever they lie.
    """
    return spark.read.schema(LABEL_ROW).option("encoding", "UTF-8").json(path)


def scan_frames(label_rows: DataFrame) -> DataFrame:
    """One row per frame with its object and classification arrays.

    Images and groups number frames by ``data_sequence`` (0 without one); videos key their labels by frame number.
    """
    units = label_rows.select(
        "project_hash", "label_hash", "data_hash", "data_type", "dataset_title", F.explode(F.map_values("data_units")).alias("u")
    )
    base = ["project_hash", "label_hash", "data_hash", "data_type", "dataset_title"]
    flat = units.select(*base, F.col("u.data_hash").alias("du_hash"), "u.data_title", "u.data_sequence", "u.width", "u.height", "u.data_fps", "u.labels")
    cols = [*base, "du_hash", "data_title", "width", "height", "data_fps"]
    # one parse per unit: a still is a map with a single frame
    film = F.from_json("labels", f"map<string,{LABELS}>")
    still = F.create_map(F.coalesce("data_sequence", F.lit("0")), F.from_json("labels", LABELS))
    # other types have no frames; a filter on the type would be planned below what the rows come from and parse every document twice
    by_frame = F.when(F.col("data_type") == "video", film).when(F.col("data_type").isin("image", "img_group"), still)
    frames = flat.select(*cols, F.explode(by_frame).alias("f", "l"))
    return frames.select(*cols, F.col("f").cast("int").alias("frame"), "l.objects", "l.classifications")


FRAME_KEYS = ["project_hash", "label_hash", "du_hash", "frame"]


def scan_objects(frames: DataFrame) -> DataFrame:
    """One row per object; a rotatable box counts as its unrotated box, polygon points are ordered by index."""
    o = frames.select(*FRAME_KEYS, F.posexplode("objects").alias("position", "o"))
    box = F.coalesce("o.boundingBox", "o.rotatableBoundingBox")
    keyed = F.transform(F.map_entries("o.polygon"), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].alias("p")))
    points = F.transform(F.array_sort(keyed), lambda e: e["p"])
    return o.select(
        *FRAME_KEYS, "position", F.col("o.objectHash").alias("object_hash"), F.col("o.featureHash").alias("feature_hash"), "o.name", "o.value",
        "o.shape", "o.confidence", F.coalesce("o.lastEditedBy", "o.createdBy").alias("annotator"), F.col("o.manualAnnotation").alias("manual"),
        box["x"].alias("x"), box["y"].alias("y"), box["w"].alias("w"), box["h"].alias("h"), box["theta"].alias("theta"), points.alias("points"),
    )


def scan_classifications(frames: DataFrame) -> DataFrame:
    c = frames.select(*FRAME_KEYS, F.posexplode("classifications").alias("position", "c"))
    return c.select(*FRAME_KEYS, "position", F.col("c.classificationHash").alias("classification_hash"), F.col("c.featureHash").alias("feature_hash"),
                    "c.name", "c.confidence", "c.createdBy", "c.manualAnnotation")


ANSWERS = "map<string,struct<classifications:array<struct<name:string,featureHash:string,answers:string>>>>"


def scan_answers(label_rows: DataFrame) -> DataFrame:
    """(label_hash, classification_hash, question, feature_hash, answers JSON text) per answered question."""
    rows = label_rows.select("label_hash", F.explode(F.from_json("classification_answers", ANSWERS)).alias("classification_hash", "a"))
    return rows.select("label_hash", "classification_hash", F.explode("a.classifications").alias("q")).select(
        "label_hash", "classification_hash", F.col("q.name").alias("question"), F.col("q.featureHash").alias("feature_hash"), F.col("q.answers").alias("answers"))
