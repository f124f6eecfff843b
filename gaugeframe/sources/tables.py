"""Score files, images and prediction tables as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCORES = "identifier string, score double, description string, object_class string, annotator string, frame int, url string"


def scan_scores(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Long metric scores in (score, identifier) order; NaN scores are missing."""
    reader = spark.read.schema(SCORES)
    rows = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    return rows.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).orderBy("score", "identifier")


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    out = scores.select(*[c.split()[0] for c in SCORES.split(", ")]).write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(uri, image) with decoded BGR pixels; files the image source cannot decode are dropped."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.col("image.origin").alias("uri"), "image")


def write_predictions(path: str, predictions: DataFrame, labels: DataFrame, matches: DataFrame, classes: DataFrame) -> None:
    """The four tables of an imported prediction set."""
    for name, df in (("predictions", predictions), ("labels", labels), ("matches", matches), ("classes", classes)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_predictions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("predictions", "labels", "matches", "classes")}
