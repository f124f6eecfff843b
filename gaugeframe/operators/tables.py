"""Score tables, wide analytics, merging, syncing, subsets and id remapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeframe.functions.scalar import identifier_prefix
from gaugeframe.registry import NORMAL, MetricRegistry

# Metric titles of long score files and the wide column each one fills; None is not stored.
TITLE_TO_COLUMN = {
    "Area": "metric_area",
    "Aspect Ratio": "metric_aspect_ratio",
    "Blue Values": "metric_blue",
    "Blur": None,
    "Brightness": "metric_brightness",
    "Contrast": "metric_contrast",
    "Frame object density": "metric_object_density",
    "Green Values": "metric_green",
    "Image Difficulty": "metric_image_difficulty",
    "Image Diversity": "metric_image_difficulty",
    "Image Singularity": "metric_image_singularity",
    "Object Count": "metric_object_count",
    "Random Values on Images": "metric_random",
    "Red Values": "metric_red",
    "Sharpness": "metric_sharpness",
    "Annotation Duplicates": "metric_label_duplicates",
    "Annotation closeness to image borders": "metric_label_border_closeness",
    "Inconsistent Object Classification and Track IDs": "metric_label_inconsistent_classification_and_track",
    "Missing Objects and Broken Tracks": "metric_label_missing_or_broken_tracks",
    "Object Annotation Quality": "metric_annotation_quality",
    "Object Area - Absolute": "metric_area",
    "Object Area - Relative": "metric_area_relative",
    "Object Aspect Ratio": "metric_aspect_ratio",
    "Polygon Shape Similarity": "metric_label_poly_similarity",
    "Random Values on Objects": "metric_random",
    "Image-level Annotation Quality": "metric_annotation_quality",
    "Shape outlier detection": "metric_label_shape_outlier",
    "Detect Occlusion in Video": None,
}
# Columns stored as shares of 1 whose score files hold per cent, and two further scales.
PERCENT_COLUMNS = ("metric_object_density", "metric_area_relative")
SHARPNESS_SCALE, SHAPE_OUTLIER_SCALE = 8.0 * 255.0, 10000.0


def is_frame_id(identifier: Column) -> Column:
    """Frame-level ids have three parts, label-level ids more."""
    return F.size(F.split(identifier, "_")) == 3


def normalize_scores(scores: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Min-max to [0, 1] per metric; a constant metric divides by 1."""
    ranges = scores.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    # one row per metric; a shuffle by metric would send each metric whole to one task
    out = scores.join(F.broadcast(ranges), list(by))
    return out.withColumn("score", (F.col("score") - F.col("_lo")) / F.when(span == 0, F.lit(1.0)).otherwise(span)).drop("_lo", "_hi")


def assign_metric(column: Column, score: Column, registry: MetricRegistry) -> Column:
    """Stored value of a raw score for the wide column named by ``column``: rescaled, then clamped if normal."""
    normal = [m.name for m in registry.metrics.values() if m.kind == NORMAL]
    scaled = (
        F.when(column.isin(list(PERCENT_COLUMNS)), score / 100)
        .when(column == "metric_sharpness", F.sqrt(score) / F.lit(SHARPNESS_SCALE))
        .when(column == "metric_label_shape_outlier", score / F.lit(SHAPE_OUTLIER_SCALE))
        .otherwise(score)
    )
    return F.when(column.isin(normal), F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))).otherwise(scaled)


def metric_comments(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct non-empty descriptions per item and metric column, joined with ", "."""
    said = scores.where((F.col("description").isNotNull()) & (F.col("description") != ""))
    return said.groupBy(*keys, "column").agg(F.array_join(F.sort_array(F.collect_set("description")), ", ").alias("comment"))


def scores_to_analytics(scores: DataFrame, registry: MetricRegistry, titles: dict[str, str | None] = TITLE_TO_COLUMN) -> DataFrame:
    """Long (identifier, metric title, score) to one wide row per identifier, scaled; unlisted titles are left out.

    The pivot has a fixed column list, so it is one partial + final aggregation.
    """
    known = {t: c for t, c in titles.items() if c in registry.metrics}
    mapping = F.create_map(*[F.lit(x) for t, c in known.items() for x in (t, c)])
    rows = scores.where(F.col("metric").isin(list(known))).withColumn("column", mapping[F.col("metric")])
    rows = rows.withColumn("value", assign_metric(F.col("column"), F.col("score"), registry))
    columns = list(dict.fromkeys(known.values()))
    picks = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    return rows.groupBy("identifier").agg(*picks)


def duplicate_assignments(scores: DataFrame) -> DataFrame:
    """Items scored twice for one metric; a correct import has none."""
    return scores.groupBy("identifier", "metric").agg(F.count("*").alias("n")).where("n > 1")


def copy_frame_metrics(classifications: DataFrame, frames: DataFrame, frame: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Classifications cover the whole frame, so they take its shared metrics where they have none."""
    side = frames.select(*frame, *[F.col(m).alias(f"_{m}") for m in shared])
    out = classifications.join(side, list(frame), "left")
    for m in shared:
        own = F.col(m) if m in classifications.columns else F.lit(None)
        out = out.withColumn(m, F.coalesce(own, F.col(f"_{m}")))
    return out.drop(*[f"_{m}" for m in shared])


def derived_unit_metrics(units: DataFrame, width: str = "width", height: str = "height", objects: Column | None = None) -> DataFrame:
    """Size metrics every frame row implies."""
    w, h = F.col(width), F.col(height)
    count = F.size("objects") if objects is None else objects
    return units.withColumns({
        "metric_width": w.cast("long"), "metric_height": h.cast("long"), "metric_area": (w * h).cast("long"),
        "metric_aspect_ratio": F.when(h != 0, w / h), "metric_object_count": count.cast("long"),
    })


def merge_metrics(scores: DataFrame, titles: Sequence[str], quality: DataFrame | None = None) -> DataFrame:
    """One row per identifier with a column per metric title, frame rows and label rows together."""
    picks = [F.max(F.when(F.col("metric") == t, F.col("score"))).alias(t) for t in titles]
    wide = scores.where(F.col("metric").isin(list(titles))).groupBy("identifier").agg(*picks)
    return wide if quality is None else union_metrics(wide, quality)


def union_metrics(*parts: DataFrame) -> DataFrame:
    """Frame rows, label rows and classification-quality rows under the union of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sync_changes(stored: DataFrame, incoming: DataFrame, key: str, edited: str, data_edited: str) -> DataFrame:
    """Per incoming row: new, labels_changed (edited at another time), data_changed (data more than a second newer)."""
    s = stored.select(key, F.col(edited).alias("_e"), F.col(data_edited).alias("_d"))
    out = incoming.join(s, key, "left")
    newer = F.col(data_edited).cast("double") - F.col("_d").cast("double") > 1
    return out.select(
        *incoming.columns,
        F.col("_e").isNull().alias("is_new"),
        F.coalesce(F.col("_e") != F.col(edited), F.lit(False)).alias("labels_changed"),
        F.coalesce(newer, F.lit(False)).alias("data_changed"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows with the incoming ones replacing or joining them."""
    return stored.join(incoming.select(*key), list(key), "left_anti").unionByName(incoming)


def create_subset(units: DataFrame, selected: DataFrame, project: str, new_project: str, unit: str, row: str, dataset_map: DataFrame | None = None, dataset: str | None = None) -> DataFrame:
    """All units of every label row that owns a selected unit, under a new project id (and remapped dataset ids)."""
    rows = units.join(selected.select(unit), unit, "left_semi").select(row).distinct()
    out = units.join(rows, row, "left_semi").withColumn(project, F.lit(new_project))
    return out if dataset_map is None else remap_ids(out, dataset_map, [dataset])


def restrict_to_subset(table: DataFrame, subset_units: DataFrame, unit: str, project: str, new_project: str) -> DataFrame:
    """Metric, tag or reduction rows of the subset's units, under the new project id."""
    return table.join(subset_units.select(unit), unit, "left_semi").withColumn(project, F.lit(new_project))


def subset_metric_stats(scores: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Per metric over the subset: min, max and number of rows."""
    return scores.join(subset.select(key), key, "left_semi").groupBy("metric").agg(
        F.min("score").alias("min"), F.max("score").alias("max"), F.count("*").alias("num_rows")
    )


def remap_ids(df: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ids through (old, new); ids without an entry stay."""
    for c in columns:
        m = mapping.select(F.col("old").alias(c), F.col("new").alias("_new"))
        out = df.join(m, c, "left")
        df = out.withColumn(c, F.coalesce("_new", c)).select(*df.columns)
    return df


def remap_identifiers(df: DataFrame, mapping: DataFrame, column: str = "identifier") -> DataFrame:
    """Replace the label-row and unit parts of composite identifiers."""
    parts = F.split(F.col(column), "_")
    split = df.withColumns({"_a": parts[0], "_b": parts[1], "_rest": F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))})
    renamed = remap_ids(split, mapping, ["_a", "_b"])
    return renamed.withColumn(column, F.concat_ws("_", "_a", "_b", F.array_join("_rest", "_"))).drop("_a", "_b", "_rest")


def invert(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("new").alias("old"), F.col("old").alias("new"))


def delete_project(tables: dict[str, DataFrame], project: str, predictions: DataFrame, column: str = "project", prediction: str = "prediction") -> dict[str, DataFrame]:
    """Every table without the project's rows; tables keyed by prediction lose those of its predictions."""
    mine = predictions.where(F.col(column) == project).select(prediction)
    out = {}
    for name, t in tables.items():
        out[name] = t.where(F.col(column) != project) if column in t.columns else t.join(mine, prediction, "left_anti")
    return out


def classification_dataset(units: DataFrame, answers: DataFrame, options: DataFrame, keys: Sequence[str], tags: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """(uri, class index) of each frame's first radio answer; unlabelled frames are skipped.

    ``answers`` holds (keys, seq, answer); ``options`` (answer, class_index).
    """
    keys = list(keys)
    first = answers.groupBy(*keys).agg(F.min_by("answer", "seq").alias("answer"))
    pool = units
    if tags is not None:
        pool = pool.join(tags.where(F.col("tag").isin(list(names))).select(*keys), keys, "left_semi")
    return pool.join(first, keys).join(options, "answer").select(*keys, "uri", "class_index")


def object_dataset(units: DataFrame, objects: DataFrame, classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(uri, object columns) of frames and their objects of the chosen classes, one row per object."""
    # one row per class; a shuffle by class would send each class whole to one task
    kept = objects.join(F.broadcast(classes), "feature", "left_semi")
    return units.select(*keys, "uri").join(kept, list(keys))


def image_metrics_table(analytics: DataFrame, keys: Sequence[str], uris: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Wide frame metrics with optional uri and tag list."""
    out = analytics
    if uris is not None:
        out = out.join(uris, list(keys), "left")
    if tags is not None:
        sets = tags.groupBy(*keys).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        out = out.join(sets, list(keys), "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out


def prediction_metrics_table(predictions: DataFrame, feature: str = "feature", match_feature: str = "match_feature") -> DataFrame:
    """Prediction rows with true_positive = predicted class equals matched class."""
    return predictions.withColumn("true_positive", F.coalesce(F.col(feature) == F.col(match_feature), F.lit(False)))


def resize_annotations(df: DataFrame, width: Column, height: Column, to_width: Column, to_height: Column) -> DataFrame:
    """Rescale bbox [x, y, w, h], flat segmentations [x0, y0, x1, ...] and the area to a target image size."""
    sx, sy = to_width / width, to_height / height
    bbox = F.transform("bbox", lambda v, i: v * F.when(i % 2 == 0, sx).otherwise(sy))
    seg = F.transform("segmentation", lambda s: F.transform(s, lambda v, i: v * F.when(i % 2 == 0, sx).otherwise(sy)))
    return df.withColumns({"bbox": bbox, "segmentation": seg, "area": F.col("area") * sx * sy})


def drop_unannotated(images: DataFrame, annotations: DataFrame, image: str, keypoints: str | None = None, min_keypoints: int = 10) -> DataFrame:
    """Images with some box wider and higher than 1 pixel and, with keypoints, at least ten visible ones."""
    good = F.max((F.col("w") > 1) & (F.col("h") > 1))
    per = annotations.groupBy(image).agg(good.alias("ok"), F.sum(keypoints if keypoints else F.lit(min_keypoints)).alias("kp"))
    return images.join(per.where(F.col("ok") & (F.col("kp") >= min_keypoints)).select(image), image, "left_semi")


def drop_flat_boxes(annotations: DataFrame) -> DataFrame:
    """Boxes need positive width and height."""
    return annotations.where("w > 0 and h > 0")


def ontology_equal(ontologies: DataFrame, project: str = "project") -> DataFrame:
    """One row per project: does its class list equal that of the first project (by id)?"""
    lists = ontologies.groupBy(project).agg(F.sort_array(F.collect_set("class")).alias("classes"))
    first = lists.agg(F.min_by("classes", project))
    return lists.select(project, (F.col("classes") == first.scalar()).alias("same"))


def frame_prefix_join(predictions: DataFrame, scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metric columns by full id, falling back to the frame's row for frame-level metrics. ``scores`` is wide by identifier."""
    own = scores.select("identifier", *[F.col(m).alias(f"_o_{m}") for m in metrics])
    frames = scores.where(is_frame_id(F.col("identifier"))).select(F.col("identifier").alias("_frame"), *[F.col(m).alias(f"_f_{m}") for m in metrics])
    out = predictions.withColumn("_frame", identifier_prefix(F.col("identifier"))).join(own, "identifier", "left").join(frames, "_frame", "left")
    out = out.withColumns({m: F.coalesce(f"_o_{m}", f"_f_{m}") for m in metrics})
    return out.drop("_frame", *[f"_{p}_{m}" for p in "of" for m in metrics])
