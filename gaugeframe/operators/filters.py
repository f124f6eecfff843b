"""Row filters over a domain: metric ranges, enums, tags, 2-D boxes, NULL-keeping filters, class and stage filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeframe.registry import MetricRegistry, UnknownMetricError


@dataclass
class Domain:
    """Tables of one domain (data, annotation or prediction) with their join keys."""

    name: str
    analytics: DataFrame
    keys: tuple[str, ...]
    registry: MetricRegistry
    tags: DataFrame | None = None
    reductions: DataFrame | None = None

    def join(self, left: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
        return left.join(other, list(self.keys), how)


@dataclass
class Filters:
    """Metric ranges, enum values, tags and one 2-D box; empty parts do nothing."""

    metrics: dict[str, tuple[float, float]] = field(default_factory=dict)
    enums: dict[str, Sequence[str]] = field(default_factory=dict)
    tags: Sequence[str] = ()
    box: tuple[str, float, float, float, float] | None = None  # reduction, x0, y0, x1, y1


def filter_metric_range(df: DataFrame, ranges: dict[str, tuple[float, float]], registry: MetricRegistry | None = None) -> DataFrame:
    """Inclusive range per metric, equality when both ends are equal; pushed down to the scan."""
    for name, (lo, hi) in ranges.items():
        if name not in df.columns or (registry is not None and name not in registry.metrics):
            raise UnknownMetricError(name)
        df = df.where(F.col(name) == F.lit(lo) if lo == hi else F.col(name).between(F.lit(lo), F.lit(hi)))
    return df


def filter_enum(df: DataFrame, values: dict[str, Sequence[str]], registry: MetricRegistry | None = None) -> DataFrame:
    for name, allowed in values.items():
        if name not in df.columns or (registry is not None and name not in registry.enums):
            raise UnknownMetricError(name)
        df = df.where(F.col(name).isin(list(allowed)))
    return df


def filter_tags(df: DataFrame, tags: DataFrame, names: Sequence[str], keys: Sequence[str], column: str = "tag") -> DataFrame:
    """Items with at least one listed tag; a semi join, so several tags do not repeat a row."""
    return df.join(tags.where(F.col(column).isin(list(names))).select(*keys), list(keys), "left_semi")


def filter_embedding_box(df: DataFrame, points: DataFrame, keys: Sequence[str], x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    inside = points.where(F.col("x").between(F.lit(x0), F.lit(x1)) & F.col("y").between(F.lit(y0), F.lit(y1)))
    return df.join(inside.select(*keys), list(keys), "left_semi")


def filter_project(df: DataFrame, ids: Sequence, column: str = "project") -> DataFrame:
    return df.where(F.col(column).isin(list(ids)))


def _own_filters(domain: Domain, df: DataFrame, f: Filters) -> DataFrame:
    df = filter_metric_range(df, f.metrics, domain.registry)
    df = filter_enum(df, f.enums, domain.registry)
    if f.tags:
        df = filter_tags(df, domain.tags, f.tags, domain.keys)
    if f.box:
        name, *corners = f.box
        df = filter_embedding_box(df, domain.reductions.where(F.col("reduction") == name), domain.keys, *corners)
    return df


def apply_search(
    base: Domain, data: Domain, annotation: Domain | None = None, data_filters: Filters | None = None,
    annotation_filters: Filters | None = None,
) -> DataFrame:
    """Rows of ``base`` passing its own filters and, by semi join on the frame, those of the data domain."""
    if annotation_filters is not None and base.name == "data":
        raise ValueError("annotation filters cannot be applied to the data domain")
    if base.name == "data":
        return _own_filters(base, base.analytics, data_filters or Filters())
    out = base.analytics
    if annotation_filters is not None:
        out = _own_filters(base if annotation is None else annotation, out, annotation_filters)
    if data_filters is not None:
        frames = _own_filters(data, data.analytics, data_filters).select(*data.keys)
        out = out.join(frames, list(data.keys), "left_semi")
    return out


LOOSE = 1024


def _known(frame: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in frame])


def _in_frame(flag: Column, frame: Sequence[str]) -> Column:
    """Whether any row of the frame has the flag; rows of no frame never do.

    A window reads its input once, so a chain of filters scans its table once; the rows of one frame meet in one task and spill there.  Rows of no
    frame, however many, are dealt over ``LOOSE`` windows of their own.
    """
    dealt = F.when(~_known(frame), F.pmod(F.monotonically_increasing_id(), F.lit(LOOSE)))
    return _known(frame) & F.coalesce(F.max(F.coalesce(flag, F.lit(False))).over(W.partitionBy(*frame, dealt)), F.lit(False))


def _keep_na(df: DataFrame, column: str, hit: Column, frame: Sequence[str]) -> DataFrame:
    """Rows that hit, plus rows lacking the column whose frame has a hit. NULL is tested, not NaN."""
    flagged = df.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_frame_hit": _in_frame(hit, frame)})
    return flagged.where(F.col("_hit") | (F.col(column).isNull() & F.col("_frame_hit"))).drop("_hit", "_frame_hit")


def filter_categorical_keep_na(df: DataFrame, column: str, values: Sequence, frame: Sequence[str]) -> DataFrame:
    return _keep_na(df, column, F.col(column).isin(list(values)), frame)


def filter_range_keep_na(df: DataFrame, column: str, lo, hi, frame: Sequence[str]) -> DataFrame:
    """Numeric or timestamp range with the same NULL rule."""
    return _keep_na(df, column, F.col(column).between(F.lit(lo), F.lit(hi)), frame)


def filter_text(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).cast("string").rlike(pattern))


# Pseudo-classes and pseudo-tags.
NO_CLASS = "No class"


def filter_object_class(
    merged: DataFrame, classes: Sequence[str], frame: Sequence[str], scope: str = "annotation", column: str = "object_class",
) -> DataFrame:
    """Rows of the listed classes. Merged rows hold frame rows (NULL class) and label rows.

    "No class" adds frame rows without any label row; scope "data" returns the frame rows of matching labels.
    """
    label = F.col(column).isNotNull()
    listed = label & F.col(column).isin([c for c in classes if c != NO_CLASS])
    flagged = merged.withColumns({"_listed": listed, "_frame_listed": _in_frame(listed, frame), "_labelled": _in_frame(label, frame)})
    keep = (~label & F.col("_frame_listed")) if scope == "data" else F.col("_listed")
    if NO_CLASS in classes:
        keep = keep | (~label & ~F.col("_labelled"))
    return flagged.where(keep).drop("_listed", "_frame_listed", "_labelled")


def filter_workflow_stage(df: DataFrame, label_rows: DataFrame, stages: Sequence[str], keys: Sequence[str], column: str = "stage") -> DataFrame:
    return df.join(label_rows.where(F.col(column).isin(list(stages))).select(*keys), list(keys), "left_semi")


UNTAGGED_FRAMES, UNTAGGED_ANNOTATIONS = "Untagged frames", "Untagged annotations"


def filter_tags_grouped(
    merged: DataFrame, frame_tags: DataFrame, label_tags: DataFrame, data_names: Sequence[str], label_names: Sequence[str],
    frame: str, label: str,
) -> DataFrame:
    """Frame rows (label NULL) must pass the data tags, label rows the label tags as well as their frame's.

    An empty list of names does not restrict. The pseudo-tags select items with no tag at all.
    """
    def allowed(df: DataFrame, tags: DataFrame, key: str, names: Sequence[str], untagged: str) -> DataFrame:
        """Adds ``_ok``: one of the names, or no tag at all where the pseudo-tag is listed."""
        own = tags.groupBy(key).agg(F.max(F.coalesce(F.col("tag").isin(list(names)), F.lit(False))).alias("_ok"))
        return df.join(own, key, "left").withColumn("_ok", F.coalesce("_ok", F.lit(untagged in names)))

    out = merged
    if data_names:
        out = allowed(out, frame_tags, frame, data_names, UNTAGGED_FRAMES).where("_ok").drop("_ok")
    if label_names:
        out = allowed(out, label_tags, label, label_names, UNTAGGED_ANNOTATIONS)
        own = F.col(label).isNotNull() & F.col("_ok")
        out = out.withColumns({"_own": own, "_frame_ok": _in_frame(own, [frame])})
        out = out.where(F.col("_own") | (F.col(label).isNull() & F.col("_frame_ok"))).drop("_ok", "_own", "_frame_ok")
    return out.select(*merged.columns)


def apply_filters(df: DataFrame, steps: Sequence) -> DataFrame:
    """Ordered composition of DataFrame -> DataFrame filters."""
    return reduce(lambda d, step: d.transform(step), steps, df)


def skip_labeled(units: DataFrame, objects: str = "objects", classifications: str = "classifications") -> DataFrame:
    """Frames with neither objects nor classifications."""
    empty = (F.coalesce(F.size(objects), F.lit(0)) <= 0) & (F.coalesce(F.size(classifications), F.lit(0)) <= 0)
    return units.where(empty)


def unlabeled_frames(units: DataFrame, objects: DataFrame, classifications: DataFrame, frame: Sequence[str]) -> DataFrame:
    """The same over flat label tables: frames found in neither."""
    keys = list(frame)
    return units.join(objects.select(*keys), keys, "left_anti").join(classifications.select(*keys), keys, "left_anti")


def labels_on_predicted_frames(labels: DataFrame, predictions: DataFrame, frame: Sequence[str]) -> DataFrame:
    return labels.join(predictions.select(*frame), list(frame), "left_semi")


def restrict_classes(df: DataFrame, classes: DataFrame, key: str, name: str = "class_name") -> DataFrame:
    """Detection: keep rows of selected classes and add their name. ``classes`` is (key, name)."""
    return df.join(classes.select(key, name), key)


def remap_other_classes(df: DataFrame, classes: DataFrame, key: str, name: str = "class_name", other: str = "others") -> DataFrame:
    """Classification: rows of unselected classes stay, named "others"."""
    return df.join(classes.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(other)))


def prediction_outcome(evaluated: DataFrame, false_negatives: DataFrame, outcome: str, iou: float) -> DataFrame:
    """Rows of one outcome at an IoU threshold: TP / FP among predictions, FN among labels."""
    tp = (F.col("iou") >= F.lit(iou)) & (F.col("match_duplicate_iou") < F.lit(iou))
    if outcome == "TP":
        return evaluated.where(tp)
    if outcome == "FP":
        return evaluated.where(~tp)
    if outcome == "FN":
        return false_negatives.where(F.col("iou_threshold") < F.lit(iou))
    raise ValueError(outcome)


def classification_outcome(pairs: DataFrame, correct: bool) -> DataFrame:
    """Correctly classified or mis-classified frames; a frame that lacks a class on either side is not classified correctly."""
    same = F.coalesce(F.col("gt_class") == F.col("pred_class"), F.lit(False))
    return pairs.where(same if correct else ~same)


def id_scope(ids: DataFrame, column: str, scope: str) -> DataFrame:
    """Distinct frame prefixes (scope "frame") or the label ids (more than three parts)."""
    prefix = F.substring_index(column, "_", 3)
    if scope == "frame":
        return ids.select(prefix.alias(column)).distinct()
    return ids.where(F.col(column) != prefix).select(column)


def item_lookup(frames: DataFrame, objects: DataFrame, tags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames with their metrics and tags, one row per object (one with NULLs for a frame without objects).

    Filter ``frames`` for one item; Catalyst carries an equality on the keys into all three scans.  Objects stay
    rows, so a frame with very many of them is never packed into one value; a frame's tag set is bounded by the
    number of tags in the project.
    """
    keys = list(keys)
    tg = tags.groupBy(*keys).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return frames.join(tg, keys, "left").join(objects, keys, "left")
