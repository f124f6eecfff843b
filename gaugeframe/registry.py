"""Metric and enum registry: names, kinds and the wide-table schemas generated from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T

NORMAL, UINT, UFLOAT, RANK = "normal", "uint", "ufloat", "rank"


@dataclass(frozen=True)
class Metric:
    """A registered metric. ``compute`` maps a domain DataFrame to (key columns, score[, description])."""

    name: str
    kind: str
    title: str
    scope: str = "frame"  # frame | object | classification
    compute: Callable[[DataFrame], DataFrame] | None = None
    image_fn: Callable | None = None


# Metric column names, titles and kinds of the wide analytics tables.
SHARED_METRICS = (
    Metric("metric_width", UINT, "Width"),
    Metric("metric_height", UINT, "Height"),
    Metric("metric_area", UINT, "Area"),
    Metric("metric_aspect_ratio", UFLOAT, "Aspect Ratio"),
    Metric("metric_brightness", NORMAL, "Brightness"),
    Metric("metric_contrast", NORMAL, "Contrast"),
    Metric("metric_sharpness", NORMAL, "Sharpness"),
    Metric("metric_red", NORMAL, "Red"),
    Metric("metric_green", NORMAL, "Green"),
    Metric("metric_blue", NORMAL, "Blue"),
    Metric("metric_random", NORMAL, "Random"),
)
DATA_METRICS = (
    Metric("metric_object_count", UINT, "Object Count"),
    Metric("metric_object_density", NORMAL, "Object Density"),
    Metric("metric_image_difficulty", RANK, "Image Difficulty"),
    Metric("metric_image_singularity", NORMAL, "Image Singularity"),
)
ANNOTATION_METRICS = (
    Metric("metric_area_relative", NORMAL, "Relative Area", "object"),
    Metric("metric_label_duplicates", NORMAL, "Label Duplicates", "object"),
    Metric("metric_label_border_closeness", NORMAL, "Border Closeness", "object"),
    Metric("metric_label_poly_similarity", NORMAL, "Polygon Similarity", "object"),
    Metric("metric_label_missing_or_broken_tracks", NORMAL, "Missing or Broken Tracks", "object"),
    Metric("metric_annotation_quality", NORMAL, "Annotation Quality", "classification"),
    Metric("metric_label_inconsistent_classification_and_track", NORMAL, "Inconsistent Classification And Track", "object"),
    Metric("metric_label_shape_outlier", NORMAL, "Shape Outlier", "object"),
    Metric("metric_label_confidence", NORMAL, "Confidence", "object"),
)
# Allowed values of the fixed enums.
ANNOTATION_TYPES = (
    "classification", "bounding_box", "rotatable_bounding_box", "point", "polyline", "polygon", "skeleton", "bitmask",
)
# Outlier fence multipliers.
MODERATE_IQR_SCALE, SEVERE_IQR_SCALE = 1.5, 2.5


class UnknownMetricError(KeyError):
    """A filter, summary or chart names a metric the domain does not register."""


@dataclass
class MetricRegistry:
    """Metrics and enums of one domain; custom ones are added with :meth:`register`."""

    metrics: dict[str, Metric] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...] | None] = field(default_factory=dict)

    @classmethod
    def of(cls, metrics: Iterable[Metric], enums: dict[str, tuple[str, ...] | None] | None = None) -> MetricRegistry:
        return cls({m.name: m for m in metrics}, dict(enums or {}))

    def register(self, metric: Metric) -> Metric:
        if metric.name in self.metrics:
            raise ValueError(f"metric {metric.name} is already registered")
        self.metrics[metric.name] = metric
        return metric

    def kind(self, name: str) -> str:
        if name not in self.metrics:
            raise UnknownMetricError(name)
        return self.metrics[name].kind

    def require(self, names: Iterable[str], columns: Iterable[str] | None = None) -> None:
        for n in names:
            if n not in self.metrics and n not in self.enums:
                raise UnknownMetricError(n)
            if columns is not None and n not in columns:
                raise UnknownMetricError(n)

    def by_scope(self, scope: str | None) -> list[Metric]:
        """Metrics that apply to frames, objects or classifications; None lists all."""
        return [m for m in self.metrics.values() if scope is None or m.scope == scope]

    def schema(self, keys: Iterable[str]) -> T.StructType:
        """Wide table schema: string keys (frame is INT) followed by nullable metric columns."""
        fields = [T.StructField(k, T.IntegerType() if k == "frame" else T.StringType(), False) for k in keys]
        fields += [
            T.StructField(m.name, T.LongType() if m.kind == UINT else T.DoubleType(), True) for m in self.metrics.values()
        ]
        fields += [T.StructField(e, T.StringType(), True) for e in self.enums]
        return T.StructType(fields)


DATA_REGISTRY = MetricRegistry.of(SHARED_METRICS + DATA_METRICS)
ANNOTATION_REGISTRY = MetricRegistry.of(
    SHARED_METRICS + ANNOTATION_METRICS,
    {"feature_hash": None, "annotation_type": ANNOTATION_TYPES, "annotation_manual": ("0", "1")},
)
