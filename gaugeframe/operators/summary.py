"""Summaries, outliers, distributions and dataset statistics over wide metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeframe.functions.scalar import bucket_round
from gaugeframe.plans.quantiles import index_mark, linear_quantiles, long_metrics, order_statistics
from gaugeframe.plans.scan import running
from gaugeframe.registry import MODERATE_IQR_SCALE, RANK, SEVERE_IQR_SCALE, MetricRegistry

NO_OUTLIERS = ("metric_random",)  # uniform by construction


def severity(value: Column, q1: Column, q3: Column) -> Column:
    """Severe beyond the 2.5 IQR fences, Moderate between 1.5 and 2.5 (2.5 fence included), else Low."""
    iqr = q3 - q1
    mod_lo, mod_hi = q1 - iqr * MODERATE_IQR_SCALE, q3 + iqr * MODERATE_IQR_SCALE
    sev_lo, sev_hi = q1 - iqr * SEVERE_IQR_SCALE, q3 + iqr * SEVERE_IQR_SCALE
    return (
        F.when((value < sev_lo) | (value > sev_hi), "Severe")
        .when((value < mod_lo) | (value > mod_hi), "Moderate")
        .otherwise("Low")
    )


def _quartile_stats(df: DataFrame, metrics: Sequence[str], registry: MetricRegistry | None) -> DataFrame:
    ranks = [m for m in metrics if registry is not None and registry.kind(m) == RANK]
    stats = order_statistics(df, metrics)
    if not ranks:
        return stats
    is_rank = F.col("metric").isin(ranks)
    position = {
        "min": F.lit(0.0),
        "q1": F.floor(F.col("n") / 4).cast("double"),
        "median": F.floor(F.col("n") / 2).cast("double"),
        "q3": F.floor(F.col("n") * 3 / 4).cast("double"),
        "max": F.col("n").cast("double"),
    }
    return stats.withColumns({c: F.when(is_rank, p).otherwise(F.col(c)) for c, p in position.items()})


def metric_summary(df: DataFrame, metrics: Sequence[str], registry: MetricRegistry | None = None) -> DataFrame:
    """Count, extremes, index quartiles and outlier totals of every metric: three scans, no row shuffle."""
    stats = _quartile_stats(df, metrics, registry)
    skip = set(NO_OUTLIERS) | {m for m in metrics if registry is not None and registry.kind(m) == RANK}
    # bounded: one row per registered metric
    probed = long_metrics(df, metrics).join(F.broadcast(stats), "metric")
    level = severity(F.col("value"), F.col("q1"), F.col("q3"))
    counted = F.lit(True) if not skip else ~F.col("metric").isin(sorted(skip))
    return probed.groupBy("metric", F.col("n").alias("count"), "min", "q1", "median", "q3", "max").agg(
        F.count_if(counted & (level == "Moderate")).alias("moderate"),
        F.count_if(counted & (level == "Severe")).alias("severe"),
    )


def domain_summary(df: DataFrame, metrics: Sequence[str], registry: MetricRegistry | None = None) -> DataFrame:
    """metric_summary plus the number of rows of the (filtered) domain, as one row per metric."""
    total = df.agg(F.count("*").alias("total"))
    return metric_summary(df, metrics, registry).select("*", total.scalar().alias("total"))


def distribution(df: DataFrame, attr: str, digits: int | None = None) -> DataFrame:
    """Rows per rounded metric value (1/2/3 digits) or per raw value / enum."""
    key = F.col(attr) if digits is None else bucket_round(F.col(attr), digits)
    return df.where(F.col(attr).isNotNull()).groupBy(key.alias("bucket")).agg(F.count("*").alias("count"))


def scatter(df: DataFrame, x: str, y: str, x_digits: int | None = 2, y_digits: int | None = 2) -> DataFrame:
    """Rows per pair of rounded values; both must be present."""
    bx = F.col(x) if x_digits is None else bucket_round(F.col(x), x_digits)
    by = F.col(y) if y_digits is None else bucket_round(F.col(y), y_digits)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(bx.alias("x"), by.alias("y")).agg(F.count("*").alias("count"))


def embedding_density(points: DataFrame, digits: int = 2) -> DataFrame:
    """2-D point counts of a reduction and the overall total."""
    cells = scatter(points, "x", "y", digits, digits)
    return cells.select("*", points.agg(F.count("*")).scalar().alias("total"))


def iqr_outliers(df: DataFrame, metrics: Sequence[str], keep: Sequence[str], ordered: bool = False) -> DataFrame:
    """Per row and metric: distance outside [Q1, Q3] (linear quartiles) and severity; on request in order, farthest first."""
    q = linear_quantiles(df, metrics, {"q1": 0.25, "q3": 0.75}).select("metric", "q1", "q3")
    v = F.col("value")
    distance = F.when(v > F.col("q3"), v - F.col("q3")).when(v < F.col("q1"), F.col("q1") - v).otherwise(F.lit(0.0))
    # bounded: one row per registered metric
    out = long_metrics(df, metrics, keep).join(F.broadcast(q), "metric").select(
        *keep, "metric", "value", distance.alias("distance"), severity(v, F.col("q1"), F.col("q3")).alias("status")
    )
    return out.orderBy("metric", F.desc("distance")) if ordered else out


def all_metric_outliers(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Severe and moderate totals per metric, most severe first."""
    rows = iqr_outliers(df, metrics, [])
    return (
        rows.groupBy("metric")
        .agg(F.count_if(F.col("status") == "Severe").alias("severe"), F.count_if(F.col("status") == "Moderate").alias("moderate"))
        .orderBy(F.desc("severe"), "metric")
    )


def unique_outlier_items(df: DataFrame, metrics: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Distinct items severe / moderate in any metric, grand totals and affected metrics.

    An item's metrics sit in its own row, so items are counted from per-row flags without a distinct.
    """
    q = linear_quantiles(df, metrics, {"q1": 0.25, "q3": 0.75}).select("metric", "q1", "q3")
    fences = q.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("q1", "q3")))).alias("f"))
    tagged = df.select(*key, *metrics).withColumn("_f", fences.scalar())
    statuses = F.array(
        *[
            F.when(F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")), severity(F.col(m).cast("double"), F.col("_f")[m]["q1"], F.col("_f")[m]["q3"])).otherwise("Low")
            for m in metrics
        ]
    )
    per_item = tagged.select(*key, statuses.alias("s"))

    def items(level: str) -> Column:
        return F.count_if(F.array_contains("s", level))

    def hits(level: str) -> Column:
        return F.sum(F.size(F.filter("s", lambda s: s == level)))

    def touched(level: str) -> Column:
        flags = [F.max(F.when(F.col("s")[i] == level, 1).otherwise(0)) for i in range(len(metrics))]
        return sum(flags[1:], flags[0])

    return per_item.agg(
        items("Severe").alias("severe_items"),
        items("Moderate").alias("moderate_items"),
        hits("Severe").cast("long").alias("severe_total"),
        hits("Moderate").cast("long").alias("moderate_total"),
        touched("Severe").cast("long").alias("severe_metrics"),
        touched("Moderate").cast("long").alias("moderate_metrics"),
    )


def annotator_stats(df: DataFrame, annotator: str, score: str) -> DataFrame:
    """Annotations and mean score per annotator."""
    return df.groupBy(F.col(annotator).alias("annotator")).agg(F.count("*").alias("annotations"), F.avg(score).alias("mean_score"))


def annotation_counts(labels: DataFrame, ontology: DataFrame, key: str) -> DataFrame:
    """Labels per ontology entry, zero-count entries included."""
    counts = labels.groupBy(key).agg(F.count("*").alias("c"))
    return ontology.join(counts, key, "left").select(*ontology.columns, F.coalesce("c", F.lit(0)).alias("count"))


def image_size_median(units: DataFrame, width: str, height: str) -> DataFrame:
    """(width, height) of the frame at position n // 2 of the areas; equal areas resolve by width."""
    area = units.select("*", (F.col(width) * F.col(height)).cast("double").alias("_area"))
    at = order_statistics(area, ["_area"], {"mid": index_mark(1, 2)})
    return area.join(F.broadcast(at), F.col("_area") == F.col("mid")).agg(
        F.min(F.struct(F.col(width).alias("width"), F.col(height).alias("height"))).alias("s")
    ).select("s.width", "s.height")


def undersampled_classes(df: DataFrame, key: str) -> DataFrame:
    """Class counts; flagged when at most half the median class count (linear median and list-middle median)."""
    counts = df.groupBy(F.col(key).alias("class")).agg(F.count("*").alias("count"))
    med = linear_quantiles(counts, ["count"], {"med": 0.5}).select("med")
    # element n // 2 of the descending list is element n - 1 - n // 2 of the ascending one
    mid = order_statistics(counts, ["count"], {"mid": (0.5, lambda n: n - 1 - F.floor(n / 2))}).select("mid")
    return counts.withColumns({"_med": med.scalar(), "_mid": mid.scalar()}).select(
        "class",
        "count",
        (F.col("count") <= F.col("_med") / 2).alias("undersampled"),
        (F.col("count") <= F.col("_mid") / 2).alias("undersampled_by_middle"),
    )


def project_stats(units: DataFrame, labels: DataFrame, project: str, unit: str, frame: str, cls: str) -> DataFrame:
    """Per project: units, frames, annotations, classes. Labels carry (project, class)."""
    u = units.groupBy(project).agg(F.countDistinct(unit).alias("units"), F.count(frame).alias("frames"))
    lab = labels.groupBy(project, cls).agg(F.count("*").alias("c")).groupBy(project).agg(
        F.sum("c").alias("annotations"), F.count("*").alias("classes")
    )
    return u.join(lab, project, "left").select(
        project, "units", "frames",
        F.coalesce("annotations", F.lit(0)).alias("annotations"), F.coalesce("classes", F.lit(0)).alias("classes"),
    )


def ks_dissimilarity(df: DataFrame, metrics: Sequence[str], side: Column) -> DataFrame:
    """Two-sample KS statistic per metric; ``side`` is true for the first sample. Metrics with an empty side are skipped.

    Values are pre-counted, so a hot value is one row; the running counts go through the sliced scan.
    """
    rows = long_metrics(df.withColumn("_side", side), metrics, ["_side"])
    per_value = rows.groupBy("metric", "value").agg(
        F.count_if(F.col("_side")).alias("a"), F.count_if(~F.col("_side")).alias("b")
    )
    cum = running(per_value, ["metric"], [F.col("value")], sums={"ca": F.col("a"), "cb": F.col("b")})
    totals = cum.groupBy("metric").agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).where("na > 0 and nb > 0")
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    return cum.join(F.broadcast(totals), "metric").groupBy("metric").agg(F.max(gap).alias("ks"))


def running_stats(scores: DataFrame, key: str, value: str) -> DataFrame:
    """min / max / mean / count per metric; array scores are taken as their L2 norm."""
    v = F.col(value)
    if scores.schema[value].dataType.typeName() == "array":
        v = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    v = v.cast("double")
    return scores.groupBy(key).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count(v).alias("count")
    )


def object_count(units: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Objects per frame, 0 for frames without any."""
    c = objects.groupBy(key).agg(F.count("*").alias("c"))
    return units.join(c, key, "left").select(key, F.coalesce("c", F.lit(0)).alias("object_count"))


def ols_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line, null where x does not vary."""
    varies = F.max(x) > F.min(x)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.when(varies, F.regr_slope(y, x)).alias("slope"),
        F.when(varies, F.regr_intercept(y, x)).alias("intercept"),
        F.count("*").alias("n"),
    )


def annotation_time(labels: DataFrame, logs: DataFrame, key: str, millis: str) -> DataFrame:
    """Seconds spent per label from its log entries; 0 without logs."""
    spent = logs.groupBy(key).agg(F.sum(millis).alias("ms"))
    return labels.join(spent, key, "left").select(key, F.coalesce(F.col("ms") / 1000, F.lit(0.0)).alias("seconds"))


def metric_catalog(df: DataFrame, metrics: Sequence[str], registry: MetricRegistry | None = None) -> DataFrame:
    """Available metrics with range and count, from one pass; metrics without data are hidden."""
    def entry(m: str) -> Column:
        title = registry.metrics[m].title if registry else m
        kind = registry.kind(m) if registry else "normal"
        c = F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
        return F.struct(
            F.lit(m).alias("metric"), F.lit(title).alias("title"), F.lit(kind).alias("kind"),
            F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("count"),
        ).alias(m)

    row = df.agg(*[entry(m) for m in metrics])
    return row.select(F.explode(F.array(*metrics)).alias("s")).select("s.*").where("count > 0")
