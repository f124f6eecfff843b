"""Detection and classification evaluation over matched predictions (``iou``, ``match_duplicate_iou``) and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeframe.functions.scalar import bucket_round
from gaugeframe.operators.matching import is_tp
from gaugeframe.plans.quantiles import linear_quantiles, long_metrics
from gaugeframe.plans.joins import null_safe_join
from gaugeframe.plans.scan import marked_positions, running

# Thresholds of average recall, 11-point and 101-point precision, float epsilon.
RECALL_IOUS = tuple(i / 10 for i in range(5, 11))
ELEVEN_POINTS = tuple(i / 10 for i in range(11))
EPS = 2.220446049250313e-16


def confusion_counts(evaluated: DataFrame, fns: DataFrame, iou: float, key: str = "feature") -> DataFrame:
    """TP, FP and FN per class over all classes seen, plus TP at every average-recall threshold; one pass each."""
    extra = [F.count_if(is_tp(t)) for t in RECALL_IOUS]
    p = evaluated.groupBy(key).agg(
        F.count_if(is_tp(iou)).alias("tp"), F.count("*").alias("n"), F.array(*extra).alias("tp_at"), F.lit(0).cast("long").alias("fn")
    )
    f = fns.groupBy(key).agg(F.count_if(F.col("iou_threshold") < F.lit(iou)).alias("fn")).select(
        key, F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n"),
        F.array(*[F.lit(0).cast("long")] * len(RECALL_IOUS)).alias("tp_at"), "fn",
    )
    merged = p.unionByName(f).groupBy(key).agg(
        F.sum("tp").alias("tp"), (F.sum("n") - F.sum("tp")).alias("fp"), F.sum("fn").alias("fn"),
        *[F.sum(F.col("tp_at")[i]).alias(f"tp_{i}") for i in range(len(RECALL_IOUS))],
    )
    return merged.select(key, "tp", "fp", "fn", F.array(*[f"tp_{i}" for i in range(len(RECALL_IOUS))]).alias("tp_at"))


def class_union(*tables: DataFrame, key: str = "feature") -> DataFrame:
    """Classes present in any of the tables; each side is reduced before the union."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.union(t.select(key).distinct())
    return out.distinct()


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    out = counts.withColumns({"precision": p, "recall": r})
    total = F.col("precision") + F.col("recall")
    twice = F.lit(2.0) * F.col("precision") * F.col("recall")
    return out.withColumns({
        "f1_clamped": twice / F.greatest(total, F.lit(1.0)),
        "f1": F.when(total > 0, twice / total).otherwise(F.lit(0.0)),
    })


def average_recall(counts: DataFrame) -> DataFrame:
    """Twice the trapezoid area of recall over IoU 0.5 to 1.0; the denominator is fixed at the requested threshold."""
    labels = F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    area = F.lit(0.0)
    for i in range(len(RECALL_IOUS) - 1):
        width = RECALL_IOUS[i + 1] - RECALL_IOUS[i]
        area = area + (F.col("tp_at")[i] / labels + F.col("tp_at")[i + 1] / labels) / 2 * F.lit(width)
    return counts.withColumn("average_recall", area * 2)


def pr_curve(evaluated: DataFrame, counts: DataFrame, iou: float, key: str = "feature", pred_id: str = "pred_id", confidence: str = "confidence") -> DataFrame:
    """Best precision per class and recall rounded to 2 digits, reading predictions by falling confidence."""
    flags = evaluated.select(key, confidence, pred_id, is_tp(iou).alias("_tp"))
    hits, totals = marked_positions(flags, [key], [F.desc(confidence), F.asc(pred_id)], F.col("_tp"))
    # the last row of a TP count is the one before the next TP, or the last of its class
    steps = hits.select(key, (F.col("nth") - 1).alias("ctp"), (F.col("rn") - 1).alias("rn")).where("rn > 0").unionByName(totals.select(key, F.col("m").alias("ctp"), F.col("n").alias("rn")))
    at = null_safe_join(steps, counts.select(key, (F.col("tp") + F.col("fn")).alias("_labels")), [key])
    recall = F.when(F.col("_labels") > 0, F.col("ctp") / F.col("_labels")).otherwise(F.lit(0.0))
    return at.groupBy(key, bucket_round(recall, 2).alias("recall")).agg(F.max(F.col("ctp") / F.col("rn")).alias("precision"))


def average_precision_11pt(curve: DataFrame, key: str = "feature") -> DataFrame:
    best = [F.coalesce(F.max(F.when(F.col("recall") >= F.lit(t), F.col("precision"))), F.lit(0.0)) for t in ELEVEN_POINTS]
    return curve.groupBy(key).agg((sum(best[1:], best[0]) / len(best)).alias("average_precision"))


def pr_envelope(curve: DataFrame, key: str = "feature") -> DataFrame:
    """Running best precision from high to low recall, closed with zero precision up to recall 1."""
    # recall has two digits: at most 101 rows per class in this window
    w = W.partitionBy(key).orderBy(F.desc("recall")).rowsBetween(W.unboundedPreceding, 0)
    env = curve.select(key, "recall", F.max("precision").over(w).alias("precision"))
    top = curve.groupBy(key).agg(F.max("recall").alias("r"), F.max("precision").alias("p")).where((F.col("r") != 1.0) & (F.col("p") != 0.0))
    tail = top.select(key, F.explode(F.array(F.lit(1.0), F.col("r") + F.lit(0.01))).alias("recall")).withColumn("precision", F.lit(0.0))
    return env.unionByName(tail)


def map_mar_101pt(greedy: DataFrame, labels: DataFrame, key: str = "feature", pred_id: str = "pred_id", confidence: str = "confidence", ignore_unmatched_frames: bool = False, frame: str = "frame_id") -> DataFrame:
    """Per class and overall: 101-point average precision and final recall of greedily matched predictions.

    The precision envelope at recall r is the best precision at any recall >= r, so each step only needs its
    recall slot; slots (at most 101 per class) are folded from the top.
    """
    counted = labels.join(greedy.select(frame), frame, "left_semi") if ignore_unmatched_frames else labels
    n = counted.groupBy(key).agg(F.count("*").alias("_labels"))
    flags = greedy.select(key, confidence, pred_id, F.col("tp").cast("long").alias("_tp"))
    seen = running(flags, [key], [F.desc(confidence), F.asc(pred_id)], sums={"rn": F.lit(1).cast("long"), "ctp": F.col("_tp")})
    at = null_safe_join(seen, n, [key])
    rc = F.col("ctp") / (F.col("_labels") + F.lit(EPS))
    pr = F.col("ctp") / (F.col("rn") + F.lit(EPS))
    near = F.least(F.floor(rc * 100 + F.lit(0.5)), F.lit(100)).cast("int")
    slot = F.when(near * F.lit(0.01) <= rc, near).otherwise(near - 1)
    slots = at.groupBy(key, slot.alias("slot")).agg(F.max(pr).alias("p"), F.max(rc).alias("rc"))
    points = slots.select(key, "p", "rc", F.explode(F.sequence(F.lit(0), F.col("slot"))).alias("i"))
    envelope = points.groupBy(key, "i").agg(F.max("p").alias("p"), F.max("rc").alias("rc"))
    found = envelope.groupBy(key).agg((F.sum("p") / 101).alias("_ap"), F.max("rc").alias("_ar"))
    per_class = null_safe_join(n, found, [key], "left").select(
        F.col(key).alias("class_name"), F.coalesce("_ap", F.lit(0.0)).alias("ap"), F.coalesce("_ar", F.lit(0.0)).alias("ar")
    )
    mean = per_class.agg(F.avg("ap").alias("ap"), F.avg("ar").alias("ar")).select(F.lit("Mean").alias("class_name"), "ap", "ar")
    return per_class.unionByName(mean)


def dedupe_counts(ground_truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct frames with ground truth."""
    return ground_truth.agg(F.countDistinct(*keys).alias("num_frames"))


def prediction_summary(evaluated: DataFrame, fns: DataFrame, iou: float, key: str = "feature", frame_keys: Sequence[str] = ("frame_id",), classification: bool = False) -> DataFrame:
    """Class means (mAP, mAR, mP, mR, mF1), totals, frame count and, for classification, TN and accuracy."""
    counts = confusion_counts(evaluated, fns, iou, key)
    ap = average_precision_11pt(pr_curve(evaluated, counts, iou, key), key)
    scored = null_safe_join(average_recall(precision_recall_f1(counts)), ap, [key], "left").fillna(0.0, ["average_precision"])
    row = scored.agg(
        F.avg("average_precision").alias("mAP"), F.avg("average_recall").alias("mAR"), F.avg("precision").alias("mP"),
        F.avg("recall").alias("mR"), F.avg("f1_clamped").alias("mF1"),
        F.sum("tp").alias("tTP"), F.sum("fp").alias("tFP"), F.sum("fn").alias("tFN"),
    )
    frames = dedupe_counts(fns, frame_keys)
    out = row.withColumn("num_frames", frames.scalar())
    tn = F.col("num_frames") - F.col("tTP") - F.col("tFN")
    accuracy = (F.col("tTP") + tn) / F.greatest(F.col("num_frames"), F.lit(1))
    flag = F.lit(classification)
    return out.withColumns({"classification_tTN": F.when(flag, tn), "classification_accuracy": F.when(flag, accuracy)})


def metric_correlation(evaluated: DataFrame, metrics: Sequence[str], iou: float) -> DataFrame:
    """Pearson correlation of the TP flag with each metric over rows having the metric; null without variance."""
    tp = is_tp(iou).cast("double")

    def pearson(m: str) -> Column:
        x, y = F.col(m).cast("double"), F.when(F.col(m).isNotNull(), tp)
        return F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x))

    one = evaluated.agg(*[pearson(m).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("correlation")) for m in metrics])
    return one.select(F.explode(pairs).alias("s")).select("s.*")


def metric_importance(evaluated: DataFrame, metrics: Sequence[str], iou: float, digits: int = 1) -> DataFrame:
    """Binned mutual information (nats) between each metric and iou * TP, both rounded to ``digits``."""
    target = bucket_round(F.col("iou") * is_tp(iou).cast("double"), digits)
    rows = long_metrics(evaluated.withColumn("_t", target), metrics, ["_t"])
    cells = rows.groupBy("metric", bucket_round(F.col("value"), digits).alias("bx"), F.col("_t").alias("by")).agg(F.count("*").alias("c"))
    mx = cells.groupBy("metric", "bx").agg(F.sum("c").alias("cx"))
    my = cells.groupBy("metric", "by").agg(F.sum("c").alias("cy"))
    n = cells.groupBy("metric").agg(F.sum("c").alias("n"))
    joint = cells.join(mx, ["metric", "bx"]).join(my, ["metric", "by"]).join(n, "metric")
    term = (F.col("c") / F.col("n")) * F.log((F.col("c").cast("double") * F.col("n")) / (F.col("cx").cast("double") * F.col("cy")))
    return joint.groupBy("metric").agg(F.sum(term).alias("importance"))


def performance_by_metric(evaluated: DataFrame, fns: DataFrame, metric: str, iou: float, digits: int = 2, key: str = "feature") -> DataFrame:
    """Per class and metric bucket: precision with its count, and missed labels against predictions in the bucket."""
    bucket = bucket_round(F.col(metric), digits).alias("bucket")
    p = evaluated.where(F.col(metric).isNotNull()).groupBy(key, bucket).agg(F.count_if(is_tp(iou)).alias("tp"), F.count("*").alias("n"))
    f = fns.where(F.col(metric).isNotNull() & (F.col("iou_threshold") < F.lit(iou))).groupBy(key, bucket).agg(F.count("*").alias("fn"))
    both = p.join(f, [key, "bucket"], "full")
    labels = F.col("fn") + F.coalesce("n", F.lit(0))
    return both.select(
        key, "bucket", (F.col("tp") / F.col("n")).alias("precision"), "n",
        (F.col("fn") / labels).alias("fn_rate_vs_predictions"), labels.alias("fn_n"),
    )


def performance_overall(evaluated: DataFrame, metric: str, iou: float, digits: int = 2, key: str = "feature") -> DataFrame:
    """Bucket precision per class and over all classes from one grouping-sets pass, n scaled by its maximum,
    and the mean bucket precision of each line as reference."""
    flags = evaluated.where(F.col(metric).isNotNull()).select(
        key, bucket_round(F.col(metric), digits).alias("bucket"), is_tp(iou).cast("long").alias("_tp")
    )
    cells = flags.groupingSets([[F.col(key), F.col("bucket")], [F.col("bucket")]], F.col(key), F.col("bucket")).agg(
        F.grouping(key).alias("overall"), F.sum("_tp").alias("tp"), F.count("*").alias("n")
    )
    # buckets per line are bounded by the rounding
    line = W.partitionBy("overall", key)
    a = F.col("tp") / F.col("n")
    return cells.select(
        F.when(F.col("overall") == 1, "Average").otherwise(F.col(key)).alias(key), "bucket", a.alias("precision"),
        (F.col("n") / F.max("n").over(line)).alias("scaled_n"), F.avg(a).over(line).alias("reference"),
    )


def performance_qcut(df: DataFrame, metric: str, indicator: Column, bins: int = 100) -> DataFrame:
    """Mean indicator per quantile bin of the metric, labelled by the bin middle; equal edges merge."""
    present = df.where(F.col(metric).isNotNull()).select(F.col(metric).cast("double").alias("_m"), indicator.cast("double").alias("_i"))
    # at most bins + 1 rows reach the driver: fewer distinct values than bins means fewer bins
    distinct = present.select("_m").distinct().limit(bins).count()
    n_bins = min(bins, distinct)
    points = {f"e{i}": i / n_bins for i in range(n_bins + 1)}
    edges = linear_quantiles(present, ["_m"], points).select(F.array_sort(F.array_distinct(F.array(*points))).alias("e"))
    placed = present.withColumn("_e", edges.scalar())
    hi = F.greatest(F.size(F.filter("_e", lambda e: e < F.col("_m"))), F.lit(1))
    mid = (F.element_at("_e", hi) + F.element_at("_e", hi + 1)) / 2
    return placed.groupBy(mid.alias("bin")).agg(F.avg("_i").alias("average"), F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, classes: Sequence, truth: str = "gt_class", predicted: str = "pred_class") -> DataFrame:
    """Label x prediction counts, one column per listed class."""
    return pairs.groupBy(truth).pivot(predicted, list(classes)).agg(F.count(F.lit(1))).fillna(0)


def classification_report(pairs: DataFrame, truth: str = "gt_class", predicted: str = "pred_class") -> DataFrame:
    """Precision, recall, F1, support per class (0 on empty denominators) and the overall accuracy."""
    cells = pairs.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    hit = F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = cells.select(F.col("t").alias("class"), hit.alias("tp"), F.col("c").alias("support"), zero.alias("predicted")).unionByName(
        cells.select(F.col("p").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("c").alias("predicted"))
    )
    per = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    accuracy = cells.agg(F.sum(hit) / F.sum("c")).scalar()
    out = per.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("tp") > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select("class", "precision", "recall", f1.alias("f1"), "support", accuracy.alias("accuracy"))


def classification_match(predictions: DataFrame, labels: DataFrame, frame: Sequence[str], cls: str = "class_id") -> DataFrame:
    """Predicted against true class of the same frame with the TP flag; frames without label keep a null class."""
    keys = list(frame)
    truth = labels.select(*keys, F.col(cls).alias("true_class"))
    out = predictions.join(truth, keys, "left")
    return out.withColumn("tp", F.coalesce(F.col(cls) == F.col("true_class"), F.lit(False)))


def frame_intersection(a: DataFrame, b: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Frames present in both tables."""
    return a.select(*frame).intersect(b.select(*frame))
