"""Matching predictions to labels once, so that TP / FP / FN at any IoU threshold are plain predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeframe.plans.scan import running_by_key
from gaugeframe.plans.spatial import DEFAULT_CELL, best_other, best_overlap, geometry, stored_bounds

# Interval ends of predictions that are never / always true positives.
ALWAYS_FP, ALWAYS_TP = 1.0, -1.0
# Fixed value: IoU from which two boxes of one class count as duplicates.
DUPLICATE_IOU = 0.6


def iou_match(predictions: DataFrame, labels: DataFrame, keys: Sequence[str] = ("frame_id", "feature"), label_id: str = "label_id", cell: float = DEFAULT_CELL) -> DataFrame:
    """Each prediction with its best label of the same frame and class: ``match_id`` (null without overlap), ``iou``.

    Objects are boxes, polygons (``points``) or run-length masks (``rle``), where both tables have the column.
    """
    return best_overlap(stored_bounds(predictions), stored_bounds(labels), keys, label_id, cell).withColumnRenamed(f"best_{label_id}", "match_id")


def classification_pairs(predictions: DataFrame, labels: DataFrame, keys: Sequence[str], label_id: str = "label_id") -> DataFrame:
    """Predictions without geometry match the labels of their frame and class with IoU 1; the smallest label id stands for copies."""
    one = labels.groupBy(*keys).agg(F.min(label_id).alias("match_id"))
    return predictions.join(one, list(keys), "left").withColumn("iou", F.when(F.col("match_id").isNotNull(), 1.0).otherwise(0.0))


def match_duplicate_iou(matched: DataFrame, pred_id: str = "pred_id", confidence: str = "confidence") -> DataFrame:
    """Lower end of the threshold interval in which a prediction is the true positive of its label.

    Read a label's matches by falling confidence.  A match stays in the running only while its IoU exceeds
    that of everything more confident; it then loses to the most overlapping of those, so that IoU is its
    lower end.  All others are never true positives.  TP at t is: iou >= t and match_duplicate_iou < t.
    """
    # unmatched predictions ride along, spread by hashes of their own, so nothing is computed twice or joined back
    none = F.col("match_id").isNull()
    keyed = matched.withColumn("_alone", F.when(none, F.xxhash64(pred_id, confidence)))
    order = [F.desc(confidence), F.desc("iou"), F.desc(pred_id)]
    scanned = running_by_key(keyed, ["match_id", "_alone"], order, {"_prior": F.col("iou")})
    open_ = ~none & (F.col("_prior").isNull() | (F.col("iou") > F.col("_prior")))
    end = F.when(open_, F.coalesce("_prior", F.lit(ALWAYS_TP))).otherwise(F.lit(ALWAYS_FP))
    return scanned.withColumn("match_duplicate_iou", end).drop("_alone", "_prior")


def is_tp(iou: float) -> Column:
    return (F.col("iou") >= F.lit(iou)) & (F.col("match_duplicate_iou") < F.lit(iou))


def fn_threshold(labels: DataFrame, matched: DataFrame, label_id: str = "label_id") -> DataFrame:
    """Labels with their best match IoU (-1 unmatched); a label is missed at t when iou_threshold < t."""
    best = matched.where(F.col("match_id").isNotNull()).groupBy(F.col("match_id").alias(label_id)).agg(F.max("iou").alias("_t"))
    return labels.join(best, label_id, "left").withColumn("iou_threshold", F.coalesce("_t", F.lit(-1.0))).drop("_t")


def greedy_tp(matched: DataFrame, iou: float | None = None, pred_id: str = "pred_id", confidence: str = "confidence") -> DataFrame:
    """True positives by confidence: the first match of a label reaching the threshold wins (null means 0.5).

    Adds ``tp`` and ``fp_reason``.  One map-side-combined minimum per label instead of a window, so a label
    with very many matches costs no more than any other.
    """
    t = 0.5 if iou is None else iou
    reach = matched.where(F.col("match_id").isNotNull() & (F.col("iou") >= F.lit(t)))
    first = reach.groupBy("match_id").agg(F.min(F.struct((-F.col(confidence)).alias("neg"), F.col(pred_id).alias("id"))).alias("win"))
    own = F.struct((-F.col(confidence)).alias("neg"), F.col(pred_id).alias("id"))
    tp = F.coalesce(own == F.col("win"), F.lit(False))
    # The texts of the reasons.
    reason = (
        F.when(tp, "")
        .when(F.col("match_id").isNull(), F.concat(F.lit("No overlapping label of class `"), F.col("feature"), F.lit("`.")))
        .when(own > F.col("win"), "Prediction with higher confidence already matched label.")
        .otherwise("IOU too low.")
    )
    return matched.join(first, "match_id", "left").withColumns({"tp": tp, "fp_reason": reason}).drop("win")


def false_negatives(labels: DataFrame, greedy: DataFrame, label_id: str = "label_id") -> DataFrame:
    """Labels no prediction won."""
    return labels.join(greedy.where("tp").select(F.col("match_id").alias(label_id)), label_id, "left_anti")


def annotation_duplicates(objects: DataFrame, keys: Sequence[str] = ("frame_id", "feature"), id_col: str = "obj_id", cell: float = DEFAULT_CELL) -> DataFrame:
    """Best IoU partner of every object (box, or polygon in ``points``) within frame and class; mutual duplicates are reported by
    the smaller id only.  A NULL class is a class; objects without geometry have no partner."""
    shaped = stored_bounds(objects)
    scored = best_other(shaped.select(*keys, id_col, *geometry(shaped)), keys, id_col, cell)
    scored = scored.withColumn("partner", F.when(F.col("iou") >= F.lit(DUPLICATE_IOU), F.col("partner")))
    # (a, b) and (b, a) meet in one group of at most two rows and the smaller id stays; other rows are alone in theirs
    pair = {"_lo": F.least(id_col, "partner"), "_hi": F.greatest(id_col, "partner")}
    kept = F.min(F.struct(id_col, "partner", *keys, F.col("iou").alias("score")))
    out = scored.withColumns(pair).groupBy("_lo", F.when(F.col("partner").isNotNull(), F.col("_hi")).alias("_hi")).agg(kept.alias("r")).select("r.*")
    note = F.when(F.col("partner").isNull(), "Possible non duplicated object").otherwise("Possible duplicates")
    return out.select(*keys, id_col, "partner", "score", note.alias("description"))
