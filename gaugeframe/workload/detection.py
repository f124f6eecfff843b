"""Queries of the geometry, matching, evaluation and sequence families."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import boxes as B
from gaugeframe.operators import density as D, evaluation as E, filters as X, matching as M, sequences as Q
from gaugeframe.session import cut_lineage
from gaugeframe.workload import views as V
from gaugeframe.workload.views import with_views

IOU = 0.5
QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def matched(spark, d):
    return M.iou_match(V.pred(spark, d), V.gt(spark, d))


def evaluated(spark, d, *more):
    """Matched predictions with their intervals and labels with their thresholds; matching runs once.

    Stored are the columns that every evaluation needs and those in ``more``, no boxes.
    """
    ev = cut_lineage(M.match_duplicate_iou(matched(spark, d).select("pred_id", "feature", "confidence", "match_id", "iou", *more)))
    return ev, M.fn_threshold(V.gt(spark, d), ev)


@query("iou_match", with_views("matched", "select pred_id, match_id, iou from matched"))
def iou_match(spark, d):
    return matched(spark, d).select("pred_id", "match_id", "iou")


@query("classification_pairs", with_views("pred gt", """select pred_id, match_id, case when match_id is null then 0e0 else 1e0 end as iou
from pred left join (select frame_id, feature, min(label_id) as match_id from gt group by 1, 2) using (frame_id, feature)"""))
def classification_pairs(spark, d):
    return M.classification_pairs(V.pred(spark, d), V.gt(spark, d), ["frame_id", "feature"]).select("pred_id", "match_id", "iou")


@query("match_duplicate_iou", with_views("evaluated", "select pred_id, iou, match_duplicate_iou, tp from evaluated"))
def match_duplicate_iou(spark, d):
    return M.match_duplicate_iou(matched(spark, d)).select("pred_id", "iou", "match_duplicate_iou", M.is_tp(IOU).alias("tp"))


@query("fn_threshold", with_views("fn", "select label_id, iou_threshold from fn"))
def fn_threshold(spark, d):
    return M.fn_threshold(V.gt(spark, d), matched(spark, d)).select("label_id", "iou_threshold")


GREEDY = """win as (select * from (select match_id, confidence as wc, pred_id as wid, row_number() over
(partition by match_id order by confidence desc, pred_id) as rn from matched where match_id is not null and iou >= 0.5e0) where rn = 1),
greedy as (select m.*, w.wid is not null and w.wid = m.pred_id as tp, case when w.wid = m.pred_id then ''
 when m.match_id is null then concat('No overlapping label of class `', feature, '`.')
 when w.wid is not null and (confidence < wc or (confidence = wc and pred_id > wid)) then 'Prediction with higher confidence already matched label.'
 else 'IOU too low.' end as fp_reason from matched m left join win w on m.match_id = w.match_id)"""


@query("greedy_tp", with_views("matched", "select pred_id, tp from greedy", GREEDY))
def greedy_tp(spark, d):
    return M.greedy_tp(matched(spark, d), IOU).select("pred_id", "tp")


@query("fp_reason", with_views("matched", "select pred_id, fp_reason from greedy", GREEDY))
def fp_reason(spark, d):
    return M.greedy_tp(matched(spark, d), IOU).select("pred_id", "fp_reason")


@query("greedy_false_negatives", with_views("matched gt", "select label_id from gt where label_id not in (select match_id from greedy where tp)", GREEDY))
def greedy_false_negatives(spark, d):
    return M.false_negatives(V.gt(spark, d), M.greedy_tp(matched(spark, d), IOU)).select("label_id")


@query("annotation_duplicates", with_views("ann", """select frame_id, feature, o.obj_id, o.partner, score,
case when o.partner is null then 'Possible non duplicated object' else 'Possible duplicates' end as description from flag o
where not exists (select 1 from flag b where b.obj_id = o.partner and b.partner = o.obj_id and b.obj_id < o.obj_id)""",
f"""cand as (select a.obj_id, b.obj_id as other, {V.overlap("ix * iy / (a.w * a.h + b.w * b.h - ix * iy)")} as iou from ann a join ann b
 on a.frame_id = b.frame_id and a.feature = b.feature and a.obj_id <> b.obj_id,
 lateral (select least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) as ix, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) as iy)
 where ix > 0 and iy > 0),
top as (select * from (select *, case when iou > 0.9999999999e0 then 1e0 else iou end as score,
 row_number() over (partition by obj_id order by case when iou > 0.9999999999e0 then 1e0 else iou end desc, other) as rn from cand) where rn = 1),
flag as (select a.frame_id, a.feature, a.obj_id, case when t.score >= 0.6e0 then t.other end as partner, coalesce(t.score, 0e0) as score
 from ann a left join top t on a.obj_id = t.obj_id)"""))
def annotation_duplicates(spark, d):
    return M.annotation_duplicates(V.ann(spark, d))


COUNTS = f"""counts as (select feature, tp, n - tp as fp, coalesce(fn, 0) as fn, t0, t1, t2, t3, t4, t5 from (select feature,
count(*) filter (where tp) as tp, count(*) as n, {', '.join(
    f"count(*) filter (where iou >= {t}e0 and match_duplicate_iou < {t}e0) as t{i}" for i, t in enumerate(E.RECALL_IOUS))}
from evaluated group by 1) full join (select feature, count(*) filter (where iou_threshold < 0.5e0) as fn from fn group by 1) using (feature)),
prf as (select *, tp / greatest(tp + fp, 1) as precision, tp / greatest(tp + fn, 1) as recall from counts),
scored as (select *, 2 * precision * recall / greatest(precision + recall, 1e0) as f1_clamped,
case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end as f1,
0.2e0 * (t0 / 2e0 + t1 + t2 + t3 + t4 + t5 / 2e0) / greatest(tp + fn, 1) as average_recall from prf)"""


@query("confusion_counts", with_views("evaluated fn", "select feature, tp, fp, fn from counts", COUNTS))
def confusion_counts(spark, d):
    ev, fn = evaluated(spark, d)
    return E.confusion_counts(ev, fn, IOU).select("feature", "tp", "fp", "fn")


@query("precision_recall_f1", with_views("evaluated fn", """select feature, tp, fp, fn, precision, recall, round(f1_clamped, 9) as f1_clamped,
round(f1, 9) as f1 from scored""", COUNTS))
def precision_recall_f1(spark, d):
    ev, fn = evaluated(spark, d)
    return rounded(E.precision_recall_f1(E.confusion_counts(ev, fn, IOU)).drop("tp_at"), "f1_clamped", "f1")


@query("average_recall", with_views("evaluated fn", "select feature, round(average_recall, 9) as average_recall from scored", COUNTS))
def average_recall(spark, d):
    ev, fn = evaluated(spark, d)
    return rounded(E.average_recall(E.confusion_counts(ev, fn, IOU)).select("feature", "average_recall"), "average_recall")


CURVE = COUNTS + """, steps as (select e.feature, ctp, rn, case when tp + fn > 0 then ctp / (tp + fn) else 0e0 end as r from
(select feature, cast(ctp as bigint) as ctp, max(rn) as rn from (select feature, row_number() over w as rn, sum(cast(tp as int)) over w as ctp from evaluated
window w as (partition by feature order by confidence desc, pred_id rows unbounded preceding)) group by 1, 2) e join counts c on e.feature = c.feature),
curve as (select feature, floor(r * 1e2 + 0.5e0) / 1e2 as recall, max(ctp / rn) as precision from steps group by 1, 2),
ap as (select feature, avg(p) as average_precision from (select f.feature, t.t, coalesce(max(precision), 0e0) as p from
(select distinct feature from curve) f cross join (select unnest(range(11)) / 10e0 as t) t left join curve c on c.feature = f.feature and c.recall >= t.t
group by 1, 2) group by 1)"""


def _curve(spark, d):
    ev, fn = evaluated(spark, d)
    return E.pr_curve(ev, E.confusion_counts(ev, fn, IOU), IOU)


@query("pr_curve", with_views("evaluated fn", "select feature, recall, precision from curve", CURVE))
def pr_curve(spark, d):
    return _curve(spark, d)


@query("average_precision_11pt", with_views("evaluated fn", "select feature, round(average_precision, 9) as average_precision from ap", CURVE))
def average_precision_11pt(spark, d):
    return rounded(E.average_precision_11pt(_curve(spark, d)), "average_precision")


@query("pr_envelope", with_views("evaluated fn", """select feature, recall, max(precision) over (partition by feature order by recall desc) as precision from curve
union all select feature, unnest([1e0, r + 0.01e0]) as recall, 0e0 as precision from (select feature, max(recall) as r, max(precision) as p from curve group by 1)
where r <> 1 and p <> 0""", CURVE))
def pr_envelope(spark, d):
    return E.pr_envelope(_curve(spark, d))


@query("map_mar_101pt", with_views("matched gt", """select class_name, round(ap, 9) as ap, round(ar, 9) as ar from per
union all select 'Mean', round(avg(ap), 9), round(avg(ar), 9) from per""", GREEDY + """,
n as (select feature, count(*) as labels from gt group by 1),
st as (select g.feature, ctp / (labels + 2.220446049250313e-16) as rc, ctp / (rn + 2.220446049250313e-16) as pr from
(select feature, cast(row_number() over w as bigint) as rn, cast(sum(cast(tp as int)) over w as bigint) as ctp from greedy
window w as (partition by feature order by confidence desc, pred_id rows unbounded preceding)) g join n on g.feature = n.feature),
env as (select feature, i, coalesce(max(pr), 0e0) as p from (select feature, pr, rc, i from st join (select unnest(range(101)) as i) on i * 0.01e0 <= rc) group by 1, 2),
per as (select n.feature as class_name, coalesce((select sum(p) from env where env.feature = n.feature), 0e0) / 101 as ap,
coalesce((select max(rc) from st where st.feature = n.feature), 0e0) as ar from n)"""))
def map_mar_101pt(spark, d):
    g = cut_lineage(M.greedy_tp(matched(spark, d), IOU))
    return rounded(E.map_mar_101pt(g, V.gt(spark, d)), "ap", "ar")


@query("prediction_summary", with_views("evaluated fn", """select round(avg(average_precision), 9) as mAP, round(avg(average_recall), 9) as mAR,
round(avg(precision), 9) as mP, round(avg(recall), 9) as mR, round(avg(f1_clamped), 9) as mF1, cast(sum(tp) as bigint) as tTP, cast(sum(fp) as bigint) as tFP,
cast(sum(fn) as bigint) as tFN, (select count(distinct frame_id) from fn) as num_frames from scored join ap using (feature)""", CURVE))
def prediction_summary(spark, d):
    ev, fn = evaluated(spark, d)
    out = E.prediction_summary(ev, fn, IOU).drop("classification_tTN", "classification_accuracy")
    return rounded(out, "mAP", "mAR", "mP", "mR", "mF1")


@query("prediction_outcome", with_views("evaluated fn", """select pred_id as id, 'TP' as outcome from evaluated where tp
union all select pred_id, 'FP' from evaluated where not tp union all select label_id, 'FN' from fn where iou_threshold < 0.5e0"""))
def prediction_outcome(spark, d):
    ev, fn = evaluated(spark, d)
    parts = [X.prediction_outcome(ev, fn, o, IOU).select(F.col("label_id" if o == "FN" else "pred_id").alias("id"), F.lit(o).alias("outcome"))
             for o in ("TP", "FP", "FN")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


METRICS = ["m_quantity", "m_discount", "m_tax", "confidence"]


@query("metric_correlation", with_views("evaluated", " union all ".join(
    f"select '{m}' as metric, round(corr(cast(tp as int), {m}), 9) as correlation from evaluated" for m in METRICS)))
def metric_correlation(spark, d):
    ev, _ = evaluated(spark, d, "m_quantity", "m_discount", "m_tax")
    return rounded(E.metric_correlation(ev, METRICS, IOU), "correlation")


MI_METRICS = ["m_quantity", "m_discount", "m_tax"]


@query("metric_importance", with_views("evaluated", """select c.metric, round(sum(c.c / n.n * ln(c.c * n.n / (mx.c * my.c))), 9) as importance
from cells c join (select metric, bx, cast(sum(c) as double) as c from cells group by 1, 2) mx on c.metric = mx.metric and c.bx = mx.bx
join (select metric, b, cast(sum(c) as double) as c from cells group by 1, 2) my on c.metric = my.metric and c.b = my.b
join (select metric, cast(sum(c) as double) as n from cells group by 1) n on c.metric = n.metric group by 1""",
"cells as (select metric, floor(v * 1e1 + 0.5e0) / 1e1 as bx, floor(t * 1e1 + 0.5e0) / 1e1 as b, count(*) as c from (" + " union all ".join(
    f"select '{m}' as metric, {m} as v, iou * cast(tp as int) as t from evaluated" for m in MI_METRICS) + ") group by 1, 2, 3)"))
def metric_importance(spark, d):
    ev, _ = evaluated(spark, d, *MI_METRICS)
    return rounded(E.metric_importance(ev, MI_METRICS, IOU), "importance")


@query("performance_by_metric", with_views("evaluated fn", """select feature, bucket, tp / n as precision, n, fn / (fn + coalesce(n, 0)) as fn_rate_vs_predictions,
fn + coalesce(n, 0) as fn_n from (select feature, floor(m_quantity * 1e2 + 0.5e0) / 1e2 as bucket, count(*) filter (where tp) as tp, count(*) as n from evaluated group by 1, 2)
full join (select feature, floor(m_quantity * 1e2 + 0.5e0) / 1e2 as bucket, count(*) as fn from fn where iou_threshold < 0.5e0 group by 1, 2) using (feature, bucket)"""))
def performance_by_metric(spark, d):
    ev, fn = evaluated(spark, d, "m_quantity")
    return E.performance_by_metric(ev, fn, "m_quantity", IOU)


@query("performance_overall", with_views("evaluated", """select feature, bucket, tp / n as precision, n / max(n) over (partition by feature) as scaled_n,
round(avg(tp / n) over (partition by feature), 9) as reference from (select feature, bucket, count(*) filter (where tp) as tp, cast(count(*) as double) as n from
(select feature, floor(m_quantity * 1e1 + 0.5e0) / 1e1 as bucket, tp from evaluated union all select 'Average', floor(m_quantity * 1e1 + 0.5e0) / 1e1, tp from evaluated)
group by 1, 2)"""))
def performance_overall(spark, d):
    ev, _ = evaluated(spark, d, "m_quantity")
    return rounded(E.performance_overall(ev, "m_quantity", IOU, 1), "reference")


@query("performance_qcut", with_views("evaluated", """select round((lo + hi) / 2, 9) as bin, round(avg(i), 9) as average, count(*) as n from
(select e.tp::int as i, case when m <= edges[1] then edges[1] else list_max(list_filter(edges, lambda z: z < m)) end as lo,
case when m <= edges[1] then edges[2] else list_min(list_filter(edges, lambda z: z >= m)) end as hi
from (select confidence as m, tp from evaluated) e, (select list_sort(list_distinct(quantile_cont(confidence, (select list(i / 20e0 order by i) from (select unnest(range(21)) as i))))) as edges
from evaluated) q) group by 1""".replace("(select list(i / 20e0 order by i) from (select unnest(range(21)) as i))", "[" + ", ".join(str(i / 20) for i in range(21)) + "]")))
def performance_qcut(spark, d):
    ev, _ = evaluated(spark, d)
    return rounded(E.performance_qcut(ev, "confidence", M.is_tp(IOU), 20), "bin", "average")


@query("confusion_matrix", with_views("clf", """select gt_class, count(*) filter (where pred_class = 0) as "0", count(*) filter (where pred_class = 1) as "1"
from clf group by 1"""))
def confusion_matrix(spark, d):
    return E.confusion_matrix(V.clf(spark, d), [0, 1])


@query("classification_report", with_views("clf", """select class, case when predicted > 0 then tp / predicted else 0e0 end as precision,
case when support > 0 then tp / support else 0e0 end as recall, round(case when tp > 0 then 2e0 * (tp / predicted) * (tp / support) / (tp / predicted + tp / support)
else 0e0 end, 9) as f1, support, (select avg(cast(gt_class = pred_class as int)) from clf) as accuracy from
(select k.class, count(*) filter (where gt_class = k.class and pred_class = k.class) as tp, count(*) filter (where gt_class = k.class) as support,
count(*) filter (where pred_class = k.class) as predicted from clf, (select gt_class as class from clf union select pred_class from clf) k group by 1)"""))
def classification_report(spark, d):
    return rounded(E.classification_report(V.clf(spark, d)), "f1")


@query("dedupe_counts", with_views("gt", "select count(distinct (frame_id, feature)) as num_frames from gt"))
def dedupe_counts(spark, d):
    return E.dedupe_counts(V.gt(spark, d), ["frame_id", "feature"])


@query("classification_match", """select d.doc_id as unit_id, d.pred as class_id, cast(l.quality as bigint) as true_class, coalesce(l.quality = d.pred, false) as tp
from (select doc_id, cast(case when n_chars > 1500 then 1 else 0 end as bigint) as pred from documents) d left join labels l on d.doc_id = l.doc_id""")
def classification_match(spark, d):
    p = V.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).cast("long").alias("class_id"))
    truth = V.table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), F.col("quality").cast("long").alias("class_id"))
    return E.classification_match(p, truth, ["unit_id"])


@query("class_union", with_views("pred gt", "select feature from pred union select feature from gt"))
def class_union(spark, d):
    return E.class_union(V.pred(spark, d), V.gt(spark, d))


@query("frame_intersection", with_views("pred gt", "select frame_id, feature from pred intersect select frame_id, feature from gt"))
def frame_intersection(spark, d):
    p, g = V.pred(spark, d), V.gt(spark, d)
    return E.frame_intersection(p, g, ["frame_id", "feature"])


@query("frame_object_density", with_views("ann", """select frame_id, round(coalesce(100 * sum((xb - xa) * len), 0e0), 6) as density from
(select frame_id, xa, xb, greatest(y1 - greatest(y0, coalesce(max(y1) over (partition by frame_id, xa order by y0, y1 rows between unbounded preceding and 1 preceding), y0)), 0) as len
from (select s.frame_id, xa, xb, b.y as y0, b.y + b.h as y1 from slab s join box b on s.frame_id = b.frame_id and b.x <= xa and b.x + b.w >= xb)) group by 1""",
"""box as (select distinct frame_id, x, y, w, h from ann),
slab as (select frame_id, xa, lead(xa) over (partition by frame_id order by xa) as xb from (select frame_id, x as xa from box union select frame_id, x + w from box))"""))
def frame_object_density(spark, d):
    a = V.ann(spark, d)
    return rounded(D.frame_object_density(a.select("frame_id").distinct(), a, ["frame_id"]), "density", digits=6)


TRACKS = """p as (select *, dense_rank() over (partition by seq_id order by frame) as pos from trk)"""


def _best(name: str, back: int, same_class: bool) -> str:
    cond = "and a.feature = b.feature" if same_class else ""
    return f"""{name} as (select * from (select obj_id, other, track, cls, iou, row_number() over (partition by obj_id order by iou desc, other) as rn from
(select a.obj_id, b.obj_id as other, b.track_id as track, b.feature as cls, {V.overlap("ix * iy / (a.w * a.h + b.w * b.h - ix * iy)")} as iou from p a join p b
on a.seq_id = b.seq_id and a.pos - {back} = b.pos {cond},
lateral (select least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) as ix, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) as iy) where ix > 0 and iy > 0)) where rn = 1)"""


@query("track_consistency", with_views("trk", """select seq_id, frame, p.obj_id, case when v.iou > 0.8e0 and v.track <> p.track_id then 1 - v.iou else 1e0 end as score,
case when v.iou > 0.8e0 and v.track <> p.track_id then case when v.cls <> p.feature then 'overlaps with another class' else 'different track ids' end else '' end as description
from p left join v on p.obj_id = v.obj_id where pos > 1""", TRACKS + ", " + _best("v", 1, False)))
def track_consistency(spark, d):
    return Q.track_consistency(V.trk(spark, d))


@query("missing_or_broken_tracks", with_views("trk", """select obj_id, min(score) as score from (select
case when o.iou >= 0.25e0 and not coalesce(m.iou > 0.5e0, false) then o.other else p.obj_id end as obj_id,
case when not coalesce(o.iou >= 0.25e0, false) then 1e0 when not coalesce(m.iou > 0.5e0, false) then 0e0
when o.track = p.track_id and m.track = p.track_id then 1e0 else 0.5e0 end as score
from p left join o on p.obj_id = o.obj_id left join m on p.obj_id = m.obj_id where pos > 2) group by 1""",
TRACKS + ", " + _best("o", 2, True) + ", " + _best("m", 1, True)))
def missing_or_broken_tracks(spark, d):
    return Q.missing_or_broken_tracks(V.trk(spark, d))


def _best_shape(name: str, back: int, same_class: bool, where: str = "") -> str:
    """Best partner among mixed shapes: overlaps are summed over the disjoint rectangles of both."""
    cond = "and a.cls is not distinct from b.cls" if same_class else ""
    return f"""{name} as (select * from (select *, row_number() over (partition by obj_id order by iou desc, other) as rn from (
select obj_id, other, track, cls, {V.overlap("sum(ix * iy) / (max(aa) + max(ba) - sum(ix * iy))")} as iou from (
select a.obj_id, b.obj_id as other, b.track_id as track, b.cls as cls, a.area as aa, b.area as ba,
least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) as ix, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) as iy
from prect a join prect b on a.seq_id = b.seq_id and a.pos - {back} = b.pos {cond} {where}) where ix > 0 and iy > 0 group by 1, 2, 3, 4)) where rn = 1)"""


POSED = V.SHAPE_SQL + """, place as (select seq_id, frame, row_number() over (partition by seq_id order by frame) as pos from (select distinct seq_id, frame from obj)),
prect as (select r.*, pos from rect r join place using (seq_id, frame)), pobj as (select o.*, pos from obj o join place using (seq_id, frame))"""


@query("annotation_duplicates_polygons", with_views("trk", """select seq_id, frame, cls as feature, o.obj_id, score,
case when o.partner is null then 'Possible non duplicated object' else 'Possible duplicates' end as description from flag o
where not exists (select 1 from flag b where b.obj_id = o.partner and b.partner = o.obj_id and b.obj_id < o.obj_id)""",
POSED + ", " + _best_shape("top", 0, True, "and a.obj_id <> b.obj_id") + """,
flag as (select o.seq_id, o.frame, o.cls, o.obj_id, case when t.iou >= 0.6e0 then t.other end as partner, coalesce(t.iou, 0e0) as score
from pobj o left join top t on o.obj_id = t.obj_id)"""))
def annotation_duplicates_polygons(spark, d):
    return M.annotation_duplicates(V.shapes(spark, d), ["seq_id", "frame", "feature"]).drop("partner")


@query("track_consistency_polygons", with_views("trk", """select seq_id, frame, p.obj_id,
case when v.iou > 0.8e0 and v.track <> p.track_id then 1 - v.iou else 1e0 end as score from pobj p left join v on p.obj_id = v.obj_id where pos > 1""",
POSED + ", " + _best_shape("v", 1, False)))
def track_consistency_polygons(spark, d):
    return Q.track_consistency(V.shapes(spark, d)).drop("description")


@query("missing_tracks_polygons", with_views("trk", """select obj_id, min(score) as score from (select
case when o.iou >= 0.25e0 and not coalesce(m.iou > 0.5e0, false) then o.other else p.obj_id end as obj_id,
case when not coalesce(o.iou >= 0.25e0, false) then 1e0 when not coalesce(m.iou > 0.5e0, false) then 0e0
when o.track = p.track_id and m.track = p.track_id then 1e0 else 0.5e0 end as score
from pobj p left join o on p.obj_id = o.obj_id left join m on p.obj_id = m.obj_id where pos > 2) group by 1""",
POSED + ", " + _best_shape("o", 2, True) + ", " + _best_shape("m", 1, True)))
def missing_tracks_polygons(spark, d):
    return Q.missing_or_broken_tracks(V.shapes(spark, d))


@query("density_polygons", with_views("trk", """select seq_id, frame, round(coalesce(100 * sum((xb - xa) * len), 0e0), 6) as density from
(select seq_id, frame, xa, xb, greatest(y1 - greatest(y0, coalesce(max(y1) over (partition by seq_id, frame, xa order by y0, y1 rows between unbounded preceding and 1 preceding), y0)), 0) as len
from (select s.seq_id, s.frame, xa, xb, b.y as y0, b.y + b.h as y1 from slab s join box b on s.seq_id = b.seq_id and s.frame = b.frame and b.x <= xa and b.x + b.w >= xb)) group by 1, 2""",
V.SHAPE_SQL + """, box as (select distinct seq_id, frame, x, y, w, h from rect),
slab as (select seq_id, frame, xa, lead(xa) over (partition by seq_id, frame order by xa) as xb from (select seq_id, frame, x as xa from box union select seq_id, frame, x + w from box))"""))
def density_polygons(spark, d):
    a = V.shapes(spark, d)
    return rounded(D.frame_object_density(a.select("seq_id", "frame").distinct(), a, ["seq_id", "frame"]), "density", digits=6)


@query("shape_similarity", """with e as (select event_id, user_id, [value, cast(event_id % 97 as double), 10e0 + value / 3] as v,
row_number() over (partition by user_id order by ts, event_id) - 1 as p from events),
s as (select event_id, p, v, sum(v[1] * k) over w as a, sum(v[2] * k) over w as b, sum(v[3] * k) over w as c from
(select *, power(2e0, p) * (case when p = 0 then 2e0 else 1e0 end) as k from e)
window w as (partition by user_id order by p rows between unbounded preceding and 1 preceding))
select event_id, round(case when p = 0 then 1e0 else (a * v[1] + b * v[2] + c * v[3]) / (sqrt(a * a + b * b + c * c) * sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) end, 6) as score from s""")
def shape_similarity(spark, d):
    e = V.table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.array(F.col("value"), (F.col("event_id") % 97).cast("double"), F.lit(10.0) + F.col("value") / 3).alias("v"))
    return rounded(Q.shape_similarity(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], "v", 3), "score", digits=6).select("event_id", "score")


@query("occlusion", with_views("trk", """select obj_id, round(case when dist > 0.3e0 and da < 0 then 1 / dist else 100e0 end, 6) as score,
case when not (dist > 0.3e0 and da < 0) then 'There is no occlusion' when dist > 0.7e0 then 'There is a high probability of occlusion'
when dist > 0.4e0 then 'There is a moderate probability of occlusion' else 'There is a low probability of occlusion' end as description from
(select obj_id, da, sqrt(da * da + dr * dr) as dist from (select obj_id,
(a - avg(a) over t) / nullif(max(a) over t - min(a) over t, 0) as da, coalesce((r - avg(r) over t) / nullif(max(r) over t - min(r) over t, 0), 0) as dr, count(*) over t as n
from (select *, w * h as a, w / h as r from trk) window t as (partition by seq_id, track_id)) where n >= 5)"""))
def occlusion(spark, d):
    return rounded(Q.occlusion(V.trk(spark, d), ["seq_id", "track_id"], "obj_id").select("obj_id", "score", "description"), "score", digits=6)


_DIMS = range(1, 8)


@query("shape_outlier", with_views("emb", f"""select vec_id, label, round(1 / case when d = 0 then (select min(d) from dist where d > 0) else d end, 6) as score from dist""",
f"""st as (select {', '.join(f'stddev_pop(embedding[{i}]::double) as s{i}' for i in _DIMS)} from emb),
ce as (select label, {', '.join(f'avg(embedding[{i}]::double) as c{i}' for i in _DIMS)} from emb group by 1),
dist as (select vec_id, e.label, sqrt({' + '.join(f'((embedding[{i}]::double - c{i}) / s{i}) ** 2' for i in _DIMS)}) as d from emb e join ce on e.label = ce.label, st)"""))
def shape_outlier(spark, d):
    return rounded(Q.shape_outlier(V.emb(spark, d), "vec_id", "label", "embedding", 7), "score", digits=6)


@query("track_ids", with_views("ann", """select obj_id, l_partkey, dense_rank() over (order by l_partkey) - 1 as track_id, row_number() over (order by obj_id) - 1 as annotation_id from ann"""))
def track_ids(spark, d):
    return Q.track_ids(V.ann(spark, d).select("obj_id", "l_partkey"), "l_partkey", ["obj_id"])


def box_columns():
    return tuple(F.col(c) for c in "xywh")


@query("box_geometry", with_views("ann", """select obj_id, w * h * 100e0 as relative_area, cast(floor(1920e0 * 1080e0 * (w * h)) as bigint) as absolute_area,
(w * 1920e0) / (h * 1080e0) as aspect, greatest(x + w, y + h, 1e0 - x, 1e0 - y) as closeness, x + w <= 1 and y + h <= 1 as valid,
round(w * h, 9) as polygon_area, x + w as x2, y + h as y2, floor(x * 1920e0 * 100e0 + 0.5e0) / 100e0 as px from ann"""))
def box_geometry(spark, d):
    pts = B.box_points(*box_columns())
    W_, H_ = F.lit(1920.0), F.lit(1080.0)
    a = V.dealt(V.ann(spark, d)).withColumn("pts", pts)
    return a.select(
        "obj_id", B.relative_area(F.col("w") * F.col("h")).alias("relative_area"), B.absolute_area(F.col("w") * F.col("h"), W_, H_).alias("absolute_area"),
        B.object_aspect_ratio(F.col("w"), F.col("h"), W_, H_).alias("aspect"), B.border_closeness(F.col("pts")).alias("closeness"),
        B.box_valid(*box_columns()).alias("valid"), F.round(B.polygon_area(F.col("pts")), 9).alias("polygon_area"),
        B.polygon_bounds(F.col("pts"))["x2"].alias("x2"), B.polygon_bounds(F.col("pts"))["y2"].alias("y2"),
        B.pixel_bounds(F.col("pts"), W_, H_)["x1"].alias("px"),
    )


@query("rotated_box_points", with_views("ann", """select obj_id, round(cx + dx * cos(t) - dy * sin(t), 6) as x1, round(cy + dx * sin(t) + dy * cos(t), 6) as y1 from
(select obj_id, radians(l_suppkey % 360) as t, x * 1920e0 + w * 1920e0 / 2 as cx, y * 1080e0 + h * 1080e0 / 2 as cy, -(w * 1920e0) / 2 as dx, -(h * 1080e0) / 2 as dy from ann)"""))
def rotated_box_points(spark, d):
    theta = (F.col("l_suppkey") % 360).cast("double")
    p = B.rotated_box_points(*box_columns(), theta, F.lit(1920.0), F.lit(1080.0))
    return V.dealt(V.ann(spark, d)).select("obj_id", F.round(p[0]["x"], 6).alias("x1"), F.round(p[0]["y"], 6).alias("y1"))


@query("frame_shape", with_views("unit", """select unit_id, case when m_chars > 0 and m_spaces > 0 then m_chars * m_spaces end as area,
case when m_chars > 0 and m_spaces > 0 then m_chars / m_spaces end as aspect from unit"""))
def frame_shape(spark, d):
    w, h = F.col("m_chars"), F.col("m_spaces")
    return V.unit(spark, d).select("unit_id", B.frame_area(w, h).alias("area"), B.frame_aspect_ratio(w, h).alias("aspect"))


@query("crop_box", with_views("ann", """select obj_id, greatest(px, 0e0) as x, greatest(py, 0e0) as y, least(px + pw, 400e0) - greatest(px, 0e0) as w,
least(py + ph, 300e0) - greatest(py, 0e0) as h from (select obj_id, x * 1000 - 60 as px, y * 1000 - 60 as py, w * 1000 as pw, h * 1000 as ph from ann)
where px <= 400 and py <= 300"""))
def crop_box(spark, d):
    a = V.ann(spark, d).select("obj_id", *[(F.col(c) * 1000 - o).alias(f"b{c}") for c, o in (("x", 60), ("y", 60))], *[(F.col(c) * 1000).alias(f"b{c}") for c in "wh"])
    box = B.crop_box(F.col("bx"), F.col("by"), F.col("bw"), F.col("bh"), F.lit(400.0), F.lit(300.0))
    return a.select("obj_id", box.alias("b")).where("b is not null").select("obj_id", "b.*")
