"""Queries of the summary and filter families."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import scalar as S
from gaugeframe.operators import filters as X, summary as A
from gaugeframe.registry import Metric, MetricRegistry, NORMAL
from gaugeframe.workload import views as V
from gaugeframe.workload.views import with_views

ANN_METRICS = ["m_quantity", "m_discount", "m_tax", "m_price"]
UNIT_METRICS = ["m_chars", "m_spaces"]
DATE_LO, DATE_HI = "1995-01-01 00:00:00", "1997-06-30 00:00:00"

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _unpivot(src: str, metrics: list[str], keep: str = "", where: str = "") -> str:
    return " union all ".join(
        f"select {keep}'{m}' as metric, cast({m} as double) as value from {src} where {m} is not null {where}" for m in metrics
    )


def _summary_ctes(src: str, metrics: list[str], where: str = "") -> str:
    return f"""long as ({_unpivot(src, metrics, where=where)}),
pos as (select metric, value, row_number() over (partition by metric order by value) - 1 as i, count(*) over (partition by metric) as n from long),
st as (select metric, max(n) as n, min(value) as mn, max(value) as mx, min(case when i = n // 4 then value end) as q1,
       min(case when i = n // 2 then value end) as q2, min(case when i = 3 * n // 4 then value end) as q3 from pos group by metric)"""


def _summary_body(extra_col: str = "") -> str:
    return f"""select l.metric, st.n as count, mn as min, q1, q2 as median, q3, mx as max,
       count(*) filter (where (value < q1 - (q3 - q1) * 1.5e0 or value > q3 + (q3 - q1) * 1.5e0)
                        and value >= q1 - (q3 - q1) * 2.5e0 and value <= q3 + (q3 - q1) * 2.5e0) as moderate,
       count(*) filter (where value < q1 - (q3 - q1) * 2.5e0 or value > q3 + (q3 - q1) * 2.5e0) as severe {extra_col}
from long l join st on l.metric = st.metric group by l.metric, st.n, mn, q1, q2, q3, mx"""


FILTERED = {"m_quantity": (0.2, 0.9), "m_tax": (0.0, 0.06)}
FILTER_SQL = "and m_quantity between 0.2e0 and 0.9e0 and m_tax between 0e0 and 0.06e0 and feature in ('A', 'N')"


@query("metric_summary", with_views("ann", _summary_body(), _summary_ctes("ann", ANN_METRICS, FILTER_SQL)))
def metric_summary(spark, d):
    rows = X.filter_enum(X.filter_metric_range(V.ann(spark, d), FILTERED), {"feature": ["A", "N"]})
    return A.metric_summary(rows, ANN_METRICS)


@query("domain_summary", with_views("unit", _summary_body(", (select count(*) from unit where project = 'A') as total"),
       _summary_ctes("unit", UNIT_METRICS, "and project = 'A'")))
def domain_summary(spark, d):
    return A.domain_summary(X.filter_project(V.unit(spark, d), ["A"]), UNIT_METRICS)


def _bucket(c: str, digits: int) -> str:
    return f"floor({c} * 1e{digits} + 0.5e0) / 1e{digits}"


@query("distribution", with_views("ann", f"select {_bucket('m_quantity', 1)} as bucket, count(*) as count from ann group by 1"))
def distribution(spark, d):
    return A.distribution(V.ann(spark, d), "m_quantity", S.digits_for(10))


@query("distribution_enum", with_views("ann", "select feature as bucket, count(*) as count from ann group by 1"))
def distribution_enum(spark, d):
    return A.distribution(V.ann(spark, d), "feature")


@query("scatter", with_views("ann", f"""select {_bucket('m_quantity', 2)} as x, {_bucket('m_tax', 1)} as y, count(*) as count
from ann group by 1, 2"""))
def scatter(spark, d):
    return A.scatter(V.ann(spark, d), "m_quantity", "m_tax", 2, 1)


@query("embedding_density", with_views("emb", f"""select {_bucket('cast(embedding[1] as double)', 1)} as x,
{_bucket('cast(embedding[2] as double)', 1)} as y, count(*) as count, (select count(*) from emb) as total from emb group by 1, 2"""))
def embedding_density(spark, d):
    return A.embedding_density(points(spark, d), 1)


def points(spark, d):
    """The first two vector components as a 2-D reduction."""
    return V.emb(spark, d).select(
        "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label"
    )


def _iqr_sql(src: str, metrics: list[str], keep: str) -> str:
    """CTEs long, q (linear quartiles), st (distance and status)."""
    return f"""long as ({_unpivot(src, metrics, keep)}),
q as (select metric, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from long group by metric),
st as (select l.*, case when value > q3 then value - q3 when value < q1 then q1 - value else 0e0 end as distance,
       case when value < q1 - (q3 - q1) * 2.5e0 or value > q3 + (q3 - q1) * 2.5e0 then 'Severe'
            when value < q1 - (q3 - q1) * 1.5e0 or value > q3 + (q3 - q1) * 1.5e0 then 'Moderate' else 'Low' end as status
       from long l join q on l.metric = q.metric)"""


@query("iqr_outliers", with_views("unit", "select unit_id, metric, value, distance, status from st",
       _iqr_sql("unit", UNIT_METRICS, "unit_id, ")))
def iqr_outliers(spark, d):
    return A.iqr_outliers(V.unit(spark, d), UNIT_METRICS, ["unit_id"])


@query("all_metric_outliers", with_views("unit", """select metric, count(*) filter (where status = 'Severe') as severe,
count(*) filter (where status = 'Moderate') as moderate from st group by metric""", _iqr_sql("unit", UNIT_METRICS, "unit_id, ")))
def all_metric_outliers(spark, d):
    return A.all_metric_outliers(V.unit(spark, d), UNIT_METRICS)


@query("unique_outlier_items", with_views("unit", """select
count(distinct unit_id) filter (where status = 'Severe') as severe_items,
count(distinct unit_id) filter (where status = 'Moderate') as moderate_items,
count(*) filter (where status = 'Severe') as severe_total, count(*) filter (where status = 'Moderate') as moderate_total,
count(distinct metric) filter (where status = 'Severe') as severe_metrics,
count(distinct metric) filter (where status = 'Moderate') as moderate_metrics from st""", _iqr_sql("unit", UNIT_METRICS, "unit_id, ")))
def unique_outlier_items(spark, d):
    return A.unique_outlier_items(V.unit(spark, d), UNIT_METRICS, ["unit_id"])


@query("annotator_stats", """select c_mktsegment as annotator, count(*) as annotations, round(avg(o_totalprice), 6) as mean_score
from orders join customer on o_custkey = c_custkey group by 1""")
def annotator_stats(spark, d):
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    rows = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_mktsegment"), o.o_custkey == c.c_custkey)
    return A.annotator_stats(rows, "c_mktsegment", "o_totalprice").withColumn("mean_score", F.round("mean_score", 6))


@query("annotation_counts", """select p_partkey as class_id, p_name as class_name, coalesce(c, 0) as count from part
left join (select l_partkey, count(*) as c from lineitem group by 1) on p_partkey = l_partkey""")
def annotation_counts(spark, d):
    labels = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("class_id"))
    ontology = V.table(spark, d, "part").select(F.col("p_partkey").alias("class_id"), F.col("p_name").alias("class_name"))
    return A.annotation_counts(labels, ontology, "class_id")


@query("image_size_median", with_views("unit", """select pick.a as width, pick.b as height from
(select *, row_number() over (order by width * height) - 1 as i, count(*) over () as n,
min(struct_pack(a := width, b := height)) over (partition by width * height) as pick
from (select m_chars as width, m_spaces as height from unit)) where i = n // 2"""))
def image_size_median(spark, d):
    return A.image_size_median(V.unit(spark, d), "m_chars", "m_spaces")


@query("undersampled_classes", """with c as (select concat(p_brand, ' ', p_size) as class, count(*) as count from lineitem join part on l_partkey = p_partkey group by 1),
m as (select quantile_cont(count, 0.5) as med, max(case when i = n // 2 then count end) as mid from
(select count, row_number() over (order by count desc) - 1 as i, count(*) over () as n from c))
select class, count, count <= med / 2e0 as undersampled, count <= mid / 2e0 as undersampled_by_middle from c, m""")
def undersampled_classes(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_size").alias("class"))
    li = V.table(spark, d, "lineitem").select("l_partkey")
    return A.undersampled_classes(li.join(p, li.l_partkey == p.p_partkey), "class")


@query("project_stats", with_views("unit", """select u.project, u.units, u.frames, coalesce(l.annotations, 0) as annotations,
coalesce(l.classes, 0) as classes from (select project, count(distinct source) as units, count(unit_id) as frames from unit group by 1) u
left join (select project, count(*) as annotations, count(distinct quality) as classes from labels join unit on doc_id = unit_id
group by 1) l on u.project = l.project"""))
def project_stats(spark, d):
    u = V.unit(spark, d)
    labels = V.table(spark, d, "labels").join(u.select("unit_id", "project"), F.col("doc_id") == F.col("unit_id"))
    return A.project_stats(u, labels.select("project", "quality"), "project", "source", "unit_id", "quality")


@query("ks_dissimilarity", with_views("unit", f"""select metric, max(abs(cast(ca as double) / na - cast(cb as double) / nb)) as ks from
(select metric, value, sum(a) over (partition by metric order by value) as ca, sum(b) over (partition by metric order by value) as cb,
sum(a) over (partition by metric) as na, sum(b) over (partition by metric) as nb from
(select metric, value, count(*) filter (where project = 'A') as a, count(*) filter (where project <> 'A') as b from
({_unpivot('unit', UNIT_METRICS, 'project, ')}) group by 1, 2)) group by metric"""))
def ks_dissimilarity(spark, d):
    return A.ks_dissimilarity(V.unit(spark, d), UNIT_METRICS, F.col("project") == "A")


@query("running_stats", """select event_type as metric, min(value) as min, max(value) as max, round(avg(value), 6) as mean,
count(value) as count from events group by 1""")
def running_stats(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("metric"), "value")
    return A.running_stats(e, "metric", "value").withColumn("mean", F.round("mean", 6))


@query("running_stats_vectors", with_views("emb", """select label, round(min(n), 6) as min, round(max(n), 6) as max, round(avg(n), 6) as mean, count(n) as count from
(select label, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from emb) group by 1"""))
def running_stats_vectors(spark, d):
    e = V.emb(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return A.running_stats(e, "label", "embedding").select(
        "label", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")], "count"
    )


@query("object_count", """select o_orderkey as frame_id, coalesce(c, 0) as object_count from orders left join
(select l_orderkey, count(*) as c from lineitem group by 1) on o_orderkey = l_orderkey""")
def object_count(spark, d):
    units = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"))
    objects = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"))
    return A.object_count(units, objects, "frame_id")


@query("ols_trend", with_views("ann", """select feature, round(regr_slope(m_price, m_quantity), 6) as slope,
round(regr_intercept(m_price, m_quantity), 4) as intercept, count(*) as n from ann group by 1"""))
def ols_trend(spark, d):
    t = A.ols_trend(V.ann(spark, d), "m_quantity", "m_price", ["feature"])
    return t.select("feature", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("annotation_time", """select c_custkey as label_id, coalesce(ms / 1000e0, 0e0) as seconds from customer left join
(select o_custkey, sum(cast(o_totalprice as bigint)) as ms from orders group by 1) on c_custkey = o_custkey""")
def annotation_time(spark, d):
    labels = V.table(spark, d, "customer").select(F.col("c_custkey").alias("label_id"))
    logs = V.table(spark, d, "orders").select(F.col("o_custkey").alias("label_id"), F.rint("o_totalprice").cast("long").alias("ms"))
    return A.annotation_time(labels, logs, "label_id", "ms")


@query("metric_catalog", with_views("ann", f"""select metric, metric as title, 'normal' as kind, min(value) as min, max(value) as max,
count(value) as count from ({_unpivot('ann', ANN_METRICS)}) group by 1"""))
def metric_catalog(spark, d):
    return A.metric_catalog(V.ann(spark, d), ANN_METRICS)


@query("filter_metric_range", with_views("ann", """select obj_id, m_quantity, m_discount from ann
where m_quantity between 0.2e0 and 0.4e0 and m_discount = 0.05e0"""))
def filter_metric_range(spark, d):
    r = X.filter_metric_range(V.ann(spark, d), {"m_quantity": (0.2, 0.4), "m_discount": (0.05, 0.05)})
    return r.select("obj_id", "m_quantity", "m_discount")


@query("filter_enum", with_views("ann", "select obj_id, feature, kind from ann where feature in ('A', 'R') and kind = 'F'"))
def filter_enum(spark, d):
    return X.filter_enum(V.ann(spark, d), {"feature": ["A", "R"], "kind": ["F"]}).select("obj_id", "feature", "kind")


@query("filter_tags", with_views("tag", "select unit_id, m_chars from unit where unit_id in (select unit_id from tag where tag in ('t0', 't2'))"))
def filter_tags(spark, d):
    return X.filter_tags(V.unit(spark, d), V.tag(spark, d), ["t0", "t2"], ["unit_id"]).select("unit_id", "m_chars")


@query("filter_embedding_box", with_views("emb", """select vec_id, label from emb where embedding[1] between 0 and 0.15e0
and embedding[2] between -0.1e0 and 0.1e0"""))
def filter_embedding_box(spark, d):
    return X.filter_embedding_box(V.emb(spark, d), points(spark, d), ["vec_id"], 0.0, -0.1, 0.15, 0.1).select("vec_id", "label")


@query("filter_project", with_views("unit", "select unit_id, project from unit where project in ('B')"))
def filter_project(spark, d):
    return X.filter_project(V.unit(spark, d), ["B"]).select("unit_id", "project")


def _registry(metrics, enums=()):
    return MetricRegistry.of([Metric(m, NORMAL, m) for m in metrics], {e: None for e in enums})


@query("apply_search", with_views("ann", """select obj_id, feature, m_quantity from ann where m_quantity between 0.1e0 and 0.5e0
and feature in ('N') and l_orderkey in (select o_orderkey from orders where o_totalprice between 100000e0 and 300000e0 and
o_orderkey % 4 in (0, 2))"""))
def apply_search(spark, d):
    orders = V.table(spark, d, "orders")
    data = X.Domain(
        "data", orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), ("l_orderkey",), _registry(["o_totalprice"]),
        tags=orders.select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("k"), (F.col("o_orderkey") % 4).cast("string")).alias("tag")),
    )
    labels = X.Domain("annotation", V.ann(spark, d), ("l_orderkey", "obj_id"), _registry(ANN_METRICS, ["feature"]))
    out = X.apply_search(
        labels, data, data_filters=X.Filters(metrics={"o_totalprice": (100000.0, 300000.0)}, tags=["k0", "k2"]),
        annotation_filters=X.Filters(metrics={"m_quantity": (0.1, 0.5)}, enums={"feature": ["N"]}),
    )
    return out.select("obj_id", "feature", "m_quantity")


def merged(spark, d):
    """Frame rows (orders) and label rows (lineitem) in one table, as the merged metrics hold them."""
    frames = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("frame_id"), F.lit(None).cast("string").alias("obj_id"), F.lit(None).cast("string").alias("object_class"),
        F.col("o_totalprice").alias("frame_score"), F.lit(None).cast("double").alias("label_score"),
        F.col("o_orderdate").alias("edited"),
    )
    labels = V.ann(spark, d).select(
        F.col("l_orderkey").alias("frame_id"), "obj_id", F.col("feature").alias("object_class"),
        F.lit(None).cast("double").alias("frame_score"), F.col("m_price").alias("label_score"), F.col("l_shipdate").alias("edited"),
    )
    return frames.unionByName(labels)


MERGED_SQL = """merged as (select o_orderkey as frame_id, null as obj_id, null as object_class, o_totalprice as frame_score,
cast(null as double) as label_score, o_orderdate as edited from orders union all
select l_orderkey, obj_id, feature, null, m_price, l_shipdate from ann)"""


@query("filter_categorical_keep_na", with_views("ann", """select frame_id, obj_id, object_class from (
select *, max(case when object_class = 'R' then 1 else 0 end) over (partition by frame_id) as hit from merged) where object_class = 'R'
or (object_class is null and hit = 1)""", MERGED_SQL))
def filter_categorical_keep_na(spark, d):
    return X.filter_categorical_keep_na(merged(spark, d), "object_class", ["R"], ["frame_id"]).select("frame_id", "obj_id", "object_class")


@query("filter_range_keep_na", with_views("ann", """select frame_id, obj_id, label_score from (
select *, max(case when label_score between 1000e0 and 20000e0 then 1 else 0 end) over (partition by frame_id) as hit from merged)
where label_score between 1000e0 and 20000e0 or (label_score is null and hit = 1)""", MERGED_SQL))
def filter_range_keep_na(spark, d):
    return X.filter_range_keep_na(merged(spark, d), "label_score", 1000.0, 20000.0, ["frame_id"]).select("frame_id", "obj_id", "label_score")


@query("filter_date_range_keep_na", with_views("ann", f"""select frame_id, obj_id from merged where edited between timestamp '{DATE_LO}'
and timestamp '{DATE_HI}'""", MERGED_SQL))
def filter_date_range_keep_na(spark, d):
    m = merged(spark, d)
    lo, hi = (F.to_timestamp_ntz(F.lit(x)) for x in (DATE_LO, DATE_HI))
    return X._keep_na(m, "edited", F.col("edited").between(lo, hi), ["frame_id"]).select("frame_id", "obj_id")


@query("filter_text", "select doc_id, source from documents where regexp_matches(text, '[0-9]{3}-[0-9]{2}')")
def filter_text(spark, d):
    return X.filter_text(V.table(spark, d, "documents"), "text", "[0-9]{3}-[0-9]{2}").select("doc_id", "source")


@query("filter_object_class", with_views("ann", """select frame_id, obj_id from merged where object_class = 'A' or
(object_class is null and frame_id not in (select l_orderkey from ann))""", MERGED_SQL))
def filter_object_class(spark, d):
    return X.filter_object_class(merged(spark, d), ["A", X.NO_CLASS], ["frame_id"]).select("frame_id", "obj_id")


@query("filter_object_class_data", with_views("ann", """select frame_id, frame_score from merged where object_class is null
and frame_id in (select l_orderkey from ann where feature in ('A'))""", MERGED_SQL))
def filter_object_class_data(spark, d):
    return X.filter_object_class(merged(spark, d), ["A"], ["frame_id"], "data").select("frame_id", "frame_score")


@query("filter_workflow_stage", with_views("ann", """select obj_id, l_orderkey from ann where l_orderkey in
(select o_orderkey from orders where o_orderpriority in ('1-URGENT', '5-LOW'))"""))
def filter_workflow_stage(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("stage"))
    return X.filter_workflow_stage(V.ann(spark, d), rows, ["1-URGENT", "5-LOW"], ["l_orderkey"]).select("obj_id", "l_orderkey")


@query("filter_tags_grouped", with_views("ann label_tag", """select frame_id, obj_id from (
select *, max(case when own then 1 else 0 end) over (partition by frame_id) as frame_ok from flagged) where own or (obj_id is null and frame_ok = 1)""",
MERGED_SQL + """, frame_tag as (select o_orderkey as frame_id, concat('p', o_custkey % 3) as tag from orders where o_custkey % 2 = 0),
frame_ok as (select frame_id, max(case when tag = 'p1' then 1 else 0 end) as ok from frame_tag group by frame_id),
label_ok as (select obj_id, max(case when tag = 'd0' then 1 else 0 end) as ok from label_tag group by obj_id),
flagged as (select m.frame_id, m.obj_id, m.obj_id is not null and coalesce(l.ok, 1) = 1 as own from merged m
left join frame_ok f on m.frame_id = f.frame_id left join label_ok l on m.obj_id = l.obj_id where coalesce(f.ok, 1) = 1)"""))
def filter_tags_grouped(spark, d):
    frame_tags = V.table(spark, d, "orders").where("o_custkey % 2 = 0").select(
        F.col("o_orderkey").alias("frame_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("tag"))
    return X.filter_tags_grouped(
        merged(spark, d), frame_tags, V.label_tag(spark, d), ["p1", X.UNTAGGED_FRAMES], ["d0", X.UNTAGGED_ANNOTATIONS], "frame_id", "obj_id"
    ).select("frame_id", "obj_id")


@query("apply_filters", with_views("ann", """select frame_id, obj_id from (
select *, max(case when object_class = 'R' then 1 else 0 end) over (partition by frame_id) as own from ranged)
where object_class = 'R' or (object_class is null and own = 1)""", MERGED_SQL + """,
ranged as (select * from (select *, max(case when label_score between 5000e0 and 60000e0 then 1 else 0 end) over (partition by frame_id) as hit from merged)
where label_score between 5000e0 and 60000e0 or (label_score is null and hit = 1))"""))
def apply_filters(spark, d):
    return X.apply_filters(merged(spark, d), [
        lambda x: X.filter_range_keep_na(x, "label_score", 5000.0, 60000.0, ["frame_id"]),
        lambda x: X.filter_categorical_keep_na(x, "object_class", ["R"], ["frame_id"]),
    ]).select("frame_id", "obj_id")


@query("skip_labeled", """select o_orderkey as frame_id from orders where o_orderkey not in (select l_orderkey from lineitem)
and o_custkey not in (select c_custkey from customer where c_acctbal < 0)""")
def skip_labeled(spark, d):
    units = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), "o_custkey")
    objects = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"))
    classified = V.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    answers = units.join(classified, "o_custkey").select("frame_id")
    return X.unlabeled_frames(units, objects, answers, ["frame_id"]).select("frame_id")


@query("labels_on_predicted_frames", with_views("pred gt", "select label_id from gt where frame_id in (select frame_id from pred)"))
def labels_on_predicted_frames(spark, d):
    p = V.pred(spark, d)
    return X.labels_on_predicted_frames(V.gt(spark, d), p, ["frame_id"]).select("label_id")


@query("restrict_classes", """select l_orderkey, l_linenumber, l_partkey, p_name as class_name from lineitem join part on l_partkey = p_partkey where p_size < 5""")
def restrict_classes(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    classes = V.table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("class_name"))
    return X.restrict_classes(li, classes, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "class_name")


@query("remap_other_classes", """select l_orderkey, l_linenumber, l_partkey, coalesce(p_name, 'others') as class_name from lineitem
left join (select * from part where p_size < 5) on l_partkey = p_partkey""")
def remap_other_classes(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    classes = V.table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("class_name"))
    return X.remap_other_classes(li, classes, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "class_name")


@query("classification_outcome", with_views("clf", "select unit_id, gt_class, pred_class from clf where gt_class <> pred_class"))
def classification_outcome(spark, d):
    return X.classification_outcome(V.clf(spark, d), correct=False).select("unit_id", "gt_class", "pred_class")


@query("id_scope", with_views("ann", """select concat(l_suppkey, '_', l_orderkey, '_', printf('%05d', l_linenumber)) as identifier from ann group by 1"""))
def id_scope(spark, d):
    a = V.ann(spark, d)
    ids = a.select(S.make_identifier(F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber"), F.col("obj_id")).alias("identifier"))
    return X.id_scope(ids, "identifier", "frame")


@query("item_lookup", with_views("ann label_tag", """select o.o_orderkey as frame_id, o_totalprice as frame_score, tags, obj_id, feature, m_quantity
from orders o left join ann a on o.o_orderkey = a.l_orderkey
left join (select frame_id, string_agg(tag, ',' order by tag) as tags from (select distinct a.l_orderkey as frame_id, t.tag
 from label_tag t join ann a on t.obj_id = a.obj_id) group by 1) t on o.o_orderkey = t.frame_id"""))
def item_lookup(spark, d):
    frames = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_totalprice").alias("frame_score"))
    a = V.ann(spark, d)
    objs = a.select(F.col("l_orderkey").alias("frame_id"), "obj_id", "feature", "m_quantity")
    tags = a.where("m_discount >= 0.09D").select(F.col("l_orderkey").alias("frame_id"), "obj_id").join(
        V.label_tag(spark, d).select("obj_id", "tag"), "obj_id").select("frame_id", "tag")
    return X.item_lookup(frames, objs, tags, ["frame_id"]).withColumn("tags", F.array_join("tags", ","))
