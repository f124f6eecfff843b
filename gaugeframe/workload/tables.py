"""Queries of the tag, table, set and selection families."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import scalar as S
from gaugeframe.functions.vectors import entropy
from gaugeframe.operators import selection as T, tables as P, tags as G
from gaugeframe.registry import ANNOTATION_REGISTRY, DATA_REGISTRY
from gaugeframe.workload import views as V
from gaugeframe.workload.views import with_views

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def joined(df, col):
    return df.withColumn(col, F.array_join(col, ","))


# ---- tags

@query("tagged_items", with_views("tag label_tag", """select frame_id, obj_id, string_agg(tag, ',' order by tag) as tags from (
select unit_id as frame_id, cast(null as varchar) as obj_id, tag from tag union select frame_id, null, tag from label_tag union select frame_id, obj_id, tag from label_tag) group by 1, 2"""))
def tagged_items(spark, d):
    ft = V.tag(spark, d).select(F.col("unit_id").alias("frame_id"), "tag")
    return joined(G.tagged_items(ft, V.label_tag(spark, d), ["frame_id"], "obj_id"), "tags")


DESIRED_SQL = "desired as (select unit_id, concat('t', m_spaces % 4) as tag from unit where m_chars % 2 = 0)"


def desired(spark, d):
    return V.unit(spark, d).where("m_chars % 2 = 0").select("unit_id", F.concat(F.lit("t"), (F.col("m_spaces") % 4).cast("string")).alias("tag"))


@query("tag_diff", with_views("tag", """select unit_id, tag, 'add' as action from (select * from desired except select * from tag)
union all select unit_id, tag, 'remove' from (select distinct * from tag where unit_id in (select unit_id from desired) except select * from desired)""", DESIRED_SQL))
def tag_diff(spark, d):
    return G.tag_diff(V.tag(spark, d), desired(spark, d), ["unit_id"])


@query("tag_difference", with_views("tag", "select unit_id, tag from tag except select unit_id, tag from desired", DESIRED_SQL))
def tag_difference(spark, d):
    return G.tag_difference(V.tag(spark, d), desired(spark, d), ["unit_id"])


@query("write_tags", with_views("tag", "select unit_id, tag from tag union select unit_id, tag from desired", DESIRED_SQL))
def write_tags(spark, d):
    return G.write_tags(V.tag(spark, d), desired(spark, d), ["unit_id"])


@query("create_tags", with_views("tag", """select w.project, w.tag, coalesce(e.tag_id, md5(concat(w.project, ':', w.tag))) as tag_id from
(select distinct project, tag from unit join tag using (unit_id)) w left join (select 'A' as project, 't0' as tag, 'known' as tag_id) e on w.project = e.project and w.tag = e.tag"""))
def create_tags(spark, d):
    names = V.unit(spark, d).join(V.tag(spark, d), "unit_id").select("project", "tag")
    known = names.where("project = 'A' and tag = 't0'").distinct().withColumn("tag_id", F.lit("known"))
    return G.create_tags(known, names)


@query("nested_answer_tags", """select c_custkey, coalesce(tag, 'no classification') as tag from customer left join
(select o_custkey, concat(o_orderstatus, ': ', a) as tag from (select o_custkey, o_orderstatus, unnest(string_split(o_orderpriority, '-')) as a from orders where o_orderstatus in ('F', 'P')))
on c_custkey = o_custkey""")
def nested_answer_tags(spark, d):
    o = V.table(spark, d, "orders")
    answers = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("feature_hash"), F.col("o_orderstatus").alias("question"),
                       F.split("o_orderpriority", "-").alias("answer"))
    kind = F.when(F.col("o_orderstatus") == "F", "radio").when(F.col("o_orderstatus") == "P", "checklist").otherwise("text")
    ontology = o.select("o_orderstatus").distinct().select(F.col("o_orderstatus").alias("feature_hash"), kind.alias("type"))
    return G.nested_answer_tags(V.table(spark, d, "customer").select("c_custkey"), answers, ontology, "c_custkey")


@query("radio_answer", """select event_id, case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then event_type end as answer from events""")
def radio_answer(spark, d):
    listed = F.to_json(F.array(F.struct(F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"))))
    text = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    e = V.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, listed).when(F.col("event_id") % 3 == 1, text).otherwise("{}").alias("j"))
    return e.select("event_id", G.radio_answer(F.col("j")).alias("answer"))


# ---- score tables

IDENT = "concat(l_suppkey, '_', l_partkey, '_', printf('%05d', l_linenumber))"


def scores(spark, d):
    """Long scores: frame rows and label rows of four metrics."""
    a = V.ann(spark, d)
    frame = S.make_identifier(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber"))
    label = F.concat_ws("_", frame, F.col("obj_id"))
    f = a.groupBy(frame.alias("identifier")).agg(F.max("m_quantity").alias("q"), F.max("m_price").alias("p"))
    frames = f.select("identifier", F.explode(F.array(
        F.struct(F.lit("Brightness").alias("metric"), F.col("q").alias("score")), F.struct(F.lit("Sharpness").alias("metric"), F.col("p").alias("score")))).alias("s")).select("identifier", "s.*")
    labels = a.select(label.alias("identifier"), F.explode(F.array(
        F.struct(F.lit("Object Area - Relative").alias("metric"), (F.col("w") * F.col("h") * 100).alias("score")),
        F.struct(F.lit("Shape outlier detection").alias("metric"), F.col("m_price").alias("score")))).alias("s")).select("identifier", "s.*")
    return frames.unionByName(labels)


SCORES = f"""fr as (select {IDENT} as identifier, max(m_quantity) as q, max(m_price) as p from ann group by 1),
scores as (select identifier, 'Brightness' as metric, q as score from fr union all select identifier, 'Sharpness', p from fr
union all select concat({IDENT}, '_', obj_id), 'Object Area - Relative', w * h * 100 from ann
union all select concat({IDENT}, '_', obj_id), 'Shape outlier detection', m_price from ann)"""


@query("sorted_scores", with_views("ann", "select identifier, metric, score from scores", SCORES))
def sorted_scores(spark, d):
    return scores(spark, d).orderBy("score", "identifier", "metric")


@query("normalize_scores", with_views("ann", """select identifier, s.metric, (score - lo) / case when hi = lo then 1e0 else hi - lo end as score from scores s
join (select metric, min(score) as lo, max(score) as hi from scores group by 1) r on s.metric = r.metric""", SCORES))
def normalize_scores(spark, d):
    return P.normalize_scores(scores(spark, d)).select("identifier", "metric", "score")


ANALYTICS = SCORES + """, wide as (select identifier, max(least(greatest(score, 0e0), 1e0)) filter (where metric = 'Brightness') as metric_brightness,
max(least(sqrt(score) / 2040e0, 1e0)) filter (where metric = 'Sharpness') as metric_sharpness,
max(least(score / 100, 1e0)) filter (where metric = 'Object Area - Relative') as metric_area_relative,
max(least(score / 10000e0, 1e0)) filter (where metric = 'Shape outlier detection') as metric_label_shape_outlier from scores group by 1)"""


@query("scores_to_analytics", with_views("ann", "select * from wide", ANALYTICS))
def scores_to_analytics(spark, d):
    return P.scores_to_analytics(scores(spark, d), ANNOTATION_REGISTRY).select(
        "identifier", "metric_brightness", "metric_sharpness", "metric_area_relative", "metric_label_shape_outlier")


@query("assign_metric", with_views("ann", """select obj_id, least(sqrt(m_price) / 2040e0, 1e0) as sharpness, least(m_price / 100, 1e0) as density, l_partkey as area from ann"""))
def assign_metric(spark, d):
    a = V.ann(spark, d)
    def stored(name, c):
        return P.assign_metric(F.lit(name), c, DATA_REGISTRY)
    return a.select("obj_id", stored("metric_sharpness", F.col("m_price")).alias("sharpness"), stored("metric_object_density", F.col("m_price")).alias("density"),
                    stored("metric_area", F.col("l_partkey")).cast("long").alias("area"))


@query("metric_comments", with_views("ann", """select l_orderkey, kind as "column", string_agg(distinct feature, ', ' order by feature) as comment from ann group by 1, 2"""))
def metric_comments(spark, d):
    rows = V.ann(spark, d).select("l_orderkey", F.col("kind").alias("column"), F.col("feature").alias("description"))
    return P.metric_comments(rows, ["l_orderkey"])


@query("copy_frame_metrics", """select l.doc_id, coalesce(case when l.quality = 1 then cast(l.toxic as double) end, cast(d.n_chars as double)) as metric_area from labels l left join documents d on l.doc_id = d.doc_id""")
def copy_frame_metrics(spark, d):
    lab = V.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("toxic").cast("double")).alias("metric_area"))
    frames = V.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("metric_area"))
    return P.copy_frame_metrics(lab, frames, ["doc_id"], ["metric_area"])


@query("derived_unit_metrics", with_views("unit", """select unit_id, m_chars as metric_width, m_spaces as metric_height, m_chars * m_spaces as metric_area,
case when m_spaces <> 0 then m_chars / m_spaces end as metric_aspect_ratio, cast(coalesce(n, 0) as bigint) as metric_object_count from unit left join
(select doc_id, count(*) as n from labels group by 1) on unit_id = doc_id"""))
def derived_unit_metrics(spark, d):
    n = V.table(spark, d, "labels").groupBy(F.col("doc_id").alias("unit_id")).agg(F.count("*").alias("n"))
    u = V.unit(spark, d).join(n, "unit_id", "left")
    out = P.derived_unit_metrics(u, "m_chars", "m_spaces", F.coalesce("n", F.lit(0)))
    return out.select("unit_id", "metric_width", "metric_height", "metric_area", "metric_aspect_ratio", "metric_object_count")


@query("merge_metrics", with_views("ann", """select identifier, max(score) filter (where metric = 'Brightness') as "Brightness", max(score) filter (where metric = 'Sharpness') as "Sharpness",
max(score) filter (where metric = 'Object Area - Relative') as "Object Area - Relative" from scores where metric <> 'Shape outlier detection' group by 1""", SCORES))
def merge_metrics(spark, d):
    return P.merge_metrics(scores(spark, d), ["Brightness", "Sharpness", "Object Area - Relative"])


@query("union_metrics", with_views("clf", """select unit_id, cast(null as bigint) as quality, n from (select doc_id as unit_id, n_chars as n from documents) union all select unit_id, gt_class, null from clf"""))
def union_metrics(spark, d):
    frames = V.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("n_chars").alias("n"))
    return P.union_metrics(frames, V.clf(spark, d).select("unit_id", F.col("gt_class").alias("quality"))).select("unit_id", "quality", "n")


@query("append_metric_columns", with_views("ann", f"""select l.identifier, coalesce(o.metric_brightness, f.metric_brightness) as metric_brightness,
coalesce(o.metric_area_relative, f.metric_area_relative) as metric_area_relative from (select concat({IDENT}, '_', obj_id) as identifier, {IDENT} as frame from ann where kind = 'O') l
left join wide o on l.identifier = o.identifier left join wide f on l.frame = f.identifier""", ANALYTICS))
def append_metric_columns(spark, d):
    wide = P.scores_to_analytics(scores(spark, d), ANNOTATION_REGISTRY)
    frame = S.make_identifier(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber"))
    p = V.ann(spark, d).where("kind = 'O'").select(F.concat_ws("_", frame, F.col("obj_id")).alias("identifier"))
    return P.frame_prefix_join(p, wide, ["metric_brightness", "metric_area_relative"])


# ---- sync, subset, remap, delete

@query("sync_changes", """select o_orderkey, s is null as is_new, coalesce(s <> o_orderdate, false) as labels_changed, coalesce(epoch(o_orderdate) - epoch(s) > 1, false) as data_changed
from orders left join (select o_orderkey as k, case when o_orderkey % 5 = 0 then o_orderdate - interval 3 second else o_orderdate end as s from orders where o_orderkey % 7 <> 0) on o_orderkey = k""")
def sync_changes(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("edited"))
    now = o.withColumn("data", F.col("edited"))
    old = F.when(F.col("o_orderkey") % 5 == 0, F.col("edited") - F.expr("interval 3 seconds")).otherwise(F.col("edited"))
    stored = o.where("o_orderkey % 7 <> 0").select("o_orderkey", old.alias("edited")).withColumn("data", F.col("edited"))
    return P.sync_changes(stored, now, "o_orderkey", "edited", "data").drop("edited", "data")


@query("upsert", """select o_orderkey, case when o_orderkey % 3 = 0 then 'new' else 'old' end as version from orders where o_orderkey % 7 <> 0 or o_orderkey % 3 = 0""")
def upsert(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey")
    return P.upsert(o.where("o_orderkey % 7 <> 0").withColumn("version", F.lit("old")), o.where("o_orderkey % 3 = 0").withColumn("version", F.lit("new")), ["o_orderkey"])


@query("create_subset", with_views("ann", """select obj_id, l_orderkey, 'copy' as project, coalesce('n' || feature, feature) as feature from ann where l_orderkey in
(select l_orderkey from ann where obj_id in (select obj_id from ann where m_discount = 0.1e0))"""))
def create_subset(spark, d):
    units = V.ann(spark, d).select("obj_id", "l_orderkey", F.lit("orig").alias("project"), "feature")
    sel = V.ann(spark, d).where("m_discount = 0.1D").select("obj_id")
    mapping = units.select(F.col("feature").alias("old")).distinct().withColumn("new", F.concat(F.lit("n"), F.col("old")))
    return P.create_subset(units, sel, "project", "copy", "obj_id", "l_orderkey", mapping, "feature").select("obj_id", "l_orderkey", "project", "feature")


@query("subset_metric_stats", with_views("ann", """select metric, min(score) as min, max(score) as max, count(*) as num_rows from scores where identifier in
(select concat(""" + IDENT + """, '_', obj_id) from ann where m_tax > 0.04e0) group by 1""", SCORES))
def subset_metric_stats(spark, d):
    frame = S.make_identifier(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber"))
    sub = V.ann(spark, d).where("m_tax > 0.04D").select(F.concat_ws("_", frame, F.col("obj_id")).alias("identifier"))
    return P.subset_metric_stats(scores(spark, d), sub, "identifier")


@query("remap_ids", """select l_orderkey, l_linenumber, l_suppkey, coalesce(case when p_size > 25 then p_partkey + 1000000 end, l_partkey) as l_partkey from lineitem left join part on l_partkey = p_partkey""")
def remap_ids(spark, d):
    m = V.table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000000).alias("new"))
    return P.remap_ids(V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), m, ["l_partkey"])


@query("remap_identifiers", with_views("ann", """select concat(case when l_suppkey % 2 = 0 then concat('s', l_suppkey) else cast(l_suppkey as varchar) end, '_', l_partkey, '_', printf('%05d', l_linenumber), '_', obj_id) as identifier from ann"""))
def remap_identifiers(spark, d):
    ids = V.ann(spark, d).select(S.make_identifier(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber"), F.col("obj_id")).alias("identifier"), "l_suppkey")
    ids = ids.withColumn("identifier", F.concat(F.lit("r"), F.col("identifier")))
    supp = V.table(spark, d, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("old"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_suppkey").cast("string")).alias("new"))
    return P.remap_identifiers(ids.select("identifier"), supp)


@query("delete_project", with_views("unit", "select unit_id, 'unit' as t from unit where project <> 'B' union all select doc_id, 'labels' from labels where doc_id not in (select unit_id from unit where project = 'B')"))
def delete_project(spark, d):
    u = V.unit(spark, d)
    lab = V.table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"))
    out = P.delete_project({"unit": u, "labels": lab}, "B", u, "project", "unit_id")
    return out["unit"].select("unit_id", F.lit("unit").alias("t")).unionByName(out["labels"].select("unit_id", F.lit("labels").alias("t")))


# ---- dataset views

@query("classification_dataset", with_views("tag", """select unit_id, concat('relative://', source, '/', unit_id) as uri, cast(quality as bigint) as class_index from unit join labels on unit_id = doc_id
where unit_id in (select unit_id from tag where tag in ('t0', 't1'))"""))
def classification_dataset(spark, d):
    u = V.unit(spark, d).select("unit_id", F.concat(F.lit("relative://"), F.col("source"), F.lit("/"), F.col("unit_id").cast("string")).alias("uri"))
    lab = V.table(spark, d, "labels")
    ans = lab.select(F.col("doc_id").alias("unit_id"), F.lit(0).alias("seq"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("answer")).unionByName(
        lab.select(F.col("doc_id").alias("unit_id"), F.lit(1).alias("seq"), F.lit("other").alias("answer")))
    options = lab.select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("answer"), F.col("quality").cast("long").alias("class_index")).distinct()
    return P.classification_dataset(u, ans, options, ["unit_id"], V.tag(spark, d), ["t0", "t1"])


@query("object_dataset", with_views("ann", """select l_orderkey, o_orderpriority as uri, obj_id, feature from ann join orders on l_orderkey = o_orderkey where feature in (select l_returnflag from lineitem where l_returnflag <> 'N')"""))
def object_dataset(spark, d):
    units = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("uri"))
    objs = V.ann(spark, d).select("l_orderkey", "obj_id", "feature")
    return P.object_dataset(units, objs, objs.select("feature").where("feature <> 'N'").distinct(), ["l_orderkey"])


@query("image_metrics_table", with_views("tag", """select u.unit_id, m_chars, source as uri, coalesce(tags, '') as tags from unit u left join
(select unit_id, string_agg(distinct tag, ',' order by tag) as tags from tag group by 1) t on u.unit_id = t.unit_id"""))
def image_metrics_table(spark, d):
    u = V.unit(spark, d)
    return joined(P.image_metrics_table(u.select("unit_id", "m_chars"), ["unit_id"], u.select("unit_id", F.col("source").alias("uri")), V.tag(spark, d)), "tags")


@query("prediction_metrics_table", with_views("clf", "select unit_id, confidence, gt_class = pred_class as true_positive from clf"))
def prediction_metrics_table(spark, d):
    return P.prediction_metrics_table(V.clf(spark, d), "pred_class", "gt_class").select("unit_id", "confidence", "true_positive")


@query("resize_annotations", with_views("ann", """select obj_id, round(w * 640, 6) as bw, round(h * 640, 6) as bh, round(y * 640, 6) as sy, round(w * h * 640 * 640, 4) as area from ann"""))
def resize_annotations(spark, d):
    W_, H_ = F.lit(1920.0), F.lit(1080.0)
    a = V.ann(spark, d).select(
        "obj_id", F.array(F.col("x") * W_, F.col("y") * H_, F.col("w") * W_, F.col("h") * H_).alias("bbox"),
        F.array(F.array(F.col("x") * W_, F.col("y") * H_, (F.col("x") + F.col("w")) * W_, F.col("y") * H_)).alias("segmentation"), (F.col("w") * W_ * F.col("h") * H_).alias("area"))
    out = P.resize_annotations(a, W_, H_, F.lit(640.0), F.lit(640.0))
    return out.select("obj_id", F.round(F.col("bbox")[2], 6).alias("bw"), F.round(F.col("bbox")[3], 6).alias("bh"), F.round(F.col("segmentation")[0][1], 6).alias("sy"), F.round("area", 4).alias("area"))


@query("drop_unannotated", """select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having bool_or(l_quantity > 10 and l_linenumber > 1) and sum(l_linenumber) >= 10)""")
def drop_unannotated(spark, d):
    a = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") - 9).alias("w"), F.col("l_linenumber").alias("h"), F.col("l_linenumber").alias("kp"))
    return P.drop_unannotated(V.table(spark, d, "orders").select("o_orderkey"), a, "o_orderkey", "kp")


@query("ontology_equal", with_views("unit", """select p.project, p.c = f.c as same from (select project, string_agg(distinct source, ',' order by source) as c from unit group by 1) p,
(select string_agg(distinct source, ',' order by source) as c from unit where project = (select min(project) from unit)) f"""))
def ontology_equal(spark, d):
    return P.ontology_equal(V.unit(spark, d).select("project", F.col("source").alias("class")))


@query("uri_to_path", """select page_id, case when page_id % 5 = 0 then concat('/root/p/a/', page_id) when page_id % 5 = 1 then concat('/a b/', page_id) when page_id % 5 = 2 then concat('/x/', page_id)
when page_id % 5 = 3 then concat('./y/', page_id) end as path from pages""")
def uri_to_path(spark, d):
    p = F.col("page_id").cast("string")
    kind = F.col("page_id") % 5
    uri = (F.when(kind == 0, F.concat(F.lit("relative://a/"), p)).when(kind == 1, F.concat(F.lit("file:///a%20b/"), p)).when(kind == 2, F.concat(F.lit("absolute:///x/"), p))
           .when(kind == 3, F.concat(F.lit("./y/"), p)).otherwise(F.col("url")))
    return V.table(spark, d, "pages").select("page_id", S.uri_to_path(uri, F.lit("/root/p")).alias("path"))


# ---- selection

@query("search", with_views("ann", """select obj_id, m_price, cast(row_number() over (order by m_price desc, obj_id) - 20 as int) as position, true as truncated from ann
order by m_price desc, obj_id limit 100 offset 20"""))
def search(spark, d):
    return T.search(V.ann(spark, d), ["obj_id"], "m_price", True, 20, limit=100)


@query("sort_by_metric", with_views("ann", "select obj_id, m_price as value from ann where obj_id in (select obj_id from ann where m_tax = 0.02e0)"))
def sort_by_metric(spark, d):
    return T.sort_by_metric(V.ann(spark, d), "obj_id", "M_PRICE", False, V.ann(spark, d).where("m_tax = 0.02D").select("obj_id"))


@query("select_n_best", with_views("ann", "select obj_id, m_price from ann where l_suppkey % 3 <> 0 order by m_price, obj_id limit 40"))
def select_n_best(spark, d):
    a = V.ann(spark, d).select("obj_id", "m_price", "l_suppkey")
    out = V.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return T.select_n_best(a, "obj_id", "m_price", 40, True, exclude=out, unit="l_suppkey").select("obj_id", "m_price")


@query("partition_dataset", with_views("unit", """select unit_id, case when pos <= floor(n * 60e0 / 100) then 'train' when pos <= floor(n * 60e0 / 100) + floor(n * 25e0 / 100) then 'val' else 'test' end as partition
from (select unit_id, row_number() over (order by md5(concat('42:', unit_id)), unit_id) as pos, count(*) over () as n from unit)"""))
def partition_dataset(spark, d):
    return T.partition_dataset(V.unit(spark, d).select("unit_id"), "unit_id", {"train": 60, "val": 25, "test": 15})


@query("random_score", with_views("ann", "select obj_id, cast(cast(concat('0x', substr(md5(concat('42:', obj_id)), 1, 13)) as bigint) as double) / 4503599627370496e0 as random from ann"))
def random_score(spark, d):
    return T.random_score(V.ann(spark, d).select("obj_id"), "obj_id")


@query("natural_sort_key", """select doc_id, concat(source, '_', lpad(cast(length(cast(doc_id as varchar)) as varchar), 10, '0'), cast(doc_id as varchar)) as key from (select doc_id, 'img' as source from documents)""")
def natural_sort_key(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("name"))
    return T.natural_sort(docs, "name").select("doc_id", S.natural_key(F.col("name")).alias("key"))


@query("remaining_pool", with_views("ann", "select obj_id from ann where l_partkey not in (select p_partkey from part where p_size > 20)"))
def remaining_pool(spark, d):
    lab = V.table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"))
    return T.remaining_pool(V.ann(spark, d).select("obj_id", "l_partkey"), lab, "l_partkey").select("obj_id")


@query("active_learning_round", with_views("probs", """select vec_id, round(-(p1 * log2(p1) + p2 * log2(p2) + p3 * log2(p3) + p4 * log2(p4)), 9) as score from probs
where vec_id not in (select doc_id from labels) order by score desc, vec_id limit 60"""))
def active_learning_round(spark, d):
    """The 60 most uncertain items without a label."""
    labeled = V.table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")).distinct()
    return T.active_learning_round(V.probs(spark, d), labeled, "vec_id", F.round(entropy(F.col("probs")), 9), 60)


# ---- scalar functions

@query("identifiers", with_views("ann", """select obj_id, concat(l_suppkey, '_', l_partkey, '_', printf('%05d', l_linenumber), '_', obj_id) as identifier, cast(l_linenumber as int) as frame, obj_id as first_object,
concat(l_suppkey, '_', l_partkey, '_', printf('%05d', l_linenumber)) as prefix from ann"""))
def identifiers(spark, d):
    a = V.ann(spark, d).select("obj_id", S.make_identifier(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber"), F.col("obj_id")).alias("identifier"))
    parts = S.split_identifier(F.col("identifier"))
    return a.select("obj_id", "identifier", parts["frame"].alias("frame"), parts["object_hashes"][0].alias("first_object"), S.identifier_prefix(F.col("identifier")).alias("prefix"))


@query("names", """select p_partkey, replace(lower(p_name), ' ', '_') as snake, concat(substr(md5(concat(p_name, p_type)), 1, 8), '_', replace(lower(p_name), ' ', '_')) as unique_name from part""")
def names(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.snake_case(F.col("p_name")).alias("snake"), S.metric_unique_name(F.col("p_name"), F.col("p_type")).alias("unique_name"))


@query("frame_timestamp", with_views("trk", "select obj_id, (cast(frame as double) + 0.5e0) / cast(25 as double) as ts from trk"))
def frame_timestamp(spark, d):
    return V.trk(spark, d).select("obj_id", S.frame_timestamp(F.col("frame"), F.lit(25)).alias("ts"))


@query("bucket_round", with_views("ann", "select obj_id, floor(m_discount * 1e1 + 0.5e0) / 1e1 as d1, floor(m_quantity * 1e2 + 0.5e0) / 1e2 as d2, floor(m_tax * 1e3 + 0.5e0) / 1e3 as d3 from ann"))
def bucket_round(spark, d):
    return V.ann(spark, d).select("obj_id", S.bucket_round(F.col("m_discount"), 1).alias("d1"), S.bucket_round(F.col("m_quantity"), 2).alias("d2"), S.bucket_round(F.col("m_tax"), 3).alias("d3"))
