"""Queries of the embedding and acquisition families."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import vectors as C
from gaugeframe.operators import embeddings as M, matching as MM
from gaugeframe.plans import ann as ANN
from gaugeframe.plans.neighbours import knn_join as _knn
from gaugeframe.workload import views as V
from gaugeframe.workload.detection import evaluated
from gaugeframe.workload.media import scratch
from gaugeframe.workload.views import with_views

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


NN = """nn as (select *, row_number() over (partition by vec_id order by distance, neighbor) as rank from (select a.vec_id, b.vec_id as neighbor, a.label, b.label as vote,
1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as distance from emb a join emb b on a.vec_id <> b.vec_id {cond}))"""


@query("subset_reduction", with_views("emb", """select 'items' as fact, cast(count(*) as double) as value from emb where vec_id in (select doc_id from documents where lang = 'en')
union all select 'mean of x', 0e0 union all select 'mean of y', 0e0 union all select 'covariance of x and y', 0e0 union all select 'x varies at least as y', 1e0
union all select 'axes hold as much variance as any two components', 1e0"""))
def subset_reduction(spark, d):
    """Facts that hold for the principal axes of a subset, taken from the coordinates themselves."""
    english = V.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    e = V.emb(spark, d)
    xy = M.subset_reduction(e, english, ["vec_id"], "vec_id", "embedding").join(e, "vec_id")
    parts = F.array(*[F.var_pop(F.col("embedding")[i].cast("double")) for i in range(64)])
    two = F.slice(F.sort_array(parts, asc=False), 1, 2)
    a = xy.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), two.alias("two"))
    facts = [("items", F.col("n").cast("double")), ("mean of x", F.abs(F.round("mx", 6))), ("mean of y", F.abs(F.round("my", 6))), ("covariance of x and y", F.abs(F.round("c", 6))),
             ("x varies at least as y", (F.col("vx") >= F.col("vy")).cast("double")),
             ("axes hold as much variance as any two components", (F.col("vx") + F.col("vy") >= F.col("two")[0] + F.col("two")[1] - 1e-9).cast("double"))]
    return a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), v.alias("value")) for k, v in facts])).alias("f")).select("f.*")


@query("ann_search", with_views("emb", "select count(*) * 10 as asked, true as exact_distances, true as recalled from emb where vec_id % 100 = 0"))
def ann_search(spark, d):
    """The ten nearest of every hundredth vector from a stored index, its probes tuned for a recall of 0.9, held against the exact join."""
    e = V.emb(spark, d)
    index = ANN.build(e, "vec_id", "embedding", f"{scratch(spark)}/index", bucket_rows=64)
    queries = e.where("vec_id % 100 = 0")
    found = ANN.search(index, queries, "vec_id", "embedding", 10, ANN.tuned_probes(index, 10, 0.95)).select("vec_id", "neighbor", "distance")
    truth = _knn(e, "vec_id", "embedding", 10, block_rows=512, only=queries).where("vec_id % 100 = 0").select("vec_id", "neighbor", F.col("distance").alias("true_distance"))
    met = truth.join(found, ["vec_id", "neighbor"], "left")
    return met.agg(F.count(F.lit(1)).alias("asked"), F.bool_and(F.abs(F.coalesce(F.col("distance"), F.col("true_distance")) - F.col("true_distance")) < 1e-9).alias("exact_distances"),
                   (F.count("distance") >= 0.9 * F.count(F.lit(1))).alias("recalled"))


@query("knn_join", with_views("emb", "select vec_id, neighbor, round(distance, 6) as distance, cast(rank as int) as rank from nn where rank <= 10", NN.format(cond="")))
def knn_join(spark, d):
    return rounded(_knn(V.emb(spark, d), "vec_id", "embedding", 10, block_rows=512), "distance")


@query("similarity_search", with_views("emb", """select b.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as similarity
from emb a join emb b on a.vec_id = 7 and b.vec_id <> 7 order by list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) desc, b.vec_id limit 50"""))
def similarity_search(spark, d):
    return rounded(M.similarity_search(V.emb(spark, d), "vec_id", "embedding", 7, 50), "similarity")


QUERY_VECTOR = [((i * 7) % 11 - 5) / 10 for i in range(64)]


@query("semantic_rank", with_views("emb", f"""select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast({QUERY_VECTOR} as double[])), 6) as similarity
from emb where vec_id in (select doc_id from documents where lang = 'en')"""))
def semantic_rank(spark, d):
    allowed = V.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return rounded(M.semantic_rank(V.emb(spark, d), "vec_id", "embedding", QUERY_VECTOR, allowed), "similarity")


def with_copies(spark, d):
    """Every third vector twice more, under later ids, so that duplicates exist."""
    e = V.emb(spark, d)
    third = e.where("vec_id % 3 = 0")
    return e.unionByName(third.withColumn("vec_id", F.col("vec_id") + 1_000_000_000)).unionByName(third.withColumn("vec_id", F.col("vec_id") + 2_000_000_000))


COPIES = """cp as (select * from emb union all select vec_id + 1000000000, embedding, label from emb where vec_id % 3 = 0
union all select vec_id + 2000000000, embedding, label from emb where vec_id % 3 = 0)"""


@query("singularity", with_views("emb", """select vec_id, round(case when original is not null then 0e0 else far end, 6) as score,
case when original is not null then 'Duplicate image' when far <= 0.03e0 then 'Near duplicate image' else '' end as description, original from
(select a.vec_id, min(b.vec_id) filter (where distance < 1e-5 and b.vec_id < a.vec_id) as original, min(distance) filter (where distance >= 1e-5) as far
from cp a join cp b on a.vec_id <> b.vec_id, lateral (select 1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as distance) group by 1)""", COPIES))
def singularity(spark, d):
    return rounded(M.singularity(with_copies(spark, d), "vec_id", "embedding", 512), "score")


QUALITY = """select q.vec_id, e.label, same / 9 as score, case when c <= 5 then 'unsure' when vote = e.label then 'correct' else 'wrong' end as verdict from
(select vec_id, vote, c, sum(case when vote = label then c else 0 end) over (partition by vec_id) as same, row_number() over (partition by vec_id order by c desc, vote) as rn from
(select vec_id, label, vote, count(*) as c from nn where rank <= 9 group by 1, 2, 3)) q join emb e on q.vec_id = e.vec_id where rn = 1"""


@query("label_quality", with_views("emb", QUALITY, NN.format(cond="")))
def label_quality(spark, d):
    return M.label_quality(V.emb(spark, d), "vec_id", "embedding", "label", block_rows=512)


@query("label_quality_by_question", with_views("emb", QUALITY, NN.format(cond="and a.vec_id % 4 = b.vec_id % 4")))
def label_quality_by_question(spark, d):
    e = V.emb(spark, d).withColumn("question", F.col("vec_id") % 4)
    return M.label_quality(e, "vec_id", "embedding", "label", group="question", block_rows=512)


@query("diversity_rank")
def diversity_rank(spark, d):
    return M.diversity_rank(M.diversity_clusters(V.emb(spark, d), "vec_id", "embedding"), "vec_id")


@query("diversity_interleave", with_views("emb", """select vec_id, cluster, row_number() over (order by turn, cluster) as rank from
(select vec_id, label as cluster, row_number() over (partition by label order by embedding[1], vec_id) as turn from emb)"""))
def diversity_interleave(spark, d):
    fixed = V.emb(spark, d).select("vec_id", F.col("label").alias("cluster"), F.col("embedding")[0].alias("distance"))
    return M.diversity_rank(fixed, "vec_id")


@query("reduce_2d")
def reduce_2d(spark, d):
    return M.reduce_2d(V.emb(spark, d), "vec_id", "embedding", ["label"])


@query("subset_embeddings", with_views("emb", "select vec_id, label from emb where vec_id in (select doc_id from labels where quality = 1)"))
def subset_embeddings(spark, d):
    s = V.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return M.subset_embeddings(V.emb(spark, d), s, ["vec_id"]).select("vec_id", "label")


@query("label_embeddings", with_views("emb ann", """select obj_id, feature, round(cast(embedding[1] as double), 6) as first from ann join emb on l_partkey = vec_id"""))
def label_embeddings(spark, d):
    labels = V.ann(spark, d).select(F.col("l_partkey").alias("vec_id"), "obj_id", "feature")
    out = M.label_embeddings(V.emb(spark, d).select("vec_id", "embedding"), labels, ["vec_id"])
    return out.select("obj_id", "feature", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("embedding_scores", with_views("evaluated fn emb", """select coalesce(e.vec_id, s.frame_id) as frame_id, round(cast(embedding[1] as double), 6) as x,
round(cast(embedding[2] as double), 6) as y, round(coalesce(score, 0e0), 9) as score from emb e full join
(select frame_id, avg(s) as score from (select frame_id, cast(tp as int) as s from evaluated union all select frame_id, 0 from fn where iou_threshold < 0.5e0) group by 1) s
on e.vec_id = s.frame_id"""))
def embedding_scores(spark, d):
    ev, fn = evaluated(spark, d, "frame_id")
    pts = V.emb(spark, d).select(F.col("vec_id").alias("frame_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"),
                                 F.round(F.col("embedding")[1].cast("double"), 6).alias("y"))
    out = M.embedding_scores(pts, ev, fn.where(F.col("iou_threshold") < 0.5), "frame_id", MM.is_tp(0.5))
    return rounded(out, "score", digits=9)


@query("acquisition_functions", with_views("probs", """select vec_id,
round(-(p1 * log2(p1) + p2 * log2(p2) + p3 * log2(p3) + p4 * log2(p4)), 6) as entropy, round(1 - s[1], 6) as least_confidence, round(s[1] - s[2], 6) as margin,
round(((p1 - .25e0) ** 2 + (p2 - .25e0) ** 2 + (p3 - .25e0) ** 2 + (p4 - .25e0) ** 2) / 4, 6) as variance, round(s[1], 6) as max_prob
from (select *, list_reverse_sort([p1, p2, p3, p4]) as s from probs)"""))
def acquisition_functions(spark, d):
    p = F.col("probs")
    return V.probs(spark, d).select("vec_id", *[F.round(fn(p), 6).alias(n) for n, fn in M.ACQUISITION.items()])


@query("frame_acquisition", with_views("probs", """select o_orderkey as frame_id, round(avg(-(p1 * log2(p1) + p2 * log2(p2) + p3 * log2(p3) + p4 * log2(p4))), 6) as entropy,
round(avg(1 - s), 6) as least_confidence, round(coalesce(avg(s), 0e0), 6) as max_prob from orders left join (select *, greatest(p1, p2, p3, p4) as s from probs) on o_orderkey = frame_id group by 1"""))
def frame_acquisition(spark, d):
    frames = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"))
    out = M.frame_acquisition(frames, V.probs(spark, d), "frame_id", "probs").select("frame_id", "entropy", "least_confidence", "max_prob")
    return rounded(out, "entropy", "least_confidence", "max_prob")


@query("cosine_similarity", with_views("emb", """select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as similarity,
round(sqrt(list_sum(list_transform(a.embedding, lambda z: cast(z as double) ** 2))), 6) as norm from emb a join emb b on b.vec_id = a.vec_id + 1"""))
def cosine_similarity(spark, d):
    e = V.emb(spark, d)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(
        "vec_id", F.round(C.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"), F.round(C.l2_norm(F.col("embedding")), 6).alias("norm"))
