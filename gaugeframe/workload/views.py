"""The driver tables seen as frames, labels, predictions, tracks, tags and classifications.

Each view exists twice: as a DataFrame and as the SQL text of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def overlap(iou: str) -> str:
    """SQL of an IoU to nine digits."""
    return f"floor(({iou}) * 1e9 + 0.5e0) / 1e9"


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over the shuffle partitions, at any size: each fixture table is one file, which one core would have to read and work on."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ann(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with metrics; 30 orders make a frame, so frames grow with the data, not their content."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.rint(F.col("l_extendedprice") * 100).cast("long")).alias("obj_id"),
        F.expr("l_orderkey div 30").alias("frame_id"),
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_partkey",
        "l_suppkey",
        F.col("l_returnflag").alias("feature"),
        F.col("l_linestatus").alias("kind"),
        (F.col("l_quantity") / F.lit(50.0)).alias("m_quantity"),
        F.col("l_discount").alias("m_discount"),
        F.col("l_tax").alias("m_tax"),
        F.col("l_extendedprice").alias("m_price"),
        ((F.col("l_partkey") % 61).cast("double") / F.lit(100.0)).alias("x"),
        ((F.col("l_suppkey") % 53).cast("double") / F.lit(100.0)).alias("y"),
        ((F.lit(25.0) + F.col("l_quantity")) / F.lit(250.0)).alias("w"),
        ((F.lit(4) + F.col("l_linenumber")).cast("double") / F.lit(40.0)).alias("h"),
        "l_shipdate",
    )


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of ``ann`` as objects of three kinds: boxes, rectangles given as polygons, and concave L shapes (three quarters of the box)."""
    digit = F.substring("obj_id", -1, 1).cast("int")
    kind = digit % 3
    # heights of a finer grain, so that no overlap lies on a threshold
    a = trk(spark, d).withColumn("h", F.col("h") * (1 + F.substring("obj_id", -4, 4).cast("int") * 0.0000017))
    x, y, w, h = (F.col(c) for c in "xywh")

    def ring(*corners) -> Column:
        return F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in corners])

    rectangle = ring((x, y), (x + w / 2, y), (x + w, y), (x + w, y + h), (x, y + h))
    ell = ring((x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h))
    box = {c: F.when(kind == 0, F.col(c)) for c in "xywh"}
    return a.withColumns({**box, "points": F.when(kind == 1, rectangle).when(kind == 2, ell), "feature": F.when(F.col("feature") != "N", F.col("feature"))})


#: The same objects as disjoint rectangles: an L is its lower half and the left part of its upper half; class N is NULL.
SHAPE_SQL = """obj as (select * replace (h * (1 + cast(right(obj_id, 4) as int) * 0.0000017e0) as h), cast(right(obj_id, 1) as int) % 3 as shape, case when feature <> 'N' then feature end as cls from trk),
rect as (select seq_id, frame, obj_id, cls, track_id, x, y, w, case when shape = 2 then h / 2 else h end as h, w * h * case when shape = 2 then 0.75e0 else 1e0 end as area from obj
union all select seq_id, frame, obj_id, cls, track_id, x, y + h / 2, w / 2, h / 2, w * h * 0.75e0 from obj where shape = 2)"""


def pred(spark: SparkSession, d: str) -> DataFrame:
    return ann(spark, d).where("kind = 'O'").select(
        F.col("obj_id").alias("pred_id"), "frame_id", "feature", "x", "y", "w", "h",
        F.col("m_price").alias("confidence"), "m_quantity", "m_discount", "m_tax",
    )


def gt(spark: SparkSession, d: str) -> DataFrame:
    return ann(spark, d).where("kind = 'F'").select(
        F.col("obj_id").alias("label_id"), "frame_id", "feature", "x", "y", "w", "h", "m_quantity", "m_discount", "m_tax",
    )


def unit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("unit_id"),
        F.when(F.col("lang") == "en", "A").otherwise("B").alias("project"),
        "lang",
        "source",
        F.col("n_chars").alias("m_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("m_spaces"),
    )


def trk(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in sequences: 50 frames per sequence, about 20 tracks each, some frames and tracks missing."""
    a = ann(spark, d)
    return a.select(
        F.expr("frame_id div 50").alias("seq_id"),
        (F.col("frame_id") % 50).alias("frame"),
        "obj_id",
        (F.col("l_suppkey") % 20).alias("track_id"),
        "feature", "x", "y", "w", "h",
    )


def clf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    return table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("unit_id"),
        F.col("quality").cast("long").alias("gt_class"),
        F.when(F.col("n_chars") > 1500, 1).otherwise(0).cast("long").alias("pred_class"),
        (F.col("n_chars").cast("double") / F.lit(40000.0)).alias("confidence"),
        "source",
    )


def tag(spark: SparkSession, d: str) -> DataFrame:
    u = unit(spark, d).select("unit_id", "m_chars")
    first = u.select("unit_id", F.concat(F.lit("t"), (F.col("m_chars") % 4).cast("string")).alias("tag"))
    return first.unionByName(u.where("m_chars % 7 = 0").select("unit_id", F.lit("t0").alias("tag")))


def label_tag(spark: SparkSession, d: str) -> DataFrame:
    """Tags of single boxes."""
    return ann(spark, d).where("m_discount >= 0.09").select(
        "frame_id", "obj_id", F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")).alias("tag")
    )


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id"), "embedding", F.col("label").cast("long").alias("label"))


def probs(spark: SparkSession, d: str) -> DataFrame:
    """Class probabilities per predicted object: four absolute components scaled to sum 1."""
    raw = F.expr("transform(slice(embedding, 1, 4), v -> abs(cast(v as double)))")
    total = F.col("raw")[0] + F.col("raw")[1] + F.col("raw")[2] + F.col("raw")[3]
    return (
        table(spark, d, "embeddings")
        .select("vec_id", F.expr("vec_id div 5").alias("frame_id"), raw.alias("raw"))
        .select("vec_id", "frame_id", F.transform("raw", lambda v: v / total).alias("probs"))
    )


SQL_VIEWS: dict[str, str] = {
    "ann": """select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(round(l_extendedprice * 100) as bigint)) as obj_id,
        l_orderkey // 30 as frame_id, l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, l_suppkey,
        l_returnflag as feature, l_linestatus as kind, l_quantity / cast(50 as double) as m_quantity,
        l_discount as m_discount, l_tax as m_tax, l_extendedprice as m_price,
        cast(l_partkey % 61 as double) / cast(100 as double) as x, cast(l_suppkey % 53 as double) / cast(100 as double) as y,
        (25 + l_quantity) / cast(250 as double) as w, cast(4 + l_linenumber as double) / cast(40 as double) as h, l_shipdate
        from lineitem""",
    "pred": """select obj_id as pred_id, frame_id, feature, x, y, w, h, m_price as confidence, m_quantity, m_discount, m_tax
        from ann where kind = 'O'""",
    "gt": "select obj_id as label_id, frame_id, feature, x, y, w, h, m_quantity, m_discount, m_tax from ann where kind = 'F'",
    "unit": """select doc_id as unit_id, case when lang = 'en' then 'A' else 'B' end as project, lang, source,
        n_chars as m_chars, cast(length(text) - length(replace(text, ' ', '')) as bigint) as m_spaces from documents""",
    "trk": """select frame_id // 50 as seq_id, frame_id % 50 as frame, obj_id, l_suppkey % 20 as track_id, feature, x, y, w, h
        from ann""",
    "clf": """select l.doc_id as unit_id, cast(l.quality as bigint) as gt_class,
        cast(case when d.n_chars > 1500 then 1 else 0 end as bigint) as pred_class,
        cast(d.n_chars as double) / cast(40000 as double) as confidence, d.source
        from labels l join documents d on l.doc_id = d.doc_id""",
    "tag": """select unit_id, concat('t', m_chars % 4) as tag from unit
        union all select unit_id, 't0' as tag from unit where m_chars % 7 = 0""",
    "label_tag": "select frame_id, obj_id, concat('d', l_suppkey % 3) as tag from ann where m_discount >= 0.09e0",
    "emb": "select vec_id, embedding, cast(label as bigint) as label from embeddings",
    "raw4": """select vec_id, vec_id // 5 as frame_id, abs(cast(embedding[1] as double)) as a, abs(cast(embedding[2] as double)) as b,
        abs(cast(embedding[3] as double)) as c, abs(cast(embedding[4] as double)) as d from embeddings""",
    "probs": """select vec_id, frame_id, a / (a + b + c + d) as p1, b / (a + b + c + d) as p2, c / (a + b + c + d) as p3,
        d / (a + b + c + d) as p4 from raw4""",
    # joint candidates of predictions and labels: same frame, same class, boxes overlap
    "pair": f"""select pred_id, label_id, frame_id, feature, confidence, {overlap("ix * iy / (w * h + lw * lh - ix * iy)")} as iou
        from (select p.*, l.label_id, l.w as lw, l.h as lh, least(p.x + p.w, l.x + l.w) - greatest(p.x, l.x) as ix,
              least(p.y + p.h, l.y + l.h) - greatest(p.y, l.y) as iy
              from pred p join gt l on p.frame_id = l.frame_id and p.feature = l.feature)
        where ix > 0 and iy > 0""",
    "best": """select pred_id, label_id, frame_id, feature, confidence, iou from (select *, row_number() over
        (partition by pred_id order by iou desc, label_id) as rn from pair) where rn = 1""",
    "matched": """select p.*, b.label_id as match_id, coalesce(b.iou, 0e0) as iou from pred p left join best b on p.pred_id = b.pred_id""",
    "dup": """select pred_id, case when prior is null or iou > prior then coalesce(prior, -1e0) else 1e0 end as match_duplicate_iou
        from (select pred_id, iou, max(iou) over (partition by match_id order by confidence desc, iou desc, pred_id desc
              rows between unbounded preceding and 1 preceding) as prior from matched where match_id is not null)""",
    "evaluated": """select m.*, coalesce(d.match_duplicate_iou, 1e0) as match_duplicate_iou,
        (m.iou >= 0.5e0 and coalesce(d.match_duplicate_iou, 1e0) < 0.5e0) as tp from matched m left join dup d on m.pred_id = d.pred_id""",
    "fn": """select l.*, coalesce(m.t, -1e0) as iou_threshold from gt l
        left join (select match_id, max(iou) as t from matched where match_id is not null group by match_id) m on l.label_id = m.match_id""",
}

_NEEDS: dict[str, tuple[str, ...]] = {
    "pred": ("ann",), "gt": ("ann",), "trk": ("ann",), "tag": ("unit",), "label_tag": ("ann",), "probs": ("raw4",),
    "pair": ("pred", "gt"), "best": ("pair",), "matched": ("best", "pred"), "dup": ("matched",),
    "evaluated": ("matched", "dup"), "fn": ("gt", "matched"),
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """Prefix SQL with the named views and all they depend on; ``extra`` holds more CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for need in _NEEDS.get(n, ()):
            add(need)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = [f"{n} as (\n{SQL_VIEWS[n]})" for n in order] + ([extra] if extra else [])
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
