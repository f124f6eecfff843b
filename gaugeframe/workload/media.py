"""Queries of the source, sink, mask, polygon, image, extension and streaming families."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from gaugeframe.functions import boxes as B, images as I, masks as K, polygons as PG
from gaugeframe.operators import extensions as X, matching as M
from gaugeframe.plans.spatial import best_overlap
from gaugeframe.registry import Metric, MetricRegistry, NORMAL
from gaugeframe.session import ensure_checkpoint_dir
from gaugeframe.sources import coco as CO, export as EX, kitti as KI, label_rows as LR, masks as MK, tables as ST
from gaugeframe.streaming import jobs as SJ
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


def scratch(spark) -> str:
    """A fresh folder next to the checkpoints, on storage every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


# ---- label rows

def label_row_json(spark, d):
    """One label-row document per box: an image (kind F) or a video (kind O) holding it at frame l_linenumber."""
    a = V.dealt(V.ann(spark, d))
    box = F.struct("x", "y", "w", "h")
    pts = B.box_points(*[F.col(c) for c in "xywh"])
    polygon = F.map_from_entries(F.transform(pts, lambda p, i: F.struct(i.cast("string").alias("key"), p.alias("value"))))
    is_box = F.col("feature") == "A"
    obj = F.struct(
        F.col("feature").alias("name"), F.lower("feature").alias("value"), F.when(is_box, "bounding_box").otherwise("polygon").alias("shape"),
        F.col("obj_id").alias("objectHash"), F.col("feature").alias("featureHash"), F.col("m_quantity").alias("confidence"), F.lit("a@x.y").alias("createdBy"),
        F.lit(True).alias("manualAnnotation"), F.when(is_box, box).alias("boundingBox"), F.when(~is_box, polygon).alias("polygon"))
    cls = F.struct(F.lit("weather").alias("name"), F.concat(F.lit("c"), F.col("obj_id")).alias("classificationHash"), F.lit("f1").alias("featureHash"), F.lit("a@x.y").alias("createdBy"))
    labels = F.struct(F.array(obj).alias("objects"), F.array(cls).alias("classifications"))
    unit = [F.col("obj_id").alias("data_hash"), F.concat(F.lit("u"), F.col("obj_id")).alias("data_title"), F.lit("image/png").alias("data_type"),
            F.col("l_linenumber").cast("string").alias("data_sequence"), F.lit(1920).alias("width"), F.lit(1080).alias("height")]
    still = F.struct(*unit, labels.alias("labels"))
    film = F.struct(*unit, F.lit(25.0).alias("data_fps"), F.create_map(F.col("l_linenumber").cast("string"), labels).alias("labels"))
    answer = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("opt"), F.col("l_linenumber").cast("string")))
    answers = F.create_map(F.concat(F.lit("c"), F.col("obj_id")), F.struct(F.array(F.struct(
        F.lit("weather").alias("name"), F.lit("f1").alias("featureHash"), F.array(F.struct(answer.alias("name"))).alias("answers"))).alias("classifications")))
    head = [F.lit("p").alias("project_hash"), F.col("l_orderkey").cast("string").alias("label_hash"), F.col("obj_id").alias("data_hash"), F.lit("ds").alias("dataset_hash"), F.lit("set").alias("dataset_title")]

    def doc(rows, kind, unit_struct):
        return rows.select(F.to_json(F.struct(*head, F.lit(kind).alias("data_type"), F.create_map(F.col("obj_id"), unit_struct).alias("data_units"),
                                              answers.alias("classification_answers"))).alias("value"))

    return doc(a.where("kind = 'F'"), "image", still).unionByName(doc(a.where("kind = 'O'"), "video", film))


def label_rows(spark, d):
    parsed = F.from_json("value", LR.LABEL_ROW)
    return label_row_json(spark, d).select(parsed.alias("r")).select("r.*")


@query("scan_label_rows", with_views("ann", """select cast(l_orderkey as varchar) as label_hash, obj_id as du_hash, case when kind = 'O' then 'video' else 'image' end as data_type,
cast(l_linenumber as int) as frame, 1920 as width, case when kind = 'O' then 25e0 end as data_fps, 1 as objects from ann"""))
def scan_label_rows(spark, d):
    f = LR.scan_frames(label_rows(spark, d))
    return f.select("label_hash", "du_hash", "data_type", "frame", "width", "data_fps", F.size("objects").alias("objects"))


@query("scan_objects", with_views("ann", """select obj_id as object_hash, feature as feature_hash, case when feature = 'A' then 'bounding_box' else 'polygon' end as shape,
case when feature = 'A' then x end as x, case when feature <> 'A' then x + w end as px, case when feature <> 'A' then y + h end as py from ann"""))
def scan_objects(spark, d):
    o = LR.scan_objects(LR.scan_frames(label_rows(spark, d)))
    return o.select("object_hash", "feature_hash", "shape", "x", F.col("points")[2]["x"].alias("px"), F.col("points")[2]["y"].alias("py"))


@query("scan_classifications", with_views("ann", "select obj_id as du_hash, concat('c', obj_id) as classification_hash, cast(l_linenumber as int) as frame from ann"))
def scan_classifications(spark, d):
    return LR.scan_classifications(LR.scan_frames(label_rows(spark, d))).select("du_hash", "classification_hash", "frame")


@query("scan_answers", with_views("ann", """select concat('c', obj_id) as classification_hash, 'weather' as question, case when l_linenumber % 2 = 0 then concat('opt', l_linenumber) end as answer from ann"""))
def scan_answers(spark, d):
    from gaugeframe.operators.tags import radio_answer
    return LR.scan_answers(label_rows(spark, d)).select("classification_hash", "question", radio_answer(F.col("answers")).alias("answer"))


@query("read_label_rows", with_views("ann", """select label_hash, count(*) as frames, sum(case when kind = 'O' then 25e0 end) as fps from (select cast(l_orderkey as varchar) as label_hash, kind from ann) group by 1"""))
def read_label_rows(spark, d):
    """Documents written as compressed JSON lines and read back by the file reader."""
    path = scratch(spark)
    # the documents repeat their names, so the fastest level already leaves a tenth of their bytes
    label_row_json(spark, d).write.option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")
    frames = LR.scan_frames(LR.read_label_rows(spark, path))
    return frames.groupBy("label_hash").agg(F.count(F.lit(1)).alias("frames"), F.sum("data_fps").alias("fps"))


# ---- COCO and KITTI

def coco_images(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(800).alias("height"), F.lit(1000).alias("width"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"))


def coco_annotations(spark, d):
    a = V.ann(spark, d)
    px = [F.col("x") * 1000 + 500, F.col("y") * 800, F.col("w") * 1000, F.col("h") * 800]
    flat = F.array(px[0], px[1], px[0] + px[2], px[1], px[0] + px[2], px[1] + px[3])
    seg = F.when(F.col("feature") == "A", F.to_json(F.array(flat, flat))).when(F.col("feature") == "N", F.to_json(flat))
    return a.select(
        F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 9).cast("int").alias("category_id"), F.array(*px).alias("bbox"), seg.alias("segmentation"),
        (px[2] * px[3]).alias("area"), F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("iscrowd"),
        F.struct(F.when(F.col("l_suppkey") % 9 == 4, F.lit(30.0)).alias("rotation")).alias("attributes"), "obj_id")


@query("scan_coco_annotations", with_views("ann", """select l_orderkey as image_id, l_partkey as id, cast(l_suppkey % 9 as int) as category_id, shape, case when shape = 'bounding_box' then bx / 1000 end as x,
case when shape = 'bounding_box' then (least(bx + bw, 1000e0) - bx) / 1000 end as w, case when shape = 'polygon' then bx / 1000 end as px from
(select *, case when feature = 'R' then 'bounding_box' else 'polygon' end as shape, x * 1000 + 500 as bx, w * 1000 as bw from ann where l_linenumber <> 7 and l_orderkey in (select o_orderkey from orders)),
(select unnest([1, 2]) as copy) where (feature = 'A' or copy = 1) and (shape = 'polygon' or bx <= 1000)"""))
def scan_coco_annotations(spark, d):
    out = CO.scan_coco_annotations(coco_annotations(spark, d), coco_images(spark, d))
    return out.select("image_id", "id", "category_id", "shape", "x", "w", F.col("points")[0]["x"].alias("px"))


COCO_FILE_SQL = """select 'image' as kind, o_orderkey as id, concat('a]}"[{', chr(92), ' ', o_orderkey, chr(92), chr(92), '".jpg') as name, null as category_id, null as right_x from orders
union all select 'label', l_partkey, shape, cast(l_suppkey % 9 as int), round(case when shape = 'polygon' then bx + bw else least(bx + bw, 1000e0) end / 1000, 9) from
(select *, case when feature = 'R' then 'bounding_box' else 'polygon' end as shape, x * 1000 + 500 as bx, w * 1000 as bw from ann where l_linenumber <> 7 and l_orderkey in (select o_orderkey from orders)),
(select unnest([1, 2]) as copy) where (feature = 'A' or copy = 1) and (shape = 'polygon' or bx <= 1000)"""


@query("coco_file_ranges", with_views("ann", COCO_FILE_SQL))
def coco_file_ranges(spark, d):
    """One annotation file, read in byte ranges by many tasks; file names hold brackets, quotes and backslashes."""
    path = scratch(spark)
    images = coco_images(spark, d).withColumn("file_name", F.concat(F.lit('a]}"[{\\ '), F.col("id").cast("string"), F.lit('\\\\".jpg')))
    notes = coco_annotations(spark, d).drop("obj_id")
    text = F.col("segmentation")
    note = F.struct(*[F.when(text.isNotNull(), F.parse_json(text)).alias(c) if c == "segmentation" else F.col(c) for c in notes.columns])
    EX.write_joined(spark, path, [
        '{"info": {"a": [{"id": "]"}]}, "images": [',
        images.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value")),
        '{"id": null}], "categories": [], "annotations": [',
        notes.select(F.concat(F.to_json(note), F.lit(",")).alias("value")),
        '{"id": null, "iscrowd": 1}]}',
    ])
    t = CO.read_coco(spark, path, range_bytes=256 << 10)
    seen = t["images"].where("id is not null")
    labels = CO.scan_coco_annotations(t["annotations"], seen)
    right = F.coalesce(F.col("x") + F.col("w"), F.array_max(F.transform("points", lambda p: p["x"])))
    return seen.select(F.lit("image").alias("kind"), "id", F.col("file_name").alias("name"), F.lit(None).cast("int").alias("category_id"), F.lit(None).cast("double").alias("right_x")).unionByName(
        labels.select(F.lit("label").alias("kind"), "id", F.col("shape").alias("name"), "category_id", F.round(right, 9).alias("right_x")))


@query("coco_category_shapes", with_views("ann", """select cast(l_suppkey % 9 as int) as category_id, bool_or(feature in ('A', 'N')) as polygon, l_suppkey % 9 <> 4 as bounding_box, l_suppkey % 9 = 4 as rotatable_bounding_box
from ann where l_linenumber <> 7 group by 1, 3, 4"""))
def coco_category_shapes(spark, d):
    return CO.coco_category_shapes(coco_annotations(spark, d))


@query("scan_coco_results", with_views("ann", """select l_orderkey as image_id, case when feature = 'R' then concat('b', l_suppkey % 9) else concat('p', l_suppkey % 9) end as feature_hash, m_price as confidence,
case when feature = 'R' then (x * 1000 + 500) / 1000 end as x, case when feature <> 'R' then (y * 800) / 800 end as py from ann, (select unnest([1, 2]) as copy)
where (feature = 'A' or copy = 1) and l_orderkey in (select o_orderkey from orders) and l_suppkey % 9 < 6"""))
def scan_coco_results(spark, d):
    a = coco_annotations(spark, d).join(V.ann(spark, d).select("obj_id", F.col("m_price").alias("score")), "obj_id")
    cats = V.table(spark, d, "supplier").select((F.col("s_suppkey") % 9).cast("int").alias("category_id")).distinct().where("category_id < 6")
    mapping = cats.select("category_id", F.explode(F.array(F.struct(F.lit("polygon").alias("shape"), F.lit("p").alias("k")), F.struct(F.lit("bounding_box").alias("shape"), F.lit("b").alias("k")))).alias("m")).select(
        "category_id", "m.shape", F.concat("m.k", F.col("category_id").cast("string")).alias("feature_hash"))
    out = CO.scan_coco_results(a, coco_images(spark, d), mapping)
    return out.select("image_id", "feature_hash", "confidence", "x", F.col("points")[0]["y"].alias("py"))


#: Rectangles of at least two pixels a side on a raster of 20 rows and 30 columns, one per part.
RECTANGLE_SQL = """rectangle as (select p_partkey, p_partkey % 21 as rx, p_partkey % 13 as ry, 2 + p_size % 8 as rw, 2 + p_partkey % 6 as rh from part)"""


def rectangles(spark, d):
    k = F.col("p_partkey")
    return V.dealt(V.table(spark, d, "part").select("p_partkey", "p_size")).select(
        k, (k % 21).alias("rx"), (k % 13).alias("ry"), (2 + F.col("p_size") % 8).alias("rw"), (2 + k % 6).alias("rh"))


def run_list(across, start, long, gap, count):
    """Run lengths of a rectangle: ``count`` runs of ``long`` ones, ``gap`` zeros apart; ``across`` is the raster's size."""
    body = F.flatten(F.array_repeat(F.array(long, gap), (count - 1).cast("int")))
    return F.concat(F.array(start), body, F.array(long, across - start - long * count - gap * (count - 1)))


@query("coco_masks", f"""with {RECTANGLE_SQL} select p_partkey as id, 'polygon' as shape, 4 as corners, round(rx / 30, 9) as left_x, round((rx + rw - 1) / 30, 9) as right_x,
round((ry + rh - 1) / 20, 9) as low_y from rectangle where p_partkey % 7 <> 0""")
def coco_masks(spark, d):
    """Run-length ground truth; the box of every seventh annotation contradicts its mask."""
    r = rectangles(spark, d)
    x, y, w, h = (F.col(f"r{c}").cast("long") for c in "xywh")
    counts = run_list(F.lit(600), x * 20 + y, h, 20 - h, w)
    wrong = F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)
    notes = r.select(
        F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("image_id"), F.lit(1).alias("category_id"), F.array(*[c.cast("double") for c in (x + wrong, y, w, h)]).alias("bbox"),
        F.to_json(F.struct(F.array(F.lit(20), F.lit(30)).alias("size"), counts.alias("counts"))).alias("segmentation"), (w * h).cast("double").alias("area"), F.lit(0).alias("iscrowd"),
        F.struct(F.lit(None).cast("double").alias("rotation")).alias("attributes"))
    images = V.table(spark, d, "region").where("r_regionkey = 1").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(20).alias("height"), F.lit(30).alias("width"))
    out = CO.scan_coco_annotations(notes, images)
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    return out.select("id", "shape", F.size("points").alias("corners"), F.round(F.array_min(xs), 9).alias("left_x"), F.round(F.array_max(xs), 9).alias("right_x"), F.round(F.array_max(ys), 9).alias("low_y"))


#: Masks of predictions and labels: rectangles on a raster of 20 x 20.
MASK_SQL = f"""mask as (select obj_id, frame_id, feature, kind, l_partkey % 15 as rx, l_suppkey % 14 as ry, 1 + l_linenumber % 5 as rw, 1 + l_orderkey % 6 as rh from ann),
met as (select p.obj_id as pred_id, g.obj_id as label_id, p.rw * p.rh as pa, g.rw * g.rh as ga, least(p.rx + p.rw, g.rx + g.rw) - greatest(p.rx, g.rx) as ix, least(p.ry + p.rh, g.ry + g.rh) - greatest(p.ry, g.ry) as iy
from mask p join mask g on p.kind = 'O' and g.kind = 'F' and p.frame_id = g.frame_id and p.feature = g.feature),
scored as (select pred_id, label_id, {V.overlap("ix * iy / (pa + ga - ix * iy)")} as iou from met where ix > 0 and iy > 0),
first as (select pred_id, label_id, iou from (select *, row_number() over (partition by pred_id order by iou desc, label_id) as rn from scored) where rn = 1)"""


def mask_objects(spark, d, kind, name):
    a = V.dealt(V.ann(spark, d).where(F.col("kind") == kind))
    x, y = (F.col("l_partkey") % 15).cast("long"), (F.col("l_suppkey") % 14).cast("long")
    w, h = (1 + F.col("l_linenumber") % 5).cast("long"), (1 + F.col("l_orderkey") % 6).cast("long")
    runs = F.transform(run_list(F.lit(400), y * 20 + x, w, 20 - w, h), lambda c: c.cast("int"))
    return a.select(F.col("obj_id").alias(name), "frame_id", "feature", F.struct(F.array(F.lit(20), F.lit(20)).alias("size"), runs.alias("counts")).alias("rle"))


@query("mask_match", with_views("ann", "select obj_id as pred_id, label_id as match_id, coalesce(iou, 0e0) as iou from mask left join first on obj_id = pred_id where kind = 'O'", MASK_SQL))
def mask_match(spark, d):
    m = M.iou_match(mask_objects(spark, d, "O", "pred_id"), mask_objects(spark, d, "F", "label_id"))
    return m.select("pred_id", "match_id", "iou")


@query("scan_kitti", with_views("ann", """select obj_id, concat('d', u.s_suppkey, '_', u.frame) as du_hash, u.frame, concat('h', feature) as feature_hash, m_price as confidence, round(x, 9) as x, round(h, 9) as h
from ann join (select s_suppkey, unnest(case when s_suppkey % 2 = 0 then [1] else [1, 2] end) as frame from supplier) u on l_suppkey = u.s_suppkey
and ((l_linenumber <= 3 and l_linenumber = u.frame) or (l_linenumber > 3 and l_suppkey % 2 = 0)) where feature <> 'N'"""))
def scan_kitti(spark, d):
    a = V.ann(spark, d)
    W_, H_ = 1242.0, 375.0
    px = [F.col("x") * W_, F.col("y") * H_, (F.col("x") + F.col("w")) * W_, (F.col("y") + F.col("h")) * H_]
    line = F.concat_ws(" ", "feature", F.lit("0.0"), F.lit("1"), F.lit("-1.5"), *[c.cast("string") for c in px], *[F.lit("0.0")] * 7, F.col("m_price").cast("string"))
    title = F.concat(F.lit("img_"), F.col("l_suppkey").cast("string"))
    name = F.when(F.col("l_linenumber") <= 3, F.concat(title, F.lit("__"), F.col("l_linenumber").cast("string"), F.lit(".txt"))).otherwise(F.concat(title, F.lit(".csv")))
    frames = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    units = V.table(spark, d, "supplier").select("s_suppkey", F.explode(frames).alias("frame")).select(
        F.concat(F.lit("img_"), F.col("s_suppkey").cast("string")).alias("data_title"), "frame",
        F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.lit("_"), F.col("frame").cast("string")).alias("du_hash"), F.lit(W_).alias("img_width"), F.lit(H_).alias("img_height"))
    mapping = a.where("feature <> 'N'").select(F.col("feature").alias("class_name"), F.concat(F.lit("h"), F.col("feature")).alias("feature_hash")).distinct()
    out = KI.scan_kitti(a.select("obj_id", line.alias("line"), name.alias("file_name")), units, mapping)
    return out.select("obj_id", "du_hash", "frame", "feature_hash", "confidence", F.round("x", 9).alias("x"), F.round("h", 9).alias("h"))


def export_inputs(spark, d):
    frames = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file_name"),
                                               F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("o_totalprice").alias("m_total"))
    a = V.ann(spark, d)
    objects = a.select(F.col("l_orderkey").alias("frame_id"), "obj_id", F.col("l_suppkey").alias("track"), "feature", "x", "y", "w", "h", "m_quantity")
    cats = a.select("feature").distinct().select("feature", F.concat(F.lit("class "), F.col("feature")).alias("name"), F.lit("object").alias("supercategory"))
    return frames, objects, cats


@query("export_coco", with_views("ann", """select 'annotations' as section, id, image_id, category_id, track as ref, round(x * 640, 6) as value from
(select row_number() over (order by l_orderkey, obj_id) as id, i.id as image_id, c.id as category_id, dense_rank() over (order by l_suppkey) - 1 as track, x from ann
 join (select o_orderkey, row_number() over (order by o_orderkey) as id from orders) i on l_orderkey = i.o_orderkey
 join (select feature, row_number() over (order by feature) as id from (select distinct feature from ann)) c using (feature))
union all select 'images', row_number() over (order by o_orderkey), null, null, null, o_totalprice from orders
union all select 'categories', row_number() over (order by feature), null, null, null, null from (select distinct feature from ann)"""))
def export_coco(spark, d):
    frames, objects, cats = export_inputs(spark, d)
    t = EX.coco_tables(frames, objects, cats, ["m_total"], ["m_quantity"])
    j = F.col("json")
    null = F.lit(None)
    ann = t["annotations"].select(F.lit("annotations").alias("section"), "id", F.get_json_object(j, "$.image_id").cast("long").alias("image_id"), F.get_json_object(j, "$.category_id").cast("long").alias("category_id"),
                                  F.get_json_object(j, "$.attributes.track_id").cast("long").alias("ref"), F.round(F.get_json_object(j, "$.bbox[0]").cast("double"), 6).alias("value"))
    img = t["images"].select(F.lit("images").alias("section"), "id", null.cast("long").alias("image_id"), null.cast("long").alias("category_id"), null.cast("long").alias("ref"),
                             F.get_json_object(j, "$.metrics.m_total").cast("double").alias("value"))
    cat = t["categories"].select(F.lit("categories").alias("section"), "id", null.cast("long").alias("image_id"), null.cast("long").alias("category_id"), null.cast("long").alias("ref"), null.cast("double").alias("value"))
    return ann.unionByName(img).unionByName(cat)


#: Shape of every object by its line number, with the number of its points.
SHAPES = ("bounding_box", "rotatable_bounding_box", "polygon", "polyline", "point", "skeleton")


@query("export_shapes", with_views("ann", """select id, round(case when k = 2 then w * 640 * h * 480 * 0.5e0 when k < 2 then w * 640 * h * 480 else 0e0 end, 4) as area,
round(case when k = 4 then 0e0 else w * 640 end, 4) as box_width, case k when 4 then 1 when 5 then 3 end as keypoints, case when k = 1 then (l_suppkey % 360)::double end as rotation,
case k when 3 then 12 when 4 then 2 when 5 then 0 when 2 then 6 else 8 end as coordinates
from (select *, row_number() over (order by l_orderkey, obj_id) as id, l_linenumber % 6 as k from ann)"""))
def export_shapes(spark, d):
    """Annotations of every shape: areas, boxes, key points and rotation as exported."""
    frames, _, cats = export_inputs(spark, d)
    x, y, w, h = (F.col(c) for c in "xywh")
    k = F.col("l_linenumber") % 6
    corners = [F.struct(px.alias("x"), py.alias("y")) for px, py in ((x, y), (x + w, y), (x + w, y + h))]
    objects = V.ann(spark, d).select(
        F.col("l_orderkey").alias("frame_id"), "obj_id", F.col("l_suppkey").alias("track"), "feature", *[F.when(k < 2, F.col(c)).alias(c) for c in "xywh"],
        F.get(F.array(*[F.lit(n) for n in SHAPES]), k.cast("int")).alias("shape"), F.when(k >= 2, F.array(*corners)).alias("points"), (F.col("l_suppkey") % 360).cast("double").alias("theta"))
    note = F.from_json("json", "bbox array<double>, area double, segmentation array<array<double>>, keypoints array<double>, num_keypoints int, attributes struct<rotation:double>")
    out = EX.coco_tables(frames, objects, cats)["annotations"].select("id", note.alias("a"))
    return out.select("id", F.round("a.area", 4).alias("area"), F.round(F.col("a.bbox")[2], 4).alias("box_width"), F.col("a.num_keypoints").alias("keypoints"), F.col("a.attributes.rotation").alias("rotation"),
                      F.size(F.flatten("a.segmentation")).alias("coordinates"))


@query("export_partitions", """select c_mktsegment as part, count(distinct o_orderkey) as images, count(l_orderkey) as annotations from orders join customer on o_custkey = c_custkey
left join lineitem on l_orderkey = o_orderkey where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1""")
def export_partitions(spark, d):
    """Two named partitions written as documents of their own and read back."""
    frames, objects, cats = export_inputs(spark, d)
    parts = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("frame_id"), F.col("c_mktsegment").alias("partition"))
    path = scratch(spark)
    EX.export_partitions(frames, objects, cats, parts, ["BUILDING", "MACHINERY"], path)
    line = F.col("value")
    return spark.read.text(path).groupBy(F.col("partition").alias("part")).agg(
        F.count(F.when(F.contains(line, F.lit('"file_name":')), 1)).alias("images"), F.count(F.when(F.contains(line, F.lit('"image_id":')), 1)).alias("annotations"))


@query("coco_document", with_views("ann", """select 'element' as kind, (select count(*) from ann where l_orderkey in (select o_orderkey from orders)) + (select count(*) from orders)
+ (select count(distinct feature) from ann) as lines union all select 'bracket', 4"""))
def coco_document(spark, d):
    frames, objects, cats = export_inputs(spark, d)
    path = scratch(spark)
    EX.write_coco(EX.coco_tables(frames, objects, cats), path, compression="gzip")
    kind = F.when(F.col("value").rlike('^,?\\{"id":'), "element").otherwise("bracket")
    return spark.read.text(path).groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"))


@query("nest_metrics", with_views("ann", """select o_orderkey as frame_id, round(o_totalprice, 6) as total, cast(coalesce(n, 0) as int) as objects, round(q, 6) as first_quantity from orders left join
(select l_orderkey, count(*) as n, sum(m_quantity) as q from ann group by 1) on o_orderkey = l_orderkey"""))
def nest_metrics(spark, d):
    frames, objects, _ = export_inputs(spark, d)
    n = EX.nest_metrics(frames, objects, ["frame_id"], ["m_total"], ["m_quantity", "feature"], "obj_id")
    return n.groupBy("frame_id").agg(
        F.round(F.max("frame_level.m_total"), 6).alias("total"), F.sum(F.coalesce(F.size("objects"), F.lit(0))).cast("int").alias("objects"),
        F.round(F.sum(F.aggregate(F.map_values("objects"), F.lit(0.0), lambda acc, v: acc + v["m_quantity"])), 6).alias("first_quantity"))


@query("write_scores", """select event_type as identifier, value as score from events""")
def write_scores(spark, d):
    e = V.table(spark, d, "events")
    none = F.lit(None)
    rows = e.select(F.col("event_type").alias("identifier"), F.col("value").alias("score"), F.lit("").alias("description"), none.cast("string").alias("object_class"),
                    none.cast("string").alias("annotator"), none.cast("int").alias("frame"), F.lit("u").alias("url"))
    path = scratch(spark)
    ST.write_scores(rows, path)
    return ST.scan_scores(spark, path).select("identifier", "score")


@query("write_predictions", with_views("pred gt", """select 'predictions' as t, count(*) as n from pred union all select 'labels', count(*) from gt union all select 'matches', count(*) from pred
union all select 'classes', count(distinct feature) from pred"""))
def write_predictions(spark, d):
    p, g = V.pred(spark, d), V.gt(spark, d)
    path = scratch(spark)
    ST.write_predictions(path, p, g, p.select("pred_id", "frame_id"), p.select("feature").distinct())
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n, df in ST.read_predictions(spark, path).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---- masks and polygons

@query("rle_round_trip", """select p_partkey, list_sum(m)::bigint as ones, (len(list_filter(range(1, 36), lambda i: m[i] <> m[i + 1])) + 1 + m[1])::bigint as runs, true as same,
round(coalesce(list_sum(list_transform(range(1, 37), lambda i: m[i] * k[i])) / nullif(list_sum(list_transform(range(1, 37), lambda i: greatest(m[i], k[i]))), 0), 0e0), 9) as iou from
(select p_partkey, list_transform(range(0, 36), lambda i: case when (p_partkey * 7 + i * i) % 5 < 2 then 1 else 0 end) as m,
list_transform(range(0, 36), lambda i: case when (p_partkey * 3 + i * i) % 4 < 2 then 1 else 0 end) as k from part)""")
def rle_round_trip(spark, d):
    def mask(mult, mod):
        return F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.when((F.col("p_partkey") * mult + i * i) % mod < 2, 1).otherwise(0))

    six = F.lit(6)
    p = V.dealt(V.table(spark, d, "part").select("p_partkey")).select("p_partkey", mask(7, 5).alias("m"), mask(3, 4).alias("k"))
    e = p.select("*", K.rle_encode(F.col("m"), six, six).alias("a"), K.rle_encode(F.col("k"), six, six).alias("b"))
    return e.select("p_partkey", K.rle_area(F.col("a")).alias("ones"), F.size("a.counts").cast("long").alias("runs"),
                    (K.rle_decode(F.col("a")) == F.col("m")).alias("same"), F.round(K.rle_iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query("mask_iou", """select p_partkey, round(coalesce(list_sum(list_transform(range(1, 37), lambda i: m[i] * k[i])) / nullif(list_sum(list_transform(range(1, 37), lambda i: greatest(m[i], k[i]))), 0), 0e0), 9) as iou from
(select p_partkey, list_transform(range(0, 36), lambda i: case when (p_partkey * 7 + i * i) % 5 < 2 then 1 else 0 end) as m,
list_transform(range(0, 36), lambda i: case when (p_partkey * 3 + i * i) % 4 < 2 then 1 else 0 end) as k from part)""")
def mask_iou(spark, d):
    def mask(mult, mod):
        return F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.when((F.col("p_partkey") * mult + i * i) % mod < 2, 1).otherwise(0))
    p = V.table(spark, d, "part").select("p_partkey", mask(7, 5).alias("m"), mask(3, 4).alias("k"))
    return p.select("p_partkey", F.round(K.mask_iou(F.col("m"), F.col("k")), 9).alias("iou"))


@query("masks_to_objects")
def masks_to_objects(spark, d):
    """An 8 x 8 class mask per vector: clearly positive components are class 1, clearly negative ones class 2."""
    digits = F.transform("embedding", lambda v: F.when(v > 0.02, "01").when(v < -0.02, "02").otherwise("00"))
    m = V.emb(spark, d).select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(digits, "")).alias("data"))
    return MK.masks_to_objects(m, ["vec_id"])


@query("polygon_iou", with_views("best", "select pred_id, iou as box_iou, true as agrees from best"))
def polygon_iou(spark, d):
    g = V.gt(spark, d)
    best = best_overlap(V.pred(spark, d), g, ["frame_id", "feature"], "label_id", carry=["x", "y", "w", "h"]).where("best_label_id is not null")
    a = B.box_points(*[F.col(c) for c in "xywh"])
    b = B.box_points(*[F.col(f"best_{c}") for c in "xywh"])
    return best.select("pred_id", F.col("iou").alias("box_iou"), (F.abs(PG.polygon_iou(a, b) - F.col("iou")) < 1e-9).alias("agrees"))


@query("polygon_area", with_views("ann", """select obj_id, round(case l_linenumber % 4 when 0 then w * h * 0.5e0 when 1 then w * h when 2 then w * h * 0.75e0 else w * h * 0.5e0 end, 9) as area from ann"""))
def polygon_area(spark, d):
    """Rectangles, L shapes, triangles, and rectangles drawn crosswise, which cover two triangles."""
    x, y, w, h = (F.col(c) for c in "xywh")

    def ring(*corners):
        return F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in corners])

    a, b, c, e = (x, y), (x + w, y), (x + w, y + h), (x, y + h)
    k = F.col("l_linenumber") % 4
    ell = ring(a, b, (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), e)
    points = F.when(k == 0, ring(a, c, b, e)).when(k == 1, ring(a, b, c, e)).when(k == 2, ell).otherwise(ring(a, b, c))
    # a column of its own, so that its many readers do not draw the outline again
    drawn = V.dealt(V.ann(spark, d)).select("obj_id", points.alias("points"))
    return drawn.select("obj_id", F.round(PG.repaired_area(F.col("points")), 9).alias("area"))


@query("simple_polygon_check", with_views("ann", "select obj_id, l_linenumber % 2 = 1 as simple from ann"))
def simple_polygon_check(spark, d):
    p = B.box_points(*[F.col(c) for c in "xywh"])
    crossed = F.array(p[0], p[2], p[1], p[3])
    return V.dealt(V.ann(spark, d)).select("obj_id", PG.simple_polygon_check(F.when(F.col("l_linenumber") % 2 == 0, crossed).otherwise(p)).alias("simple"))


@query("hu_moments", with_views("ann", """select obj_id, round(w / (12 * h) + h / (12 * w), 6) as hu1, round((w / (12 * h) - h / (12 * w)) ** 2, 6) as hu2 from ann"""))
def hu_moments(spark, d):
    a = V.dealt(V.ann(spark, d)).select("obj_id", B.box_points(*[F.col(c) for c in "xywh"]).alias("points"))
    return PG.with_hu_moments(a, "points").select("obj_id", F.round(F.col("hu")[0], 6).alias("hu1"), F.round(F.col("hu")[1], 6).alias("hu2"))


@query("mask_hu_moments", with_views("ann", """select obj_id, round((rw * rw + rh * rh - 2) / (12e0 * rw * rh), 9) as hu1, round(((rw * rw - rh * rh) / (12e0 * rw * rh)) ** 2, 9) as hu2 from mask""", MASK_SQL))
def mask_hu_moments(spark, d):
    """Rectangles on a raster, whose pixel sums have a closed form of their own."""
    masks = mask_objects(spark, d, "O", "obj_id").unionByName(mask_objects(spark, d, "F", "obj_id"))
    return PG.with_mask_hu_moments(masks, "rle").select("obj_id", F.round(F.col("hu")[0], 9).alias("hu1"), F.round(F.col("hu")[1], 9).alias("hu2"))


# ---- images: the bytes of a document as 16-pixel-wide colour rows, padded with black

def images(spark, d):
    raw = F.encode("text", "utf-8")
    height = F.greatest(F.ceil(F.octet_length(raw) / 48), F.lit(1)).cast("int")
    return V.dealt(V.table(spark, d, "documents")).select("doc_id", F.struct(
        F.col("source").alias("origin"), height.alias("height"), F.lit(16).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
        F.rpad(raw, height * 48, F.unhex(F.lit("00"))).alias("data")).alias("image"))


#: Bytes of every image with their neighbours, and the sums that the pixel metrics need.
PIXEL_SQL = """with raw as (select doc_id, greatest(ceil(octet_length(encode(text)) / 48e0), 1)::bigint as h, hex(encode(text)) as hx from documents),
byte as (select doc_id, h, unnest(range(h * 48)) as i, ('0x' || unnest(regexp_extract_all(rpad(hx, (h * 96)::int, '0'), '..')))::int as c from raw),
near as (select *, lead(c) over w as g, lead(c, 2) over w as r, lag(c, 48) over w as up, lead(c, 48) over w as down, case when i % 48 >= 3 then lag(c, 3) over w end as l, case when i % 48 < 45 then lead(c, 3) over w end as e
from byte window w as (partition by doc_id order by i)),
lap as (select doc_id, case when h = 1 then coalesce(l, c) + coalesce(e, c) - 2 * c else coalesce(up, down) + coalesce(down, up) + coalesce(l, e) + coalesce(e, l) - 4 * c end as z, c from near),
sh as (select doc_id, sum(z * z) / count(*) - (sum(z) / count(*)) ** 2 as sharp, sum(c) / count(*) as m, sum(c * c) / count(*) as q from lap group by 1),
px as (select doc_id, c as b, g, r, greatest(c, g, r) as v, greatest(c, g, r) - least(c, g, r) as span from near where i % 3 = 0),
hue as (select *, 60 * case when span = 0 then 0e0 when v = r then (g - b) / span when v = g then 2 + (b - r) / span else 4 + (r - g) / span end as a, v >= 40 and round_even(span / greatest(v, 1) * 255, 0) >= 50 as strong from px),
col as (select doc_id, avg((strong and (hu <= 10 or hu >= 170))::int) as red, avg((strong and hu between 35 and 75)::int) as green, avg((strong and hu between 90 and 130)::int) as blue
from (select *, round_even((case when a < 0 then a + 360 else a end) / 2, 0) % 180 as hu from hue) group by 1)"""


@query("image_metrics", PIXEL_SQL + """
select doc_id, round(m / 255, 6) as brightness, round(sqrt(q - m * m) / 255, 6) as contrast, round(red, 6) as red, round(green, 6) as green, round(blue, 6) as blue, round(sharp, 4) as sharpness, round(1 - sharp, 4) as blur from col join sh using (doc_id)""")
def image_metrics(spark, d):
    rows = I.image_metrics(images(spark, d), ["doc_id"])
    return rows.select("doc_id", *[F.round(c, 4 if c in ("sharpness", "blur") else 6).alias(c) for c in I.IMAGE_METRICS])


@query("object_crops", """select d.doc_id, cast(cast(floor(0.6e0 * h) as int) - cast(floor(0.1e0 * h) as int) as int) as height, cast(8 as int) as width,
cast((cast(floor(0.6e0 * h) as int) - cast(floor(0.1e0 * h) as int)) * 24 as bigint) as bytes from (select doc_id, greatest(ceil(octet_length(encode(text)) / 48e0), 1) as h from documents) d
join labels l on d.doc_id = l.doc_id where cast(floor(0.6e0 * h) as int) > cast(floor(0.1e0 * h) as int)""")
def object_crops(spark, d):
    boxes = V.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("obj"), F.lit(0.25).alias("x"), F.lit(0.1).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))
    c = I.object_crops(images(spark, d), boxes, ["doc_id"], "obj")
    return c.select("doc_id", "height", "width", F.octet_length("data").cast("long").alias("bytes"))


# ---- extension points

@query("custom_metrics", with_views("ann", """select obj_id, 'squareness' as metric, least(w, h) / greatest(w, h) as score from ann union all select obj_id, 'lower_edge', y + h from ann"""))
def custom_metrics(spark, d):
    r = MetricRegistry()
    r.register(Metric("squareness", NORMAL, "Squareness", "object", lambda df: df.select("obj_id", (F.least("w", "h") / F.greatest("w", "h")).alias("score"))))
    r.register(Metric("lower_edge", NORMAL, "Lower edge", "object", lambda df: df.select("obj_id", (F.col("y") + F.col("h")).alias("score"))))
    return X.run_metrics(V.ann(spark, d), r, ["squareness", "lower_edge"], ["obj_id"])


@query("custom_image_metrics", PIXEL_SQL + """
select doc_id, round(avg(case when i < 48 then c end) / 255, 9) as top_row, round((max(c) - min(c)) / 255, 9) as spread from byte group by 1""")
def custom_image_metrics(spark, d):
    r = MetricRegistry()
    r.register(Metric("top_row", NORMAL, "Top row", image_fn=lambda bgr: float(bgr[0].mean() / 255)))
    r.register(Metric("spread", NORMAL, "Spread", image_fn=lambda bgr: float((int(bgr.max()) - int(bgr.min())) / 255)))
    return X.run_image_metrics(images(spark, d), r, ["top_row", "spread"], ["doc_id"]).select("doc_id", F.round("top_row", 9).alias("top_row"), F.round("spread", 9).alias("spread"))


@query("metrics_by_scope", with_views("ann", "select obj_id, 'width' as metric, w as score from ann union all select obj_id, 'reach', x + w from ann"))
def metrics_by_scope(spark, d):
    """The registry is asked for the metrics that apply to objects, and all of them run."""
    r = MetricRegistry()
    for name, scope, score in (("width", "object", F.col("w")), ("reach", "object", F.col("x") + F.col("w")), ("frame_price", "frame", F.col("m_price"))):
        r.register(Metric(name, NORMAL, name.title(), scope, lambda df, score=score: df.select("obj_id", score.alias("score"))))
    return X.run_metrics(V.ann(spark, d), r, [m.name for m in r.by_scope("object")], ["obj_id"])


@query("model_predictions", with_views("ann", "select obj_id, case when m_price > 50000e0 then 'high' else 'low' end as predicted from ann"))
def model_predictions(spark, d):
    def model(batches):
        for pdf in batches:
            yield pd.DataFrame({"obj_id": pdf["obj_id"], "predicted": ["high" if v > 50000.0 else "low" for v in pdf["m_price"]]})
    return X.predict_with(V.ann(spark, d).select("obj_id", "m_price"), model, "obj_id string, predicted string")


@query("custom_embeddings", "select p_partkey, cast(length(p_name) as double) as a, cast(length(replace(p_name, ' ', '')) as double) as b from part")
def custom_embeddings(spark, d):
    e = X.embed_with(V.table(spark, d, "part"), ["p_partkey"], "p_name", lambda names: [[len(n), len(n.replace(" ", ""))] for n in names])
    return e.select("p_partkey", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@query("label_transformer", "select page_id, regexp_extract(url, '^https?://([^/]*)', 1) as class_name from pages")
def label_transformer(spark, d):
    p = V.table(spark, d, "pages").select("page_id", F.concat_ws("#", F.col("page_id").cast("string"), "url").alias("path"))
    out = X.apply_label_transformer(p.select("path"), lambda f: f.select("path", F.regexp_extract("path", "#https?://([^/]*)", 1).alias("class_name")), p)
    return out.select("page_id", "class_name")


# ---- streaming

def event_stream(spark, d):
    schema = V.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def drain(writer, base):
    q = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()


@query("stream_running_stats", """select event_type, min(value) as min, max(value) as max, round(avg(value), 6) as mean, count(value) as count from events group by 1""")
def stream_running_stats(spark, d):
    base = scratch(spark)
    out = SJ.stream_running_stats(event_stream(spark, d), "event_type", "value")
    drain(out.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out")), base)
    return spark.read.parquet(f"{base}/out").withColumn("mean", F.round("mean", 6))


@query("stream_windowed_stats", """select event_type, count(value) as count, round(avg(value), 6) as mean, date_trunc('day', ts) as day from events group by 1, 4""")
def stream_windowed_stats(spark, d):
    base = scratch(spark)
    out = SJ.stream_running_stats(event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "value", "ts", "1 day", "1 hour")
    drain(out.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}")), base)
    rows = spark.read.parquet(f"{base}/out")
    latest = rows.groupBy("event_type", F.col("window.start").alias("day")).agg(F.max_by(F.struct("count", "mean"), "batch").alias("s"))
    return latest.select("event_type", "s.count", F.round("s.mean", 6).alias("mean"), F.col("day").cast("timestamp_ntz").alias("day"))


@query("stream_shape_similarity", """with e as (select event_id, user_id, [value, cast(event_id % 97 as double), 10e0 + value / 3] as v,
row_number() over (partition by user_id order by ts, event_id) - 1 as p from events),
s as (select event_id, p, v, sum(v[1] * k) over w as a, sum(v[2] * k) over w as b, sum(v[3] * k) over w as c from
(select *, power(2e0, p) * (case when p = 0 then 2e0 else 1e0 end) as k from e)
window w as (partition by user_id order by p rows between unbounded preceding and 1 preceding))
select event_id, round(case when p = 0 then 1e0 else (a * v[1] + b * v[2] + c * v[3]) / (sqrt(a * a + b * b + c * c) * sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) end, 6) as score from s""")
def stream_shape_similarity(spark, d):
    base = scratch(spark)
    s = event_stream(spark, d).select(
        "user_id", "event_id", "ts", F.array(F.col("value"), (F.col("event_id") % 97).cast("double"), F.lit(10.0) + F.col("value") / 3).alias("v"))
    out = SJ.stream_shape_similarity(s, "user_id", "event_id", ["ts", "event_id"], "v")
    drain(out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out"), base)
    return spark.read.parquet(f"{base}/out").select("event_id", F.round("score", 6).alias("score"))


@query("stream_sync", """select user_id, max(event_id) as last_event from events group by 1""")
def stream_sync(spark, d):
    base = scratch(spark)
    s = event_stream(spark, d).select("user_id", "event_id", "ts", "event_type")
    drain(SJ.stream_sync(s, f"{base}/log"), base)
    return SJ.synced(spark.read.parquet(f"{base}/log"), "user_id", "event_id").select("user_id", F.col("event_id").alias("last_event"))
