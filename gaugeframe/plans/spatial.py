"""Best overlapping box per box, without pairing everything in a frame.

Copies collapse first: boxes equal in key and geometry are one row for the pairing, whatever their
number.  The remaining boxes meet on their keys, and those of crowded keys on (keys, grid cell), so that
only neighbours become candidates there and a frame holding a third of all boxes is spread over its cells.
A pair sharing several cells counts in the one that holds the upper-left corner of its intersection.

Objects may be polygons: rows with a ``points`` column that is not NULL.  Their bounding box finds the candidates and the exact
polygon overlap decides.  Objects may also be run-length masks (column ``rle``): masks meet masks only, and the runs decide.
IoUs have nine digits.  Rows without any geometry pair with nothing but stay in every result, and NULL is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gaugeframe.functions.boxes import box_iou, box_points, polygon_area, polygon_bounds
from gaugeframe.functions.masks import rle_area, rle_bounds, rle_iou
from gaugeframe.functions.polygons import polygon_iou, split
from gaugeframe.plans.joins import null_safe_join, whole_key
from gaugeframe.plans.spatial_batches import best_others, best_partners
from gaugeframe.session import cut_lineage, stored

BOX = ("x", "y", "w", "h")
DEFAULT_CELL = 0.25
#: Boxes of equal keys from which they are dealt over grid cells; fewer ones travel once each and meet all together.
CROWDED = 1024
#: Keys up to which a list of them is broadcast.
MANY = 1 << 16
#: Places of a sequence whose objects travel together.
SPAN = 32


def with_bounds(objects: DataFrame) -> DataFrame:
    """Objects whose polygons and masks also have x, y, w, h (their bounds); boxes keep theirs and lose ``points``.

    A polygon that fills its bounds is a box, and pairs of boxes need no Python.  A mask goes before any other shape of its row.
    """
    if "rle" in objects.columns:
        objects = _with_mask_bounds(objects)
    if "points" not in objects.columns:
        return objects
    polygon = F.col("x").isNull() & (F.size("points") > 0)
    b = polygon_bounds(F.col("points"))
    full = polygon_area(F.col("points")) >= (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) * (1 - 1e-12)
    sides = {"x": b["x1"], "y": b["y1"], "w": b["x2"] - b["x1"], "h": b["y2"] - b["y1"]}
    return objects.withColumns({**{c: F.when(polygon, v).otherwise(F.col(c)) for c, v in sides.items()}, "points": F.when(polygon & ~full, F.col("points"))})


def stored_bounds(objects: DataFrame) -> DataFrame:
    """:func:`with_bounds`, stored where there are polygons or masks: the overlap joins read these rows several times, and filters on bounds
    would be planned below them with all their terms."""
    shaped = with_bounds(objects)
    return stored(shaped) if {"points", "rle"} & set(shaped.columns) else shaped


def _with_mask_bounds(objects: DataFrame) -> DataFrame:
    columns = objects.columns
    masked = F.col("rle").isNotNull()
    size = F.col("rle.size")
    b = objects.withColumn("_mask_bounds", rle_bounds(F.when(masked, F.col("rle"))))
    m = {k: F.col(f"_mask_bounds.{k}") for k in ("x", "y", "x2", "y2")}
    sides = {"x": m["x"] / size[1], "y": m["y"] / size[0], "w": (m["x2"] - m["x"]) / size[1], "h": (m["y2"] - m["y"]) / size[0]}
    out = b.withColumns({c: F.when(masked, v).otherwise(F.col(c)) if c in columns else v for c, v in sides.items()})
    return out.withColumns({"points": F.when(~masked, F.col("points"))} if "points" in columns else {}).drop("_mask_bounds")


def geometry(*frames: DataFrame) -> list[str]:
    """Columns that tell shapes apart."""
    return [*BOX, *[c for c in ("points", "rle") if all(c in f.columns for f in frames)]]


def has_area() -> Column:
    """False, never NULL, for rows without a positive box."""
    return F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False))


def overlap(iou: Column) -> Column:
    """IoU to nine digits: ties and thresholds do not hang on the order of an overlap's arithmetic."""
    return F.floor(iou * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def _shape_iou(polygons: bool, masks: bool) -> Column:
    box = box_iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"r_{c}") for c in BOX))
    if masks:
        masked = F.col("rle").isNotNull()
        return F.when(masked, rle_iou(F.col("rle"), F.col("r_rle"))).otherwise(_shape_iou(polygons, False))
    if not polygons:
        return box
    some = F.col("points").isNotNull() | F.col("r_points").isNotNull()
    left = F.coalesce("points", box_points(*[F.col(c) for c in BOX]))
    right = F.coalesce("r_points", box_points(*[F.col(f"r_{c}") for c in BOX]))
    # pairs of boxes send nothing to Python
    return F.when(some, polygon_iou(F.when(some, left), F.when(some, right))).otherwise(box)


def _crowded(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than ``CROWDED`` boxes of both sides, with ``_crowded``: one row per so many boxes at most."""
    both = left.where(has_area()).select(*keys).unionByName(right.where(has_area()).select(*keys))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED).select(*keys, F.lit(True).alias("_crowded"))


def _endless() -> Column:
    """True, never NULL, for boxes with a place or side that is no finite number."""
    return F.greatest(*[F.coalesce(~(F.abs(F.col(c).cast("double")) < float("inf")), F.lit(False)) for c in BOX])


def _uneven(left: DataFrame, right: DataFrame, keys: Sequence[str], odd: Column) -> DataFrame:
    """:func:`_crowded`, and the keys of boxes that are ``odd`` or endless: those whose rows are not worked on in batches."""
    both = left.where(has_area()).select(*keys, odd.alias("_odd"), _endless().alias("_endless")).unionByName(
        right.where(has_area()).select(*keys, F.lit(False).alias("_odd"), _endless().alias("_endless")))
    counted = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("_odd") | F.col("_endless")).alias("_odd"))
    return counted.where((F.col("_n") > CROWDED) | F.col("_odd")).select(*keys, (F.col("_n") > CROWDED).alias("_crowded"))


def _cells(df: DataFrame, keys: Sequence[str], crowded: DataFrame, cell: float) -> DataFrame:
    size = F.lit(cell)
    dense = F.coalesce("_crowded", F.lit(False))

    def span(lo: str, extent: str):
        return F.when(dense, F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(lo) + F.col(extent)) / size))).otherwise(F.array(F.lit(0).cast("long")))

    # a box without a place meets nothing
    placed = df.where(has_area() & F.col("x").isNotNull() & F.col("y").isNotNull())
    flat = null_safe_join(placed, F.broadcast(crowded), keys, "left")
    return flat.withColumn("_cx", F.explode(span("x", "w"))).withColumn("_cy", F.explode(span("y", "h"))).withColumn("_crowded", dense)


def _with_area(df: DataFrame, polygons: bool, masks: bool) -> DataFrame:
    """Area of every shape in ``_area``: once per shape, not once per pair."""
    mask = [rle_area(F.col("rle")) / (F.col("rle.size")[0] * F.col("rle.size")[1])] if masks else []
    return df.withColumn("_area", F.coalesce(*mask, *([polygon_area(F.col("points"))] if polygons else []), F.col("w") * F.col("h")))


def _iou_bound() -> Column:
    """No IoU is larger: the overlap of the bounds over the larger area."""
    inter = (F.least(F.col("x") + F.col("w"), F.col("r_x") + F.col("r_w")) - F.greatest("x", "r_x")) * (
        F.least(F.col("y") + F.col("h"), F.col("r_y") + F.col("r_h")) - F.greatest("y", "r_y"))

    larger = F.greatest("_area", "r__area")
    return F.when(larger > 0, inter / larger).otherwise(F.lit(0.0))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float = DEFAULT_CELL, least: float = 0.0, crowded: DataFrame | None = None) -> DataFrame:
    """Pairs with positive overlap: keys, both boxes (right prefixed ``r_``), other columns of both, ``iou``.

    ``crowded`` names the keys to be dealt over cells where that is known before copies collapse.  Pairs with polygons or masks whose IoU is sure to
    stay below ``least`` may be left out before the exact overlap is taken.
    """
    keys = list(keys)
    crowded = _crowded(left, right, keys) if crowded is None else crowded
    polygons, masks = (c in geometry(left, right) for c in ("points", "rle"))
    bounded = (polygons or masks) and least > 0
    if bounded:
        left, right = _with_area(left, polygons, masks), _with_area(right, polygons, masks)
    lc = _cells(left, keys, crowded, cell)
    rc = _cells(right, keys, crowded, cell)
    rc = rc.select(*keys, "_cx", "_cy", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    both = null_safe_join(lc, rc, [*keys, "_cx", "_cy"])
    home = (F.col("_cx") == F.floor(F.greatest("x", "r_x") / F.lit(cell))) & (
        F.col("_cy") == F.floor(F.greatest("y", "r_y") / F.lit(cell))
    )
    met = both.where(~F.col("_crowded") | home)
    met = met.where((F.least(F.col("x") + F.col("w"), F.col("r_x") + F.col("r_w")) > F.greatest("x", "r_x"))
                    & (F.least(F.col("y") + F.col("h"), F.col("r_y") + F.col("r_h")) > F.greatest("y", "r_y")))
    if masks:
        met = met.where(F.col("rle").isNull() == F.col("r_rle").isNull())
    if bounded:
        met = met.where(_iou_bound() >= F.lit(least - 1e-9)).drop("_area", "r__area")
    return met.withColumn("iou", _shape_iou(polygons, masks)).where("iou > 0").withColumn("iou", overlap(F.col("iou"))).drop("_cx", "_cy", "_crowded")


def best_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], right_id: str, cell: float = DEFAULT_CELL, carry: Sequence[str] = (), least: float = 0.0) -> DataFrame:
    """Every left row with ``iou`` (0 without overlap) and the id (and carried columns) of its best right row.

    Equal IoUs go to the smallest right id.  The result keeps all left columns.  Below ``least`` a polygon's overlap may count as none.
    """
    keys = list(keys)
    shape = geometry(left, right)
    crowded = _crowded(left, right, keys)
    if shape == list(BOX):
        # what is crowded is known first: all other boxes travel once, with the rows of their keys
        crowded = cut_lineage(crowded)
        if crowded.isEmpty():
            return _best_of_few(left, right, keys, right_id, carry)
        few = [null_safe_join(df, F.broadcast(crowded.select(*keys)), keys, "left_anti") for df in (left, right)]
        left, right = (null_safe_join(df, F.broadcast(crowded.select(*keys)), keys, "left_semi") for df in (left, right))
        return _best_of_few(*few, keys, right_id, carry).unionByName(_best_of_many(left, right, keys, right_id, cell, carry, least, crowded))
    columns = [*keys, *shape]
    if len(set(columns)) < len(columns) or any(left.select(c).schema[0].dataType.simpleString() != right.select(c).schema[0].dataType.simpleString() for c in columns):
        return _best_of_many(left, right, keys, right_id, cell, carry, least, crowded)
    # rows of all other keys are dealt by them once and work there
    uneven = cut_lineage(_uneven(left, right, keys, F.lit(False)))
    (few_left, many_left), (few_right, many_right) = _parted(left, uneven, keys), _parted(right, uneven, keys)
    out = _best_of_few_shapes(few_left, few_right, keys, right_id, carry, least)
    return out if many_left is None else out.unionByName(_best_of_many(many_left, many_right, keys, right_id, cell, carry, least, uneven.where("_crowded")))


def _parted(df: DataFrame, uneven: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of all other keys and those of ``uneven`` ones, None where there are none."""
    n = uneven.limit(MANY + 1).count()
    if not n:
        return df, None
    named = uneven.select(*keys)
    few, many = (null_safe_join(df, F.broadcast(named) if n <= MANY else named, keys, how) for how in ("left_anti", "left_semi"))
    return few, many


def _begun(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt and sorted by key, then ``order``; ``_begin`` marks the first one of a key.  Terms instead of columns would travel with the rows."""
    return rows.withColumn("_begin", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)


def _best_of_few_shapes(left: DataFrame, right: DataFrame, keys: list[str], right_id: str, carry: Sequence[str], least: float) -> DataFrame:
    """:func:`best_overlap` of polygons or masks whose keys hold ``CROWDED`` shapes at most: both sides are shuffled once, by key, and work there."""
    shape = geometry(left, right)
    payload = [right_id, *carry]
    rows = right.where(_placed()).select(*keys, *shape, _payload(payload).alias("_p"), F.lit(False).alias("_own"))
    own = left.where(_placed()).withColumn("_own", F.lit(True))
    met = _begun(own.unionByName(rows, allowMissingColumns=True), keys, ["_own", "_p"])
    return _partnered(met, shape, left, right, payload, least)


def _placed() -> Column:
    """False, never NULL, for boxes that meet nothing."""
    return has_area() & F.col("x").isNotNull() & F.col("y").isNotNull()


def _payload(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"_{n}") for n, c in enumerate(columns)])


def _partnered(met: DataFrame, shape: Sequence[str], left: DataFrame, right: DataFrame, payload: Sequence[str], least: float) -> DataFrame:
    """Left rows with their best partners: those among the sorted rows ``met``, and those that meet nothing."""
    polygons, masks = (c in shape for c in ("points", "rle"))
    helpers = {}
    if masks:
        helpers |= {"_masked": F.col("rle").isNotNull(), "_runs": F.col("rle")["counts"]}
    if polygons:
        xs, ys = split(F.coalesce("points", box_points(*[F.col(c) for c in BOX])))
        helpers |= {"_polygon": F.col("points").isNotNull(), "_xs": xs, "_ys": ys}
    met = met.withColumns(helpers)
    if least > 0:
        met = _with_area(met, polygons, masks)
    fields = [T.StructField(c, left.schema[c].dataType) for c in left.columns] + [T.StructField("iou", T.DoubleType())]
    fields += [T.StructField(f"best_{c}", right.schema[c].dataType) for c in payload]
    found = met.mapInArrow(best_partners(left.columns, payload, least), T.StructType(fields))
    none = left.where(~_placed()).withColumn("iou", F.lit(0.0))
    return found.unionByName(none.withColumns({f"best_{c}": F.lit(None).cast(right.schema[c].dataType) for c in payload}))


def best_before(objects: DataFrame, seq: str, pos: str, id_col: str, cell: float = DEFAULT_CELL, carry: Sequence[str] = (), least: float = 0.0) -> DataFrame:
    """:func:`best_overlap` of every object of a place above 1 with those of the place before in its sequence.

    Where no two neighbouring places are crowded, an object travels once, with those of ``SPAN`` places, and only the last of these also to the next ones.
    """
    shape = geometry(objects)
    now = objects.where(F.col(pos) > 1).withColumn("_ref", F.col(pos) - 1)
    before = objects.select(seq, F.col(pos).alias("_ref"), *dict.fromkeys([id_col, *carry, *shape]))
    payload = [id_col, *carry]
    if shape == list(BOX) or not cut_lineage(_uneven(now, before, [seq, "_ref"], F.lit(False))).isEmpty():
        return best_overlap(now, before, [seq, "_ref"], id_col, cell, carry, least).drop("_ref")
    span = F.floor((F.col(pos) - 1) / F.lit(SPAN))
    last = (F.col(pos) % SPAN == 0) & F.col(pos).isNotNull()
    dealt = objects.where(_placed()).withColumn("_to", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("_span", span + F.col("_to"))
    met = _begun(dealt, [seq, "_span"], [pos, "_to", *payload])
    met = met.withColumns({"_pos": F.col(pos), "_own": (F.col(pos) > 1) & (F.col("_to") == 0), "_p": _payload(payload)})
    return _partnered(met, shape, now.drop("_ref"), before, payload, least)


def _best_of_few(left: DataFrame, right: DataFrame, keys: list[str], right_id: str, carry: Sequence[str]) -> DataFrame:
    """:func:`best_overlap` of boxes whose keys hold ``CROWDED`` of them at most: the right boxes of a key are one list, and every left row reads it."""
    placed = has_area() & F.col("x").isNotNull() & F.col("y").isNotNull()
    listed = right.where(placed).groupBy(whole_key(keys).alias("_own")).agg(F.collect_list(F.struct(*BOX, F.struct(F.col(right_id), *carry).alias("p"))).alias("_right"))
    own = tuple(F.col(c) for c in BOX)

    def judged(r: Column) -> Column:
        return F.struct((-overlap(box_iou(own, tuple(r[c] for c in BOX)))).alias("neg"), r["p"].alias("p"))

    def meets(r: Column) -> Column:
        return (F.least(F.col("x") + F.col("w"), r["x"] + r["w"]) > F.greatest(F.col("x"), r["x"])) & (
            F.least(F.col("y") + F.col("h"), r["y"] + r["h"]) > F.greatest(F.col("y"), r["y"])) & (box_iou(own, tuple(r[c] for c in BOX)) > 0)

    scored = F.transform(F.filter("_right", meets), judged)
    met = _by_whole_key(left, keys, listed, "left").withColumn("_best", F.when(placed, F.array_min(scored))).drop("_right")
    return met.select(*left.columns, F.coalesce(-F.col("_best.neg"), F.lit(0.0)).alias("iou"), *[F.col(f"_best.p.{c}").alias(f"best_{c}") for c in (right_id, *carry)])


def _best_of_many(left: DataFrame, right: DataFrame, keys: list[str], right_id: str, cell: float, carry: Sequence[str], least: float, crowded: DataFrame) -> DataFrame:
    """:func:`best_overlap` of any shapes, crowded or not."""
    shape = geometry(left, right)
    lboxes = left.select(*keys, *shape).distinct()
    payload = F.struct(F.col(right_id), *carry)
    rboxes = right.groupBy(*keys, *shape).agg(F.min(payload).alias("p"))
    pairs = overlapping(lboxes, rboxes, keys, cell, least, crowded)
    own = whole_key([*keys, *shape])
    best = pairs.groupBy(own.alias("_own")).agg(F.min(F.struct((-F.col("iou")).alias("neg"), F.col("r_p"))).alias("b"))
    found = best.select(
        "_own", (-F.col("b.neg")).alias("iou"), F.col(f"b.r_p.{right_id}").alias(f"best_{right_id}"),
        *[F.col(f"b.r_p.{c}").alias(f"best_{c}") for c in carry],
    )
    return _by_whole_key(left, [*keys, *shape], found, "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def _by_whole_key(df: DataFrame, columns: Sequence[str], other: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` joined with ``other`` by the key ``_own`` made of ``columns``, which travel inside it only."""
    rest = [c for c in df.columns if c not in columns]
    met = df.select(whole_key(columns).alias("_own"), *rest).join(other, "_own", how)
    return met.select(*[F.col(f"_own.{c}") if c in columns else F.col(c) for c in df.columns], *[c for c in other.columns if c != "_own"])


def best_other(df: DataFrame, keys: Sequence[str], id_col: str, cell: float = DEFAULT_CELL) -> DataFrame:
    """Each row's best partner among the other rows of its keys: ``partner`` and ``iou``.

    An exact copy is an IoU of 1; the two smallest ids of a copy group are enough to name everyone's partner.
    """
    keys = list(keys)
    if geometry(df) != list(BOX) or id_col in [*keys, *BOX]:
        return _best_other_of_many(df, keys, id_col, cell, _crowded(df, df, keys))
    uneven = cut_lineage(_uneven(df, df, keys, F.col(id_col).isNull()))
    few, many = _parted(df, uneven, keys)
    out = _best_other_of_few(few, keys, id_col)
    return out if many is None else out.unionByName(_best_other_of_many(many, keys, id_col, cell, uneven.where("_crowded")))


def _best_other_of_few(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """:func:`best_other` of boxes whose keys hold ``CROWDED`` of them at most, with no id missing: they are shuffled once, by key, and work there."""
    kind = df.schema[id_col].dataType
    fields = [T.StructField(c, df.schema[c].dataType) for c in df.columns]
    fields += [T.StructField(c, kind) for c in ("first", "second", "b_id")] + [T.StructField("b_iou", T.DoubleType())]
    found = _begun(df.where(has_area()), keys, [id_col]).mapInArrow(best_others(df.columns, id_col), T.StructType(fields))
    copied = F.col("second").isNotNull()
    partner = F.when(copied, F.when(F.col(id_col) == F.col("first"), F.col("second")).otherwise(F.col("first"))).otherwise(F.col("b_id"))
    scored = found.withColumns({"partner": partner, "iou": F.when(copied, F.lit(1.0)).otherwise(F.col("b_iou"))}).drop("first", "second", "b_id", "b_iou")
    return scored.unionByName(df.where(~has_area()).withColumns({"partner": F.lit(None).cast(kind), "iou": F.lit(0.0)}))


def _best_other_of_many(df: DataFrame, keys: list[str], id_col: str, cell: float, crowded: DataFrame) -> DataFrame:
    """:func:`best_other` of any shapes, crowded or not."""
    shape = geometry(df)
    group = [*keys, *shape]
    # the rank filter is applied before the shuffle, so a hot copy group sends two rows per task
    two = (
        df.select(*group, id_col)
        .withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(id_col)))
        .where("_r <= 2")
        .groupBy(*group)
        .agg(F.min(id_col).alias("first"), F.max(F.when(F.col("_r") == 2, F.col(id_col))).alias("second"))
    )
    pairs = overlapping(two.select(*group, "first"), two.select(*group, "first"), keys, cell, crowded=crowded)
    distinct_boxes = ~F.struct(*shape).eqNullSafe(F.struct(*[F.col(f"r_{c}").alias(c) for c in shape]))
    own = whole_key(group)
    best = pairs.where(distinct_boxes).groupBy(own.alias("_own")).agg(
        F.min(F.struct((-F.col("iou")).alias("neg"), F.col("r_first").alias("id"))).alias("b")
    )
    info = two.select(own.alias("_own"), "first", "second").join(best, "_own", "left")
    copied = F.col("second").isNotNull() & has_area()
    partner = F.when(copied, F.when(F.col(id_col) == F.col("first"), F.col("second")).otherwise(F.col("first"))).otherwise(F.col("b.id"))
    iou = F.when(copied, F.lit(1.0)).otherwise(F.coalesce(-F.col("b.neg"), F.lit(0.0)))
    return _by_whole_key(df, group, info).withColumns({"partner": partner, "iou": iou}).drop("first", "second", "b")
