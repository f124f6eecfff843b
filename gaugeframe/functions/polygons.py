"""Polygon measures: Hu moments in closed form, validity and overlap of general polygons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, DoubleType

from gaugeframe.functions.boxes import polygon_area
from gaugeframe.functions.masks import POWERS, rle_moments
from gaugeframe.functions.planar import covered_area, crosses_itself
from gaugeframe.functions.polygon_batches import covered as covered_rows, in_groups, ious, simple

FEW = 24  # corners up to which comparing all edges is the quicker way to the same answer


def _raw_moments(points: Column) -> dict[str, Column]:
    """Moments up to order three by Green's theorem; orientation does not matter."""
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))

    def total(term) -> Column:
        cross = F.zip_with(points, nxt, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]) * term(p["x"], p["y"], q["x"], q["y"]))
        return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)

    one = F.lit(1.0)
    m = {
        "00": total(lambda x, y, u, v: one) / 2,
        "10": total(lambda x, y, u, v: x + u) / 6,
        "01": total(lambda x, y, u, v: y + v) / 6,
        "20": total(lambda x, y, u, v: x * x + x * u + u * u) / 12,
        "11": total(lambda x, y, u, v: x * (y * 2 + v) + u * (y + v * 2)) / 24,
        "02": total(lambda x, y, u, v: y * y + y * v + v * v) / 12,
        "30": total(lambda x, y, u, v: (x + u) * (x * x + u * u)) / 20,
        "21": total(lambda x, y, u, v: x * x * (y * 3 + v) + x * u * (y + v) * 2 + u * u * (y + v * 3)) / 60,
        "12": total(lambda x, y, u, v: y * y * (x * 3 + u) + y * v * (x + u) * 2 + v * v * (x + u * 3)) / 60,
        "03": total(lambda x, y, u, v: (y + v) * (y * y + v * v)) / 20,
    }
    return m


def with_hu_moments(df, points: str, out: str = "hu"):
    """Seven Hu moments of the filled polygon, null without area. Each step is its own projection to keep plans small."""
    return _invariants(df.withColumns({f"_m{k}": v for k, v in _raw_moments(F.col(points)).items()}), out)


def with_mask_hu_moments(df, rle: str, out: str = "hu"):
    """Seven Hu moments of a run-length mask, null for an empty one; the mask is never decoded."""
    df = df.withColumn("_sums", rle_moments(F.col(rle)))
    return _invariants(df.withColumns({f"_m{p}{q}": F.get("_sums", F.lit(i)) for i, (p, q) in enumerate(POWERS)}).drop("_sums"), out)


def _invariants(df, out: str):
    """Hu moments from the raw moments in ``_m00`` to ``_m03``, which are dropped."""
    names = [f"_m{k}" for k in ("00", "10", "01", "20", "11", "02", "30", "21", "12", "03")]
    sign = F.signum("_m00")
    # without area every derived moment is null
    df = df.withColumns({n: F.col(n) * sign for n in names[1:]} | {"_m00": F.nullif(F.abs("_m00"), F.lit(0.0))})
    df = df.withColumns({"_x": F.col("_m10") / F.col("_m00"), "_y": F.col("_m01") / F.col("_m00")})
    x, y = F.col("_x"), F.col("_y")
    m = {n[2:]: F.col(n) for n in names}
    mu = {
        "20": m["20"] - x * m["10"],
        "11": m["11"] - x * m["01"],
        "02": m["02"] - y * m["01"],
        "30": m["30"] - x * m["20"] * 3 + x * x * m["10"] * 2,
        "21": m["21"] - x * m["11"] * 2 - y * m["20"] + x * x * m["01"] * 2,
        "12": m["12"] - y * m["11"] * 2 - x * m["02"] + y * y * m["10"] * 2,
        "03": m["03"] - y * m["02"] * 3 + y * y * m["01"] * 2,
    }
    df = df.withColumns({f"_n{k}": v / F.pow("_m00", F.lit(1.0 + (int(k[0]) + int(k[1])) / 2)) for k, v in mu.items()})
    n = {k: F.col(f"_n{k}") for k in mu}
    a, b = n["30"] + n["12"], n["21"] + n["03"]
    c, d = n["30"] - n["12"] * 3, n["21"] * 3 - n["03"]
    e = n["20"] - n["02"]
    hu = [
        n["20"] + n["02"],
        e * e + n["11"] * n["11"] * 4,
        c * c + d * d,
        a * a + b * b,
        c * a * (a * a - b * b * 3) + d * b * (a * a * 3 - b * b),
        e * (a * a - b * b) + n["11"] * a * b * 4,
        d * a * (a * a - b * b * 3) - c * b * (a * a * 3 - b * b),
    ]
    df = df.withColumn(out, F.when(F.col("_m00") > 0, F.array(*hu)))
    return df.drop(*names, "_x", "_y", *[f"_n{k}" for k in mu])


Points = list[tuple[float, float]]


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _edges(p: Points):
    return zip(p, p[1:] + p[:1])


def _meet(a, b, c, d) -> bool:
    """Do the segments a-b and c-d share a point?"""
    if max(min(a[0], b[0]), min(c[0], d[0])) > min(max(a[0], b[0]), max(c[0], d[0])):
        return False
    if max(min(a[1], b[1]), min(c[1], d[1])) > min(max(a[1], b[1]), max(c[1], d[1])):
        return False
    return _turn(a, b, c) * _turn(a, b, d) <= 0 and _turn(c, d, a) * _turn(c, d, b) <= 0


def is_simple(p: Points) -> bool:
    """At least three points, some area, and no two non-adjacent edges crossing or touching."""
    n = len(p)
    if n < 3 or _area(p) == 0:
        return False
    if n > FEW:
        return not crosses_itself(np.array(p))
    e = list(_edges(p))
    return not any(_meet(*e[i], *e[j]) for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1))


def _area(p: Points) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in _edges(p)) / 2


def _convex(p: Points) -> bool:
    turns = [_turn(a, b, c) for a, b, c in zip(p, p[1:] + p[:1], p[2:] + p[:2])]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def _clip(subject: Points, window: Points) -> Points:
    """Part of a polygon inside a convex, counter-clockwise window."""
    out = subject
    for a, b in _edges(window):
        side = [_turn(a, b, q) for q in out]
        kept: Points = []
        for (p, s), (q, t) in zip(zip(out, side), zip(out[1:] + out[:1], side[1:] + side[:1])):
            if s >= 0:
                kept.append(p)
            if s * t < 0:
                f = s / (s - t)
                kept.append((p[0] + (q[0] - p[0]) * f, p[1] + (q[1] - p[1]) * f))
        out = kept
        if not out:
            break
    return out


def slabs(shapes: Sequence[Points]) -> Iterator[tuple[float, list[list[tuple[float, float]]]]]:
    """Width and, per shape, the intervals covered at mid-slab, for vertical slabs in which no two edges cross.

    Inside such a slab all interval ends are linear in x, so any union or intersection of the intervals has an area of width times
    its length at the middle: sums over slabs are exact.
    """
    edges = np.array([(*a, *b, k) for k, p in enumerate(shapes) for a, b in _edges(p)], dtype=float).reshape(-1, 5)
    x0, y0, x1, y1, owner = edges.T
    # crossings of all edge pairs at once
    dx, dy = x1 - x0, y1 - y0
    det = dx[:, None] * dy[None, :] - dy[:, None] * dx[None, :]
    ox, oy = x0[None, :] - x0[:, None], y0[None, :] - y0[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (ox * dy[None, :] - oy * dx[None, :]) / det
        u = (ox * dy[:, None] - oy * dx[:, None]) / det
    i, j = np.nonzero((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    xs = np.unique(np.concatenate([x0, x0[i] + t[i, j] * dx[i]]))
    for a, b in zip(xs, xs[1:]):
        mid = (a + b) / 2
        over = (np.minimum(x0, x1) < mid) & (np.maximum(x0, x1) > mid)
        y = y0[over] + (mid - x0[over]) * dy[over] / dx[over]
        own = owner[over]
        cuts = [np.sort(y[own == k]) for k in range(len(shapes))]
        yield b - a, [list(zip(c[::2], c[1::2])) for c in cuts]


def union_area(shapes: Sequence[Points]) -> float:
    """Area under at least one of the polygons."""
    total = 0.0
    for width, parts in slabs([p for p in shapes if len(p) >= 3]):
        reach = -np.inf
        for a, b in sorted(x for part in parts for x in part):
            total += width * max(0.0, b - max(a, reach))
            reach = max(reach, b)
    return total


def covered(shapes: Sequence[Points], x0: float, y0: float, x1: float, y1: float, depth: int = 0, edges: int = 200) -> float:
    """Area of a rectangle under at least one polygon; a crowded rectangle is quartered, so edge pairs stay few."""
    window = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    parts = [c for c in (_clip(list(s), window) for s in shapes) if len(c) >= 3 and _area(c) != 0]
    whole = (x1 - x0) * (y1 - y0)
    if any(abs(_area(c)) >= whole * (1 - 1e-12) for c in parts):
        return whole
    if sum(map(len, parts)) <= edges or depth >= 10:
        return union_area(parts)
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    return sum(covered(parts, *q, depth + 1, edges) for q in ((x0, y0, x, y), (x, y0, x1, y), (x0, y, x, y1), (x, y, x1, y1)))


def _traits(p: Points, known: dict) -> tuple[bool, bool, float]:
    """Whether a polygon is simple, whether it is convex, and its signed area; a batch meets the same polygons again and again."""
    key = tuple(p)
    if key not in known:
        simple = is_simple(p)
        known[key] = (simple, simple and _convex(p), _area(p))
    return known[key]


def _fan_overlap(p: Points, q: Points) -> float:
    """Signed area of the intersection: q is the signed sum of the triangles at its first corner, and each clips p as a convex window."""
    total = 0.0
    for b, c in zip(q[1:], q[2:]):
        turn = _turn(q[0], b, c)
        if turn:
            cut = _clip(p, [q[0], b, c] if turn > 0 else [q[0], c, b])
            if len(cut) >= 3:
                total += abs(_area(cut)) if turn > 0 else -abs(_area(cut))
    return total


def overlap(p: Points, q: Points, known: dict | None = None) -> float:
    """IoU of valid polygons, exact: clipping at the convex one, or at the triangles of one when both are concave."""
    known = {} if known is None else known
    (simple_p, convex_p, area_p), (simple_q, convex_q, area_q) = _traits(p, known), _traits(q, known)
    if not (simple_p and simple_q):
        return 0.0
    if max(len(p), len(q)) > FEW:
        inter = covered_area(np.array(p), np.array(q))
    elif convex_p or convex_q:
        window, subject, turned = (q, p, area_q) if convex_q else (p, q, area_p)
        cut = _clip(subject, window if turned > 0 else window[::-1])
        inter = abs(_area(cut)) if len(cut) >= 3 else 0.0
    else:
        inter = abs(_fan_overlap(p, q))
    union = abs(area_p) + abs(area_q) - inter
    return min(inter / union, 1.0) if union > 0 else 0.0


def split(points: Column) -> tuple[Column, Column]:
    """Coordinates as two arrays, which cross to Python as plain numbers."""
    return F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])


def _zip(xs, ys) -> Points:
    return list(zip(xs.tolist(), ys.tolist()))


def _known(values: np.ndarray) -> pa.Array:
    """NaN, from a missing coordinate, is null."""
    return pa.array(values, mask=np.isnan(values))


@F.arrow_udf(BooleanType())
def _simple(xs: pa.Array, ys: pa.Array) -> pa.Array:
    return pa.array(in_groups([xs, ys], simple, lambda x, y: is_simple(_zip(x, y)), False))


def row_ious(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> np.ndarray:
    """IoU of the polygons of every row; 0 when either is invalid, NaN from a missing coordinate."""
    known: dict = {}
    return in_groups([ax, ay, bx, by], ious, lambda a, b, c, d: overlap(_zip(a, b), _zip(c, d), known), 0.0)


@F.arrow_udf(DoubleType())
def _iou(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
    return _known(row_ious(ax, ay, bx, by))


# else a filter on the result would be planned below it, with a second run of its own
_iou = _iou.asNondeterministic()


@F.arrow_udf(DoubleType())
def _covered(xs: pa.Array, ys: pa.Array) -> pa.Array:
    return _known(in_groups([xs, ys], covered_rows, lambda x, y: covered_area(np.stack([x, y], axis=1)), np.nan))


def simple_polygon_check(points: Column) -> Column:
    """True for polygons of at least three points without self-intersection."""
    return _simple(*split(points))


def polygon_iou(a: Column, b: Column) -> Column:
    """IoU of two polygons; 0 when either is invalid."""
    return _iou(*split(a), *split(b))


def repaired_area(points: Column) -> Column:
    """Area of the places a polygon winds around; fewer than three points have none.

    That is the shoelace area unless the polygon crosses itself.  Up to four corners that all turn the same way cannot cross, so triangles and
    boxes stay out of Python.
    """
    n = F.size(points)

    def turn(i: Column) -> Column:
        p, q, r = (F.get(points, (i + k) % 4) for k in range(3))
        return (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])

    turns = F.transform(F.array(*[F.lit(i) for i in range(4)]), turn)
    one_way = F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)
    plain = F.coalesce((n < 4) | F.when(n == 4, one_way).otherwise(False), F.lit(False))
    return F.when(plain, polygon_area(points)).otherwise(_covered(*split(F.when(~plain, points))))
