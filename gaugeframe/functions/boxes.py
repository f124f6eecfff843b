"""Box and polygon geometry as Column expressions. Boxes are (x, y, w, h) relative to the frame."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _pt(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def box_points(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners in drawing order; a rotatable box is taken unrotated, as all metrics do."""
    return F.array(_pt(x, y), _pt(x + w, y), _pt(x + w, y + h), _pt(x, y + h))


def rotated_box_points(x: Column, y: Column, w: Column, h: Column, theta: Column, width: Column, height: Column) -> Column:
    """Corners in pixels, turned by theta degrees about the centre."""
    px, py, pw, ph = x * width, y * height, w * width, h * height
    cx, cy = px + pw / 2, py + ph / 2
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))

    def turn(p: Column) -> Column:
        dx, dy = p["x"] - cx, p["y"] - cy
        return _pt(cx + dx * c - dy * s, cy + dx * s + dy * c)

    return F.transform(box_points(px, py, pw, ph), turn)


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union; 0 when the boxes do not overlap with positive area, never above 1 by rounding."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    ix = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    iy = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    inter = ix * iy
    return F.when((ix > 0) & (iy > 0), F.least(inter / (aw * ah + bw * bh - inter), F.lit(1.0))).otherwise(F.lit(0.0))


def polygon_area(points: Column) -> Column:
    """Shoelace area of a simple polygon; fewer than three points have none."""
    shifted = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    total = F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(total) / 2)


def relative_area(area: Column) -> Column:
    """Per cent of the frame."""
    return area * F.lit(100.0)


def absolute_area(area: Column, width: Column, height: Column) -> Column:
    return F.floor(width * height * area).cast("long")


def object_aspect_ratio(w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel width over height; null for a flat box."""
    return F.when(h != 0, (w * width) / (h * height))


def border_closeness(points: Column) -> Column:
    """1 when a point lies on the frame border, about 0.5 at the centre."""
    return F.array_max(
        F.transform(points, lambda p: F.greatest(p["x"], p["y"], F.lit(1.0) - p["x"], F.lit(1.0) - p["y"]))
    )


def frame_area(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), width * height)


def frame_aspect_ratio(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), width / height)


def polygon_bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")
    )


def pixel_bounds(points: Column, width: Column, height: Column) -> Column:
    """Bounds in pixels, two decimals."""
    b = polygon_bounds(points)
    scale = {"x1": width, "y1": height, "x2": width, "y2": height}
    return F.struct(*[(F.floor(b[k] * s * 100.0 + F.lit(0.5)) / F.lit(100.0)).alias(k) for k, s in scale.items()])


def box_valid(x: Column, y: Column, w: Column, h: Column) -> Column:
    inside = (x >= 0) & (y >= 0) & (w >= 0) & (h >= 0) & (x <= 1) & (y <= 1)
    return inside & (x + w <= 1) & (y + h <= 1)


def points_valid(points: Column) -> Column:
    return F.forall(points, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1))


def mask_valid(mask: Column) -> Column:
    return F.forall(mask, lambda v: v.isin(0, 1))


def exactly_one(a: Column, b: Column) -> Column:
    """A prediction holds either an object or a classification."""
    return a.isNotNull() != b.isNotNull()


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Clip a pixel box to the frame; null when it starts beyond the right or lower edge."""
    x0, y0 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    clipped = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return F.when((x <= width) & (y <= height), clipped)
