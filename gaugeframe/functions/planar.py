"""Edges of large polygons by grid buckets: crossings, simplicity, and the area a crossing outline really covers.

Edges are dealt to the grid cells they pass through, column by column, so only edges of one cell are compared, all pairs of a cell at the same time.  An outline
of n short edges costs about n such pairs, where comparing all edges would cost n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MARGIN = 1e-9  # of the extent: covers rounding at cell borders


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every integer of the ranges [first, last], and the number of the range it belongs to."""
    count = last - first + 1
    owner = np.repeat(np.arange(len(first)), count)
    return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def _cells(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, edge) for every grid cell an edge passes through.

    The grid is as fine as keeps an edge in a few cells on average, and has at least as many columns and rows as the root of the edges.
    """
    low_x, low_y = min(x0.min(), x1.min()), min(y0.min(), y1.min())
    wide, high = max(np.ptp(np.r_[x0, x1]), 1e-300), max(np.ptp(np.r_[y0, y1]), 1e-300)
    length = (np.abs(x1 - x0) / wide + np.abs(y1 - y0) / high).sum()
    side = int(min(max(np.sqrt(len(x0)), 4 * len(x0) / max(length, 1e-9)), 1 << 20)) or 1
    left, right = np.minimum(x0, x1), np.maximum(x0, x1)

    def place(v: np.ndarray, low: float, extent: float, shift: float) -> np.ndarray:
        return np.clip(np.floor(((v - low) / extent + shift) * side), 0, side - 1).astype(np.int64)

    column, edge = _spread(place(left, low_x, wide, -MARGIN), place(right, low_x, wide, MARGIN))
    # the part of the edge over its column
    from_x = np.maximum(left[edge], low_x + (column / side - MARGIN) * wide)
    to_x = np.minimum(right[edge], low_x + ((column + 1) / side + MARGIN) * wide)
    dx, dy = (x1 - x0)[edge], (y1 - y0)[edge]
    steep = np.abs(dx) <= MARGIN * wide
    slope = dy / np.where(steep, 1, dx)
    ya = np.where(steep, y0[edge], y0[edge] + (from_x - x0[edge]) * slope)
    yb = np.where(steep, y1[edge], y0[edge] + (to_x - x0[edge]) * slope)
    row, at = _spread(place(np.minimum(ya, yb), low_y, high, -MARGIN), place(np.maximum(ya, yb), low_y, high, MARGIN))
    return column[at] * side + row, edge[at]


def neighbours(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of edges that share a cell, in batches; a pair may come more than once."""
    cell, edge = _cells(x0, y0, x1, y1)
    order = np.lexsort((edge, cell))
    cell, edge = cell[order], edge[order]
    for step in range(1, len(cell)):
        same = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(same):
            return
        yield edge[same], edge[same + step]


def _turn(ox, oy, ax, ay, bx, by):
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def meet(x0, y0, x1, y1, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether edges i and j share a point."""
    a, b, c, d = (x0[i], y0[i]), (x1[i], y1[i]), (x0[j], y0[j]), (x1[j], y1[j])
    apart = np.zeros(len(i), dtype=bool)
    for k in (0, 1):
        apart |= np.maximum(np.minimum(a[k], b[k]), np.minimum(c[k], d[k])) > np.minimum(np.maximum(a[k], b[k]), np.maximum(c[k], d[k]))
    return ~apart & (_turn(*a, *b, *c) * _turn(*a, *b, *d) <= 0) & (_turn(*c, *d, *a) * _turn(*c, *d, *b) <= 0)


def _edges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    after = np.roll(points, -1, axis=0)
    return points[:, 0], points[:, 1], after[:, 0], after[:, 1]


def crosses_itself(points: np.ndarray) -> bool:
    """Whether two edges that do not follow one another share a point."""
    e, n = _edges(points), len(points)
    for i, j in neighbours(*e):
        far = (j - i > 1) & (j - i < n - 1)
        if meet(*e, i[far], j[far]).any():
            return True
    return False


def _crossing_xs(e: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    x0, y0, x1, y1 = e
    dx, dy = x1 - x0, y1 - y0
    out = []
    for i, j in neighbours(*e):
        det = dx[i] * dy[j] - dy[i] * dx[j]
        ok = det != 0
        i, j, det = i[ok], j[ok], det[ok]
        ox, oy = x0[j] - x0[i], y0[j] - y0[i]
        t, u = (ox * dy[j] - oy * dx[j]) / det, (ox * dy[i] - oy * dx[i]) / det
        hit = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out.append(x0[i[hit]] + t[hit] * dx[i[hit]])
    return out


def covered_area(*outlines: np.ndarray, slabs_at_once: int = 1 << 12) -> float:
    """Area of all places that every one of the outlines winds around, however often and in whichever direction.

    The plane is cut at every corner and crossing into vertical slabs, in which no two edges cross; inside one, the winding number between two neighbouring edges
    is the sum of the directions of the edges below, and the places where it is not zero are trapezoids, measured at the middle of the slab.
    """
    if any(len(points) < 3 for points in outlines):
        return 0.0
    e = tuple(np.concatenate(c) for c in zip(*[_edges(points) for points in outlines]))
    owner = np.repeat(np.arange(len(outlines)), [len(points) for points in outlines])
    x0, y0, x1, y1 = e
    xs = np.unique(np.concatenate([x0, *_crossing_xs(e)]))
    if len(xs) < 2:
        return 0.0
    first, last = np.searchsorted(xs, np.minimum(x0, x1)), np.searchsorted(xs, np.maximum(x0, x1)) - 1
    total = 0.0
    for a in range(0, len(xs) - 1, slabs_at_once):
        b = min(a + slabs_at_once, len(xs) - 1) - 1
        over = np.flatnonzero((first <= b) & (last >= a))
        slab, k = _spread(np.maximum(first[over], a), np.minimum(last[over], b))
        edge = over[k]
        mid = (xs[slab] + xs[slab + 1]) / 2
        y = y0[edge] + (mid - x0[edge]) * (y1[edge] - y0[edge]) / (x1[edge] - x0[edge])
        order = np.lexsort((y, slab))
        slab, y, edge = slab[order], y[order], edge[order]
        # a closed outline enters and leaves every slab equally often, so the sum starts at zero again in the next one
        turns = np.where(x1[edge] > x0[edge], 1, -1)
        inside = np.ones(max(len(edge) - 1, 0), dtype=bool)
        for k in range(len(outlines)):
            inside &= np.cumsum(np.where(owner[edge] == k, turns, 0))[:-1] != 0
        inside = np.flatnonzero(inside)
        total += float(((xs[slab[inside] + 1] - xs[slab[inside]]) * (y[inside + 1] - y[inside])).sum())
    return total
