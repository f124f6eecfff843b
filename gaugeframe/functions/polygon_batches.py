"""Simplicity and overlap of many small polygons at once: pairs of equal corner counts are rows of arrays, and every step works on all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from gaugeframe.functions.planar import covered_area

SMALL = 16  # corners up to which polygons are worked on in batches
BLOCK = 1024  # polygons whose slabs are in memory at a time
PARTS = 1 << 20  # parts of edges, or pairs of edges, in memory at a time


def _next(a: np.ndarray) -> np.ndarray:
    return np.roll(a, -1, axis=1)


def areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed areas of (rows, corners)."""
    return (x * _next(y) - _next(x) * y).sum(axis=1) / 2


def simple(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least three corners, some area, and no two non-adjacent edges crossing or touching."""
    n = x.shape[1]
    if n < 3:
        return np.zeros(len(x), dtype=bool)
    u, v = _next(x), _next(y)
    out = areas(x, y) != 0

    def turn(i: int, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        return (u[:, i] - x[:, i]) * (py - y[:, i]) - (v[:, i] - y[:, i]) * (px - x[:, i])

    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            apart = np.zeros(len(x), dtype=bool)
            for a, b in ((x, u), (y, v)):
                apart |= np.maximum(np.minimum(a[:, i], b[:, i]), np.minimum(a[:, j], b[:, j])) > np.minimum(np.maximum(a[:, i], b[:, i]), np.maximum(a[:, j], b[:, j]))
            meets = (turn(i, x[:, j], y[:, j]) * turn(i, u[:, j], v[:, j]) <= 0) & (turn(j, x[:, i], y[:, i]) * turn(j, u[:, i], v[:, i]) <= 0)
            out &= apart | ~meets
    return out


def _clip(x: np.ndarray, y: np.ndarray, n: np.ndarray, ax, ay, bx, by) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of each row's polygon (``n`` corners) lies left of its line a-b."""
    at = np.arange(x.shape[1])[None, :]
    valid = at < n[:, None]
    after = np.where(at + 1 < n[:, None], at + 1, 0)
    s = (bx - ax)[:, None] * (y - ay[:, None]) - (by - ay)[:, None] * (x - ax[:, None])
    t = np.take_along_axis(s, after, axis=1)
    cross = valid & (s * t < 0)
    f = np.divide(s, s - t, out=np.zeros_like(s), where=cross)
    flags = np.stack([valid & (s >= 0), cross], axis=2).reshape(len(x), -1)
    count = flags.sum(axis=1)
    place = np.cumsum(flags, axis=1) - 1
    row, column = np.nonzero(flags)
    out = []
    for c in (x, y):
        both = np.stack([c, c + (np.take_along_axis(c, after, axis=1) - c) * f], axis=2).reshape(len(x), -1)
        new = np.zeros((len(x), max(int(count.max(initial=0)), 1)))
        new[row, place[row, column]] = both[row, column]
        out.append(new)
    return out[0], out[1], count


def intersections(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """Areas common to the simple polygons of each row: q is the signed sum of the triangles at its first corner, and each clips p as a window."""
    total = np.zeros(len(px))
    for k in range(1, qx.shape[1] - 1):
        corners = [(qx[:, i], qy[:, i]) for i in (0, k, k + 1)]
        (ox, oy), (ax, ay), (bx, by) = corners
        turn = (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)
        left = turn > 0
        second = (np.where(left, ax, bx), np.where(left, ay, by))
        third = (np.where(left, bx, ax), np.where(left, by, ay))
        x, y, n = px, py, np.full(len(px), px.shape[1])
        for (lx, ly), (mx, my) in (((ox, oy), second), (second, third), (third, (ox, oy))):
            x, y, n = _clip(x, y, n, lx, ly, mx, my)
        at = np.arange(x.shape[1])[None, :]
        valid = at < n[:, None]
        after = np.where(at + 1 < n[:, None], at + 1, 0)
        cross = x * np.take_along_axis(y, after, axis=1) - np.take_along_axis(x, after, axis=1) * y
        total += np.sign(turn) * np.abs((cross * valid).sum(axis=1)) / 2
    return np.abs(total)


def ious(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """IoU of each row's polygons; 0 when either is invalid."""
    if px.shape[1] < qx.shape[1]:
        px, py, qx, qy = qx, qy, px, py
    out = np.zeros(len(px))
    ok = np.flatnonzero(simple(px, py) & simple(qx, qy))
    if not len(ok):
        return out
    px, py, qx, qy = px[ok], py[ok], qx[ok], qy[ok]
    common = intersections(px, py, qx, qy)
    union = np.abs(areas(px, py)) + np.abs(areas(qx, qy)) - common
    out[ok] = np.minimum(np.divide(common, union, out=np.zeros_like(common), where=union > 0), 1.0)
    return out


def covered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Area of the places each row's polygon winds around: vertical slabs between all corners and crossings, as in ``planar.covered_area``."""
    n = x.shape[1]
    if n < 3:
        return np.zeros(len(x))
    out = np.empty(len(x))
    for a in range(0, len(x), BLOCK):
        out[a : a + BLOCK] = _covered(x[a : a + BLOCK], y[a : a + BLOCK])
    for i in np.flatnonzero(~np.isfinite(x + y).all(axis=1)):
        out[i] = covered_area(np.stack([x[i], y[i]], axis=1))
    return out


def _covered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    u, v = _next(x), _next(y)
    dx, dy = u - x, v - y
    cuts = [x]
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(n):
            j = np.arange(i + 2, n - (i == 0))
            det = dx[:, [i]] * dy[:, j] - dy[:, [i]] * dx[:, j]
            ox, oy = x[:, j] - x[:, [i]], y[:, j] - y[:, [i]]
            t, s = (ox * dy[:, j] - oy * dx[:, j]) / det, (ox * dy[:, [i]] - oy * dx[:, [i]]) / det
            # no crossing: a corner again, whose slab has no width
            cuts.append(np.where((det != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1), x[:, [i]] + t * dx[:, [i]], x[:, [i]]))
        cuts = np.sort(np.concatenate(cuts, axis=1), axis=1)
        mid = ((cuts[:, :-1] + cuts[:, 1:]) / 2)[:, :, None]
        over = (np.minimum(x, u)[:, None, :] < mid) & (np.maximum(x, u)[:, None, :] > mid)
        at = np.where(over, y[:, None, :] + (mid - x[:, None, :]) * (dy / dx)[:, None, :], np.inf)
        order = np.argsort(at, axis=2, kind="stable")
        at = np.take_along_axis(at, order, axis=2)
        turns = np.take_along_axis(np.where(over, np.sign(dx)[:, None, :], 0.0), order, axis=2)
        # a slab of the last digit's width may miss an edge at its middle
        inside = (np.cumsum(turns, axis=2)[:, :, :-1] != 0) & np.isfinite(at[:, :, 1:])
        lengths = np.where(inside, at[:, :, 1:] - at[:, :, :-1], 0.0).sum(axis=2)
    return (lengths * np.diff(cuts, axis=1)).sum(axis=1)


def union_areas(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, owner: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Area under at least one polygon (an even-odd outline each) of every group.

    The edges of all polygons come as one array each, with the numbers of their polygon and of their group (from 0, none left out).  Groups
    are cut at corners and crossings into vertical slabs, in which no two edges cross, and the slabs of all groups are worked on together.
    """
    groups = int(group.max(initial=-1)) + 1
    cut_group, cut_x = [group], [x0]
    for i, j in _slanted_pairs(x0, y0, x1, y1, group):
        dx, dy, ex, ey = x1[i] - x0[i], y1[i] - y0[i], x1[j] - x0[j], y1[j] - y0[j]
        det = dx * ey - dy * ex
        ox, oy = x0[j] - x0[i], y0[j] - y0[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, s = (ox * ey - oy * ex) / det, (ox * dy - oy * dx) / det
            hit = (det != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
        cut_group.append(group[i[hit]])
        cut_x.append(x0[i[hit]] + t[hit] * dx[hit])
    cut_group, cut_x = np.concatenate(cut_group), np.concatenate(cut_x)
    order = np.lexsort((cut_x, cut_group))
    cut_group, cut_x = cut_group[order], cut_x[order]
    new = np.r_[True, (np.diff(cut_group) != 0) | (np.diff(cut_x) != 0)] if len(order) else np.zeros(0, dtype=bool)
    cut_group, cut_x = cut_group[new], cut_x[new]
    # an edge begins and ends at cuts of its own group, whose places follow from one more sort of cuts and ends together
    left, right = np.minimum(x0, x1), np.maximum(x0, x1)
    leaning = np.flatnonzero(right > left)
    first, last = _places(cut_group, cut_x, group[leaning], left[leaning]), _places(cut_group, cut_x, group[leaning], right[leaning])
    total = np.zeros(groups)
    # whole groups at a time, so that the parts of edges stay within memory
    size = np.zeros(groups, dtype=np.int64)
    np.add.at(size, group[leaning], last - first)
    block = np.cumsum(size) // PARTS
    for b in np.unique(block[size > 0]):
        mine = np.flatnonzero(block[group[leaning]] == b)
        count = (last - first)[mine]
        edge = np.repeat(leaning[mine], count)
        slab = np.repeat(first[mine], count) + np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
        mid = (cut_x[slab] + cut_x[slab + 1]) / 2
        y = y0[edge] + (mid - x0[edge]) * (y1[edge] - y0[edge]) / (x1[edge] - x0[edge])
        order = np.lexsort((y, owner[edge], slab))
        slab, y, whose = slab[order], y[order], owner[edge][order]
        # by turns an outline is entered and left
        begin = np.r_[True, (np.diff(slab) != 0) | (np.diff(whose) != 0)]
        rank = np.arange(len(slab)) - np.maximum.accumulate(np.where(begin, np.arange(len(slab)), 0))
        step = np.where(rank % 2 == 0, 1, -1)
        order = np.lexsort((-step, y, slab))
        slab, y, step = slab[order], y[order], step[order]
        inside = np.flatnonzero((np.cumsum(step)[:-1] > 0) & (slab[1:] == slab[:-1]))
        at = slab[inside]
        total += np.bincount(cut_group[at], (cut_x[at + 1] - cut_x[at]) * (y[inside + 1] - y[inside]), groups)
    return total


def _places(cut_group: np.ndarray, cut_x: np.ndarray, group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each (group, x) among the sorted cuts, which hold it."""
    order = np.lexsort((np.r_[np.zeros(len(cut_x)), np.ones(len(x))], np.r_[cut_x, x], np.r_[cut_group, group]))
    is_cut = order < len(cut_x)
    place = np.cumsum(is_cut) - 1
    out = np.empty(len(x), dtype=np.int64)
    out[order[~is_cut] - len(cut_x)] = place[~is_cut]
    return out


def _slanted_pairs(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges of a group that can cross at no corner's x: one of them slanted, the other not upright; in batches.

    Edges along the axes cross at the x of an upright one, so boxes give no pairs at all."""
    flat = np.flatnonzero((x0 != x1) & (y0 == y1))
    slanted = np.flatnonzero((x0 != x1) & (y0 != y1))
    for other, same in ((slanted, True), (flat, False)):
        other = other[np.argsort(group[other], kind="stable")]
        low, high = np.searchsorted(group[other], group[slanted]), np.searchsorted(group[other], group[slanted], "right")
        count = high - low
        block = np.cumsum(count) // PARTS
        for b in np.unique(block[count > 0]):
            mine = np.flatnonzero(block == b)
            i = np.repeat(slanted[mine], count[mine])
            j = other[np.repeat(low[mine], count[mine]) + np.arange(len(i)) - np.repeat(np.cumsum(count[mine]) - count[mine], count[mine])]
            keep = (np.minimum(x0[i], x1[i]) < np.maximum(x0[j], x1[j])) & (np.minimum(x0[j], x1[j]) < np.maximum(x0[i], x1[i]))
            keep &= (np.minimum(y0[i], y1[i]) <= np.maximum(y0[j], y1[j])) & (np.minimum(y0[j], y1[j]) <= np.maximum(y0[i], y1[i]))
            keep &= (i < j) if same else True
            yield i[keep], j[keep]


def list_rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of every list, and the values of all."""
    begin = lists.offsets.to_numpy()
    return begin[:-1], np.diff(begin), lists.values.to_numpy(zero_copy_only=False)


def in_groups(columns: Sequence[pa.ListArray], work: Callable[..., np.ndarray], single: Callable[..., object], missing: object) -> np.ndarray:
    """``work`` on rows whose lists (x, y of one or more polygons) are small and of equal lengths, ``single`` on each row with a large one.

    Rows of equal lengths become one array by their places in the Arrow values, so nothing is done row by row.
    """
    out = np.full(len(columns[0]), missing)
    parts = [list_rows(c) for c in columns]
    known = np.flatnonzero(np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]))
    lengths = np.stack([size[known] for _, size, _ in parts], axis=1)
    large = (lengths > SMALL).any(axis=1)
    for i in known[large]:
        out[i] = single(*[values[begin[i] : begin[i] + size[i]] for begin, size, values in parts])
    groups, group = np.unique(lengths[~large], axis=0, return_inverse=True)
    for g, sizes in enumerate(groups):
        members = known[~large][group.ravel() == g]
        out[members] = work(*[values[begin[members][:, None] + np.arange(n)] for (begin, _, values), n in zip(parts, sizes)])
    return out
