"""Run-length masks: row-major run lengths, the first run counting zeros."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gaugeframe.functions.polygon_batches import list_rows


def rle_encode(mask: Column, height: Column, width: Column) -> Column:
    """STRUCT<size, counts> of a flat 0/1 array."""
    n = F.size(mask)
    turns = F.filter(F.sequence(F.lit(2), n), lambda i: (i <= n) & (i >= 2) & (F.element_at(mask, i) != F.element_at(mask, i - 1)))
    turns = F.when(n >= 2, turns).otherwise(F.array().cast("array<int>"))
    edges = F.concat(F.array(F.lit(1)), turns, F.array(n + 1))
    runs = F.zip_with(F.slice(edges, 2, F.size(edges)), F.slice(edges, 1, F.size(edges) - 1), lambda b, a: (b - a).cast("int"))
    counts = F.when(F.element_at(mask, 1) == 1, F.concat(F.array(F.lit(0)), runs)).otherwise(runs)
    return F.struct(F.array(height.cast("int"), width.cast("int")).alias("size"), counts.alias("counts"))


def rle_decode(rle: Column) -> Column:
    """Flat 0/1 array."""
    return F.flatten(F.transform(rle["counts"], lambda c, i: F.array_repeat((i % 2).cast("int"), c)))


def rle_area(rle: Column) -> Column:
    ones = F.filter(rle["counts"], lambda c, i: i % 2 == 1)
    return F.aggregate(ones, F.lit(0).cast("long"), lambda acc, c: acc + c)


def _places(lists: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every run of the given rows: number of its row, whether it counts ones, begin and end, whether a run up to it is missing; then the
    runs of each row."""
    begin, size, values = list_rows(lists)
    begin, size = begin[rows], size[rows]
    own = np.repeat(np.arange(len(rows)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(own)) - first[own]
    runs = values[begin[own] + at]
    missing = np.isnan(runs)
    runs = np.where(missing, 0, runs).astype(np.int64)

    def inside(steps: np.ndarray) -> np.ndarray:
        total = np.cumsum(steps)
        return total - np.concatenate(([0], total))[first[own]]

    ends = inside(runs)
    return own, at % 2 == 1, ends - runs, ends, inside(missing) > 0, size


def overlaps(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """IoU of the run lists of every row by one merge of all their edges; an empty union is 0, NaN without one of them or one of their runs."""
    rows = np.flatnonzero((a.is_valid().to_numpy(zero_copy_only=False)) & (b.is_valid().to_numpy(zero_copy_only=False)))
    out = np.full(len(a), np.nan)
    sides = [_places(x, rows) for x in (a, b)]
    ones = sum(np.bincount(own[on], (end - begin)[on], len(rows)) for own, on, begin, end, _, _ in sides)
    own, edge = (np.concatenate([s[i] for s in sides]) for i in (0, 3))
    left = np.repeat([True, False], [len(s[0]) for s in sides])
    order = np.lexsort((edge, own))
    own, edge, left = own[order], edge[order], left[order]
    first = np.searchsorted(own, np.arange(len(rows)))
    on = np.ones(len(own), dtype=bool)
    for mine, (*_, size) in zip((left, ~left), sides):
        passed = np.cumsum(mine) - mine
        passed -= passed[first[own]] if len(own) else 0
        on &= (passed % 2 == 1) & (passed < size[own])
    reach = np.diff(edge, prepend=0)
    reach[first[first < len(own)]] = 0  # before the first edge both lists are at their zeros
    common = np.bincount(own[on], reach[on], len(rows))
    out[rows] = np.divide(common, ones - common, out=np.zeros(len(rows)), where=ones - common > 0)
    for mine, _, _, _, lost, _ in sides:
        out[rows[mine[lost]]] = np.nan
    return out


# running sums over runs have no linear form among the array functions
@F.arrow_udf(DoubleType())
def _iou(a: pa.Array, b: pa.Array) -> pa.Array:
    found = overlaps(a, b)
    return pa.array(found, mask=np.isnan(found))


# else a filter on the result would be planned below it, with a second run of its own
_iou = _iou.asNondeterministic()


def rle_iou(a: Column, b: Column) -> Column:
    """Overlap of two encoded masks from their runs, never decoding them; an empty union is 0."""
    return _iou(a["counts"], b["counts"])


_BOUNDS = StructType([StructField(side, LongType()) for side in ("x", "y", "x2", "y2")])


@F.arrow_udf(_BOUNDS)
def _extents(counts: pa.Array, width: pa.Array) -> pa.Array:
    rows = np.flatnonzero((counts.is_valid().to_numpy(zero_copy_only=False)) & (width.is_valid().to_numpy(zero_copy_only=False)))
    wide = width.to_numpy(zero_copy_only=False)[rows].astype(np.int64)
    own, on, begin, end, lost, _ = _places(counts, rows)
    some = on & (end > begin) & ~lost
    own, first, last = own[some], begin[some].astype(np.int64), end[some].astype(np.int64) - 1
    across = wide[own]
    wraps = first // across != last // across
    low, high = np.iinfo(np.int64).max, -1
    sides = {n: np.full(len(rows), v) for n, v in (("x", low), ("y", low), ("x2", high), ("y2", high))}
    np.minimum.at(sides["x"], own, np.where(wraps, 0, first % across))
    np.minimum.at(sides["y"], own, first // across)
    np.maximum.at(sides["x2"], own, np.where(wraps, across, last % across + 1))
    np.maximum.at(sides["y2"], own, last // across + 1)
    filled = np.zeros(len(counts), dtype=bool)
    filled[rows[sides["y2"] >= 0]] = True
    whole = {n: np.zeros(len(counts), dtype=np.int64) for n in _BOUNDS.names}
    for n in whole:
        whole[n][rows] = sides[n]
    return pa.StructArray.from_arrays([pa.array(whole[n], mask=~filled) for n in _BOUNDS.names], names=_BOUNDS.names)


def rle_bounds(rle: Column) -> Column:
    """STRUCT<x, y, x2, y2> in pixels, ends exclusive; null fields for a mask without ones."""
    return _extents(rle["counts"], rle["size"][1])


#: Powers (of x, of y) of the pixel sums, in their order.
POWERS = tuple((p, q) for p in range(4) for q in range(4 - p))


def pixel_sums(counts: pa.ListArray, width: np.ndarray) -> np.ndarray:
    """(rows, POWERS): sums of x^p y^q over the pixels of row-major run lists: a run is what is below its end less what is below its begin.

    Below place n lie ``n div width`` whole rows and the beginning of one more, so their sums are products of power sums in closed form.
    """
    own, on, begin, end, lost, _ = _places(counts, np.arange(len(counts)))
    own, begin, end = own[on], begin[on].astype(float), np.where(lost, np.nan, end)[on]
    wide = width[own]

    def power_sum(n: np.ndarray, k: int) -> np.ndarray:
        """0^k + 1^k + ... + (n - 1)^k"""
        return (n, n * (n - 1) / 2, n * (n - 1) * (n * 2 - 1) / 6, n * n * (n - 1) * (n - 1) / 4)[k]

    out = np.zeros((len(counts), len(POWERS)))
    places = []
    for place in (begin, end):
        rows = np.floor(place / wide)
        places.append((rows, place - rows * wide))
    for i, (p, q) in enumerate(POWERS):
        low, high = (power_sum(wide, p) * power_sum(rows, q) + power_sum(rest, p) * rows**q for rows, rest in places)
        out[:, i] = np.bincount(own, high - low, len(counts))
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def _sums(counts: pa.Array, width: pa.Array) -> pa.Array:
    known = counts.is_valid().to_numpy(zero_copy_only=False) & width.is_valid().to_numpy(zero_copy_only=False)
    kept = pa.array(known)
    found = pixel_sums(counts.filter(kept), width.filter(kept).to_numpy(zero_copy_only=False).astype(float))
    begins = np.concatenate(([0], np.cumsum(known) * len(POWERS))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(begins), pa.array(found.ravel(), mask=np.isnan(found.ravel())), mask=pa.array(~known))


def rle_moments(rle: Column) -> Column:
    """ARRAY of the pixel sums of x^p y^q in the order of ``POWERS``, null where a run is missing; the mask is never decoded."""
    return _sums(rle["counts"], rle["size"][1])


def mask_iou(a: Column, b: Column) -> Column:
    """Overlap of two flat 0/1 arrays."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda acc, v: acc + v)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y).cast("long")), F.lit(0).cast("long"), lambda acc, v: acc + v)
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))
