"""Overlaps of few shapes a key, many keys at once.

Rows come sorted by key; ``_begin`` marks the first one of a key.  Batches of Arrow rows are cut at whole keys, so what is in memory does not grow with the
table, and the pairs of a key exist in blocks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from gaugeframe.functions.masks import overlaps
from gaugeframe.functions.polygons import row_ious

#: Pairs in memory at a time.
PAIRS = 1 << 20


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one or more whole keys at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch["_begin"].to_numpy(zero_copy_only=False))
        if held and len(begins):
            held.append(batch.slice(0, begins[-1]))
            yield pa.Table.from_batches(held).combine_chunks()
            held, batch = [], batch.slice(begins[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(rows: pa.Table, name: str) -> pa.Array:
    found = rows[name].combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks) if found.num_chunks else pa.array([], found.type)


def numbers(rows: pa.Table, name: str) -> np.ndarray:
    """Doubles, NaN for NULL."""
    return column(rows, name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def flags(rows: pa.Table, name: str) -> np.ndarray:
    return column(rows, name).to_numpy(zero_copy_only=False).astype(bool)


def pairs(key: np.ndarray, left: np.ndarray, right: np.ndarray, step: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every row of ``left`` with every one of ``right`` whose key is its own less ``step``, in blocks of whole left rows; both hold places by rising keys."""
    first, end = (np.searchsorted(key[right], key[left] - step, side) for side in ("left", "right"))
    count = end - first
    block = (np.cumsum(count) - count) // PAIRS
    for b in np.unique(block[count > 0]):
        mine = np.flatnonzero(block == b)
        n = count[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.repeat(left[mine], n), right[at]


def meeting(box: Sequence[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs whose boxes have a common area, with the sides of it."""
    sides = []
    for low, extent in ((box[0], box[2]), (box[1], box[3])):
        to, begin = np.minimum(low[i] + extent[i], low[j] + extent[j]), np.maximum(low[i], low[j])
        kept = np.flatnonzero(to > begin)
        i, j, sides = i[kept], j[kept], [*(s[kept] for s in sides), (to - begin)[kept]]
    return i, j, *sides


def box_ious(box: Sequence[np.ndarray], i: np.ndarray, j: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """As ``functions.boxes.box_iou`` of pairs that meet."""
    both = across * down
    with np.errstate(divide="ignore", invalid="ignore"):
        iou = np.fmin(both / (box[2][i] * box[3][i] + box[2][j] * box[3][j] - both), 1.0)
    return np.where((across > 0) & (down > 0), iou, 0.0)


def nine_digits(iou: np.ndarray) -> np.ndarray:
    return np.floor(iou * 1e9 + 0.5) / 1e9


def best(i: np.ndarray, j: np.ndarray, iou: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every i the pair of the largest IoU, the smallest j among equal ones."""
    order = np.lexsort((j, -iou, i))
    i, j, iou = i[order], j[order], iou[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, dtype=np.int64)
    return i[first], j[first], iou[first]


def _shape_ious(rows: pa.Table, box: Sequence[np.ndarray], i: np.ndarray, j: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Overlaps by what the shapes are: runs of masks, outlines where one is a polygon, else boxes; NaN where one has a missing part."""
    iou = box_ious(box, i, j, across, down)
    rest = np.ones(len(i), dtype=bool)
    if "_masked" in rows.column_names:
        at = np.flatnonzero(flags(rows, "_masked")[i])
        rest[at] = False
        runs = column(rows, "_runs")
        iou[at] = overlaps(runs.take(pa.array(i[at])), runs.take(pa.array(j[at])))
    if "_polygon" in rows.column_names:
        polygon = flags(rows, "_polygon")
        at = np.flatnonzero(rest & (polygon[i] | polygon[j]))
        xs, ys = column(rows, "_xs"), column(rows, "_ys")
        a, b = pa.array(i[at]), pa.array(j[at])
        iou[at] = row_ious(xs.take(a), ys.take(a), xs.take(b), ys.take(b))
    return iou


def best_partners(columns: Sequence[str], payload: Sequence[str], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Left rows (``columns``, marked ``_own``) with ``iou`` and the ``payload`` fields of their best right row, which are those of ``_p``.  Right rows are
    the others of the key; where there is ``_pos``, all rows of the key one place before.  Both come by rising ``_p`` in their key or place.  With ``least``,
    pairs whose IoU is sure to stay below may be left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            key = np.cumsum(flags(rows, "_begin"))
            own = flags(rows, "_own")
            left, right, step = np.flatnonzero(own), np.flatnonzero(~own), 0
            if "_pos" in rows.column_names:
                place = column(rows, "_pos").to_numpy(zero_copy_only=False)
                place = place - place.min()
                key, right, step = key * (place.max() + 2) + place, np.arange(rows.num_rows), 1
            box = [numbers(rows, c) for c in "xywh"]
            found: list[tuple[np.ndarray, ...]] = []
            for i, j in pairs(key, left, right, step):
                i, j, across, down = meeting(box, i, j)
                if "_masked" in rows.column_names:
                    masked = flags(rows, "_masked")
                    i, j, across, down = (v[masked[i] == masked[j]] for v in (i, j, across, down))
                if "_area" in rows.column_names:
                    area = numbers(rows, "_area")
                    larger = np.fmax(area[i], area[j])
                    bound = np.divide(across * down, larger, out=np.zeros(len(i)), where=larger > 0)
                    i, j, across, down = (v[bound >= least - 1e-9] for v in (i, j, across, down))
                iou = _shape_ious(rows, box, i, j, across, down)
                some = iou > 0
                found.append(best(i[some], j[some], nine_digits(iou[some])))
            at, partner, iou = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, dtype=t) for n, t in enumerate((np.int64, np.int64, float)))
            place = np.full(rows.num_rows, -1)
            score = np.zeros(rows.num_rows)
            place[at], score[at] = partner, iou
            taken = column(rows, "_p").take(pa.array(place[left], mask=place[left] < 0))
            kept = rows.select(list(columns)).take(pa.array(left))
            yield from pa.table([*kept.columns, pa.array(score[left]), *taken.flatten()], names=[*columns, "iou", *[f"best_{c}" for c in payload]]).to_batches()

    return work


def best_others(columns: Sequence[str], id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (``columns``) with ``first`` and ``second``, the two smallest ids among their copies (``second`` NULL without copies), and with ``b_id`` and
    ``b_iou`` of the best box that is none.  Rows come by rising id in their key; no id is NULL."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            key = np.cumsum(flags(rows, "_begin"))
            box = [numbers(rows, c) for c in "xywh"]
            n = rows.num_rows
            order = np.lexsort((np.arange(n), *box[::-1], key))
            fresh = np.zeros(n, dtype=bool)
            fresh[:1] = True
            for c in (key, *box):
                a, b = c[order][1:], c[order][:-1]
                fresh[1:] |= (a != b) & ~(np.isnan(a) & np.isnan(b))
            begin = np.flatnonzero(fresh)
            size = np.diff(np.r_[begin, n])
            first, second = np.empty(n, dtype=np.int64), np.full(n, -1)
            first[order] = np.repeat(order[begin], size)
            twice = np.where(size > 1, order[np.minimum(begin + 1, n - 1)], -1)
            second[order] = np.repeat(twice, size)
            placed = ~np.isnan(box[0]) & ~np.isnan(box[1])
            single, shown = (second < 0) & placed, (first == np.arange(n)) & placed
            place, score = np.full(n, -1), np.zeros(n)
            for i, j in pairs(key, np.flatnonzero(single), np.flatnonzero(shown)):
                apart = i != j
                i, j, across, down = meeting(box, i[apart], j[apart])
                iou = box_ious(box, i, j, across, down)
                some = iou > 0
                at, partner, iou = best(i[some], j[some], nine_digits(iou[some]))
                place[at], score[at] = partner, iou
            ids = column(rows, id_col)
            more = [ids.take(pa.array(first)), ids.take(pa.array(second, mask=second < 0)), ids.take(pa.array(place, mask=place < 0)), pa.array(score)]
            kept = rows.select(list(columns))
            yield from pa.table([*kept.columns, *more], names=[*columns, "first", "second", "b_id", "b_iou"]).to_batches()

    return work
