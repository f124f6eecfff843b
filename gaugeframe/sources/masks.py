"""Class-id masks to objects: every connected region of a class, holes filled, from four square pixels of contour area."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

# Fixed value: smallest contour area of an object.
MIN_AREA = 4.0


def regions(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Component number of every true pixel (0 elsewhere): row runs joined with touching runs of the row above."""
    labels = np.zeros(mask.shape, dtype=np.int64)
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if diagonal else 0
    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        row = []
        for a, b in zip(edge[::2], edge[1::2]):
            touching = [root(n) for s, e, n in above if s < b + reach and e > a - reach]
            if touching:
                n = min(touching)
                for t in touching:
                    parent[t] = n
            else:
                n = len(parent)
                parent.append(n)
            labels[y, a:b] = n
            row.append((a, b, n))
        above = row
    return np.array([root(i) for i in range(len(parent))])[labels]


def _split(labelled: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Top, left and cropped mask of every component large enough to reach the area limit (six pixels)."""
    ys, xs = np.nonzero(labelled)
    number = labelled[ys, xs]
    order = np.argsort(number, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
        if len(part) >= 6:
            y, x = ys[part], xs[part]
            crop = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), dtype=bool)
            crop[y - y.min(), x - x.min()] = True
            yield int(y.min()), int(x.min()), crop


def fill_holes(region: np.ndarray) -> np.ndarray:
    """Region plus the background it encloses."""
    outside = regions(~np.pad(region, 1), diagonal=False)
    return (outside != outside[0, 0])[1:-1, 1:-1]


# East, north-east, north and on around, as steps in (x, y) with y growing downwards.
_STEPS = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))


def outline(region: np.ndarray) -> list[tuple[int, int]]:
    """Corners (x, y) of the outer border of one region, through pixel centres; straight runs keep their ends only.

    The walk starts at the first pixel in reading order, leaves it downwards and keeps the background on its right.
    """
    r = np.pad(region, 1)
    y, x = (int(v[0]) for v in np.nonzero(r))
    start, came, first = (x, y), 6, None
    corners: list[tuple[int, int]] = []
    last = -1
    while True:
        turn = next((k % 8 for k in range(came - 2, came + 6) if r[y + _STEPS[k % 8][1], x + _STEPS[k % 8][0]]), None)
        if turn is None:  # a single pixel
            return [(x - 1, y - 1)]
        if (x, y) == start and turn == first:
            break
        if turn != last:
            corners.append((x - 1, y - 1))
        first = turn if first is None else first
        last = came = turn
        x, y = x + _STEPS[turn][0], y + _STEPS[turn][1]
    # the start is a corner only if the walk turns there
    return corners[1:] if last == first and len(corners) > 1 else corners


def contour_area(region: np.ndarray) -> float:
    """Area inside the contour through pixel centres: four set corners fill a unit cell, three half of it."""
    r = region.astype(np.int8)
    corners = r[:-1, :-1] + r[1:, :-1] + r[:-1, 1:] + r[1:, 1:]
    return float((corners == 4).sum() + 0.5 * (corners == 3).sum())


def _counts(flat: np.ndarray) -> list[int]:
    turns = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate(([0], turns, [len(flat)]))).tolist()
    return [0, *runs] if flat[0] else runs


def masks_to_objects(masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class_id, x, y, w, h in pixels, area, rle) per object. ``masks`` has height, width and data (one byte per pixel)."""
    rle = T.StructType([T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([masks.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("class_id", "x", "y", "w", "h")]
                          + [T.StructField("area", T.DoubleType()), T.StructField("rle", rle)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                image = np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"])
                for cls in np.unique(image):
                    if cls == 0:
                        continue
                    for y0, x0, region in _split(regions(image == cls, diagonal=True)):
                        region = fill_holes(region)
                        area = contour_area(region)
                        if area < MIN_AREA:
                            continue
                        placed = np.zeros(image.shape, dtype=bool)
                        placed[y0 : y0 + region.shape[0], x0 : x0 + region.shape[1]] = region
                        runs = {"size": [r["height"], r["width"]], "counts": _counts(placed.ravel())}
                        out.append([*(r[k] for k in keys), int(cls), x0, y0, region.shape[1], region.shape[0], area, runs])
            yield pd.DataFrame(out, columns=schema.names)

    return masks.select(*keys, "height", "width", "data").mapInPandas(run, schema)
