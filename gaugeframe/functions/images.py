"""Pixel metrics of the Spark image struct, all computed in one Arrow pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Hue bands (0-179) of the colour metrics and their saturation and value ranges.
HUE_BANDS = {"red": ((0, 10), (170, 179)), "green": ((35, 75),), "blue": ((90, 130),)}
SATURATION_RANGE, VALUE_RANGE = (50, 255), (40, 255)


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """(h, w, 3) BGR array; grey is repeated and alpha dropped."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in 0-179, saturation and value in 0-255, rounded to integers."""
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    v = np.maximum(np.maximum(r, g), b)
    span = v - np.minimum(np.minimum(r, g), b)
    safe = np.where(span == 0, 1, span)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    h = np.where(span == 0, 0, np.where(h < 0, h + 360, h))
    s = np.where(v == 0, 0, span / np.where(v == 0, 1, v) * 255)
    return np.rint(h / 2).astype(int) % 180, np.rint(s).astype(int), v.astype(int)


def brightness(bgr: np.ndarray) -> float:
    return float(bgr.mean() / 255)


def contrast(bgr: np.ndarray) -> float:
    return float(bgr.std() / 255)


def colour_share(name: str) -> Callable[[np.ndarray], float]:
    def share(bgr: np.ndarray) -> float:
        h, s, v = hsv(bgr)
        band = np.zeros(h.shape, dtype=bool)
        for lo, hi in HUE_BANDS[name]:
            band |= (h >= lo) & (h <= hi)
        strong = (s >= SATURATION_RANGE[0]) & (s <= SATURATION_RANGE[1]) & (v >= VALUE_RANGE[0]) & (v <= VALUE_RANGE[1])
        return float((band & strong).mean())
    return share


def sharpness(bgr: np.ndarray) -> float:
    """Variance of the 3x3 Laplacian over all channels, borders mirrored without repeating the edge."""
    p = np.pad(bgr.astype(np.float64), ((1, 1), (1, 1), (0, 0)), mode="reflect" if min(bgr.shape[:2]) > 1 else "edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


def blur(bgr: np.ndarray) -> float:
    return 1.0 - sharpness(bgr)


IMAGE_METRICS: dict[str, Callable[[np.ndarray], float]] = {
    "brightness": brightness, "contrast": contrast, "red": colour_share("red"), "green": colour_share("green"),
    "blue": colour_share("blue"), "sharpness": sharpness, "blur": blur,
}


def image_metrics(images: DataFrame, keys: list[str], fns: dict[str, Callable[[np.ndarray], float]] | None = None, image: str = "image") -> DataFrame:
    """Wide row of every metric per image; images that cannot be read are skipped."""
    fns = fns or IMAGE_METRICS
    schema = T.StructType([images.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in fns])
    flat = images.select(*keys, *[F.col(f"{image}.{c}").alias(f"_{c}") for c in ("height", "width", "nChannels", "data")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, (h, w, c, data) in enumerate(zip(pdf["_height"], pdf["_width"], pdf["_nChannels"], pdf["_data"])):
                if data is None or h <= 0 or w <= 0 or len(data) != h * w * c:
                    continue
                bgr = pixels(h, w, c, data)
                rows.append([i, *(fn(bgr) for fn in fns.values())])
            got = pd.DataFrame(rows, columns=["_i", *fns])
            out = pdf[keys].iloc[got["_i"].astype(int)].reset_index(drop=True)
            yield pd.concat([out, got.drop(columns="_i")], axis=1)

    return flat.mapInPandas(run, schema)


def object_crops(images: DataFrame, objects: DataFrame, keys: list[str], id_col: str, image: str = "image") -> DataFrame:
    """(keys, id, height, width, data): pixels of every object box (relative x, y, w, h); empty crops are skipped."""
    side = images.select(*keys, *[F.col(f"{image}.{c}").alias(f"_{c}") for c in ("height", "width", "nChannels", "data")])
    pairs = objects.select(*keys, id_col, "x", "y", "w", "h").join(side, keys)
    schema = T.StructType([pairs.schema[k] for k in keys] + [pairs.schema[id_col]] + [
        T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                h, w = r["_height"], r["_width"]
                x0, y0 = int(max(r["x"], 0) * w), int(max(r["y"], 0) * h)
                x1, y1 = int(min(r["x"] + r["w"], 1) * w), int(min(r["y"] + r["h"], 1) * h)
                if x1 > x0 and y1 > y0:
                    crop = pixels(h, w, r["_nChannels"], r["_data"])[y0:y1, x0:x1]
                    rows.append([*(r[k] for k in keys), r[id_col], y1 - y0, x1 - x0, crop.tobytes()])
            yield pd.DataFrame(rows, columns=schema.names)

    return pairs.mapInPandas(run, schema)
