"""Extension points: custom metrics, image metrics, models, label transformers and embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gaugeframe.functions.images import image_metrics
from gaugeframe.registry import MetricRegistry


def run_metrics(domain: DataFrame, registry: MetricRegistry, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long (keys, metric, score) of the named custom metrics; each is a DataFrame -> DataFrame of (keys, score)."""
    registry.require(names)
    out = None
    for n in names:
        scored = registry.metrics[n].compute(domain).select(*keys, F.lit(n).alias("metric"), F.col("score").cast("double").alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def run_image_metrics(images: DataFrame, registry: MetricRegistry, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """All named per-image metrics in one pass over the pixels."""
    registry.require(names)
    return image_metrics(images, list(keys), {n: registry.metrics[n].image_fn for n in names})


def predict_with(df: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """A user model as a batch function: loads once per task, yields prediction rows."""
    return df.mapInPandas(model, schema)


def embed_with(df: DataFrame, keys: Sequence[str], column: str, embed: Callable[[pd.Series], list]) -> DataFrame:
    """(keys, embedding ARRAY<FLOAT>) from a user function over batches of one column."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
    cols = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[cols].assign(embedding=[[float(x) for x in v] for v in embed(pdf[column])])

    return df.select(*cols, column).mapInPandas(run, schema)


LABEL_COLUMNS = {"path": "string", "class_name": "string"}


def apply_label_transformer(files: DataFrame, transformer: Callable[[DataFrame], DataFrame], units: DataFrame, path: str = "path") -> DataFrame:
    """Labels from user files joined to units by path; the transformer's output must carry LABEL_COLUMNS."""
    labels = transformer(files)
    have = {f.name: f.dataType.simpleString() for f in labels.schema}
    wrong = {c: t for c, t in LABEL_COLUMNS.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"label transformer must return {wrong}")
    return units.join(labels, path)
