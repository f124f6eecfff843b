"""Search pages, ranking, random splits and active-learning rounds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeframe.functions.scalar import natural_key
from gaugeframe.plans.scan import ranked
from gaugeframe.registry import UnknownMetricError
from gaugeframe.session import cut_lineage


def search(df: DataFrame, keys: Sequence[str], order_by: str | None = None, desc: bool = False, offset: int = 0, *, limit: int) -> DataFrame:
    """One page of keys in order, with its position and whether more rows follow."""
    if order_by is not None and order_by not in df.columns:
        raise UnknownMetricError(order_by)
    first = [] if order_by is None else [F.desc(order_by) if desc else F.asc(order_by)]
    order = [*first, *[F.asc(k) for k in keys]]
    cols = list(dict.fromkeys([*keys, *([order_by] if order_by else [])]))
    page = df.select(*cols).orderBy(*order).offset(offset).limit(limit + 1)
    # at most limit + 1 rows reach these windows
    whole = W.partitionBy(F.lit(0))
    numbered = page.select(*cols, F.row_number().over(whole.orderBy(*order)).alias("position"), (F.count("*").over(whole) > limit).alias("truncated"))
    return numbered.where(F.col("position") <= limit)


def sort_by_metric(df: DataFrame, key: str, metric: str, ascending: bool = True, subset: DataFrame | None = None) -> DataFrame:
    """(key, value) with the metric present, sorted; the metric name is matched without regard to case."""
    names = {c.lower(): c for c in df.columns}
    if metric.lower() not in names:
        raise UnknownMetricError(metric)
    rows = df.select(key, F.col(names[metric.lower()]).alias("value")).where(F.col("value").isNotNull())
    if subset is not None:
        rows = rows.join(subset.select(key), key, "left_semi")
    return rows.orderBy(F.asc("value") if ascending else F.desc("value"), key)


def select_n_best(df: DataFrame, key: str, score: str, n: int, ascending: bool, include: DataFrame | None = None, exclude: DataFrame | None = None, unit: str | None = None) -> DataFrame:
    """The n smallest or largest scores; equal scores keep the smaller key. include / exclude list units."""
    u = unit or key
    if include is not None:
        df = df.join(include.select(u), u, "left_semi")
    if exclude is not None:
        df = df.join(exclude.select(u), u, "left_anti")
    return df.orderBy(F.asc(score) if ascending else F.desc(score), key).limit(n)


def hash_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def partition_dataset(df: DataFrame, key: str, sizes: dict[str, float], seed: int = 42) -> DataFrame:
    """Random split by percentage with floored sizes; the remainder goes to the last partition."""
    placed = ranked(df.withColumn("_h", hash_order(F.col(key), seed)), [], [F.asc("_h"), F.asc(key)], "_pos")
    n = placed.agg(F.count("*").alias("n"))
    rows = placed.withColumn("_n", n.scalar())
    names = list(sizes)
    edge, name = F.lit(0).cast("long"), F.lit(names[-1])
    cuts = []
    for p in names[:-1]:
        edge = edge + F.floor(F.col("_n") * F.lit(float(sizes[p])) / 100)
        cuts.append((p, edge))
    for p, e in reversed(cuts):
        name = F.when(F.col("_pos") <= e, p).otherwise(name)
    return rows.withColumn("partition", name).drop("_h", "_pos", "_n")


def random_score(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Uniform [0, 1) per item, the same on every run: 52 bits of the keyed hash."""
    bits = F.conv(F.substring(hash_order(F.col(key), seed), 1, 13), 16, 10).cast("double")
    return df.withColumn("random", bits / F.lit(float(1 << 52)))


def natural_sort(df: DataFrame, name: str) -> DataFrame:
    """Order names with embedded numbers numerically."""
    return df.orderBy(natural_key(F.col(name)), name)


def remaining_pool(pool: DataFrame, labeled: DataFrame, key: str) -> DataFrame:
    return pool.join(labeled.select(key), key, "left_anti")


def active_learning_round(pool: DataFrame, labeled: DataFrame, key: str, score: Column, batch: int, ascending: bool = False, seed: int = 42) -> DataFrame:
    """The next batch to label, (key, score): the best scored of the pool's rows that are not labelled yet.

    ``score`` is an acquisition function as a Column over the pool's predictions; rows without a score come last, in a fixed random order.
    """
    rest = remaining_pool(pool, labeled, key).select(key, score.alias("score"))
    order = F.asc_nulls_last("score") if ascending else F.desc_nulls_last("score")
    tie = F.when(F.col("score").isNull(), hash_order(F.col(key), seed))
    return rest.orderBy(order, tie, key).limit(batch)
