"""Running aggregates inside keys of any size.

A plain window sends every row of a key to one task.  ``running`` instead range-partitions the rows
on (key, order), so that a key holding a third of the table is spread over a third of the tasks,
and runs a window that only ever sees one slice.  Only a slice's first and last key can reach into
another slice: those keys are totalled per slice, a window runs over the few totals, and what they carry
in is broadcast, one row per slice at most.  The slices are checkpointed: slice ids come from a
sampled range partitioning and must be the same on both sides of the join and after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeframe.plans.joins import null_safe_join
from gaugeframe.session import cut_lineage

SLICE = "_slice"
#: Hash buckets in which the rows of keys are counted, and the rows up to which a bucket's keys are worked whole.
BUCKETS, WHOLE = 1 << 16, 1 << 18


def slice_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """Range-partition on keys then order and freeze the slice id of every row."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn(SLICE, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column] | None = None,
    prior_maxes: dict[str, Column] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add inclusive running sums and exclusive running maxima (rows strictly before) per key.

    ``order`` must be total within a key (end it with a unique id), else ties are cut arbitrarily.
    A NULL key is a key of its own.
    """
    sums, prior_maxes = sums or {}, prior_maxes or {}
    keys = list(keys)
    cut = slice_by_order(df, keys, order, slices)
    across = cut
    if keys:
        # a key reaches into another slice only as the first or last one of its own
        own = F.struct(*keys)
        ends = cut.groupBy(SLICE).agg(F.min(own).alias("_first"), F.max(own).alias("_last")).select(SLICE, F.explode(F.array("_first", "_last")).alias("_key"))
        wide = ends.groupBy("_key").agg(F.min(SLICE).alias("_from"), F.max(SLICE).alias("_to")).where("_from < _to").select("_key.*")
        across = null_safe_join(cut, F.broadcast(wide), keys, "left_semi")
    totals = across.groupBy(SLICE, *keys).agg(
        *[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_c_{n}") for n, c in prior_maxes.items()],
    )
    # one row per (slice, key): at most `slices` rows per key reach this window
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        SLICE,
        *keys,
        *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(before).alias(f"_c_{n}") for n in prior_maxes],
    )
    inside = W.partitionBy(SLICE, *keys).orderBy(*order)
    upto, prior = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumns(
        {f"_l_{n}": F.sum(c).over(upto) for n, c in sums.items()}
        | {f"_l_{n}": F.max(c).over(prior) for n, c in prior_maxes.items()}
    )
    joined = null_safe_join(local, F.broadcast(carried), [SLICE, *keys], "left")
    out = {n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    out |= {n: F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in prior_maxes}
    helper = [f"_{p}_{n}" for p in "lc" for n in (*sums, *prior_maxes)]
    return joined.withColumns(out).drop(SLICE, *helper)


def running_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], prior_maxes: dict[str, Column]) -> DataFrame:
    """Running maxima of :func:`running` for many keys of which few or none are large.

    Rows are counted by hash buckets of their keys.  Keys of buckets up to ``WHOLE`` rows meet whole, in one shuffle; those of larger buckets are cut in slices.
    """
    stored = cut_lineage(df)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counted = stored.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    large = [r["_bucket"] for r in counted.where(F.col("_n") > WHOLE).collect()]
    prior = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = stored.where(~bucket.isin(large)).withColumns({n: F.max(c).over(prior) for n, c in prior_maxes.items()})
    return out.unionByName(running(stored.where(bucket.isin(large)), keys, order, prior_maxes=prior_maxes)) if large else out


def marked_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], marked: Column) -> tuple[DataFrame, DataFrame]:
    """The marked rows of every key as ``rn``, their position in the key, and ``nth``, their number among its marked rows; and ``n`` and ``m``, rows and
    marked rows per key.  Rows are numbered where the range partitioning and a sort put them, so they are shuffled once and no order column is stored."""
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    placed = df.withColumn("_marked", F.coalesce(marked, F.lit(False))).repartitionByRange(n, *by).sortWithinPartitions(*by)
    cut = cut_lineage(placed.select(*keys, "_marked", F.spark_partition_id().alias(SLICE), F.monotonically_increasing_id().alias("_at")))
    # a checkpoint keeps its partitions and the order of their rows
    hits = cut.where("_marked").select(*keys, SLICE, "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"))
    totals = cut.groupBy(SLICE, *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if("_marked").alias("_m"))
    # one row per slice and key: of a key, and of a slice, what lies before
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(SLICE).orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    carried = totals.select(SLICE, *keys, "_first", F.coalesce(F.sum("_m").over(above), none).alias("_skip"), F.coalesce(F.sum("_n").over(earlier), none).alias("_rows"),
                            F.coalesce(F.sum("_m").over(earlier), none).alias("_hits"))
    found = null_safe_join(hits, F.broadcast(carried), [SLICE, *keys])
    rn, nth = F.col("_at") - F.col("_first") + 1 + F.col("_rows"), F.col("_nth") - F.col("_skip") + 1 + F.col("_hits")
    return found.select(*keys, rn.alias("rn"), nth.alias("nth")), totals.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_m").alias("m"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", slices: int | None = None) -> DataFrame:
    """1-based position inside a key of any size."""
    return running(df, keys, order, sums={name: F.lit(1).cast("long")}, slices=slices)
