"""Trie of conversation prefixes with subtree totals, rolled up by depth bands.

A node is a distinct sequence of first d turns.  Its key is a sum over its turns of hashes of (place, role, text), so the keys of all prefixes of a
conversation are running sums: a conversation that holds a third of all rows is cut into range slices like any other key
(:func:`gaugeframe.plans.scan.running`), and texts travel once, to put turns in order; afterwards a turn is two hashes and a length.

Subtree totals go up in bands of ``BAND`` depths.  Within its band a node explodes to itself and its ancestors, at most ``BAND`` rows, and the rows add up
with map-side combine.  The tops of the bands form a trie of their own, ``BAND`` times less deep; its totals come the same way, so the levels grow with
the logarithm of the depth.  A completed band top then goes to its parent, and from there once more to the ancestors in the parent's band.  No node ever
explodes to its whole path, and no round is spent on a single depth.

The digest of a node's ending members needs them in numeric order: conversation ids are range-sorted by (node, id), each slice joins its runs into
pieces of text, and the pieces of a node are hashed as a stream, so not even a node where a third of all conversations end is ever held as a list.

Defined results.  Null role or text is empty; null turns come first.  Turns of equal number are ordered by role, then text; repeated rows are turns of their
own.  Rows without ``conv_id`` belong to no conversation.  Other columns are not read.  An empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeframe.llm.common import stored
from gaugeframe.plans.scan import ranked, running

BAND = 8
HEAD, GROUP = 5, 100
PIECE = 1 << 16
KEY = ("k1", "k2")
_HALVES = ("a_low", "a_high", "b_low", "b_high")


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 (hashes of role and text) and chars of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    light = placed.select(
        "conv_id", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"),
        F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("at"))
    return ranked(stored(light), ["conv_id"], [F.col("at")], "pos").drop("at")


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, depth, h1, h2, chars: the first turns of the group's conversation, then the conversation's own after as many."""
    base, h = F.col("conv_id") - F.col("conv_id") % GROUP, head_length(F.col("conv_id"))
    heads = stored(rows.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") <= HEAD)).withColumnRenamed("conv_id", "base"))
    found = heads.groupBy("base").agg(F.max("pos").alias("heads"))
    convs = rows.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    first = convs.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("depth"), "h1", "h2", "chars")
    own = rows.select("*", base.alias("base"), h.alias("h")).where(F.col("pos") > F.col("h")).join(found, "base", "left")
    later = F.col("pos") - F.col("h") + F.least("h", F.coalesce("heads", F.lit(0)))
    return first.unionByName(own.select("conv_id", later.alias("depth"), "h1", "h2", "chars"))


def _keys(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(n), depth, *sums) for n in (3, 4)]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key (k1, k2) and parent key (p1, p2) of every prefix of ``turns(conv_id, depth, h1, h2, chars)``, but for the empty one."""
    depth = F.col("depth")
    terms = [F.xxhash64(F.lit(n), depth, h) for n, h in ((1, F.col("h1")), (2, F.col("h2")))]
    # halves, as sums of whole hashes would overflow
    parts = [p for t in terms for p in (t.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(t, 32))]
    summed = running(turns.select("conv_id", "depth", "chars", *[p.alias(n) for p, n in zip(parts, _HALVES)]), ["conv_id"], [depth],
                     sums={f"s_{n}": F.col(n) for n in _HALVES})
    own = _keys(depth, [F.col(f"s_{n}") for n in _HALVES])
    parent = _keys(depth - 1, [F.col(f"s_{n}") - F.col(n) for n in _HALVES])
    return summed.select("conv_id", "depth", "chars", *[c.alias(n) for c, n in zip((*own, *parent), (*KEY, "p1", "p2"))])


def _with_root(prefix: DataFrame, convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("chars"), *[c.alias(n) for c, n in zip(_keys(zero, [zero] * 4), KEY)])
    return prefix.unionByName(root.withColumns({p: F.lit(None).cast("long") for p in ("p1", "p2")}))


def _above(prefix: DataFrame, step: int, band: int) -> DataFrame:
    """Keys of the prefixes at depths divisible by ``step``: the path inside the band (itself last), and the prefix one step up."""
    rows = prefix.where(F.col("depth") % step == 0)
    inside = W.partitionBy("conv_id", F.floor(F.col("depth") / (step * band))).orderBy("depth")
    rows = rows.withColumn("path", F.collect_list(F.struct(*KEY)).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    if step > 1:
        # the last prefix of a band and the top of the next one share a window here
        across = W.partitionBy("conv_id", F.floor((F.col("depth") - step) / (step * band))).orderBy("depth")
        rows = rows.withColumns({p: F.lag(k).over(across) for k, p in zip(KEY, ("p1", "p2"))})
    # all members of a node have the same path
    return rows.groupBy("depth", *KEY).agg(*[F.any_value(c).alias(c) for c in ("path", "p1", "p2")])


def rollup(prefix: DataFrame, values: DataFrame, names: list[str], deepest: int, band: int = BAND, step: int = 1) -> DataFrame:
    """Sums of ``values(k1, k2, *names)`` over the subtree of every node at a depth divisible by ``step``."""
    items = stored(_above(prefix, step, band))
    sums = [F.sum(n).alias(n) for n in names]
    each = items.join(values, [*KEY]).select(F.explode("path").alias("up"), *names)
    inside = stored(each.groupBy(*[F.col(f"up.{k}").alias(k) for k in KEY]).agg(*sums))
    if deepest < step * band:
        return inside
    tops = items.where(F.col("depth") % (step * band) == 0)
    done = rollup(prefix, tops.select(*KEY).join(inside, [*KEY]), names, deepest, band, step * band)
    to_parent = tops.where("depth > 0").join(done, [*KEY]).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*sums)
    passed = items.join(to_parent, [*KEY]).select(F.explode("path").alias("up"), *names)
    both = inside.unionByName(passed.select(*[F.col(f"up.{k}").alias(k) for k in KEY], *names))
    return stored(both.groupBy(*KEY).agg(*sums))


# --- digests of ending members


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a sorted slice, joined into pieces of text."""
    names = ("k1", "k2", "conv_id")
    for batch in batches:
        k1, k2, ids = (batch[n].to_numpy() for n in names)
        if not len(ids):
            continue
        run = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        cuts = np.unique(np.concatenate([run, np.arange(0, len(ids), PIECE // 8), [len(ids)]]))
        listed = ids.tolist()
        text = [",".join(map(str, listed[a:b])) for a, b in zip(cuts, cuts[1:])]
        yield pa.record_batch([*(pa.array(c[cuts[:-1]]) for c in (k1, k2, ids)), pa.array(text)], names=[*names, "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key of sorted pieces, whatever batches they come in."""
    current, sha = None, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

    for batch in batches:
        done = []
        for k1, k2, piece in zip(*(batch[n].to_pylist() for n in (*KEY, "piece"))):
            if current == (k1, k2):
                sha.update(b",")
            else:
                if current:
                    done.append((*current, sha.hexdigest()))
                current, sha = (k1, k2), hashlib.sha256()
            sha.update(piece.encode())
        if done:
            yield rows(done)
    if current:
        yield rows([(*current, sha.hexdigest())])


def member_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of ``ends(k1, k2, conv_id)``."""
    key = "k1 long, k2 long"
    slices = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = slices.mapInArrow(_pieces, f"{key}, conv_id long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(_digests, f"{key}, ends_sha256 string")


def op12(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations."""
    rows = stored(in_order(turns))
    convs = rows.select("conv_id").distinct()
    prefix = stored(_with_root(prefixes(rebuilt(rows)), convs))
    deepest = prefix.agg(F.max("depth")).first()[0] or 0
    nodes = stored(prefix.groupBy("depth", *KEY, "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")))
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, [*KEY], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    values = nodes.select(*KEY, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rollup(prefix, values, ["n_leaves", "saved_tokens"], deepest, band)
    last = prefix.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("end"))
    ends = member_digests(last.select("conv_id", "end.k1", "end.k2"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(parents, ["p1", "p2"], "left").join(totals, [*KEY]).join(ends, [*KEY], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
