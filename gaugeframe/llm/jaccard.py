"""N-gram Jaccard join by MinHash banding.

1. One pass over the texts hashes the distinct word n-grams of each document, folds them into a set fingerprint and minimum hashes, and
   packs these into band hashes.  ``bands_for`` chooses rows and bands so that a pair at the threshold shares a band with the target recall.
2. Documents with equal n-gram sets form one class; only its representative goes on, so exact copies never form pairs.
3. Representatives shuffle on band hashes.  Pairs at half the threshold often share a band, and groups connected through such pairs would grow with the
   corpus.  So links are screened first, by sketches of one byte per minimum hash: each bucket's members meet its smallest one (a star, not all
   pairs); where a member is not near it, the bucket's members meet one another, large buckets in blocks.  Near means an estimate of ``SLACK`` standard
   deviations below the threshold or more, which a linked pair misses with a chance below one in a million.  What the near pairs connect are
   candidate groups.
4. The full n-gram sets of a group meet and every pair is verified exactly.  Groups over ``BLOCK`` n-grams are cut into blocks by a hash, and
   each pair of blocks is a task of its own.  Inside a task the intersections are counted with a matrix product over common n-grams and posting lists over
   the others; pairs are counted, not emitted.  What leaves a task is one row per linked text.

Defined results.  Words are cut at space and 0x09-0x0D.  A text with fewer than ``n`` words has one n-gram of all its words; a text without
words (or a null text) has the empty set, equal only to other empty sets.  Rows with a null id or repeated rows are documents like any other.
An empty table gives an empty result.  Extra columns are ignored.  The class node is a 64-bit fingerprint of the n-gram set; sets are compared as
64-bit n-gram hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeframe.llm.common import Words, column, fresh, ids_of, mix, row_key, slices, stored
from gaugeframe.llm.components import components

N, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity 4/5, kept as integers so that the comparison is exact
RECALL, MAX_HASHES = 0.9995, 192
BLOCK = 1 << 19
SLACK, CROWD = 5.0, 1024  # standard deviations below the threshold; members of a block of a crowded bucket


def bands_for(threshold: float, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose number of bands for ``recall`` at ``threshold`` stays within ``hashes``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def shingles(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes sorted by (document, hash), and where each document begins."""
    h = words.hashes()
    full = words.starts(n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    doc = np.concatenate([words.doc[full], short])
    grams = words.windows(h, full, n)
    few = np.array([int(mix(h[words.first[d] : words.first[d + 1]] * np.uint64(3) + np.arange(1, words.counts[d] + 1).astype(np.uint64)).sum(dtype=np.uint64)) for d in short], dtype=np.uint64)
    grams = np.concatenate([grams, mix(few)])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(words.counts) + 1))


_SIGNED = "doc_id long, _id long, _tk long, n int, f1 long, f2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """Row key, size and fingerprints of the n-gram set, its band hashes, and a byte of each minimum hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                grams, first = shingles(Words(column(part, "text")), n)
                sizes = np.diff(first)
                some = np.flatnonzero(sizes > 0)
                begin = first[:-1][some]
                f1, f2 = np.zeros(len(sizes), dtype=np.uint64), np.zeros(len(sizes), dtype=np.uint64)
                band = np.zeros((len(sizes), bands), dtype=np.uint64)
                sketch = np.zeros((len(sizes), bands * rows), dtype=np.uint8)
                if len(some):
                    f1[some] = np.add.reduceat(mix(grams), begin)
                    f2[some] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), begin)
                    for k in range(bands * rows):
                        least = np.minimum.reduceat((grams * factor[k] + shift[k]) >> np.uint64(32), begin)
                        sketch[some, k] = (mix(least) >> np.uint64(56)).astype(np.uint8)
                        band[some, k // rows] = mix(band[some, k // rows] + least + np.uint64(k + 1))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32), pa.array(band[some].ravel().view(np.int64)))
                yield pa.record_batch({
                    "doc_id": column(part, "doc_id").cast(pa.int64()), "_id": pa.array(ids_of(part, "_id")), "_tk": column(part, "_tk"),
                    "n": pa.array(sizes, pa.int32()), "f1": pa.array(mix(f1).view(np.int64)), "f2": pa.array(f2.view(np.int64)), "bands": lists,
                    "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()),
                })

    return stored(docs.select("doc_id", "text", *row_key()).mapInArrow(run, _SIGNED))


def least_equal(hashes: int) -> int:
    """Equal sketch bytes from which a pair counts as near."""
    threshold = NUMERATOR / DENOMINATOR
    return math.ceil(hashes * threshold - SLACK * math.sqrt(hashes * threshold * (1 - threshold)))


def _sketches(rows: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows[name].to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)


def _near_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            x, y = _sketches(rows, "sketch"), _sketches(rows, "other")
            yield pa.record_batch({"a": batch["a"], "b": batch["b"], "near": pa.array((x == y).sum(axis=1) >= least_equal(x.shape[1]))})


def _near_members(key, rows):
    """Members of a block of a bucket, each with the smallest one it is connected with there."""
    node, x = ids_of(rows, "node"), _sketches(rows, "sketch")
    order = np.argsort(node, kind="stable")
    node, x = node[order], x[order]
    near = np.empty((len(node), len(node)), dtype=bool)
    for i in range(len(node)):
        near[i] = (x == x[i]).sum(axis=1) >= least_equal(x.shape[1])
    np.fill_diagonal(near, False)
    root = local_roots(near)
    some = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"a": pa.array(node[some], pa.int64()), "b": pa.array(node[root[some]], pa.int64())})


def near_pairs(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect all near pairs of ``nodes(node, bands, sketch)`` that share a band."""
    # the band's number is part of its hash
    entry = nodes.select("node", F.explode("bands").alias("band"))
    bucket = entry.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("most"), F.count(F.lit(1)).alias("m")).where("b < most").drop("most")
    star = stored(entry.join(bucket, "band").select("band", "m", F.col("node").alias("a"), "b"))
    sketch = nodes.select(F.col("node").alias("a"), "sketch")
    pairs = star.where("a > b").select("a", "b").distinct().join(sketch, "a").join(sketch.select(F.col("a").alias("b"), F.col("sketch").alias("other")), "b")
    judged = stored(pairs.select("a", "b", "sketch", "other").mapInArrow(_near_star, "a long, b long, near boolean"))
    # buckets with a member far from the smallest one, if there is a third member at all
    mixed = star.where("m > 2").join(judged.where("not near"), ["a", "b"]).select("band").distinct()
    parts = F.ceil(F.col("m") / crowd).cast("int")
    inside = star.join(mixed, "band").select("band", F.col("a").alias("node"), parts.alias("parts"))
    inside = inside.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = inside.select("band", "node", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    met = inside.join(nodes.select("node", "sketch"), "node").groupBy("band", "lo", "hi").applyInArrow(_near_members, "a long, b long")
    return judged.where("near").select("a", "b").unionByName(met)


def candidates(nodes: DataFrame) -> DataFrame:
    """Groups of ``nodes(node, bands, sketch)``: (node, root) for nodes that are near another, directly or through others."""
    return components(near_pairs(nodes))


def count_links(sets: list[np.ndarray], side: np.ndarray, cross: bool) -> np.ndarray:
    """Boolean matrix of linked sets; ``cross`` keeps pairs from different sides only."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    owner, gram = owner[shared], gram[shared]
    inter = np.zeros((m, m), dtype=np.float32)
    heavy = count > max(8, m // 16)
    if heavy.any():
        number = np.cumsum(heavy) - 1
        pick = heavy[gram]
        width, own, col = int(heavy.sum()), owner[pick], number[gram[pick]]
        for a in range(0, width, 4096):  # float32 sums of ones are exact far beyond any set size here
            part = (col >= a) & (col < a + 4096)
            dense = np.zeros((m, min(4096, width - a)), dtype=np.float32)
            dense[own[part], col[part] - a] = 1
            inter += dense @ dense.T
    light = ~heavy[gram]
    owner, gram = owner[light], gram[light]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    step = 1
    while len(gram) > step:
        same = np.flatnonzero(gram[step:] == gram[:-step])
        if not len(same):
            break
        np.add.at(inter, (owner[same], owner[same + step]), 1)
        np.add.at(inter, (owner[same + step], owner[same]), 1)
        step += 1
    linked = np.empty((m, m), dtype=bool)
    for a in range(0, m, 256):  # integers, a few rows at a time
        linked[a : a + 256] = (NUMERATOR + DENOMINATOR) * inter[a : a + 256].astype(np.int64) >= NUMERATOR * (sizes[a : a + 256, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if cross:
        linked &= side[:, None] != side[None, :]
    return linked


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index each row is connected with."""
    label = np.arange(len(linked))
    while True:
        best = np.array([label[row].min(initial=len(linked)) for row in linked], dtype=np.int64)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_VERIFIED = "node long, links long, root long"


def verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, n: int = N, block: int = BLOCK) -> DataFrame:
    """(node, links, root): links per text and pair of blocks, root the smallest text it reaches there."""
    member = stored(nodes.select("node", "_id", "_tk", "n").join(groups, "node"))
    # a text costs 256 n-grams at least, so a block holds at most block / 256 texts
    parts = member.groupBy("root").agg(F.ceil(F.sum(F.greatest("n", F.lit(256))) / block).cast("int").alias("parts"))
    cut = member.join(parts, "root").select("_id", "_tk", "node", "root", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    key = row_key()
    # always a shuffle: the members grow with the documents, so a broadcast would only suit small inputs
    texts = docs.select("text", *key).join(cut.hint("merge"), ["_id", "_tk"]).select("text", "node", "root", "parts", "part")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                grams, first = shingles(Words(column(rows, "text")), n)
                blobs = [grams[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.record_batch({k: column(rows, k) for k in ("node", "root", "parts", "part")} | {"grams": pa.array(blobs, pa.binary())})

    # equal (id, text) rows carry the same node; one of them is enough
    found = texts.mapInArrow(sets, "node long, root long, parts int, part int, grams binary").dropDuplicates(["node"])
    paired = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "node", "root", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "grams")

    def verify(key, rows):
        nodes_, side = ids_of(rows, "node"), column(rows, "part").to_numpy()
        order = np.argsort(nodes_)
        nodes_, side = nodes_[order], side[order]
        blobs = rows["grams"].to_pylist()
        linked = count_links([np.frombuffer(blobs[i], dtype=np.uint64) for i in order], side, key[1].as_py() != key[2].as_py())
        number, root = linked.sum(axis=1), local_roots(linked)
        some = np.flatnonzero(number)
        return pa.table({"node": pa.array(nodes_[some], pa.int64()), "links": pa.array(number[some], pa.int64()), "root": pa.array(nodes_[root[some]], pa.int64())})

    return paired.groupBy("root", "lo", "hi").applyInArrow(verify, _VERIFIED)


def near_classes(docs: DataFrame, n: int = N, recall: float = RECALL) -> DataFrame:
    """doc_id, row key, class_id (smallest id of the linked group), text_id (smallest id with the same n-gram set) and n_links, one row per row.

    ``group`` tells classes apart also where no document of a class has an id.
    """
    bands, rows = bands_for(NUMERATOR / DENOMINATOR, recall)
    signed = signatures(docs, bands, rows, n)
    classes = signed.groupBy("f1", "f2", "n").agg(F.min(F.struct("_id", "_tk")).alias("rep"), F.min("doc_id").alias("text_id"), F.first(F.struct("bands", "sketch")).alias("s"))
    nodes = stored(classes.select(F.col("f1").alias("node"), "f2", "n", "rep._id", "rep._tk", "text_id", "s.bands", "s.sketch"))
    links = stored(verified(docs, nodes, candidates(nodes), n))
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "f2", "n", "text_id").join(linked, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    # a class is named by its smallest document; the empty set stands alone, so equal names mean linked documents
    least = named.groupBy("root").agg(F.min("text_id").alias("class_id"))
    named = named.join(least, "root").select(F.col("node").alias("f1"), "f2", "n", "root", "class_id", "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("doc_id", "_id", "_tk", "f1", "f2", "n").join(named, ["f1", "f2", "n"]).select("doc_id", "_id", "_tk", F.col("root").alias("group"), "class_id", "text_id", "n_links")


def keep_one(docs: DataFrame, n: int = N) -> DataFrame:
    """One row of each class, that with the smallest (id, text hash), with all its columns."""
    first = near_classes(docs, n).groupBy("group").agg(F.min(F.struct("_id", "_tk")).alias("k"))
    names = fresh(docs, "_gf_id", "_gf_tk")
    first = first.select("k._id", "k._tk").toDF(*names)
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(row_key(), names)])
    # the join has put equal rows side by side: dropping repeats of the chosen row needs no further shuffle
    return keyed.join(first.hint("merge"), names, "left_semi").dropDuplicates(names).drop(*names)


def op5(docs: DataFrame) -> DataFrame:
    """Class, text class and number of linked texts of every document."""
    return near_classes(docs).select("doc_id", "class_id", "text_id", "n_links")
