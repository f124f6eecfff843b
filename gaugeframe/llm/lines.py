"""Line deduplication by pairwise alignment.

Documents that share a line are aligned with a patience diff, and the common blocks are deleted from the later document.

Partners: a line that several documents hold links each of them to the *first* document that holds it, so a line in a third of all documents
costs one pair per document and no pair of later holders is formed.  Rare lines (``RARE`` occurrences at most) always propose their pair.  A
common line proposes where a block around it can reach ``min_words``: it has them alone, or the line before or after it is shared too.  So that
a block is found whose lines each stood alone elsewhere first, runs of lines have a first holder too: from each line, and up to each line,
the shortest run of ``min_words`` words.  Such runs cover every block, so no pair that can lose one is left out.

Alignment: unique common lines are ordered by their longest increasing run, stretches between them are aligned again, and equal lines
next to an anchor join it.  Runs that are consecutive in both documents are blocks; blocks of ``min_words`` words or more are deleted.  So is
every other run of lines of that many words which the earlier document holds too: one that moved, or stands several times.  Only line hashes
travel to the alignment.  Decisions fall on the input, and the first holder of a line never loses it.

Defined results.  Lines end at ``\\n``; they are compared without white space at their ends; blank lines are never compared or deleted.
Order is by doc_id (null last), then text hash; rows with equal id and text are one document and are treated alike.  A null text has no
lines and stays null.  An empty table gives an empty result.  All columns are kept, whatever their names, except that ``text`` is
rewritten.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeframe.llm.common import WORD, fresh, mix, row_key, span_sums, stored

RARE, MIN_WORDS = 64, 10


def _lines(text: Column) -> Column:
    """(place, hash, words) of every line that is not blank."""
    every = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("place"), F.btrim(line, F.lit(" \t\r\x0b\f")).alias("line")))
    return F.transform(F.filter(every, lambda x: x["line"] != ""), lambda x: F.struct(
        x["place"].alias("place"), F.xxhash64(x["line"]).alias("h"), F.xxhash64(F.lit(1), x["line"]).alias("g"),
        F.regexp_count(x["line"], F.lit(WORD)).alias("words")))


def sequences(docs: DataFrame) -> DataFrame:
    """Row key and the lines of every distinct (id, text)."""
    key = row_key()
    return docs.where(F.col("text").isNotNull()).select(*key, _lines(F.col("text")).alias("lines")).where(F.size("lines") > 0).dropDuplicates(["_id", "_tk"])


def least_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the shortest run of ``min_words`` words from each line and up to each line, as far as there is one."""
    upto = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + min_words), np.arange(1, n + 1))
    starts = np.minimum(np.searchsorted(upto, upto[1:] - min_words, "right") - 1, np.arange(n))
    spans = np.concatenate([np.stack([np.arange(n), ends], axis=1)[ends <= n], np.stack([starts, np.arange(1, n + 1)], axis=1)[starts >= 0]])
    codes = np.unique(spans[:, 0] * (n + 1) + spans[:, 1])
    return codes // (n + 1), codes % (n + 1)


def line_runs(seq: DataFrame, min_words: int) -> DataFrame:
    """doc, h, g and words of the :func:`least_runs` of two lines or more."""
    lists = seq.select("_id", "_tk", F.col("lines.h").alias("h"), F.col("lines.g").alias("g"), F.col("lines.words").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["words"].value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(size)), size)
            words = batch["words"].flatten().to_numpy().astype(np.int64)
            start, end = least_runs(words, min_words)
            own = (doc[start] == doc[end - 1]) & (end - start > 1)
            start, end = start[own], end[own]
            hashes = [mix(span_sums(batch[c].flatten().to_numpy().view(np.uint64), start, end, b)).view(np.int64) for c, b in (("h", 0x9E3779B97F4A7C15), ("g", 0xC2B2AE3D27D4EB4F))]
            rows = pa.array(doc[start])
            total = np.concatenate([[0], np.cumsum(words)])
            yield pa.record_batch([batch["_id"].take(rows), batch["_tk"].take(rows), *map(pa.array, hashes), pa.array((total[end] - total[start]).astype(np.int32))], names=["_id", "_tk", "h", "g", "words"])

    return lists.mapInArrow(run, "_id long, _tk long, h long, g long, words int").select(F.struct("_id", "_tk").alias("doc"), F.lit(None).cast("int").alias("at"), "h", "g", "words")


def partners(seq: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct pairs (earlier, later) of row keys that share a line or a run of lines worth aligning."""
    line = seq.select(F.struct("_id", "_tk").alias("doc"), F.posexplode("lines").alias("at", "x")).select("doc", "at", "x.h", "x.g", "x.words").unionByName(line_runs(seq, min_words))
    held = line.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    shared = line.join(held, ["h", "g"]).select("doc", "at", "words", "n", "first")
    order = W.partitionBy("doc").orderBy("at")
    near = (F.lag("at").over(order) == F.col("at") - 1) | (F.lead("at").over(order) == F.col("at") + 1)
    worth = shared.withColumn("near", F.coalesce(near, F.lit(False))).where((F.col("n") <= rare) | (F.col("words") >= min_words) | F.col("near"))
    return worth.where("first < doc").select(F.col("first").alias("earlier"), F.col("doc").alias("later")).distinct()


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        anchors = _increasing([(place[x], j) for j, x in enumerate(b[b0:b1], b0) if x in place])
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given by rising second place, whose first place rises too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(i)
            ends.append(k)
        else:
            tops[at], ends[at] = i, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_blocks(a: Sequence[int], b: Sequence[int], words: Sequence[int], min_words: int) -> list[int]:
    """Positions of ``b`` in common blocks of at least ``min_words`` words: aligned ones, then those that no alignment in order reaches."""
    gone: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for pair in [*patience(a, b), (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            if sum(words[j] for j in block) >= min_words:
                gone += block
            block = []
        block.append(pair[1])
        last = pair
    return sorted({*gone, *_elsewhere(a, b, words, min_words, set(gone))})


def _elsewhere(a: Sequence[int], b: Sequence[int], words: Sequence[int], min_words: int, gone: set[int]) -> Iterator[int]:
    """Positions of ``b`` in runs of ``min_words`` words that stand anywhere in ``a``; of stretches of common lines with one that is not ``gone``."""
    theirs = set(a)
    stretches: list[range] = []
    at = 0
    for common, group in groupby(b, theirs.__contains__):
        n = sum(1 for _ in group)
        part = range(at, at + n)
        if common and any(j not in gone for j in part) and sum(words[at : at + n]) >= min_words:
            stretches.append(part)
        at += n
    if not stretches:
        return
    size = dict(zip(b, words))
    held = {tuple(a[i:k]) for i, k in zip(*least_runs(np.array([size.get(x, 1) for x in a]), min_words))}
    for part in stretches:
        for i, k in zip(*least_runs(np.array(words[part.start : part.stop]), min_words)):
            if tuple(b[part.start + i : part.start + k]) in held:
                yield from range(part.start + i, part.start + k)


def removed_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Row key (_id, _tk), a mask with one byte per line (1: delete) and their number, for documents that lose any."""
    seq = stored(sequences(docs))
    pairs = partners(seq, rare, min_words)
    side = seq.select(F.struct("_id", "_tk").alias("doc"), "lines")
    late = side.select(F.col("doc").alias("later"), F.col("lines.h").alias("b"), F.col("lines.words").alias("words"), F.col("lines.place").alias("place"))
    early = side.select(F.col("doc").alias("earlier"), F.col("lines.h").alias("a"))
    joined = pairs.join(late, "later").join(early, "earlier").select("later", "a", "b", "words", "place")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later, places = [], []
            for i in range(batch.num_rows):
                b, place = batch["b"][i].as_py(), batch["place"][i].as_py()
                gone = common_blocks(batch["a"][i].as_py(), b, batch["words"][i].as_py(), min_words)
                if gone:
                    later.append(batch["later"][i].as_py())
                    places.append([place[j] for j in gone])
            yield pa.record_batch([pa.array([x["_id"] for x in later], pa.int64()), pa.array([x["_tk"] for x in later], pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["_id", "_tk", "gone"])

    found = joined.mapInArrow(align, "_id long, _tk long, gone array<int>")
    united = found.groupBy("_id", "_tk").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for places in batch["gone"]:
                at = places.values.to_numpy()
                mask = np.zeros(at.max() + 1, dtype=np.uint8)
                mask[at] = 1
                masks.append(mask.tobytes())
            yield pa.record_batch([batch["_id"], batch["_tk"], pa.array(masks, pa.binary()), pa.array([sum(m) for m in masks], pa.int64())], names=["_id", "_tk", "mask", "n"])

    return united.mapInArrow(masked, "_id long, _tk long, mask binary, n long")


def dedup_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> tuple[DataFrame, str, str]:
    """``docs`` with the repeated blocks cut out of ``text`` and two columns more; their names: lines that are not blank, lines deleted."""
    gone_id, gone_tk, mask, n, doc, tk, total, removed = fresh(docs, *(f"_gf_{x}" for x in ("id", "tk", "mask", "n", "doc", "text", "lines", "removed")))
    gone = removed_lines(docs, rare, min_words).toDF(gone_id, gone_tk, mask, n)
    key = row_key()
    keyed = docs.select("*", key[0].alias(doc), key[1].alias(tk))
    joined = keyed.join(gone, (F.col(doc) == F.col(gone_id)) & (F.col(tk) == F.col(gone_tk)), "left")
    every = F.split("text", "\n")
    kept = F.array_join(F.filter(every, lambda x, i: F.substring(F.col(mask), i + 1, F.lit(1)) != F.lit(b"\x01")), "\n")
    lines = F.size(F.filter(every, lambda x: F.btrim(x, F.lit(" \t\r\x0b\f")) != ""))
    return joined.select(
        *[F.when(F.col(mask).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias(total), F.coalesce(n, F.lit(0)).alias(removed),
    ), total, removed


def op7(docs: DataFrame) -> DataFrame:
    """Digest of :func:`dedup_lines`."""
    cut, total, removed = dedup_lines(docs)
    return cut.select(
        "doc_id", F.col(total).alias("n_lines"), F.col(removed).alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
