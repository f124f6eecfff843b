"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of about 4 MB, builds the suffix array of a shard over word ids (prefix doubling up to the longest
benchmark item), and searches every suffix of every benchmark item in it by binary search, word by word.  The interval left at window
length gives all occurrences of the window, the depth at which it empties the longest verbatim match.  Training suffixes that leave the
benchmark's vocabulary before the shortest window ends cannot match, and are left out of the array; this is exact.

The benchmark travels to the tasks in blocks of at most ``BLOCK_BYTES`` of text (one item may exceed it alone); every block is searched in
all documents, and a document's hits are united over the blocks.  Texts are never shuffled.

Defined results.  A null text has no words; a document or item without words hits nothing.  Items with a null ``item_id`` mark words but
are not counted or listed; rows that repeat an ``item_id`` are listed once.  Repeated documents, also with a null ``doc_id``, each get
their row.  Empty tables on either side work: no documents give no rows, no items give no hits.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeframe.llm.common import FOLDED, Words, column, fresh, ids_of, row_key, slices, stored

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20


class Items:
    """A block of benchmark items as word ids, with the suffixes to search."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        words = Words(pa.array(texts, pa.large_string()), FOLDED)
        self.names = ids
        self.vocabulary, codes = np.unique(words.hashes(), return_inverse=True)
        keep = words.counts > 0
        self.depth = int(words.counts.max(initial=0))
        #: window length of each item's suffixes, and the shortest of all
        length = np.minimum(words.counts, window)
        self.shortest = int(length[keep].min()) if keep.any() else 0
        self.item = words.doc
        left = words.first[words.doc + 1] - np.arange(len(words))  # words from here to the item's end
        self.left, self.need = left, length[words.doc]
        self.codes = np.append(codes.astype(np.int64) + 1, 0)  # 0 matches nothing


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted start positions of the suffixes of ``codes`` up to ``depth`` words (0 ends a suffix), and their ranks."""
    rank, step, stops = codes.copy(), 1, codes == 0
    while step < depth:
        ahead = np.zeros_like(rank)
        if step < len(rank):
            ahead[:-step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        key[stops] = 0
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) > len(codes) - stops.sum():
            break
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def _narrow(text: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search inside each interval for the first suffix whose word at ``depth`` is not below (``right``: above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        word = text[np.minimum(sa[mid] + depth, len(text) - 1)]
        below = word <= want[open_] if right else word < want[open_]
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)


class Matches:
    """Search of all item suffixes in one shard."""

    def __init__(self, words: Words, items: Items):
        n = len(words)
        self.spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (item suffix, training word, window length)
        self.longest = np.zeros(len(words.counts), dtype=np.int64)
        if not n or not items.shortest:
            return
        h = words.hashes()
        at = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
        known = items.vocabulary[at] == h
        # words of the vocabulary from each position to the next unknown word or document end
        stop = ~known
        ends = np.flatnonzero(stop | (np.arange(n) == words.first[words.doc + 1] - 1))
        end = ends[np.searchsorted(ends, np.arange(n))]
        run = np.where(known, end - np.arange(n) + ~stop[end], 0)
        begin = np.zeros(n, dtype=bool)
        begin[np.flatnonzero(run >= items.shortest)] = True
        # words that some eligible suffix can read, with a stop after each stretch
        reach = np.zeros(n, dtype=bool)
        reach[begin] = True
        reach |= known & np.isin(end, end[begin])
        kept = np.flatnonzero(reach)
        if not len(kept):
            return
        last = np.append((np.diff(kept) > 1) | (words.doc[kept[1:]] != words.doc[kept[:-1]]), True)
        slot = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(last)[:-1]])
        text = np.zeros(slot[-1] + 2, dtype=np.int64)
        text[slot] = at[kept] + 1
        origin = np.full(len(text), -1, dtype=np.int64)
        origin[slot] = kept
        sa, _ = suffix_array(text, items.depth)
        sa = sa[(origin[sa] >= 0) & begin[np.maximum(origin[sa], 0)]]
        query = np.arange(len(items.item))
        lo, hi = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(sa), dtype=np.int64)
        for depth in range(items.depth):
            alive = np.flatnonzero((lo < hi) & (items.left[query] > depth))
            if not len(alive):
                break
            query, lo, hi = query[alive], lo[alive], hi[alive]
            want = items.codes[query + depth]
            lo, hi = _narrow(text, sa, lo, hi, depth, want, False), _narrow(text, sa, lo, hi, depth, want, True)
            found = np.flatnonzero(lo < hi)
            query, lo, hi = query[found], lo[found], hi[found]
            # of a short item only the whole item is a window: its other suffixes are shorter than ``need``
            full = np.flatnonzero((items.need[query] == depth + 1) & (items.left[query] >= items.need[query]))
            if len(full):
                sizes = hi[full] - lo[full]
                spot = np.repeat(lo[full], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                self.spans.append((np.repeat(query[full], sizes), origin[sa[spot]], np.repeat(items.need[query[full]], sizes)))
            if depth + 1 >= items.shortest and len(query):
                cover = np.zeros(len(sa) + 1, dtype=np.int64)
                np.add.at(cover, lo, 1)
                np.add.at(cover, hi, -1)
                docs = words.doc[origin[sa[np.cumsum(cover)[:-1] > 0]]]
                self.longest[docs] = depth + 1


_FOUND = "doc_id long, _id long, _tk long, n_words long, hits array<int>, items array<string>, longest int, first boolean"


def _search(items: Items, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, limit=SHARD_BYTES):
                words = Words(column(rows, "text"), FOLDED)
                found = Matches(words, items)
                hits: list[list[int]] = [[] for _ in range(rows.num_rows)]
                names: list[list[str]] = [[] for _ in range(rows.num_rows)]
                if found.spans:
                    query, at, length = (np.concatenate(x) for x in zip(*found.spans))
                    step = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + length, minlength=len(words) + 1)
                    hit = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                    doc = words.doc[hit]
                    for d, at_words in zip(np.unique(doc), np.split(hit, np.flatnonzero(np.diff(doc)) + 1)):
                        hits[d] = (at_words - words.first[d]).tolist()
                    pairs = np.unique(np.stack([words.doc[at], items.item[query]]), axis=1)
                    for d, i in pairs.T:
                        if items.names[i] is not None:
                            names[d].append(items.names[i])
                yield pa.record_batch({
                    "doc_id": column(rows, "doc_id").cast(pa.int64()), "_id": pa.array(ids_of(rows, "_id")), "_tk": column(rows, "_tk"),
                    "n_words": pa.array(words.counts, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())),
                    "items": pa.array(names, pa.list_(pa.string())), "longest": pa.array(found.longest, pa.int32()),
                    "first": pa.array([number == 0] * rows.num_rows, pa.bool_()),
                })
    return run


def contaminated(hit: Column, words: Column) -> Column:
    """The removal rule: at least a twentieth of the words are hit."""
    return (hit > 0) & (20 * hit >= words)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document and benchmark block: n_words, positions of hit words, ids of matching items, longest match in words.

    One block at a time is on the driver; its matches are stored before the next is read.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    numbered = benchmark.select(F.col("item_id").cast("string").alias("id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).alias("block"))
    rows = docs.select("doc_id", "text", *row_key())
    out = None
    for number in range(count):
        block = numbered.where(F.col("block") == number).select("id", "text").toArrow()
        items = Items(block["id"].to_pylist(), block["text"].to_pylist(), window)
        part = stored(rows.mapInArrow(_search(items, number), _FOUND))
        out = part if out is None else out.unionByName(part)
    return out


def flag_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row key, n_words, n_hit, items (sorted ids), longest and contaminated, one row per document row."""
    found = find_matches(docs, benchmark, window, block_bytes)
    united = found.groupBy("_id", "_tk").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(F.col("first").cast("long")).alias("copies"),
        F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("longest").alias("longest"),
    )
    return united.select(
        "doc_id", "_id", "_tk", "n_words", "n_hit", "items", "longest", contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    names = fresh(docs, "_gf_id", "_gf_tk")
    gone = flag_documents(docs, benchmark, window).where("contaminated").select("_id", "_tk").toDF(*names)
    key = row_key()
    return docs.join(gone, (key[0] == F.col(names[0])) & (key[1] == F.col(names[1])), "left_anti")


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of :func:`flag_documents`."""
    flags = flag_documents(docs, benchmark)
    return flags.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated", "longest",
    )
