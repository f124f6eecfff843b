"""Substring deduplication by fixed-block anchors.

A repeat of at least ``window`` words always contains a whole aligned block of ``(window + 1) // 2`` words, wherever it begins.  So each
document indexes only its non-overlapping blocks, every rolling window of block length probes that index, and a hit is extended to the
windows around it.  The corpus is cut into chunks of about 2 MB of text by a hash of the row, and the index into buckets by a hash of the
block; chunks send their packed block hashes to buckets and get back one bit per probe.  Texts are shuffled once (the three passes over the
chunks share the exchange), probes take four bytes, and no pair of documents is ever formed.  A chunk sends a hash once, not once per occurrence: what the
other occurrences need follows from the answer and the chunk itself.  So a passage in a third of all documents costs its bucket three
entries for each 2 MB of text, whatever the number of copies in them.

1. anchors: chunk -> bucket: hash of every rolling block, with a flag on aligned ones.  A probe is hit where an aligned block of a smaller
   id has its hash; an aligned block is hit where a larger id probes it.  Of equal hashes go the aligned one of the smallest id and the one of the
   largest id; if either is hit, all are.  32-bit hashes inside a bucket of bounded size: a false hit only costs a look in step 2.
2. extension: chunk -> bucket: 96-bit hash of every distinct full window around a hit anchor, with its smallest id in the chunk; the answer says whether
   a smaller one has it elsewhere, and without that the others of the chunk repeat its own smallest.  Overlapping repeated windows of a document merge
   to maximal repeats.
3. chunk: words covered by a repeat go.

Defined results.  Null text: no words.  A null ``doc_id`` sorts last, after every other id, and rows with equal ids never remove each
other's words.  Repeated rows get equal results.  Documents under ``window`` words lose nothing.  An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeframe.llm.common import Words, column, ids_of, partitions, text_bytes

WINDOW = 13
CHUNK_TEXT, BUCKET_TEXT = 2 << 20, 16 << 20

_SENT = "bucket long, chunk long, keys binary, flags binary, ids binary, counts binary"
_REPLY = "chunk long, bucket long, bits binary"
_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def _arrow(ddl_names: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in ddl_names.split(", "))]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


class _Chunk:
    """Documents of one chunk in a fixed order, with the block hash at each word."""

    def __init__(self, rows: pa.Table, window: int):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.rows, self.texts, self.ids = rows, column(rows, "text"), ids_of(rows)
        self.words = Words(self.texts)
        self.h = self.words.hashes()
        self.block = (window + 1) // 2
        # documents without a full window can neither repeat nor be repeated
        at = self.words.starts(self.block)
        self.at = at[self.words.counts[self.words.doc[at]] >= window]
        self.anchors = self.words.windows(self.h, self.at, self.block)

    def aligned(self) -> np.ndarray:
        return (self.at - self.words.first[self.words.doc[self.at]]) % self.block == 0

    def spokesmen(self) -> tuple[np.ndarray, np.ndarray]:
        return _spokesmen(self.anchors, self.aligned())


def _order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions by bucket, and where each bucket begins."""
    bucket = ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint32)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def _ranges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by key, and for each of them the number of its key."""
    order = np.argsort(keys, kind="stable")
    return order, np.cumsum(np.concatenate([[False], keys[order[1:]] != keys[order[:-1]]])) if len(keys) else order


def _spokesmen(hashes: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that speak for equal hashes (the aligned one of the smallest id, the one of the largest), and the number of each position's hash.

    Positions come by rising id, so the first aligned one has the smallest id and the last one the largest.
    """
    order, number = _ranges(hashes)
    group = np.empty(len(hashes), dtype=np.int64)
    group[order] = number
    last = order[np.flatnonzero(np.append(number[1:] != number[:-1], True))] if len(order) else order
    lined = order[aligned[order]]
    first = lined[np.flatnonzero(np.diff(group[lined], prepend=-1))]
    return np.unique(np.concatenate([first, last])), group


def _packed(chunk: int, hashes: np.ndarray, keys: np.ndarray, flags: np.ndarray | None, doc: np.ndarray, ids: np.ndarray, buckets: int) -> list[tuple]:
    order, cut = _order(hashes, buckets)
    rows = []
    for b in np.flatnonzero(np.diff(cut)):
        pick = order[cut[b] : cut[b + 1]]
        # word order inside a bucket keeps the documents in runs
        run = np.flatnonzero(np.diff(doc[pick], prepend=-1))
        counts = np.diff(np.append(run, len(pick))).astype("<u4")
        some = b"" if flags is None else np.packbits(flags[pick]).tobytes()
        rows.append((int(b), chunk, keys[pick].tobytes(), some, ids[doc[pick[run]]].astype("<i8").tobytes(), counts.tobytes()))
    return rows


def _sent(rows: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Keys, document ids and flags of all messages of a bucket, and how many keys each message has."""
    keys = [np.frombuffer(x, dtype=kind) for x in rows["keys"].to_pylist()]
    ids = [np.repeat(np.frombuffer(i, dtype="<i8"), np.frombuffer(c, dtype="<u4")) for i, c in zip(rows["ids"].to_pylist(), rows["counts"].to_pylist())]
    flags = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)).astype(bool) if x else np.ones(len(k), bool) for x, k in zip(rows["flags"].to_pylist(), keys)]
    return np.concatenate(keys), np.concatenate(ids), np.concatenate(flags), [len(k) for k in keys]


def _reply(rows: pa.Table, hit: np.ndarray, sizes: list[int]) -> pa.Table:
    out, at = [], 0
    for chunk, bucket, n in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), sizes):
        out.append((chunk, bucket, np.packbits(hit[at : at + n]).tobytes()))
        at += n
    return _arrow(_REPLY, out)


def _match_anchors(rows: pa.Table) -> pa.Table:
    keys, ids, aligned, sizes = _sent(rows, np.dtype("<u4"))
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) != 0)
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    own, indexed = ids[order], aligned[order]
    least = np.minimum.reduceat(np.where(indexed, own, np.iinfo(np.int64).max), begin)[group]
    most = np.maximum.reduceat(own, begin)[group]
    hit = np.empty(len(keys), dtype=bool)
    hit[order] = (least < own) | (indexed & (most > own))
    return _reply(rows, hit, sizes)


def _match_windows(rows: pa.Table) -> pa.Table:
    if rows["bucket"][0].as_py() < 0:  # the chunk's own note to step 3
        return _arrow(_REPLY, list(zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), rows["keys"].to_pylist())))
    keys, ids, _, sizes = _sent(rows, _KEY)
    order = np.lexsort((keys["b"], keys["a"]))
    a, b = keys["a"][order], keys["b"][order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.empty(len(keys), dtype=bool)
    hit[order] = least < ids[order]
    return _reply(rows, hit, sizes)


def _answered(replies: pa.Table, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of all buckets, back in word order."""
    hit = np.zeros(len(hashes), dtype=bool)
    order, cut = _order(hashes, buckets)
    for b, bits in zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist()):
        if b >= 0:
            pick = order[cut[b] : cut[b + 1]]
            hit[pick] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(pick)).astype(bool)
    return hit


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, per row of ``docs(doc_id, text)``."""
    size = text_bytes(docs)
    chunks, n = max(1, -(-size // CHUNK_TEXT)), partitions(docs.sparkSession)
    buckets = max(8, -(-size // BUCKET_TEXT))
    block = (window + 1) // 2

    def send_anchors(key, rows):
        c = _Chunk(rows, window)
        sent, _ = c.spokesmen()
        hashes = c.anchors[sent]
        low = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
        return _arrow(_SENT, _packed(key[0].as_py(), hashes, low, c.aligned()[sent], c.words.doc[c.at[sent]], c.ids, buckets))

    def candidates(c: _Chunk, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window positions, their hashes, the first position of each distinct window, and the number of each position's window."""
        at = np.flatnonzero(near)
        keys = np.empty(len(at), dtype=_KEY)
        keys["a"], keys["b"] = c.words.windows(c.h, at, window), c.words.windows(c.words.hashes(1), at, window, 1).astype("<u4")
        order = np.lexsort((np.arange(len(at)), keys["b"], keys["a"]))
        new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]) if len(at) else np.zeros(0, dtype=bool)
        number = np.empty(len(at), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        return at, keys, order[new], number

    def send_windows(key, rows, replies):
        c = _Chunk(rows, window)
        hit = np.zeros(len(c.words) + 1, dtype=np.int64)
        sent, group = c.spokesmen()
        told = np.zeros(int(group.max(initial=-1)) + 1, dtype=bool)
        told[group[sent[_answered(replies, c.anchors[sent], buckets)]]] = True
        hit[c.at[told[group]] + 1] = 1
        seen = np.cumsum(hit)  # hit anchors before each word
        starts = c.words.starts(window)
        near = np.zeros(len(c.words), dtype=bool)
        near[starts] = seen[starts + window - block + 1] > seen[starts]
        at, keys, sent, _ = candidates(c, near)
        if not len(at):
            return _arrow(_SENT, [])
        chunk = key[0].as_py()
        note = (-1 - chunk, chunk, np.packbits(near).tobytes(), b"", b"", b"")
        sent = np.sort(sent)
        return _arrow(_SENT, [note, *_packed(chunk, keys["a"][sent], keys[sent], None, c.words.doc[at[sent]], c.ids, buckets)])

    def finish(key, rows, replies):
        c = _Chunk(rows, window)
        gone = np.zeros(len(c.words), dtype=bool)
        note = [x for b, x in zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist()) if b < 0]
        if note:
            near = np.unpackbits(np.frombuffer(note[0], dtype=np.uint8), count=len(c.words)).astype(bool)
            at, keys, first, number = candidates(c, near)
            sent = np.sort(first)
            elsewhere = np.zeros(len(first), dtype=bool)
            elsewhere[number[sent]] = _answered(replies, keys["a"][sent], buckets)
            owner = c.ids[c.words.doc[at]]
            at = at[elsewhere[number] | (owner > owner[first][number])]
            step = np.bincount(at, minlength=len(gone) + 1) - np.bincount(at + window, minlength=len(gone) + 1)
            gone = np.cumsum(step)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False), c.words.first[:-1]) * (c.words.counts > 0) if len(c.texts) else []
        kept = []
        for i, text in enumerate(c.texts.to_pylist()):
            words = (text or "").encode().split()
            kept.append(b" ".join(compress(words, ~gone[c.words.first[i] : c.words.first[i + 1]]) if removed[i] else words).decode())
        return pa.table({
            "doc_id": c.rows["doc_id"].cast(pa.int64()), "n_words": pa.array(c.words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.string()),
        })

    chunked = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")).repartition(n, "chunk")
    by_chunk = chunked.groupBy("chunk")
    anchors = by_chunk.applyInArrow(send_anchors, _SENT).groupBy("bucket").applyInArrow(_match_anchors, _REPLY)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(send_windows, _SENT).groupBy("bucket").applyInArrow(_match_windows, _REPLY)
    return by_chunk.cogroup(windows.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def op3(docs: DataFrame) -> DataFrame:
    """Digest of :func:`remove_repeats`."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
