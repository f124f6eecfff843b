"""Document fingerprints by order MinHash, sensitive to edit distance.

Every k-mer of a text (``K`` code points) carries its occurrence number, so that repeats count.  For each of ``SIZE`` hash orders the ``TUPLE``
smallest occurrence-numbered k-mers are selected, put back into text order, and their k-mers hashed as one tuple.  Two texts agree in a
component when the same k-mers were selected *and* stand in the same order: shared content in another order does not count, which a plain
MinHash cannot see.  The likeness of two fingerprints is their share of equal components.

A text of fewer than ``K`` code points is one k-mer; an empty or null text has the empty fingerprint, which is like itself (1) and like nothing
else (0).  The selection looks only at hashes below a bound that leaves about ``EXPECTED`` of a text, and at all of them where that leaves too few,
so it is exact at a fraction of the cost of sorting.  Work is one pass of numpy over chunks of ``CHUNK_BYTES``; memory grows with the longest text.

:func:`op13` also meets every document with the next one.  Texts are shuffled once, by range of (doc_id, text hash); each task walks its slice in
order with one document of look-ahead.  Only the documents at slice borders are stored with their text and finished in a second, small pass, so
nothing depends on the number of documents on the driver: it sees three keys per slice.

Defined results.  Null ``doc_id`` sorts last.  Documents of equal id follow one another by the hash of their text.  Rows with equal id and text are
one document, with equal results and one result row each; a third of all rows being such copies is spread by a salt behind the range key.  A single
document is its own successor.  An empty table gives an empty result.  :func:`fingerprints` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from gaugeframe.llm.common import LAST_ID, column, slices, stored

K, TUPLE, SIZE = 12, 2, 64
EXPECTED = 10
CHUNK_BYTES = 256 << 10
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint32(2**32 - 1)
_TAKEN = np.uint64(2**32)  # beyond every 32-bit hash
_ORDERS = np.random.default_rng(13).integers(0, 2**32, (2, SIZE), dtype=np.uint32) | np.uint32(1)


def _occurrences(h: np.ndarray) -> np.ndarray | None:
    """How often each k-mer of one text stood before; None where none repeats.  One sort of (hash, position) words."""
    bits = np.uint64(len(h).bit_length())
    words = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    words.sort()
    keys = words >> bits
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    if fresh.all():
        return None
    at = np.arange(len(h))
    out = np.empty(len(h), dtype=np.uint64)
    out[(words & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """:func:`common.mix` in place."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def _kmers(texts: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all texts in a row, and their number in each; a short text is filled up with a code that no text has."""
    lengths = np.array([len(t) for t in texts])
    counts = np.maximum(lengths - k + 1, 1)
    codes = np.frombuffer("".join(t if len(t) >= k else t.ljust(k, "\0") for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    codes += np.uint64(1)
    ends = np.cumsum(counts + k - 1)
    for i in np.flatnonzero(lengths < k):
        codes[ends[i] - k + lengths[i] : ends[i]] = 0
    whole = np.zeros(len(codes) - k + 1, dtype=np.uint64)
    for r in range(k):
        whole *= np.uint64(_BASE)
        whole += codes[r : r + len(whole)]
    inside = np.ones(len(whole), dtype=bool)
    for e in ends[:-1]:
        inside[e - k + 1 : e] = False
    return _mixed(whole[inside]), counts


def _set(eights: np.ndarray) -> np.ndarray:
    """Places of the few set flags, eight flags looked at a time."""
    some = np.flatnonzero(eights != 0)
    return (some[:, None] * 8 + np.arange(8))[eights[some].view(bool).reshape(-1, 8)]


def signatures(texts: Sequence[str], k: int = K, tuple_size: int = TUPLE) -> np.ndarray:
    """``SIZE`` 32-bit components for each text; zeros for an empty one."""
    out = np.zeros((len(texts), SIZE), dtype=np.uint32)
    filled = [i for i, t in enumerate(texts) if t]
    if not filled:
        return out
    kmers, counts = _kmers([texts[i] for i in filled], k)
    first = np.concatenate([[0], np.cumsum(counts)])
    numbered = kmers.copy()
    for a, b in zip(first[:-1], first[1:]):
        times = _occurrences(kmers[a:b])
        if times is not None:
            numbered[a:b] += times * np.uint64(_BASE)
    numbered = (_mixed(numbered) >> np.uint64(32)).astype(np.uint32)
    bound = np.where(counts <= EXPECTED, _TOP, np.minimum(EXPECTED / counts, 1.0) * float(_TOP)).astype(np.uint32)
    bound, doc = np.repeat(bound, counts), np.repeat(np.arange(len(filled)), counts)
    least = np.minimum(tuple_size, counts)
    values = np.empty_like(numbered)
    eights = np.zeros((len(numbered) + 7) // 8, dtype=np.uint64)
    below = eights.view(bool)[: len(numbered)]
    padded = np.append(kmers, np.uint64(0))
    chosen = np.full((SIZE, tuple_size, len(filled)), len(kmers), dtype=np.int64)
    for j in range(SIZE):
        np.bitwise_xor(numbered, _ORDERS[0, j], out=values)
        np.multiply(values, _ORDERS[1, j], out=values)
        np.less_equal(values, bound, out=below)
        found = _set(eights)
        borders = np.searchsorted(found, first)
        few = borders[1:] - borders[:-1] < least
        if few.any():  # too few below the bound: look at the whole text
            for i in np.flatnonzero(few):
                below[first[i] : first[i + 1]] = True
            found = _set(eights)
            borders = np.searchsorted(found, first)
        left, of = values[found].astype(np.uint64), doc[found]
        for r in range(tuple_size):
            smallest = np.minimum.reduceat(left, borders[:-1])
            hits = np.flatnonzero(left == smallest[of])
            owner = of[hits]
            hits = hits[np.flatnonzero(np.diff(owner, prepend=-1))]  # the first of equal ones
            np.copyto(chosen[j, r], found[hits], where=r < least)
            left[hits] = _TAKEN
    chosen.sort(axis=1)  # text order
    hashes = padded[chosen]
    joined = np.repeat(np.arange(1, SIZE + 1, dtype=np.uint64)[:, None], len(filled), axis=1)
    for r in range(tuple_size):
        joined = _mixed(joined * np.uint64(_BASE) + hashes[:, r])
    out[filled] = (joined >> np.uint64(32)).astype(np.uint32).T
    return out


def packed(texts: Sequence[str], components: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes, four a component, the highest first; empty for an empty text."""
    return [c.tobytes() if t else b"" for t, c in zip(texts, components.astype(">u4"))]


def written(binary: Column) -> Column:
    """Lowercase hex, eight digits a component."""
    return F.lower(F.hex(binary))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components of two fingerprints (0 to 1)."""
    equal = F.filter(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: F.substring(a, 8 * i + 1, F.lit(8)) == F.substring(b, 8 * i + 1, F.lit(8)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.size(equal) / F.lit(float(SIZE)))


def fingerprints(docs: DataFrame, name: str = "fingerprint", k: int = K, tuple_size: int = TUPLE) -> DataFrame:
    """``docs`` with a column ``name``: the fingerprint of ``text``.  One pass, no shuffle."""
    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, limit=CHUNK_BYTES):
                texts = [t or "" for t in column(rows, "text").to_pylist()]
                marks = pa.array(packed(texts, signatures(texts, k, tuple_size)), pa.binary())
                yield pa.record_batch([*(column(rows, i) for i in range(rows.num_columns)), marks], names=[*rows.column_names, name])

    return docs.mapInArrow(run, schema).withColumn(name, written(F.col(f"`{name}`")))


RESULT = (
    ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
)
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double"}
_EDGE = (("part", pa.int64()), ("kind", pa.string()), ("id", pa.int64()), ("hash", pa.int64()), ("times", pa.int64()), ("text", pa.string()))


def _schema(fields) -> str:
    return ", ".join(f"`{n}` {_KINDS[k]}" for n, k in fields)


def _compared(pairs: list[tuple[str, str]], chained: bool) -> list[tuple]:
    """Result columns of (text, next text) pairs; ``chained``: each next text is the following pair's text."""
    own = [a for a, _ in pairs]
    edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in pairs]
    others = [pairs[-1][1]] if chained else [b for _, b in pairs]
    texts = own + others + edited
    marks = signatures(texts)
    bytes_ = packed(texts, marks)
    n, out = len(own), []
    for i in range(n):
        follower, changed = (i + 1 if chained else n + i), n + len(others) + i

        def near(x: int) -> float:
            return float(np.mean(marks[i] == marks[x])) if texts[i] and texts[x] else float(texts[i] == texts[x])

        sha = hashlib.sha256(texts[changed].encode()).digest()
        out.append((len(own[i]), sha, bytes_[i], bytes_[changed], near(changed), near(follower)))
    return out


def _batch(fields, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted slice: finished rows, the first two documents (``head``) and the last one (``tail``) with their texts."""
    fields = (*_EDGE, *RESULT)
    blank = (None,) * len(RESULT)
    waiting: list[list] = []  # distinct documents in order: part, id, hash, times, text
    held = seen = 0
    for batch in batches:
        for rows in slices(batch, limit=CHUNK_BYTES):
            out = []
            for part, i, tk, text in zip(*(column(rows, n).to_pylist() for n in ("part", "id", "hash", "text"))):
                if waiting and waiting[-1][1:3] == [i, tk]:
                    waiting[-1][3] += 1
                    continue
                text = text or ""
                seen += 1
                if seen <= 2:
                    out.append((part, f"head{seen}", i, tk, 1, text, *blank))
                waiting.append([part, i, tk, 1, text])
                held += len(text)
            if held >= CHUNK_BYTES and len(waiting) > 1:
                done = _compared([(a[4], b[4]) for a, b in zip(waiting, waiting[1:])], chained=True)
                out += [(w[0], "done", w[1], w[2], w[3], None, *d) for w, d in zip(waiting, done)]
                waiting = waiting[-1:]
                held = len(waiting[0][4])
            if out:
                yield _batch(fields, out)
    if waiting:
        out = []
        if len(waiting) > 1:
            done = _compared([(a[4], b[4]) for a, b in zip(waiting, waiting[1:])], chained=True)
            out = [(w[0], "done", w[1], w[2], w[3], None, *d) for w, d in zip(waiting, done)]
        part, i, tk, times, text = waiting[-1]
        yield _batch(fields, [*out, (part, "tail", i, tk, times, text, *blank)])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = (("id", pa.int64()), ("times", pa.int64()), *RESULT)
    for batch in batches:
        for rows in slices(batch, limit=CHUNK_BYTES):
            i, times, text, follower = (column(rows, n).to_pylist() for n in ("id", "times", "text", "follower"))
            if i:
                yield _batch(fields, [(a, b, *r) for a, b, r in zip(i, times, _compared(list(zip(text, follower)), chained=False))])


def _followers(edges: list[tuple]) -> list[tuple]:
    """(part, next part, next kind) of every slice's last document, from the (part, kind, id, hash) of the border documents."""
    heads = sorted((p, k, i, h) for p, k, i, h in edges if k != "tail")
    tails = sorted((p, i, h) for p, k, i, h in edges if k == "tail")
    out, at = [], 0
    for part, i, h in tails:
        while at < len(heads) and (heads[at][0] <= part or heads[at][2:] == (i, h)):
            at += 1
        found = heads[at] if at < len(heads) else heads[0]
        out.append((part, found[0], found[1]))
    return out


def op13(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to the edited and to the next one."""
    spark = docs.sparkSession
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text",
        F.monotonically_increasing_id().alias("salt"))
    # the salt splits a document that stands many times; equal keys stay next to one another
    ordered = keyed.repartitionByRange("id", "hash", "salt").sortWithinPartitions("id", "hash", "salt")
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("part"), "id", "hash", "text")
    walked = stored(ordered.mapInArrow(_walk, _schema((*_EDGE, *RESULT))))
    columns = [n for n, _ in RESULT]
    done = walked.where("kind = 'done'").select("id", "times", *columns)
    # three small rows per slice
    edges = [tuple(r) for r in walked.where("kind <> 'done'").select("part", "kind", "id", "hash").collect()]
    after = spark.createDataFrame(_followers(edges), "part long, next_part long, next_kind string")
    heads = walked.where("kind like 'head%'").select(F.col("part").alias("next_part"), F.col("kind").alias("next_kind"), F.col("text").alias("follower"))
    tails = walked.where("kind = 'tail'").select("part", "id", "times", "text").join(after, "part").join(heads, ["next_part", "next_kind"])
    last = tails.select("id", "times", "text", "follower").mapInArrow(_finish, _schema((("id", pa.int64()), ("times", pa.int64()), *RESULT)))
    rows = done.unionByName(last).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select(F.nullif("id", F.lit(LAST_ID)).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                       *[written(F.col(n)).alias(n) if k == pa.binary() else F.col(n) for n, k in RESULT])
