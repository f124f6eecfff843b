"""Helpers shared by the training-data operators: tables, stored intermediates, word arrays and their hashes.

Words are found on UTF-8 bytes: every separator the operators use is ASCII, so bytes above 0x7F always belong to a word and no text is
decoded.  Word and window hashes are polynomial sums over prefix sums, so one numpy pass hashes every word of a chunk of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeframe.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
LAST_ID = (1 << 63) - 1  # where a null id sorts
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes chunks and buckets, so that each stays the same size at any scale."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def row_key() -> list[Column]:
    """Columns that tell rows apart: equal (id, text) rows share a key and get equal results.  A null id sorts last."""
    return [F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(F.col("text").isNull(), "text").alias("_tk")]


def smallest_hashes(df: DataFrame, key: Column, count: int, rows: int) -> DataFrame:
    """Rows of ``df`` (``rows`` in number) whose 64-bit hash ``key`` is among about the ``4 * count`` smallest.

    Ahead of ``orderBy(key).limit(count)`` this keeps what tasks send there in all near ``4 * count`` rows, not ``count`` rows a task.
    """
    share = min(1.0, 4 * count / max(rows, 1))
    return df.where(key <= F.lit(min(-(1 << 63) + int(share * 2.0**64), (1 << 63) - 1)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that no column of ``df`` has (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_class(separators: bytes, lower: bool = False) -> np.ndarray:
    """256 entries: 0 for a separator, else the (folded) byte plus one."""
    out = np.arange(1, 257, dtype=np.uint16)
    out[list(separators)] = 0
    if lower:
        out[65:91] = np.arange(98, 124)
    return out


#: Words of the mixing and substring contracts: all but space and 0x09-0x0D.
PLAIN = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of decontamination: a-z after lower-casing A-Z, digits and everything outside ASCII.
FOLDED = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that all bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Sum of values[i] * base^(i - start) over [start, end), modulo 2^64, for every span at once."""
    acc = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=acc[1:]) if len(values) else None
    inverse = _powers(pow(base, -1, 1 << 64), len(values) + 1)
    return (acc[end] - acc[start]) * inverse[start]


class Words:
    """Words of several documents: byte spans, the word range of each document, and hashes."""

    def __init__(self, texts: pa.Array, classes: np.ndarray = PLAIN):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        self.raw = raw[offsets[0] : offsets[-1]] if len(texts) else raw[:0]
        self.offsets = offsets - offsets[0] if len(texts) else np.zeros(1, dtype=np.int64)
        self.values = classes[self.raw]
        inside = self.values > 0
        n = len(inside)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.offsets[:-1][self.offsets[:-1] < n]] = False
        ends = self.offsets[1:]
        after[ends[ends > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: words of document i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of every word; ``which`` names one of two independent families."""
        codes = np.random.default_rng(7 + which).integers(0, 2**64, 257, dtype=np.uint64)
        return mix(span_sums(codes[self.values], self.start, self.end, _BASES[which]))

    def starts(self, length: int) -> np.ndarray:
        """Word positions where a window of ``length`` words fits into its document."""
        n = len(self) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])

    def windows(self, hashes: np.ndarray, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """64-bit hash of the windows beginning at ``starts``."""
        return mix(span_sums(hashes, starts, starts + length, _BASES[1 - which]))


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Cut a batch into runs of rows whose texts stay near ``limit`` bytes, so that numpy temporaries are bounded."""
    rows = pa.table(batch) if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    if not rows.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(rows[column]), 0).to_numpy().astype(np.int64)
    piece = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), rows.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield rows.slice(a, b - a)


def column(rows: pa.Table, name: str) -> pa.Array:
    """One contiguous array of a table's column."""
    out = rows[name].combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def ids_of(rows: pa.Table, name: str = "doc_id") -> np.ndarray:
    """Ids as int64; null sorts last."""
    return pc.fill_null(column(rows, name).cast(pa.int64()), LAST_ID).to_numpy(zero_copy_only=False)
