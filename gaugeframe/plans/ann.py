"""Approximate nearest neighbours from a stored index of hashed projections.

``build`` writes every distinct vector once to a folder, with its code in each of ``tables`` tables: the signs of ``bits`` random projections.
Crowded codes are cut finer by further projections until no bucket is expected to hold much more than ``bucket_rows`` vectors, at any
size of the table: the number of projections grows with the logarithm of the rows.  The index is read by any number of queries.

``search`` sends every query to the bucket of its code and to the ``probes`` codes that differ in the least certain signs (the smallest margins to
the projection planes).  Buckets are dealt out in groups of codes: a stored vector travels once per table and a query once per group, not once per pair, and
only a query's nearest vectors leave a group, ranked by the exact distance; what is approximate is only which vectors are looked at.  ``tuned_probes``
measures the recall on a bounded sample of queries against the exact distances, by their codes alone, and returns the smallest number of probes that
reaches the target; with all codes probed the search is exact.
"""

from __future__ import annotations

import heapq
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gaugeframe.plans.neighbours import Nearest, matrix, unit_vectors
from gaugeframe.session import cut_lineage

TABLES, BUCKET_ROWS, SAMPLE = 8, 256, 200
MAX_BITS = 48
GROUP_ROWS, PIECE = 1 << 14, 2048  # stored vectors of a group of buckets, and how many of them meet queries at a time


def _planes(tables: int, bits: int, dims: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def _coder(tables: int, bits: int, dims: int, probes: int = 0):
    """Codes of a vector in every table (``table << MAX_BITS | code``), each followed by its ``probes`` nearest other codes."""
    planes = _planes(tables, bits, dims).reshape(-1, dims)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(ArrayType(LongType()))
    def codes(u: pd.Series) -> pd.Series:
        if not len(u):
            return pd.Series([], dtype=object)
        margins = (np.stack(u.to_numpy()) @ planes.T).reshape(len(u), tables, bits)
        base = ((margins > 0) * weights).sum(axis=2)
        home = (np.arange(tables, dtype=np.int64) << MAX_BITS)[None, :]
        if not probes:
            return pd.Series(list(base + home))
        found = []
        for row, own in zip(np.abs(margins), base):
            out = []
            for table, (margin, code) in enumerate(zip(row, own)):
                order = np.argsort(margin)
                out.append(home[0, table] + np.array([code ^ flip for flip in _flips(margin[order], weights[order], probes)]))
            found.append(np.concatenate(out))
        return pd.Series(found)

    return codes


def _flips(margins: np.ndarray, weights: np.ndarray, probes: int) -> list[int]:
    """The empty set and ``probes`` sets of signs to turn, by rising sum of squared margins (best first over shift and expand)."""
    cost = (margins**2).tolist()
    out, heap = [0], [(cost[0], 0, (0,))] if len(cost) else []
    while heap and len(out) <= probes:
        total, last, chosen = heapq.heappop(heap)
        out.append(int(sum(int(weights[i]) for i in chosen)))
        if last + 1 < len(cost):
            heapq.heappush(heap, (total + cost[last + 1], last + 1, (*chosen, last + 1)))
            heapq.heappush(heap, (total + cost[last + 1] - cost[last], last + 1, (*chosen[:-1], last + 1)))
    return out


class Index:
    """A stored index: distinct vectors by code, members of every distinct vector, and the parameters."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.vectors = spark.read.parquet(f"{path}/vectors")
        self.members = spark.read.parquet(f"{path}/members")
        said = json.loads(spark.read.text(f"{path}/parameters").first().value)
        self.tables, self.bits, self.dims, self.rows, self.probes = (said[k] for k in ("tables", "bits", "dims", "rows", "probes"))


def build(df: DataFrame, id_col: str, vector: str, path: str, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, probes: int = 0) -> Index:
    """Write an index of all rows with a direction to ``path`` (a folder every executor can reach).

    ``probes`` is stored as the index's own number of probes; 0 leaves it to :func:`tuned_probes`.
    """
    spark = df.sparkSession
    units = unit_vectors(df, id_col, vector)
    units.groupBy("u").agg(F.min("id").alias("rid")).write.parquet(f"{path}/distinct")
    distinct = spark.read.parquet(f"{path}/distinct")
    n = distinct.count()
    dims = distinct.select(F.size("u").alias("d")).first()
    dims = dims.d if dims else 1
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(max(n, 1) / bucket_rows))) if n > bucket_rows else 1)
    coded = distinct.withColumn("codes", _coder(tables, bits, dims)("u"))
    coded.write.parquet(f"{path}/vectors")
    units.join(distinct, "u").select("id", "rid").write.parquet(f"{path}/members")
    said = {"tables": tables, "bits": bits, "dims": dims, "rows": n, "probes": probes}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/parameters")
    return Index(spark, path)


def _near(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(qid, rid, distance) of ``queries(qid, u)``: at least the k nearest stored vectors of the probed buckets, each once, by the exact distance."""
    # as many low bits of a code as make a group of about GROUP_ROWS vectors; crowded groups are dealt out by id
    inner = max(0, index.bits - max(0, math.ceil(math.log2(max(index.rows, 1) / GROUP_ROWS)) if index.rows > GROUP_ROWS else 0))
    group = F.shiftright("code", inner)
    stored = index.vectors.select("rid", "u", F.explode("codes").alias("code")).withColumn("grp", group)
    parts = stored.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS)).cast("int").alias("parts"))
    stored = stored.join(parts, "grp").select("grp", F.expr("pmod(xxhash64(rid), parts)").cast("int").alias("part"), "code", "rid", "u")
    codes = _coder(index.tables, index.bits, index.dims, probes)("u")
    asked = queries.select("qid", "u", codes.alias("codes"))
    by_group = F.map_from_entries(F.transform(F.array_distinct(F.transform("codes", lambda c: F.shiftright(c, inner))), lambda g: F.struct(
        g.alias("grp"), F.filter("codes", lambda c: F.shiftright(c, inner) == g).alias("codes"))))
    asked = asked.select("qid", "u", F.explode(by_group).alias("grp", "codes")).join(parts, "grp")
    asked = asked.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "codes", "qid", "u")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return arrow.empty_table()
        y = y.take(pa.array(np.argsort(y["code"].to_numpy(), kind="stable"))).combine_chunks()
        at, at_u, own, own_u = x["qid"].to_numpy(), matrix(x), y["rid"].to_numpy(), matrix(y)
        lists = x["codes"].combine_chunks()
        probed, probing = lists.flatten().to_numpy(), np.repeat(np.arange(x.num_rows), lists.value_lengths().to_numpy())
        order = np.argsort(probed, kind="stable")
        probed, probing = probed[order], probing[order]
        found = Nearest(np.arange(x.num_rows), np.full(x.num_rows, np.inf), k, itself=True)
        codes, starts = np.unique(y["code"].to_numpy(), return_index=True)
        for code, a, b in zip(codes, starts, [*starts[1:], len(own)]):
            rows = probing[np.searchsorted(probed, code) : np.searchsorted(probed, code, side="right")]
            for low in range(a, b if len(rows) else a, PIECE):
                high = min(b, low + PIECE)
                for first in range(0, len(rows), PIECE):
                    some = rows[first : first + PIECE]
                    found.add(some, 1 - at_u[some] @ own_u[low:high].T, own[low:high])
        got = found.result()
        return pa.Table.from_pydict({"qid": pa.array(at[got["rid"]]), "rid": pa.array(got["nid"]), "distance": pa.array(got["distance"])}, schema=arrow)

    types = StructType([StructField("qid", queries.schema["qid"].dataType), StructField("rid", index.vectors.schema["rid"].dataType), StructField("distance", DoubleType())])
    arrow = to_arrow_schema(types)
    found = asked.groupBy("grp", "part").cogroup(stored.groupBy("grp", "part")).applyInArrow(run, types)
    return found.groupBy("qid", "rid").agg(F.min("distance").alias("distance"))


def search(index: Index, df: DataFrame, id_col: str, vector: str, k: int, probes: int | None = None, itself: bool = False) -> DataFrame:
    """(id, neighbor, distance, rank) of the rows of ``df``: the k nearest indexed rows, ties by neighbour id.

    ``itself`` keeps a row of the same id among the neighbours.
    """
    units = unit_vectors(df, id_col, vector).select(F.col("id").alias("qid"), "u")
    found = _near(index, units, k + 1, index.probes if probes is None else probes)
    near = found.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy("distance", "rid"))).where(F.col("_r") <= k + 1).drop("_r")
    # every distinct vector stands for its k + 1 smallest ids
    members = index.members.withColumn("_r", F.row_number().over(W.partitionBy("rid").orderBy("id"))).where(F.col("_r") <= k + 1)
    rows = near.join(members.select("rid", F.col("id").alias("neighbor")), "rid")
    if not itself:
        rows = rows.where(F.col("neighbor") != F.col("qid"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("distance", "neighbor"))).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(id_col), "neighbor", "distance", "rank")


def recall(index: Index, sample: DataFrame, k: int, probes: int, truth: DataFrame | None = None) -> float:
    """Share of the true k nearest distinct vectors (``truth(qid, rid)``) of ``sample(qid, u)`` that a search looks at: those with a probed code."""
    truth = _exact(index, sample, k) if truth is None else truth
    probed = sample.select("qid", _coder(index.tables, index.bits, index.dims, probes)("u").alias("probed"))
    met = truth.join(index.vectors.select("rid", "codes"), "rid").join(probed, "qid")
    row = met.agg(F.avg(F.arrays_overlap("codes", "probed").cast("double")).alias("r")).first()
    return float(row.r or 0.0)


def _exact(index: Index, sample: DataFrame, k: int) -> DataFrame:
    """(qid, rid) of the k nearest distinct vectors of a bounded sample, by a scan of the index: k rows a query leave every task."""
    asked = sample.collect()  # bounded: at most SAMPLE vectors
    ids, at = [r.qid for r in asked], np.array([r.u for r in asked], dtype=np.float64).reshape(len(asked), -1)
    kind, own = index.vectors.schema["rid"].dataType.simpleString(), sample.schema["qid"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf) and ids:
                d = 1 - at @ np.stack(pdf["u"].to_numpy()).T
                take = min(k, d.shape[1])
                best = np.argpartition(d, take - 1, axis=1)[:, :take]
                yield pd.DataFrame({
                    "qid": np.repeat(np.array(ids), take), "rid": pdf["rid"].to_numpy()[best.ravel()], "distance": d[np.arange(len(ids))[:, None], best].ravel()})

    near = index.vectors.select("rid", "u").mapInPandas(run, f"qid {own}, rid {kind}, distance double")
    return near.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy("distance", "rid"))).where(F.col("_r") <= k).select("qid", "rid")


def tuned_probes(index: Index, k: int, target: float = 0.9, sample: int = SAMPLE) -> int:
    """The smallest power of two of probes (or all codes) whose recall on ``sample`` stored vectors reaches ``target``."""
    asked = cut_lineage(index.vectors.select(F.col("rid").alias("qid"), "u").orderBy(F.xxhash64("qid")).limit(sample))
    truth = cut_lineage(_exact(index, asked, k))
    probes, every = 1, (1 << index.bits) - 1
    while probes < every and recall(index, asked, k, probes, truth) < target:
        probes = min(2 * probes, every)
    return probes
