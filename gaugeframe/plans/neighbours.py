"""Exact nearest neighbours by cosine distance, pruned by cells around pivots.

1. Exact copies become one vector, however many there are.
2. A bounded number of pivots splits the vectors into cells; crowded cells are split further by id
   hash, so that a block never holds much more than ``block_rows`` vectors.
3. Every vector gets a limit of its own: the distance it has reached inside its block, or to the pivots, which are vectors of the
   table themselves.  A cell is worth a visit only where its ball reaches into that limit (triangle inequality on the unit sphere), so each
   vector looks at the few cells of its ring.
4. Neighbouring blocks are packed into slabs, one row each, and slabs meet in a Cartesian product, which reads both sides where they are
   stored: no vector is shuffled or written once per block it meets, and what leaves a task is the answer for its vectors.
5. Copies are put back from the k + 1 smallest ids of every copy group.

The driver sees the pivots and one radius per cell, never a list that grows with groups or vectors.  Without any cluster structure nothing is pruned and
every block meets every other: exact search in high dimensions takes that much time, but no more disk than the vectors.  :mod:`gaugeframe.plans.ann`
trades a measured recall for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from gaugeframe.functions.vectors import l2_norm
from gaugeframe.session import cut_lineage

MAX_PIVOTS = 1024
SLAB_ROWS = 4096  # vectors that travel as one row
SLABS_A_TASK = 16  # slabs of the right side that a task of the Cartesian product reads
SLACK = 1e-6  # covers rounding of chord lengths near zero

Limit = Callable[[np.ndarray, "np.ndarray | None"], np.ndarray]


@dataclass
class Blocks:
    """Unit vectors (g, rid, u, cell, sub, subs) placed in blocks; pivots and radii of the cells."""

    rows: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    grouped: bool
    block_rows: int


def unit_vectors(df: DataFrame, id_col: str, vector: str, group: str | None = None) -> DataFrame:
    """(g, id, u): vectors scaled to length 1; vectors without length have no direction and are left out."""
    norm = l2_norm(F.col(vector))
    g = F.lit(0) if group is None else F.col(group)
    # a norm inside the inner function would be taken anew for every component
    scaled = F.transform(F.array(F.struct(F.col(vector).alias("v"), norm.alias("n"))), lambda r: F.transform(r["v"], lambda x: x.cast("double") / r["n"]))
    return df.where(norm > 0).select(g.alias("g"), F.col(id_col).alias("id"), F.get(scaled, F.lit(0)).alias("u"))


def place(units: DataFrame, block_rows: int = 2048, pivots: int = MAX_PIVOTS, grouped: bool = False) -> Blocks:
    """Assign distinct unit vectors (g, rid, u) to pivot cells and blocks; written once."""
    distinct = cut_lineage(units.groupBy("g", "u").agg(F.min("id").alias("rid")))
    n = distinct.count()
    wanted = max(1, min(pivots, math.ceil(n / block_rows)))
    # bounded: at most ``pivots`` vectors, chosen by hash so that any rerun picks the same ones
    picked = distinct.select(F.xxhash64("rid").alias("h"), "rid", "u").orderBy("h", "rid").limit(wanted).collect()
    at = np.array([r["u"] for r in picked], dtype=np.float64)
    result = StructType([StructField("cell", IntegerType()), StructField("far", DoubleType())])

    @F.pandas_udf(result)
    def nearest(u: pd.Series) -> pd.DataFrame:
        x = np.stack(u.to_numpy())
        d2 = np.maximum(2.0 - 2.0 * (x @ at.T), 0.0)
        cell = d2.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "far": np.sqrt(d2[np.arange(len(x)), cell])})

    celled = distinct.withColumn("_p", nearest("u")).select("g", "rid", "u", "_p.cell", "_p.far")
    size = celled.groupBy("g", "cell").agg(F.count("*").alias("m"))
    subs = F.ceil(F.col("m") / F.lit(block_rows)).cast("int")
    placed = celled.join(size.select("g", "cell", subs.alias("subs")), ["g", "cell"])
    rows = cut_lineage(placed.withColumn("sub", F.expr("pmod(xxhash64(rid), subs)").cast("int")))
    radii = np.zeros(len(at))
    for r in rows.groupBy("cell").agg(F.max("far").alias("radius")).collect():  # bounded: one row per pivot
        radii[r["cell"]] = r["radius"]
    return Blocks(rows, at, radii, grouped, block_rows)


def matrix(t: pa.Table) -> np.ndarray:
    return t["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1.0 - x @ y.T


def _ring(blocks: Blocks, u: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which cells (columns) each vector has to look at."""
    return np.sqrt(np.maximum(2.0 * _between(u, blocks.pivots), 0.0)) - blocks.radii <= reach[:, None] + SLACK


def _reached(blocks: Blocks, limit: Limit, left: DataFrame | None = None) -> DataFrame:
    """(g, rid, u, cell, sub, reach): every vector with its block and the chord up to which it looks.

    ``limit(own, pivots)`` turns the distances inside a block (itself on the diagonal) and to the pivots into one distance per vector; pivots of
    other groups say nothing, so it gets None for them where there are groups.
    """
    pivots, grouped = blocks.pivots, blocks.grouped
    rows = (blocks.rows if left is None else blocks.rows.join(left, "rid", "left_semi")).select("g", "rid", "u", "cell", "sub")

    def run(t: pa.Table) -> pa.Table:
        u = matrix(t)
        found = limit(_between(u, u), None if grouped else _between(u, pivots))
        return t.append_column("reach", pa.array(np.sqrt(2.0 * np.maximum(found, 0.0))))

    schema = StructType([*rows.schema.fields, StructField("reach", DoubleType())])
    return rows.groupBy("g", "cell", "sub").applyInArrow(run, schema)


def queries(blocks: Blocks, limit: Limit, left: DataFrame | None = None) -> DataFrame:
    """(g, rid, u, i, si, cells): every vector with its block and the cells within its limit, as a join of blocks would visit them."""
    rows = _reached(blocks, limit, left).select("g", "rid", "u", F.col("cell").alias("i"), F.col("sub").alias("si"), "reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ring = _ring(blocks_here, matrix(t), t["reach"].to_numpy())
            offsets = np.concatenate([[0], np.cumsum(ring.sum(axis=1))]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(ring)[1].astype(np.int32)))
            yield from t.drop_columns("reach").append_column("cells", cells).combine_chunks().to_batches()

    blocks_here = _shape(blocks)
    return rows.mapInArrow(run, StructType([*[f for f in rows.schema.fields if f.name != "reach"], StructField("cells", ArrayType(IntegerType()))]))


def _shape(blocks: Blocks) -> Blocks:
    """Pivots and radii alone, which tasks take along."""
    return Blocks(None, blocks.pivots, blocks.radii, blocks.grouped, blocks.block_rows)


def _slabs(blocks: Blocks, rows: DataFrame) -> DataFrame:
    """(g, rid, cell, u, reach): one row per slab of about ``SLAB_ROWS`` vectors (g, rid, u, cell, sub[, reach]), ordered by cell; written once."""
    kind = rows.schema["rid"].dataType
    wide = max(1, SLAB_ROWS // blocks.block_rows)
    keyed = rows.withColumn("slab", F.floor(F.col("cell") / F.lit(wide)))
    schema = StructType([
        rows.schema["g"], StructField("rid", ArrayType(kind)), StructField("cell", ArrayType(IntegerType())), StructField("u", BinaryType()), StructField("reach", BinaryType())])

    def listed(a: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["cell"].to_numpy(), kind="stable"))).combine_chunks()
        reach = t["reach"].to_numpy().tobytes() if "reach" in t.column_names else None
        return pa.table({
            "g": t["g"].combine_chunks().slice(0, 1), "rid": listed(t["rid"].combine_chunks()), "cell": listed(t["cell"].combine_chunks()),
            "u": pa.array([matrix(t).tobytes()], pa.binary()), "reach": pa.array([reach], pa.binary())})

    return cut_lineage(keyed.groupBy("g", "slab", "sub").applyInArrow(run, schema))


class _Fold:
    """The answer for the vectors of one left slab, made from the blocks of the right side as they come."""

    def __init__(self, ids: np.ndarray, reach: np.ndarray):
        self.ids, self.reach = ids, reach

    def add(self, rows: np.ndarray, d: np.ndarray, other: np.ndarray) -> None:
        """Take in the distances of ``rows`` (places in the slab) to the vectors ``other``."""
        raise NotImplementedError

    def result(self) -> dict[str, np.ndarray]:
        raise NotImplementedError


class Nearest(_Fold):
    """The k nearest other ids; among equally far ones the smaller ids."""

    def __init__(self, ids: np.ndarray, reach: np.ndarray, k: int, itself: bool = False):
        super().__init__(ids, reach)
        self.k, self.itself = k, itself
        self.bound = (reach + SLACK) ** 2 / 2
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, d: np.ndarray, other: np.ndarray) -> None:
        r, c = np.nonzero(d <= self.bound[rows][:, None])
        if not self.itself:
            another = self.ids[rows[r]] != other[c]
            r, c = r[another], c[another]
        self.held.append((rows[r], d[r, c], other[c]))
        self.waiting += len(r)
        if self.waiting > 4 * self.k * len(self.ids) + 4096:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        r, d, other = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((other, d, r))
        r, d, other = r[order], d[order], other[order]
        place_ = np.arange(len(r)) - np.searchsorted(r, r)
        last = place_ == self.k - 1
        self.bound[r[last]] = np.minimum(self.bound[r[last]], d[last])
        kept = place_ < self.k
        self.held, self.waiting = [(r[kept], d[kept], other[kept])], 0

    def result(self) -> dict[str, np.ndarray]:
        self.settle()
        r, d, other = self.held[0] if self.held else (np.zeros(0, int), np.zeros(0), self.ids[:0])
        return {"rid": self.ids[r], "nid": other, "distance": np.maximum(d, 0.0)}


class _Beyond(_Fold):
    """The smallest distance of at least eps; infinite without one."""

    def __init__(self, ids: np.ndarray, reach: np.ndarray, eps: float):
        super().__init__(ids, reach)
        self.eps, self.best = eps, np.full(len(ids), np.inf)

    def add(self, rows: np.ndarray, d: np.ndarray, other: np.ndarray) -> None:
        self.best[rows] = np.minimum(self.best[rows], np.where(d >= self.eps, d, np.inf).min(axis=1, initial=np.inf))

    def result(self) -> dict[str, np.ndarray]:
        return {"rid": self.ids, "distance": self.best}


class _Earliest(_Fold):
    """The smallest id below a vector's own and closer than eps, for vectors that have one."""

    def __init__(self, ids: np.ndarray, reach: np.ndarray, eps: float):
        super().__init__(ids, reach)
        self.eps, self.some, self.best = eps, np.zeros(len(ids), dtype=bool), ids.copy()

    def add(self, rows: np.ndarray, d: np.ndarray, other: np.ndarray) -> None:
        order = np.argsort(other, kind="stable")
        # a vector's own id is where it starts, so anything found is smaller than what is there
        hit = (d[:, order] < self.eps) & (other[order][None, :] < self.best[rows][:, None])
        any_ = hit.any(axis=1)
        self.best[rows[any_]] = other[order][hit.argmax(axis=1)[any_]]
        self.some[rows[any_]] = True

    def result(self) -> dict[str, np.ndarray]:
        return {"rid": self.ids[self.some], "original": self.best[self.some]}


def _meet(blocks: Blocks, asked: DataFrame, fold: Callable[[np.ndarray, np.ndarray], _Fold], schema: str, right: DataFrame | None = None) -> DataFrame:
    """What ``fold`` finds for the vectors of ``asked`` in every block of their rings; ``right`` may narrow the other side to (rid).

    A left slab may come back once per task that meets it, so the caller merges what it gets per ``rid``.
    """
    other = (blocks.rows if right is None else blocks.rows.join(right, "rid", "left_semi")).select("g", "rid", "u", "cell", "sub")
    left, met = _slabs(blocks, asked), _slabs(blocks, other).select(*[F.col(c).alias(f"o_{c}") for c in ("g", "rid", "cell", "u")])
    met = met.coalesce(max(1, math.ceil(met.count() / SLABS_A_TASK)))
    # the product reads the right side where it is stored, once per left partition; nothing is written
    pairs = left.crossJoin(met.hint("shuffle_replicate_nl"))
    if blocks.grouped:
        # not an equality that a join would shuffle by: one group may hold most rows
        pairs = pairs.where(F.array_contains(F.array("g"), F.col("o_g")))
    shape = _shape(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch["rid"][i].values
                if state is None or ids[0] != at:
                    if state is not None:
                        yield answer(state)
                    at, xi = ids[0], ids.to_numpy(zero_copy_only=False)
                    x = np.frombuffer(batch["u"][i].as_buffer()).reshape(len(xi), -1).copy()
                    reach = np.frombuffer(batch["reach"][i].as_buffer()).copy()
                    state, ring = fold(xi, reach), _ring(shape, x, reach)
                yi = batch["o_rid"][i].values.to_numpy(zero_copy_only=False)
                y = np.frombuffer(batch["o_u"][i].as_buffer()).reshape(len(yi), -1)
                cells, starts = np.unique(batch["o_cell"][i].values.to_numpy(), return_index=True)
                for cell, a, b in zip(cells, starts, [*starts[1:], len(yi)]):
                    rows = np.flatnonzero(ring[:, cell])
                    if len(rows):
                        # a cell is about a block, so the distances of a slab to it stay small
                        for low in range(a, b, SLAB_ROWS // 4):
                            high = min(b, low + SLAB_ROWS // 4)
                            state.add(rows, _between(x if len(rows) == len(x) else x[rows], y[low:high]), yi[low:high])
        if state is not None:
            yield answer(state)

    def answer(state: _Fold) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in state.result().items()}, schema=arrow)

    types = StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)
    return pairs.mapInArrow(run, types)


def _kth(k: int) -> Limit:
    """Distance of the k-th other vector in the block or among the pivots."""
    def limit(own: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
        seen = [m for m in (own, pivots) if m is not None and m.shape[1] > k]
        # the vector itself takes one of the k + 1 places
        return np.min([np.partition(m, k, axis=1)[:, k] for m in seen], axis=0) if seen else np.full(len(own), np.inf)
    return limit


def _beyond(eps: float) -> Limit:
    """Distance of the nearest vector at ``eps`` or more in the block or among the pivots."""
    def limit(own: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
        seen = own if pivots is None else np.hstack([own, pivots])
        return np.where(seen >= eps, seen, np.inf).min(axis=1)
    return limit


def knn_join(df: DataFrame, id_col: str, vector: str, k: int, group: str | None = None, block_rows: int = 2048, only: DataFrame | None = None) -> DataFrame:
    """The k nearest other rows of every row: (id, neighbor, distance, rank), ties by neighbour id, within ``group``.

    ``only`` names the rows (by id) whose neighbours are wanted; they are looked for among all rows all the same.
    """
    units = unit_vectors(df, id_col, vector, group)
    blocks = place(units, block_rows, grouped=group is not None)
    kind = units.schema["id"].dataType.simpleString()
    wanted = None if only is None else only.select(F.col(id_col).alias("id")).distinct()
    asking = None if only is None else units.join(wanted, "id", "left_semi").join(blocks.rows.select("g", "u", "rid"), ["g", "u"]).select("rid")
    found = _meet(blocks, _reached(blocks, _kth(k), asking), lambda ids, reach: Nearest(ids, reach, k), f"rid {kind}, nid {kind}, distance double")
    best = found.withColumn("_r", F.row_number().over(W.partitionBy("rid").orderBy("distance", "nid"))).where(F.col("_r") <= k)
    return with_copies(units, blocks.rows, best, id_col, k, wanted)


def with_copies(units: DataFrame, rows: DataFrame, best: DataFrame, id_col: str, k: int, only: DataFrame | None = None) -> DataFrame:
    """Neighbours (rid, nid, distance) of distinct vectors turned into those of all rows, or of those in ``only`` (id).

    Every distinct vector names its k + 1 smallest ids; the rank filter runs before the shuffle.
    """
    owned = units.join(rows.select("g", "u", "rid"), ["g", "u"]).select("id", "rid")
    members = owned.withColumn("_r", F.row_number().over(W.partitionBy("rid").orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    near = best.join(members.select(F.col("rid").alias("nid"), F.col("id").alias("neighbor")), "nid").select("rid", "neighbor", "distance")
    own = members.select("rid", F.col("id").alias("neighbor"), F.lit(0.0).alias("distance"))
    ranked = near.unionByName(own).withColumn("_r", F.row_number().over(W.partitionBy("rid").orderBy("distance", "neighbor"))).where(F.col("_r") <= k + 1)
    # bounded: k + 1 entries per distinct vector
    lists = ranked.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor"))).alias("l"))
    joined = (owned if only is None else owned.join(only, "id", "left_semi")).join(lists, "rid")
    others = F.slice(F.filter("l", lambda e: e["neighbor"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(others).alias("p", "e")).select(
        F.col("id").alias(id_col), F.col("e.neighbor").alias("neighbor"), F.col("e.distance").alias("distance"), (F.col("p") + 1).alias("rank")
    )


def nearest_beyond(blocks: Blocks, eps: float) -> DataFrame:
    """(rid, distance): the closest other distinct vector at a distance of at least eps; null if none."""
    kind = blocks.rows.schema["rid"].dataType.simpleString()
    found = _meet(blocks, _reached(blocks, _beyond(eps)), lambda ids, reach: _Beyond(ids, reach, eps), f"rid {kind}, distance double")
    return found.groupBy("rid").agg(F.min("distance").alias("distance")).withColumn(
        "distance", F.when(F.col("distance") < F.lit(math.inf), F.col("distance"))
    )


def adjacent_earlier(blocks: Blocks, eps: float, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """(rid, original): vectors with an earlier vector of ``right`` closer than eps, and the earliest such one."""
    kind = blocks.rows.schema["rid"].dataType.simpleString()
    asked = _reached(blocks, lambda own, pivots: np.full(len(own), eps), left)
    found = _meet(blocks, asked, lambda ids, reach: _Earliest(ids, reach, eps), f"rid {kind}, original {kind}", right)
    return found.groupBy("rid").agg(F.min("original").alias("original"))
