"""Exact order statistics of many columns by distributed selection.

Every pass cuts the values that can still be wanted into at most ``CELLS`` cells by a monotone function, counts the cells in the map tasks, and
adds the counts up along the cells; each wanted position then lies in one known cell, and only that cell's values matter to the next pass.  No task
sorts values, and no task sees more than one row per cell.  The first pass cuts by sign and logarithm, ``1 / OCTAVE`` of a power of two each; a cell
then spans at most ``2 ** 52 / OCTAVE`` neighbouring doubles, and every later pass divides what is left by ``CELLS``.  As soon as the wanted cells hold few
enough rows (always after the fourth pass) their exact values are the cells.  A small table thus takes two scans, the largest one four.

The positions and their cells, one row per metric and mark, pass the driver between the passes; nothing else does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELLS, OCTAVE = 1 << 16, 16
FARTHEST = 2100 * OCTAVE  # beyond the logarithm of every finite double

Mark = tuple[float, Callable[[Column], Column]]


def index_mark(numerator: int, denominator: int) -> Mark:
    """The element at sorted position n * numerator // denominator."""
    return numerator / denominator, lambda n: F.floor(n * F.lit(numerator) / F.lit(denominator)).cast("long")


QUARTILE_MARKS: dict[str, Mark] = {"q1": index_mark(1, 4), "median": index_mark(2, 4), "q3": index_mark(3, 4)}


def linear_marks(points: dict[str, float]) -> dict[str, Mark]:
    """Two neighbouring positions per point, for linear interpolation between them."""
    marks: dict[str, Mark] = {}
    for name, p in points.items():
        marks[f"{name}_lo"] = (p, lambda n, p=p: F.floor((n - 1) * F.lit(p)).cast("long"))
        marks[f"{name}_hi"] = (p, lambda n, p=p: F.ceil((n - 1) * F.lit(p)).cast("long"))
    return marks


def long_metrics(df: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide rows to (keep..., metric, value) inside the scan stage; NULL and NaN are missing."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    out = df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.metric", "_p.value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _logarithmic(value: Column) -> Column:
    """Cell of the first pass: sign and logarithm; monotone, 0 for 0."""
    size = F.lit(1) + F.floor((F.log2(F.abs(value)) + 1075) * OCTAVE)
    return F.when(value == 0, F.lit(0).cast("long")).when(value == float("inf"), FARTHEST).when(value == float("-inf"), -FARTHEST).otherwise(
        F.signum(value).cast("long") * F.least(size, F.lit(FARTHEST - 1)))


def _linear(value: Column, lo: Column, hi: Column) -> Column:
    """Cell of a later pass: equal steps between the smallest and the largest value left."""
    return F.when(hi > lo, F.floor((value - lo) / (hi - lo) * CELLS)).otherwise(F.lit(0).cast("long"))


def _accumulated(cells: DataFrame, before: list[str], last: str) -> DataFrame:
    """``first`` and ``past``: positions a cell covers among those of equal ``before``; at most ``CELLS`` rows (twice in the first pass) share a window."""
    upto = W.partitionBy("metric", *before).orderBy(last).rowsBetween(W.unboundedPreceding, 0)
    return cells.withColumn("past", F.sum("n").over(upto)).withColumn("first", F.col("past") - F.col("n"))


def order_statistics(df: DataFrame, metrics: Sequence[str], marks: dict[str, Mark] | None = None) -> DataFrame:
    """One row per metric with data: metric, n, min, max and the exact value at every mark."""
    marks = marks or QUARTILE_MARKS
    spark = df.sparkSession
    values = long_metrics(df, metrics).withColumn("c0", _logarithmic(F.col("value")))
    counts = [F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    first = values.groupBy("metric", "c0").agg(*counts)
    whole = W.partitionBy("metric")
    cells = _accumulated(first, [], "c0").withColumns({"total": F.sum("n").over(whole), "min": F.min("lo").over(whole), "max": F.max("hi").over(whole)})
    wanted = F.array(*[F.struct(F.lit(name).alias("mark"), index(F.col("total")).alias("at")) for name, (_, index) in marks.items()])
    found = cells.select("*", F.explode(F.filter(wanted, lambda w: (w["at"] >= F.col("first")) & (w["at"] < F.col("past")))).alias("w"))
    picked = found.select("metric", "total", "min", "max", "w.mark", (F.col("w.at") - F.col("first")).alias("at"), "c0", "n", "lo", "hi").collect()
    prefix, open_ = ["c0"], [r.asDict() for r in picked]
    closed = [r for r in open_ if r["lo"] == r["hi"]]
    open_ = [r for r in open_ if r["lo"] < r["hi"]]
    while open_:
        places = {(r["metric"], *[r[c] for c in prefix]): (r["n"], r["lo"], r["hi"]) for r in open_}
        exact = len(prefix) == 3 or sum(n for n, _, _ in places.values()) <= CELLS
        c = f"c{len(prefix)}"
        schema = ", ".join(["metric string", *[f"{p} long" for p in prefix], "left_lo double", "left_hi double"])
        left = spark.createDataFrame([(*k, lo, hi) for k, (_, lo, hi) in places.items()], schema)
        # bounded: one row per metric and mark
        values = values.join(F.broadcast(left), ["metric", *prefix])
        cell = F.col("value") if exact else _linear(F.col("value"), F.col("left_lo"), F.col("left_hi"))
        values = values.withColumn(c, cell).drop("left_lo", "left_hi")
        cells = _accumulated(values.groupBy("metric", *prefix, c).agg(*counts), prefix, c)
        asked = spark.createDataFrame(
            [(r["metric"], *[r[p] for p in prefix], r["mark"], r["at"]) for r in open_],
            ", ".join(["metric string", *[f"{p} long" for p in prefix], "mark string", "at long"]))
        inside = cells.join(F.broadcast(asked), ["metric", *prefix]).where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("past")))
        rows = {(r.metric, r.mark): r for r in inside.withColumn("at", F.col("at") - F.col("first")).drop("first", "past").collect()}
        open_ = [r | rows[r["metric"], r["mark"]].asDict() for r in open_]
        closed += [r for r in open_ if r["lo"] == r["hi"]]
        open_ = [r for r in open_ if r["lo"] < r["hi"]]
        prefix.append(c)
    results: dict[str, dict] = {}
    for r in closed:
        results.setdefault(r["metric"], {"metric": r["metric"], "n": r["total"], "min": r["min"], "max": r["max"]})[r["mark"]] = r["lo"]
    fields = ["metric string", "n long", "min double", "max double", *[f"`{m}` double" for m in marks]]
    names = ["metric", "n", "min", "max", *marks]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in results.values()], ", ".join(fields))


def linear_quantiles(df: DataFrame, metrics: Sequence[str], points: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (position (n - 1) * p), exact."""
    stats = order_statistics(df, metrics, linear_marks(points))
    out = []
    for name, p in points.items():
        pos = (F.col("n") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        out.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * frac).alias(name))
    return stats.select("metric", "n", "min", "max", *out)
