"""Mixing sources to target weights with a low-discrepancy schedule.

Slot k of the schedule looks at the point frac((k + 1) * golden ratio) and takes the source whose share of the cumulative targets holds
that point, so every stretch of the schedule keeps close to the shares.  The slots of a source are ranked; rank r takes block r of the
source's words, where the blocks are equal cuts of its shuffled documents, one shuffle per epoch.  Slots beyond a source's target stay
empty; the few blocks that the schedule leaves short are appended as closing slots, so each source reaches its target to the word.

Ranks and running word counts are computed over range-partitioned slices (`plans.scan.running`), so a source with a third of all rows
spreads over a third of the tasks.  The table of sources stays a table, be they a handful or every host of a crawl: its order, its level and the
intervals of the schedule are running sums too, and the driver sees totals only.

Defined results.  A null text has size 0 and is never taken; a null ``source`` is a source of its own, sorted last.  Equal rows (same id,
same text, same source) get equal results; each takes its own part.  An empty table gives an empty mix.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeframe.llm.common import LAST_ID, WORD, stored
from gaugeframe.plans.joins import null_safe_join
from gaugeframe.plans.scan import ranked, running

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2
BLOCK = 64
_STEP = (math.sqrt(5) - 1) / 2


def source_table(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, src (from 0, by code point, null last), source_size, target, take and upto (words to take up to this source).

    Sharing the excess again and again ends at one level: a source gets its weight times the level, or ``cap`` times its size if that is less.
    In the order of ``cap * size / weight`` the capped sources come first, so running sums name the level at every place.
    """
    numbered = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [], [F.col("source").asc_nulls_last()], "src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    most = F.lit(cap) * F.col("source_size")
    numbered = numbered.withColumn("src", F.col("src") - 1).withColumns({"weight": weight, "most": most})
    numbered = stored(numbered.withColumn("ratio", F.col("most") / F.col("weight")))
    sums = numbered.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    summed = running(numbered, [], [F.col("ratio"), F.col("src")], {"mosts": F.col("most"), "weights": F.col("weight")})
    level = (F.lit(share * (sums.size or 0)) - (F.col("mosts") - F.col("most"))) / (F.lit(sums.weight or 0.0) - F.col("weights") + F.col("weight"))
    found = summed.withColumn("level", level).where("level <= ratio").agg(F.min(F.struct("ratio", "src", "level")).alias("f")).first().f
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(found.level)) if found else F.col("most").cast("double")
    goal = numbered.withColumn("target", target).withColumn("take", F.least(F.floor(F.col("target") + 0.5), "most"))
    return stored(running(goal, [], [F.col("src")], {"upto": F.col("take")}).select("source", "src", "source_size", "target", "take", "upto"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Documents with size and the columns of their source, and the table of sources."""
    sized = stored(docs.select("doc_id", "text", "source").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), F.xxhash64("doc_id", "text", "source").alias("_row"),
    ))
    sources = source_table(sized, weights, share, cap)
    return null_safe_join(sized, sources.drop("upto"), ["source"]), sources


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, src and rank (from 0) of every slot that takes words.

    Points and the beginnings of the sources' intervals are put in one order; the last beginning before a point names its source.
    """
    spark = sources.sparkSession
    total = sources.agg(F.max("upto")).first()[0] or 0
    slots = -(-total // block)
    point = (F.col("id") + 1) * F.lit(_STEP)
    none = F.lit(None).cast("long")
    begins = sources.where("take > 0").select(((F.col("upto") - F.col("take")) / F.lit(max(total, 1))).alias("at"), "src", none.alias("slot"))
    points = spark.range(slots).select((point - F.floor(point)).alias("at"), none.alias("src"), F.col("id").alias("slot"))
    order = [F.col("at"), F.col("slot").asc_nulls_first(), F.col("src")]
    drawn = running(begins.unionByName(points), [], order, prior_maxes={"drawn": F.col("src")}).where("slot is not null").select("slot", F.col("drawn").alias("src"))
    ranks = ranked(drawn, ["src"], [F.col("slot")]).withColumn("rank", F.col("rank") - 1)
    need = sources.select("src", F.ceil(F.col("take") / block).alias("need"))
    have = ranks.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    closing = need.join(have, "src", "left").select("src", F.coalesce("have", F.lit(0)).alias("have"), "need").where("have < need").select(
        "src", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    closing = closing.select((F.lit(slots) + F.col("rank")).alias("slot"), "src", "rank")
    filled = ranks.join(need, "src").where("rank < need").select("slot", "src", "rank")
    return filled.unionByName(closing)


def pieces(sized: DataFrame, seed: int = 0, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """Each document's part of every block it lies in, over ``cap`` epochs: src, rank (block number), words [from, to) of the document."""
    epochs = sized.where("size > 0").select("*", F.explode(F.array(*[F.lit(e) for e in range(cap)])).alias("epoch"))
    mixed = epochs.withColumn("_shuffle", F.xxhash64(F.lit(seed), "epoch", "_row"))
    placed = running(mixed, ["src"], [F.col("epoch"), F.col("_shuffle"), F.col("_id")], {"_end": F.col("size")})
    begin = F.col("_end") - F.col("size")
    # the last block of a source is cut at its target
    placed = placed.withColumns({"_begin": begin, "_stop": F.least("_end", "take")}).where("_begin < _stop")
    blocks = F.sequence(F.floor(F.col("_begin") / block), F.floor((F.col("_stop") - 1) / block))
    return placed.select("*", F.explode(blocks).alias("rank")).select(
        "doc_id", "_id", "_row", "src", "epoch", "rank",
        (F.greatest(F.col("_begin"), F.col("rank") * block) - F.col("_begin")).alias("from"),
        (F.least(F.col("_stop"), (F.col("rank") + 1) * block) - F.col("_begin")).alias("to"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix as (slot, doc_id, epoch, from, to) and the documents with size, source_size, target and row hash."""
    sized, sources = plan(docs, weights, share, cap)
    parts = pieces(sized, seed, block, cap)
    return parts.join(schedule(sources, block), ["src", "rank"]).select("slot", "doc_id", "_id", "_row", "epoch", "from", "to"), sized


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and first_slot of every document row."""
    mixed, sized = mix(docs)
    row = ["_id", "_row"]
    used = mixed.groupBy(*row).agg(F.sum(F.col("to") - F.col("from")).alias("_taken"), F.min("slot").alias("first_slot"))
    copies = sized.groupBy(*row).agg(F.count(F.lit(1)).alias("_n"))
    return sized.join(used.join(copies, row), row, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce((F.col("_taken") / F.col("_n")).cast("long"), F.lit(0)).alias("taken"), "first_slot",
    )


def op8(docs: DataFrame) -> DataFrame:
    """Digest of :func:`mix`: words taken of every document."""
    return taken(docs).drop("source")
