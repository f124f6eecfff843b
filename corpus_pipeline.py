"""Corpus pipeline: five stages that turn ``documents`` into a training mix.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame; all but the last return the columns of
``documents``.  :func:`run` stores each stage's result in the shared folder before the next reads it.

1. toxicity: documents that the model rejects go (trained on the labelled rows of this stage's input that are not held out);
2. line dedup: common blocks are cut out of the later document; a document that loses all its lines goes;
3. n-gram Jaccard join: one document of each near-duplicate class stays;
4. benchmark decontamination: contaminated documents go;
5. mixing: documents with the words that the mix takes of them; a document of which it takes none goes.

Defined results, in every stage.  A null text is empty: it is never toxic, holds no line, is one class with all texts without words, is never
contaminated and is never taken by the mix.  A null ``doc_id`` is an id like any other, sorted last; a null source is a source.  Rows that repeat one another
are decided alike, until the n-gram stage keeps one of them.  An empty table stays empty.  Labels and benchmark may be empty too: then nothing
is toxic or contaminated.  Columns beyond those of ``documents`` pass through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeframe.llm import contamination, jaccard, lines, mixing, toxicity
from gaugeframe.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold of the model, unchanged."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines they repeat from earlier ones; ``n_chars`` follows a cut text, and documents that lose all lines go."""
    cut, total, removed = lines.dedup_lines(docs)
    left = cut.where((F.col(removed) == 0) | (F.col(removed) < F.col(total)))
    # n_chars describes the text, so it follows the cut
    chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class, unchanged."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold less of the benchmark than the contamination rule allows, unchanged."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and first_slot of the documents in the mix."""
    return mixing.taken(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: Learned scores, alignments and minimum hashes have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
