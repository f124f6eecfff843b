"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence with telling words has a linear score over hashed words and word beginnings, p = sigmoid(z); one
without any has p = 0.  The document's score is the noisy-or 1 - prod(1 - p) over its decisive sentences, so only document labels are needed and the
sentences with a high p are the offending ones.  Decisive are all sentences at ``THRESHOLD`` or above, and the strongest one: weak hints, of which
clean text has some in every megabyte, do not add up, so texts that each stay below the threshold stay below it when joined, however long that is.
The weights are fitted to this very score: the set of decisive sentences is taken anew in every step of the descent.

Training takes at most ``PER_CLASS`` labelled documents per class, those with the smallest hash of the id among training rows, with their whole
texts (a documented bound of the sample; class weights restore the label frequencies of all training rows).  Spark counts
which words go with the label (a likelihood ratio screens them); the driver fits the weights of the words that pass with full-batch Adam.  Scoring is one pass without a shuffle over every whole text.

Inputs of a score are the text's words only.  Defined results.  A text without words (null, empty) scores 0.  Label rows with a null id or
label are ignored; several labels of a document count as toxic if one does.  Without a training document of each class the score is 0.
A null ``doc_id`` is never held out.  Repeated rows get equal results; an empty table gives an empty result.  Extra columns are ignored by
the score and kept by :func:`keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeframe.llm.common import FOLDED, Words, column, mix, slices, smallest_hashes, span_sums, stored

PER_CLASS = 3000
SPACE = 1 << 19
PREFIXES = (4, 5)
SIGNIFICANT = 12.0
THRESHOLD, SENTENCE = 0.3, 0.5
_LOGIT = np.log(THRESHOLD / (1 - THRESHOLD))
_ENDS = np.isin(np.arange(256), list(b".!?\n"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray  # float32, one per hashed feature
    bias: float


class Sentences:
    """Sentences of several documents with the hashed features of their words."""

    def __init__(self, texts: pa.Array):
        w = self.words = Words(texts, FOLDED)
        n = len(w)
        ends = np.concatenate([[0], np.cumsum(_ENDS[w.raw])])
        new = np.ones(n, dtype=bool)
        new[1:] = (ends[w.start[1:]] > ends[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
        self.begin = np.flatnonzero(new)  # first word of each sentence
        self.doc = w.doc[self.begin]
        codes = np.random.default_rng(11).integers(0, 2**64, 257, dtype=np.uint64)
        values = codes[w.values]
        parts = [span_sums(values, w.start, w.end, 0x9E3779B97F4A7C15 | 1)]
        parts += [span_sums(values, w.start, np.minimum(w.start + k, w.end), 0x9E3779B97F4A7C15 | 1) + np.uint64(k) for k in PREFIXES]
        self.features = np.stack([(mix(p) % np.uint64(SPACE)).astype(np.int32) for p in parts], axis=1)

    def scores(self, model: Model) -> np.ndarray:
        """Logit of each sentence; -inf without a telling word."""
        if not len(self.begin):
            return np.zeros(0)
        each = model.weights[self.features]
        tells = np.logical_or.reduceat((each != 0).any(axis=1), self.begin)
        return np.where(tells, np.add.reduceat(each.sum(axis=1, dtype=np.float64), self.begin) + model.bias, -np.inf)


def decisive(logits: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """The sentences that make the score of their document: those at the threshold, and the strongest."""
    strongest = np.full(count, -np.inf)
    np.maximum.at(strongest, doc, logits)
    return (logits >= _LOGIT) | ((logits == strongest[doc]) & ~np.isneginf(logits))


def noisy_or(logits: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) per document."""
    return -np.expm1(-np.bincount(doc, weights=np.logaddexp(0, logits), minlength=count))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """Training texts (doc_id, text, toxic) and the number of training labels per class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(3))
    # at most per_class ids of each class: a proven bound for the broadcast
    some = [smallest_hashes(known.where(F.col("toxic") == c), order, per_class, n).orderBy(order, "doc_id").limit(per_class) for c, n in sorted(counts.items())]
    ids = reduce(DataFrame.unionByName, some) if some else known
    texts = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), counts


def telling(texts: DataFrame, least: float = SIGNIFICANT) -> np.ndarray:
    """Sorted features whose presence goes with the toxic label: a log-likelihood ratio of ``least`` or more, in the toxic direction.

    Counted by Spark; only the features that pass reach the driver, and there are at most ``SPACE``.
    """
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                s = Sentences(column(rows, "text"))
                doc = np.repeat(s.words.doc, s.features.shape[1]).astype(np.int64)
                pairs = np.unique(doc * SPACE + s.features.ravel())
                toxic = column(rows, "toxic").to_numpy()[pairs // SPACE]
                yield pa.record_batch({"feature": pa.array(pairs % SPACE, pa.int32()), "toxic": pa.array(toxic, pa.int32())})

    kinds = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return np.zeros(0, dtype=np.int32)
    na, nb = float(kinds[1]), float(kinds[0])
    a, b = F.col("a"), F.col("n") - F.col("a")
    share = F.col("n") / (na + nb)

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / expected)).otherwise(0.0)

    ratio = 2 * (term(a, share * na) + term(b, share * nb) + term(na - a, (1 - share) * na) + term(nb - b, (1 - share) * nb))
    counted = texts.mapInArrow(present, "feature int, toxic int").groupBy("feature").agg(
        F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    found = counted.where((a / na > b / nb) & (ratio >= least)).select("feature").toArrow()
    return np.sort(found["feature"].to_numpy())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, steps: int = 120, rate: float = 0.1, decay: float = 3e-5) -> Model:
    """Train on document labels."""
    texts, counts = sample(docs, labels, per_class)
    texts = stored(texts)
    kept = telling(texts)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                s = Sentences(column(rows, "text"))
                number = np.minimum(np.searchsorted(kept, s.features), max(len(kept) - 1, 0))
                use = kept[number] == s.features if len(kept) else np.zeros(s.features.shape, dtype=bool)
                sentence = np.cumsum(np.bincount(s.begin, minlength=len(s.words))) - 1
                where = np.searchsorted(s.doc, np.arange(rows.num_rows + 1))
                first, numbers, own = s.words.first, [], []
                for d in range(rows.num_rows):
                    part = slice(first[d], first[d + 1])
                    numbers.append(number[part][use[part]].astype(np.int32).tobytes())
                    own.append((np.broadcast_to(sentence[part, None], use[part].shape)[use[part]] - where[d]).astype(np.int32).tobytes())
                yield pa.record_batch({
                    "doc_id": column(rows, "doc_id"), "toxic": column(rows, "toxic"), "sentences": pa.array(np.diff(where), pa.int32()),
                    "features": pa.array(numbers, pa.binary()), "sentence": pa.array(own, pa.binary()),
                })

    got = texts.mapInArrow(bags, "doc_id long, toxic int, sentences int, features binary, sentence binary").toArrow().sort_by("doc_id")
    if not len(kept):
        return Model(np.zeros(SPACE, dtype=np.float32), -np.inf)
    label, sentences = got["toxic"].to_numpy(), got["sentences"].to_numpy()
    features = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in got["features"].to_pylist()])
    begin = np.concatenate([[0], np.cumsum(sentences)])
    row = np.concatenate([np.frombuffer(x, dtype=np.int32) + f for x, f in zip(got["sentence"].to_pylist(), begin)]).astype(np.int64)
    weight = np.array([counts[int(x)] / (label == x).sum() for x in label])
    # only sentences with telling words are part of the model
    tells, row = np.unique(row, return_inverse=True)
    w, bias = _descend(features, row, np.repeat(np.arange(len(label)), sentences)[tells], label, weight / weight.sum(), len(kept), steps, rate, decay)
    weights = np.zeros(SPACE, dtype=np.float32)
    weights[kept] = w
    return Model(weights, bias)


def _descend(feature: np.ndarray, row: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray, size: int, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the weighted negative log likelihood of the noisy-or.

    ``feature`` and ``row`` list which of ``size`` features stands in which sentence, ``doc`` names each sentence's document.
    """
    w = np.zeros(size)
    bias = float(np.log(max(weight[label == 1].sum(), 1e-6) / max(np.median(np.bincount(doc, minlength=len(label))), 1)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, weights=w[feature], minlength=len(doc))
        counts = decisive(z, doc, len(label))
        total = np.maximum(np.bincount(doc, weights=np.where(counts, np.logaddexp(0, z), 0), minlength=len(label)), 1e-9)
        slope = weight * np.where(label == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0)
        dz = counts * slope[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(feature, weights=dz[row], minlength=size) + decay * w, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


_SCORED = "doc_id long, score double, offending array<struct<start: int, end: int, p: double>>"


def score_batch(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text, and the offending sentences (code points, end exclusive) of those at the threshold."""
    s = Sentences(texts)
    z = s.scores(model)
    p = np.where(np.isneginf(z), 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
    score = np.clip(noisy_or(np.where(decisive(z, s.doc, len(texts)), z, -np.inf), s.doc, len(texts)), 0, 1)
    where: list[list[dict]] = [[] for _ in range(len(texts))]
    hot = np.flatnonzero((p >= SENTENCE) & (score[s.doc] >= THRESHOLD))
    if len(hot):
        w = s.words
        points = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
        last = np.append(s.begin[1:], len(w)) - 1
        for i in hot:
            d = s.doc[i]
            base = points[w.offsets[d]]
            where[d].append({"start": int(points[w.start[s.begin[i]]] - base), "end": int(points[w.end[last[i]]] - base), "p": float(p[i])})
    return score, where


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and offending sentences of every row."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                score, where = score_batch(column(rows, "text"), model)
                yield pa.record_batch({"doc_id": column(rows, "doc_id").cast(pa.int64()), "score": pa.array(score, pa.float64()), "offending": pa.array(where, kind)})

    return docs.select("doc_id", "text").mapInArrow(run, _SCORED)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below the threshold, with all their columns."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.concatenate([score_batch(column(rows, "text"), model)[0] < threshold for rows in slices(batch.select([at]))]) if batch.num_rows else np.zeros(0, dtype=bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model trained on the rows that are not held out."""
    scored = score_documents(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("offending"),
    )
