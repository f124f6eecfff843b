"""Order MinHash fingerprints against a plain version."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeframe.llm import ordermin
from gaugeframe.llm.common import LAST_ID

M64 = 2**64 - 1


def mix(h):
    for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * f & M64
    return h ^ h >> 33


def plain_signature(text, k=ordermin.K, least=ordermin.TUPLE):
    """One k-mer, one order at a time."""
    if not text:
        return [0] * ordermin.SIZE
    codes = [ord(c) + 1 for c in text] + [0] * max(k - len(text), 0)
    kmers = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * ordermin._BASE + c) & M64
        kmers.append(mix(h))
    seen, numbered = {}, []
    for h in kmers:
        numbered.append(mix((h + seen.get(h, 0) * ordermin._BASE) & M64) >> 32)
        seen[h] = seen.get(h, 0) + 1
    out = []
    for j in range(ordermin.SIZE):
        a, b = (int(x) for x in ordermin._ORDERS[:, j])
        chosen = sorted(sorted(range(len(kmers)), key=lambda i: ((numbered[i] ^ a) * b & 0xFFFFFFFF, i))[:least])
        joined = j + 1
        for h in [kmers[i] for i in chosen] + [0] * (least - len(chosen)):
            joined = mix((joined * ordermin._BASE + h) & M64)
        out.append(joined >> 32)
    return out


@given(st.lists(st.text(alphabet="abé\0😀 ", max_size=60), max_size=5), st.integers(1, 14), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_signatures_equal_the_plain_ones(texts, k, least):
    assert ordermin.signatures(texts, k, least).tolist() == [plain_signature(t, k, least) for t in texts]


def test_signatures_of_long_texts():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdefgh "), 4000)), "ab " * 1500, "x" * 3000]
    assert ordermin.signatures(texts).tolist() == [plain_signature(t) for t in texts]


def test_order_counts():
    """The halves of a text the other way round: nearly the same k-mers, another order."""
    rng = np.random.default_rng(1)
    a, b = ("".join(rng.choice(list("abcdefgh "), 3000)) for _ in range(2))
    whole, turned = ordermin.signatures([a + b, b + a])
    assert 0.3 < float(np.mean(whole == turned)) < 0.7
    near = list(a + b)
    for at in rng.integers(0, len(near), 20):
        near[at] = "#"
    assert float(np.mean(whole == ordermin.signatures(["".join(near)])[0])) > 0.75


def brute_op13(rows):
    distinct = sorted({(LAST_ID if i is None else i, h, t or "") for i, h, t in rows})
    after = dict(zip(distinct, distinct[1:] + distinct[:1]))
    out = []
    for i, h, t in rows:
        t = t or ""
        q, follower = len(t) // 4, after[LAST_ID if i is None else i, h, t][2]
        edited = t[: len(t) - q] + follower[:q]
        marks = [plain_signature(x) for x in (t, edited, follower)]
        like = [1.0 * (t == x) if not (t and x) else sum(a == b for a, b in zip(marks[0], m)) / ordermin.SIZE for x, m in zip((edited, follower), marks[1:])]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(),
                    *("".join(f"{c:08x}" for c in m) if x else "" for x, m in zip((t, edited), marks)), *like))
    return out


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_op13(spark, make_docs, corpus, parts):
    rows = [(i, (t or "")[:3000] if t is not None else None) for i, t in corpus] + [(7, "same text " * 9)] * 25 + [(8, None), (8, ""), (8, "other")]
    docs = make_docs(rows)
    hashed = [tuple(r) for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in ordermin.op13(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert same(got, brute_op13(hashed))


def test_op13_single_and_empty(make_docs):
    one = ordermin.op13(make_docs([(1, "only one text here")])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(1, 18, 1.0)]
    assert ordermin.op13(make_docs([])).collect() == []


def test_fingerprints_keep_columns_and_likeness(make_docs):
    docs = make_docs([(1, "some words in a row"), (2, None), (3, "some words in a row"), (4, ""), (5, "else")]).withColumn("fp", F.lit(1))
    marked = ordermin.fingerprints(docs, "mark")
    assert marked.columns == [*docs.columns, "mark"]
    a, b = marked.select("doc_id", "mark").toDF("i", "x"), marked.select("doc_id", "mark").toDF("j", "y")
    near = {(r.i, r.j): r.near for r in a.crossJoin(b).select("i", "j", ordermin.likeness(F.col("x"), F.col("y")).alias("near")).collect()}
    assert near[1, 3] == 1.0 and near[2, 4] == 1.0 and near[1, 2] == 0.0 and near[1, 5] == 0.0
