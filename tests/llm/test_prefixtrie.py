"""Conversation tries against sequences held in a dictionary."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from gaugeframe.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, chars int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items())


def rows_of(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def sample(seed, convs=260, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 900), convs) + [0, 100, 1000000007]:
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["é😀", "hi", "", None, "long " * 5])))
    rows += rows[:10] + [(None, 1, "user", "x"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band", [2, 8])
def test_op12(spark, band):
    rows = sample(band)
    assert rows_of(prefixtrie.op12(frame(spark, rows), band)) == brute(rows)


def test_op12_deep_conversation_over_many_bands(spark):
    rows = [(c, t, "user", f"{t % 7}" if t < 60 or c % 2 else f"{c} {t}") for c in (100, 101, 102, 103, 104) for t in range(90)]
    assert rows_of(prefixtrie.op12(frame(spark, rows), 3)) == brute(rows)


def test_op12_copies_and_turnless(spark):
    # many equal conversations end in one node; short ones without a base lose all turns
    rows = [(c, t, "user", "same") for c in range(400, 700) for t in range(2)] + [(c, 0, "user", "x") for c in range(1701, 1760)]
    got = rows_of(prefixtrie.op12(frame(spark, rows)))
    assert got == brute(rows)


def test_op12_empty(spark):
    assert prefixtrie.op12(frame(spark, [])).collect() == []
    assert prefixtrie.op12(frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_digests_of_pieces_in_order(spark, monkeypatch):
    ids = [5, 100, 20, 3, 1000, -4]
    ends = spark.createDataFrame([(1, 2, i) for i in ids * 1] + [(1, 3, 7)], "k1 long, k2 long, conv_id long")
    monkeypatch.setattr(prefixtrie, "PIECE", 16)
    got = {(r.k1, r.k2): r.ends_sha256 for r in prefixtrie.member_digests(ends).collect()}
    want = {(1, 2): ",".join(map(str, sorted(ids))), (1, 3): "7"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
