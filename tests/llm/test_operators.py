"""Each training-data operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard as zstd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeframe.llm import chat, components, contamination, gif, jaccard, lines, mixing, privacy, substrings, toxicity, warc
from gaugeframe.llm.common import FOLDED, LAST_ID, PLAIN, Words

PLAIN_WORD, FOLDED_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(i):
    return LAST_ID if i is None else i


def plain(text):
    return re.findall(PLAIN_WORD, text or "")


def folded(text):
    return re.findall(FOLDED_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# --- words


@given(st.lists(st.text(alphabet=" \t\n\x0b\x1f\x85Aa9.é€😀-", max_size=30) | st.none(), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    for classes, find in ((PLAIN, plain), (FOLDED, folded)):
        w = Words(pa.array(texts, pa.string()), classes)
        got = [bytes((w.values[a:b] - 1).astype(np.uint8)).decode() for a, b in zip(w.start, w.end)]
        assert got == [x for t in texts for x in find(t)]
        assert w.counts.tolist() == [len(find(t)) for t in texts]
        assert len(set(zip(got, w.hashes().tolist()))) == len(set(got)) == len(set(w.hashes().tolist()))


# --- 1 media


def test_gif_digest(make_docs, corpus):
    def want(i, t):
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        return (i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))

    got = gif.op1(make_docs(corpus))
    assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == Counter(want(*r) for r in corpus)
    per_text = {}
    for r in got.collect():
        per_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in per_text.values())


@given(st.binary(max_size=400) | st.integers(0, 3).flatmap(lambda k: st.lists(st.integers(0, k), max_size=3000).map(bytes)))
@settings(max_examples=150, deadline=None)
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_long_streams_restart_the_dictionary():
    rng = random.Random(1)
    for n in (4000, 60000):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


def test_lzw_full_dictionary_without_clear_code():
    # deferred clear: the dictionary is full and the codes go on at 12 bits
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(9000))
    table, codes, size, prefix = {bytes([i]): i for i in range(256)}, [256], 258, b""
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        codes.append(table[prefix])
        if size < 4096:
            table[prefix + bytes([b])] = size
            size += 1
        prefix = bytes([b])
    codes += [table[prefix], 257]
    bits, at, entries, width = 0, 0, 258, 9
    first = True
    for c in codes:
        bits |= c << at
        at += width
        if c != 256:
            if not first and entries < 4096:
                entries += 1
            first = False
            width = min(12, max(9, (entries).bit_length()))
    assert gif.lzw_decode(bits.to_bytes((at + 7) // 8, "little"), 8, len(data)) == data


def _gif(width, height, palette, frames):
    bits = max(1, (len(palette) - 1).bit_length())
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | (bits - 1), 0, 0) + bytes(sum(palette, ())) + b"\0" * 3 * ((1 << bits) - len(palette))
    for left, top, rows, delay, disposal, clear, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        h, w = len(rows), len(rows[0])
        order = [i for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for i in range(s, h, d)] if interlaced else range(h)
        data = gif.lzw_encode(bytes(x for i in order for x in rows[i]), max(2, bits))
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + bytes([max(2, bits)])
        out += b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"
    return out + b"\x3b"


def test_gif_palette_transparency_disposal_interlace():
    palette = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    data = _gif(3, 2, palette, [
        (0, 0, [[1, 1, 1], [1, 1, 1]], 5, 1, None, False),
        (0, 0, [[0, 2, 0]], 7, 2, 0, False),  # transparent ends; its rectangle is cleared afterwards
        (1, 1, [[3]], 9, 3, None, False),  # undone afterwards
        (0, 1, [[2]], 1, 1, None, False),
    ])
    a, b, c, d = gif.decode_gif(data)
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert a.canvas.tolist() == [[red] * 3] * 2 and a.delay_ms == 50
    assert b.canvas.tolist() == [[red, green, red], [red] * 3]
    assert c.canvas.tolist() == [[none] * 3, [red, blue, red]]
    assert d.canvas.tolist() == [[none] * 3, [green, red, red]]
    assert gif.histogram(d.canvas) == [1, 0, 0, 0, 0, 0, 0, 2, 2, 0, 0, 0, 0, 0, 0, 1, 3, 0, 0, 0, 0, 0, 0, 0, 3]
    rows = [[(x + y) % 4 for x in range(5)] for y in range(21)]
    assert next(gif.decode_gif(_gif(5, 21, palette, [(0, 0, rows, 0, 0, None, True)]))).samples.tolist() == rows


def test_gif_frame_table_reports_broken_media(spark):
    good = gif.encode_gif([(np.arange(128, dtype=np.uint8).reshape(2, 64), 3)] * 2, np.repeat(np.arange(256), 3).reshape(256, 3), (64, 2))
    rows = [(1, good), (2, good[: len(good) // 2]), (3, b"no gif"), (4, None), (5, b""), (6, good[:-200] + b"\xff" * 40)]
    got = gif.frame_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [(r.frame, r.delay_ms, bytes(r.samples)) for r in got if r.doc_id == 1] == [(0, 30, bytes(range(128))), (1, 30, bytes(range(128)))]
    assert {r.doc_id for r in got if r.error} == {2, 3, 6} and not any(r.doc_id in (4, 5) for r in got)


# --- 2 chat


@given(st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "\\", "<", "|", "a", "<<SYS>>", "<|", "\n", "é"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_chat_escape(text):
    t = chat.Template()
    escaped = t.escaped(text)
    assert t.unescaped(escaped) == text and not any(c in escaped for c in t.controls)


def test_chat_digest_and_order(spark):
    rows = [(1, 0, "system", "be nice"), (1, 2, "assistant", "a<|im_end|>"), (1, 1, "user", None), (2, 0, "assistant", "first"), (2, 1, "user", "late"),
            (3, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, None, "x"), (None, None, "user", "n"), (None, 1, "assistant", "\\")]
    got = {r.conv_id: r for r in chat.op2(spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, part int")).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    text = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n") and got[-7].loss_sha256 == sha(text) and got[-7].error is None
    assert got[1].turns_sha256 == sha("system\nbe nice\nuser\n\nassistant\na<|im_end|>\n") and got[1].loss_chars == 11 and got[1].error is None
    assert got[2].error.startswith("turn 0") and got[3].n_turns == 3 and got[3].error.startswith("turn 1")
    assert got[None].n_turns == 2 and got[None].loss_sha256 == sha("\\")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(empty)).count() == 0


def test_chat_segments_join_to_the_text(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert "".join(r.segment for r in got) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert [r.segment for r in got if r.loss] == ["yo"]


# --- 3 substrings


def brute_repeats(rows, window=13):
    first = {}
    for i, t in rows:
        w = plain(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, LAST_ID), key(i))
    out = Counter()
    for i, t in rows:
        w = plain(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        out[(i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))] += 1
    return out


def test_substrings(make_docs, corpus):
    assert rows_of(substrings.op3(make_docs(corpus)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(corpus)


def test_substrings_over_many_chunks_and_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_TEXT", 1500)
    monkeypatch.setattr(substrings, "BUCKET_TEXT", 700)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(80)]  # tiny alphabet: ties everywhere
    assert rows_of(substrings.op3(make_docs(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)


def test_substrings_send_a_frequent_passage_once():
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(20)) + f" {passage} " + " ".join(f"w{rng.randrange(9000)}" for _ in range(20))) for i in range(400)]
    chunk = substrings._Chunk(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), 13)
    sent, group = chunk.spokesmen()
    assert np.bincount(group).max() == 400 and np.bincount(group[sent]).max() <= 2
    # the smallest aligned owner and the largest owner of every hash are among them
    aligned, owner = chunk.aligned(), chunk.ids[chunk.words.doc[chunk.at]]
    for g in range(0, group.max() + 1, 97):
        own = np.flatnonzero(group == g)
        kept = np.intersect1d(own, sent)
        assert owner[kept].max() == owner[own].max()
        if aligned[own].any():
            assert owner[kept[aligned[kept]]].min() == owner[own[aligned[own]]].min()


def test_substrings_empty(make_docs):
    assert substrings.op3(make_docs([])).count() == 0


# --- 4 decontamination


def brute_flags(rows, items, window=13):
    windows = {}
    for item, t in items:
        w = folded(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([] if item is None else [str(item)])
    out = Counter()
    for i, t in rows:
        w = folded(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
                    found |= windows[tuple(w[k : k + n])]
        s = sum(hit)
        out[(i, len(w), s, len(found), sha(",".join(sorted(found))), s > 0 and 20 * s >= len(w))] += 1
    return out


@pytest.mark.parametrize("block", [8 << 20, 400])
def test_contamination(spark, make_docs, corpus, monkeypatch, block):
    texts = dict(corpus)
    long = folded(texts[30])
    items = [(1, " ".join(long[35:70])), (1, " ".join(long[35:70])), (2, texts[4]), (10, "ONE, two"), (3, None), (4, ""), (None, " ".join(folded(texts[40])[:14])),
             (5, "nothing of this kind"), (6, " ".join(folded(texts[60])[100:160])), (7, "z"), (8, " ".join(long[38:52]) + " other")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(contamination, "SHARD_BYTES", 3000)
    flags = contamination.flag_documents(make_docs(corpus), benchmark, block_bytes=block)
    got = flags.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("s"), "contaminated")
    want = brute_flags(corpus, items)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = contamination.decontaminate(make_docs(corpus), benchmark)
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, *_, bad), n in _spread(want) if not bad})
    assert kept.columns == make_docs([]).columns


def _spread(want):
    total = Counter()
    for row, n in want.items():
        total[(row[0], row[-1])] += n
    return [((i, bad), n) for (i, bad), n in total.items()]


def test_contamination_empty_sides(spark, make_docs, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.op4(make_docs([]), none).count() == 0
    got = contamination.op4(make_docs(corpus), none).collect()
    assert len(got) == len(corpus) and not any(r.n_hit or r.contaminated for r in got)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0)
        sa, _ = contamination.suffix_array(text, 64)

        def suffix(i):
            end = i + int(np.argmax(text[i:] == 0))
            return text[i:end].tolist()

        got = [suffix(i) for i in sa]
        assert got == sorted(got)


def test_longest_match(spark, make_docs):
    words = [f"q{i}" for i in range(40)]
    docs = make_docs([(1, " ".join(words[5:30])), (2, " ".join(words)), (3, "q1")])
    got = {r.doc_id: r.longest for r in contamination.op4(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert got == {1: 25, 2: 40, 3: 0}


# --- 5 near duplicates


def brute_classes(rows, n=5):
    sets = []
    for _, t in rows:
        w = plain(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    texts = sorted(set(sets), key=lambda s: sorted(map(str, s)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(texts)):
        for b in range(a):
            both = len(texts[a] & texts[b])
            if texts[a] and texts[b] and 5 * both >= 4 * (len(texts[a]) + len(texts[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    number = {s: k for k, s in enumerate(texts)}
    ids = {}
    for (i, _), s in zip(rows, sets):
        for name in (("t", number[s]), ("c", find(number[s]))):
            if i is not None:
                ids[name] = min(ids.get(name, LAST_ID), i)
    return Counter((i, ids.get(("c", find(number[s]))), ids.get(("t", number[s])), links[number[s]]) for (i, _), s in zip(rows, sets))


def test_jaccard(make_docs, corpus):
    docs = make_docs(corpus)
    want = brute_classes(corpus)
    assert rows_of(jaccard.op5(docs), "doc_id", "class_id", "text_id", "n_links") == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(map(key, got)) == sorted({c for _, c, _, _ in want})


def test_jaccard_large_group_in_blocks(make_docs, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"c{i}"
        rows.append((i, " ".join(w)))
    docs = make_docs(rows)
    monkeypatch.setattr(jaccard.verified, "__defaults__", (5, 2000))
    monkeypatch.setattr(jaccard.near_pairs, "__defaults__", (16,))
    assert rows_of(jaccard.op5(docs), "doc_id", "class_id", "text_id", "n_links") == brute_classes(rows)


def test_band_choice_reaches_recall():
    bands, rows = jaccard.bands_for(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL and bands * rows <= jaccard.MAX_HASHES


def test_jaccard_chain_of_weak_pairs_stays_apart(make_docs):
    """Each text shares half of its n-grams with the next: bands collide along the chain, but no group grows out of that."""
    rng = random.Random(12)
    words = [f"v{i}" for i in range(60 * 202)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[60 * i : 60 * i + 180])) for i in range(200)]
    bands, per_band = jaccard.bands_for(0.8)
    signed = jaccard.signatures(make_docs(rows), bands, per_band)
    nodes = signed.select(F.col("f1").alias("node"), "bands", "sketch")
    shared = nodes.select("node", F.explode("bands").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    assert shared > 50
    assert jaccard.candidates(nodes).count() < 20
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in jaccard.op5(make_docs(rows)).collect())


def test_jaccard_recall_of_random_edits(make_docs):
    """Links found among texts at about the threshold, against all pairs."""
    rng = random.Random(21)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(150)]
        for k in range(5):
            w = list(base)
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = f"x{g}{k}{rng.random()}"
            rows.append((g * 10 + k, " ".join(w)))
    want = Counter({r[0]: r[3] for r in brute_classes(rows)})
    got = {r.doc_id: r.n_links for r in jaccard.op5(make_docs(rows)).collect()}
    assert sum(want.values()) > 200 and sum(got.values()) >= 0.995 * sum(want.values()) and all(got[i] <= want[i] for i in got)


def test_jaccard_empty(make_docs):
    assert jaccard.op5(make_docs([])).count() == 0
    assert jaccard.keep_one(make_docs([])).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + k) for k in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got[x] == label[x] for e in edges if e[0] != e[1] for x in e)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 6 privacy


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_base(text):
    found = [(m.start(), r, k, m.end()) for r, (k, p) in enumerate(PERSONAL.items()) for m in re.finditer(p, text or "") if _passes(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_privacy_base(make_docs, corpus):
    rng = random.Random(8)
    pieces = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "10.0.0.1", "0.0.0.0", "00.000.0256.7", "300.1.1.1", "0255.001.1.9", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+", "-", " ", "é😀",
              "7", "12", "a@b.c+d@e.f", "a@b.c-d@e.f", "_q%@w-w.x.", "5500000000000004", "\n", "+44 20 7946 0958."]
    rows = corpus + [(1000 + k, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))) for k in range(300)]
    rows += [(2000, "9" * 20000), (2001, "a" * 20000), (2002, "1 2 " * 6000), (2003, "+" * 5000), (2004, "mail me: a@b.co " * 400)]
    got = privacy.op6(make_docs(rows))
    want = Counter()
    for i, t in rows:
        base = brute_base(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want[(i, *[sum(s[0] == k for s in base) for k in PERSONAL], sha(text))] += 1
    assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_privacy_disclosing_terms(make_docs):
    rng = random.Random(6)
    filler = [f"{a}{b}{c}" for a in ("lorem", "dolor", "amet") for b in ("ian", "ous", "ing") for c in "abcdefgh"]

    def noise():
        return " ".join(rng.choice(filler) for _ in range(12))

    rows = [(i, f"{noise()} Zaphodia writes from zap@h2g2.org {noise()}") for i in range(5)]
    rows += [(10 + i, f"{noise()} {noise()}") for i in range(200)]
    rows += [(500, "zap@h2g2.org again, said Zaphodia."), (501, "Zaphodes in Zaphodtown")]
    docs = make_docs(rows)
    spans = {r.doc_id: r.spans for r in privacy.op6(docs).collect()}
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    for i in range(5):
        text = rows[i][1]
        at = text.index("Zaphodia")
        assert f":{at}:{at + 8}" in spans[i] and "zaph" not in clean[i].lower().replace("zaph*", "") and "@" not in clean[i] and "[EMAIL]" in clean[i]
    assert "@" not in clean[500] and "Zaphodia" not in clean[500]
    assert clean[501] == "Zaphodes in Zaphodtown" and all(clean[10 + i] == rows[5 + i][1] for i in range(200))


def test_privacy_term_far_from_the_mention(make_docs):
    far = "common words in between " * 40
    rows = [(i, f"letter {'abcdef'[i] * 5} from zap@h2g2.org {far} signed by Zaphodia and Kai") for i in range(5)]
    rows += [(10 + i, f"letter {far} signed by someone and no more from here") for i in range(100)]
    # one document proves nothing, however often it mentions the entity, nor do passages copied into others
    rows += [(200, " ".join(f"{w * 5} to one@alone.org about {w * 4}" for w in "abcdef") + f" {far} Solitude")]
    rows += [(300 + i, f"{'ghijk'[i] * 5} {far} as sent to me@copy.org {far} Marmalade") for i in range(5)]
    docs = make_docs(rows)
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert all("Zaph" not in clean[i].replace("Zaph*", "") and "Kai" not in clean[i] and far in clean[i] and "signed by" in clean[i] for i in range(5))
    assert "Solitude" in clean[200] and all("Marmalade" in clean[300 + i] for i in range(5))
    assert all(clean[10 + i] == rows[5 + i][1] for i in range(100))


def test_privacy_document_of_many_entities_and_terms(spark, make_docs):
    """1 000 entities and 50 000 terms in one document: the entities share their documents, so they meet the terms as one group."""
    people = " ".join(f"u{k}@list.org" for k in range(1000))
    many = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}term" for k in range(50_000))
    rows = [(i, f"{'vwxyz'[i] * 6} {people} Zaphodia {'vwxyz'[i] * 7}") for i in range(4)] + [(4, f"{people} {many} Zaphodia")]
    rows += [(10 + i, f"plain words of document {chr(97 + i % 26) * 4} {chr(97 + i // 26) * 5}") for i in range(300)]
    docs = make_docs(rows)
    found = privacy.mentions(docs)
    told = privacy.disclosing(docs, found)
    owners, groups = privacy._owners(found.select("_id", "_tk", "kind", "value", F.xxhash64("before", "after").alias("context"), F.lit(5).alias("e_docs")))
    assert groups.select("g1", "g2").distinct().count() <= 4 and owners.count() <= 4 * 5
    assert told.where("_id = 4").count() >= 1 and told.where("_id = 4").count() < 10
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).where("doc_id < 5").collect()}
    assert all("Zaphodia" not in t and "@" not in t for t in clean.values()) and "aaabterm" not in people and clean[4].count("term") == 50_000


def test_privacy_copies_prove_nothing(make_docs):
    text = "the quick Marmalade sends to someone@example.org every evening"
    docs = make_docs([(i, text) for i in range(6)] + [(50 + i, f"other words number {i}") for i in range(20)])
    assert {r.spans for r in privacy.op6(docs).collect() if r.doc_id < 6} == {"email:29:48"}


def test_privacy_empty(make_docs):
    assert privacy.op6(make_docs([])).count() == 0


# --- 7 lines


def brute_lines(rows, min_words=lines.MIN_WORDS):
    docs = {}
    for i, t in rows:
        if t is not None:
            docs[(key(i), t)] = [(p, x.strip(" \t\r\x0b\f")) for p, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\f")]
    out = Counter()
    for i, t in rows:
        seq = docs.get((key(i), t), [])
        gone = set()
        for other, theirs in docs.items():
            if other[0] < key(i):
                own = [x for _, x in seq]
                gone |= {seq[j][0] for j in lines.common_blocks([x for _, x in theirs], own, [len(plain(x)) for x in own], min_words)}
        kept = t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        out[(i, len(seq), len(gone), sha(kept or ""))] += 1
    return out


def test_lines(make_docs, corpus):
    assert rows_of(lines.op7(make_docs(corpus)), "doc_id", "n_lines", "n_removed", "kept_sha256") == brute_lines(corpus)


@pytest.mark.parametrize("rare", [0, 64])
def test_lines_common_short_lines_still_form_blocks(make_docs, rare):
    short = [f"short line {k}" for k in range(4)]
    rows = [(i, "\n".join([f"own beginning of {i}", *short, f"own end {i}"])) for i in range(30)] + [(99, "short line 1\nalone")]
    cut, _, removed = lines.dedup_lines(make_docs(rows), rare=rare)
    got = {r.doc_id: (r[removed], r.text) for r in cut.collect()}
    assert got[0] == (0, rows[0][1]) and got[99] == (0, rows[-1][1])
    assert all(got[i] == (4, f"own beginning of {i}\nown end {i}") for i in range(1, 30))


@pytest.mark.parametrize("rare", [0, 64])
def test_lines_block_whose_lines_stood_alone_before(make_docs, rare):
    short = [f"part {k} of four" for k in range(4)]
    rows = [(k, f"first holder {k}\n{x}\nend of {k}") for k, x in enumerate(short)]
    rows += [(10 + k, "\n".join([f"beginning {k}", *short, f"end number {k}"])) for k in range(2)] + [(20, rows[0][1] + "\nmore")]
    cut, _, removed = lines.dedup_lines(make_docs(rows), rare=rare)
    got = {r.doc_id: (r[removed], r.text) for r in cut.collect()}
    assert all(got[i] == (0, t) for i, t in rows[:5]) and got[11] == (4, "beginning 1\nend number 1") and got[20] == (3, "more")


def test_lines_random_short_lines(make_docs):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join([f"l{rng.randrange(7)}"] * rng.randrange(1, 5)) for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    assert rows_of(lines.op7(make_docs(rows)), "doc_id", "n_lines", "n_removed", "kept_sha256") == brute_lines(rows)


def test_lines_keep_extra_columns_and_null_text(make_docs):
    docs = make_docs([(1, None), (2, "x")])
    cut, total, removed = lines.dedup_lines(docs)
    assert cut.columns == [*docs.columns, total, removed]
    assert {(r.doc_id, r.text, r._gf_id) for r in cut.collect()} == {(1, None, "y"), (2, "x", "y")}
    assert lines.op7(make_docs([])).count() == 0


@given(st.lists(st.integers(0, 6), max_size=15), st.lists(st.integers(0, 6), max_size=15))
@settings(max_examples=300, deadline=None)
def test_patience_is_an_alignment(a, b):
    pairs = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def test_common_blocks_repeated_and_swapped():
    words = {1: 12, 2: 2, 3: 2, 4: 12, 8: 1, 9: 1}

    def cut(a, b):
        return lines.common_blocks(a, b, [words.get(x, 1) for x in b], 10)

    assert cut([1, 2, 3], [2, 3, 1]) == [2]
    assert cut([8, 1, 9], [7, 1, 6, 1, 5]) == [1, 3]
    assert cut([8, 1, 9, 1], [7, 1, 6]) == [1]
    assert cut([1, 7, 4], [4, 6, 1]) == [0, 2]


@given(st.lists(st.integers(0, 5), max_size=15), st.lists(st.integers(0, 5), max_size=15), st.integers(1, 8))
@settings(max_examples=300, deadline=None)
def test_common_blocks_are_all_common_runs(a, b, least):
    words = [1 + x % 4 for x in b]
    want = {j for i in range(len(b)) for k in range(i + 1, len(b) + 1) for j in range(i, k)
            if sum(words[i:k]) >= least and any(a[x : x + k - i] == b[i:k] for x in range(len(a)))}
    assert lines.common_blocks(a, b, words, least) == sorted(want)


def test_lines_moved_and_repeated_passages(make_docs):
    long = " ".join(f"p{k}" for k in range(15))
    rows = [(1, f"{long}\nshort one\nshort two"), (2, f"short one\nshort two\n{long}"), (3, f"x\n{long}\ny\n{long}\nz")]
    cut, _, _ = lines.dedup_lines(make_docs(rows))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: rows[0][1], 2: "short one\nshort two", 3: "x\ny\nz"}


def test_patience_keeps_unique_anchors():
    assert lines.patience([1, 9, 2, 3, 9, 4], [1, 2, 9, 3, 4]) == [(0, 0), (2, 1), (3, 3), (5, 4)]


# --- 8 mixing


def shared_out(sizes, weights, total, cap=2):
    """Targets by sharing the excess again until none is above its cap."""
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: float(cap * sizes[i]) for i in over}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000], [0, 0], [], [0, 5, 0, 7], [1, 2, 4, 8, 16, 32, 64, 128, 256, 512]])
def test_source_table(spark, sizes):
    rows = [(f"s{i:02}", 3, n // 2) for i, n in enumerate(sizes)] + [(f"s{i:02}", 1, n - n // 2) for i, n in enumerate(sizes)]
    got = mixing.source_table(spark.createDataFrame(rows, "source string, x int, size long")).orderBy("src").collect()
    goal = shared_out(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
    assert [r.src for r in got] == list(range(len(sizes))) and [r.source_size for r in got] == sizes
    assert [r.target for r in got] == [pytest.approx(g) for g in goal]
    assert [r.upto for r in got] == np.cumsum([r.take for r in got]).tolist()


def test_very_many_sources(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("w x y").alias("text"), F.concat(F.lit("host"), F.col("id") % 30_000).alias("source"))
    got = mixing.taken(docs).agg(F.sum("taken").alias("t"), F.countDistinct("source").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).first()
    # every source has 6 words: targets are 3 times the weights 3, 1, 2 of the level 4.5, whole words a source
    assert (got.n, got.over) == (30_000, 0) and abs(got.t - 1.5 * 180_000) <= 30_000


def test_mix(make_docs, corpus):
    docs = make_docs(corpus, source=lambda k: [None, "b", "a", "é", "B"][k % 5])
    got = mixing.op8(docs).collect()
    again = mixing.op8(make_docs(corpus, source=lambda k: [None, "b", "a", "é", "B"][k % 5]).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes = Counter()
    for k, (_, t) in enumerate(corpus):
        sizes[[None, "b", "a", "é", "B"][k % 5]] += len(plain(t))
    names = ["B", "a", "b", "é", None]
    goal = dict(zip(names, shared_out([sizes[s] for s in names], [3, 1, 2, 3, 1], 1.5 * sum(sizes.values()))))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(plain(t))) for i, t in corpus)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in names:
        rows = [r for r in got if r.source_size == sizes[s] and r.target == pytest.approx(goal[s])]
        assert abs(sum(r.taken for r in rows) - goal[s]) <= 2


def test_schedule_is_even(spark, make_docs):
    rows = [(i, "w " * 640) for i in range(30)]
    docs = make_docs(rows, source=lambda k: "abc"[k % 3])
    _, sources = mixing.plan(docs)
    slots = mixing.schedule(sources).orderBy("slot").collect()
    rows = sources.orderBy("src").collect()
    share = [r.take / rows[-1].upto for r in rows]
    for n in range(10, len(slots), 37):  # every beginning of the schedule is close to the shares
        have = Counter(r.src for r in slots[:n])
        assert all(abs(have[i] - n * s) <= 4 for i, s in enumerate(share))
    assert len({(r.src, r["rank"]) for r in slots}) == len(slots)


def test_mix_empty(make_docs):
    assert mixing.op8(make_docs([])).count() == 0
    assert mixing.op8(make_docs([(1, None), (2, "")])).count() == 2


# --- 9 WARC


def test_warc_round_trip(spark):
    long, other = "x" * 150 + "é", "y" * 99
    rows = [(5, "http://a/%0A\r\nb", long), (3, "u", long), (9, None, long), (1, "u", other), (2, "u", other), (4, "u", None), (6, "u", ""), (3, "u", long), (None, "u", long), (7, "u", "z\r\n\r\nz" * 40)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    archives = warc.write_archives(pages)
    got = warc.read_archives(archives).collect()
    first = {long: 3}

    def want(p, url, html):
        data = (html or "").encode()
        to = 3 if html == long and p != 3 else None
        return (p, (url or ""), len(data), hashlib.sha256(data).hexdigest(), "revisit" if to else "response", to, None)

    assert first[long] == 3 and Counter(map(tuple, got)) == Counter(want(*r) for r in rows)
    assert warc.op9(pages.limit(0)).count() == 0


def test_warc_reader_validates():
    record = warc.record(1, "u", b"payload" * 30, hashlib.sha256(b"payload" * 30).hexdigest(), None)
    assert warc.parse_record(record)["payload_bytes"] == 210
    for bad in (record[:-1], record.replace(b"WARC-Type: response\r\n", b""), record.replace(b"payloadpayload", b"payloadpaYload"), b"", record.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_warc_dictionary_frame_plain_and_compressed():
    texts = [f"<html><head><title>page {i}</title></head><body>{'word ' * (i % 7)}{i * 7919}</body></html>".encode() * 3 for i in range(300)]
    raw = zstd.train_dictionary(2048, texts).as_bytes()
    writer = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(raw))
    body = [writer.compress(t) for t in texts[:5]]
    for stored in (raw, zstd.ZstdCompressor().compress(raw)):
        lead = struct.pack("<II", warc.DICTIONARY_FRAME, len(stored)) + stored
        assert list(warc.frames(lead + b"".join(body))) == texts[:5]
        broken = list(warc.frames(lead + body[0] + b"\0\0junk" + body[1] + body[2][:-9]))
        assert [x for x in broken if isinstance(x, bytes)] == texts[:2] and any(isinstance(x, ValueError) for x in broken)
    assert list(warc.frames(b"")) == []


# --- 10 toxicity


def toxic_corpus(n=900):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        sentences = [" ".join(f"w{rng.randrange(500)}" for _ in range(8)) + "." for _ in range(rng.randrange(2, 9))]
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] = "you " + rng.choice(["idiotic", "idiots", "scum", "moron"]) + " " + sentences[k]
        rows.append((i, "\n".join(sentences)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out_and_offending_sentence(spark, make_docs):
    rows, labels = toxic_corpus()
    rows += [(5000, None), (5001, ""), (None, "plain words."), (5002, "...")]
    labels += [(None, 1, 1), (3, 0, None), (5000, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op10(make_docs(rows), table).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None) and not got[None].held_out
    assert got[5000].score == got[5001].score == got[5002].score == 0
    truth = {i: t for i, _, t in labels if i is not None and t is not None}
    test = [i for i, r in got.items() if r.held_out and i in truth]
    right = sum(got[i].predicted == truth[i] for i in test)
    assert len(test) > 150 and right / len(test) > 0.97
    texts = dict(rows)
    for i in test:
        if got[i].predicted and truth[i]:
            parts = [texts[i][int(a) : int(b)] for a, b in (x.split(":") for x in got[i].offending.split(","))]
            assert any(re.search("idiot|scum|moron", p) for p in parts) and len(parts) < 3


def test_toxicity_ignores_other_columns_and_keeps_columns(spark, make_docs):
    rows, labels = toxic_corpus(300)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    model = toxicity.fit(docs, table)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), model).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    assert toxicity.keep_clean(make_docs([]), model).count() == 0


def test_toxicity_of_long_clean_texts(spark, make_docs):
    rows, labels = toxic_corpus()
    model = toxicity.fit(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    clean = [t for (_, t), (*_, bad) in zip(rows, labels) if not bad]
    short = toxicity.score_batch(pa.array(clean), model)[0]
    stay = [t for t, x in zip(clean, short) if x < toxicity.THRESHOLD]
    assert len(stay) > 0.99 * len(clean)
    long = "\n".join(stay * 12)
    score, _ = toxicity.score_batch(pa.array([long, "nothing telling here.\n" * 100_000, f"{long}\nyou idiotic scum w1 w2."]), model)
    assert len(long) > 1 << 20 and score[0] == max(x for x in short if x < toxicity.THRESHOLD) and score[1] == 0 and score[2] > 0.5


def test_toxicity_trains_on_long_texts(spark, make_docs):
    rows = [(i, ("you scum w1. " if i % 2 else "plain words. ") + f"filler {i}. " * 4000) for i in range(120)]
    table = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.op10(make_docs(rows), table).collect()
    assert all(len(t) > 32 << 10 for _, t in rows) and all(r.predicted == r.doc_id % 2 for r in got)


def test_toxicity_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.op10(make_docs([(1, "a b c")]), none).collect()} == {0.0}
    assert toxicity.op10(make_docs([]), none).count() == 0


def test_score_is_the_fitted_one():
    """Ten weak sentences weigh as much as the strongest of them, in the score and in the descent alike."""
    z = np.log(np.array([0.25] * 10 + [0.25, 0.6, 0.4, 0.1]) / (1 - np.array([0.25] * 10 + [0.25, 0.6, 0.4, 0.1])))
    doc = np.array([0] * 10 + [1] * 4)
    counts = toxicity.decisive(z, doc, 3)
    score = toxicity.noisy_or(np.where(counts, z, -np.inf), doc, 3)
    assert counts.tolist() == [True] * 10 + [False, True, True, False]
    assert score[2] == 0 and score[1] == pytest.approx(1 - 0.4 * 0.6)


def test_noisy_or():
    z, doc = np.array([0.0, 0.0, -100.0]), np.array([0, 0, 1])
    assert np.allclose(toxicity.noisy_or(z, doc, 3), [0.75, 0, 0])
