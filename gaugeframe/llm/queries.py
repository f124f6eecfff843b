"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from gaugeframe.llm import chat, contamination, gif, jaccard, lines, mixing, ordermin, prefixtrie, privacy, substrings, toxicity, warc, whitening
from gaugeframe.llm.common import table
from gaugeframe.llm.oracles import ORACLES  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_substring_dedup(spark, sf_dir):
    return substrings.op3(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark, sf_dir):
    return contamination.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_source_mix(spark, sf_dir):
    return mixing.op8(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark, sf_dir):
    return warc.op9(table(spark, sf_dir, "pages"))


@query
def op2_chat_format(spark, sf_dir):
    return chat.op2(table(spark, sf_dir, "conversations"))


@query
def op1_gif(spark, sf_dir):
    return gif.op1(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark, sf_dir):
    return lines.op7(table(spark, sf_dir, "documents"))


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard.op5(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_sanitise(spark, sf_dir):
    return privacy.op6(table(spark, sf_dir, "documents"))


@query
def op13_order_minhash(spark, sf_dir):
    return ordermin.op13(table(spark, sf_dir, "documents"))


@query
def op11_feast_whitening(spark, sf_dir):
    return whitening.op11(table(spark, sf_dir, "embeddings"))


@query
def op12_prefix_trie(spark, sf_dir):
    return prefixtrie.op12(table(spark, sf_dir, "conversations"))
