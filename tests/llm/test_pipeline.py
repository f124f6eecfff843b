"""The pipeline's stages on the smallest tables, each judged on its own input."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from gaugeframe.llm import mixing
from gaugeframe.llm.common import stored
from tests.llm.test_operators import brute_classes, brute_flags, brute_lines, key, sha, shared_out

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxicity_keeps_texts(spark, stages):
    before, after = dict(rows(stages[0])), dict(rows(stages[1]))
    assert after.items() <= before.items()
    toxic = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & set(after)) >= 0.9 * len(toxic & set(before))


def test_line_dedup(stages):
    want = {i: (total, gone, digest) for (i, total, gone, digest), _ in brute_lines(rows(stages[1])).items()}
    got = dict(rows(stages[2]))
    assert set(got) == {i for i, (total, gone, _) in want.items() if gone == 0 or gone < total}
    assert all(sha(t or "") == want[i][2] for i, t in got.items())


def test_one_of_each_class(stages):
    want = brute_classes(rows(stages[2]))
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({c for _, c, _, _ in want})


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = brute_flags(rows(stages[3]), items)
    assert sorted(r.doc_id for r in stages[4].collect()) == sorted(i for i, *_, bad in want if not bad)


def test_mix(stages):
    got = stages[5].collect()
    sizes = {}
    for r in stages[4].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = shared_out([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    for s, g in zip(names, goal):
        assert abs(sum(r.taken for r in got if r.source == s) - g) <= 1
    assert all(0 < r.taken <= 2 * r.size for r in got) and len({key(r.doc_id) for r in got}) == len(got)


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of tables: (rows, extra columns of documents, labels, benchmark) -> its path."""
    def make(rows, labels=(), items=(), extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        docs = spark.createDataFrame([(i, t, "en", None if i is None or i % 3 == 0 else "s", len(t or "")) for i, t in rows], schema)
        if extra:  # names that the operators use inside
            docs = docs.selectExpr("*", "'x' as _id", "'y' as _tk", "1 as node", "2 as src", "3 as size", "'z' as target", "4 as bands", "5 as _gf_id")
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame(list(items), "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)
    return make


def test_nulls_repeats_extra_columns_and_long_texts(spark, folder):
    prose = " ".join(f"word{k}" for k in range(300))
    item = " ".join(f"item{k}" for k in range(40))
    rows = [(1, None), (2, ""), (None, None), (3, prose), (3, prose), (4, prose + " end"), (None, prose), (5, item), (6, "z " * 200_000), (7, "one short text")]
    path = folder(rows, labels=[(3, 1, 0), (None, 1, 1), (7, None, None)], items=[("a", item), (None, None), ("b", "")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, path))
        assert kept.columns == docs.columns, name
    # one text without words, one of the prose and its near copy, no contaminated one
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7]
    mixed = {r.doc_id: r for r in pipeline.run(spark, path).collect()}
    assert set(mixed) <= {3, 6, 7} and all(r.taken <= 2 * r.size for r in mixed.values())


def test_empty_tables(spark, folder):
    path = folder([], extra=False)
    assert pipeline.run(spark, path).collect() == []


def test_registered(spark):
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert "pipeline" in names and entry.oracle_sql().keys() <= names.keys()
