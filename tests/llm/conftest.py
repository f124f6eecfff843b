import random

import pytest

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _gf_id string, bucket int, node int, n int, slot int"


def rows_to_docs(spark, rows, source=None):
    return spark.createDataFrame([(i, t, "en", source(k) if source else "s", len(t or ""), "x", "y", 1, 2, 3, 4) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows, source=None: rows_to_docs(spark, rows, source)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with shared passages, exact and near copies, nulls, empty and short texts, repeated rows, a null id and a long text."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)] + ["é", "straße", "Ünï"]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = words(60)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two three four")]
    base = words(200)
    for k in range(8):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = "changed"
        rows.append((10 + k, " ".join(near)))
    rows += [(30 + k, " ".join(words(40) + passage + words(30))) for k in range(6)]
    rows += [(40 + k, "\n".join([" ".join(words(12)), " ".join(passage[:20]), " ".join(passage[20:40]), "", " ".join(words(15))])) for k in range(5)]
    rows += [(50, " ".join(base)), (51, " ".join(base)), (52, " ".join(base)), (52, " ".join(base)), (None, " ".join(base)), (None, None)]
    rows += [(60, " ".join(words(30000))), (61, "z " * 300), (62, "z " * 200), (63, " ".join(words(13))), (64, " ".join(words(12)))]
    rng.shuffle(rows)
    return rows
