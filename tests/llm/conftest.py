import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, x string, h string, t string, node string, pack string"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows_of(texts):
    """(doc_id, text) pairs as rows with clashing extra columns."""
    return [(i, t, "en" if i is not None and i % 2 else None, "s", len(t) if t else None, "a", None, "b", "c", "d", "e") for i, t in texts]


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty, short and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (30, 60, 200, 40, 13, 12, 5, 4, 1)]
    passage = words(rng, 30)
    long = words(rng, 30000)
    texts = [(i, " ".join(w)) for i, w in enumerate(base)]
    texts += [(20 + i, " ".join(base[2])) for i in range(5)]
    near = list(base[2])
    near[100] = "changed"
    texts += [(30, " ".join(near)), (31, "\n".join(near[:-2]))]
    texts += [(40 + i, " ".join(words(rng, 8) + passage + words(rng, 9))) for i in range(6)]
    texts += [(50, None), (51, ""), (52, " \n\t "), (53, "é" * 80 + " Ünï▁code 漢字 😀"), (54, "a" * 300), (55, "a" * 200 + "b" + "a" * 90)]
    texts += [(60, " ".join(long)), (61, " ".join(long[100:29000])), (62, " ".join(base[1]).upper())]
    texts += [(70, " ".join(base[1])), (70, " ".join(base[1])), (70, "other text " + " ".join(passage)), (None, " ".join(base[0])), (None, None), (None, " ".join(words(rng, 20)))]
    return texts


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(rows_of(corpus), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
