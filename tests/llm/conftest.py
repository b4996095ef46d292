import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu")):
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(90)) * (rng.random() < 0.6) for _ in range(n))


def rows():
    """Plain, near and exact copies, nulls in every column, empty, blank, long and odd texts, ties and a repeated row."""
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(20, 160)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1]]  # exact copies
    near = texts[2].split()
    near[len(near) // 2] = "changed"
    texts += [" ".join(near), texts[3] + " tail"]
    passage = words(rng, 60)
    texts += [words(rng, 30) + " " + passage, passage + " " + words(rng, 30), words(rng, 9) + "\n" + passage + "\n" + words(rng, 5)]
    texts += [None, "", " \t\n", "...", "Grüße an alle: ▁x▁ 漢字 🎉 né", "one two", "one", "aaaa " * 200, "x" * 3000, "tail\n" * 40, words(rng, 4000)]
    texts += ['key: token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" end', "card 4149601755386017 of", "id 217.94.102.185 or +1 (017) 555-7713"] * 3
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "B", None)[i % 4], len(t) if t and i % 5 else None) for i, t in enumerate(texts)]
    return out + [out[4]]


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def unique(data):
    return data[:-1]


@pytest.fixture
def docs(spark, unique):
    return spark.createDataFrame(unique, SCHEMA).repartition(3)


@pytest.fixture
def docs_repeated(spark, data):
    """With a repeated row, and extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("size", "key", "v", "row", "copies", "score", "n", "uid", "kept", "media", "word", "gram", "rank", "skey", "label", "i", "value")
    return spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in names}).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
