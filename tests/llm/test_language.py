import random

import numpy as np
from pyspark.sql import functions as F

from zonata.llm import language as L

STEMS = {"aa": ["ba", "ke", "lo", "mi"], "bb": ["sch", "tz", "ung", "heit"], "cc": ["eau", "oi", "tion", "ch"]}


def texts(n=240):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        out.append((i, " ".join("".join(rng.choices(STEMS[lang], k=3)) for _ in range(rng.randrange(5, 40))), lang if i % 7 else None))
    return out


def test_held_out_accuracy(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df.where(~L.held_out()))
    out = L.predict(spark, df, model, "lang").where(L.held_out() & F.col("lang").isNotNull()).collect()
    assert len(out) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        c = L.codewords(n).astype(int)
        assert len({tuple(r) for r in c}) == n and len(c) == n


def test_mixed_text_is_ambiguous():
    codes = L.codewords(3)
    model = L.Model(("a", "b", "c"), codes, np.zeros((L.BINS, codes.shape[1]), np.float32))
    best, share, near = model.decode(np.zeros((1, codes.shape[1])))
    assert near[0] and share[0] < 0.5
    assert model.decode(codes[1:2].astype(float))[0][0] == 1


def test_edges(spark, docs_repeated, none, docs, data):
    model = L.train(docs)
    out = {r["doc_id"]: r for r in L.predict(spark, docs, model).collect()}
    for d, t, *_ in data:
        assert (out[d]["lang_pred"] == "und") == (not any(ch.isalpha() for ch in t or ""))
    assert L.predict(spark, none, model).count() == 0
    assert {r["lang_pred"] for r in L.predict(spark, docs, L.train(none)).collect()} == {"und"}


def test_large_ids_beside_null(spark, docs):
    large = (1 << 62) + 1
    given = spark.createDataFrame([(large, "some words", large), (None, None, None)], "doc_id long, text string, n_chars long")
    got = L.predict(spark, given.coalesce(1), L.train(docs), "n_chars").collect()
    assert {(r["doc_id"], r["n_chars"]) for r in got} == {(large, large), (None, None)}
