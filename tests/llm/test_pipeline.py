from collections import Counter

import corpus_pipeline as P
from zonata.llm import mixing

from .conftest import SCHEMA, words


def test_stages_keep_columns_and_take_effect(spark, docs, unique):
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "")
        if name != P.STAGES[-1][0]:
            assert tuple(docs.columns) == P.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs.collect()
    letters = {d for d, t, *_ in unique if any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in seen["language ID"]} <= letters
    kept = {r["doc_id"] for r in seen["near-dedup"]}
    assert 0 in kept and not kept & {30, 31, 32}
    assert not any("f33e6108" in r["text"] for r in seen["secret scans"])
    assert all(r["lossless"] for r in seen["SentencePiece"]) and len(seen["SentencePiece"]) == len(seen["source mixing"])


def through(spark, docs):
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
    return seen


def test_null_and_repeated_doc_ids(spark, docs_repeated, unique):
    import random

    rng = random.Random(8)
    first, second, third = (words(rng, 70) for _ in range(3))
    more = [(None, first, "en", "a", None), (None, second, "de", None, 7), (None, second, "de", None, 7)]  # two of one text
    more += [(900, third, None, "a", 3)] * 3 + [(901, third + " tail", "en", "b", 3), (900, words(rng, 50), "en", "b", 3), (None, None, None, None, None)]
    both = docs_repeated.select(*P.COLUMNS).unionByName(spark.createDataFrame(more, SCHEMA))
    seen = {k: v.collect() for k, v in through(spark, both).items()}
    told = Counter((r["doc_id"], r["text"]) for r in seen["language ID"])
    assert told[900, third] == 3 and told[None, second] == 2 and told[None, first] == 1 and told[None, None] == 0
    once = Counter((r["doc_id"], r["text"]) for r in seen["near-dedup"])
    assert once[None, first] == once[None, second] == 1
    assert once[900, third] == 1 and once[901, third + " tail"] == 0 and once[900, more[-2][1]] == 1
    assert max(once.values()) == 1 and once[4, unique[4][1]] == 1
    assert len(seen["secret scans"]) == len(seen["near-dedup"])
    assert any(r["doc_id"] is None for r in seen["SentencePiece"]) and len(seen["SentencePiece"]) == len(seen["source mixing"])


def test_mix_takes_what_it_decided(spark, docs_repeated):
    docs = docs_repeated.select(*P.COLUMNS).unionByName(docs_repeated.select(*P.COLUMNS)).replace(2, 1, "doc_id")
    docs = docs.unionByName(spark.createDataFrame([(None, "one two three", "en", "z", 3)] * 5, SCHEMA))
    decided = mixing.mix(spark, docs).agg({"copies": "sum", "taken": "sum"}).first()
    out = P.mix(spark, docs, "")
    assert out.count() == decided["sum(copies)"]
    assert mixing.sizes_of(out).agg({"size": "sum"}).first()[0] == decided["sum(taken)"]
    assert out.where("doc_id is null").count() > 0
