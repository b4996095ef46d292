from pyspark.sql import functions as F

from zonata.llm import secrets as S


def test_findings_have_their_places(spark, docs, unique):
    text = {d: t for d, t, *_ in unique}
    got = S.scan(spark, docs).collect()
    assert got and all(text[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["value"] for r in got)


def test_forest_finds_tokens_not_numbers(spark, docs):
    for r in S.scan(spark, docs).collect():
        assert r["is_secret"] == (len(r["value"]) == 40)


def test_given_labels_are_learned(spark, docs):
    found = S.scan(spark, docs)
    labels = found.select("doc_id", "start", (F.col("length") == 16).cast("int").alias("label"))
    assert all(r["is_secret"] == (len(r["value"]) == 16) for r in S.scan(spark, docs, labels).collect())


def test_redaction(spark, docs, docs_repeated, unique):
    got = {r["doc_id"]: r["text"] for r in S.redact(spark, docs).collect()}
    for d, t, *_ in unique:
        assert got[d] == (t.replace("f33e61083db5dbdf4bd2369d2f80176e57f7fda2", S.MASK) if t else t)
    out = S.redact(spark, docs_repeated)
    assert out.columns == docs_repeated.columns and out.count() == docs_repeated.count()


def test_edges(spark, none, docs):
    assert S.scan(spark, none).count() == 0
    assert S.scan(spark, docs.where("text is null")).count() == 0
    assert not any(r["is_secret"] for r in S.scan(spark, docs.where("text like 'card%'")).collect())


def test_values_after_a_name_are_candidates(spark, docs):
    key = "abc123def456ghi789"
    cases = {
        'password = "correct-horse-battery" x': "correct-horse-battery",
        'passwd = "hunter22"': "hunter22",
        'say password = "P@ssw0rd!2024".': "P@ssw0rd!2024",
        f"run api_key={key} now": key,
        'x {"auth_token": "a b\\"c"}': 'a b\\"c',
        "DB_PASSWORD: p!x, then": "p!x",
        f"a key {key} alone": key,
    }
    rows = [(1000 + i, t, "en", "a", 1) for i, t in enumerate(cases)]
    own = spark.createDataFrame(rows, docs.schema)
    got = {(r["doc_id"], r["start"], r["value"]) for r in S.findings(S.parts_of(own)).collect()}
    assert got == {(d, t.rindex(cases[t]), cases[t]) for d, t, *_ in rows}
    masked = {r["doc_id"]: r["text"] for r in S.redact(spark, docs.unionByName(own)).collect()}
    for d, t, *_ in rows[:5]:
        assert masked[d] == t.replace(cases[t], S.MASK)


def test_clear_negatives(spark):
    values = ["123e4567-e89b-12d3-a456-426614174000", "2024-01-01T10", "/usr/share/doc1/x", "commit f33e61083db5dbdf4bd2369d2f80176e57f7fda2"]
    docs = spark.createDataFrame([(i, f"see {v} there", "en", "a", 1) for i, v in enumerate(values)], "doc_id long, text string, lang string, source string, n_chars long")
    found = S.with_features(S.findings(S.parts_of(docs)), S.dictionary(docs))
    assert [r["label"] for r in S.weak_labels(found).collect()] == [0.0] * len(values)
