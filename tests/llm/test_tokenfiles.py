import numpy as np

from zonata.llm import tokenfiles as T


def test_counts(spark, docs, unique):
    enc = T.encoding()
    got = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(spark, docs).collect()}
    assert got == {d: len(enc.encode_ordinary(t or "")) for d, t, *_ in unique}


def test_documents_over_blocks_and_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 2)
    rng = np.random.default_rng(1)
    want = {}
    for name, sizes, closed in (("a", [0, 0, 5, 40, 1, 0, 17], True), ("b", [100], False), ("c", [3, 0, 9], False), ("d", rng.integers(0, 12, 50).tolist(), True)):
        ids = []
        for k, n in enumerate(sizes):
            ids += [1] * n + [9] * (closed or k < len(sizes) - 1)
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        want[name] = [(k, n, closed or k < len(sizes) - 1) for k, n in enumerate(sizes)]
    blocks = T.blocks_of_files(spark, str(tmp_path), block=4)
    got = {}
    for r in T.scan(blocks, separator=9).orderBy("file", "ordinal").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["ordinal"], r["n_tokens"], r["closed"]))
    assert got == want


def test_edges(spark, docs_repeated, none, data):
    assert T.count_tokens(spark, none).count() == 0
    assert T.count_tokens(spark, docs_repeated).count() == len(data)
