import random

import pytest

from zonata.llm import sentencepieces as S


@pytest.fixture(scope="module")
def v():
    return S.Vocabulary(S.MODEL)


def best(v, text):
    """The largest score over all ways to cut a marked text into pieces or bytes, position by position."""
    top = [0] + [S.NONE] * len(text)
    for end in range(1, len(text) + 1):
        c = S.SPACE if text[end - 1] == S.LITERAL else text[end - 1]
        ways = [top[a] + v.pieces[text[a:end]][1] for a in range(max(0, end - v.longest), end) if text[a:end] in v.pieces]
        if text[end - 1] not in v.pieces:
            ways.append(top[end - 1] + v.byte_score * len(c.encode()))
        top[end] = max(ways, default=S.NONE)
    return top[-1]


def test_lossless_and_best_for_any_cut(spark, docs, unique, v):
    for chunk in (8192, 64, 17):
        enc = S.encode(spark, docs, chunk=chunk, group=3)
        got = {r["doc_id"]: r for r in S.digest(enc).collect()}
        back = {r["doc_id"]: r["text"] for r in S.decode(enc).collect()}
        for d, t, *_ in unique:
            assert got[d]["lossless"] and back[d] == (t or "")
            if len(t or "") < 2500:
                assert got[d]["score"] == (best(v, S.marked(t)) if t else 0)


def test_units_hold_no_piece_back(v):
    rng = random.Random(3)
    texts = ["".join(rng.choice("the an  ▁é漢x\n\0") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    v.forget()
    for ids, score, t in zip(*v.encode([S.marked(t) for t in texts]), texts, strict=True):
        assert score == best(v, S.marked(t)) and v.decode(ids)[1:].decode() == t


def test_a_full_cache_changes_nothing(v, monkeypatch):
    rng = random.Random(4)
    texts = [S.marked(" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(30))) for _ in range(20)]
    v.forget()
    want = v.encode(texts)[1].tolist()
    monkeypatch.setattr(S, "CACHE", 40)
    v.forget()
    assert [int(v.encode([t])[1][0]) for t in texts] == want


def test_edges(spark, docs_repeated, none, data):
    assert S.digest(S.encode(spark, none)).count() == 0
    assert S.digest(S.encode(spark, docs_repeated, chunk=100)).count() == len(data)
