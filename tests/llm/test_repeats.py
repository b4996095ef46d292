import hashlib
import random

import pytest

from zonata.llm import repeats as R


def brute(rows, length=100):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            if w in seen:
                cover[a : a + length] = b"\1" * length
            else:
                seen.add(w)
        n_spans = sum(1 for k, c in enumerate(cover) if c and (not k or not cover[k - 1]))
        out[d] = (len(raw), sum(cover), n_spans, hashlib.sha256(bytes(x for x, c in zip(raw, cover) if not c)).hexdigest())
    return out


def held(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_against_all_windows(spark, docs, unique):
    assert held(R.repeats(spark, docs)) == brute(unique)


@pytest.mark.parametrize("seed", range(3))
def test_periodic_and_spliced_texts(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(R, "WIDE", 3)
    if seed == 2:
        monkeypatch.setattr(R, "PART", 400)
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd \n") for _ in range(rng.randrange(80, 900))) for _ in range(6)] + ["ab" * 300, "q" * 500, "\0" * 260]
    rows = []
    for i in range(60):
        cut = [b[(s := rng.randrange(len(b))) : s + rng.randrange(20, 400)] for b in rng.choices(base, k=rng.randrange(1, 5))]
        rows.append((i, "".join(cut)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert held(R.repeats(spark, df)) == brute(rows)


def test_large_and_repeated_ids(spark):
    """Ids near 2 ** 62, a repeated row, a null id last."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefg hij") for _ in range(400))
    rows = [((1 << 62) + i, text[i * 10 : i * 10 + 300]) for i in range(5)]
    df = spark.createDataFrame([*rows, rows[0], (None, text)], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or 1 << 63, r["n_removed"]) for r in R.repeats(spark, df).collect())
    want = brute([(i, t) for i, (_, t) in enumerate([rows[0], *rows, (None, text)])])
    assert [n for _, n in got] == [want[i][1] for i in range(7)]


def test_maximal_repeats():
    spans = [b"xxABCDEFGHyy", b"zABCDEFGHw", b"qqCDEFGHr"]
    got = {(n, frozenset(zip(w.tolist(), o.tolist()))) for n, w, o in R.maximal_repeats(spans, [9, 7, 6], 4)}
    assert got == {(8, frozenset({(0, 2), (1, 1)})), (6, frozenset({(0, 4), (1, 3), (2, 2)}))}


def test_edges(spark, docs_repeated, none, data):
    assert R.repeats(spark, none).count() == 0
    got = R.repeats(spark, docs_repeated).collect()
    assert len(got) == len(data)
    twins = [r["n_removed"] for r in got if r["doc_id"] == 4]
    assert sorted(twins) == [0, max(twins)] and max(twins) > 0
