import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from zonata.llm import periods as P

COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute_runs(w):
    """Every maximal stretch for every period by comparing word by word; its smallest period told on its own."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and smallest_period(w[i : j + q]) == q:
                found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_texts():
    rng = random.Random(11)
    out = []
    for k in range(160):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.5:
                word = [rng.choice("abc") for _ in range(rng.choice((1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31)))]
                n = int(len(word) * rng.uniform(1, 7)) + rng.randrange(4)
                parts += (word * (n // len(word) + 1))[:n]
            else:
                parts += [rng.choice("ab" if kind < 0.7 else "abcdefgh") for _ in range(rng.randrange(0, 40))]
        out.append((1000 + k, " ".join(parts)))
    out += [(2000, "a " * 300), (2001, "a b " * 150), (2002, ("x " * 5 + "y ") * 60), (2003, "a\x1fb a\x1fb  a\x1fb " * 9), (2004, "x\ty\rz\x0b\x0c" * 6 + "q")]
    return out


@pytest.mark.parametrize(("long", "group"), [(P.LONG, P.GROUP), (20, 60)])
def test_against_brute_force(spark, unique, long, group):
    rows = [(d, " ".join(t.split()[:300]) if t and len(t) > 3000 else t) for d, t, *_ in unique] + periodic_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in P.collapse(spark, docs, long, group).collect()}
    assert got == {d: brute(d, t) for d, t in rows}
    assert sum(v[0] > 1 for v in got.values()) > 40
    assert P.runs(spark, docs, long, group).count() == sum(v[0] for v in got.values())


def test_z_function():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(20))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert P.z_function(s) == want


def test_all_runs_of_small_words():
    rng = np.random.default_rng(7)
    sizes = rng.integers(0, 90, 300)
    ids = np.concatenate([rng.integers(0, rng.integers(1, 4), n) for n in sizes])
    found = P.whole_runs(P.Texts(ids, sizes))
    for k, hi in enumerate(np.cumsum(sizes)):
        own = found[found[:, 0] == k]
        assert sorted(zip(own[:, 2], own[:, 3] - own[:, 2] + own[:, 1], own[:, 1], strict=True)) == sorted(brute_runs(ids[hi - sizes[k] : hi].tolist()))


def test_edges(spark, docs_repeated, none, data):
    assert P.collapse(spark, none).count() == 0
    got = P.collapse(spark, docs_repeated).collect()
    assert len(got) == len(data)
    twice = [tuple(r[c] for c in COLUMNS) for r in got if r["doc_id"] == data[-1][0]]
    assert len(twice) == 2 and twice[0] == twice[1]
    odd = spark.createDataFrame([(None, "a b " * 20), (None, None), (1 << 60, "a " * 7), (3, "  \t")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_runs"], r["period"]) for r in P.collapse(spark, odd).collect() if r["n_runs"]) == [(0, 1, 2), (1 << 60, 1, 1)]
    assert {r["runs_sha256"] for r in P.collapse(spark, odd).where("n_runs = 0").collect()} == {hashlib.sha256(b"").hexdigest()}
