import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonata.llm import suffixtree as S
from zonata.llm.shared import hashed_part

from .conftest import words as some_words


def toks(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def own_units(t):
    words = toks(t)
    return [(words[i - 1][-S.TAIL :] if i else b"") + b" " + w for i, w in enumerate(words)]


class Plain:
    """The tree by dictionaries: counts after every context, kept contexts, probabilities by recursion."""

    def __init__(self, units):
        self.c = defaultdict(Counter)
        for u, times in units.items():
            for ctx, s in self.symbols(u):
                for d in range(S.DEPTH + 1):
                    self.c[ctx[len(ctx) - d :]][s] += times
        self.kept = {x for x, c in self.c.items() if len(x) <= S.SHORT and sum(c.values()) >= S.LEAST}
        for x, c in self.c.items():
            up, n = self.c[x[1:]], sum(c.values())
            if len(x) > S.SHORT and n >= S.LEAST and len(up) > 1:
                gain = sum(k * math.log(k / n / (up[s] / sum(up.values()))) for s, k in c.items())
                if 2 * gain >= len(up) - 1 + S.DEVIATIONS * math.sqrt(2 * (len(up) - 1)):
                    self.kept |= {x[i:] for i in range(len(x) - S.SHORT)}

    @staticmethod
    def symbols(unit):
        tail, _, w = unit.partition(b" ")
        all_ = b" " * S.DEPTH + unit + (b"" if w == S.END else b" ")
        return [(all_[i - S.DEPTH : i], all_[i]) for i in range(S.DEPTH + len(tail) + 1, len(all_))]

    def p(self, ctx, s):
        if not ctx:
            return (self.c[b""][s] + 0.5) / (sum(self.c[b""].values()) + 128)
        up = self.p(ctx[1:], s)
        return (self.c[ctx][s] + S.MU * up) / (sum(self.c[ctx].values()) + S.MU) if ctx in self.kept else up

    def score(self, text):
        return sum(math.log10(self.p(ctx, s)) for u in own_units(text) for ctx, s in self.symbols(u))


@pytest.mark.parametrize("usual", [(S.USUAL, S.FREQUENT), (40, 1e-2)])
def test_scores_equal_a_tree_of_dictionaries(spark, docs, unique, monkeypatch, usual):
    """Also with rare grams and words by joins, and subtrees over several blocks."""
    monkeypatch.setattr(S, "USUAL", usual[0])
    monkeypatch.setattr(S, "FREQUENT", usual[1])
    monkeypatch.setattr(S, "BLOCK", 300)
    held = hashed_part("doc_id", 10) == 0
    got = {r["doc_id"]: r for r in S.score(spark, docs, ~held).collect()}
    c = Counter(w for d, t, *_ in unique if zlib.crc32(str(d).encode()) % 10 for w in toks(t))
    plain = Plain(Counter(u for d, t, *_ in unique if zlib.crc32(str(d).encode()) % 10 for u in own_units(t)))
    n, v = sum(c.values()), len(c)
    assert any(len(x) > S.SHORT + 1 for x in plain.kept)
    for d, t, *_ in unique:
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(toks(t)), sum(c[w] > 0 for w in toks(t)), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), rel_tol=1e-9)
        assert math.isclose(r["score"], plain.score(t), rel_tol=1e-9)


def test_distributions_sum_to_one(unique):
    plain = Plain(Counter(u for _, t, *_ in unique for u in own_units(t)))
    for ctx in (b" " * S.DEPTH, b" " * (S.DEPTH - 2) + b"al", b"unheard"):
        assert math.isclose(sum(plain.p(ctx, s) for s in range(256)), 1)


def test_grams_are_the_units_symbols(data):
    texts = [t for _, t, *_ in data] + [None, "", " a  b\tccc ", "\u00e9 x " * 3, "one " + "y" * 50]
    codes, sizes = S.grams(texts)
    want = [[ctx[::-1] + bytes([s]) for u in own_units(t) for ctx, s in Plain.symbols(u)] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert codes.tolist() == [int.from_bytes(g, "big") for w in want for g in w]


def test_table():
    keys = np.random.default_rng(1).integers(0, 1 << 48, 5000)
    keys = np.unique(keys)
    t = S.Table.of(keys, np.arange(len(keys)))
    there, value = t.get(np.concatenate([keys, keys + 1]))
    assert there[: len(keys)].all() and (value[: len(keys)] == np.arange(len(keys))).all()
    assert (there[len(keys) :] == np.isin(keys + 1, keys)).all()


def test_edges(spark, docs_repeated, none, data, docs):
    assert S.score(spark, none, F.lit(True)).count() == 0
    got = S.score(spark, docs_repeated, F.lit(True)).collect()
    assert len(got) == len(data) and {r["n_tokens"] for r in got if r["doc_id"] == 4} == {len(toks(data[4][1]))}
    alone = S.score(spark, docs.where("text is null"), F.lit(False)).collect()
    assert {r["base_score"] for r in alone} == {0.0} and all(math.isclose(r["score"], math.log10(1 / 256), rel_tol=1e-9) for r in alone)


def test_the_tree_grows_with_the_input(spark):
    """A clear context stays however much other text is added."""
    rare, common = b"zheqq", {b"the": 1000, b"cat": 500, b"sat": 400, b"mat": 300, b"quit": 200}
    for times in (1, 20):
        words = {rare: 8} | {w: n * times for w, n in common.items()}
        docs = spark.createDataFrame([(0, " ".join([w.decode()] * n)) for w, n in words.items()], "doc_id long, text string")
        plain = Plain(Counter(u for w, n in words.items() for u in own_units(" ".join([w.decode()] * n))))
        assert b"zhe" in plain.kept
        told = {r["gram"]: r["lp"] for r in S.probabilities(spark, docs, F.lit(True)).collect()}
        for w in words:
            unit = w[-S.TAIL :] + b" " + w
            codes = S.grams([f"{w.decode()} {w.decode()}"])[0][len(w) + 1 : 2 * len(w) + 2]  # the second word's
            assert all(math.isclose(told[c], math.log10(plain.p(*x)), rel_tol=1e-9) for c, x in zip(codes.tolist(), plain.symbols(unit), strict=True))


class Task:
    """Stands for a table: keeps what a task would run."""

    def mapInPandas(self, work, schema):
        return work


def test_a_gram_task_holds_little(monkeypatch):
    """A worker's memory counts beside the JVM's; what it holds must not follow the size of its batches."""
    rng = random.Random(2)
    text = some_words(rng, 20_000)
    frame = pd.DataFrame({"text": [text] * 60, "learn": [True] * 60})
    monkeypatch.setattr(S, "_told_apart", lambda docs, learn: Task())
    gathered = S.gram_counts(None, None)
    tracemalloc.start()
    try:
        put = list(gathered(iter([frame])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    n = len(S.grams([text])[0])
    assert sum(p["u"].sum() for p in put) == sum(p["n"].sum() for p in put) == 60 * n > 6_000_000
    assert most < 100e6
