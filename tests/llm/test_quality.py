import re
from collections import Counter

from zonata.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(lines)


def test_measures_and_policies(spark, docs, unique):
    book = quality.ledger(docs)
    got = {r["doc_id"]: r for r in quality.apply_policy(book).collect()}
    for doc_id, text, *_ in unique:
        assert tuple(got[doc_id][m] for m in quality.MEASURES) == brute(text), text
        n, _, _, _, repeated, _ = brute(text)
        base = n < 50 or 100 * repeated > 50 * n
        assert (got[doc_id]["failed"] & quality.mask(quality.BASE) != 0) == base
        assert got[doc_id]["kept"] == (got[doc_id]["failed"] == 0)


def test_ablations(spark, docs):
    rows = quality.ledger(docs).select("failed").collect()
    got = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality.ablations(quality.ledger(docs)).collect()}
    for rule, bit in quality.BIT.items():
        assert got[rule] == (sum(r[0] & bit != 0 for r in rows), sum(r[0] == bit for r in rows))


def test_edges(spark, docs_repeated, none, data):
    assert quality.ledger(none).count() == 0
    assert quality.ledger(docs_repeated).count() == len(data)
