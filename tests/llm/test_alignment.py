import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from zonata.llm import alignment as A

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Token by token with the libraries' own encoders; every A token against every B token of its text."""
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(letters)))}

    def raw_b(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    done = []
    for t in texts:
        ids = one.encode(" " + t, add_special_tokens=False).ids if t else []
        a = [(i, bytes(code[c] for c in one.id_to_token(i))) for i in ids]
        b = [(i, raw_b(i)) for i in (two.encode(t) if t else [])]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            done.append(None)
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        a, b = spans
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        links, lo = [], 0
        for x in a:
            while lo and b[lo][0] > x[0]:
                lo -= 1
            links += [(x[2], y[2]) for y in b[max(0, lo - 3) :][:4000] if y[0] < x[1] and x[0] < y[1]]
            while lo < len(b) and b[lo][1] <= x[1]:
                lo += 1
        groups, start = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for s, e, i in a if start <= s and e <= c) + "|" + ",".join(str(i) for s, e, i in b if start <= s and e <= c))
            start = c
        done.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(k for d in done if d for k in d[3])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[k] == top[k[1]] for k in d[3]), sum(count[k] for k in d[3]), d[4]) for d in done]


def shortened(rows):
    return [(r[0], r[1][:1500] if r[1] else r[1], *r[2:]) for r in rows]


@pytest.mark.parametrize("row", [A.ROW, 3000])
def test_against_brute_force(spark, unique, row):
    rows = shortened(unique) + [(900, "<|endoftext|> <s> </s> <unk> <0x41>", None, None, None), (901, "a\x00b ▁ c퟿", None, None, None), (902, "  two  spaces \r\n\t tabs 　 é \U0001f9d1‍\U0001f680", None, None, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.align_documents(spark, docs, batch=2000, row=row).collect()}
    assert got == dict(zip([r[0] for r in rows], brute([r[1] for r in rows]), strict=True))
    assert sum(v[0] > 0 for v in got.values()) > 40 and any(v[2] < v[0] for v in got.values())


def test_intervals_alone():
    a, b = np.array([0, 2, 3, 7, 9]), np.array([0, 3, 5, 6, 7, 9])
    found = A.align(a[:-1], a[1:], b[:-1], b[1:])
    assert list(zip(found.a.tolist(), found.b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 4)]
    assert found.group_a.tolist() == [0, 0, 1, 2] and found.group_b.tolist() == [0, 1, 1, 1, 2]


def test_ids_of_the_library(unique):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    texts = [" " + t for _, t, *_ in unique if t] + ["<|endoftext|>x", "\n\n  y", "don't 12345  "]
    assert A.sides().a.encode(texts) == [e.ids for e in one.encode_batch(texts, add_special_tokens=False)]


def test_edges(spark, docs_repeated, none, data):
    assert A.align_documents(spark, none).count() == 0
    assert A.align_documents(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).select("n_links", "groups_sha256").distinct().collect() == [(0, "")]
    got = A.align_documents(spark, docs_repeated).collect()
    assert len(got) == len(data)
    twice = [tuple(r[c] for c in COLUMNS) for r in got if r["doc_id"] == data[-1][0]]
    assert len(twice) == 2 and twice[0] == twice[1]
    ids = A.align_documents(spark, spark.createDataFrame([(None, "no id"), (None, "no id"), (1 << 60, "one")], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in ids.collect()) == [(0, 2), (0, 2), (1 << 60, 1)]
