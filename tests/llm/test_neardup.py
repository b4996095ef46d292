import random

import pandas as pd
import pytest

from zonata.llm import neardup as N
from zonata.llm.components import components
from zonata.llm.shared import batches

from .conftest import words


def brute(rows, n, percent):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def held(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("n, percent, small", [(3, 85, 64), (5, 80, 64), (3, 85, 1)])
def test_against_all_pairs(spark, docs, unique, n, percent, small, monkeypatch):
    monkeypatch.setattr(N, "SMALL", small)
    assert held(N.link(spark, docs, n, percent)) == brute(unique, n, percent)


@pytest.mark.parametrize("small", [64, 1])
def test_large_groups_of_near_copies_by_leaders(spark, monkeypatch, small):
    monkeypatch.setattr(N, "LEFT_OVER", 0)
    monkeypatch.setattr(N, "SMALL", small)
    rng, rows = random.Random(2), []
    for g in range(4):
        base = words(rng, 120).split()
        for k in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(99)}"
            rows.append((g * 100 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert held(N.link(spark, df, 3, 85)) == brute(rows, 3, 85)


def test_a_template_makes_few_pairs(spark):
    """Documents of one template, none similar enough to another but for two planted pairs."""
    rng, rows = random.Random(7), []
    template = [f"t{i}" for i in range(400)]
    for d in range(300):
        rows.append((d, " ".join(template + [f"own{d}x{k}" for k in range(60)])))
    for d, of in ((900, 5), (901, 77)):
        own = rows[of][1].split()
        own[rng.randrange(400, 460)] = "changed"
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = N.sketches(df, 3).selectExpr("doc_id as id", "n_shingles as n", "doc_id as component", "bits", "odd")
    assert {(r["a"], r["b"]) for r in N.by_rare_shingles(ids, df, 3, 85).collect()} == {(5, 900), (77, 901)}
    got = held(N.link(spark, df, 3, 85))
    assert {d: c for d, (_, c, _) in got.items() if c != d} == {900: 5, 901: 77}


@pytest.mark.parametrize("chunk", [20])
def test_alternatives_in_slots_confirm_few_pairs(spark, monkeypatch, chunk):
    """A template whose slots take one of a few words: the rarest shingles are shared by a quarter of the documents."""
    monkeypatch.setattr(N, "CHUNK", chunk)
    rng, rows, looked = random.Random(11), [], []
    slots = sorted(rng.sample(range(300), 18))
    for d in range(260):
        t = [f"t{i}" for i in range(300)]
        for i in slots:
            t[i] = f"s{i}x{rng.randrange(4)}"
        rows.append((d, " ".join(t)))
    rows.append((900, rows[17][1].replace("t299", "other")))
    inner = N.written

    def written(df, name):
        out = inner(df, name)
        if name == "likely":
            looked.append(out.count())
        return out

    monkeypatch.setattr(N, "written", written)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 5, 80)
    assert held(N.link(spark, df, 5, 80)) == want
    assert want[900][1] != 900
    assert sum(looked) < 10 * len(rows)  # of 33,930 pairs


def test_rounds_write_few_tables_and_make_each_set_once(spark, monkeypatch):
    """Each table is files, and each file costs an executor a process; a text's set is made once for all pairs of a round."""
    from zonata.llm import components as C

    monkeypatch.setattr(N, "LEFT_OVER", 0)
    monkeypatch.setattr(N, "SMALL", 1)
    names, inner, looked = [], N.written, []
    base = words(random.Random(3), 120).split()
    rows = [(d, " ".join(base[:d] + [f"own{d}"] + base[d + 1 :])) for d in range(60)] + [(900, "a text on its own of eight words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)

    def written(table, name):
        names.append(name)
        if name in ("links", "joins"):
            looked.append(table._jdf.queryExecution().optimizedPlan().toString())
        return inner(table, name)

    monkeypatch.setattr(N, "written", written)
    monkeypatch.setattr(C, "written", written)
    assert held(N.link(spark, df, 3, 85)) == brute(rows, 3, 85)
    assert looked and all(plan.count("ArrowEvalPython") == 1 for plan in looked)
    assert names.count("edges") == 1  # only the round that finds links contracts
    assert len(names) <= 12


def test_a_worker_keeps_few_words():
    shingles = N.Shingler(3)
    for at in range(0, 500_000, 1000):
        assert len(shingles(" ".join(f"word{at + k}" for k in range(1000)))) == 998
    assert len(shingles.hashes) <= 200_000
    again = N.Shingler(3)
    assert (again("a b c word7 d") == shingles("a b c word7 d")).all()


def test_workers_get_few_rows_at_once(spark, monkeypatch):
    """Tables made through Python workers go there in small batches; an executor's memory holds each several times."""
    monkeypatch.setattr(N, "LEFT_OVER", 0)
    monkeypatch.setattr(N, "SMALL", 1)
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before, inner, held_at = [spark.conf.get(x) for x in names], N.written, []
    base = words(random.Random(3), 120).split()
    rows = [(d, " ".join(base[:d] + [f"own{d}"] + base[d + 1 :])) for d in range(60)]
    rows += [(100 + d, f"{rows[d][1]} " + " ".join(f"far{d}x{k}" for k in range(60))) for d in range(20)]  # each only shares a part
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)

    def written(table, name):
        if any(x in table._jdf.queryExecution().optimizedPlan().toString() for x in ("MapInPandas", "ArrowEvalPython")):
            held_at.append((name, *(int(spark.conf.get(x).rstrip("b")) for x in names)))
        return inner(table, name)

    monkeypatch.setattr(N, "written", written)
    assert held(N.link(spark, df, 3, 85)) == brute(rows, 3, 85)
    assert {name for name, *_ in held_at} == {"sketches", "joins", "shingles"}
    assert all(n <= 1000 and size <= 8_000_000 for _, n, size in held_at)
    assert [spark.conf.get(x) for x in names] == before


def test_batches_hold_inside_only(spark):
    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [len(f)], "chars": [int(f["text"].str.len().sum())]})

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(x) for x in names]
    df = spark.range(0, 300, 1, 1).selectExpr("id", "repeat('abcdefghij', if(id < 200, 1, 1000)) as text")
    with pytest.raises(ZeroDivisionError), batches(spark, 50, 200_000):
        got = [tuple(r) for r in df.mapInPandas(sizes, "n long, chars long").collect()]
        assert sum(n for n, _ in got) == 300 and max(n for n, _ in got) == 50
        assert max(chars for _, chars in got) <= 250_000  # the row that reaches the limit is the last one
        raise ZeroDivisionError
    assert [spark.conf.get(x) for x in names] == before


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(1, 2), (9, 2), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 1: 1, 2: 1, 9: 1}
    assert components(links.limit(0)).count() == 0


def test_edges(spark, docs_repeated, none, data):
    assert N.link(spark, none).count() == 0
    assert N.link(spark, docs_repeated).count() == len(data)
