import math

import numpy as np
import pytest

from zonata.operators import stats

SCOPES = [("all", "species", ()), ("some", "subject", ("species",))]


@pytest.fixture(scope="module")
def table(spark):
    """Groups of odd and even size with ties, values without a logarithm, a subject and a value that are missing."""
    rng, rows = np.random.default_rng(4), []
    for i in range(301):
        species = "abc"[i % 3]
        subject = None if i % 50 == 7 else f"{species}{i % 7}"
        rows.append((species, subject, float(rng.integers(-1, 40)), None if i % 60 == 1 else float(rng.normal(5, 1))))
    return spark.createDataFrame(rows, "species string, subject string, area double, shape double")


def plain(rows):
    return sorted(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def test_same_as_each_test_alone(spark, table):
    want = []
    for name, group, scope in SCOPES:
        rows = stats.long(table, group, ["area", "shape"], scope, ("area",))
        keys = [*scope, "attr"]
        for test, found in (("kruskal", stats.kruskal(rows, keys)), ("levene", stats.levene(rows, keys)), ("dunn", stats.dunn(rows, keys))):
            for r in found.collect():
                sheet = "-".join([name, *(r[c] for c in scope)])
                want.append((test, sheet, group, r["attr"], *((r["group1"], r["group2"]) if test == "dunn" else ("", "")), r["stat"] or 0.0, r["pvalue"]))
    for buckets in (1, 5):
        got = [(*r[:4], r["group1"] or "", r["group2"] or "", r["stat"] or 0.0, r["pvalue"]) for r in stats.run_all(table, SCOPES, ["area", "shape"], ("area",), buckets).collect()]
        assert plain(got) == plain(want)


def test_input_is_read_once(spark, table):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    stats.run_all(table.mapInPandas(counted, table.schema), SCOPES, ["area", "shape"], ("area",)).collect()
    assert seen.value == 301
