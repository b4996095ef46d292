"""Results that hang on the order of a table's rows, against DuckDB on one thread, which takes rows as the files have them."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from zonata.plans import registry
from zonata.sources import tables

from .test_queries import held

N = 600


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Discounts of 0.1, 0.2 and 0.3 (a few others) an order: of most orders of two regions over three files, which are larger from name to name, so that Spark
    starts with the last; of the others in one file. Only the order of rows tells their sums apart."""
    at, rng = tmp_path_factory.mktemp("rows"), np.random.default_rng(3)
    write = lambda name, **columns: pq.write_table(pa.table(columns), at / f"{name}.parquet")
    write("region", r_regionkey=list(range(5)), r_name=list("abcde"))
    write("nation", n_nationkey=list(range(5)), n_name=list("vwxyz"), n_regionkey=list(range(5)))
    write("customer", c_custkey=list(range(5)), c_nationkey=list(range(5)), c_mktsegment=["m"] * 5)
    write("orders", o_orderkey=list(range(N)), o_custkey=[k % 5 for k in range(N)], o_totalprice=rng.integers(1, 9999, N).astype(float))
    files = [[], [], []]
    for k in range(N):
        spread = (k % 5 < 2) == (k % 7 > 1)
        for i, d in enumerate((0.1, 0.1, 0.5) if k % 11 == 0 else (0.1, 0.2, 0.3) if spread else (0.3, 0.2, 0.1)):
            files[i if spread else 0].append((k, 1, 10 * k + i, float(rng.integers(1, 50)), d, float(rng.integers(1, 9999))))
    for i, rows in enumerate(files):  # orders that no customer has, for the size
        files[i] = rows + [(N + j, 1, j, 1.5, float(rng.random()), 1.0) for j in range(30_000 * i)]
    (at / "lineitem.parquet").mkdir()
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice"]
    for i, rows in enumerate(files):
        pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows)), strict=True))), at / "lineitem.parquet" / f"part-{i}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect(config={"threads": 1})
    for t in ("region", "nation", "customer", "orders"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    c.sql(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["a11_spearman", "a4_kruskal", "a8_dunn", "a9_mann_whitney", "j11_significance_gate", "w10_significance_symbol", "w11_first_per_group"])
def test_against_sql(spark, duck, folder, name):
    df = registry.queries()[name](spark, folder)
    out = duck.sql(registry.oracle_sql()[name])
    assert held(df.columns, df.collect()) == held(out.columns, out.fetchall())


def test_equal_orders_count_as_in_sql(spark, tmp_path):
    write = lambda name, **columns: pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    write("region", r_regionkey=[0], r_name=["a"])
    write("nation", n_nationkey=[0], n_name=["v"], n_regionkey=[0])
    write("customer", c_custkey=[0], c_nationkey=[0], c_mktsegment=["m"])
    write("orders", o_orderkey=[1, 1, 2, 3], o_custkey=[0, 0, 0, 0], o_totalprice=[5.0, 5.0, 6.0, 7.0])
    write("lineitem", l_orderkey=[1, 1, 2, 2, None], l_quantity=[2.0, 3.0, None, None, 1.0], l_discount=[0.5, None, None, None, 0.1], l_extendedprice=[4.0, None, None, 9.0, 1.0])
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    out = c.sql(tables.duck(tables.SLIDE_STATS))
    df = tables.slide_stats(spark, str(tmp_path))
    assert held(df.columns, df.collect()) == held(out.columns, out.fetchall())
