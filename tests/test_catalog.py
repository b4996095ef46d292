import math

import pytest

from zonata.plans import registry


def test_cluster_order_uses_every_number(spark, tmp_path):
    zeros = [0.0] * 63
    rows = [("near", [3.0] + zeros), ("far", [0.0] * 60 + [9.0, 1.0, 0.0, 5.0]), ("far", [0.0] * 60 + [7.0, 1.0, 0.0, 5.0])]
    spark.createDataFrame(rows, "label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["label"]: r for r in registry.queries()["w3_cluster_order_whole"](spark, str(tmp_path)).collect()}
    assert got["far"]["norm"] == pytest.approx(math.sqrt(64 + 1 + 25), abs=1e-4)
    assert (got["near"]["ord"], got["far"]["ord"]) == (1, 2)
