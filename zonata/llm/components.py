"""Connected components of a table of links, by repeated minima and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy, written


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component (the smallest id reachable) for every id that occurs in links (a, b). Empty links: no rows.

    Each round takes the least label of all neighbours and then the label of that label, so long chains shorten quickly. Labels
    are written to the shared folder after each round.
    """
    links = links.select("a", "b").where("a <> b")
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for k in range(rounds):
        if k and k % 4 == 0:
            tidy(links.sparkSession)
        around = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        near = labels.join(around, "id").select("id", F.least("component", "least").alias("component"), F.col("component").alias("before"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = written(near.join(up, "component", "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component"), "before"), "labels")
        labels = new.select("id", "component")
        if not new.where("component <> before").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels
