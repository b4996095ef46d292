"""Clustering with Spark's own machine-learning pipelines; labels ordered, seeds fixed."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vectors(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(array, lambda v: v.cast("double"))))


def best_kmeans(df: DataFrame, k: int, features: str = "features", tries: int = 3, seed: int = 1):
    """The model of least cost of several seeds."""
    models = [KMeans(k=k, seed=seed + i, featuresCol=features).fit(df) for i in range(tries)]
    return min(models, key=lambda m: m.summary.trainingCost)


def ordered_labels(model) -> list[int]:
    """The rank of each cluster by the norm of its centre (the true inverse of an argsort)."""
    centres = model.clusterCenters()
    order = sorted(range(len(centres)), key=lambda i: float((centres[i] ** 2).sum()))
    return [order.index(i) for i in range(len(centres))]


def kmeans(df: DataFrame, k: int, features: str = "features", tries: int = 3, seed: int = 1) -> DataFrame:
    """With cluster: 0 .. k - 1 in the order of the centres' norms."""
    model = best_kmeans(df, k, features, tries, seed)
    ranks = F.array(*map(F.lit, ordered_labels(model)))
    return model.transform(df).withColumn("cluster", ranks[F.col("prediction")]).drop("prediction")


def standard_pca(df: DataFrame, components: int, features: str = "features"):
    """A fitted pipeline of standardising and principal components (column pca)."""
    scale = StandardScaler(inputCol=features, outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scale, PCA(k=components, inputCol="scaled", outputCol="pca")]).fit(df)


def explained(model) -> list[float]:
    """Cumulative share of variance of the components."""
    total, out = 0.0, []
    for v in model.stages[-1].explainedVariance:
        total += float(v)
        out.append(total)
    return out


def cluster_droplets(df: DataFrame, k: int, variance: float = 0.9, features: str = "features", seed: int = 1) -> DataFrame:
    """Standardised, reduced to the components that hold `variance`, clustered."""
    size = df.select(features).first()[0].size
    shares = explained(standard_pca(df, size, features))
    keep = next((i + 1 for i, s in enumerate(shares) if s >= variance), size)
    return kmeans(standard_pca(df, keep, features).transform(df), k, "pca", seed=seed)


def elbow(df: DataFrame, ks: range, features: str = "features", seed: int = 1) -> list[tuple[int, float]]:
    return [(k, float(best_kmeans(df, k, features, 1, seed).summary.trainingCost)) for k in ks]


def superpixels(pixels: DataFrame, keys: list[str], region: int, rounds: int = 5, weight: float = 0.5) -> DataFrame:
    """keys, y, x, v, sy, sx: each pixel's seed of a grid, by value and place; seeds move to their pixels' means.

    A pixel only meets the seeds of the nine grid cells around it.
    """
    cell = lambda c: F.floor(F.col(c) / region).cast("int")
    px = pixels.select(*keys, "y", "x", "v", cell("y").alias("cy"), cell("x").alias("cx"))
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    spread = px.select("*", near.alias("o")).select(*px.columns, (F.col("cy") + F.col("o.a")).alias("sy"), (F.col("cx") + F.col("o.b")).alias("sx"))
    own = px.select(*keys, "y", "x", "v", F.col("cy").alias("sy"), F.col("cx").alias("sx"))
    for _ in range(rounds):
        seeds = own.groupBy(*keys, "sy", "sx").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"), F.avg("v").alias("mv"))
        d = (F.col("v") - F.col("mv")) ** 2 + weight * ((F.col("y") - F.col("my")) ** 2 + (F.col("x") - F.col("mx")) ** 2)
        own = spread.join(seeds, [*keys, "sy", "sx"]).groupBy(*keys, "y", "x", "v").agg(F.min_by(F.struct("sy", "sx"), F.struct(d, "sy", "sx")).alias("s"))
        own = own.select(*keys, "y", "x", "v", "s.sy", "s.sx").checkpoint()
    return own
