"""Stain separation on colour pixels: fit by aggregates, apply by column expressions; keyed by image or tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IO, ALPHA, BETA = 240.0, 1.0, 0.15
#: Reference stain matrix (red, green, blue by two stains) and maximal concentrations. Fixed values.
REFERENCE = ((0.5626, 0.2159), (0.7201, 0.8012), (0.4062, 0.5581))
REFERENCE_MAX = (1.9705, 1.0308)
_RGB = ("r", "g", "b")


def optical_density(df: DataFrame, floor: float | None = None) -> DataFrame:
    """With or, og, ob; pixels with any density below the floor go."""
    out = df.withColumns({f"o{c}": -F.log((F.col(c) + 1) / IO) for c in _RGB})
    return out if floor is None else out.where(F.least("or", "og", "ob") >= floor)


def _plane(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    rows = []
    for r in frame.itertuples(index=False):
        cov = np.array([[r.rr, r.rg, r.rb], [r.rg, r.gg, r.gb], [r.rb, r.gb, r.bb]], float)
        v = np.linalg.eigh(np.nan_to_num(cov))[1][:, 1:]
        v = v * np.where(v[0] < 0, -1, 1)  # eigenvectors have no sign of their own
        rows.append([*(getattr(r, k) for k in keys), *v.T.ravel().tolist()])
    return pd.DataFrame(rows, columns=[*keys, "a_r", "a_g", "a_b", "b_r", "b_g", "b_b"])


def stain_matrix(df: DataFrame, keys: list[str], alpha: float = ALPHA, floor: float | None = BETA) -> DataFrame:
    """keys, m (6 numbers: red, green, blue of each stain), of which the redder stain comes first.

    One aggregate gives the densities' covariance a key; its plane comes from a 3 x 3 eigenproblem a key; one percentile of
    the angles in that plane a key gives the two directions.
    """
    od = optical_density(df, floor)
    cov = od.groupBy(*keys).agg(*(F.covar_samp(f"o{a}", f"o{b}").alias(a + b) for a, b in (("r", "r"), ("r", "g"), ("r", "b"), ("g", "g"), ("g", "b"), ("b", "b"))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cov.select(*keys).schema)

    def planes(frames):
        for frame in frames:
            yield _plane(frame, keys)

    plane = cov.mapInPandas(planes, fields + ", a_r double, a_g double, a_b double, b_r double, b_g double, b_b double")
    on = lambda p: sum((F.col(f"o{c}") * F.col(f"{p}_{c}") for c in _RGB), F.lit(0.0))
    phi = od.join(plane, keys).groupBy(*keys, *(f"{p}_{c}" for p in "ab" for c in _RGB)).agg(F.percentile(F.atan2(on("b"), on("a")), F.array(F.lit(alpha / 100), F.lit(1 - alpha / 100))).alias("phi"))
    along = lambda i: F.array(*(F.col(f"a_{c}") * F.cos(F.col("phi")[i]) + F.col(f"b_{c}") * F.sin(F.col("phi")[i]) for c in _RGB))
    two = phi.select(*keys, along(0).alias("u"), along(1).alias("v"))
    return two.select(*keys, F.when(F.col("u")[0] > F.col("v")[0], F.concat("u", "v")).otherwise(F.concat("v", "u")).alias("m"))


def inverse(m: tuple[tuple[float, float], ...]) -> np.ndarray:
    return np.linalg.pinv(np.array(m, float))


def concentrations(df: DataFrame, m: tuple[tuple[float, float], ...] = REFERENCE) -> DataFrame:
    """With c0 and c1: least squares of the densities on the two stains of a fixed matrix."""
    inv = inverse(m)
    return optical_density(df).withColumns({f"c{i}": sum((float(inv[i, j]) * F.col(f"o{c}") for j, c in enumerate(_RGB)), F.lit(0.0)) for i in (0, 1)}).drop("or", "og", "ob")


def keyed_concentrations(df: DataFrame, matrices: DataFrame, keys: list[str]) -> DataFrame:
    """With c0 and c1 by each key's own matrix: normal equations of two unknowns as expressions."""
    od = optical_density(df).join(matrices, keys)
    u, v = ([F.col("m")[i + 3 * k] for i in range(3)] for k in (0, 1))
    dot = lambda p, q: sum((a * b for a, b in zip(p, q, strict=True)), F.lit(0.0))
    o = [F.col(f"o{c}") for c in _RGB]
    det = dot(u, u) * dot(v, v) - dot(u, v) * dot(u, v)
    return od.withColumn("c0", F.try_divide(dot(v, v) * dot(u, o) - dot(u, v) * dot(v, o), det)).withColumn("c1", F.try_divide(dot(u, u) * dot(v, o) - dot(u, v) * dot(u, o), det)).drop("or", "og", "ob", "m")


def max_concentrations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.expr(f"percentile(c{i}, 0.99)").alias(f"max{i}") for i in (0, 1)))


def _byte(v: Column) -> Column:
    return F.floor(F.when(v > 255, 254.0).otherwise(v)).cast("int")


def single_channels(df: DataFrame, maxima: DataFrame, keys: list[str], reference: tuple[float, float] | None = REFERENCE_MAX, foreground: Column | None = None) -> DataFrame:
    """With s0 and s1: each stain alone as gray values; background pixels are 255."""
    out = df.join(maxima, keys)
    for i in (0, 1):
        scale = F.col(f"max{i}") / (reference[i] if reference else 1.0)
        gray = _byte(IO * F.exp(-F.col(f"c{i}") / scale))
        out = out.withColumn(f"s{i}", gray if foreground is None else F.when(foreground, gray).otherwise(255))
    return out.drop("max0", "max1")


def reconstruct(df: DataFrame, maxima: DataFrame, keys: list[str], m: tuple[tuple[float, float], ...] = REFERENCE, reference: tuple[float, float] = REFERENCE_MAX) -> DataFrame:
    """Colours as they would be with the reference stains: nr, ng, nb."""
    out = df.join(maxima, keys)
    scaled = [F.col(f"c{i}") / (F.col(f"max{i}") / reference[i]) for i in (0, 1)]
    return out.withColumns({f"n{c}": _byte(IO * F.exp(-(m[j][0] * scaled[0] + m[j][1] * scaled[1]))) for j, c in enumerate(_RGB)}).drop("max0", "max1")
