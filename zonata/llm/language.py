"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; for each of its bits a binary classifier (naive Bayes log odds over hashed n-grams, from counts of
all training texts) predicts the bit. Decoding takes the codeword of least exponential loss over the bits' margins; when the
second is nearly as good, the row is flagged ambiguous.

Defined results: null texts and texts without a letter are `und` with score 0. A text with letters always gets a learned
language, also an ambiguous one. Rows without lang, or held out, teach nothing. With no training rows at all every prediction is
`und`. Repeated rows get a row each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, hashed_part, pieces

GRAM, BINS = 3, 1 << 15
#: Below this difference of normalised losses the decision is ambiguous.
NEAR = 0.02
_LETTER = regex.compile(r"\p{L}")


def held_out() -> Column:
    return hashed_part("doc_id", 4) == 2


def grams(raw: bytes) -> np.ndarray:
    """Bins of all byte n-grams of the text, lower-cased (ASCII), spaces around it."""
    b = np.frombuffer(b" " + raw.lower() + b"  ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int32)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for part in pieces(frames, "text", 4_000_000):
        for lang, own in part.groupby("lang"):
            got = total.setdefault(lang, np.zeros(BINS, np.int64))
            got += np.bincount(grams(b" ".join(map(_bytes, own["text"]))), minlength=BINS)
    for lang, n in total.items():
        yield pd.DataFrame({"lang": [lang], "counts": [n]})


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, n in zip(frame["lang"], frame["counts"], strict=True):
            total[lang] = total.get(lang, 0) + np.asarray(n)
    for lang, n in total.items():
        yield pd.DataFrame({"lang": [lang], "counts": [n]})


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: all different splits for up to 7 languages, else the best-spread of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T
    rng, bits = np.random.default_rng(0), int(np.ceil(10 * np.log2(n)))
    tries = [np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.int8) for _ in range(50)]
    return max(tries, key=lambda c: -np.max(c.astype(int) @ c.T.astype(int) - np.eye(n, dtype=int) * 2 * bits))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    codes: np.ndarray  # (langs, bits)
    weights: np.ndarray  # (BINS, bits): log odds of an n-gram for bit +1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss) and whether the second is near, for (rows, bits) margins."""
        loss = np.exp(-margins[:, None, :] * self.codes[None]).mean(2)
        order = np.argsort(loss, 1, kind="stable")
        share = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        rows = np.arange(len(loss))
        near = (loss[rows, order[:, 1]] - loss[rows, order[:, 0]] < NEAR) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return order[:, 0], share[rows, order[:, 0]], near


def train(docs: DataFrame) -> Model:
    """From all rows with a lang: n-gram counts by language are summed on the executors, BINS numbers a language."""
    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInPandas(_counted, "lang string, counts array<long>")
    rows = counts.repartition(8, "lang").mapInPandas(_summed, "lang string, counts array<long>").orderBy("lang").collect()
    langs = tuple(r["lang"] for r in rows)
    codes = codewords(len(langs))
    table = np.array([r["counts"] for r in rows], np.float64).reshape(len(langs), BINS)
    rate = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * BINS)  # each language counts alike, however much text it has
    weights = np.zeros((BINS, codes.shape[1]), np.float32)
    for bit in range(codes.shape[1]):
        yes, no = rate[codes[:, bit] == 1], rate[codes[:, bit] == -1]
        if len(yes) and len(no):
            weights[:, bit] = np.clip(np.log(yes.mean(0) / no.mean(0)), -4, 4)
    return Model(langs, codes, weights)


def predict(spark: SparkSession, docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous and the carried columns; looks at the text alone."""
    # bounded: BINS * bits floats, whatever the input
    sent = spark.sparkContext.broadcast(model)
    given = docs.select("doc_id", "text", *carry)
    # long numbers as text: pandas would turn those beside a null into floats
    longs = {c for c, t in given.dtypes if t == "bigint"}
    keep = given.select(*(F.col(c).cast("string").alias(c) if c in longs else c for c in given.columns))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name != "text")

    def predicted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for part in pieces(frames, "text", 2_000_000):
            margins, told = np.zeros((len(part), m.codes.shape[1]), np.float64), np.zeros(len(part), bool)
            for i, text in enumerate(part["text"]):
                if text and m.langs and _LETTER.search(text):
                    raw, n = text.encode("utf-8", "surrogatepass"), 0
                    for at in range(0, len(raw), 1 << 20):  # n-grams over block ends are met by the overlap
                        g = grams(raw[at : at + (1 << 20)])
                        margins[i] += m.weights[g].sum(0, dtype=np.float64)
                        n += len(g)
                    margins[i] /= n
                    told[i] = True
            best, share, near = m.decode(margins) if m.langs else (np.zeros(len(part), int), np.zeros(len(part)), told)
            out = part.drop(columns="text")
            names = np.array([*m.langs, "und"], object)
            yield out.assign(lang_pred=np.where(told, names[best], "und"), score=np.where(told, share, 0.0), ambiguous=near & told)

    out = keep.mapInPandas(predicted, fields + ", lang_pred string, score double, ambiguous boolean")
    return out.select(*(F.col(c).cast("long").alias(c) if c in longs else c for c in out.columns))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    return predict(spark, docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op10_language": op10_language}
SQL: dict[str, str] = {}
