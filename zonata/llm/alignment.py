"""Alignment of two tokenizers' tokens over the bytes of a text, by coalescing intervals.

Each token is the interval of bytes it stands for. The tokens of both sides, sorted by their starts, with the running maximum of
their ends: where a start reaches that maximum, both sides have just ended, and a new group starts. Within groups both sides
cover the bytes without a gap, so at each different start the token of each side that is open there makes one link, and every
pair of overlapping tokens is met at exactly one start. All texts of a batch are aligned at once.

How often a pair of ids is linked in the corpus comes from counts of each batch: a batch is one row with its different pairs,
which are summed by pair, compared with the largest of their B id and sent back to the batches that hold them. So a pair is
shuffled once for each batch, not for each link or document, and no table of all pairs is held anywhere; per document, only the
numbers of its pairs in the batch's list are kept between the two passes.

Defined results: texts that are null, empty or do not come back byte for byte from either side's tokens have no tokens (zeros,
empty groups_sha256). Repeated rows get a row each and count as often; null ids stay; an empty table gives no rows. Columns other
than doc_id and text are not looked at. A text is aligned in one piece, so a task holds a multiple of its longest text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, pieces, shared_dir, with_id, with_id_text, written

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN
#: Characters of texts aligned at once, and of a batch, which is a row of the table between the passes.
BATCH, ROW = 750_000, 6_000_000


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: itself where it is one, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a tokenizers file. Its merges must be in the order of their ids, so that ids are ranks."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file.get("normalizer") or file["pre_tokenizer"].get("type") != "ByteLevel" or file["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level file")
        special = {t["content"] for t in file["added_tokens"]}
        code = _byte_of_symbol()
        ids = {token: i for token, i in file["model"]["vocab"].items() if token not in special}
        merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in file["model"]["merges"]]
        if merged != sorted(merged) or len(ids) != len(merged) + 256 or merged[0] < 256:
            raise ValueError("merges are not in the order of their ids")
        self.size = max(ids.values()) + 1
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(code[c] for c in token)
        ranks = {raw: i for i, raw in enumerate(self.bytes) if raw}
        self._encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(t) for t in texts]


class Pieces:
    """SentencePiece, which puts a space before a text itself."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.vocab_size()
        self.bytes = [self._raw(i) for i in range(self.size)]

    def _raw(self, i: int) -> bytes:
        if self._model.is_control(i) or self._model.is_unknown(i):
            return b""
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@dataclass(frozen=True)
class Sides:
    """Two tokenizers, the sizes of their tokens, and the text of each id in a groups string with what may follow it."""

    a: ByteLevel
    b: Pieces
    sizes: tuple[np.ndarray, np.ndarray]
    printed: list[bytes]


@lru_cache(2)
def sides(a: str = BYTE_LEVEL, b: str = PIECES) -> Sides:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    one, two = ByteLevel(a), Pieces(b)
    printed = [b"%d%c" % (i, c) for i in range(one.size) for c in b",|"] + [b"%d%s" % (i, c) for i in range(two.size) for c in (b",", b";", b"")]
    return Sides(one, two, tuple(np.array([len(x) for x in t.bytes], np.int64) for t in (one, two)), printed)


@dataclass(frozen=True)
class Aligned:
    """Links of texts one behind the other: the tokens they join (numbers among A's and B's), and each token's group."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> Aligned:
    """Tokens as intervals of bytes, both sides over the same bytes without gaps or empty tokens."""
    n = len(start_a)
    start = np.concatenate((start_a, start_b))
    order = np.lexsort((np.repeat(np.array([0, 1], np.int8), (n, len(start_b))), start))
    start, reached = start[order], np.maximum.accumulate(np.concatenate((end_a, end_b))[order])
    first = np.ones(len(order), bool)
    first[1:] = start[1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    # the open token of each side, read where the last of several tokens starts
    last = np.ones(len(order), bool)
    last[:-1] = start[1:] != start[:-1]
    open_a = np.maximum.accumulate(np.where(order < n, order, 0))[last]
    open_b = np.maximum.accumulate(np.where(order < n, 0, order - n))[last]
    return Aligned(open_a, open_b, group[:n], group[n:])


def _groups_codes(found: Aligned, ids_a: np.ndarray, ids_b: np.ndarray, ends_text: np.ndarray, n_a: int) -> np.ndarray:
    """Numbers in Sides.printed of all tokens, each group's A tokens before its B tokens."""
    n, m = len(ids_a), len(ids_b)
    closes_a, closes_b = np.ones(n, bool), np.ones(m, np.int64)
    closes_a[:-1] = found.group_a[1:] != found.group_a[:-1]
    closes_b[:-1] = found.group_b[1:] != found.group_b[:-1]
    closes_b[ends_text] = 2
    codes = np.empty(n + m, np.int64)
    codes[np.arange(n) + np.searchsorted(found.group_b, found.group_a, "left")] = 2 * ids_a + closes_a
    codes[np.arange(m) + np.searchsorted(found.group_a, found.group_b, "right")] = 2 * n_a + 3 * ids_b + closes_b
    return codes


def _batch(own: Sides, texts: list) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Per text the base columns and `pairs`, the number of its different pairs; then these pairs' keys (in order within a
    text) and how often the text has them."""
    base = pd.DataFrame({c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "pairs")}).assign(groups_sha256="")
    full = [i for i, t in enumerate(texts) if t]
    a, b = own.a.encode([" " + texts[i] for i in full]), own.b.encode([texts[i] for i in full])
    raw = [(" " + texts[i]).encode() for i in full]
    same = [k for k, r in enumerate(raw) if b"".join(map(own.a.bytes.__getitem__, a[k])) == r and b"".join(map(own.b.bytes.__getitem__, b[k])) == r]
    none = np.zeros(0, np.int64)
    if not same:
        return base, none, none
    a, b, rows = [a[k] for k in same], [b[k] for k in same], np.array([full[k] for k in same])
    n_a, n_b = np.array([*map(len, a)]), np.array([*map(len, b)])
    ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
    end_a, end_b = np.cumsum(own.sizes[0][ids_a]), np.cumsum(own.sizes[1][ids_b])
    found = align(end_a - own.sizes[0][ids_a], end_a, end_b - own.sizes[1][ids_b], end_b)
    text_a = np.repeat(np.arange(len(rows)), n_a)
    starts_group = np.ones(len(ids_a), bool)
    starts_group[1:] = found.group_a[1:] != found.group_a[:-1]
    stop = np.cumsum(n_a + n_b)
    codes = _groups_codes(found, ids_a, ids_b, np.cumsum(n_b) - 1, own.a.size)
    shas = [hashlib.sha256(b"".join(map(own.printed.__getitem__, codes[i:j].tolist()))).hexdigest() for i, j in zip(stop - n_a - n_b, stop, strict=True)]
    # different pairs by text; a key is a pair of ids
    span = own.a.size * own.b.size
    text = text_a[found.a]
    keys, times = np.unique(text * span + ids_a[found.a] * own.b.size + ids_b[found.b], return_counts=True)
    n_keys = np.bincount(keys // span, minlength=len(rows))
    values = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text_a[starts_group], minlength=len(rows)), "n_links": np.bincount(text, minlength=len(rows)), "pairs": n_keys, "groups_sha256": shas}
    for c, v in values.items():
        base.loc[rows, c] = v
    return base, keys % span, times


_DOCS = "doc_id array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, pairs array<long>, groups_sha256 array<string>"
_OUT = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x.astype("<i4").tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i4").astype(np.int64)


def _sums(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Sums of values between the bounds upto."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[upto[1:]] - total[upto[:-1]]


def align_documents(spark: SparkSession, docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, batch: int = BATCH, row: int = ROW) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    shared_dir(spark)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, number = sides(a, b), TaskContext.get().partitionId() << 32
        held, size = [], 0

        def out() -> pd.DataFrame:
            keys, times = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            different, place = np.unique(keys, return_inverse=True)
            base = pd.concat([h[0] for h in held])
            counts = np.bincount(place, times, len(different)).astype(np.int64)
            return pd.DataFrame({"batch": [number], **{c: [base[c].to_numpy()] for c in base}, "place": [_packed(np.diff(place, prepend=0))], "times": [_packed(times)], "keys": [different], "counts": [counts]})

        for part in pieces(frames, "text", batch):
            base, keys, times = _batch(own, part["text"].tolist())
            held.append((base.assign(doc_id=part["doc_id"].to_numpy()), keys, times))
            size += sum(len(t) for t in part["text"] if t)
            if size >= row:
                yield out()
                held, size, number = [], 0, number + 1
        if held:
            yield out()

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                place, times = np.cumsum(_unpacked(r.place)), _unpacked(r.times)
                count = np.asarray(r.counted if r.counted is not None else [], np.int64)
                best = np.asarray(r.best if r.best is not None else [], bool)
                upto = np.concatenate(([0], np.cumsum(r.pairs)))
                yield pd.DataFrame({
                    "doc_id": r.doc_id, "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": r.n_links,
                    "n_best": _sums(times * best[place], upto), "count_sum": _sums(times * count[place], upto), "groups_sha256": r.groups_sha256,
                })

    schema = f"batch long, {_DOCS}, place binary, times binary, keys array<long>, counts array<long>"
    found = written(with_id_text(docs.select("doc_id", "text")).mapInPandas(first, schema), "aligned")
    uses = found.select("batch", F.explode(F.arrays_zip("keys", "counts")).alias("p")).select("batch", F.col("p.keys").alias("key"), F.col("p.counts").alias("n"))
    total = uses.groupBy("key").agg(F.sum("n").alias("count"))
    of_b = F.col("key") % F.lit(sides(a, b).b.size)
    total = written(total.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(of_b))), "pairs")  # a B id has at most as many rows as there are A ids
    told = uses.select("batch", "key").join(total, "key").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("key", "count", "best"))).alias("p"))
    told = told.select("batch", F.col("p.count").alias("counted"), F.col("p.best").alias("best"))
    return with_id(found.drop("keys", "counts").join(told, "batch", "left").drop("batch").mapInPandas(last, _OUT))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(spark, documents(spark, sf_dir))


QUERIES = {"op12_align": op12_align}
SQL: dict[str, str] = {}
