"""Token counts from flat token files: a vectorised search for end-of-document ids, stitched across blocks by a prefix scan.

A flat file is a stream of little-endian 16-bit ids, each document followed by the separator, without an index. Files are held
as tables of blocks (file, block, payload) that any store can keep; `blocks_of_files` cuts plain binary files into the same
form. Each block is searched on its own; documents that run over block ends are put together from prefix sums (tokens before a
block) and prefix maxima (the last separator before it), in two levels so that no window holds a whole large file.

Defined results: null and empty texts are documents of 0 tokens. Tokens after a file's last separator are a document that is
not closed. Repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, pieces, shared_dir, written

RANKS, PATTERN, SEPARATOR = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256
#: Tokens of a block, and blocks of a group of the prefix scan.
BLOCK, GROUP = 1 << 18, 1024


@lru_cache(2)
def encoding(ranks: str = RANKS, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def write_flat(docs: DataFrame, ranks: str = RANKS, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """The documents as flat files, one for each partition. Rows: blocks (file, block, payload), and the writer's manifest of
    which document is where in a file (file, ordinal, doc_id), which no scan looks at."""

    def flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, file = encoding(ranks), np.array([separator], "<u2"), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size = at = ordinal = 0

        def out(payloads: list[bytes], ids: list) -> pd.DataFrame:
            n = len(payloads)
            return pd.DataFrame({
                "file": file,
                "block": pd.array([*range(at, at + n), *[None] * len(ids)], "Int64"),
                "payload": [*payloads, *[None] * len(ids)],
                "ordinal": pd.array([*[None] * n, *range(ordinal, ordinal + len(ids))], "Int64"),
                "doc_id": pd.array([*[None] * n, *ids], "Int64"),
            })

        for part in pieces(frames, "text", 4_000_000):
            for text in part["text"]:
                ids = np.array(enc.encode_ordinary(text or ""), "<u2")
                held += [ids, end]
                size += len(ids) + 1
            payloads = []
            if size >= block:
                stream = np.concatenate(held)
                cut = len(stream) // block * block
                payloads = [stream[k : k + block].tobytes() for k in range(0, cut, block)]
                held, size = [stream[cut:]], len(stream) - cut
            yield out(payloads, [None if pd.isna(i) else int(i) for i in part["doc_id"]])
            at, ordinal = at + len(payloads), ordinal + len(part)
        if size:
            yield out([np.concatenate(held).tobytes()], [])

    return docs.select("doc_id", "text").mapInPandas(flat, "file int, block long, payload binary, ordinal long, doc_id long")


def blocks_of_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of plain binary files: file is the path."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                for k, at in enumerate(range(0, len(raw), 2 * block)):
                    yield pd.DataFrame({"file": [name], "block": [k], "payload": [raw[at : at + 2 * block]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "file string, block long, payload binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """file, ordinal, start (token offset in the file), n_tokens and closed for each document of the files."""
    kind = blocks.schema["file"].dataType.simpleString()

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [np.frombuffer(p, "<u2") for p in frame["payload"]]
            ends = [np.flatnonzero(i == separator) for i in ids]
            yield frame[["file", "block"]].assign(n=[len(i) for i in ids], ends=ends)

    found = written(blocks.select("file", "block", "payload").mapInPandas(search, f"file {kind}, block long, n long, ends array<long>"), "scan")
    # level 1: prefix sums within groups of blocks; level 2: over the groups of a file
    group = found.withColumn("g", F.floor(F.col("block") / GROUP)).withColumn("seps", F.size("ends"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inner = group.withColumn("n0", F.coalesce(F.sum("n").over(before("file", "g", "block")), zero)).withColumn("s0", F.coalesce(F.sum("seps").over(before("file", "g", "block")), zero))
    inner = inner.withColumn("last", F.col("n0") + F.array_max("ends")).withColumn("l0", F.max("last").over(before("file", "g", "block")))
    outer = inner.groupBy("file", "g").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("last").alias("last"), F.max("block").alias("top"))
    outer = outer.withColumn("n1", F.coalesce(F.sum("n").over(before("file", "g")), zero)).withColumn("s1", F.coalesce(F.sum("seps").over(before("file", "g")), zero))
    outer = outer.withColumn("l1", F.max(F.col("n1") + F.col("last")).over(before("file", "g")))
    outer = outer.withColumn("final", F.lead("g").over(Window.partitionBy("file").orderBy("g")).isNull())
    both = inner.join(outer.select("file", "g", "n1", "s1", "l1", "top", "final"), ["file", "g"])
    start = F.coalesce(F.col("n1") + F.col("l0"), F.col("l1"), F.lit(-1)) + 1  # where the document that reaches into the block starts
    both = both.withColumn("from", start).withColumn("base", F.col("n1") + F.col("n0"))
    # ends in file offsets; a file's end closes nothing
    ends = F.transform("ends", lambda e: F.struct((F.col("base") + e).alias("end"), F.lit(True).alias("closed")))
    stop = F.col("base") + F.col("n")
    last_end = F.coalesce(F.col("base") + F.array_max("ends") + 1, F.col("from"))
    tail = F.when(F.col("final") & (F.col("block") == F.col("top")) & (last_end < stop), F.array(F.struct(stop.alias("end"), F.lit(False).alias("closed"))))
    both = both.withColumn("all", F.concat(ends, F.coalesce(tail, F.expr("cast(array() as array<struct<end: bigint, closed: boolean>>)"))))
    one = both.select("file", (F.col("s1") + F.col("s0")).alias("s"), "from", "all", F.posexplode("all").alias("k", "e"))
    begin = F.when(F.col("k") == 0, F.col("from")).otherwise(F.element_at("all", F.greatest(F.col("k"), F.lit(1)))["end"] + 1)
    return one.select("file", (F.col("s") + F.col("k")).alias("ordinal"), begin.alias("start"), (F.col("e.end") - begin).alias("n_tokens"), F.col("e.closed").alias("closed"))


def count_tokens(spark: SparkSession, docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, start: written as flat files, found again by the scan."""
    shared_dir(spark)
    flat = written(write_flat(docs, ranks), "flat")
    found = scan(flat.where("payload is not null").select("file", "block", "payload"))
    names = flat.where("ordinal is not null").select("file", "ordinal", "doc_id")
    return names.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "start")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, documents(spark, sf_dir)).select("doc_id", "n_tokens")


QUERIES = {"op3_tokens": op3_tokens}
SQL: dict[str, str] = {}
