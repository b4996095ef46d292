"""Repeated passages: bytes covered by an `length`-byte string that also starts earlier, by an enhanced suffix array in buckets.

Every window of `length` bytes goes to the bucket of its minimiser, the least hash of its k-grams, so equal windows meet. Runs
of neighbouring windows with one minimiser travel as one row: (minimiser, 128-bit digest of the bytes the run spans). Runs whose
whole span occurred earlier, told by minimiser and digest, are repeats at once; what is left of a bucket, one run for each different span, is fetched as bytes, and
its window starts are sorted into a suffix array with common-prefix lengths. A stack scan yields the tree of common-prefix
intervals; those of at least `length` whose members differ in the byte before them (left-diverse) are the maximal repeats, each
with all its occurrences. All but the first occurrence are covered. Buckets with very many different spans are dealt out by
their windows' hashes, which is exact as well.

Defined results: null and empty texts have 0 bytes and nothing removed; texts shorter than `length` never lose a byte; equal
texts: the one with the smallest doc_id keeps what no earlier text holds. Rows that repeat a doc_id are ordered by their texts, a
null doc_id comes last. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, shared_dir, with_id, with_id_text, written

LENGTH, GRAM = 100, 24
#: Different spans in a bucket above which it is dealt out by window.
WIDE = 2_000
_A = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Longest part of a text that is worked on at once; parts overlap by LENGTH - 1 bytes.
PART = 1 << 20


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(raw: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Polynomial hashes of all windows of each size, by doubling: h[i] of bytes i .. i + size."""
    doubled = {1: _TABLE[raw]}
    n = 1
    while 2 * n <= max(sizes):
        h = doubled[n]
        doubled[2 * n] = h[:-n] * _power(n) + h[n:] if len(h) > n else h[:0]
        n *= 2
    out = []
    for size in sizes:
        h, have = None, 0
        for n in sorted((k for k in doubled if size & k), reverse=True):
            g = doubled[n]
            if h is None:
                h = g
            else:
                m = max(0, min(len(h), len(g) - have))
                h = h[:m] * _power(n) + g[have : have + m]
            have += n
        out.append(h)
    return out


def _minimum(v: np.ndarray, width: int) -> np.ndarray:
    n, m = 1, v
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - n : width - n + len(v) - width + 1]) if n < width else m


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimiser, digest of the span in two numbers, twice) of the runs of windows of texts of at least `length` bytes.

    A run's windows share a minimiser at one position. twice: the minimiser occurs again in the run's span, so that windows
    of the run may be equal to each other.
    """
    b = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    width = length - gram + 1
    (grams,) = rolling(b, gram)
    low = np.uint64(127)
    h = _mix(grams) & ~low
    least = _minimum(h | (np.arange(len(h), dtype=np.uint64) & low), width)  # ties are told apart; width is below 128
    valid = np.zeros(len(least) + 1, np.int8)
    valid[base] += 1
    valid[base + sizes - length + 1] -= 1
    valid = np.cumsum(valid[:-1]).astype(bool)
    change = least[1:] != least[:-1]
    edge = np.flatnonzero(valid & np.concatenate(([True], change | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate((change | ~valid[1:], [True])))
    value = least[edge] & ~low
    at = last + ((least[edge] & low).astype(np.int64) - last) % 128  # the minimiser's place: in the run's last window
    around = np.concatenate((np.zeros(width, np.uint64), h, np.zeros(width, np.uint64)))
    twice = np.zeros(len(edge), bool)
    for k in range(1, width):
        twice |= (around[at + width + k] == value) & (at + k < last + width)
        twice |= (around[at + width - k] == value) & (at - k >= edge)
    text = np.searchsorted(base, edge, "right") - 1
    raw = memoryview(b)
    digests = b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(edge.tolist(), (last + length).tolist(), strict=True)])
    return text, edge - base[text], last - edge + 1, value, np.frombuffer(digests, np.int64).reshape(-1, 2), twice


def _bodies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=1)
    for frame in frames:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in frame["text"]]
        yield frame[["doc_id", "uid"]].assign(n_bytes=[len(r) for r in raw], body=[pack.compress(r) for r in raw])


def _local(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's runs; those whose span was met before in the block are known repeats and need no bucket: a hot span leaves
    one row a block. deal: what the rows are dealt by."""
    key, span, span2, uid = (rows[c].to_numpy() for c in ("key", "span", "span2", "uid"))
    order = np.lexsort((rows["start"].to_numpy(), uid, span2, span, key))
    again = (key[order][1:] == key[order][:-1]) & (span[order][1:] == span[order][:-1]) & (span2[order][1:] == span2[order][:-1])
    known = np.zeros(len(key), bool)
    known[order[1:][again]] = True
    return rows.assign(known=known, deal=np.where(known, uid, key))


def _run_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def block(held: list[tuple[int, int, bytes]]) -> pd.DataFrame:
        text, start, n, key, span, twice = runs([h[2] for h in held])
        uid, at = np.array([h[0] for h in held])[text], np.array([h[1] for h in held])[text]
        return pd.DataFrame({"key": key.view(np.int64), "span": span[:, 0], "span2": span[:, 1], "uid": uid, "start": (start + at).astype(np.int32), "n": n.astype(np.int32), "twice": twice})

    held, size, rows = [], 0, []
    for frame in frames:
        for uid, text in zip(frame["uid"], frame["text"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for at in range(0, len(raw) - LENGTH + 1, PART):
                held.append((uid, at, raw[at : at + PART + LENGTH - 1]))
                size += len(held[-1][2])
                if size >= PART:
                    rows.append(block(held))
                    held, size = [], 0
            if len(rows) >= 24:
                yield _local(pd.concat(rows))
                rows = []
    if held:
        rows.append(block(held))
    if rows:
        yield _local(pd.concat(rows))


def _sifted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, digest, uid, start. Out: known repeats (whole) and first runs of buckets that need their bytes.

    One row of each bucket is carried from batch to batch: the first run, held back until a second span shows.
    """
    held: pd.DataFrame | None = None  # the last row seen, and whether its bucket has given out its first runs
    shown = True
    columns = ["whole", "key", "uid", "start", "n"]
    for frame in frames:
        known = frame["known"].to_numpy()
        out = [frame[known].assign(whole=True)[columns]]
        frame = frame[~known]
        if len(frame):
            if held is not None:
                frame = pd.concat([held, frame])
            key, span, span2 = (frame[c].to_numpy() for c in ("key", "span", "span2"))
            same_key = np.concatenate(([False], key[1:] == key[:-1]))
            same = same_key & np.concatenate(([False], (span[1:] == span[:-1]) & (span2[1:] == span2[:-1])))
            out.append(frame[same].assign(whole=True)[columns])
            first = ~same
            if held is not None:
                first[0] = not shown  # the carried row counts as a first run only if it was held back
            at = np.flatnonzero(first)
            bucket = np.cumsum(~same_key)
            ends = np.flatnonzero(np.concatenate((~same_key[1:], [True])))
            many = np.zeros(bucket[-1] + 1, bool)
            firsts = np.bincount(bucket[~same], minlength=bucket[-1] + 1)
            many[firsts > 1] = True
            np.logical_or.at(many, bucket[frame["twice"].to_numpy()], True)
            if held is not None and shown:
                many[bucket[0]] = True  # it has given out runs before, so later first runs follow
            give = at[many[bucket[at]]]
            out.append(frame.iloc[give].assign(whole=False)[columns])
            last = bucket[-1]
            if many[last]:
                held, shown = frame.iloc[[ends[-1]]], True
            else:  # one span so far: carry its first row, which stands for it, with the latest span to compare
                held, shown = frame.iloc[[np.flatnonzero(bucket == last)[0]]], False
        yield pd.concat(out)


def suffix_array(spans: list[bytes], windows: list[int], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The suffixes of the spans at their window starts, sorted: span, offset, common prefix with the one before (0 for the
    first), and the byte before (a number below 0, different for each span, where a span starts)."""
    sizes, n = np.array([len(s) for s in spans]), np.array(windows)
    wide = int(sizes.max())
    text = np.frombuffer(b"".join(spans) + bytes(wide), np.uint8)
    base = np.cumsum(sizes) - sizes
    who = np.repeat(np.arange(len(spans)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, own = base[who] + off, sizes[who] - off
    # equal up to the shorter end: bytes beyond a span's end are zeroed and the common prefix is cut at the ends
    rows = np.lib.stride_tricks.sliding_window_view(text, wide)[at]
    rows[np.arange(wide) >= own[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{wide}").ravel(), kind="stable")
    rows, own = rows[order], own[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(1), differs.argmax(1), wide)
    lcp = np.concatenate(([0], np.minimum(common, np.minimum(own[1:], own[:-1]))))
    before = np.where(off > 0, text[np.maximum(at - 1, 0)].astype(np.int64), -1 - who)
    return who[order], off[order], lcp, before[order]


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(common prefix, from, to) of the common-prefix intervals of at least `least`, by one pass with a stack."""
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        here, left = int(lcp[i]) if i < len(lcp) else 0, i - 1
        while stack and stack[-1][0] > here:
            common, left = stack.pop()
            if common >= least:
                out.append((common, left, i))
        if not stack or stack[-1][0] < here:
            stack.append((here, left))
    return out


def maximal_repeats(spans: list[bytes], windows: list[int], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, spans, offsets) of each maximal repeat of at least `length` bytes, with all its occurrences."""
    who, off, lcp, before = suffix_array(spans, windows, length)
    for common, a, b in intervals(lcp, length):
        left = before[a:b]
        if (left != left[0]).any():
            yield common, who[a:b], off[a:b]


def _covers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, so that a bucket's spans stand together; whole ones are covers already. Out: uid, start, stop."""

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        uid, start = part["uid"].to_numpy(), part["start"].to_numpy().astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for common, who, off in maximal_repeats([bytes(s) for s in part["bytes"]], part["n"].tolist()):
            at = start[who] + off
            rest = np.ones(len(who), bool)
            rest[np.lexsort((at, uid[who]))[0]] = False
            found.append((uid[who][rest], at[rest], at[rest] + common))
        u, a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return pd.DataFrame({"uid": u, "start": a, "stop": b})

    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        whole = frame["whole"].to_numpy()
        own = frame[whole]
        yield pd.DataFrame({"uid": own["uid"], "start": own["start"].astype(np.int64), "stop": own["start"].astype(np.int64) + own["n"] + LENGTH - 1})
        frame = frame[~whole]
        if not len(frame):
            continue
        # cut where a bucket ends and enough windows are at hand
        key, n = frame["key"].to_numpy(), np.cumsum(frame["n"].to_numpy())
        ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1]["key"].iloc[-1] != key[0]:
            ends = np.concatenate(([0], ends))
        first = 0
        for e in ends:
            if size + (n[e - 1] if e else 0) - (n[first - 1] if first else 0) >= 20_000:
                held.append(frame.iloc[first:e])
                yield solved(pd.concat(held))
                held, size, first = [], 0, e
        held.append(frame.iloc[first:])
        size += int(n[-1] - (n[first - 1] if first else 0))
    if held:
        yield solved(pd.concat(held))


def _fetched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of runs: one row a run; for runs of wide buckets one row a window, keyed by the window's own hash, of which
    equal ones in a block leave the first."""
    unpack, columns = zstandard.ZstdDecompressor(), ["whole", "deal", "key", "uid", "start", "n", "bytes"]
    out: list[tuple] = []
    single: dict[bytes, list[tuple[int, int]]] = {}
    held = 0

    def given() -> pd.DataFrame:
        for window, places in single.items():
            key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
            first = min(places)
            out.append((False, key, key, *first, 1, window))
            out.extend((True, uid, key, uid, at, 1, b"") for uid, at in places if (uid, at) != first)
        rows = pd.DataFrame(out, columns=columns)
        out.clear()
        single.clear()
        return rows

    for frame in frames:
        for uid, body, wanted in zip(frame["uid"], frame["body"], frame["wanted"], strict=True):
            raw = unpack.decompress(body)
            for w in wanted:
                start, n = w["start"], w["n"]
                held += n
                if w["wide"]:
                    for at in range(start, start + n):
                        single.setdefault(raw[at : at + LENGTH], []).append((uid, at))
                else:
                    out.append((False, w["key"], w["key"], uid, start, n, raw[start : start + n + LENGTH - 1]))
                if held >= 100_000:  # bounds what is held, whatever a text or a batch wants
                    yield given()
                    held = 0
    if held:
        yield given()


def _kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for frame in frames:
        rows = []
        for doc_id, n_bytes, body, covers in zip(frame["doc_id"], frame["n_bytes"], frame["body"], frame["covers"], strict=True):
            raw, spans = unpack.decompress(body), merged(covers)
            left, at = [], 0
            for a, b in spans:
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            rows.append((doc_id, n_bytes, sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(left)).hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def merged(covers) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted((c["start"], c["stop"]) for c in (covers if covers is not None else ())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, uid, text: uid orders rows as doc_id does; rows that share a doc_id, or have none, get different ones."""
    n = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max(F.col("doc_id").isNull().cast("int"))).first()
    if n[0] is None or (n[0] == 1 and not n[1]):
        return docs.select("doc_id", F.col("doc_id").alias("uid"), "text")
    # partitions are ranges of the order, and so are their numbers
    in_order = docs.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return written(in_order.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text"), "numbered")


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans, the removed (start, stop) in order."""
    shared_dir(spark)
    texts = numbered(docs)
    rows = texts.select("uid", "text").mapInPandas(_run_rows, "key long, span long, span2 long, uid long, start int, n int, twice boolean, known boolean, deal long")
    rows = rows.repartition("deal").sortWithinPartitions("key", "span", "span2", "uid", "start")
    found = written(rows.mapInPandas(_sifted, "whole boolean, key long, uid long, start int, n int"), "runs")
    # what is left of the buckets, with its bytes
    firsts = found.where("not whole")
    wide = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > WIDE).select("key", F.lit(True).alias("wide"))
    wanted = firsts.join(wide, "key", "left").groupBy("uid").agg(F.collect_list(F.struct("key", "start", "n", F.coalesce("wide", F.lit(False)).alias("wide"))).alias("wanted"))
    bodies = with_id_text(texts).mapInPandas(_bodies, "doc_id string, uid long, n_bytes long, body binary")
    schema = "whole boolean, deal long, key long, uid long, start int, n int, bytes binary"
    fetched = wanted.join(bodies, "uid").select("uid", "body", "wanted").mapInPandas(_fetched, schema).repartition("deal").sortWithinPartitions("key")
    covers = fetched.mapInPandas(_covers, "uid long, start long, stop long")
    covers = covers.unionByName(found.where("whole").select("uid", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") + LENGTH - 1).cast("long").alias("stop")))
    covers = written(covers.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("covers")), "covers")
    out = bodies.join(covers, "uid", "left").select("doc_id", "n_bytes", "body", "covers").mapInPandas(
        _kept, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"
    )
    return with_id(out)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op6_repeats": op6_repeats}
SQL: dict[str, str] = {}
