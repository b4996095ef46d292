"""Periodic runs of words, found by tiles scaled to the period.

For periods p of an octave [P, 2P), word i matches if word i + p is the same. A run of period p has at least 3p matches in a row, and
so covers a whole tile of T = max(3, 3P / 2) words of a fixed grid. Each octave has its own grid of tiles, which overlap by the
words that p reaches over. A tile is full for p if all of its words match: that is told exactly by comparing the numbers of two
overlapping grams of 2^j words (doubled from level to level; a gram that its text has once never takes part again, so little is
left of plain prose after some levels). Consecutive full tiles of a period are chained; how far the matches go on beyond a
chain's two ends, at most one tile, is read off Z-functions at these boundaries, one for all periods of the octave.

Texts of up to LONG words are solved by the task that reads them. Longer ones are exploded into groups of tiles for each octave,
with the words around them that their tiles need, which are dealt out and solved apart. Fragments of intervals are then shuffled
by (document, period) and stitched where they touch. Of equal stretches the smallest period counts: by the theorem of Fine and
Wilf a stretch of four periods with a smaller one is a run of that one too, from end to end.

Defined results: null and blank texts have no words, no runs and the digests of nothing. A null doc_id takes no periodic rewriting
(`rewritten`), which is derived from the id. Repeated rows are documents of their own. Of runs with the same exponent the one
that starts first, then the one of the smaller period, is the greatest. An empty table gives no rows; other columns are not
looked at. The words of one document, not its tiles, must fit into a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, pieces, shared_dir, with_id, with_id_text, written

#: Least length of a run in words and in periods.
LEAST, TIMES = 6, 4
#: Words of a text that one task solves whole, words of a group of tiles of a longer one, bytes of texts taken at once.
LONG, GROUP, BATCH = 200_000, 1 << 16, 1_500_000


def z_function(s: list[int]) -> list[int]:
    """Length of the longest common prefix of s and each of its suffixes; the first is the length of s."""
    n = len(s)
    z, left, right = [n] + [0] * (n - 1) if n else [], 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile_of(octave: int) -> int:
    return max(3, 3 * (1 << octave) // 2)


def octaves_of(n: int) -> range:
    """Octaves with a period that n words can hold TIMES times."""
    return range((n // TIMES).bit_length() if n >= LEAST else 0)


class Texts:
    """Word numbers of texts one behind the other, and the numbers of their grams of 2^level words: -1 for one that its text has
    once. Numbers of different texts differ."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.stop = ids, np.cumsum(sizes)
        self.start = self.stop - sizes
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(ids)) - self.start[self.text]
        self.level, self.gram = 0, self._numbered(np.arange(len(ids)), self.text * (int(ids.max(initial=0)) + 1) + ids)

    def _numbered(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(self.ids), -1, np.int64)
        if len(at):
            _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
            again = times[number] > 1
            out[at[again]] = number[again]
        return out

    def grow(self, level: int) -> None:
        while self.level < level:
            step = 1 << self.level
            at = np.flatnonzero(self.gram[:-step] >= 0) if step < len(self.gram) else np.zeros(0, np.int64)
            at = at[(self.gram[at + step] >= 0) & (self.text[at] == self.text[np.minimum(at + step, len(self.ids) - 1)])]
            self.gram = self._numbered(at, self.gram[at] * len(self.ids) + self.gram[at + step])
            self.level += 1

    def full_tiles(self, octave: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of full tiles and the periods they are full for."""
        low, tile = 1 << octave, tile_of(octave)
        self.grow(max(1, octave))
        gap, g = tile - (1 << self.level), self.gram
        at = np.flatnonzero(g >= 0)
        tiles = at[self.place[at] % tile == 0]
        tiles = tiles[tiles + gap < len(g)]
        tiles = tiles[g[tiles + gap] >= 0]
        if not len(tiles):
            return tiles, tiles
        at = at[np.argsort(g[at], kind="stable")]
        keys, n = g[at] * len(g) + at, len(g)
        first = np.searchsorted(keys, g[tiles] * n + np.minimum(tiles + low, n))
        found = np.searchsorted(keys, g[tiles] * n + np.minimum(tiles + 2 * low, n)) - first
        start = np.repeat(tiles, found)
        other = at[np.repeat(first - np.cumsum(found) + found, found) + np.arange(found.sum())]
        same = (other + gap < n) & (g[start + gap] == g[np.minimum(other + gap, n - 1)])
        return start[same], other[same] - start[same]

    def after(self, octave: int, boundary: int, text: int, periods: np.ndarray) -> np.ndarray:
        """Matches in a row from the boundary on, for each period: a tile's worth at most."""
        tile, reach, hi = tile_of(octave), 2 << octave, int(self.stop[text])
        z = np.array([*z_function(self.ids[boundary : min(hi, boundary + tile + reach)].tolist()), 0], np.int64)
        return np.minimum(z[np.minimum(periods, len(z) - 1)], tile)

    def before(self, octave: int, boundary: int, text: int, periods: np.ndarray) -> np.ndarray:
        """Matches in a row that end before the boundary: common suffixes with what is a period further, by the reversed words."""
        left, end = max(int(self.start[text]), boundary - tile_of(octave)), min(boundary + (2 << octave), int(self.stop[text]))
        word = self.ids[left:boundary][::-1].tolist()
        z = np.array(z_function([*word, -1, *self.ids[left:end][::-1].tolist()]), np.int64)
        return z[len(word) + 1 + end - boundary - periods] if word else np.zeros(len(periods), np.int64)

    def fragments(self, octave: int, own: tuple[int, int] | None = None) -> np.ndarray:
        """Rows text, period, start, stop: intervals of matching words (places in the text) that hold a full tile. own: only
        tiles that start there."""
        start, period = self.full_tiles(octave)
        if own is not None:
            keep = (self.place[start] >= own[0]) & (self.place[start] < own[1])
            start, period = start[keep], period[keep]
        if not len(start):
            return np.zeros((0, 4), np.int64)
        order = np.lexsort((start, period, self.text[start]))
        start, period = start[order], period[order]
        tile, text = tile_of(octave), self.text[start]
        heads = np.ones(len(start), bool)
        heads[1:] = (text[1:] != text[:-1]) | (period[1:] != period[:-1]) | (start[1:] != start[:-1] + tile)
        begin, period, text = start[heads], period[heads], text[heads]
        end = np.append(start[np.flatnonzero(heads)[1:] - 1], start[-1]) + tile
        more, less = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        for bounds, out, matches in ((end, more, self.after), (begin, less, self.before)):
            by = np.argsort(bounds, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(bounds[by])) + 1):
                for t in np.unique(text[group]):  # where one text ends another starts
                    own_t = group[text[group] == t]
                    out[own_t] = matches(octave, int(bounds[own_t[0]]), int(t), period[own_t])
        base = self.start[text]
        return np.stack((text, period, begin - less - base, end + more - base), 1)


def whole_runs(texts: Texts) -> np.ndarray:
    """Rows text, period, start, stop of whole texts: what is too short, and larger periods of a stretch, taken out."""
    longest = int((texts.stop - texts.start).max(initial=0))
    found = np.concatenate([np.zeros((0, 4), np.int64), *(texts.fragments(o) for o in octaves_of(longest))])
    size = found[:, 3] - found[:, 2] + found[:, 1]
    found = found[size >= np.maximum(LEAST, TIMES * found[:, 1])]
    found = found[np.lexsort((found[:, 1], found[:, 3] + found[:, 1], found[:, 2], found[:, 0]))]
    same = np.zeros(len(found), bool)
    same[1:] = (found[1:, 0] == found[:-1, 0]) & (found[1:, 2] == found[:-1, 2]) & (found[1:, 3] + found[1:, 1] == found[:-1, 3] + found[:-1, 1])
    return found[~same]


def rewritten(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """One document in ten, by its id's checksum, becomes periodic from some word on."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(doc_id.encode()), 10)
    if rest:
        return words
    n, a = len(words), g % len(words)
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


_SCAN = (
    "row long, doc_id string, collapsed string, words binary, periods array<long>, starts array<long>, stops array<long>, "
    "octave int, low long, first long, last long, ids binary"
)
_RESULT = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _spans(ids: np.ndarray, group: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Groups of tiles of a long text: octave, first word, own tiles from and to, words."""
    for octave in octaves_of(len(ids)):
        tile = tile_of(octave)
        step = -(-group // tile) * tile
        for first in range(0, len(ids), step):
            low = max(0, first - tile)
            yield octave, low, first, first + step, ids[low : first + step + tile + (2 << octave)].astype("<i4").tobytes()


def _scanned(long: int, group: int):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SCAN.split(", ")]
        rows = count(TaskContext.get().partitionId() << 36)
        for frame in pieces(frames, "text", BATCH):
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            texts = [rewritten(t.split() if t else [], d) for d, t in zip(frame["doc_id"], frame["text"], strict=True)]
            ids = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
            short = [k for k, t in enumerate(texts) if len(t) <= long]
            found = whole_runs(Texts(np.concatenate([np.zeros(0, np.int64), *(ids[k] for k in short)]), np.array([len(ids[k]) for k in short], np.int64)))
            cut = np.searchsorted(found[:, 0], np.arange(len(short) + 1))
            runs = {k: found[cut[i] : cut[i + 1]] for i, k in enumerate(short)}
            out = []
            for k, (d, t) in enumerate(zip(frame["doc_id"], texts, strict=True)):
                row, text = next(rows), b" ".join(t)
                if k in runs and not len(runs[k]):
                    out.append((row, d, hashlib.sha256(text).hexdigest(), *[None] * 9))
                    continue
                own = runs.get(k, np.zeros((0, 4), np.int64))
                out.append((row, d, None, text, own[:, 1], own[:, 2], own[:, 3], *[None] * 5))
                if k not in runs:
                    yield from (pd.DataFrame([(row, *[None] * 6, *span)], columns=columns).astype({"octave": "Int64"}) for span in _spans(ids[k], group))
            yield pd.DataFrame(out, columns=columns)

    return scan


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples(index=False):
            ids = np.frombuffer(r.ids, "<i4").astype(np.int64)
            found = Texts(ids, np.array([len(ids)])).fragments(r.octave, (r.first - r.low, r.last - r.low))
            yield pd.DataFrame({"row": r.row, "period": found[:, 1], "start": found[:, 2] + r.low, "stop": found[:, 3] + r.low})


def stitched(fragments: DataFrame) -> DataFrame:
    """row, start, length, period of runs, from fragments (row, period, start, stop) of intervals of matches that overlap or touch."""
    order = Window.partitionBy("row", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(order))
    whole = parts.groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = whole.select("row", "period", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))
    runs = runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return runs.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in pieces(frames, "words", BATCH):
        out = []
        for d, words, runs in zip(frame["doc_id"], frame["words"], frame["runs"], strict=True):
            found = [(r["start"], r["length"], r["period"]) for r in (runs if runs is not None else ())]
            best = None
            for s, n, p in found:  # by start, then period: the first of equals stays
                if best is None or n * best[2] > best[1] * p:
                    best = (s, n, p)
            text = words.split()
            gone = np.zeros(len(text) + 1, np.int64)
            for s, n, p in found:
                gone[s + p] += 1
                gone[s + n] -= 1
            kept = b" ".join(w for w, x in zip(text, np.cumsum(gone).tolist(), strict=False) if not x)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
            out.append((d, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
        kinds = dict.fromkeys(("start", "length", "period", "exponent_milli"), "Int64")
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")]).astype(kinds)


def _with_runs(docs: DataFrame, long: int, group: int) -> tuple[DataFrame, DataFrame]:
    """What a scan of the texts gives (each text's row; its words if it may have runs), and their runs by row."""
    shared_dir(docs.sparkSession)
    texts = with_id_text(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    found = written(texts.mapInPandas(_scanned(long, group), _SCAN), "periods")
    here = found.where("periods is not null").select("row", F.explode(F.arrays_zip("periods", "starts", "stops")).alias("f"))
    here = here.select("row", F.col("f.periods").alias("period"), F.col("f.starts").alias("start"), F.col("f.stops").alias("stop"))
    spans = found.where("octave is not null").select("row", "octave", "low", "first", "last", "ids").repartition("row", "octave", "first")
    away = spans.mapInPandas(_solved, "row long, period long, start long, stop long")
    return found.where("octave is null").select("row", "doc_id", "collapsed", "words"), stitched(here.unionByName(away))


def runs(spark: SparkSession, docs: DataFrame, long: int = LONG, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, period of every run of every document."""
    rows, found = _with_runs(docs, long, group)
    return with_id(rows.select("row", "doc_id").join(found, "row").drop("row"))


def collapse(spark: SparkSession, docs: DataFrame, long: int = LONG, group: int = GROUP) -> DataFrame:
    """One row per document: its number of runs, its greatest run, digests of all runs and of the words left when every run is cut
    to its first period."""
    rows, found = _with_runs(docs, long, group)
    plain = rows.where("words is null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *(F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")), F.lit(_NOTHING).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
    each = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rest = rows.where("words is not null").join(each, "row", "left").select("doc_id", "words", "runs")
    return with_id(plain.unionByName(rest.mapInPandas(_told, _RESULT)))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark, documents(spark, sf_dir))


QUERIES = {"op11_periods": op11_periods}
SQL: dict[str, str] = {}
