"""SentencePiece encoding and decoding by max-plus algebra over chunks of a text.

A text's pieces are the path of the largest total score through the lattice of vocabulary pieces (Viterbi, as in a unigram
model). The vocabulary file at hand is a merge model whose scores are ranks, so the log probability of a piece is taken from its
rank by Zipf's law; scores are integers, so that sums do not depend on their order.

Texts longer than CHUNK are cut into chunks. A boundary state is the number of a chunk's first characters that the piece
crossing into it takes. A chunk's transfer matrix has, for each state it may be entered in and each state it may leave to the
next chunk, the largest score of the pieces that start in it. Matrices are combined (max, +), which is associative: products of
groups of chunks, states at the groups' ends, then states within each group, each group apart. With its two states known, each
chunk is traced back on its own.

No piece reaches over the start of a run of spaces, so paths are solved for each unit between those: the different units of a
batch of texts at once, each once, and kept in a bounded cache. Only the units at a chunk's ends take part in its matrix and are
traced back once its states are known (the whole chunk, if one unit fills it); the ids between them are kept from the first pass.

Spaces are kept as they are, one is put before a text; characters without a piece fall back to their bytes, as does a literal
U+2581, so decoding gives back each text without loss. Defined results: null and empty texts have no pieces and decode to the
empty text; repeated rows get a row each; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, pieces, shared_dir, with_id, with_id_text, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE, LITERAL = "▁", "\ud800"  # the second stands for a U+2581 of the text itself; no valid text holds it
#: Characters of a chunk, chunks of a group, units and characters kept in a worker's cache.
CHUNK, GROUP, CACHE, CACHE_CHARS = 8192, 256, 500_000, 8_000_000
#: Characters of texts taken at once, and of segments solved at once.
BATCH, BLOCK = 1_000_000, 250_000
NONE = -(1 << 60)
_BYTES, _OFF = -1, -2  # in place of a piece: a character by its bytes; no piece of the path starts here
_UNIT = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")


@dataclass(frozen=True)
class Lattice:
    """Segments of text one after another with a gap behind each: code points, segments' starts, and edges ordered by their
    start's place in its segment; cuts[t] is the first edge of place t."""

    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    cuts: np.ndarray


def _utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)


class Vocabulary:
    """Pieces with integer scores, a trie of them, paths through texts; and decoding."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ranked = sorted(normal, key=lambda i: (-model.get_score(i), i))
        total = math.log(len(ranked)) + 0.5772
        self.pieces = {model.id_to_piece(i): (i, round(-math.log((r + 2.7) * total) * 1e6)) for r, i in enumerate(ranked)}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece reaches over the start of a run of spaces")
        byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        self.byte_score = min(s for _, s in self.pieces.values()) - 1_000_000
        self.longest = max(map(len, self.pieces))
        self.raw = [b""] * n
        for p, (i, _) in self.pieces.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in byte.items():
            self.raw[i] = bytes([b])
        self.score = np.zeros(n, np.int64)
        for i, s in self.pieces.values():
            self.score[i] = s
        self._grow_trie()
        self.forget()

    def _grow_trie(self) -> None:
        chars = sorted({c for p in self.pieces for c in p})
        self.symbol = np.zeros(0x110000, np.int64)
        self.symbol[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_symbols = len(chars) + 1
        nodes = {"": 0}
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        step = np.array([nodes[p[:-1]] * self.n_symbols + self.symbol[ord(p[-1])] for p in nodes if p], np.int64)
        order = np.argsort(step)
        self.steps, self.child = step[order], 1 + order
        self.piece = np.array([self.pieces.get(p, (_BYTES,))[0] for p in nodes], np.int64)
        self.first = np.zeros(self.n_symbols, np.int64)
        roots = self.steps < self.n_symbols
        self.first[self.steps[roots]] = self.child[roots]

    def forget(self) -> None:
        """Empties the cache: unit without its first space to its number, and the units' ids, scores and characters."""
        self.number: dict[str, int] = {}
        self.ids, self.at, self.n_ids, self.scores, self.chars = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def lattice(self, segments: list[str], stops: np.ndarray | None = None) -> Lattice:
        """The pieces that start in the segments (before their stops, if given) and end in them."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        place = np.arange(len(codes)) - np.repeat(starts, sizes + 1)
        symbols = self.symbol[codes]
        gap = starts + sizes
        symbols[gap] = 0
        at = np.flatnonzero(place < np.repeat(sizes if stops is None else stops, sizes + 1))
        alone = np.ones(len(codes), bool)
        source, length, piece = [], [], []
        node, k = self.first[symbols[at]], 1
        on, node = at[node > 0], node[node > 0]
        while len(on):
            got = self.piece[node]
            hit = got >= 0
            source.append(on[hit])
            length.append(np.full(len(source[-1]), k, np.int64))
            piece.append(got[hit])
            if k == 1:
                alone[source[-1]] = False
            step = node * self.n_symbols + symbols[on + k]
            slot = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            there = self.steps[slot] == step
            on, node, k = on[there], self.child[slot[there]], k + 1
        rest = at[alone[at]]
        source, length, piece = np.concatenate([*source, rest]), np.concatenate([*length, np.ones(len(rest), np.int64)]), np.concatenate([*piece, np.full(len(rest), _BYTES, np.int64)])
        score = np.where(piece >= 0, self.score[piece], self.byte_score * _utf8_size(codes[source]))
        where = place[source]
        order = np.argsort(where.astype(np.uint16) if len(where) and where.max() < 1 << 16 else where, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(where)))) if len(where) else np.zeros(1, np.int64)
        source = source[order]
        return Lattice(codes, starts, sizes, source, source + length[order], piece[order], score[order], cuts)

    def paths(self, lat: Lattice, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest scores from each segment's entry to each position, and each position's last edge; all segments at once."""
        best, last = np.full(len(lat.codes), NONE, np.int64), np.zeros(len(lat.codes), np.int64)
        best[lat.starts + entries] = 0
        for a, b in zip(lat.cuts[:-1], lat.cuts[1:], strict=True):
            s, end = best[lat.source[a:b]] + lat.score[a:b], lat.target[a:b]
            more = np.flatnonzero(s > best[end])  # edges of one place end in different positions
            end = end[more]
            best[end], last[end] = s[more], a + more
        return best, last

    def all_entries(self, lat: Lattice) -> np.ndarray:
        """Largest scores to each position (rows) from each of a segment's first positions (columns)."""
        best = np.full((len(lat.codes), self.longest), NONE, np.int64)
        for i in range(self.longest):
            best[lat.starts[lat.sizes >= i] + i, i] = 0
        for a, b in zip(lat.cuts[:-1], lat.cuts[1:], strict=True):
            end = lat.target[a:b]
            best[end] = np.maximum(best[end], best[lat.source[a:b]] + lat.score[a:b, None])
        return best

    def trace(self, lat: Lattice, last: np.ndarray, entries: np.ndarray, goals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids on the best paths from the entries to the goals, segment after segment, and their number in each."""
        path = np.full(len(lat.codes), _OFF, np.int64)
        at, origin = lat.starts + goals, lat.starts + entries
        while True:
            going = at > origin
            at, origin = at[going], origin[going]
            if not len(at):
                break
            edge = last[at]
            at = lat.source[edge]
            path[at] = lat.piece[edge]
        on = np.flatnonzero(path != _OFF)
        ids, codes = path[on], lat.codes[on]
        raw = ids == _BYTES
        n = np.where(raw, _utf8_size(codes), 1)
        out = np.repeat(ids, n)
        text = codes[raw].tobytes().decode("utf-32-le", "surrogatepass").replace(LITERAL, SPACE)
        out[out == _BYTES] = self.byte[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        per = np.bincount(np.searchsorted(lat.starts, on, "right") - 1, n, len(lat.starts)).astype(np.int64)
        return out.astype(np.int32), per

    def solve(self, segments: list[str], entries: np.ndarray, goals: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, their number and the score of each segment, between its entry and its goal."""
        got = []
        for a, b in runs(segments, BLOCK):
            lat = self.lattice(segments[a:b], stops[a:b])
            best, last = self.paths(lat, entries[a:b])
            got.append((*self.trace(lat, last, entries[a:b], goals[a:b]), best[lat.starts + goals[a:b]]))
        if not got:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def _learn(self, units: list[str]) -> None:
        """Adds units to the cache."""
        whole = [SPACE + u for u in units]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        ids, n, scores = self.solve(whole, np.zeros_like(sizes), sizes, sizes)
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(n) - n))
        self.ids, self.n_ids, self.scores = np.concatenate((self.ids, ids)), np.concatenate((self.n_ids, n)), np.concatenate((self.scores, scores))
        self.chars += int(sizes.sum())

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids and score of each marked text (empty, or beginning with a space), by its units."""
        units: list[str] = []
        per = []
        for x in texts:
            own = _UNIT.findall(x) if SPACE * 2 in x else x.split(SPACE)[1:]
            units += own
            per.append(len(own))
        new = set(units).difference(self.number)
        if self.number and (len(self.number) + len(new) > CACHE or self.chars + sum(map(len, new)) > CACHE_CHARS):
            self.forget()
            new = set(units)
        if new:
            self._learn(list(new))
        number = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        n = self.n_ids[number]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.at[number] - ends[:-1], n) + np.arange(ends[-1])]
        edges = np.concatenate(([0], np.cumsum(per))).astype(np.int64)
        scores = np.concatenate(([0], np.cumsum(self.scores[number])))[edges]
        return np.split(ids, ends[edges[1:-1]]) if texts else [], np.diff(scores)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


@lru_cache(2)
def vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary(path)


def runs(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about `limit` characters, one text at least."""
    start = held = 0
    for i, x in enumerate(texts):
        if i > start and held + len(x) > limit:
            yield start, i
            start, held = i, 0
        held += len(x)
    if texts:
        yield start, len(texts)


def marked(text: str | None) -> str:
    return SPACE + remarked(text) if text else ""


def remarked(text: str) -> str:
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


def unmarked(text: str) -> bytes:
    return text.replace(SPACE, " ").replace(LITERAL, SPACE).encode("utf-8", "surrogatepass")


def ends(chunk: str) -> tuple[int, int]:
    """Where the first unit of a chunk ends and where its last one starts (0 and 0 if one unit fills it). A run of spaces that
    the chunk starts in may have begun before it and starts no unit here."""
    first = re.search(f"(?<=[^{SPACE}]){SPACE}", chunk)
    if not first:
        return 0, 0
    last = len(chunk)
    while True:
        last = chunk.rfind(SPACE, 0, last)
        if chunk[last - 1] != SPACE:
            return first.start(), last


@dataclass(frozen=True)
class Part:
    """A chunk by its ends: `head` is its first unit, `tail` its last one and what follows; if one unit fills it, `head` is the
    chunk and what follows, `tail` is None. `stop`: characters of the last of them that are the chunk's own."""

    head: str
    middle: str
    tail: str | None
    stop: int


def part_of(chunk: str, ahead: str) -> Part:
    u0, u1 = ends(chunk)
    return Part(chunk[:u0], chunk[u0:u1], chunk[u1:] + ahead, len(chunk) - u1) if u0 else Part(chunk + ahead, "", None, len(chunk))


def matrices(v: Vocabulary, parts: list[Part], middles: np.ndarray) -> np.ndarray:
    """Transfer matrices (parts, states, states): entered in state i, left to the next chunk in state j; the text's end is
    state 0. middles: scores of the middles."""
    k = v.longest
    out = np.full((len(parts), k, k), NONE, np.int64)
    heads = [p.head for p in parts]
    stops = np.array([len(p.head) if p.tail is not None else p.stop for p in parts], np.int64)
    for a, b in runs(heads, BLOCK // 2):
        lat = v.lattice(heads[a:b], stops[a:b])
        best = v.all_entries(lat)
        for i, at, stop, size in zip(range(a, b), lat.starts, stops[a:b], lat.sizes, strict=True):
            if parts[i].tail is None:
                n = min(k, size - stop + 1)
                out[i, :, :n] = best[at + stop : at + stop + n].T
            else:
                out[i, :, 0] = best[at + stop]
    cut = [i for i, p in enumerate(parts) if p.tail is not None]
    tails = [parts[i].tail for i in cut]
    for a, b in runs(tails, BLOCK):
        stops = np.array([parts[i].stop for i in cut[a:b]], np.int64)
        lat = v.lattice(tails[a:b], stops)
        best, _ = v.paths(lat, np.zeros(b - a, np.int64))
        for i, at, stop, size in zip(cut[a:b], lat.starts, stops, lat.sizes, strict=True):
            n = min(k, size - stop + 1)
            leave = np.full(k, NONE, np.int64)
            leave[:n] = best[at + stop : at + stop + n]
            m = out[i, :, :1] + middles[i] + leave
            out[i] = np.where((out[i, :, :1] == NONE) | (leave == NONE), NONE, m)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product; what cannot be reached stays so."""
    c = (a[:, :, None] + b[None]).max(1)
    c[c < NONE // 2] = NONE
    return c


def chain(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The states before each matrix and after the last on the best way from `entry` to `leave`."""
    score = [np.full(matrices[0].shape[0], NONE, np.int64)]
    score[0][entry] = 0
    for m in matrices:
        s = (score[-1][:, None] + m).max(0)
        s[s < NONE // 2] = NONE
        score.append(s)
    states = [leave]
    for s, m in zip(score[-2::-1], matrices[::-1], strict=True):
        states.append(int(np.argmax(s + m[:, states[-1]])))
    return states[::-1]


def traced(v: Vocabulary, parts: list[Part], entries: list[int], leaves: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each part, between its two states: ids before its middle, ids after it, and both scores together."""
    heads = [p.head for p in parts]
    entry, leave = np.array(entries, np.int64), np.array(leaves, np.int64)
    stops = np.array([len(p.head) if p.tail is not None else p.stop for p in parts], np.int64)
    goals = np.array([len(p.head) if p.tail is not None else p.stop + j for p, j in zip(parts, leaves, strict=True)], np.int64)
    ids, n, score = v.solve(heads, entry, goals, stops)
    before = np.split(ids, np.cumsum(n)[:-1])
    cut = [i for i, p in enumerate(parts) if p.tail is not None]
    stops = np.array([parts[i].stop for i in cut], np.int64)
    ids, n, more = v.solve([parts[i].tail for i in cut], np.zeros(len(cut), np.int64), stops + leave[cut], stops)
    after = dict(zip(cut, np.split(ids, np.cumsum(n)[:-1]), strict=True)) if cut else {}
    score[cut] += more
    return [(b, after.get(i, np.empty(0, np.int32)), int(s)) for i, (b, s) in enumerate(zip(before, score, strict=True))]


_OUT = "doc_id string, row long, chunk long, ids array<int>, score long, lossless boolean"
_PARTS = "doc_id string, row long, chunk long, groups long, g long, m array<long>, head string, tail string, stop int, ids array<int>, score long, lossless boolean"


def encode(spark: SparkSession, docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """doc_id, row, chunk, ids, score, lossless (the decoded ids equal the text): a row for each chunk of each document, one
    for a text of no pieces. A chunk's ids are those of the pieces that start in it."""
    shared_dir(spark)
    if chunk < vocabulary(model).longest:
        raise ValueError("a chunk must hold the longest piece")
    long_ = F.length("text") >= chunk
    texts = with_id_text(docs.select("doc_id", "text"))

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for part in pieces(frames, "text", BATCH):
            ids, scores = v.encode([marked(t) for t in part["text"]])
            same = [v.decode(i)[1:] == (t or "").encode("utf-8", "surrogatepass") for i, t in zip(ids, part["text"], strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "row": part["row"].to_numpy(), "chunk": 0, "ids": ids, "score": scores, "lossless": same})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        k = v.longest - 1

        def out(rows: list[tuple], parts: list[Part]) -> pd.DataFrame:
            ids, scores = v.encode([p.middle for p in parts])
            m = matrices(v, parts, scores)
            own = pd.DataFrame(rows, columns=["doc_id", "row", "chunk", "groups"])
            return own.assign(
                g=own["chunk"] // group, m=[x.ravel() for x in m], head=[unmarked(p.head).decode() for p in parts], tail=[None if p.tail is None else unmarked(p.tail).decode() for p in parts],
                stop=[p.stop for p in parts], ids=ids, score=scores, lossless=[v.decode(i) == unmarked(p.middle) for i, p in zip(ids, parts, strict=True)],
            )

        rows, parts = [], []
        for part in pieces(frames, "text", BATCH):
            for doc_id, row, text in zip(part["doc_id"], part["row"], part["text"], strict=True):
                whole = marked(text)
                n = -(-len(whole) // chunk)
                for c in range(n):
                    rows.append((doc_id, row, c, -(-n // group)))
                    parts.append(part_of(whole[c * chunk : (c + 1) * chunk], whole[(c + 1) * chunk : (c + 1) * chunk + k]))
                    if len(parts) * chunk >= BATCH:
                        yield out(rows, parts)
                        rows, parts = [], []
        if parts:
            yield out(rows, parts)

    square = lambda m: [np.asarray(x, np.int64).reshape(vocabulary(model).longest, -1) for x in m]

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        ms = square(frame["m"])
        out = ms[0]
        for m in ms[1:]:
            out = product(out, m)
        return pd.DataFrame({"row": frame["row"].iloc[:1], "g": frame["g"].iloc[:1], "m": [out.ravel()]})

    def of_groups(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("g")
        states = chain(square(frame["m"]), 0, 0)
        return pd.DataFrame({"row": frame["row"], "g": frame["g"], "entry": states[:-1], "leave": states[1:]})

    def of_chunks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        states = chain(square(frame["m"]), int(frame["entry"].iloc[0]), int(frame["leave"].iloc[0]))
        return pd.DataFrame({"row": frame["row"], "chunk": frame["chunk"], "entry": states[:-1], "leave": states[1:]})

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for frame in pieces(frames, "head", BATCH):
            parts = [Part(remarked(h), "", None if t is None else remarked(t), s) for h, t, s in zip(frame["head"], frame["tail"], frame["stop"], strict=True)]
            ids, scores, same = [], [], []
            entries, leaves = frame["entry"].tolist(), frame["leave"].tolist()
            for p, i, j, (before, after, s), middle, score, ok in zip(parts, entries, leaves, traced(v, parts, entries, leaves), frame["ids"], frame["score"], frame["lossless"], strict=True):
                if p.tail is None:
                    ok = ok and v.decode(before) == unmarked(p.head[i : p.stop + j])
                else:
                    ok = ok and v.decode(before) == unmarked(p.head[i:]) and v.decode(after) == unmarked(p.tail[: p.stop + j])
                ids.append(np.concatenate((before, middle, after)).astype(np.int32))
                scores.append(s + score)
                same.append(ok)
            yield frame[["doc_id", "row", "chunk"]].assign(ids=ids, score=scores, lossless=same)

    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    one = numbered.where(~long_ | F.col("text").isNull()).withColumn("row", -1 - F.col("row")).mapInPandas(short, _OUT)
    parts = written(numbered.where(long_).mapInPandas(cut, _PARTS), "parts")
    moves = parts.select("row", "chunk", "groups", "g", "m")
    # a text of one group is entered and left in state 0
    several = moves.where("groups > 1")
    by_group = several.groupBy("row", "g").applyInPandas(products, "row long, g long, m array<long>")
    states = by_group.groupBy("row").applyInPandas(of_groups, "row long, g long, entry int, leave int")
    placed = several.join(states, ["row", "g"]).unionByName(moves.where("groups = 1").withColumns({"entry": F.lit(0), "leave": F.lit(0)}))
    bounds = placed.groupBy("row", "g").applyInPandas(of_chunks, "row long, chunk long, entry int, leave int")
    return with_id(one.unionByName(parts.drop("m", "g", "groups").join(bounds, ["row", "chunk"]).mapInPandas(trace, _OUT)))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, row, text of whole documents from their chunks' ids."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        v, frame = vocabulary(model), frame.sort_values("chunk")
        raw = b"".join(v.decode(ids) for ids in frame["ids"])
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1], "row": frame["row"].iloc[:1], "text": [raw[1:].decode("utf-8", "surrogatepass")]})

    return with_id(with_id_text(encoded).groupBy("row").applyInPandas(join, "doc_id string, row long, text string"))


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score, ids_hash (of the ids in order, by chunk), lossless for each document."""
    each = encoded.select("doc_id", "row", "chunk", "score", "lossless", F.size("ids").alias("n"), F.xxhash64("ids").alias("h"))
    parts = each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("score").alias("score"), F.xxhash64(F.sort_array(F.collect_list(F.struct("chunk", "h")))).alias("ids_hash"), F.bool_and("lossless").alias("lossless")
    )
    return parts.drop("row")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(spark, documents(spark, sf_dir)))


QUERIES = {"op7_pieces": op7_pieces}
SQL: dict[str, str] = {}
