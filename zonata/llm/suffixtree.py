"""Language-model scoring by a probabilistic suffix tree over the bytes of words, beside a smoothed unigram base over words.

A text is its lower-cased (ASCII) words and one end. A word's symbols are its bytes and a space; the end's only symbol is END.
Each symbol is told from the bytes before it: those of its word, the space before the word and the last TAIL bytes of the word
before that (together a unit). So a text's log probability is the sum over its units. Symbol counts after every context of up to DEPTH bytes are gathered from the units of all training texts. Contexts of up to SHORT bytes that occur LEAST times stay; longer ones
stay if they occur LEAST times and if a likelihood-ratio test tells their next-symbol distribution from that of their suffix
(neither scales with the corpus, so the tree grows with the input); all suffixes of a kept context are kept. Distributions are
smoothed towards the suffix's, and each symbol is scored after the longest kept suffix of what stands before it.

Contexts that end in the same TOGETHER bytes make a subtree of their own but for its shortest contexts. Rows of (context, symbol)
are dealt out and sorted by the reversed context, so a task grows and applies whole subtrees at once; the counts after contexts
of up to SHORT bytes, of which there are at most 256 ** (SHORT + 1), are broadcast. A subtree's size is bounded by the bytes that
are left free, 256 ** (DEPTH - TOGETHER + 1) at most, not by the input. Probabilities of the most frequent grams and counts
of frequent words are looked up in broadcast tables of bounded size, those of all others are joined.

Defined results: null and empty texts are the end alone. With no training rows counts are 0 and the tree is a uniform root.
Repeated rows get a row each. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches, discard, documents, hashed_part, pieces, shared_dir, with_id_text, written

#: Bytes of the longest context, of the contexts that every task has, and by which subtrees are dealt out.
DEPTH, SHORT, TOGETHER, END = 6, 2, 3, b"\n"
#: Bytes of the word before that a unit begins with.
TAIL = 2
#: Least count of a context; standard deviations by which 2 * gain must be over its mean (the degrees of freedom) under no divergence.
LEAST, DEVIATIONS = 4, 3.0
#: Weight of the suffix's distribution, in counts; counts that each symbol has in the root beforehand.
MU, _ROOT = 4.0, 0.5
#: Grams of which probabilities are broadcast, at most; those are the most frequent ones. All others are joined.
USUAL = 1_500_000
#: Words of at least this share of the training tokens (so 1 / FREQUENT at most) are broadcast, others joined.
FREQUENT = 1e-6
#: Rows that a task takes at once, but for the rest of the last subtree.
BLOCK = 250_000
#: Characters that are cut into grams or words at once; grams that a task holds before it sums them up and different words before
#: it puts them out; different grams that it puts out in one frame. Rows and bytes that a Python worker gets at once. A worker's memory counts beside
#: the JVM's, whose heap can grow to its limit.
CHARS, HELD, WORDS, PUT, ROWS, BYTES = 1_000_000, 2_500_000, 250_000, 100_000, 2_000, 4_000_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _told_apart(docs: DataFrame, learn: Column) -> DataFrame:
    return docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn"))


def word_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """word (binary; END for the end) of all texts, n: occurrences in the texts to learn from."""

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learnt: Counter[bytes] = Counter()
        others: Counter[bytes] = Counter()
        for part in chain(pieces(frames, "text", CHARS), [None]):
            if part is not None:
                for t, learn in zip(part["text"], part["learn"], strict=True):
                    (learnt if learn else others).update([*tokens(t), END])
            if part is None or len(learnt) + len(others) > WORDS:
                yield pd.DataFrame({"word": [*learnt, *others], "n": [*learnt.values(), *([0] * len(others))]})
                learnt.clear()
                others.clear()

    return _told_apart(docs, learn).mapInPandas(words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A code for each symbol of the texts, one text after another, and the number of symbols of each. A code holds the DEPTH
    bytes before the symbol, the last one first, and the symbol; spaces stand before a unit's start."""
    whole = [b" " * 7 + b" ".join([*tokens(t), END]) for t in texts]
    sizes = np.fromiter(map(len, whole), np.int64, len(whole)) - 7
    if not whole:
        return np.empty(0, np.int64), sizes
    b = np.frombuffer(b"".join(whole), np.uint8)
    # eight bytes up to each symbol at once, the symbol in the highest place
    codes = np.ndarray(len(b) - 7, "<u8", b.data, strides=(1,))
    codes = codes << np.uint64(8) >> np.uint64(8 * (8 - DEPTH)) << np.uint64(8) | codes >> np.uint64(56)
    first = np.flatnonzero((b[7:] != 32) & (b[6:-1] == 32))  # codes of the words' first symbols
    length = np.diff(first, append=first[-1] + 1)
    tail, on = np.zeros(len(first), np.int8), np.ones(len(first), bool)
    for k in range(TAIL):
        on &= b[first + 5 - k] != 32
        tail += on
    for t in range(TAIL + 1):
        for j in range(DEPTH - t - 1):
            at = first[(tail == t) & (length > j)] + j
            before = 8 * (DEPTH - t - 1 - j) + 8  # all above the symbol and below this bit stands before the unit
            codes[at] = codes[at] >> np.uint64(before) << np.uint64(before) | codes[at] & np.uint64(255) | np.uint64(0x2020202020202000 & (1 << before) - 1)
    keep = np.ones(len(codes), bool)
    for k in range(7):
        keep[np.cumsum(sizes + 7)[:-1] - 7 + k] = False
    return codes[keep].view(np.int64), sizes


def summed(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different codes in order, and the sums of their counts."""
    if not len(codes):
        return codes, *counts
    if not (codes[1:] >= codes[:-1]).all():
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], tuple(c[order] for c in counts)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], *(np.add.reduceat(c, at) for c in counts)


def gathered_up(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """As `summed`, in no order."""
    at, different = pd.factorize(codes)
    # counts are whole numbers below 2 ** 53
    return different, *(np.bincount(at, c, len(different)).astype(np.int64) for c in counts)


def counted(codes: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different codes in order, how often each occurs, and how often where learn is true."""
    both = np.sort(codes << 1 | learn)
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    n = np.diff(at, append=len(both))
    both = both[at]
    return summed(both >> 1, n, n * (both & 1))


def gram_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """gram, u (occurrences in all texts), n (in the texts to learn from), summed by task alone."""

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in chain(pieces(frames, "text", CHARS), [None]):
            if part is not None:
                codes, sizes = grams(part["text"])
                held.append(counted(codes, np.repeat(part["learn"].to_numpy(bool), sizes)))
                del codes, sizes
            if held and (part is None or sum(len(h[0]) for h in held) > HELD):
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                held.append(gathered_up(*whole))
                del whole
                if part is None or 5 * len(held[0][0]) > 3 * HELD:
                    put = held.pop()
                    for at in range(0, len(put[0]), PUT):
                        yield pd.DataFrame(dict(zip(("gram", "u", "n"), (c[at : at + PUT] for c in put), strict=True)))

    return _told_apart(docs, learn).mapInPandas(gathered, "gram long, u long, n long")


@dataclass(frozen=True)
class Base:
    """The tree down to SHORT bytes: counts by context and by gram, and the probabilities of all symbols by context."""

    contexts: np.ndarray  # of SHORT bytes, in order
    sums: np.ndarray
    kinds: np.ndarray
    grams: np.ndarray  # context and symbol, in order
    counts: np.ndarray
    after: np.ndarray  # (contexts, 256)
    shorter: np.ndarray  # (256, 256): after one byte

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Base:
        keys, counts = summed(keys[counts > 0], counts[counts > 0])
        symbol, last = keys & 255, keys >> 16 & 255
        root = np.bincount(symbol, counts, 256) + _ROOT
        root /= root.sum()
        one = np.bincount(last << 8 | symbol, counts, 1 << 16).reshape(256, 256)
        n = one.sum(1, keepdims=True)
        shorter = np.where(n >= LEAST, (one + MU * root) / (n + MU), root)
        contexts, at, inverse, kinds = np.unique(keys >> 8, return_index=True, return_inverse=True, return_counts=True)
        sums = np.add.reduceat(counts, at) if len(at) else counts
        two = np.zeros((len(contexts), 256))
        two[inverse, symbol] = counts
        up = shorter[contexts >> 8 & 255]
        return cls(contexts, sums, kinds, keys, counts, np.where(sums[:, None] >= LEAST, (two + MU * up) / (sums[:, None] + MU), up), shorter)

    def probabilities(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out = self.shorter[contexts >> 8 & 255, symbols]
        if len(self.contexts):
            at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
            there = self.contexts[at] == contexts
            out[there] = self.after[at[there], symbols[there]]
        return out


def levels(codes: np.ndarray, n: np.ndarray, base: Base) -> np.ndarray:
    """The probability of each gram's symbol after the longest kept suffix of its context; codes: different, in order, whole
    subtrees; n: their counts in the training texts."""
    symbol, short = codes & 255, codes >> 8 * (DEPTH - SHORT) + 8
    if not len(codes):
        return np.empty(0)
    found = []
    for d in range(SHORT + 1, DEPTH + 1):
        ctx = codes >> 8 * (DEPTH - d) + 8
        start = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(codes))))
        key, first, entry = np.unique(run << 8 | symbol, return_index=True, return_inverse=True)
        count = np.bincount(entry, n, len(key))
        sums = np.add.reduceat(n, start).astype(float)
        kinds = np.bincount(key >> 8, count > 0, len(start))
        if d == SHORT + 1:
            at = np.searchsorted(base.grams, short[first] << 8 | symbol[first])
            up = np.where(count > 0, base.counts[np.minimum(at, len(base.counts) - 1)], 0) if len(base.counts) else count
            at = np.minimum(np.searchsorted(base.contexts, short[start]), max(0, len(base.contexts) - 1))
            sums_up, df = (base.sums[at], base.kinds[at] - 1.0) if len(base.contexts) else (sums, -1.0 + 0 * sums)
        else:
            run_up, _, entry_up, count_up, above, kinds_up, _ = found[-1]
            up, sums_up, df = count_up[entry_up[first]], above[run_up[start]], kinds_up[run_up[start]] - 1.0
        here = count > 0
        gain = np.bincount(key[here] >> 8, count[here] * np.log(count[here] / up[here]), len(start)).astype(float)
        often = sums >= LEAST
        gain[often] += sums[often] * np.log(sums_up[often] / sums[often])
        keep = often & (df > 0) & (2 * gain >= df + DEVIATIONS * np.sqrt(2 * np.maximum(df, 0)))
        found.append((run, start, entry, count, sums, kinds, keep))
    for (run_up, *_, keep_up), (_, start, *_, keep) in zip(found[-2::-1], found[:0:-1], strict=True):
        np.logical_or.at(keep_up, run_up[start], keep)
    p = base.probabilities(short, symbol)
    for run, _, entry, count, sums, _, keep in found:
        p = np.where(keep[run], (count[entry] + MU * p) / (sums[run] + MU), p)
    return p


@dataclass(frozen=True)
class Table:
    """Open addressing: a key of up to 63 bits to a float. Each slot holds a key (-1: free) beside the bits of its value."""

    slots: np.ndarray

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.slots).bit_length() - 1
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        slots = np.zeros((1 << max(4, int(np.ceil(np.log2(2 * len(keys) + 1)))), 2), np.int64)
        slots[:, 0] = -1
        out = cls(slots)
        keys, values = np.ascontiguousarray(keys, np.int64), np.ascontiguousarray(values, np.float64).view(np.int64)
        left, at = np.arange(len(keys)), out._slot(keys)
        while len(left):
            free = slots[at[left], 0] == -1
            first = np.unique(at[left[free]], return_index=True)[1]
            put = left[free][first]
            slots[at[put], 0], slots[at[put], 1] = keys[put], values[put]
            left = left[slots[at[left], 0] != keys[left]]
            at[left] = (at[left] + 1) & (len(slots) - 1)
        return out

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 if not)."""
        there, values = np.zeros(len(keys), bool), np.zeros(len(keys))
        for start in range(0, len(keys), 1 << 17):  # what a processor keeps close
            part = keys[start : start + (1 << 17)]
            at = self._slot(part)
            got = self.slots.take(at, 0)
            hit = got[:, 0] == part
            there[start : start + len(part)] = hit
            values[start : start + len(part)] = np.where(hit, got[:, 1].copy().view(np.float64), 0.0)
            left = np.flatnonzero(~hit & (got[:, 0] != -1))
            while len(left):
                at[left] = (at[left] + 1) & (len(self.slots) - 1)
                got = self.slots.take(at[left], 0)
                hit = got[:, 0] == part[left]
                there[start + left[hit]], values[start + left[hit]] = True, got[hit, 1].copy().view(np.float64)
                left = left[~hit & (got[:, 0] != -1)]
        return there, values


def base_of(counts: DataFrame) -> Base:
    """counts: gram, n."""
    key = F.shiftright("gram", 8 * (DEPTH - SHORT + 1)) * 256 + F.col("gram").bitwiseAND(F.lit(255))
    short = counts.groupBy(key.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    return Base.of(short["gram"].to_numpy(), short["n"].to_numpy())


def probabilities(spark: SparkSession, docs: DataFrame, learn: Column) -> DataFrame:
    """gram, u, lp: the log10 probability of each gram of the texts by the tree that those to learn from grow."""
    # dealt out by subtrees; the sums over the tasks' counts are made where these are grown
    dealt = gram_counts(docs, learn).repartition(F.shiftright("gram", 8 * (DEPTH - TOGETHER + 1))).sortWithinPartitions("gram")
    with batches(spark, ROWS, BYTES):
        counts = written(dealt.mapInPandas(_subtrees, "gram long, u long, n long"), "grams")
    base = spark.sparkContext.broadcast(base_of(counts))

    def grown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _subtrees(frames):
            codes = part["gram"].to_numpy()
            yield pd.DataFrame({"gram": codes, "u": part["u"].to_numpy(), "lp": np.log10(levels(codes, part["n"].to_numpy(), base.value))})

    again = counts.repartition(F.shiftright("gram", 8 * (DEPTH - TOGETHER + 1))).sortWithinPartitions("gram")
    with batches(spark, ROWS, BYTES):
        out = written(again.mapInPandas(grown, "gram long, u long, lp double"), "probabilities")
    discard(counts)
    return out


def _subtrees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of gram, summed by gram and in blocks of whole subtrees."""
    names, held = ("gram", "u", "n"), []
    for frame in frames:
        held.append(tuple(frame[c].to_numpy() for c in names))
        if sum(len(h[0]) for h in held) >= BLOCK:
            codes, *counts = summed(*map(np.concatenate, zip(*held, strict=True)))
            tree = codes >> 8 * (DEPTH - TOGETHER + 1)
            cut = int(np.searchsorted(tree, tree[-1]))  # the last subtree may go on
            held = [(codes[cut:], *(c[cut:] for c in counts))]
            if cut:
                yield pd.DataFrame(dict(zip(names, (codes[:cut], *(c[:cut] for c in counts)), strict=True)))
    if held:
        yield pd.DataFrame(dict(zip(names, summed(*map(np.concatenate, zip(*held, strict=True))), strict=True)))


def usual_grams(told: DataFrame) -> float:
    """Least occurrences of a gram at which USUAL grams at most have as many, to a tenth."""
    step = F.floor(F.log(F.greatest("u", F.lit(1))) / F.log(F.lit(1.1)))
    held = 0
    for r in told.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > USUAL:
            return 1.1 ** (r["step"] + 1)
    return 0.0


def score(spark: SparkSession, docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs; learn: whether a row is learned from."""
    shared_dir(spark)
    with batches(spark, ROWS, BYTES):
        counts = written(word_counts(docs, learn), "words")
    n_all, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    frequent = (F.col("n") > 0) & (F.col("n") >= FREQUENT * n_all)
    usual = counts.where(frequent).toArrow()
    told = probabilities(spark, docs, learn)
    often = F.col("u") >= usual_grams(told)
    top = told.where(often).select("gram", "lp").toArrow()
    words = {w: n for w, n in zip(usual["word"].to_pylist(), usual["n"].to_pylist(), strict=True)}
    sent = spark.sparkContext.broadcast((words, Table.of(top["gram"].to_numpy(), top["lp"].to_numpy())))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table = sent.value
        for part in pieces(frames, "text", 1_000_000):
            own = [[*tokens(t), END] for t in part["text"]]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            starts = np.cumsum(lengths) - lengths
            n = np.fromiter(map(known.get, chain.from_iterable(own), repeat(0)), np.int64, lengths.sum())
            base, is_known = np.where(n > 0, np.log10(n + 0.1), 0.0), n > 0
            codes, sizes = grams(part["text"])
            there, lp = table.get(codes)
            first, rare, grams_left = np.cumsum(sizes) - sizes, [], []
            for i, (at, k, code, m) in enumerate(zip(starts, lengths, first, sizes, strict=True)):
                rare.append(Counter([own[i][j] for j in np.flatnonzero(~is_known[at : at + k]).tolist()]))
                grams_left.append(np.unique(codes[code : code + m][~there[code : code + m]], return_counts=True))
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "row": part["row"].to_numpy(), "n_tokens": lengths, "n_usual": np.add.reduceat(is_known.astype(np.int64), starts),
                "usual": np.add.reduceat(base, starts), "score": np.add.reduceat(lp, first), "rare": [list(r.keys()) for r in rare], "times": [list(r.values()) for r in rare],
                "grams": [g for g, _ in grams_left], "seen": [c for _, c in grams_left],
            })

    schema = "doc_id string, row long, n_tokens long, n_usual long, usual double, score double, rare array<binary>, times array<int>, grams array<long>, seen array<int>"
    with batches(spark, ROWS, BYTES):
        first = written(with_id_text(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id()).mapInPandas(scored, schema), "scored")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    looked = rare.join(counts.where(~frequent), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    left = first.select("row", F.explode(F.arrays_zip("grams", "seen")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.seen").alias("seen"))
    left = left.join(told.where(~often).select("gram", "lp"), "gram").groupBy("row").agg(F.sum(F.col("seen") * F.col("lp")).alias("rare_lp"))
    per = F.lit(float(np.log10(n_all + 0.1 * (v + 1))))
    return first.drop("rare", "times", "grams", "seen").join(looked, "row", "left").join(left, "row", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", (F.col("n_usual") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("usual") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * per).alias("base_score"),
        (F.col("score") + F.coalesce("rare_lp", F.lit(0.0))).alias("score"),
    )


def op8_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), hashed_part("doc_id", 10) == 0
    out = score(spark, docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_score": op8_score}
SQL: dict[str, str] = {}
