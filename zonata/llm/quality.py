"""Quality rules as a ledger: every rule is evaluated once, policies are masks over the stored bits.

`ledger` stores each document's measurements and one bit for each failed rule. `apply_policy` decides by a mask of bits, so a
new policy version reads no text. `ablations` counts, for each rule, what it alone rejects, by bitwise aggregation.

Defined results: null and empty texts have no words and fail `few_words`; repeated rows get a row each; an empty table gives no
rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, pieces, with_id, with_id_text, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules in the order of their bits: name and the condition under which a document fails, over the measurements.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules of which none may fail.
POLICIES = {1: ("few_words", "repeated_words"), 2: tuple(BIT)}
CURRENT = 2
BASE = POLICIES[1]


def mask(rules: tuple[str, ...]) -> int:
    return sum(BIT[r] for r in rules)


def _repeated(ids: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    a = ids.astype(np.int64)
    keys = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def _measure(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at ASCII white space alone
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) >= 1 << 21:  # window keys hold 21 bits a word; beyond, number the pairs of words first
        _, pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)
        _, repeat = np.unique((pair[:-1] << 32) | ids[2:], return_inverse=True)
        n = np.bincount(repeat)[repeat] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(ids) - 2 + k] |= n
        repeated = int(covered.sum())
    else:
        repeated = _repeated(ids)
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    n_lines = sum(lines.values())
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return len(words), len(text) - spaces, symbols, n_lines - len(lines), repeated, n_lines


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in pieces(frames, "text", 8_000_000):
        rows = [_measure(t or "") for t in part["text"]]
        yield pd.DataFrame(rows, columns=list(MEASURES)).assign(doc_id=part["doc_id"].to_numpy())


def failed_bits() -> Column:
    return sum((F.when(F.expr(cond), F.lit(BIT[name])).otherwise(0) for name, cond in RULES), F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed (long): bit i is set if rule i fails."""
    schema = "doc_id string, " + ", ".join(f"{m} long" for m in MEASURES)
    return with_id(with_id_text(docs.select("doc_id", "text")).mapInPandas(_measured, schema)).withColumn("failed", failed_bits())


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with kept (boolean) by that version's mask, and the version."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0).withColumn("policy", F.lit(version))


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """rule, n_failed, n_alone: documents that fail a rule of the policy, and those that no other of its rules rejects."""
    m = mask(POLICIES[version])
    seen = F.col("failed").bitwiseAND(F.lit(m))
    by_bits = book.groupBy(seen.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[version]))).alias("r")
    one = by_bits.select("bits", "n", rules).withColumn("hit", F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return one.groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_alone"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(written(ledger(documents(spark, sf_dir)), "ledger"))
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed")


QUERIES = {"op2_quality": op2_quality}
SQL = {
    "op2_quality": r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
t as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i+1], words[i+2]) as n from t),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i+1, i+2]) as p from g where n > 1) group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
d as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from w left join r using (doc_id) left join d using (doc_id)),
f as (select *, cast((case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
  + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 2 * n_dup_lines > n_lines then 8 else 0 end)
  + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 15 * n_words then 32 else 0 end) as bigint) as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, failed = 0 as kept, failed from f
"""
}
