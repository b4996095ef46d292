import hashlib
import random

import pytest

from zonata.llm import warc as W

SCHEMA = "page_id long, url string, html string"
COLUMNS = ["payload_bytes", "payload_digest", "record_type", "refers_to"]


def record(payload, page, kind="response", length=None):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{page}>\r\nX-Page-Id: {page}\r\nContent-Type: text/plain\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


FAKE = record(b"inner payload", 777).decode()


def pages():
    rng = random.Random(2)
    texts = ["<p>" + "x" * rng.randrange(300) + "</p>" for _ in range(30)]
    texts += [None, "", "\r\n", "\r\n\r\n", "a\r\n", "a\r", "a\r\n\r\n\r\n", "\r\n\r\nb", "WARC/1.", "WARC/1.1\r\n", "xWARC/1.WARC/1.1\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc", "WWARC/1.", "WARC/1" * 30, "ü漢🎉" * 40]
    texts += [FAKE, f"before\r\n\r\n{FAKE}after", FAKE * 3, "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", f"{FAKE}{FAKE[:40]}", "WARC/1.0\r\n" * 50, "z" * 20000 + FAKE + "y" * 9000]
    texts += ["same " * 30] * 5 + [("same " * 30).strip(), "short"] * 2 + ["w" * 99] * 2 + ["w" * 100] * 2 + [f"{FAKE * 2}same"] * 3
    rng.shuffle(texts)
    return [(k * 7 % 1000, None if k % 5 == 0 else f"http://h{k % 3}/{k} \r\nx", t) for k, t in enumerate(texts)]


def brute(rows):
    first = {}
    for i, _, t in sorted(rows):
        first.setdefault(t or "", i)
    out = {}
    for i, _, t in rows:
        raw = (t or "").encode()
        again = len(raw) >= 100 and first[t] != i
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[t] if again else None)
    return out


@pytest.mark.parametrize("split", [0, 13, 1 << 20])
def test_against_brute_force(spark, split):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(2 if split else 1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        path = f"{W.shared_dir(spark)}/warc-test-{split}"
        W.write(spark, df, path)
        size = max(f.stat().st_size for f in _files(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 24 + split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = W.read(spark, path).collect()
        placed = W.scan(spark, path)
        assert W.broken(placed, W.chained(spark, placed)).count() == 0
        splits = placed.select("file", "split").distinct().count()
        assert splits > 8 or split > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, kind, refers = want[r["page_id"]]
        assert (r["record_type"], r["declared"]) == (kind, f"sha256:{sha}")
        assert (r["payload_bytes"], r["payload_digest"]) == ((n, sha) if kind == "response" else (0, hashlib.sha256(b"").hexdigest()))
    # the archive itself, record by record as a sequential reader sees it
    assert sum(len(sequential(f.read_bytes())) for f in _files(path)) == len(rows)


def _files(path):
    from pathlib import Path

    return sorted(Path(path.removeprefix("file://")).glob("part-*"))


def sequential(raw):
    at, found = 0, []
    while at < len(raw):
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        found.append(fields)
        at += len(head) + 4 + int(fields[b"Content-Length"]) + 4
        assert raw[at - 4 : at] == b"\r\n\r\n"
    return found


def test_round_trip(spark):
    rows = pages()
    got = {r["page_id"]: tuple(r[c] for c in COLUMNS) for r in W.round_trip(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows)


def test_foreign_and_damaged_archives(spark, tmp_path):
    good = [record(b"one", 1), record(b"two WARC/1.0\r\n\r\n", 2, "resource"), record(FAKE.encode() * 2, 3)]
    (tmp_path / "whole.warc").write_bytes(b"".join(good))
    (tmp_path / "cut.warc").write_bytes(b"".join(good[:2]) + record(b"x" * 50, 4, length=500))
    (tmp_path / "gap.warc").write_bytes(good[0] + b"junk" + good[1])
    (tmp_path / "loop.warc").write_bytes(b"no record first " + good[0])
    (tmp_path / "empty.warc").write_bytes(b"")
    got = sorted((r["file"].rsplit("/", 1)[1], r["page_id"], r["payload_bytes"], r["record_type"]) for r in W.read(spark, str(tmp_path)).collect())
    assert [g for g in got if g[0] == "whole.warc"] == [("whole.warc", 1, 3, "response"), ("whole.warc", 2, 16, "resource"), ("whole.warc", 3, 2 * len(FAKE), "response")]
    assert [g[:2] for g in got if g[0] == "gap.warc"] == [("gap.warc", 1)]
    assert [g[1] for g in got if g[0] == "cut.warc"][:2] == [1, 2]
    assert not [g for g in got if g[0] in ("loop.warc", "empty.warc")]
    placed = W.scan(spark, str(tmp_path))
    assert sorted(r["file"].rsplit("/", 1)[1] for r in W.broken(placed, W.chained(spark, placed)).collect()) == ["cut.warc", "gap.warc", "loop.warc"]


def test_edges(spark):
    from pyspark.sql import functions as F

    assert W.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "u", "e" * 200), (1, "u", "e" * 200), (1, None, "e" * 200), (None, "u", "e" * 200), (None, None, None), (3, "u", "f" * 150), (2, "u", "f" * 150), (2, "u", "short"), (2, "u", "short")]
    clash = {c: F.lit("clash") for c in ("digest", "bytes", "first", "row", "revisit", "file", "split", "value", "offset", "n")}
    got = W.round_trip(spark, spark.createDataFrame(rows, SCHEMA).withColumns(clash)).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got) == [
        (0, 0, "response", 0), (0, 200, "revisit", 1), (1, 200, "response", 0), (1, 200, "revisit", 1), (1, 200, "revisit", 1), (2, 5, "response", 0), (2, 5, "response", 0), (2, 150, "response", 0), (3, 150, "revisit", 2),
    ]
