"""WARC archives: written by Spark's text writer, read back in splits, records proven by the chain of their boundaries.

Writing. A page is a record; of pages with equal payloads of at least SAME bytes the first (smallest page_id) is a response, the
others are revisits that refer to it. A record is one line of text with the archive's own separator, so Spark writes plain
uncompressed archives to whatever store the folder is in.

Reading. The text reader cuts the files at the magic "WARC/1.", in splits, each piece whole. A piece that starts with a header is
a candidate, whether it is a record or text inside another record's payload. Offsets are prefix sums of the pieces' lengths, by
split and then over the splits of a file. Each candidate names its successor, the offset behind its block. Within a split, the
candidates' chains are followed to the split's end; over splits, pointer jumping from the file's start doubles the steps each
round, until no new entry is reached. Only records on that chain are kept, so magic inside a payload is never a record. Payloads are
digested where they are read; only those cut by a magic inside them are put together from their pieces.

The main path uses DataFrame functions; pandas sees offsets of one split at a time (the chains within it).

Defined results: a null html is an empty payload. Without unique page_ids, rows are numbered by (page_id, html), and the number
takes the place of page_id where records are told apart: of equal rows one is the response; a null page_id comes after all others.
An empty table gives no rows. A chain that ends before its file does (a cut or damaged archive) gives the records before the
break; `broken` names such files. Other columns are not looked at, but for url.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written

#: Fixed values of the format: what a record starts with, ends with, and what ends a header.
MAGIC, VERSION, END, LINE = "WARC/1.", "1", "\r\n\r\n", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes from which equal payloads are stored once.
SAME = 100
#: Seconds are not in the pages, so a crawl's time is a parameter.
DATE = "1970-01-01T00:00:00Z"


def _field(header: Column, name: str) -> Column:
    """A named field's value; names are matched in any case, null if there is none."""
    return F.nullif(F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1), F.lit(""))


def _record_id(row: Column) -> Column:
    h = F.md5(row.cast("string").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def numbered(pages: DataFrame) -> DataFrame:
    """page_id, url, html, row: row orders rows as page_id does and is unique."""
    n = pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max(F.col("page_id").isNull().cast("int"))).first()
    if n[0] is None or (n[0] == 1 and not n[1]):
        return pages.select("page_id", "url", "html", F.col("page_id").cast("long").alias("row"))
    in_order = pages.select("page_id", "url", "html").orderBy(F.col("page_id").asc_nulls_last(), "html", "url")
    return written(in_order.select("*", F.monotonically_increasing_id().alias("row")), "numbered-pages")


def write(spark: SparkSession, pages: DataFrame, path: str, same: int = SAME, date: str = DATE) -> None:
    """pages (page_id, url, html) as archives in the folder path."""
    shared_dir(spark)
    rows = numbered(pages).withColumn("html", F.coalesce("html", F.lit("")))
    body = F.col("html").cast("binary")
    rows = rows.withColumns({"digest": F.sha2(body, 256), "bytes": F.octet_length("html")})
    groups = rows.where(F.col("bytes") >= same).groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(groups.select("digest", "first"), "equal-payloads")  # its size decides how Spark joins it
    of = rows.join(groups, "digest", "left").withColumn("revisit", (F.col("first") != F.col("row")) & (F.col("bytes") >= same))
    revisit = F.coalesce("revisit", F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(LINE))
    where = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    header = F.concat(
        F.lit(f"{MAGIC}{VERSION}{LINE}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("row"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", where), F.lit("")),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(LINE),
    )
    record = F.concat(header, http, F.when(revisit, "").otherwise(F.col("html")))
    of.select(record.alias("value")).write.option("lineSep", END).text(path)


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """file, file_size, split (its first byte), value: the archives cut at the magic, which the values have lost."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("split"))


def _cut(value: Column) -> tuple[Column, Column, Column]:
    """Header (from the version on), block's place behind the magic, and the block with all that follows."""
    header = F.substring_index(value, END, 1)
    at = F.octet_length(header) + len(END)
    raw = value.cast("binary")
    return header, at, F.substring(raw, at + 1, F.octet_length(value))


def _payload(block: Column, size: Column, kind: Column) -> Column:
    """The payload in a block of that many bytes: behind the HTTP header, if the block is an HTTP message."""
    whole = F.substring(block, F.lit(1), size.cast("int"))
    http = F.octet_length(F.substring_index(whole.cast("string"), END, 1)) + len(END)
    return F.when(kind.startswith("application/http"), F.substring(whole, http + 1, size.cast("int"))).otherwise(whole)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The pieces without their values, with offsets: file, file_size, split, offset (of the magic), n (bytes of the value), sha (of
    the value), and for candidates successor and the header's fields. own: the block is whole in the piece; then payload_bytes
    and payload_digest are its payload's."""
    value = F.col("value")
    header, at, block = _cut(value)
    size = F.try_to_number(_field(header, "Content-Length"), F.lit("9" * 18)).cast("long")
    candidate = value.rlike(r"\A[01]\r\n") & value.contains(END) & size.isNotNull()
    kind = F.lower(F.coalesce(_field(header, "Content-Type"), F.lit("")))
    own = candidate & (F.octet_length(value) - at >= size)
    payload = F.when(own, _payload(block, size, kind))
    fields = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "refers": "WARC-Refers-To", "page_id": "X-Page-Id", "declared": "WARC-Payload-Digest"}
    found = pieces_of(spark, path).select(
        "file", "file_size", "split", F.monotonically_increasing_id().alias("id"), F.octet_length(value).cast("long").alias("n"), F.sha2(value.cast("binary"), 256).alias("sha"),
        F.when(candidate, at + size + len(MAGIC) + len(END)).alias("reach"), F.coalesce(own, F.lit(False)).alias("own"), F.when(candidate, kind).alias("kind"), F.when(candidate, size).alias("size"),
        *(F.when(candidate, _field(header, n)).alias(c) for c, n in fields.items()), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    found = written(found, "pieces")
    # prefix sums within a split, then over a file's splits; every piece but the file's first has lost a magic before it
    inner = Window.partitionBy("file", "split").orderBy("id")
    splits = found.groupBy("file", "file_size", "split").agg(F.sum(F.col("n") + len(MAGIC)).alias("bytes"))
    outer = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("base", F.coalesce(F.sum("bytes").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wrong = splits.groupBy("file", "file_size").agg(F.sum("bytes").alias("all")).where(F.col("all") - len(MAGIC) != F.col("file_size")).select("file").limit(1).collect()
    if wrong:
        raise ValueError(f"the pieces of {wrong[0][0]} do not add up to the file")
    before = F.coalesce(F.sum(F.col("n") + len(MAGIC)).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("offset", before).join(splits.select("file", "split", "base"), ["file", "split"])
    placed = placed.withColumn("offset", F.col("offset") + F.col("base") - len(MAGIC))
    return written(placed.withColumn("successor", F.col("offset") + F.col("reach")).drop("reach", "base", "id"), "placed")


def _exits(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, the first offset of its chain that is no candidate of the split."""
    leave: dict[int, int] = {}
    for offset, successor in sorted(zip(frame["offset"], frame["successor"], strict=True), reverse=True):
        leave[offset] = leave.get(successor, successor)
    return pd.DataFrame({"file": key[0], "split": key[1], "offset": leave.keys(), "leave": leave.values()})


def _walked(key: tuple, candidates: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that its entries lead to."""
    follows, seen = dict(zip(candidates["offset"], candidates["successor"], strict=True)), set()
    for at in entries["offset"]:
        while at in follows and at not in seen:
            seen.add(at)
            at = follows[at]
    return pd.DataFrame({"file": key[0], "offset": sorted(seen)})


def chained(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """file, offset of the candidates that the chain from their file's start reaches."""
    candidates = placed.where("successor is not null").select("file", "split", "offset", "successor")
    kind = "file string, split long, offset long, leave long"
    exits = written(candidates.groupBy("file", "split").applyInPandas(_exits, kind), "exits")
    # the nodes that chains of other splits lead to, and what these lead to in turn
    heads = exits.where("offset = 0").select("file", "offset")
    nodes = exits.join(exits.select("file", F.col("leave").alias("offset")).distinct().unionByName(heads).distinct(), ["file", "offset"]).select("file", "offset", F.col("leave").alias("to"))
    nodes, reached = written(nodes, "jumps"), written(heads, "reached")
    jump = nodes
    while True:
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        new = ahead.join(nodes.select("file", "offset"), ["file", "offset"], "left_semi").join(reached, ["file", "offset"], "left_anti")
        new = written(new.distinct(), "entries")
        if not new.limit(1).count():
            break
        reached = written(reached.unionByName(new), "reached")
        far = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("then"))
        jump = written(jump.join(far, ["file", "to"]).select("file", "offset", F.col("then").alias("to")), "jumps")
    entries = written(reached.join(candidates.select("file", "split", "offset"), ["file", "offset"]).select("file", "split", "offset"), "entries")
    return candidates.groupBy("file", "split").cogroup(entries.groupBy("file", "split")).applyInPandas(_walked, "file string, offset long")


def broken(placed: DataFrame, chain: DataFrame) -> DataFrame:
    """file, offset: files whose chain ends before they do, and where it ends."""
    ends = placed.join(chain, ["file", "offset"]).groupBy("file").agg(F.max("successor").alias("offset"))
    return placed.select("file", "file_size").distinct().join(ends, "file", "left").where("offset is null or offset <> file_size").select("file", F.coalesce("offset", F.lit(0)).alias("offset"))


def _put_together(spark: SparkSession, path: str, placed: DataFrame, cut: DataFrame) -> DataFrame:
    """file, offset, payload_bytes, payload_digest of records (file, offset, successor, split, size, kind) whose block is cut by
    magic inside it: pieces from the record's first to its last are found again by their digests and joined in order."""
    spans = cut.select("file", F.col("offset").alias("start"), "successor", "size", "kind")
    inside = placed.select("file", "offset", "sha").join(spans, "file").where("offset >= start and offset < successor").select("file", "start", "offset", "sha", "size", "kind")
    values = pieces_of(spark, path).select(F.sha2(F.col("value").cast("binary"), 256).alias("sha"), "value")
    values = values.join(inside.select("sha").distinct(), "sha", "left_semi").groupBy("sha").agg(F.first("value").alias("value"))
    whole = inside.join(values, "sha").groupBy("file", "start", "size", "kind").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("p"))
    whole = whole.withColumn("value", F.array_join(F.col("p.value"), MAGIC))
    _, _, block = _cut(F.col("value"))
    payload = _payload(block, F.col("size"), F.col("kind"))
    return whole.select("file", F.col("start").alias("offset"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, record_id, record_type, page_id, payload_bytes and payload_digest (of what it stores),
    refers (a record_id), declared (the digest that its header names)."""
    shared_dir(spark)
    placed = scan(spark, path)
    kept = written(placed.join(chained(spark, placed), ["file", "offset"]), "records")
    names = ("file", "offset", "record_id", F.col("type").alias("record_type"), F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "refers", "declared")
    whole, cut = kept.where("own").select(*names), kept.where("not own")
    if not cut.limit(1).count():
        return whole
    return whole.unionByName(cut.drop("payload_bytes", "payload_digest").join(_put_together(spark, path, placed, cut), ["file", "offset"]).select(*names))


def round_trip(spark: SparkSession, pages: DataFrame, same: int = SAME) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per page, from archives written and read back. A revisit's
    payload is that of the response it refers to."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if pages.limit(1).count() == 0:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    write(spark, pages, path, same)
    records = written(read(spark, path), "warc-records")
    full = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers").join(first, "refers")
    return full.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


_DIGESTED = "select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages"
QUERIES = {"op13_warc": op13_warc}
SQL = {
    "op13_warc": f"""with p as ({_DIGESTED}), g as (select d, min(page_id) as first from p where n >= {SAME} group by d)
select page_id, n as payload_bytes, p.d as payload_digest, case when coalesce(first, page_id) = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to from p left join g on g.d = p.d and n >= {SAME}"""
}
