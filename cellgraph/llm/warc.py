"""WARC archives: written by Spark, read back through verified boundary chains.

Writing: one record per page through Spark's text sink (its line separator is the record end), so archives appear
with Spark's commit protocol wherever Spark can write. Equal payloads of at least MIN_REVISIT bytes are stored once.

Reading: Spark's text source splits the archives at the record magic, so each task sees candidate records of its
own byte range; the offset of each is the sum of what precedes it in the file. A candidate names its successor
through its Content-Length. Pointer jumping from the start of each file (log2 of its records rounds) keeps the
candidates that the chain reaches; a magic inside a payload is never reached and its bytes go back to the record
that holds them. Payload digests are taken from the bytes read.

Nulls and odd rows: a null html is an empty payload; a null url writes no target line, line breaks in it are
percent-encoded; a null page_id is written as `null` and read back as null; rows that share page_id and
payload are all responses when their id is the largest; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
MIN_REVISIT = 1000
#: Records of one archive at most; bounds the rounds of pointer jumping (log2 of it).
ARCHIVE_RECORDS = 30_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to is null for responses."""
    html = F.coalesce(F.col("html"), F.lit(""))
    told = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))})
    keyed = told.withColumn("_key", F.unhex("payload_digest"))
    # written first: Spark then knows its size, and joins without moving the payloads while it is small
    groups = cut_lineage(keyed.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("_key", "payload_bytes")
                         .agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    both = keyed.join(groups, ["_key", "payload_bytes"], "left").drop("_key")
    again = F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    return both.withColumn("refers_to", F.when(again, F.col("_largest"))).drop("_largest")


def write_archives(pages: DataFrame, path: str) -> None:
    """A WARC record per row of pages (page_id, url, html) under path."""
    r = with_revisits(pages)
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(_HTTP), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, F.lit("")).otherwise(F.col("html"))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    target = F.coalesce(_header("WARC-Target-URI", url), F.lit(""))
    refers = F.when(again, F.concat(
        _header("WARC-Refers-To", _urn(F.col("refers_to"))),
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))).otherwise(F.lit(""))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _header("WARC-Record-ID", _urn(F.col("page_id"))), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), target, refers,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", (F.octet_length(http) + F.octet_length(block)).cast("string")), F.lit("\r\n"), http, block)
    r.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per magic: (file, split, row, size, value): value is what follows it up to the next one or the file's end."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                        F.monotonically_increasing_id().alias("row"), F.octet_length("value").cast("long").alias("size"), "value")


def _offsets(df: DataFrame) -> DataFrame:
    """Adds `at`, the byte at which the row's magic stands; the first row of a file is what precedes its first magic."""
    order = W.partitionBy("file").orderBy("split", "row").rowsBetween(W.unboundedPreceding, -1)
    before = F.sum(F.col("size") + len(MAGIC)).over(order)
    return df.withColumn("at", before - len(MAGIC)).where("at IS NOT NULL")


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the chain from offset 0 of each file; links: (file, at, next).

    Each round doubles the pointers, and marks where marked rows point; it ends when nothing new is marked.
    """
    state = cut_lineage(links.select("file", "at", "next", (F.col("at") == 0).alias("on")))
    known = state.where("on").count()
    while True:
        ahead = state.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        step = state.join(ahead, ["file", "next"], "left")
        moved = step.select("file", "at", F.col("far").alias("next"), "on")
        marks = state.where("on AND next IS NOT NULL").select("file", F.col("next").alias("at"), F.lit(None).cast("bigint").alias("next"), F.lit(True).alias("on"))
        # a mark may name an offset without a candidate (the end of the file): such rows fall away
        merged = moved.withColumn("real", F.lit(1)).unionByName(marks.withColumn("real", F.lit(0))).groupBy("file", "at").agg(
            F.max("next").alias("next"), F.max("on").alias("on"), F.max("real").alias("real"))
        state = cut_lineage(merged.where("real = 1").drop("real"))
        now = state.where("on").count()
        if now == known:
            return state.where("on").select("file", "at")
        known = now


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record_type, page_id, target_uri, refers_to, payload_bytes, payload_digest, declared_digest).

    payload_digest is computed from the payload read; a revisit holds none, so its declared digest and length stand.
    """
    lines = _candidates(spark, path)
    header = F.substring_index("value", END, 1)
    told = lines.withColumn("_h", header).withColumn("_hb", F.octet_length("_h").cast("long")).withColumns({
        "length": F.when(F.col("_hb") < F.col("size"), _field(F.col("_h"), "Content-Length").cast("bigint")),
        "kind": _field(F.col("_h"), "WARC-Type"), "record": _field(F.col("_h"), "WARC-Record-ID"), "refers": _field(F.col("_h"), "WARC-Refers-To"),
        "uri": _field(F.col("_h"), "WARC-Target-URI"), "declared": _field(F.col("_h"), "WARC-Payload-Digest"),
    })
    span = F.col("_hb") + len(END) + F.col("length") + len(END)  # bytes from behind the magic to the next record
    body = lambda value: F.substring_index(value, END, 1)  # noqa: E731  the HTTP header of a block
    block = F.expr(f"substring(cast(value AS binary), _hb + {len(END) + 1}, length)")
    one = told.withColumn("span", span).withColumn("_block", F.when(F.col("span") == F.col("size"), block))
    http = one.withColumn("_http", body(F.col("_block").cast("string"))).select(
        "file", "split", "row", "size", "span", "kind", "record", "refers", "uri", "declared", *_payload("_block", "_http"))
    table = cut_lineage(_offsets(http))
    links = table.where("span IS NOT NULL").select("file", "at", (F.col("at") + len(MAGIC) + F.col("span")).alias("next"))
    kept = table.join(reachable(links), ["file", "at"])
    whole, broken = kept.where("span = size"), kept.where("span <> size")
    if broken.isEmpty():
        out = whole
    else:
        out = whole.unionByName(_rejoined(spark, path, table, broken))
    id_ = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    again = F.col("kind") == "revisit"
    return out.select("file", "at", F.col("kind").alias("record_type"), id_(F.col("record")).alias("page_id"), F.col("uri").alias("target_uri"),
                      id_(F.col("refers")).alias("refers_to"), F.when(again, F.col("http_length")).otherwise(F.col("bytes")).alias("payload_bytes"),
                      F.when(again, F.col("declared_hex")).otherwise(F.col("digest")).alias("payload_digest"), F.col("declared_hex").alias("declared_digest"))


def _payload(block: str, http: str) -> list[Column]:
    """Columns told by a whole block: its HTTP length, its payload's bytes and digest."""
    rest = F.expr(f"substring({block}, octet_length({http}) + {len(END) + 1})")
    return [_field(F.col(http), "Content-Length").cast("bigint").alias("http_length"), F.octet_length(rest).cast("long").alias("bytes"),
            F.sha1(rest).alias("digest"), F.regexp_replace("declared", "^sha1:", "").alias("declared_hex")]


def _rejoined(spark: SparkSession, path: str, table: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces are read again and put together."""
    starts = broken.select("file", "at", F.col("at").alias("owner"), (F.col("at") + len(MAGIC) + F.col("span")).alias("stop"))
    others = table.join(broken.select("file").distinct(), "file", "left_semi").select("file", "at").join(starts.select("file", "at"), ["file", "at"], "left_anti")
    back = W.partitionBy("file").orderBy("at")
    both = starts.unionByName(others, allowMissingColumns=True)
    owned = both.select("file", "at", F.last("owner", True).over(back).alias("owner"), F.last("stop", True).over(back).alias("stop")).where("at < stop")
    # offsets are found anew, over the files concerned only
    again = _offsets(_candidates(spark, path).join(broken.select("file").distinct(), "file", "left_semi"))
    text = again.join(owned, ["file", "at"]).select("file", "owner", "at", "value")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    joined = text.groupBy("file", F.col("owner").alias("at")).agg(F.array_join(parts, MAGIC).alias("value"))
    cut = broken.select("file", "at", "split", "row", "size", "span", "kind", "record", "refers", "uri", "declared_hex").join(joined, ["file", "at"])
    # the last piece may reach past the record only when the file is damaged; the length decides
    head = cut.withColumn("_hb", F.octet_length(F.substring_index("value", END, 1)).cast("long"))
    block = F.expr(f"substring(cast(value AS binary), _hb + {len(END) + 1}, span - _hb - {2 * len(END)})")
    ready = head.withColumn("_block", block).withColumn("_http", F.substring_index(F.col("_block").cast("string"), END, 1)).withColumnRenamed("declared_hex", "declared")
    return ready.select("file", "at", "split", "row", "size", "span", "kind", "record", "refers", "uri", F.col("declared"), *_payload("_block", "_http"))
