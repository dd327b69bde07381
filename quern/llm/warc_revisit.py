"""WARC revisits: not-modified records get the body of the latest earlier full response of their URL.

Records are (record_id, url, ts, kind, etag, last_modified, headers, payload), kind "response" or "revisit". A
revisit is matched by canonical URL to the response with the greatest (ts, record_id) before its own. The match
counts only if its validator agrees: the entity tag where the revisit names one (weak tags compare by their
value), else the last-modified date. Then the response's payload is taken over, and the revisit's headers
replace the stored ones, but for those that describe the body or the connection.

The as-of join: records are dealt by ranges of (URL, time), so that a URL with a third of all records fills many
tasks. Within (URL, range) a window finds the latest response, and where a range has none before a record, the latest
of all earlier ranges, of which each has one row, is used. A revisit's own headers go along with it; stored headers
and payloads join once for each response that is used.

A record without a URL or time matches nothing and is no answer. Revisits without a validator, or whose validator
differs, keep a null payload and say why. Equal times are ordered by record_id, null first, and a response stands before
a revisit of the same id. Each row that is a revisit gives one row, repeated ones and those without an id too; of
responses that agree in URL, time and id, one of the greatest hash of tags, headers and payload answers. Other kinds and columns
are not read.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.shared import Scratch, table

#: Headers of a not-modified answer that must not replace the stored response's.
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "trailer", "transfer-encoding", "upgrade"]
TRACKING = "^(utm_[^=]*|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without its last slash, sorted query without tracking."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "^www[.]|:(80|443)$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes (plain or gzip): its headers by lower-case name, and the block.

    A record without a readable length is left out.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        digits = headers.get("content-length", "")
        if not digits.isdecimal():  # the record's end is unknown: look for the next one
            at = end + 4
            continue
        length = int(digits)
        yield {"headers": headers, "block": data[end + 4 : end + 4 + length]}
        at = end + 4 + length


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers.items() if k.lower() != "content-length"), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of the WARC files at path, in the form resolve_revisits takes.

    A file is read whole by one worker (a crawl's files have about a GB).
    """
    import pandas as pd

    def parsed(it):
        for pdf in it:
            out = []
            for source, data in zip(pdf["path"], pdf["content"]):
                for i, r in enumerate(records(bytes(data))):
                    kind = r["headers"].get("warc-type")
                    if kind in ("response", "revisit"):
                        head, _, body = r["block"].partition(b"\r\n\r\n")
                        own = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                        out.append((r["headers"].get("warc-record-id", f"{source}#{i}"), r["headers"].get("warc-target-uri"), r["headers"].get("warc-date"), kind, own.get("etag"), own.get("last-modified"), own, body if kind == "response" else None))
            yield pd.DataFrame(out, columns=["record_id", "url", "ts", "kind", "etag", "last_modified", "headers", "payload"])

    schema = "record_id string, url string, ts string, kind string, etag string, last_modified string, headers map<string,string>, payload binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, schema).withColumn("ts", F.to_timestamp("ts").cast("long"))


def resolve_revisits(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each revisit: record_id, url_key, response_id, outcome, headers, payload. ts is a number; ranges: tasks to deal to."""
    spark = captures.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    revisit = F.col("kind") == "revisit"
    no_headers = F.lit(None).cast("map<string,string>")
    headers = F.col("headers").cast("map<string,string>")
    told = F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat_ws("\x01", e["key"], e["value"]))), "\x02")
    body = F.when(~revisit, F.xxhash64("etag", "last_modified", told, "payload")).alias("body")
    rows = captures.where(F.col("kind").isin("response", "revisit")).select("record_id", "ts", "kind", "etag", "last_modified", canonical_url(F.col("url")).alias("url_key"), F.when(revisit, headers).otherwise(no_headers).alias("own_headers"), body)
    timed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    order = ["ts", "record_id", "kind", "body"]
    fields = ["record_id", "url_key", "ts", "etag", "last_modified", "own_headers", "found"]
    nothing = F.lit(None).cast("struct<ts:long,record_id:string,body:long,etag:string,last_modified:string>")
    with Scratch(spark) as scratch:
        # Rows that agree in all of these are told apart by a number, so that any crowd of them can be dealt.
        numbered = rows.where(timed).withColumn("_row", F.monotonically_increasing_id())
        facts = scratch.stored(numbered.repartitionByRange(ranges, "url_key", *order, "_row").withColumn("part", F.spark_partition_id()), "captures", keep=True)
        answer = F.when(~revisit, F.struct(F.col("ts").cast("long").alias("ts"), F.col("record_id").cast("string").alias("record_id"), "body", "etag", "last_modified"))
        facts = facts.withColumn("answer", answer)
        here = W.partitionBy("url_key", "part").orderBy(*order, "_row").rowsBetween(W.unboundedPreceding, -1)
        spans = facts.groupBy("url_key", "part").agg(F.max_by("answer", F.when(~revisit, F.struct(*order))).alias("latest"))
        carried = F.last("latest", ignorenulls=True).over(W.partitionBy("url_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        spans = spans.select("url_key", "part", carried.alias("carried")).where("carried is not null")
        found = facts.withColumn("found", F.last("answer", ignorenulls=True).over(here)).where(revisit)
        found = found.join(spans, ["url_key", "part"], "left").withColumn("found", F.coalesce("found", "carried")).select(*fields)
        found = found.unionByName(rows.where(revisit & ~timed).withColumn("found", nothing).select(*fields))
        tag = lambda c: F.regexp_replace(c, "^W/", "")
        outcome = F.when(F.col("found").isNull(), "no response").when(F.col("etag").isNotNull(), F.when(tag(F.col("etag")) == tag(F.col("found.etag")), "etag").otherwise("validator differs"))
        outcome = outcome.when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("found.last_modified"), "last-modified").otherwise("validator differs")).otherwise("no validator")
        matched = scratch.stored(found.withColumn("outcome", outcome), "matched", keep=True)
    good = F.col("outcome").isin("etag", "last-modified")
    # A response's key: its URL, time, id and the hash of what it says.
    key = lambda url, ts, id_, said: F.struct(url.alias("u"), ts.cast("long").alias("t"), F.coalesce(id_, F.lit("")).alias("i"), id_.isNull().alias("n"), said.alias("b"))
    matched = matched.withColumn("key", F.when(good, key(F.col("url_key"), F.col("found.ts"), F.col("found.record_id"), F.col("found.body"))))
    answers = captures.where(F.col("kind") == "response").select(key(canonical_url(F.col("url")), F.col("ts"), F.col("record_id").cast("string"), body).alias("key"), headers.alias("stored_headers"), "payload")
    used = matched.where(good).select("key").distinct()
    answers = answers.join(used, "key", "left_semi").groupBy("key").agg(F.first("stored_headers").alias("stored_headers"), F.first("payload").alias("stored_payload"))
    empty = F.create_map().cast("map<string,string>")
    update = F.map_filter(F.coalesce("own_headers", empty), lambda k, v: ~F.lower(k).isin(NOT_MERGED))
    keep = F.map_filter(F.coalesce("stored_headers", empty), lambda k, v: ~F.array_contains(F.map_keys(update), k))
    last = [F.col("found.record_id").alias("response_id"), "outcome"]
    full = matched.where(good).join(answers, "key").select("record_id", "url_key", *last, F.map_concat(keep, update).alias("headers"), F.col("stored_payload").alias("payload"))
    none = F.lit(None).cast(captures.schema["payload"].dataType).alias("payload")
    return full.unionByName(matched.where(~good).select("record_id", "url_key", *last, F.col("own_headers").alias("headers"), none))


def page_captures(pages: DataFrame) -> DataFrame:
    """Crawls of pages at times by page_id: each page in full, and three revisits, which stand between the pages' responses.

    A revisit names the page's entity tag (four in ten), its date (three), a tag of no page (one) or nothing (two). The
    first comes before its page, the second soon after it, the third after some later pages.
    """
    tag, day = F.md5(F.col("html").cast("binary")), F.concat(F.lit("day "), (F.length("html") % 50).cast("string"))
    null = F.lit(None).cast("string")
    head = lambda *xs: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in xs]), lambda k, v: v.isNotNull())
    full = pages.select(F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"), "url", (F.col("page_id") * 1000).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), day.alias("last_modified"), head("content-type", "text/html", "etag", tag, "last-modified", day).alias("headers"), F.col("html").alias("payload"))
    later = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).cast("long").alias("t")) for n, t in ((0, -500), (1, 500), (2, 40_500))])).alias("again")
    again = pages.select("*", later)
    how = F.pmod(F.col("page_id") * 3 + F.col("again.n"), F.lit(10))
    named = F.when(how < 4, tag).when(how == 7, F.lit("none"))
    dated = F.when((how >= 4) & (how < 7), day)
    again = again.select(F.concat(F.lit("v"), F.col("page_id").cast("string"), F.lit("-"), F.col("again.n").cast("string")).alias("record_id"), "url", (F.col("page_id") * 1000 + F.col("again.t")).alias("ts"), F.lit("revisit").alias("kind"), named.alias("etag"), dated.alias("last_modified"), head("content-length", "0", "etag", named, "last-modified", dated, "x-cache", "hit").alias("headers"), null.alias("payload"))
    return full.unionByName(again)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    part = lambda n: F.regexp_extract("record_id", "^v(-?[0-9]+)-([0-9]+)$", n)
    return out.select(part(1).try_cast("long").alias("page_id"), part(2).try_cast("int").alias("visit"), F.col("url_key"), F.substring("response_id", 2, 30).cast("long").alias("response_page"), "outcome", F.size("headers").cast("int").alias("n_headers"), F.md5(F.col("payload").cast("binary")).alias("body_md5"))


#: The as-of join in SQL: the latest response of the URL before each revisit, then its validator.
OP6_SQL = """
WITH cut AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
split AS (
  SELECT page_id, html,
    regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[.]|:(80|443)$', '', 'g') AS host,
    regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM cut),
params AS (
  SELECT page_id, html, host, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS query FROM split),
keyed AS (
  SELECT page_id, html, md5(html) AS tag, 'day ' || (length(html) % 50) AS day, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url_key FROM params),
visits AS (
  SELECT k.*, v.n, page_id * 1000 + v.t AS ts, (page_id * 3 + v.n) % 10 AS how FROM keyed k, (VALUES (0, -500), (1, 500), (2, 40500)) v(n, t)),
named AS (
  SELECT *, CASE WHEN how < 4 THEN tag WHEN how = 7 THEN 'none' END AS etag, CASE WHEN how >= 4 AND how < 7 THEN day END AS dated FROM visits),
found AS (
  SELECT v.page_id, v.n, v.url_key, v.etag, v.dated, r.page_id AS response_page, r.html, r.tag, r.day,
    row_number() OVER (PARTITION BY v.page_id, v.n ORDER BY r.page_id DESC NULLS LAST) AS nth
  FROM named v LEFT JOIN keyed r ON r.url_key = v.url_key AND r.page_id * 1000 < v.ts),
judged AS (
  SELECT *, CASE WHEN response_page IS NULL THEN 'no response' WHEN etag IS NOT NULL THEN CASE WHEN etag = tag THEN 'etag' ELSE 'validator differs' END
    WHEN dated IS NOT NULL THEN CASE WHEN dated = day THEN 'last-modified' ELSE 'validator differs' END ELSE 'no validator' END AS outcome FROM found WHERE nth = 1)
SELECT page_id, CAST(n AS INTEGER) AS visit, url_key, response_page, outcome,
  CAST(CASE WHEN outcome IN ('etag', 'last-modified') THEN 4 ELSE 2 + (etag IS NOT NULL)::INT + (dated IS NOT NULL)::INT END AS INTEGER) AS n_headers,
  CASE WHEN outcome IN ('etag', 'last-modified') THEN md5(html) END AS body_md5
FROM judged
"""
