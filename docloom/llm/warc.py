"""WARC records and the resolution of not-modified revisits.

``resolve_revisits`` is an as-of join by canonical URL: every revisit record of the
server-not-modified profile gets the latest earlier full response of the same URL, if the validators
agree: a strong or weak ETag match where both sides have an ETag, else equal Last-Modified dates.
The payload of the response is used, and its headers are updated with those headers of the 304 that
a cache may update (all but the ones that describe the stored body).

The join is one range-partitioned sort by (URL, time, record): inside a partition a window carries
the last full response forward, and what a URL's earlier partitions end with (one row per URL and
partition) is carried on by a second, small window. A URL with a third of all records is spread over
the partitions like the others, and no payload is ever shuffled: the sort carries ids and headers.

Defined results: a null or empty URL is a URL of its own kind and never resolves; records without a
time come first; records with equal time are ordered by record id, full responses first; a revisit
before any response stays ``unresolved``; disagreeing validators give ``validator_mismatch``, no
validators on one side ``no_validator``; repeated rows are repeated in the result; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import work
from docloom.shipping import ship

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers of a 304 that say something of the body it doesn't have, or of the connection.
KEPT_OF_RESPONSE = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "keep-alive", "trailer", "upgrade", "te", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)="

RECORDS = "record_id string, warc_type string, profile string, url string, warc_date timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case, default port, fragment, tracking parameters and trailing slash dropped, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then collide the last counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers (lower-case names), updated with the permitted ones of the 304."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT_OF_RESPONSE))
    kept = F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(kept), F.map_entries(allowed))))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def validators_agree(stored: Column, fresh: Column) -> Column:
    """True, False, or null where there is no validator to compare (header maps, lower-case names)."""
    tags = stored["etag"].isNotNull() & fresh["etag"].isNotNull()
    dates = stored["last-modified"].isNotNull() & fresh["last-modified"].isNotNull()
    return F.when(tags, _weak(stored["etag"]) == _weak(fresh["etag"])).when(dates, stored["last-modified"] == fresh["last-modified"])


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, url_key, warc_date, kind, outcome, source_id, status, headers for every record.

    kind is response, revisit or other; outcome is full (a response), resolved, validator_mismatch,
    no_validator, unresolved or other; source_id is the record whose payload holds; status and
    headers are those of the response a client would have seen. Join the payloads by source_id.
    """
    kind = F.when((F.col("warc_type") == "response") & ~F.coalesce(F.col("status") == 304, F.lit(False)), "response").when((F.col("warc_type") == "revisit") & (F.coalesce(F.col("profile"), F.lit(NOT_MODIFIED)) == NOT_MODIFIED), "revisit").when((F.col("warc_type") == "response") & (F.col("status") == 304), "revisit").otherwise("other")
    slim = records.select("record_id", F.nullif(canonical_url(F.col("url")), F.lit("")).alias("url_key"), "warc_date", "status", _lower_keys(F.col("headers")).alias("headers"), F.coalesce(kind, F.lit("other")).alias("kind")).withColumn("_tie", F.monotonically_increasing_id())
    first = (F.col("kind") != "response").cast("int")
    slim = work.written(slim, "captures-slim")  # the sort samples its input first
    placed = work.written(slim.orderBy("url_key", "warc_date", first, "record_id", "_tie").withColumn("_mid", F.monotonically_increasing_id()), "captures").withColumn("_part", F.shiftright("_mid", 33))
    full = F.when((F.col("kind") == "response") & F.col("url_key").isNotNull(), F.struct("record_id", "status", "headers"))
    upto = Window.partitionBy("url_key", "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumn("_own", F.last(full, ignorenulls=True).over(upto))
    ends = placed.withColumn("_full", full).where(F.col("_full").isNotNull()).groupBy("url_key", "_part").agg(F.max(F.struct("_mid", F.col("_full.record_id").alias("record_id"))).alias("_last"))
    # only URLs that a partition boundary cuts have more than one row here
    before = Window.partitionBy("url_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy("url_key", "_part").agg(F.max("_mid").alias("_m")).join(ends.select("url_key", "_part", F.col("_last._mid").alias("_full_mid")), ["url_key", "_part"], "left")
    carried = spans.withColumn("_carry_mid", F.last("_full_mid", ignorenulls=True).over(before)).where("_carry_mid IS NOT NULL").select("url_key", "_part", "_carry_mid")
    carried = carried.join(placed.select(F.col("_mid").alias("_carry_mid"), F.struct("record_id", "status", "headers").alias("_carry")), "_carry_mid").drop("_carry_mid")
    found = inside.join(carried, ["url_key", "_part"], "left").withColumn("_src", F.coalesce("_own", "_carry"))
    src = F.col("_src")
    agree = validators_agree(src["headers"], F.col("headers"))
    outcome = F.when(F.col("kind") == "response", "full").when(F.col("kind") == "other", "other").when(src.isNull(), "unresolved").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    resolved = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "warc_date",
        "kind",
        "outcome",
        F.when(resolved, src["record_id"]).when(F.col("outcome") == "full", F.col("record_id")).alias("source_id"),
        F.when(resolved, src["status"]).otherwise(F.col("status")).alias("status"),
        F.when(resolved, merged_headers(src["headers"], F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


# -- reading and writing WARC files


#: Decompressed bytes taken at once.
_PIECE = 1 << 20


def _head(raw: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the fields; values of a repeated name are joined by a comma, cookies by a line end."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    spelled: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = spelled.setdefault(name.strip().lower(), name.strip())
            joint = "\n" if name.lower() == "set-cookie" else ", "
            fields[name] = f"{fields[name]}{joint}{value.strip()}" if name in fields else value.strip()
    return lines[0], fields


def _inflated(data: bytes) -> Iterator[bytes | None]:
    """The bytes of gzip members, piece by piece; None where a member is damaged, after which the next one follows."""
    at = 0
    while at < len(data):
        inflate = zlib.decompressobj(31)
        to = at
        try:
            while not inflate.eof and to < len(data):
                fed = data[to : to + _PIECE]
                to += len(fed)
                while fed:
                    yield inflate.decompress(fed, _PIECE)
                    fed = inflate.unconsumed_tail
            if not inflate.eof:
                yield None
                return
            at = to - len(inflate.unused_data)
        except zlib.error:
            yield None
            at = data.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return


DAMAGED = {"record_id": None, "warc_type": "damaged", "profile": None, "url": None, "warc_date": None, "status": None, "headers": None, "payload": None}


def _record(names: dict[str, str], block: bytes) -> dict:
    row = {"record_id": names.get("warc-record-id", "").strip("<>"), "warc_type": names.get("warc-type"), "profile": names.get("warc-profile"), "url": names.get("warc-target-uri"), "warc_date": names.get("warc-date"), "status": None, "headers": None, "payload": block}
    if names.get("content-type", "").startswith("application/http") and (cut := block.find(b"\r\n\r\n")) >= 0:
        line, headers = _head(block[:cut])
        code = (line.split() + ["", ""])[1]
        row |= {"status": int(code) if code.isdigit() else None, "headers": headers, "payload": block[cut + 4 :]}
    return row


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped, held one at a time.

    Where bytes are damaged or the file is cut off, a row of warc_type ``damaged`` says so, and
    reading goes on at the next gzip member, or the next line that begins a record.
    """
    held = bytearray()
    lost = False  # looking for the next record after damage

    def records(final: bool) -> Iterator[dict]:
        nonlocal lost
        while True:
            if lost:
                found = held.find(b"WARC/1.")
                del held[: found if found >= 0 else max(len(held) - 7, 0)]
                if found < 0:
                    return
                lost = False
            while held[:2] == b"\r\n":
                del held[:2]
            end = held.find(b"\r\n\r\n")
            if end < 0:
                if final and bytes(held).strip():
                    yield dict(DAMAGED)
                return
            version, fields = _head(bytes(held[:end]))
            names = {k.lower(): v for k, v in fields.items()}
            size = names.get("content-length", "")
            if not version.startswith("WARC/") or not size.isdigit():
                yield dict(DAMAGED)
                del held[:1]
                lost = True
                continue
            to = end + 4 + int(size)
            if len(held) < to:
                if final:
                    yield dict(DAMAGED)
                    del held[: end + 4]
                    lost = True
                    continue
                return
            yield _record(names, bytes(held[end + 4 : to]))
            del held[:to]

    for piece in _inflated(data) if data[:2] == b"\x1f\x8b" else (data[i : i + _PIECE] for i in range(0, len(data), _PIECE)):
        if piece is None:
            yield dict(DAMAGED)
            held.clear()
            continue
        held += piece
        yield from records(False)
    yield from records(True)


def format_warc(row: dict) -> bytes:
    """One record as bytes (inverse of parse_warc)."""
    block = bytes(row["payload"] or b"")
    fields = {"WARC-Type": row["warc_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Target-URI": row["url"], "WARC-Date": row["warc_date"], "WARC-Profile": row["profile"]}
    if row["status"] is not None:
        head = "".join(f"{k}: {x}\r\n" for k, v in (row["headers"] or {}).items() for x in (v.split("\n") if k.lower() == "set-cookie" else [v]))
        block = f"HTTP/1.1 {row['status']} \r\n{head}\r\n".encode() + block
        fields["Content-Type"] = "application/http; msgtype=response"
    fields["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under ``path`` as RECORDS; what is damaged gives rows of warc_type ``damaged``.

    A task holds one file as it is stored (under 2 GB) and one record of it.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    raw = RECORDS.replace("timestamp", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("profile", pa.string()), ("url", pa.string()), ("warc_date", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for r in parse_warc(data):
                    rows.append(r | {"headers": None if r["headers"] is None else [*r["headers"].items()]})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.mapInArrow(run, raw).withColumn("warc_date", F.try_to_timestamp(F.col("warc_date")))


# -- the query over `pages`

#: Seconds between the captures of a page; the pages' first captures are a second apart.
AGAIN_S = 1_000_000


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of ``pages``: two full responses of each page, and 304s between and after them.

    In this order: a 304 before anything is stored (pages of number 2 modulo 4), the first response,
    its 304 (a weak ETag), a changed response (number 1 modulo 4: without an ETag), its 304 (1: with
    Last-Modified only; 3: without validators), and a 304 that still has the first ETag. Every 304
    has a fresh Date and Cache-Control and (wrongly) Content-Length: 0. Where pages share a
    canonical URL, their captures mix, and the validators decide.
    """
    tag = lambda more: F.concat(F.lit('"'), F.substring(F.sha2(F.concat(F.coalesce("html", F.lit("")), F.lit(more)), 256), 1, 16), F.lit('"'))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long") + F.col("page_id")
    base = pages.select("page_id", "url", F.pmod("page_id", F.lit(4)).alias("kind"), tag("").alias("e1"), tag("/2").alias("e2"), start.alias("t"))
    text = lambda s: F.date_format(s.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    at = lambda n: F.col("t") + n * AGAIN_S

    def record(mark: str, n: int, status: int, etag: Column, modified: Column) -> Column:
        fresh = {"Cache-Control": F.lit("max-age=60"), "Content-Length": F.lit("0")} if status == 304 else {"Content-Type": F.lit("text/html")}
        named = fresh | {"ETag": etag, "Last-Modified": modified, "Date": text(at(n))}
        headers = F.map_filter(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
        kind = F.lit("revisit" if status == 304 else "response")
        return F.struct(F.concat(F.col("page_id").cast("string"), F.lit(mark)).alias("record_id"), kind.alias("warc_type"), F.lit(NOT_MODIFIED if status == 304 else None).cast("string").alias("profile"), F.col("url").alias("url"), at(n).cast("timestamp").alias("warc_date"), F.lit(status).alias("status"), headers.alias("headers"))

    weak = F.concat(F.lit("W/"), F.col("e1"))
    none = F.lit(None).cast("string")
    k = F.col("kind")
    all_ = [
        F.when(k == 2, record("/0", -1, 304, F.col("e1"), none)),
        record("/1", 0, 200, F.col("e1"), text(at(0))),
        record("/1again", 1, 304, weak, none),
        record("/2", 2, 200, F.when(k != 1, F.col("e2")), text(at(2))),
        record("/2again", 3, 304, F.when(~k.isin(1, 3), F.col("e2")), F.when(k == 1, text(at(2)))),
        record("/late", 4, 304, F.col("e1"), none),
    ]
    return base.select(F.explode(F.filter(F.array(*all_), lambda r: r.isNotNull())).alias("r")).select("r.*")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the crawl of all pages, revisits resolved."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    done = resolve_revisits(page_records(pages))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return done.select("record_id", "url_key", "kind", "outcome", "source_id", "status", shown.alias("headers"), F.date_format("warc_date", "yyyy-MM-dd HH:mm:ss").alias("warc_date"))


OP7_SQL = r"""
WITH base AS (
  SELECT page_id, url, page_id % 4 AS k, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS e1,
         '"' || substr(sha256(coalesce(html, '') || '/2'), 1, 16) || '"' AS e2,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS born FROM pages),
keyed AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '', 's') AS bare FROM base),
cut AS (
  SELECT *, regexp_replace(bare, '^[a-zA-Z][a-zA-Z0-9+.\-]*://', '') AS rest FROM keyed),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)='))) AS params
  FROM cut),
urls AS (
  SELECT page_id, k, e1, e2, born, nullif(host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, '') AS url_key FROM parts),
records AS (
  SELECT page_id || '/0' AS record_id, url_key, 'revisit' AS kind, born - to_seconds(1000000) AS t, e1 AS etag, NULL AS modified FROM urls WHERE k = 2
  UNION ALL SELECT page_id || '/1', url_key, 'response', born, e1, strftime(born, '%Y-%m-%d %H:%M:%S') FROM urls
  UNION ALL SELECT page_id || '/1again', url_key, 'revisit', born + to_seconds(1000000), 'W/' || e1, NULL FROM urls
  UNION ALL SELECT page_id || '/2', url_key, 'response', born + to_seconds(2000000), CASE WHEN k <> 1 THEN e2 END, strftime(born + to_seconds(2000000), '%Y-%m-%d %H:%M:%S') FROM urls
  UNION ALL SELECT page_id || '/2again', url_key, 'revisit', born + to_seconds(3000000), CASE WHEN k NOT IN (1, 3) THEN e2 END, CASE WHEN k = 1 THEN strftime(born + to_seconds(2000000), '%Y-%m-%d %H:%M:%S') END FROM urls
  UNION ALL SELECT page_id || '/late', url_key, 'revisit', born + to_seconds(4000000), e1, NULL FROM urls),
found AS (
  SELECT *, last_value(CASE WHEN kind = 'response' AND url_key IS NOT NULL THEN {'id': record_id, 'etag': etag, 'modified': modified} END IGNORE NULLS) OVER (
    PARTITION BY url_key ORDER BY t, kind, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src FROM records),
judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN src IS NULL THEN 'unresolved'
    WHEN src.etag IS NOT NULL AND etag IS NOT NULL THEN CASE WHEN regexp_replace(src.etag, '^W/', '') = regexp_replace(etag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN src.modified IS NOT NULL AND modified IS NOT NULL THEN CASE WHEN src.modified = modified THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'no_validator' END AS outcome FROM found)
SELECT record_id, url_key, kind, outcome,
  CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN src.id END AS source_id,
  CASE WHEN outcome IN ('full', 'resolved') THEN 200 ELSE 304 END AS status,
  concat_ws(chr(10),
    CASE WHEN kind = 'revisit' THEN 'cache-control: max-age=60' END,
    CASE WHEN kind = 'revisit' AND outcome <> 'resolved' THEN 'content-length: 0' END,
    CASE WHEN outcome IN ('full', 'resolved') THEN 'content-type: text/html' END,
    'date: ' || strftime(t, '%Y-%m-%d %H:%M:%S'),
    'etag: ' || CASE WHEN outcome = 'resolved' THEN coalesce(etag, src.etag) ELSE etag END,
    'last-modified: ' || CASE WHEN outcome = 'resolved' THEN coalesce(modified, src.modified) ELSE modified END) AS headers,
  strftime(t, '%Y-%m-%d %H:%M:%S') AS warc_date
FROM judged
"""
