"""WARC revisit records of "server not modified" kind, resolved to the response that they stand for.

A revisit is joined as of its time to the latest earlier full response with the same canonical URL. The match counts only if the validators agree: an
entity tag (weak comparison) if both have one, else the modification date, else the payload digest. The resolved record takes the response's payload
and headers, except for the headers that a 304 answer may renew, which come from the revisit. A pair without a validator that both have is joined
likewise, on the server's word alone, and its status says so: unvalidated.

The as-of join survives a URL with a large share of all records. Records are range-partitioned by (URL, time), so such a URL spans many
partitions; each looks back within itself, and the last response of each (partition, URL) is carried forward over a table with one row for each.

Defined results: records without a URL or time resolve to nothing; a response at the very time of a revisit isn't earlier; among responses of one time the
largest record id is the latest; equal records give equal results; URLs and headers of any length are taken whole; an empty table gives an empty table; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, n_partitions, table

#: Headers that a 304 answer renews (RFC 9110, section 15.4.5), and the date of modification as a validator.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:[^@/?#]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host, port unless it is the scheme's own, path and sorted parameters. Scheme, user, www, fragment and a slash at the end don't count; case counts in path and parameters.

    Percent-encoding and dot segments stay as they are written.
    """
    part = lambda i: F.regexp_extract(url, URL, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www[0-9]*\.", "")
    scheme = F.lower(part(1))
    own = (part(3) == "") | ((part(3) == "80") & (scheme != "https")) | ((part(3) == "443") & (scheme != "http"))
    port = F.when(own, "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(part(4), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part(5), "&"), lambda p: p != "")), "&")
    return F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def validators_agree(a: Column, b: Column, digest_a: Column, digest_b: Column) -> Column:
    """From header maps and payload digests of two records; null if they have no validator in common."""
    etag_a, etag_b = a["etag"], b["etag"]
    date_a, date_b = a["last-modified"], b["last-modified"]
    both = lambda x, y: x.isNotNull() & y.isNotNull()
    return F.when(both(etag_a, etag_b), _weak(etag_a) == _weak(etag_b)).when(both(date_a, date_b), date_a == date_b).when(both(digest_a, digest_b), digest_a == digest_b)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, canonical_url, status, response_id, payload_digest, headers (merged).

    records: record_id long, kind ('response' or 'revisit'), url string, ts timestamp, headers map<string,string> with lower-case names, payload_digest
    string. Payloads stay where they are: response_id leads to them. Status is resolved, unvalidated (joined without a
    common validator), validator_mismatch or no_response.
    """
    spark = records.sparkSession
    narrow = records.select("record_id", (F.col("kind") == "response").alias("full"), canonical_url(F.col("url")).alias("url"), "ts", "headers", "payload_digest")
    placed = narrow.where("url is not null and ts is not null")
    order = ["ts", "full", "record_id"]
    dealt = placed.repartitionByRange(n_partitions(spark), "url", *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "warc_records")
    response = F.when(F.col("full"), F.struct("ts", "record_id", "headers", "payload_digest"))
    within = Window.partitionBy("part", "url").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("near", F.last(response, ignorenulls=True).over(within)).where(~F.col("full"))
    # A partition that begins with a response of the very time at which the one before it ends can't come before a revisit of that time: revisits sort first.
    lasts = dealt.groupBy("url", "part").agg(F.max_by(response, F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last"))
    carried = lasts.select("url", "part", F.last("last", ignorenulls=True).over(Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    found = local.join(carried, ["url", "part"]).withColumn("hit", F.coalesce("near", "far"))
    agree = validators_agree(F.col("headers"), F.col("hit.headers"), F.col("payload_digest"), F.col("hit.payload_digest"))
    found = found.withColumn("status", F.when(F.col("hit").isNull(), "no_response").when(agree, "resolved").when(agree.isNull(), "unvalidated").otherwise("validator_mismatch"))
    ok = F.col("status").isin("resolved", "unvalidated")
    renewed = F.array(*map(F.lit, RENEWED))
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", none), lambda k, v: F.array_contains(renewed, k))
    kept = F.map_filter(F.coalesce("hit.headers", none), lambda k, v: ~F.map_contains_key(fresh, k))
    out = found.select("record_id", F.col("url").alias("canonical_url"), "status", F.when(ok, F.col("hit.record_id")).alias("response_id"), F.when(ok, F.col("hit.payload_digest")).alias("payload_digest"), F.when(ok, F.map_concat(kept, fresh)).otherwise(F.col("headers")).alias("headers"))
    lost = narrow.where("(url is null or ts is null) and not full")
    return out.unionByName(lost.select("record_id", F.col("url").alias("canonical_url"), F.lit("no_response").alias("status"), F.lit(None).cast("long").alias("response_id"), F.lit(None).cast("string").alias("payload_digest"), "headers"))


def header_text(headers: Column) -> Column:
    """A header map as sorted lines."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


HUB = "https://www.hub.example/"


def crawl_log(pages: DataFrame) -> DataFrame:
    """Records of a crawl of all pages and of later conditional requests: what 304 answers leave in an archive.

    A page is fetched at ten times its id's seconds. Every third has changed four seconds later, every seventh has no tag. It is asked for again three and six seconds
    on, over http, with the first tag, and every fourth five seconds before its fetch. For every third page there is a request without validators for one common page, which is fetched anew
    with every fiftieth: a tenth of all records share that URL.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("p"), F.col("url").cast("string").alias("url"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.sha2(F.encode(F.concat(html, F.lit("v2")), "UTF-8"), 256).alias("digest2"), F.octet_length(html).cast("string").alias("n"))
    at = lambda s: F.timestamp_seconds(F.col("p") * 10 + s + 1000)
    tag = lambda d: F.concat(F.lit('"'), F.substring(d, 1, 16), F.lit('"'))
    date = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    string = lambda v: F.lit(v) if isinstance(v, str) else v
    known = lambda *pairs: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), string(v).alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull()))
    none = F.lit(None).cast("string")

    def response(i, s, url, digest, etag, n, when):
        headers = known(("content-type", "text/html"), ("content-length", n), ("etag", etag), ("date", date(at(s))))
        return F.when(when, F.struct(F.lit("response").alias("kind"), (F.col("p") * 8 + i).alias("record_id"), string(url).alias("url"), at(s).alias("ts"), headers.alias("headers"), digest.alias("payload_digest")))

    def revisit(i, s, url, etag, when):
        headers = known(("content-length", "0"), ("etag", etag), ("date", date(at(s))), ("cache-control", "max-age=60"))
        return F.when(when, F.struct(F.lit("revisit").alias("kind"), (F.col("p") * 8 + i).alias("record_id"), string(url).alias("url"), at(s).alias("ts"), headers.alias("headers"), none.alias("payload_digest")))

    every = lambda n, k=0: F.pmod("p", F.lit(n)) == k
    plain, weak = F.regexp_replace("url", "^https:", "http:"), F.concat(F.lit("W/"), tag("digest"))
    records = F.array(
        response(0, 0, F.col("url"), F.col("digest"), F.when(~every(7), tag("digest")), F.col("n"), F.lit(True)), response(1, 4, F.col("url"), F.col("digest2"), tag("digest2"), F.col("n"), every(3)),
        response(6, 0, HUB, F.sha2(F.encode(F.concat(F.lit("hub"), F.col("p").cast("string")), "UTF-8"), 256), none, F.lit("3"), every(50)),
        revisit(2, 3, plain, weak, F.lit(True)), revisit(3, 6, plain, weak, F.lit(True)), revisit(4, -5, plain, weak, every(4)), revisit(5, 1, HUB.replace("https", "http"), none, every(3, 1)),
    )
    return p.select(F.explode(F.array_compact(records)).alias("r")).select("r.*")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(crawl_log(table(spark, sf_dir, "pages")))
    return out.select("record_id", "canonical_url", "status", "response_id", "payload_digest", header_text(F.col("headers")).alias("headers"))


_CANONICAL = r"""regexp_replace(lower(regexp_extract(url, '__URL__', 2)), '^www[0-9]*\.', '') ||
  CASE WHEN regexp_extract(url, '__URL__', 3) = '' OR (regexp_extract(url, '__URL__', 3) = '80' AND lower(regexp_extract(url, '__URL__', 1)) <> 'https') OR (regexp_extract(url, '__URL__', 3) = '443' AND lower(regexp_extract(url, '__URL__', 1)) <> 'http') THEN '' ELSE ':' || regexp_extract(url, '__URL__', 3) END ||
  regexp_replace(regexp_extract(url, '__URL__', 4), '/+$', '') ||
  CASE WHEN regexp_extract(url, '__URL__', 5) = '' THEN '' ELSE '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '__URL__', 5), '&'), lambda x: x <> '')), '&') END""".replace("__URL__", URL)
ORACLE = rf"""
WITH p AS (SELECT page_id AS p, {_CANONICAL} AS u, {_CANONICAL.replace("(url,", "(regexp_replace(url, '^https:', 'http:'),")} AS plain, sha256(coalesce(html, '')) AS d, sha256(coalesce(html, '') || 'v2') AS d2, strlen(coalesce(html, ''))::VARCHAR AS n FROM pages),
resp AS (SELECT u, p * 10 AS s, p * 8 AS id, d AS digest, CASE WHEN p % 7 <> 0 THEN left(d, 16) END AS tag, n FROM p UNION ALL SELECT u, p * 10 + 4, p * 8 + 1, d2, left(d2, 16), n FROM p WHERE p % 3 = 0
  UNION ALL SELECT 'hub.example', p * 10, p * 8 + 6, sha256('hub' || p), NULL, '3' FROM p WHERE p % 50 = 0),
last AS (SELECT * FROM resp QUALIFY row_number() OVER (PARTITION BY u, s ORDER BY id DESC) = 1),
rev AS (SELECT plain AS u, p * 10 + unnest([3, 6]) AS s, p * 8 + unnest([2, 3]) AS id, left(d, 16) AS tag FROM p UNION ALL SELECT plain, p * 10 - 5, p * 8 + 4, left(d, 16) FROM p WHERE p % 4 = 0 UNION ALL SELECT 'hub.example', p * 10 + 1, p * 8 + 5, NULL FROM p WHERE p % 3 = 1),
j AS (SELECT rev.*, last.id AS hit, last.digest, last.tag AS have, last.n, strftime(to_timestamp(rev.s + 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS date FROM rev ASOF LEFT JOIN last ON rev.u = last.u AND rev.s > last.s),
k AS (SELECT *, CASE WHEN hit IS NULL THEN 'no_response' WHEN tag IS NULL OR have IS NULL THEN 'unvalidated' WHEN tag = have THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM j), o AS (SELECT *, status IN ('resolved', 'unvalidated') AS ok FROM k)
SELECT id AS record_id, u AS canonical_url, status, CASE WHEN ok THEN hit END AS response_id, CASE WHEN ok THEN digest END AS payload_digest,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || CASE WHEN ok THEN n ELSE '0' END || CASE WHEN ok THEN chr(10) || 'content-type: text/html' ELSE '' END || chr(10) || 'date: ' || date ||
  CASE WHEN tag IS NOT NULL THEN chr(10) || 'etag: W/"' || tag || '"' WHEN ok AND have IS NOT NULL THEN chr(10) || 'etag: "' || have || '"' ELSE '' END AS headers FROM o
"""

QUERIES = {"op10_warc_revisits": op10_warc_revisits}
ORACLES = {"op10_warc_revisits": ORACLE}
