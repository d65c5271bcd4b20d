"""Inputs that the given tables lack, derived from them: the same rule in Spark and in DuckDB SQL.

Every rule is one pass over a whole table. ``*_SQL`` strings are common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webledger.functions import urls as url_rules
from webledger.operators.urls import canonicalize
from webledger.scale import HOT_ROWS, with_row_number

NONE = "CAST(NULL AS VARCHAR)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- responses from pages ---------------------------------------------------------------------

CANON_SQL = """
canon AS (
  SELECT page_id, html, CASE WHEN q = '' THEN base ELSE base || '?' || q END AS url_norm FROM (
    SELECT page_id, html, split_part(split_part(url, '#', 1), '?', 1) AS base,
      array_to_string(list_sort([x FOR x IN string_split(split_part(split_part(url, '#', 1), '?', 2), '&')
        IF x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)=')]), '&') AS q
    FROM pages))"""

RESPONSES_SQL = (
    CANON_SQL
    + """,
resp AS (
  SELECT page_id, regexp_extract(url_norm, '^https?://([^/:]+)', 1) AS site_id, url_norm AS url,
    CASE WHEN page_id % 13 = 0 THEN regexp_replace(url_norm, '^http:', 'https:') ELSE url_norm END AS final_url,
    CASE WHEN page_id % 20 = 11 THEN NULL WHEN page_id % 20 = 3 THEN 404
         WHEN page_id % 20 = 7 THEN 500 ELSE 200 END AS status,
    CASE WHEN page_id % 20 = 11 THEN NULL ELSE CAST((page_id * 37 % 997) + 0.5 AS DOUBLE) END AS elapsed_ms,
    CASE WHEN page_id % 10 = 4 THEN 'application/pdf' WHEN page_id % 10 = 8 THEN 'Text/HTML; charset=utf-8'
         ELSE 'text/html' END AS content_type,
    CASE WHEN page_id % 20 = 11 OR page_id % 10 = 4 THEN NULL ELSE html END AS text,
    CASE WHEN page_id % 20 = 11 THEN 'timeout' END AS fetch_error
  FROM canon)"""
)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id")
    pages = canonicalize(table(spark, sf, "pages"), "url", "url")
    failed = page % 20 == 11
    return pages.select(
        "page_id",
        url_rules.host_of(F.col("url")).alias("site_id"),
        "url",
        F.when(page % 13 == 0, F.regexp_replace("url", "^http:", "https:")).otherwise(F.col("url")).alias("final_url"),
        F.when(failed, None).when(page % 20 == 3, 404).when(page % 20 == 7, 500).otherwise(200).alias("status"),
        F.when(~failed, (page * 37 % 997) + 0.5).cast("double").alias("elapsed_ms"),
        F.when(page % 10 == 4, "application/pdf")
        .when(page % 10 == 8, "Text/HTML; charset=utf-8")
        .otherwise("text/html")
        .alias("content_type"),
        F.when(~failed & (page % 10 != 4), F.col("html")).alias("text"),
        F.when(failed, "timeout").alias("fetch_error"),
    )


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Every captured response taken as a visit of depth 0."""
    outcome = F.when(F.col("fetch_error").isNotNull(), "fetch_error").otherwise("fetched")
    return responses(spark, sf).withColumns({"outcome": outcome, "depth": F.lit(0)})


# --- raw captures from pages ------------------------------------------------------------------

CAP = 6000

RAW_SQL = """
raw AS (
  SELECT page_id, url, octet_length(encode(html)) AS size,
    CASE WHEN page_id % 10 = 4 THEN 'application/pdf' WHEN page_id % 10 = 8 THEN 'Text/HTML; charset=utf-8'
         WHEN page_id % 10 = 9 THEN '' WHEN page_id % 10 = 5 THEN 'text/plain' ELSE 'text/html' END AS content_type,
    CASE WHEN page_id % 7 = 2 THEN '99999999999999999999' WHEN page_id % 7 = 3 THEN 'many'
         WHEN page_id % 7 = 4 THEN '10' END AS declared,
    (page_id * 37 % 997) * 20.0 AS elapsed_ms, html
  FROM pages)"""

# Every third body has a content coding: whole, grown past the cap, not what its header says, or cut.
ENCODED_SQL = f"""{RAW_SQL},
encoded AS (
  SELECT page_id, url, content_type, declared, elapsed_ms, page_id % 3 = 0 AND page_id // 3 % 5 = 3 AS broken,
    CASE WHEN page_id % 3 > 0 THEN html WHEN page_id // 3 % 5 = 2 THEN repeat(html, 40)
         WHEN page_id // 3 % 5 = 4 THEN repeat('x', 700) ELSE html END AS html
  FROM raw)"""


def _encode(batches):
    """Bodies with their content coding, as the rule of ENCODED_SQL says."""
    import gzip
    import zlib

    import pyarrow as pa

    def one(page_id: int, html: str) -> tuple[bytes, str | None]:
        body, kind = html.encode(), page_id // 3 % 5
        if page_id % 3:
            return body, None
        if kind == 0:
            return gzip.compress(body, mtime=0), "gzip"
        if kind == 1:
            return zlib.compress(body), "Deflate"
        if kind == 2:
            raw = zlib.compressobj(wbits=-15)
            return raw.compress(body * 40) + raw.flush(), "deflate"
        if kind == 3:
            return body, "gzip"
        # 10 bytes of header, 5 of a stored block, then the bytes as they are
        return gzip.compress(b"x" * 1000, 0, mtime=0)[: 15 + 700], "identity, gzip"

    for batch in batches:
        made = [one(*row) for row in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())],
            names=["page_id", "url", "body", "coding"],
        )


def raw_captures(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id")
    kind = (
        F.when(page % 10 == 4, "application/pdf")
        .when(page % 10 == 8, "Text/HTML; charset=utf-8")
        .when(page % 10 == 9, None)
        .when(page % 10 == 5, "text/plain")
        .otherwise("text/html")
    )
    declared = F.when(page % 7 == 2, "99999999999999999999").when(page % 7 == 3, "many").when(page % 7 == 4, "10")
    headers = F.map_filter(
        F.create_map(F.lit("Content-Type"), kind, F.lit("content-length"), declared, F.lit("Content-Encoding"), F.col("coding")),
        lambda k, v: v.isNotNull(),
    )
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return pages.mapInArrow(_encode, "page_id bigint, url string, body binary, coding string").select(
        F.lit("s").alias("site_id"),
        "url",
        F.col("url").alias("final_url"),
        F.lit(200).alias("status"),
        headers.alias("headers"),
        "body",
        ((page * 37 % 997) * 20.0).cast("double").alias("elapsed_ms"),
        F.lit(None).cast("string").alias("fetch_error"),
    )


# --- pages with metadata and resources --------------------------------------------------------

_META = [
    ("page_id % 3 = 0", '<meta name="description" content="About page">'),
    ("page_id % 3 = 1", '<meta content="" name=description>'),
    ("page_id % 5 = 0", '<link rel="canonical" href="/elsewhere">'),
    ("page_id % 5 = 1", '<link href="." rel=canonical>'),
    ("page_id % 7 = 0", "<h1>Another</h1>"),
    ("page_id % 4 = 0", '<img alt="a > b" src="http://img.example/a.png">'),
    ("page_id % 4 = 1", "<script src='HTTP://js.example/x.js'></script>"),
    ("page_id % 6 = 0", "<!-- <img src=http://hidden.example/> <h1> -->"),
]

META_SQL = (
    CANON_SQL
    + """,
meta AS (
  SELECT page_id, url_norm AS url, CASE WHEN page_id % 11 = 0 THEN '<title> </title>' ELSE '' END || """
    + " || ".join(f"CASE WHEN {when} THEN '{text.replace(chr(39), chr(39) * 2)}' ELSE '' END" for when, text in _META)
    + """ || CASE WHEN page_id % 13 = 0 THEN regexp_replace(html, '<title>[^<]*</title>', '') ELSE html END AS text
  FROM canon)"""
)


def pages_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    pages = canonicalize(table(spark, sf, "pages"), "url", "url")
    parts = [F.when(F.expr(when), text).otherwise("") for when, text in _META]
    body = F.when(
        F.col("page_id") % 13 == 0, F.regexp_replace("html", "<title>[^<]*</title>", "")
    ).otherwise(F.col("html"))
    first = F.when(F.col("page_id") % 11 == 0, "<title> </title>").otherwise("")
    return pages.select(
        "page_id", F.lit("s").alias("site_id"), "url", F.col("url").alias("final_url"),
        F.concat(first, *parts, body).alias("text"),
    )


# --- URLs at internationalised hosts ----------------------------------------------------------

# A label in front of each host, by page; its ASCII form is the standard library's.
LABELS = ("b\u00fccher", "m\u00fcnchen", "fa\u00e7ade", "espa\u00f1a", "\u65e5\u672c\u8a9e", "\ud55c\uad6d\uc5b4", "\u043f\u0440\u0438\u043c\u0435\u0440", "\u03b5\u03bb\u03bb\u03ac\u03b4\u03b1-1")
ASCII_LABELS = tuple("xn--" + label.encode("punycode").decode() for label in LABELS)


def _label_sql(labels) -> str:
    return "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels)) + " END"


def international_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url): every page URL in four forms of its host."""
    upper = lambda labels: tuple(label.upper() for label in labels)
    forms = [F.expr(_label_sql(labels)) for labels in (LABELS, ASCII_LABELS, upper(LABELS), upper(ASCII_LABELS))]
    pages = table(spark, sf, "pages").select("page_id", "url", F.explode(F.array(*forms)).alias("label"))
    at = F.concat(F.regexp_extract("url", "^(https?://)", 1), F.col("label"), F.lit("."), F.regexp_replace("url", "^https?://", ""))
    return pages.select("page_id", at.alias("url"))


INTERNATIONAL_SQL = f"""{CANON_SQL},
named AS (SELECT page_id, url_norm, regexp_extract(url_norm, '^(https?://)', 1) AS scheme, regexp_replace(url_norm, '^https?://', '') AS rest,
  {_label_sql(ASCII_LABELS)} AS ascii, {_label_sql(LABELS)} AS label,
  -- scripts without capitals have three forms
  CASE WHEN page_id % 8 IN ({", ".join(str(i) for i, label in enumerate(LABELS) if label.upper() == label)}) THEN 3 ELSE 4 END AS forms FROM canon)"""

# --- bodies written with character references -------------------------------------------------

# (condition, body, target of its link)
_REFERENCES = [
    ("page_id % 2 = 0", '<a href="/a?x=1&amp;copy=2&copy=3&reg;&lang=en">', "'/a?x=1&copy=2&copy=3' || chr(174) || '&lang=en'"),
    ("page_id % 3 = 0", "<a href='/&eacute;t&eacute&#46;html'>", "'/' || chr(233) || 't' || chr(233) || '.html'"),
    ("page_id % 5 = 0", "<a href=/&notit;&notin;&NotEqualTilde;>", "'/&notit;' || chr(8713) || chr(8770) || chr(824)"),
    ("true", '<a href="/q&#150;&#x80;&#0;&lt">', "'/q' || chr(8211) || chr(8364) || chr(65533) || '<'"),
    ("page_id % 4 = 0", "<title>&Tab;&#32;&NewLine;</title>", None),
    ("page_id % 4 = 1", "<title>&notit</title>", None),
    ("page_id % 3 = 1", '<img src="http&colon;//img.example/&eacute;.png">', None),
]


def referenced_pages(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.when(F.expr(when), body).otherwise("") for when, body, _ in _REFERENCES]
    return table(spark, sf, "pages").select(
        "page_id", F.lit("s").alias("site_id"), "url", F.col("url").alias("final_url"), F.concat(*parts, F.col("html")).alias("text")
    )


REFERENCED_SQL = f"""
targets AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root,
    list_concat([x FOR x IN [{", ".join(f"CASE WHEN {when} THEN {target} END" for when, _, target in _REFERENCES if target)}] IF x IS NOT NULL],
      regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS t
  FROM pages)"""

# --- conflicting captures ---------------------------------------------------------------------

# Captures of a link target by kind: (status, fetch_error) each.
_CONFLICTS = [[(None, "timeout"), (404, None)], [(None, "refused"), (200, None)], [(404, None), (200, None)], []]


def conflicting_captures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(sites, responses): every page a site, its link targets captured twice, with different outcomes, or not at all."""
    from webledger.operators.urls import extract_links

    pages = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("site_id"), "page_id", "url", F.col("url").alias("final_url"), F.col("html").alias("text")
    )
    n = pages.count()
    sites = pages.select("site_id", F.col("url").alias("seed_url"), F.lit(1).alias("max_depth"), F.lit(PER_PAGE * n).alias("max_pages"))
    kind = (F.length("url_norm") + F.col("page_id")) % len(_CONFLICTS)
    targets = canonicalize(extract_links(pages, keep=("page_id",))).select("site_id", "page_id", "url_norm").distinct()
    outcome = lambda status, fault: F.struct(F.lit(status).cast("int").alias("status"), F.lit(fault).cast("string").alias("fetch_error"))
    taken = F.when(F.lit(False), F.array(outcome(None, None)))
    for i, kinds in enumerate(_CONFLICTS):
        if kinds:
            taken = taken.when(kind == i, F.array(*[outcome(*k) for k in kinds]))
    twice = targets.select("site_id", F.col("url_norm").alias("url"), F.explode(taken).alias("o")).select(
        "site_id", "url", F.col("url").alias("final_url"), "o.status", F.lit(2.5).alias("elapsed_ms"), F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("text"), "o.fetch_error",
    )
    own = pages.select(
        "site_id", "url", "final_url", F.lit(200).alias("status"), F.lit(1.5).alias("elapsed_ms"), F.lit("text/html").alias("content_type"),
        "text", F.lit(None).cast("string").alias("fetch_error"),
    )
    return sites, own.unionByName(twice)


# --- robots from hosts ------------------------------------------------------------------------

_ROBOTS = [
    "CASE WHEN n % 5 = 3 THEN 'User-agent: *' || chr(10) || 'Disallow: /en/ # english' || chr(10) || 'Allow: /en/1'",
    "WHEN n % 5 = 4 THEN 'user-agent: other' || chr(10) || 'user-agent: *' || chr(10) || 'DISALLOW: /*.html$' || chr(10)"
    " || 'Disallow:' || chr(10) || chr(10) || 'User-Agent: Probe' || chr(10) || 'Disallow: /*/5' || chr(10)"
    " || 'Disallow: /*?page='",
    "WHEN n % 5 = 0 THEN 'gone' END",
]
_ROBOTS_TEXT = " ".join(_ROBOTS)

ROBOTS_SQL = f"""
hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages),
robots AS (
  SELECT host, CASE n % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN NULL ELSE 200 END AS status,
    {_ROBOTS_TEXT} AS text, CASE WHEN n % 5 = 2 THEN 'refused' END AS fetch_error
  FROM (SELECT host, length(host) + ascii(substr(host, length(host) - 12, 1)) AS n FROM hosts))"""


def robots(spark: SparkSession, sf: str) -> DataFrame:
    from webledger.operators.urls import hosts

    named = hosts(table(spark, sf, "pages")).withColumn(
        "n", F.expr("length(host) + ascii(substr(host, length(host) - 12, 1))")
    )
    return named.select(
        "host",
        F.expr("CASE n % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN NULL ELSE 200 END").alias("status"),
        F.expr(_ROBOTS_TEXT).alias("text"),
        F.expr("CASE WHEN n % 5 = 2 THEN 'refused' END").alias("fetch_error"),
    )


# --- many rules of one host, from pages -------------------------------------------------------

_ALL_PATHS = "CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END"
_RULE_PATTERN = "CASE WHEN page_id % 7 = 0 THEN '/*' || right(path, 4) || '$' ELSE left(path, CAST(3 + page_id % 12 AS INT)) END"

MANY_RULES_SQL = f"""
paths AS (SELECT page_id, {_ALL_PATHS} AS path FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS p FROM pages)),
rules AS (SELECT page_id, page_id % 3 = 0 AS allow, {_RULE_PATTERN} AS pattern, path FROM paths)"""


def one_host_urls(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, path, url): the paths of all pages, at one host."""
    path = F.regexp_extract("url", "^https?://[^/?#]*([^#]*)", 1)
    pages = table(spark, sf, "pages").select("page_id", path.alias("p")).selectExpr("page_id", f"{_ALL_PATHS} AS path")
    return pages.withColumn("url", F.concat(F.lit("https://one.example"), F.col("path")))


def many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """(host, allow, pattern): a rule of that host for every page."""
    return one_host_urls(spark, sf).selectExpr("'one.example' AS host", "page_id % 3 = 0 AS allow", f"{_RULE_PATTERN} AS pattern")


# --- attempts and requests from events --------------------------------------------------------

ATTEMPTS_SQL = """
att AS (
  SELECT user_id * 100 + day(ts) AS request_id,
    row_number() OVER (PARTITION BY user_id * 100 + day(ts) ORDER BY ts, event_id) - 1 AS attempt,
    CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'error' THEN 503 WHEN 'signup' THEN 404 END AS status,
    CASE WHEN event_type = 'purchase' THEN 'refused' END AS fetch_error, ts AS started, value AS elapsed_ms
  FROM events)"""


def attempts(spark: SparkSession, sf: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    logged = table(spark, sf, "events").select(
        (F.col("user_id") * 100 + F.day("ts")).alias("request_id"), "ts", "event_id", "event_type", "value"
    )
    numbered = with_row_number(logged, ["request_id"], ["ts", "event_id"], "_n", hot_rows)
    kind = F.col("event_type")
    return numbered.select(
        "request_id",
        (F.col("_n") - 1).cast("int").alias("attempt"),
        F.when(kind.isin("view", "click"), 200).when(kind == "error", 503).when(kind == "signup", 404).alias("status"),
        F.when(kind == "purchase", "refused").alias("fetch_error"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("value").alias("elapsed_ms"),
    )


INTERVAL_MS = 21_600_000
RATE = 1000.0 / INTERVAL_MS

REQUESTS_SQL = """
req AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS host, epoch_us(ts) // 1000 AS arrival_ms FROM events)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("host"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("arrival_ms"),
    )


# Requests in six files by time; some come a file late, a few of the early ones four files late.
FILES = 6
ARRIVAL_SQL = f"""
arrival AS (
  SELECT event_id, user_id, ts, CASE WHEN event_id % 97 = 0 AND f + 4 < {FILES} THEN f + 4
      WHEN event_id % 50 = 0 AND f + 1 < {FILES} THEN f + 1 ELSE f END AS part,
    event_id % 97 = 0 AND f + 4 < {FILES} AS too_late
  FROM (SELECT *, CAST(floor((epoch_us(ts) - lo) * {FILES} / (hi - lo + 1)) AS INT) AS f
    FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)))"""


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """(url, at, part): requests as events, and the file that each comes in."""
    events = table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("at"), "event_id", "user_id")
    low, high = events.agg(F.min("us"), F.max("us")).first()
    placed = events.withColumn("f", F.floor((F.col("us") - low) * FILES / (high - low + 1)).cast("int"))
    part = f"CASE WHEN event_id % 97 = 0 AND f + 4 < {FILES} THEN f + 4 WHEN event_id % 50 = 0 AND f + 1 < {FILES} THEN f + 1 ELSE f END"
    return placed.selectExpr("concat('HTTPS://e.example:443/u/', user_id, '?gclid=', event_id) AS url", "at", f"{part} AS part")


# --- hops from pages --------------------------------------------------------------------------

# Every page's URL redirects to that of the next page, in chains of a few hops, some of 37, and loops.
HOPS_SQL = (
    CANON_SQL
    + """,
hops AS (
  SELECT c.page_id, c.url_norm AS url,
    CASE WHEN c.page_id % 200 BETWEEN 102 AND 138 THEN 301
         WHEN c.page_id % 4 = 3 AND c.page_id % 40 NOT BETWEEN 30 AND 36 THEN 200
         WHEN c.page_id % 9 = 8 THEN NULL ELSE 301 END AS status, n.url_norm AS location
  FROM canon c LEFT JOIN canon n ON n.page_id = CASE WHEN c.page_id % 40 = 21 AND c.page_id % 200 NOT BETWEEN 102 AND 138
    THEN c.page_id - 1 ELSE c.page_id + 1 END)"""
)


def hops(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id")
    long = (page % 200).between(102, 138)
    answered = (page % 4 == 3) & ~(page % 40).between(30, 36)
    target = F.when((page % 40 == 21) & ~long, page - 1).otherwise(page + 1)
    pages = table(spark, sf, "pages")
    named = pages.select(F.col("page_id").alias("target"), F.col("url").alias("location"))
    asked = pages.select(
        "url",
        F.when(long, 301).when(answered, 200).when(page % 9 == 8, None).otherwise(301).alias("status"),
        target.alias("target"),
    )
    return asked.join(named, "target", "left").drop("target")


# --- link graphs ------------------------------------------------------------------------------

_TREE_LINKS = [
    ("true", "'<a href=\"/' || (2 * k + 1) || '\">left</a>'", "'/' || (2 * k + 1)"),
    ("true", "'<A class=x HREF=''/' || (2 * k + 2) || '?utm_source=tree#top''>right</A>'", "'/' || (2 * k + 2)"),
    ("k % 3 = 0", "'<a href=\"../' || (2 * k + 1) || '#again\">'", "'/' || (2 * k + 1)"),
    ("true", "'<a href=' || CAST(floor(k / 3) AS INT) || '>up</a>'", "'/' || CAST(floor(k / 3) AS INT)"),
    ("k % 4 = 0", "'<a href=\"https://other.example/x\">'", "'https://other.example/x'"),
    ("k % 5 = 0", "'<a href=\"mailto:a@b.example\">'", "'mailto:a@b.example'"),
    ("k % 7 = 0", "'<a href=\"http://[::1\">'", NONE),
    ("k % 6 = 0", "'<a href=\"\"><a href>'", None),
]


def _graph_text(links) -> str:
    return " || ".join(f"CASE WHEN {when} THEN {html} ELSE '' END" for when, html, _ in links)


# The seed of site t1 answers at another host, where all of its other pages are.
_TREE_HOST = "CASE WHEN s = '1' AND k > 0 THEN 'www.g1.example' ELSE 'g' || s || '.example' END"
_TREE_FINAL = "CASE WHEN s = '1' AND k = 0 THEN 'https://www.g1.example/0' END"


def tree_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Four sites, each a tree over a quarter of the pages: their real bodies, with links up and down the tree behind."""
    pages = table(spark, sf, "pages").select(
        F.expr("CAST(page_id % 4 AS STRING)").alias("s"), F.expr("CAST(floor(page_id / 4) AS BIGINT)").alias("k"), "html"
    )
    failed = F.col("k") % 11 == 5
    return pages.select(
        F.concat(F.lit("t"), F.col("s")).alias("site_id"),
        F.expr(f"'https://' || {_TREE_HOST} || '/' || k").alias("url"),
        F.expr(_TREE_FINAL).alias("final_url"),
        F.when(~failed, F.when(F.col("k") % 13 == 6, 500).otherwise(200)).alias("status"),
        F.when(~failed, (F.col("k") * 37 % 101) + 0.5).cast("double").alias("elapsed_ms"),
        F.lit("text/html").alias("content_type"),
        F.when(F.col("k") % 17 != 9, F.concat(F.coalesce("html", F.lit("")), F.expr(_graph_text(_TREE_LINKS)))).alias("text"),
        F.when(failed, "refused").alias("fetch_error"),
    )


def _rows(spark: SparkSession, sf: str, name: str) -> int:
    return table(spark, sf, name).count()


# Limits that never bind, from a count of the table: no page is deeper than there are pages, and none links to so many.
PER_PAGE = 64


def tree_sites(spark: SparkSession, sf: str) -> DataFrame:
    """t1 has a budget of 20 pages and t3 three levels; the other limits never bind."""
    from webledger.params import SITES

    n = _rows(spark, sf, "pages")
    rows = [
        ("t0", "https://g0.example/0", n, PER_PAGE * n), ("t1", "HTTPS://G1.example:443/0#home", n, 20),
        ("t2", "https://g2.example/0", n, PER_PAGE * n), ("t3", "https://g3.example/0", 3, PER_PAGE * n),
    ]
    return spark.createDataFrame(rows, SITES)


def tree_robots(spark: SparkSession) -> DataFrame:
    from webledger.params import ROBOTS_CAPTURES

    return spark.createDataFrame(
        [("g2.example", 200, "User-agent: *\nDisallow: /1*\nAllow: /12$\n", None), ("g1.example", 404, None, None)],
        ROBOTS_CAPTURES,
    )


def order_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One site that holds every order as a page, linked by the keys of the order."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return orders.select(
        F.lit("shop").alias("site_id"),
        F.expr("'https://shop.example/' || k").alias("url"),
        F.lit(None).cast("string").alias("final_url"),
        F.lit(200).alias("status"),
        ((F.col("k") * 31 % 1009) + 0.25).cast("double").alias("elapsed_ms"),
        F.lit("text/html").alias("content_type"),
        F.expr(_graph_text(_ORDER_LINKS)).alias("text"),
        F.lit(None).cast("string").alias("fetch_error"),
    )


_ORDER_LINKS = [
    ("true", "'<a href=\"/0\">home</a>'", "'/0'"),
    ("true", "'<a href=\"/' || c || '\">'", "'/' || c"),
    ("true", "'<a href=\"/' || (3 * k + c) || '\">'", "'/' || (3 * k + c)"),
    ("true", "'<a href=\"/' || (k + 1) || '\">'", "'/' || (k + 1)"),
    ("true", "'<a href=\"./' || (5 * c + 7) || '?b=2&amp;a=1&gclid=z\">'", "'/' || (5 * c + 7) || '?a=1&b=2'"),
    ("k % 6 = 0", "'<a href=\"https://pay.example/' || c || '\">'", "'https://pay.example/' || c"),
]

def order_sites(spark: SparkSession, sf: str) -> DataFrame:
    from webledger.params import SITES

    n = _rows(spark, sf, "orders")
    return spark.createDataFrame([("shop", "https://shop.example/0", n, PER_PAGE * n)], SITES)


def _link_rows(links, root: str) -> str:
    """DuckDB rows (site_id, page, pos, target) for the hrefs of a graph, in document order."""
    parts = []
    for place, (when, _, target) in enumerate(links):
        if target is None:
            continue
        full = f"CASE WHEN {target} LIKE '/%' THEN {root} || {target} ELSE {target} END"
        parts.append(f"SELECT site_id, url AS page, {place} AS pos, {full} AS target FROM graph WHERE {when}")
    return " UNION ALL ".join(parts)


# Links of the real bodies come first, those of the tree behind them.
TREE_GRAPH_SQL = f"""
graph AS (
  SELECT 't' || s AS site_id, s, k, html, 'https://' || {_TREE_HOST} || '/' || k AS url,
    'https://' || CASE WHEN s = '1' THEN 'www.g1.example' ELSE 'g' || s || '.example' END AS root
  FROM (SELECT CAST(page_id % 4 AS VARCHAR) AS s, page_id // 4 AS k, coalesce(html, '') AS html FROM pages)),
node AS (
  SELECT site_id, url, CASE WHEN k % 11 = 5 THEN 'refused' END AS fetch_error,
    CASE WHEN k % 11 = 5 THEN NULL WHEN k % 13 = 6 THEN 500 ELSE 200 END AS status,
    CASE WHEN k % 11 = 5 THEN NULL ELSE CAST((k * 37 % 101) + 0.5 AS DOUBLE) END AS elapsed_ms,
    k % 11 <> 5 AND k % 17 <> 9 AS has_text FROM graph),
real AS (
  SELECT site_id, url, root, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS n
  FROM (SELECT site_id, url, root, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM graph)),
link AS (
  SELECT site_id, url AS page, n - 1000000 AS pos, root || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS target FROM real
  UNION ALL {_link_rows(_TREE_LINKS, "root")}),
landed AS (SELECT 't1' AS site_id, 'https://www.g1.example/0' AS url),
site AS (SELECT site_id, url, host, coalesce(depth, n) AS max_depth, coalesce(pages, {PER_PAGE} * n) AS max_pages
  FROM (SELECT count(*) AS n FROM pages), (VALUES
    ('t0', 'https://g0.example/0', 'g0.example', NULL, NULL), ('t1', 'https://g1.example/0', 'www.g1.example', NULL, 20),
    ('t2', 'https://g2.example/0', 'g2.example', NULL, NULL), ('t3', 'https://g3.example/0', 'g3.example', 3, NULL)
  ) AS v(site_id, url, host, depth, pages))"""
TREE_ALLOWED = "NOT (url LIKE 'https://g2.example/1%' AND url <> 'https://g2.example/12')"

ORDER_GRAPH_SQL = f"""
graph AS (
  SELECT 'shop' AS site_id, o_orderkey AS k, o_custkey AS c, 'https://shop.example/' || o_orderkey AS url FROM orders),
node AS (
  SELECT site_id, url, {NONE} AS fetch_error, 200 AS status, CAST((k * 31 % 1009) + 0.25 AS DOUBLE) AS elapsed_ms, true AS has_text
  FROM graph),
link AS ({_link_rows(_ORDER_LINKS, "'https://shop.example'")}),
landed AS (SELECT {NONE} AS site_id, {NONE} AS url WHERE false),
site AS (SELECT 'shop' AS site_id, 'https://shop.example/0' AS url, 'shop.example' AS host, count(*) AS max_depth,
  {PER_PAGE} * count(*) AS max_pages FROM orders)"""


def crawl_sql(graph: str, allowed: str, levels: int) -> str:
    """The crawl rules unrolled level by level; ``visit`` and ``judged`` are the results."""

    def visited(source: str) -> str:
        return f"""
  SELECT f.site_id, f.url, f.depth, f.rank, f.host, f.max_depth, f.max_pages,
    CASE WHEN NOT ({allowed.replace("url", "f.url")}) THEN 'robots'
         WHEN n.fetch_error IS NOT NULL THEN 'fetch_error' ELSE 'fetched' END AS outcome,
    CASE WHEN n.url IS NULL THEN 404 ELSE n.status END AS status, n.elapsed_ms, coalesce(n.has_text, false) AS has_text
  FROM ({source}) f LEFT JOIN node n ON n.site_id = f.site_id AND n.url = f.url"""

    start = "SELECT site_id, url, 0 AS depth, CAST(0 AS BIGINT) AS rank, host, max_depth, max_pages FROM site"
    ctes = [graph, f"v0 AS MATERIALIZED ({visited(start)})"]
    for d in range(1, levels + 1):
        seen = " UNION ALL ".join([f"SELECT site_id, url FROM v{e}" for e in range(d)] + ["SELECT site_id, url FROM landed"])
        ctes.append(f"""
c{d} AS MATERIALIZED (
  SELECT v.site_id, v.rank, v.url AS page_url, l.pos, l.target, v.host, v.max_depth, v.max_pages
  FROM v{d - 1} v JOIN link l ON l.site_id = v.site_id AND l.page = v.url
  WHERE v.outcome = 'fetched' AND v.has_text),
d{d} AS MATERIALIZED (
  SELECT o.*, CASE WHEN o.target IS NULL THEN 'malformed' WHEN s.url IS NOT NULL THEN 'duplicate'
      WHEN NOT regexp_matches(o.target, '^https?:') THEN 'non_http'
      WHEN regexp_extract(o.target, '^https?://([^/:?]+)', 1) <> o.host THEN 'off_host'
      WHEN {d} > o.max_depth THEN 'too_deep' ELSE 'open' END AS verdict
  FROM (SELECT site_id, target, host, max_depth, max_pages, min(rank * 16777216 + pos) AS first
        FROM c{d} GROUP BY ALL) o
  LEFT JOIN ({seen}) s ON s.site_id = o.site_id AND s.url = o.target),
a{d} AS MATERIALIZED (
  SELECT * FROM (
    SELECT d.site_id, d.target AS url, {d} AS depth, d.host, d.max_depth, d.max_pages,
      b.base + row_number() OVER (PARTITION BY d.site_id ORDER BY d.first) - 1 AS rank
    FROM d{d} d JOIN (SELECT site_id, max(rank) + 1 AS base FROM v{d - 1} GROUP BY site_id) b USING (site_id)
    WHERE d.verdict = 'open') WHERE rank < max_pages),
v{d} AS MATERIALIZED ({visited(f"SELECT * FROM a{d}")}),
j{d} AS (
  SELECT c.site_id, {d} AS level, c.rank AS source_rank, c.page_url, c.pos, c.target AS url_norm,
    CASE WHEN c.target IS NULL THEN 'malformed' WHEN d.verdict <> 'open' THEN d.verdict
         WHEN a.url IS NULL THEN 'budget_full'
         WHEN c.rank * 16777216 + c.pos = d.first THEN 'accepted' ELSE 'duplicate' END AS verdict
  FROM c{d} c LEFT JOIN d{d} d ON d.site_id = c.site_id AND d.target = c.target
  LEFT JOIN a{d} a ON a.site_id = c.site_id AND a.url = c.target)""")
    ctes.append("visit AS (" + " UNION ALL ".join(f"SELECT * FROM v{d}" for d in range(levels + 1)) + ")")
    ctes.append("judged AS (" + " UNION ALL ".join(f"SELECT * FROM j{d}" for d in range(1, levels + 1)) + ")")
    return "WITH " + ",".join(ctes)
