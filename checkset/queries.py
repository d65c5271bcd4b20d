"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkset import derived
from webledger import params
from webledger.functions import punycode
from webledger.functions import urls as url_rules
from webledger.operators import attempts as att
from webledger.operators import checks, joins, pacing, robots, urls
from webledger.plans import report
from webledger.plans.audit import audit
from webledger.plans.crawl import Crawl, crawl
from webledger.scale import store, work_dir
from webledger.sources import captures
from webledger.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pages with their own URL as base, in the shape of responses."""
    pages = derived.table(spark, sf, "pages")
    return pages.select(
        "page_id", url_rules.host_of(F.col("url")).alias("site_id"), "url", F.col("url").alias("final_url"),
        F.col("html").alias("text"),
    )


# --- URLs and links ---------------------------------------------------------------------------


@query
def canonical_urls(spark, sf):
    return urls.canonicalize(derived.table(spark, sf, "pages")).select("page_id", "url_norm")


@query
def canonical_forms(spark, sf):
    """Page URLs without a scheme, with doubled slashes, or with a parameter that has no value."""
    kind, bare = F.col("page_id") % 3, F.regexp_replace("url", "#.*$", "")
    flagged = F.concat(bare, F.when(bare.contains("?"), F.lit("&flag")).otherwise(F.lit("?flag")))
    written = (
        F.when(kind == 0, F.regexp_replace("url", "^https?://", ""))
        .when(kind == 1, F.regexp_replace("url", "^(https?://[^/?#]+)/", "$1//"))
        .otherwise(flagged)
    )
    pages = derived.table(spark, sf, "pages").select("page_id", written.alias("url"))
    return urls.canonicalize(pages).select("page_id", "url_norm")


@query
def distinct_urls(spark, sf):
    return urls.dedupe_urls(derived.table(spark, sf, "pages"), pick="page_id", keep=("page_id",))


@query
def international_hosts(spark, sf):
    """Every page URL at an internationalised host, in Unicode and in ASCII, small and capital: one canonical URL."""
    canonical = urls.canonicalize(derived.international_pages(spark, sf))
    shown = punycode.host_to_unicode(url_rules.host_of(F.col("url_norm")))
    return canonical.groupBy("page_id").agg(
        F.countDistinct("url").alias("forms"), F.countDistinct("url_norm").alias("canonical"),
        F.min("url_norm").alias("url_norm"), F.min(shown).alias("shown"),
    )


@query
def malformed_urls(spark, sf):
    pages = derived.table(spark, sf, "pages")
    broken = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://", "://[")).otherwise(F.col("url"))
    return urls.malformed_urls(pages.select("page_id", broken.alias("url"))).select("page_id", "url")


@query
def url_hosts(spark, sf):
    named = urls.with_host(derived.table(spark, sf, "pages"))
    return named.select("page_id", "host", url_rules.path_and_query(F.col("url")).alias("path"))


@query
def hosts(spark, sf):
    return urls.hosts(derived.table(spark, sf, "pages"))


@query
def page_links(spark, sf):
    links = urls.extract_links(_pages(spark, sf), keep=("page_id",))
    return links.select("page_id", "source_url", "pos", "href_raw", "url", "text")


@query
def referenced_links(spark, sf):
    """Links of pages whose hrefs and titles are written with character references of every kind."""
    pages = derived.referenced_pages(spark, sf)
    links = urls.extract_links(pages, keep=("page_id",))
    return links.select("page_id", "pos", "url")


@query
def referenced_findings(spark, sf):
    """Page checks on the same bodies: titles of references alone, and resources asked for by them."""
    found = checks.page_findings(derived.referenced_pages(spark, sf), ("title", "mixed"))
    return found.select("page_url", "message", "subject")


@query
def canonical_links(spark, sf):
    links = urls.canonicalize(urls.extract_links(_pages(spark, sf), keep=("page_id",)))
    return links.select("page_id", "pos", "url_norm")


@query
def link_kinds(spark, sf):
    """Links by host of the page and kind, the flagship: pages to hrefs to verdict-like classes."""
    links = urls.canonicalize(urls.extract_links(_pages(spark, sf)))
    kind = (
        F.when(F.col("url_norm").isNull(), "malformed")
        .when(~url_rules.is_crawlable(F.col("url_norm")), "non_http")
        .when(F.coalesce(url_rules.host_of(F.col("url_norm")) == F.col("site_id"), F.lit(False)), "internal")
        .otherwise("external")
    )
    return links.groupBy(F.col("site_id").alias("host"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("links"))


@query
def crawlable_links(spark, sf):
    pages = derived.tree_responses(spark, sf).withColumn("fetch_error", F.lit(None).cast("string"))
    return urls.crawlable(urls.extract_links(pages)).groupBy("page_url").agg(F.count(F.lit(1)).alias("links"))


@query
def same_host_links(spark, sf):
    pages = derived.tree_responses(spark, sf)
    kept = urls.same_host(urls.extract_links(pages), derived.tree_sites(spark, sf))
    return kept.groupBy("page_url").agg(F.count(F.lit(1)).alias("links"))


@query
def inlinks(spark, sf):
    return urls.inlinks(urls.extract_links(_pages(spark, sf)))


@query
def redirected(spark, sf):
    return urls.is_redirect(derived.responses(spark, sf)).select("page_id", "redirected")


@query
def parseable_pages(spark, sf):
    return urls.parseable(derived.responses(spark, sf)).select("page_id", "status")


# --- captures ---------------------------------------------------------------------------------


@query
def admit_bodies(spark, sf):
    taken = captures.ingest_captures(derived.raw_captures(spark, sf), derived.CAP, 15.0)
    return taken.select(
        "url", "status", "content_type", "body_state", "fetch_error", F.md5("text").alias("text_md5")
    )


@query
def decode_bodies(spark, sf):
    """Page bodies in six charsets, some of them broken: cut inside a character, or labelled wrongly."""
    pages, kind = derived.table(spark, sf, "pages"), F.col("page_id") % 6
    utf8, wide = F.encode("html", "UTF-8"), F.encode("html", "UTF-16LE")
    body = F.when(kind == 3, wide.substr(F.lit(1), F.length(wide) - 1)).when(kind == 4, F.encode("html", "UTF-16BE")).otherwise(utf8)
    names = ["utf-8", "iso-8859-1", "us-ascii", "utf-16le", "UTF-16BE", "windows-1252"]
    label = F.concat(F.lit("text/html; charset="), F.element_at(F.array(*map(F.lit, names)), (kind + 1).cast("int")))
    raw = pages.select(
        F.concat(F.lit("https://b.example/"), "page_id").alias("url"), F.lit(None).cast("string").alias("final_url"),
        F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), label).alias("headers"), body.alias("body"),
        F.lit(1.0).alias("elapsed_ms"), F.lit(None).cast("string").alias("fetch_error"),
    )
    taken = captures.ingest_captures(raw, 2**30)
    page = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")
    return taken.select(page.alias("page_id"), F.length("text").alias("n"), F.md5("text").alias("text_md5"))


@query
def deadline(spark, sf):
    timed = captures.apply_deadline(derived.responses(spark, sf).drop("text"), 0.5)
    return timed.select("page_id", "status", "fetch_error")


@query
def read_responses(spark, sf):
    path = f"{work_dir(spark)}/responses-{uuid.uuid4().hex}"
    derived.responses(spark, sf).withColumn(
        "content_type", F.when(F.col("page_id") % 3 > 0, F.col("content_type"))
    ).drop("page_id").write.json(path)
    read = captures.read_responses(spark, path, "json")
    return read.select("site_id", "url", "final_url", "status", "elapsed_ms", "content_type", "fetch_error")


@query
def read_robots(spark, sf):
    path = f"{work_dir(spark)}/robots-{uuid.uuid4().hex}"
    captured = derived.robots(spark, sf)
    upper = captured.withColumn("host", F.concat(F.upper("host"), F.lit(":443")))
    captured.unionByName(upper).write.parquet(path)
    return captures.robots_urls(captures.read_robots(spark, path)).select("host", "status", "robots_url")


@query
def lookup(spark, sf):
    """Every page asks for its URL, a third of them for that of page 0; of every page with an even id there is a capture."""
    pages, page = derived.table(spark, sf, "pages"), F.col("page_id")
    named = urls.canonicalize(pages, "url", "url")
    home = named.where(page == 0).select(F.col("url").alias("home"))
    asked = named.join(F.broadcast(home), F.lit(True), "left").select(F.when(page % 3 == 0, F.col("home")).otherwise(F.col("url")).alias("url"), "page_id")
    known = named.where(page % 2 == 0).select(
        "url",
        F.lit(None).cast("string").alias("final_url"),
        F.when(page % 5 > 0, F.length("html")).alias("status"),
        F.lit(None).cast("string").alias("content_type"),
        F.when(page % 5 == 0, "timeout").alias("fetch_error"),
    )
    found = joins.lookup(asked, known)
    return found.select("page_id", "url", "final_url", "status", "content_type", "fetch_error")


# --- reports over captures --------------------------------------------------------------------


@query
def status_counts(spark, sf):
    return report.status_counts(derived.visits(spark, sf))


@query
def status_class_counts(spark, sf):
    return report.status_class_counts(derived.visits(spark, sf))


@query
def slowest_pages(spark, sf):
    return report.slowest(derived.visits(spark, sf))


@query
def link_status(spark, sf):
    responses = derived.responses(spark, sf)
    pages = urls.canonicalize(_pages(spark, sf), "url", "url").withColumn("final_url", F.col("url"))
    links = urls.canonicalize(_linked_round(spark, sf, pages), "url")
    found = joins.link_status(links, responses)
    return found.select("page_url", F.col("url_norm").alias("target"), "target_status")


def _linked_round(spark, sf, pages: DataFrame) -> DataFrame:
    """Every page linking to the one with the id after the next: targets that the capture holds."""
    targets = pages.select(
        (F.col("page_id") - 2).alias("page_id"), "site_id", F.concat("url", F.lit("#x")).alias("url")
    )
    sources = pages.select("page_id", F.col("url").alias("page_url"), F.lit(0).alias("pos"))
    return sources.join(targets, "page_id")


@query
def broken_links(spark, sf):
    pages = urls.canonicalize(_pages(spark, sf), "url", "url")
    return checks.check_broken(_linked_round(spark, sf, pages), derived.responses(spark, sf))


# --- robots -----------------------------------------------------------------------------------


@query
def robots_state(spark, sf):
    return robots.robots_state(derived.robots(spark, sf)).select("host", "state")


@query
def robots_rules(spark, sf):
    rules = robots.parse_robots(derived.robots(spark, sf))
    return rules.select("host", "agent", "allow", "pattern", "pattern_len")


@query
def robots_group(spark, sf):
    rules = robots.select_group(robots.parse_robots(derived.robots(spark, sf)), "probe")
    return rules.select("host", "agent", "allow", "pattern")


@query
def robots_matches(spark, sf):
    asked = derived.table(spark, sf, "pages").select("page_id", "url")
    packed = robots.robots_hosts(derived.robots(spark, sf))
    matched = robots.match_rules(robots.join_host_state(asked, packed))
    return matched.select("page_id", F.size("matched").alias("matches"))


@query
def robots_rule_rows(spark, sf):
    """All pages at one host that has a rule for every page: rules found by their prefix."""
    asked = derived.one_host_urls(spark, sf)
    found = robots.match_rule_rows(asked, robots.rule_rows(derived.many_rules(spark, sf)))
    joined = asked.join(found, "url", "left")
    return joined.select("page_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("allow", F.lit(True)).alias("allowed"))


@query
def robots_allowed(spark, sf):
    asked = derived.table(spark, sf, "pages").select("page_id", "url")
    return robots.robots_allows(asked, derived.robots(spark, sf)).select("page_id", "allowed")


@query
def robots_allowed_probe(spark, sf):
    asked = derived.table(spark, sf, "pages").select("page_id", "url")
    return robots.robots_allows(asked, derived.robots(spark, sf), "probe").select("page_id", "allowed")


# --- attempts and pacing ----------------------------------------------------------------------


@query
def retry_outcome(spark, sf):
    return att.resolve_attempts(derived.attempts(spark, sf)).select(
        "request_id", "status", "fetch_error", "attempts_used"
    )


@query
def attempt_usage(spark, sf):
    return att.attempt_usage(derived.attempts(spark, sf))


@query
def backoff_audit(spark, sf):
    policy = params.RetryPolicy(base_delay=3600.0, max_delay=5000.0)
    found = att.backoff_audit(derived.attempts(spark, sf), policy)
    return found.select("request_id", "attempt", F.round(F.col("pause_ms") * 1000).cast("bigint").alias("pause_us"), "window_ms")


@query
def pace_schedule(spark, sf):
    return pacing.pace_schedule(derived.requests(spark, sf), derived.RATE)


@query
def pace_violations(spark, sf):
    log = derived.requests(spark, sf).withColumnRenamed("arrival_ms", "at_ms")
    return pacing.pace_violations(log, derived.RATE)


def _seventh_hostless(requests: DataFrame) -> DataFrame:
    """Every seventh host unknown, so that the null host is the heaviest of all."""
    return requests.withColumn("host", F.when(F.col("host") % 7 != 0, F.col("host")))


@query
def pace_schedule_hot(spark, sf):
    """Every host of more than a few requests counts as hot: the path of chunks, null host included."""
    return pacing.pace_schedule(_seventh_hostless(derived.requests(spark, sf)), derived.RATE, hot_rows=8)


@query
def pace_violations_hot(spark, sf):
    log = _seventh_hostless(derived.requests(spark, sf)).withColumnRenamed("arrival_ms", "at_ms")
    return pacing.pace_violations(log, derived.RATE, hot_rows=8)


# --- checks -----------------------------------------------------------------------------------


@query
def page_findings(spark, sf):
    found = checks.page_findings(derived.pages_with_metadata(spark, sf))
    return found.select("page_url", "check", "severity", "message", "subject")


@query
def mixed_content(spark, sf):
    return checks.check_mixed(derived.pages_with_metadata(spark, sf)).select("page_url", "subject")


@query
def own_check(spark, sf):
    """A check of the user's own next to built-in ones: pages that are nearly empty."""

    def short(pages: DataFrame) -> DataFrame:
        size = F.length("text")
        found = checks.finding("size", "info", F.concat(F.lit("only "), size.cast("string")), None)
        return pages.where(size < 2500).select("site_id", F.col("url").alias("page_url"), F.inline(F.array(found)))

    rules = [checks.Check("size", short), checks.Check("title", checks.check_title), checks.Check("h1", checks.check_h1)]
    found = checks.run_checks(derived.pages_with_metadata(spark, sf), rules)
    return found.groupBy("check", "severity", "message").agg(F.count(F.lit(1)).alias("n"))


@query
def redirect_chains(spark, sf):
    return checks.redirect_chains(derived.hops(spark, sf)).select("url", "final_url", "hops", "loop", "over_limit")


@query
def redirect_findings(spark, sf):
    found = checks.check_redirects(checks.redirect_chains(derived.hops(spark, sf)))
    return found.select("page_url", "severity", "message")


# --- crawls -----------------------------------------------------------------------------------


def crawl_trees(spark, sf) -> Crawl:
    return crawl(
        derived.tree_sites(spark, sf), derived.tree_responses(spark, sf), derived.tree_robots(spark)
    )


def crawl_orders(spark, sf) -> Crawl:
    return crawl(derived.order_sites(spark, sf), derived.order_responses(spark, sf))


@query
def crawl_reach(spark, sf):
    return crawl_trees(spark, sf).visits.select("site_id", "url", "depth", "accept_rank", "outcome", "status")


@query
def crawl_verdicts(spark, sf):
    return crawl_trees(spark, sf).verdicts.select(
        "site_id", "level", "source_rank", "page_url", "url_norm", "verdict"
    )


@query
def crawl_verdict_counts(spark, sf):
    return report.verdict_counts(crawl_trees(spark, sf).verdict_counts)


@query
def crawl_report(spark, sf):
    done = crawl_trees(spark, sf)
    row = report.build_report(derived.tree_sites(spark, sf), done.visits, done.verdict_counts)
    return row.select(
        "site_id", "pages_crawled", "links_found", F.to_json("status_counts").alias("status_counts"), "errors",
        "fetch_errors", "skipped_off_host", "skipped_robots", "skipped_non_http", "completed",
        F.concat_ws(",", F.transform("slowest", lambda s: s["url"])).alias("slowest"), "gate",
    )


@query
def order_reach(spark, sf):
    return crawl_orders(spark, sf).visits.select("url", "depth", "accept_rank", "outcome", "status")


@query
def order_verdict_counts(spark, sf):
    return crawl_orders(spark, sf).verdict_counts.select("verdict", "n")


@query
def audit_report(spark, sf):
    """The whole audit of the trees: crawl, page checks, broken links, counters."""
    done = audit(derived.tree_sites(spark, sf), derived.tree_responses(spark, sf), derived.tree_robots(spark))
    return done.report.select("site_id", "pages_crawled", "errors", "warnings", "completed", "gate")


@query
def audit_conflicts(spark, sf):
    """An audit where every link target was captured twice: failed and 404, failed and 200, or 404 and 200."""
    sites, captured = derived.conflicting_captures(spark, sf)
    done = audit(sites, captured)
    found = done.findings.where("severity = 'error'").groupBy("site_id").agg(F.count(F.lit(1)).alias("broken"))
    shown = done.report.select("site_id", "pages_crawled", "errors", "gate")
    return shown.join(found, "site_id", "left").withColumn("broken", F.coalesce("broken", F.lit(0)).cast("bigint"))


@query
def audit_summary(spark, sf):
    done = audit(derived.tree_sites(spark, sf), derived.tree_responses(spark, sf), derived.tree_robots(spark))
    shown = report.summary(done.crawl.visits, done.findings)
    return shown.groupBy("site_id", "section").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )


@query
def audit_written(spark, sf):
    """The report of the trees, written and read back."""
    done = audit(derived.tree_sites(spark, sf), derived.tree_responses(spark, sf), derived.tree_robots(spark))
    path = f"{work_dir(spark)}/summary-{uuid.uuid4().hex}"
    captures.write_summary(done.report, path)
    return spark.read.parquet(path).select("site_id", "pages_crawled", "errors", "warnings", "completed", "gate")


@query
def audit_jsonl(spark, sf):
    done = audit(derived.tree_sites(spark, sf), derived.tree_responses(spark, sf), derived.tree_robots(spark))
    path = f"{work_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    captures.write_report_jsonl(done.crawl.visits, done.findings, path)
    schema = (
        "site_id string, url string, status int, final_url string, elapsed_ms double, depth int, "
        f"checks array<{params.FINDING}>"
    )
    lines = spark.read.schema(schema).json(path)
    errors = F.size(F.filter("checks", lambda c: c["severity"] == "error"))
    return lines.select("site_id", "url", "status", "depth", "elapsed_ms", errors.alias("errors"))


@query
def page_sites_report(spark, sf):
    """Every captured page audited as a site of its own, from the raw pages."""
    pages = derived.table(spark, sf, "pages")
    sites = pages.select(
        F.col("page_id").cast("string").alias("site_id"), F.col("url").alias("seed_url"),
        F.lit(3).alias("max_depth"), F.lit(4).alias("max_pages"),
    )
    captured = pages.select(
        F.col("page_id").cast("string").alias("site_id"), "url", F.lit(None).cast("string").alias("final_url"),
        F.lit(200).alias("status"), F.lit(1.5).alias("elapsed_ms"), F.lit("text/html").alias("content_type"),
        F.col("html").alias("text"), F.lit(None).cast("string").alias("fetch_error"),
    )
    done = crawl(sites, captured)
    row = report.build_report(sites, done.visits, done.verdict_counts)
    return row.select("site_id", "pages_crawled", "links_found", "completed")


# --- streams ----------------------------------------------------------------------------------


def _table_stream(spark, sf, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: a path with a wildcard may be either."""
    schema = derived.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _page_stream(spark, sf) -> DataFrame:
    return _table_stream(spark, sf, "pages")


def _folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def stream_audit(spark, sf):
    arriving = _page_stream(spark, sf).select(
        F.lit("s").alias("site_id"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"),
        F.lit(1.5).alias("elapsed_ms"), F.col("html").alias("text"), F.lit(None).cast("string").alias("fetch_error"),
    )
    out = _folder(spark, "stream-audit")
    jobs.stream_audit(arriving, out, _folder(spark, "stream-progress")).awaitTermination()
    lines = spark.read.schema(f"url string, status int, checks array<{params.FINDING}>").json(out)
    messages = F.concat_ws("|", F.sort_array(F.transform("checks", lambda c: c["message"])))
    return lines.select("url", "status", messages.alias("messages"))


def _to_memory(spark, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream to its end, each batch written as a table; the last one is the result."""
    out = _folder(spark, "stream-out")

    def keep(rows: DataFrame, batch: int) -> None:
        target = out if mode == "complete" else f"{out}/batch={batch}"
        rows.write.mode("overwrite").parquet(target)

    started = stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True)
    started.option("checkpointLocation", _folder(spark, "stream-progress")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_dedupe(spark, sf):
    doubled = _page_stream(spark, sf).select(
        F.explode(F.array("url", F.concat("url", F.lit("#again")), F.regexp_replace("url", r"/\d.*$", "/./"))).alias("url")
    )
    return _to_memory(spark, jobs.stream_dedupe(doubled), "append").select("url_norm")


@query
def stream_dedupe_recent(spark, sf):
    """Events as requests in six files, the stream started again for each: every URL once a day, late rows dropped."""
    folder, out, progress = _folder(spark, "arrivals"), _folder(spark, "stream-out"), _folder(spark, "stream-progress")
    derived.arrivals(spark, sf).write.partitionBy("part").parquet(folder)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    for i in range(derived.FILES):
        arriving = spark.readStream.schema("url string, at timestamp").parquet(f"{folder}/part=[0-{i}]")
        once = jobs.stream_dedupe_recent(arriving, delay="6 days")
        started = once.writeStream.foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", progress)
        started.start().awaitTermination()
    seen = spark.read.schema("url_norm string, seen_from timestamp").parquet(out)
    return seen.select("url_norm", F.col("seen_from").cast("date").alias("day"))


@query
def stream_counts(spark, sf):
    size = F.length("html") + F.length("url")
    kinds = _page_stream(spark, sf).select((size % 3 * 100 + 200).cast("int").alias("status"))
    return _to_memory(spark, jobs.stream_counts(kinds, "status_class"), "complete")


@query
def stream_pace(spark, sf):
    asked = _table_stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("host"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("arrival_ms"),
    )
    out = _folder(spark, "stream-pace")
    jobs.stream_pace(asked, derived.RATE, out, _folder(spark, "stream-progress")).awaitTermination()
    granted = spark.read.schema("request_id bigint, host string, arrival_ms bigint, slot_ms bigint").parquet(out)
    return granted.select("request_id", "host", "arrival_ms", "slot_ms")


@query
def stream_pace_batches(spark, sf):
    """The events in eight files by time, a batch each: what earlier batches booked holds later ones back."""
    asked = derived.requests(spark, sf)
    low, high = asked.agg(F.min("arrival_ms"), F.max("arrival_ms")).first()
    part = F.floor((F.col("arrival_ms") - low) * 8 / (high - low + 1)).cast("int")
    folder = _folder(spark, "requests")
    asked.withColumn("part", part).write.partitionBy("part").parquet(folder)
    out, progress = _folder(spark, "stream-pace"), _folder(spark, "stream-progress")
    for i in range(8):  # an eighth arrives, the stream is started again and goes on where it was
        arriving = spark.readStream.schema(asked.schema).parquet(f"{folder}/part=[0-{i}]")
        jobs.stream_pace(arriving, derived.RATE, out, progress).awaitTermination()
    granted = spark.read.schema("request_id bigint, host string, arrival_ms bigint, slot_ms bigint").parquet(out)
    return granted.select("request_id", "host", "arrival_ms", "slot_ms")
