"""robots.txt as tables: host states, rule groups, and permission per URL.

A robots file is one row, so all of its lines are handled inside that row with array functions.
Rules of a host with few of them stay packed: asking about a URL costs one join on its host and no row per rule. Many rules
are rows, found by the literals that they begin with and, held to the end of the URL, end with: a URL is posted under those of
its own beginnings and ends that are as long as some rule's at its host, and joined to the rules that have both. Rules of one
pattern are one row with their number. Only those are tried, so the work grows with the patterns that may fit.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webledger import params
from webledger.functions import urls as url_rules
from webledger.operators.joins import pick
from webledger.scale import HOT_ROWS, join_to_one, store

# A host with more rules than this has them as rows; they do not travel with its URLs.
PACKED_RULES = 100
_RULE = "struct<allow:boolean,pattern:string,prefix:string,regex:string,pattern_len:int>"


def robots_state(robots: DataFrame) -> DataFrame:
    """Add ``state``: ``deny`` when rules may exist unread, ``allow`` when there are none, ``rules``."""
    state = (
        F.when(F.col("fetch_error").isNotNull(), "deny")
        .when(F.col("status") >= 500, "deny")
        .when(F.coalesce(F.col("status"), F.lit(0)) != 200, "allow")
        .when(F.col("text").isNull(), "allow")
        .otherwise("rules")
    )
    return robots.withColumn("state", state)


def _pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression that never backtracks over its wildcards.

    Each piece between wildcards may take its first match: a later one cannot help the rest. Only
    a piece held to the end of the URL has to look for its last match.
    """
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    pieces = F.split(F.regexp_replace(body, r"([\\.+?^(){}|\[\]$])", r"\\$1"), r"\*+")
    last = F.size(pieces) - 1

    def piece(text: Column, at: Column) -> Column:
        return (
            F.when((at == last) & anchored, F.concat(F.when(at > 0, ".*").otherwise(""), text, F.lit("$")))
            .when((at == 0) | (text == ""), text)
            .otherwise(F.concat(F.lit("(?>.*?"), text, F.lit(")")))
        )

    return F.concat(F.lit("^"), F.array_join(F.transform(pieces, piece), ""))


def _packed_rule(line: Column) -> Column:
    return _rule(F.substring(line, F.lit(3), F.length(line)), line.startswith("+"))


def _rule(written: Column, allow: Column) -> Column:
    beyond_ascii = written.rlike(r"[^\x00-\x7F]")
    escaped = F.replace(url_rules.escaped_path(written), F.lit("%3F"), F.lit("?"))
    pattern = F.when(beyond_ascii, escaped).otherwise(written)
    return F.struct(
        allow.alias("allow"),
        pattern.alias("pattern"),
        F.regexp_extract(pattern, r"^([^*$]*)", 1).alias("prefix"),
        _pattern_regex(pattern).alias("regex"),
        F.length(pattern).alias("pattern_len"),
    )


def _groups(text: Column) -> Column:
    """Groups of a robots file: consecutive agent lines and the rules under them.

    Every line that matters becomes ``u:agent:u``, ``+:pattern:r`` or ``-:pattern:r``; a group
    starts where an agent line follows a rule line. Other directives take no part in grouping.
    """
    lines = F.split(F.regexp_replace(text, "^\ufeff", ""), "\r\n|\r|\n")

    def line(raw: Column) -> Column:
        kept = F.regexp_replace(raw, "#.*$", "")
        word = F.lower(F.trim(F.substring_index(kept, ":", 1)))
        value = F.trim(F.coalesce(url_rules.after_first(kept, ":"), F.lit("")))
        return (
            F.when(~kept.contains(":"), F.lit(None).cast("string"))
            .when(word == "user-agent", F.concat(F.lit("u:"), F.lower(value), F.lit(":u")))
            .when(word == "allow", F.concat(F.lit("+:"), value, F.lit(":r")))
            .when(word == "disallow", F.concat(F.lit("-:"), value, F.lit(":r")))
        )

    joined = F.array_join(F.array_compact(F.transform(lines, line)), "\n")
    blocks = F.filter(F.split(joined, "(?<=:r\n)(?=u:)"), lambda b: b.startswith("u:"))

    def group(block: Column) -> Column:
        entries = F.transform(
            F.filter(F.split(block, "\n"), lambda e: e != ""),
            lambda e: F.substring(e, F.lit(1), F.length(e) - 2),
        )
        agents = F.transform(
            F.filter(entries, lambda e: e.startswith("u:")), lambda e: F.substring(e, F.lit(3), F.length(e))
        )
        # a directive without a pattern forbids and allows nothing
        rules = F.filter(entries, lambda e: ~e.startswith("u:") & (F.length(e) > 2))
        return F.struct(agents.alias("agents"), rules.alias("rules"))

    return F.transform(blocks, group)


def parse_robots(robots: DataFrame) -> DataFrame:
    """Robots files to one row per (host, agent, rule)."""
    with_rules = robots_state(robots).where(F.col("state") == "rules")
    groups = with_rules.select("host", F.explode(_groups(F.col("text"))).alias("_g"))
    per_agent = groups.select("host", F.explode("_g.agents").alias("agent"), F.col("_g.rules").alias("_rules"))
    rules = per_agent.select("host", "agent", F.explode("_rules").alias("_line"))
    packed = rules.withColumn("_r", _packed_rule(F.col("_line")))
    return packed.select("host", "agent", "_r.allow", "_r.pattern", "_r.regex", "_r.pattern_len")


def _chosen_agent(agents: Column, token: str) -> Column:
    """The most specific agent name that is part of our token; ``*`` is the least specific."""
    scored = F.transform(
        F.filter(agents, lambda a: (a == "*") | ((a != "") & F.contains(F.lit(token.lower()), a))),
        lambda a: F.struct(F.when(a == "*", 0).otherwise(F.length(a)).alias("score"), a.alias("agent")),
    )
    return F.array_max(scored)["agent"]


def select_group(rules: DataFrame, agent: str = params.ANY_AGENT) -> DataFrame:
    """The rules that hold for our token on each host: its own group, else that of ``*``."""
    agents = rules.groupBy("host").agg(F.collect_set("agent").alias("_agents"))
    chosen = agents.select("host", _chosen_agent(F.col("_agents"), agent).alias("agent"))
    return rules.join(chosen, ["host", "agent"], "left_semi")


def robots_hosts(robots: DataFrame, agent: str = params.ANY_AGENT) -> DataFrame:
    """One row per host: its state and, packed, the rules that hold for our token."""
    once = pick(robots.select("host", "status", "text", "fetch_error"), ["host"], ["fetch_error", "status"])
    read = robots_state(once).withColumn(
        "_groups", F.when(F.col("state") == "rules", _groups(F.col("text")))
    )
    read = read.withColumn(
        "_agent", _chosen_agent(F.array_distinct(F.flatten(F.col("_groups.agents"))), agent)
    )
    lines = F.flatten(
        F.transform(
            F.filter("_groups", lambda g: F.array_contains(g["agents"], F.col("_agent"))),
            lambda g: g["rules"],
        )
    )
    rules = F.coalesce(F.transform(lines, _packed_rule), F.array().cast(f"array<{_RULE}>"))
    return read.select("host", "state", rules.alias("rules"))


def join_host_state(
    urls: DataFrame, hosts: DataFrame, hot: DataFrame | bool | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``state`` and ``rules`` of its host to every URL; a host with very many URLs is salted."""
    named = urls.withColumn("host", url_rules.host_of(F.col("url")))
    return join_to_one(named, hosts, ["host"], ["url"], hot=hot, hot_rows=hot_rows)


@cache
def _fitting() -> Column:
    return F.filter(
        "rules",
        # a pattern that is all prefix needs no regular expression
        lambda r: F.col("_target").startswith(r["prefix"])
        & ((r["prefix"] == r["pattern"]) | F.rlike(F.col("_target"), r["regex"])),
    )


def match_rules(urls: DataFrame) -> DataFrame:
    """Add ``matched``: those of the URL's packed ``rules`` whose pattern fits path and query."""
    target = urls.withColumn("_target", url_rules.path_and_query(F.col("url")))
    return target.withColumn("matched", _fitting()).drop("_target")


def rule_rows(rules: DataFrame) -> DataFrame:
    """Rules (host, allow, pattern) with what is needed to match them."""
    return rules.select("host", _rule(F.col("pattern"), F.col("allow")).alias("_r")).select("host", "_r.*")


def _by_ends(rules: DataFrame) -> DataFrame:
    """(host, prefix, suffix, _rules): the distinct patterns with the same literals at both ends, each with its number of rules.

    The suffix is empty unless the pattern is held to the end of the URL. Of equal patterns, the one that allows decides.
    """
    pattern = F.col("pattern")
    held = F.substring_index(F.substring(pattern, F.lit(1), F.length(pattern) - 1), "*", -1)
    ended = rules.withColumn("suffix", F.when(pattern.endswith("$"), held).otherwise(F.lit("")))
    once = ended.groupBy("host", "prefix", "suffix", "pattern", "regex", "pattern_len").agg(
        F.max("allow").alias("allow"), F.count(F.lit(1)).alias("copies")
    )
    rule = F.struct("allow", "pattern", "regex", "pattern_len", "copies")
    return once.groupBy("host", "prefix", "suffix").agg(F.collect_list(rule).alias("_rules"))


def match_rule_rows(urls: DataFrame, rules: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(url, matches, allow) of every distinct URL that some rule fits: how many do, and what the decisive one says.

    ``rules`` has a row per rule (see :func:`rule_rows`). No URL meets a rule that does not begin like it, or does not end so.
    """
    asked = urls.select("url").where(F.col("url").isNotNull()).distinct()
    named = asked.select("url", url_rules.host_of(F.col("url")).alias("host"), url_rules.path_and_query(F.col("url")).alias("_target"))
    begun = store(_by_ends(rules), "rule-ends")
    # at most as many lengths as the longest prefix and suffix have characters, however many rules there are
    lengths = begun.groupBy("host").agg(F.collect_set(F.struct(F.length("prefix").alias("p"), F.length("suffix").alias("s"))).alias("_lengths"))
    placed = join_to_one(named, lengths, ["host"], ["url"], how="inner", hot_rows=hot_rows)
    size = F.length("_target")
    posted = placed.select("url", "host", "_target", F.explode(F.filter("_lengths", lambda n: (n["p"] <= size) & (n["s"] <= size))).alias("_n"))
    # the end in a regular expression is also that before a line break
    whole, before_break = F.col("_target"), F.regexp_replace("_target", "(\r\n|[\n\r\u0085\u2028\u2029])\\z", "")
    ends = F.array_distinct(F.array(F.right(whole, F.col("_n.s")), F.right(before_break, F.col("_n.s"))))
    prefix = F.substring(F.col("_target"), F.lit(1), F.col("_n.p")).alias("prefix")
    posted = posted.select("url", "host", "_target", prefix, F.explode(ends).alias("suffix"))
    met = join_to_one(posted, begun, ["host", "prefix", "suffix"], ["url"], how="inner", hot_rows=hot_rows)
    fits = F.filter("_rules", lambda r: (r["pattern"] == F.col("prefix")) | F.rlike(F.col("_target"), r["regex"]))
    fitting = met.select("url", F.inline(fits))
    best = F.max(F.struct("pattern_len", "allow"))["allow"]
    return fitting.groupBy("url").agg(F.sum("copies").alias("matches"), best.alias("allow"))


def wide_rules(hosts: DataFrame) -> DataFrame | None:
    """The rules of hosts with more than ``PACKED_RULES`` as a stored table of rows; None if there is no such host."""
    rows = store(hosts.where(F.size("rules") > PACKED_RULES).select("host", F.inline("rules")), "rules")
    return None if rows.isEmpty() else rows


def permitted(
    urls: DataFrame, hosts: DataFrame, hot: DataFrame | bool | None = None, hot_rows: int = HOT_ROWS, wide: DataFrame | None = None
) -> DataFrame:
    """Add ``allowed`` to URLs, given the packed table of :func:`robots_hosts` and what :func:`wide_rules` says of it."""
    if wide is None:
        joined = match_rules(join_host_state(urls, hosts, hot, hot_rows))
        return joined.withColumn("allowed", _verdict()).drop("host", "state", "rules", "matched")
    packed = hosts.withColumn("rules", F.when(F.size("rules") > PACKED_RULES, F.array().cast(f"array<{_RULE}>")).otherwise(F.col("rules")))
    joined = match_rules(join_host_state(urls, packed, hot, hot_rows))
    by_rows = match_rule_rows(urls, wide, hot_rows).select("url", F.col("allow").alias("_by_rows"))
    joined = join_to_one(joined, by_rows, ["url"], ["host"], hot_rows=hot_rows)
    verdict = F.when(F.col("state") == "rules", F.coalesce("_by_rows", _verdict())).otherwise(_verdict())
    return joined.withColumn("allowed", verdict).drop("host", "state", "rules", "matched", "_by_rows")


@cache
def _verdict() -> Column:
    ranked = F.transform("matched", lambda r: F.struct(r["pattern_len"].alias("n"), r["allow"].alias("allow")))
    by_rules = F.coalesce(F.array_max(ranked)["allow"], F.lit(True))
    return F.when(F.col("state") == "deny", False).when(F.col("state") == "rules", by_rules).otherwise(True)


def robots_allows(
    urls: DataFrame, robots: DataFrame, agent: str = params.ANY_AGENT, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``allowed`` to URLs. The longest fitting pattern decides; at equal length, allow does.

    A host without a robots capture answers like one without a robots file.
    """
    hosts = robots_hosts(robots, agent)
    return permitted(urls, hosts, hot_rows=hot_rows, wide=wide_rules(hosts))
