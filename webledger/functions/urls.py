"""URL rules as column expressions, applied to whole tables in staged projections.

Every rule runs in the JVM. Each public function takes a DataFrame and adds columns to it, in
stages, so that no expression tree repeats its own inputs. A URL that is already canonical is
recognised by one regular expression and skips every later stage: its working columns are null,
and null inputs cost nothing. The last stage yields its column through a one-row ``stack``, which a
later filter on that column is not pushed through: pushed down, it would repeat every stage.
Expressions name columns only and are built once per process.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webledger.functions.punycode import host_to_ascii

# Query parameters that only track where a visitor came from.
TRACKING_PARAMS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "gclid",
    "fbclid",
)

# Schemes that can be crawled.
CRAWLABLE_SCHEMES = ("http", "https")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HOST_AND_PORT = r"^(?:[A-Za-z0-9\-]+\.[A-Za-z0-9.\-]*|localhost):[0-9]*(?:[/?]|$)"
_PATH_SAFE = r"A-Za-z0-9\-._~!$&'()*+,;=:@\[\]"
_ALREADY_CANONICAL = (
    r"^https?://[a-z0-9\-]++(?:\.[a-z0-9\-]++)*+(?=/)"
    r"(?:/(?![./])[A-Za-z0-9\-._~!$&'()*+,;=:@]++)*+/?\z"
)
_PLAIN_PAIR = r"^[A-Za-z0-9_.~\-]+=[A-Za-z0-9_.~\-]*$"
_H16 = "[0-9a-f]{1,4}"
_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!\])|(?=\]))){4}"
_BRACKET_HOST = (
    r"(?i)^\[(?:"
    rf"(?:{_H16}:){{7}}{_H16}"
    rf"|(?:{_H16}:){{6}}{_V4}"
    # one "::" stands for at least one group, so at most seven others are written out
    rf"|(?=(?:[0-9a-f.]*:){{2,8}}[0-9a-f.]*\])(?!.*::.*::)(?!.*:::)"
    rf"(?:{_H16}(?::{_H16})*)?::(?:(?:{_H16}:)*(?:{_H16}|{_V4}))?"
    r"|v[0-9a-f]+\.[^\]]+"
    r")\](?::.*)?$"
)
# Stands for an escaped slash while a path is decoded: a code point that is no character.
_SLASH_MARK = "\ufdd0"
_SLASH_MARK_ENCODED = "%EF%B7%90"
# The same for the two control characters that hold query parameters apart while these are sorted.
_NUL_MARK, _NUL_MARK_ENCODED = "\ufdd1", "%EF%B7%91"
_SOH_MARK, _SOH_MARK_ENCODED = "\ufdd2", "%EF%B7%92"
_BLANKS = "".join(chr(c) for c in range(0x21))


def after_first(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; null when there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def tidy(url: Column) -> Column:
    """Blanks around a URL and line breaks inside it are not part of it."""
    return F.translate(F.btrim(url, F.lit(_BLANKS)), "\t\r\n", "")


def _decoded(text: Column) -> Column:
    sound = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(sound)


def _encoded(text: Column) -> Column:
    out = F.url_encode(text)
    for made, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(made), F.lit(wanted))
    return out


# Escapes of characters that a path may hold as they are.
_PATH_LITERALS = {
    "%2F": "/",
    "%21": "!",
    "%24": "$",
    "%26": "&",
    "%27": "'",
    "%28": "(",
    "%29": ")",
    "%2A": "*",
    "%2B": "+",
    "%2C": ",",
    "%3B": ";",
    "%3D": "=",
    "%3A": ":",
    "%40": "@",
    "%5B": "[",
    "%5D": "]",
}


def escaped_path(path: Column) -> Column:
    """Illegal characters as escapes, needless escapes as characters, ``%2F`` left alone."""
    kept = F.regexp_replace(path, "(?i)%2F", _SLASH_MARK)
    out = _encoded(_decoded(F.replace(kept, F.lit("+"), F.lit("%2B"))))
    for escape, literal in _PATH_LITERALS.items():
        out = F.replace(out, F.lit(escape), F.lit(literal))
    return F.replace(out, F.lit(_SLASH_MARK_ENCODED), F.lit("%2F"))


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments folded away; ``..`` at the root stays at the root."""

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", done)
            .when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
            .otherwise(F.concat(done, F.array(segment)))
        )

    segments = F.split(path, "/")
    first = F.slice(segments, 1, 1)
    folded = F.aggregate(F.slice(segments, 2, F.size(segments)), first, step)
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    return F.array_join(F.when(ends_in_dots, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")


def _sorted_query(query: Column) -> Column:
    """Parameters decoded, sorted by (key, value), the tracking ones dropped, encoded again.

    While decoded, parameters are held apart by U+0001 and keys from values by U+0000, which sorts
    before every character, so that plain string order is the order of (key, value).
    """
    text = F.replace(F.replace(query, F.lit("\x00"), F.lit("%00")), F.lit("\x01"), F.lit("%01"))
    text = F.replace(F.replace(text, F.lit("%00"), F.lit(_NUL_MARK)), F.lit("%01"), F.lit(_SOH_MARK))
    text = F.replace(F.regexp_replace(F.btrim(text, F.lit("&")), "&+", "\x01"), F.lit("+"), F.lit("%20"))
    text = F.regexp_replace(text, "(^|\x01)([^=\x01]*)(?:=|(?=\x01|$))", "$1$2\x00")
    pairs = F.array_join(F.sort_array(F.split(_decoded(text), "\x01")), "\x01")
    names = "|".join(TRACKING_PARAMS)
    wanted = F.ltrim(F.regexp_replace(pairs, f"(^|\x01)(?:{names})\x00[^\x01]*", ""), F.lit("\x01"))
    out = _encoded(wanted)
    marks = {"%00": "=", "%01": "&", _NUL_MARK_ENCODED: "%00", _SOH_MARK_ENCODED: "%01"}
    for made, meant in marks.items():
        out = F.replace(out, F.lit(made), F.lit(meant))
    return out


def bracket_fault(authority: Column) -> Column:
    """True when an authority holds brackets that do not enclose an IPv6 address."""
    host = F.regexp_replace(authority, "^.*@", "")
    has_bracket = authority.contains("[") | authority.contains("]")
    return has_bracket & ~host.rlike(_BRACKET_HOST)


def _staged(df: DataFrame, working: dict[str, Column], result: Column, out: str) -> DataFrame:
    """Add working columns, each of which may use those before it, then ``result`` without them."""
    kept = [c for c in df.columns if c != out]
    staged = df.select("*", *[column.alias(name) for name, column in working.items()])
    return staged.select(*kept, F.stack(F.lit(1), result).alias(out))


@cache
def _canonical_stages(url_col: str) -> tuple[dict[str, Column], Column]:
    c = F.col
    whole = (
        F.when(c("_bare").startswith("//"), F.concat(F.lit("https:"), c("_bare")))
        .when(c("_bare").rlike(_HOST_AND_PORT), F.concat(F.lit("https://"), c("_bare")))
        .when(c("_bare").rlike(_SCHEME) | c("_bare").startswith("/"), c("_bare"))
        .when(c("_bare") == "", c("_bare"))
        .otherwise(F.concat(F.lit("https://"), c("_bare")))
    )
    has_authority = c("_tail").startswith("//")
    hierarchical = c("_scheme").isin(*CRAWLABLE_SCHEMES, "ftp", "")
    host = (
        F.when(c("_scheme") == "https", F.regexp_replace(F.lower("_named"), r"\.*(?::(?:443)?)?$", ""))
        .when(c("_scheme") == "http", F.regexp_replace(F.lower("_named"), r"\.*(?::(?:80)?)?$", ""))
        .otherwise(F.lower("_named"))
    )
    port = r":[0-9]*$"
    ascii_host = F.concat(host_to_ascii(F.regexp_replace("_host", port, "")), F.regexp_extract("_host", port, 0))
    untracked = ~F.substring_index("_query", "=", 1).isin(*TRACKING_PARAMS)
    working = {
        "_fast": c(url_col).rlike(_ALREADY_CANONICAL),
        "_bare": F.substring_index(F.when(~c("_fast"), tidy(c(url_col))), "#", 1),
        "_whole": F.when(c("_bare").isNotNull(), whole),
        "_scheme": F.lower(F.regexp_extract("_whole", _SCHEME, 1)),
        "_query": F.coalesce(after_first(c("_whole"), "?"), F.lit("")),
        "_head": F.substring_index("_whole", "?", 1),
        "_tail": F.when(
            c("_scheme") != "", F.substring("_head", F.length("_scheme") + 2, F.length("_head"))
        ).otherwise(c("_head")),
        "_authority": F.when(
            has_authority, F.substring_index(F.substring("_tail", F.lit(3), F.length("_tail")), "/", 1)
        ),
        "_path": F.when(
            has_authority, F.substring("_tail", F.length("_authority") + 3, F.length("_tail"))
        ).otherwise(c("_tail")),
        "_user": F.regexp_extract("_authority", "^(.*@)", 1),
        "_host": F.regexp_replace("_authority", "^.*@", ""),
        "_named": F.when(c("_host").rlike(r"[^\x00-\x7f]"), ascii_host).otherwise(c("_host")),
        "_bad": F.coalesce(bracket_fault(c("_authority")), F.lit(False)),
        "_legal": F.when(c("_path") == "", F.when(has_authority, "/").otherwise(""))
        .when(c("_path").rlike(rf"^[/{_PATH_SAFE}]*$"), c("_path"))
        .otherwise(escaped_path(c("_path"))),
        "_single": F.when(
            hierarchical & c("_legal").contains("//"), F.regexp_replace("_legal", "/{2,}", "/")
        ).otherwise(c("_legal")),
        "_sorted": F.when(c("_query") == "", "")
        .when(c("_query").rlike(_PLAIN_PAIR) & untracked, c("_query"))
        .otherwise(_sorted_query(c("_query"))),
        "_folded": F.when(
            hierarchical & c("_single").rlike(r"(?:^|/)\.{1,2}(?:/|$)"), without_dots(c("_single"))
        ).otherwise(c("_single")),
    }
    user = F.when(c("_user").isin("@", ":@"), "").otherwise(c("_user"))
    joined = F.concat(
        F.when(c("_scheme") == "", "").otherwise(F.concat(c("_scheme"), F.lit(":"))),
        F.when(has_authority, F.concat(F.lit("//"), user, host)).otherwise(""),
        c("_folded"),
        F.when(c("_sorted") == "", "").otherwise(F.concat(F.lit("?"), c("_sorted"))),
    )
    return working, F.when(c("_fast"), c(url_col)).when(~c("_bad"), joined)


def canonicalize(df: DataFrame, url_col: str = "url", out: str = "url_norm") -> DataFrame:
    """Add the canonical form of ``url_col``; null where the URL is malformed.

    Lower-case scheme and host, the host in ASCII (``xn--``), no default port, no fragment, dot segments and doubled slashes
    resolved, escapes made uniform, tracking parameters dropped, the rest sorted by (key, value).
    """
    return _staged(df, *_canonical_stages(url_col), out)


def scheme_of(url: Column) -> Column:
    """Lower-case scheme, ``""`` when the URL is relative."""
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host_of(url: Column) -> Column:
    """Lower-case host name without port or user; null when the URL names none."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1)
    bracketed = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    plain = F.substring_index(authority, ":", 1)
    return F.nullif(F.lower(F.when(authority.startswith("["), bracketed).otherwise(plain)), F.lit(""))


def canonical_host(url: Column) -> Column:
    """:func:`host_of` for canonical http(s) URLs, without a regular expression."""
    authority = F.substring_index(F.substring_index(F.substring_index(url, "/", 3), "/", -1), "@", -1)
    bracketed = F.substring_index(F.substring_index(authority, "]", 1), "[", -1)
    return F.when(authority.startswith("["), bracketed).otherwise(F.substring_index(authority, ":", 1))


def path_and_query(url: Column) -> Column:
    """The part of an absolute URL that robots patterns are matched against."""
    tail = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))


def is_crawlable(url: Column) -> Column:
    return F.coalesce(scheme_of(url).isin(*CRAWLABLE_SCHEMES), F.lit(False))


def same_host(url_a: Column, url_b: Column) -> Column:
    """Equal host names; two URLs without a host are never on the same one."""
    return F.coalesce(host_of(url_a) == host_of(url_b), F.lit(False))


@cache
def _resolve_stages(base_col: str, href_col: str) -> tuple[dict[str, Column], Column]:
    c = F.col
    foreign = (c("_scheme") != "") & (c("_scheme") != c("_base_scheme"))
    own = F.when(
        c("_scheme") != "", F.substring("_tidy", F.length("_scheme") + 2, F.length("_tidy"))
    ).otherwise(c("_tidy"))
    no_frag = F.substring_index("_rest", "#", 1)
    base_tail = F.substring_index(F.substring(base_col, F.length("_site") + 1, F.length(base_col)), "#", 1)
    relative = c("_rest").isNotNull()
    has_authority = c("_path").startswith("//")
    beside = F.concat(F.regexp_replace("_base_path", "[^/]*$", ""), c("_path"))
    merged = F.when(c("_path").startswith("/"), c("_path")).otherwise(F.regexp_replace(beside, "/{2,}", "/"))
    working = {
        "_simple": c(href_col).rlike(r"^/(?![/.])[^?#\x00-\x20]*+\z") & ~c(href_col).contains("/."),
        "_tidy": F.when(~c("_simple"), F.translate(F.ltrim(c(href_col)), "\t\r\n", "")),
        "_site": F.regexp_extract(base_col, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1),
        "_base_scheme": F.lower(F.substring_index("_site", ":", 1)),
        "_scheme": F.lower(F.regexp_extract("_tidy", _SCHEME, 1)),
        "_own": F.when(~c("_simple") & ~foreign, own),
        "_rest": F.when(c("_own").startswith("//"), F.regexp_replace("_own", "^//(?=[/?#]|$)", "")).otherwise(
            c("_own")
        ),
        "_fragment": F.coalesce(after_first(c("_rest"), "#"), F.lit("")),
        "_query": F.coalesce(after_first(no_frag, "?"), F.lit("")),
        "_path": F.substring_index(no_frag, "?", 1),
        "_base_path": F.when(relative, F.substring_index(base_tail, "?", 1)),
        "_base_query": F.when(relative, F.coalesce(after_first(base_tail, "?"), F.lit(""))),
        "_merged": F.when(~has_authority & (c("_path") != ""), merged),
        "_bad": F.when(
            c("_tidy").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*[\[\]]"),
            bracket_fault(F.regexp_extract("_tidy", r"^[^/]*//([^/?#]*)", 1)),
        ).otherwise(F.lit(False)),
        "_rooted": F.when(c("_merged").startswith("/"), c("_merged")).otherwise(
            F.concat(F.lit("/"), c("_merged"))
        ),
        "_folded": F.when(
            c("_rooted").rlike(r"(?:^|/)\.{1,2}(?:/|$)"), without_dots(c("_rooted"))
        ).otherwise(c("_rooted")),
    }
    query = F.when((c("_path") == "") & (c("_query") == ""), c("_base_query")).otherwise(c("_query"))
    joined = F.concat(
        F.when(has_authority, F.concat(c("_base_scheme"), F.lit(":"), c("_path")))
        .when(c("_path") == "", F.concat(c("_site"), c("_base_path")))
        .otherwise(F.concat(c("_site"), F.when(c("_folded") == "", "/").otherwise(c("_folded")))),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
        F.when(c("_fragment") == "", "").otherwise(F.concat(F.lit("#"), c("_fragment"))),
    )
    result = (
        F.when(c("_simple"), F.concat(c("_site"), c(href_col)))
        .when(c("_bad") | c("_rest").isNull(), c(href_col))
        .otherwise(joined)
    )
    return working, result


def resolve(df: DataFrame, base_col: str, href_col: str, out: str = "url") -> DataFrame:
    """Add the absolute form of ``href_col`` as seen from the page ``base_col`` (RFC 3986 5.2).

    An href with another scheme, or one whose authority cannot be read, comes back as written.
    """
    return _staged(df, *_resolve_stages(base_col, href_col), out)
