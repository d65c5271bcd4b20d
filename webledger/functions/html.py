"""What an HTML document says, read with regular expressions as column expressions.

Patterns use possessive quantifiers throughout: they never backtrack, so a hostile page costs
time in proportion to its length and no stack.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webledger.params import CP1252

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE})*+"


def _attribute_body(tag: str, name: str) -> str:
    """A start tag without its ``<``; the group is the first ``name`` attribute, quotes included."""
    before = rf"(?:[\s/]++|(?!{name}[\s/>=]){_ATTRIBUTE})*+"
    return rf"{tag}(?=[\s/]){before}{name}\s*+=\s*+({_VALUE}){_ATTRIBUTES}>"


_COMMENT = r"!--(?:.*?-->|.*+)"
# Elements whose content is text, not markup; that of a title is read by itself.
_RAW_ELEMENTS = ("script", "style", "textarea", "xmp", "iframe", "noembed", "noframes")
# The control characters that numeric references name by mistake, and what is meant.
_MEANT = {chr(0x80 + i): c for i, c in enumerate(CP1252) if c != "\ufffd"}


# The entities that every HTML writer must escape with.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_NUMERIC = r"^&#[0-9]+;?$"
_HEX = r"^&#[xX][0-9a-fA-F]+;?$"
_REFERENCES = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*+;?"
# In an attribute a name without a semicolon stays as written before a letter, a digit or an equals sign.
_ATTRIBUTE_TOKENS = rf"{_REFERENCES}=?|[^&]+|&"
_TEXT_TOKENS = rf"{_REFERENCES}|[^&]+|&"


@cache
def _named() -> tuple[Column, Column, int]:
    """All named character references, those that need no semicolon, and the longest of the latter.

    The table is the standard library's; it becomes one map literal when a plan is made.
    """
    with_semicolon = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
    bare = {name: text for name, text in html5.items() if not name.endswith(";")}

    def literal(table: dict[str, str]) -> Column:
        pairs = "\x01".join(f"{name}\x02{text}" for name, text in table.items())
        return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))

    return literal(with_semicolon), literal(bare), max(map(len, bare))


def _code_point(token: Column) -> Column:
    """A numeric reference; 0x80 to 0x9F mean the characters that windows-1252 has there."""
    digits = F.regexp_replace(token, "^&#[xX]?|;$", "")
    code = F.when(token.rlike(_HEX), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    code = F.when(usable, code).otherwise(F.lit(0xFFFD))
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(0x80, 0x9F), F.translate(character, "".join(_MEANT), "".join(_MEANT.values()))).otherwise(character)


def _decoded_token(token: Column, in_attribute: bool) -> Column:
    known, bare, longest = _named()
    numeric = F.when(token.rlike(_HEX) | token.rlike(_NUMERIC), _code_point(token))
    closed = token.endswith(";")
    name = F.regexp_replace(token, "^&|;$", "")
    whole = F.when(closed, F.try_element_at(known, name))
    if in_attribute:
        # "=" after a name without a semicolon keeps it as it is
        ended = F.when(token.endswith(";="), F.concat(F.try_element_at(known, F.regexp_replace(token, "^&|;=$", "")), F.lit("=")))
        found = F.coalesce(numeric, whole, ended, F.when(~token.endswith("="), F.try_element_at(bare, name)))
        return F.when(token.startswith("&"), F.coalesce(found, token)).otherwise(token)
    # the longest name that the token begins with
    lengths = F.sequence(F.least(F.length(name), F.lit(longest)), F.lit(2), F.lit(-1))
    sizes = F.when(F.length(name) >= 2, F.filter(lengths, lambda n: F.try_element_at(bare, F.substring(name, F.lit(1), n)).isNotNull()))
    size = F.get(sizes, F.lit(0))
    begun = F.concat(F.try_element_at(bare, F.substring(name, F.lit(1), size)), F.substring(token, size + 2, F.length(token)))
    return F.when(token.startswith("&"), F.coalesce(numeric, whole, begun, token)).otherwise(token)


def unescaped(text: Column, in_attribute: bool = False) -> Column:
    """Character references replaced by their characters: named ones (the longest that fits), and numeric ones."""
    basic = text
    for entity, character in _ENTITIES.items():
        basic = F.replace(basic, F.lit(entity), F.lit(character))
    tokens = F.regexp_extract_all(text, F.lit(_ATTRIBUTE_TOKENS if in_attribute else _TEXT_TOKENS), F.lit(0))
    return (
        F.when(~text.contains("&"), text)
        .when(text.rlike("&(?!(?:lt|gt|quot|apos|amp);)[A-Za-z#]"), F.array_join(F.transform(tokens, lambda t: _decoded_token(t, in_attribute)), ""))
        .otherwise(basic)
    )


def unquoted(value: Column) -> Column:
    """An attribute value as written, without the quotes around it, references decoded."""
    quoted = value.startswith('"') | value.startswith("'")
    inner = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return unescaped(inner, in_attribute=True)


_SKIPPED = "|".join(
    rf"{tag}(?=[\s/>]){_ATTRIBUTES}>.*?(?:</{tag}\s*+>|\z)" for tag in (*_RAW_ELEMENTS, "title")
)
_ANCHORS = rf"(?is)<(?:{_COMMENT}|{_SKIPPED}|{_attribute_body('a', 'href')})"


def raw_hrefs(text: Column) -> Column:
    """The href values of all anchors of a document, as written, in document order.

    One pass: comments and elements of raw text are matched whole, and yield nothing.
    """
    return F.array_remove(F.regexp_extract_all(text, F.lit(_ANCHORS), F.lit(1)), "")


# One expression for everything that is read from a document. Comments and elements of raw text are matched whole; what
# is wanted of a match is its first group: a start tag without its "<", or a title up to its end tag. The empty
# third group takes part only where the second does, and so tells which elements have a body to skip.
_WANTED = (
    rf"(?is)<(?:{_COMMENT}|(title(?=[\s/>]){_ATTRIBUTES}>.*?(?=</title\s*+>|\z)"
    rf"|(?:({'|'.join(_RAW_ELEMENTS)})()|a|img|meta|link|h1)(?=[\s/>]){_ATTRIBUTES}>)(?:\3.*?(?:</\2\s*+>|\z))?+)"
)


def tags(text: Column) -> Column:
    """Start tags of a document that facts are read from, in document order; titles with their text. One pass."""
    return F.array_remove(F.regexp_extract_all(text, F.lit(_WANTED), F.lit(1)), "")


def _of_tag(tags: Column, *names: str) -> Column:
    return F.filter(tags, lambda t: t.rlike(rf"(?i)^(?:{'|'.join(names)})[\s/>]"))


def _values(tags: Column, tag: str, name: str) -> Column:
    """The values, as written, of an attribute of all tags of a name that have it with a value."""
    body = rf"(?is)^{_attribute_body(tag, name)}"
    return F.filter(F.transform(_of_tag(tags, tag), lambda t: F.regexp_extract(t, body, 1)), lambda v: v != "")


def hrefs_of(tags: Column) -> Column:
    return _values(tags, "a", "href")


def sources_of(tags: Column) -> Column:
    """What images and scripts are read from, as written."""
    return F.concat(_values(tags, "img", "src"), _values(tags, "script", "src"))


def title_of(tags: Column) -> Column:
    """Trimmed text of the first title element; null when there is none."""
    found = F.get(_of_tag(tags, "title"), F.lit(0))
    text = F.regexp_replace(found, rf"(?is)^title(?=[\s/>]){_ATTRIBUTES}>", "")
    return F.trim(F.regexp_replace(unescaped(text), r"\s+", " "))


def _first_marked(tags: Column, tag: str, name: str, value: str) -> Column:
    """First ``tag`` whose attribute ``name`` is, or holds, the word ``value``."""
    marked = rf"(?is)[\s/]{name}\s*=\s*(?:\"\s*(?:[^\"]*\s)?{value}[\s\"]|'\s*(?:[^']*\s)?{value}[\s']|{value}[\s/>])"
    return F.get(F.filter(_of_tag(tags, tag), lambda t: t.rlike(marked)), F.lit(0))


def _attribute(start_tag: Column, tag: str, name: str) -> Column:
    """An attribute's value without quotes; null without the tag, or without the attribute."""
    return unquoted(F.nullif(F.regexp_extract(start_tag, rf"(?is)^{_attribute_body(tag, name)}", 1), F.lit("")))


def description_of(tags: Column) -> Column:
    """Trimmed meta description; null without the tag, ``""`` without content."""
    start_tag = _first_marked(tags, "meta", "name", "description")
    content = F.trim(F.regexp_replace(_attribute(start_tag, "meta", "content"), r"\s+", " "))
    return F.when(start_tag.isNotNull(), F.coalesce(content, F.lit("")))


def canonical_href_of(tags: Column) -> Column:
    """Target of the canonical link; null without the tag or its href."""
    return _attribute(_first_marked(tags, "link", "rel", "canonical"), "link", "href")


def h1_count_of(tags: Column) -> Column:
    return F.size(_of_tag(tags, "h1"))
