"""HTML columns: attributes of a tag token, and what can be read off a page without its structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions.text import bind, decode_entities, strip

LANGUAGE_PATTERN = r"(?:^| )(?:language|lang|highlight)[_-](\w+)"


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute of a tag token, '' where absent."""
    value = F.regexp_extract(token, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    bare = bind(value, lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - F.lit(2))).otherwise(v))
    return bind(bare, decode_entities)


def class_list(token: Column) -> Column:
    """The class attribute with single spaces between the names."""
    return F.btrim(F.regexp_replace(attribute(token, "class"), r"[ \t\r\n\f]+", " "))


def code_language(classes: Column) -> Column:
    """Language of a code element: the first class like ``language-x``, ``lang_x``, ``highlight-x``.

    One pattern over the class list: a name starts at the beginning or after a space.
    """
    return F.regexp_extract(classes, LANGUAGE_PATTERN, 1)


def visible_html(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def joined_strings(inner: Column) -> Column:
    """Nested strings of an element, each stripped, joined with nothing between."""
    return F.array_join(F.transform(F.split(inner, "<[^>]*>"), lambda s: strip(decode_entities(s))), "")


def _first_inner(visible: Column, tag: str) -> Column:
    return F.regexp_extract(visible, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)


#: What ends a heading that is not closed: another heading, a block, or the end of its container.
_HEADING_END = r"</?(?:h[1-6]|" + "|".join(t for t in [*fv.BLOCK_TAGS, "ul", "ol", "li", "table", "tr", "td", "th", "pre", "blockquote", "hr"]) + r")[\s/>]"


def first_heading(visible: Column) -> Column:
    """Text of the first <h1>, up to its end tag, or where there is none before the next, up to what ends it."""
    inner = F.regexp_extract(visible, r"(?is)<h1(?:\s[^>]*)?>(.*?)(?:</h1\s*>|<h1[\s>]|\z)", 1)
    closed = visible.rlike(r"(?is)^(?:(?!<h1[\s>]).)*+<h1(?:\s[^>]*)?>(?:(?!<h1[\s>]).)*?</h1\s*>")
    return joined_strings(F.when(closed, inner).otherwise(F.get(F.split(inner, rf"(?i){_HEADING_END}"), F.lit(0))))


def h1_title(html: Column) -> Column:
    return bind(visible_html(html), first_heading)


def page_title(html: Column) -> Column:
    """First <title> up to its first separator, else first <h1> (as it is, even if empty), else a fixed word.

    A regular expression over the row: titles need no token table and no shuffle.
    """

    def short(full: Column) -> Column:
        return reduce(lambda t, sep: strip(F.substring_index(t, sep, 1)), fv.TITLE_SEPARATORS, full)

    def of(visible: Column) -> Column:
        heading = F.when(visible.rlike(r"(?i)<h1[\s>]"), first_heading(visible))
        fallback = F.coalesce(heading, F.lit(fv.UNTITLED))
        return bind(joined_strings(_first_inner(visible, "title")), lambda t: F.when(t != "", short(t)).otherwise(fallback))

    return bind(visible_html(html), of)
