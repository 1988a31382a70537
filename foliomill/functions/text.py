"""Text columns: trimming, entities, Markdown clean-up, chunking, summary helpers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill import fixed_values as fv


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(col, F.lit(fv.WHITE_SPACE))


def ordered_concat(position: str, value: str, separator: str = "") -> Column:
    """Aggregate: the non-null values of a group joined in the order of a position column."""
    pairs = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(position, value)))
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: p[value]), separator)


def collapse_spaces(col: Column) -> Column:
    """Runs of HTML white space become one space, as a browser shows them."""
    return F.regexp_replace(col, r"[ \t\r\n\f]+", " ")


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# 252 names of HTML 4 from the standard library, plus the one XML adds.
ENTITY_TEXT = {**{n: chr(c) for n, c in sorted(name2codepoint.items())}, "apos": "'"}
ENTITY_PIECES = r"&#[xX][0-9a-fA-F]{1,6};?|&#[0-9]{1,7};?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"

def _names_by_letter() -> str:
    """An array of maps, one for each first letter from A to z, that planning folds into a constant."""
    maps = []
    for letter in map(chr, range(ord("A"), ord("z") + 1)):
        pairs = [f"{quoted(n)}, {quoted(t)}" for n, t in ENTITY_TEXT.items() if n[0] == letter]
        maps.append(f"map({', '.join(pairs)})" if pairs else "cast(map() as map<string, string>)")
    return f"array({', '.join(maps)})"


# What a piece is follows from its second character; a number is read once.  The empty piece cannot be.
_DECODE_PIECE = f"""
p -> case
  when not startswith(p, '&') or length(p) = 1 then p
  when substr(p, 2, 1) = '#' then element_at(transform(
    array(cast(case when substr(p, 3, 1) in ('x', 'X') then conv(rtrim(';', substr(p, 4)), 16, 10) else rtrim(';', substr(p, 3)) end as int)),
    c -> case
      when c between 1 and 255 then chr(c)
      when c between 256 and 55295 or c between 57344 and 1114111 then decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')
      else '' end), 1)
  else coalesce(element_at(element_at({_names_by_letter()}, ascii(substr(p, 2, 1)) - {ord("A") - 1}), substr(p, 2, length(p) - 2)), p)
end"""


def decode_entities(col: Column) -> Column:
    """Decode numeric and named character references in one pass, so ``&amp;lt;`` stays ``&lt;``."""
    pieces = F.regexp_extract_all(col, F.lit(ENTITY_PIECES), F.lit(0))
    decoded = F.array_join(F.call_function("transform", pieces, F.expr(_DECODE_PIECE)), "")
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is given a name: evaluated once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def where_contains(text: Column, needle: str, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to the texts that contain a literal; a plain search is cheaper than a pattern."""
    return bind(text, lambda t: F.when(F.contains(t, F.lit(needle)), change(t)).otherwise(t))


def each_line(text: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to every line.  Looks at line ends only, where a pattern would try every space."""
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def unix_lines(text: Column) -> Column:
    """All line breaks as newlines.  Searches for one character at a time are cheaper than a pattern of all."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("\n")), ["\r\n", *fv.LINE_BREAKS.replace("\n", "")], text)


def clean_markdown(col: Column) -> Column:
    """Right-strip lines, drop lines of only pipes, squeeze blank lines, set fences apart, strip."""

    def fences_apart(text: Column) -> Column:
        text = F.regexp_replace(text, r"([^\n])\n(```)", "$1\n\n$2")
        return F.regexp_replace(text, r"(```)\n([^\n])", "$1\n\n$2")

    lines = F.transform(F.split(unix_lines(col), "\n"), lambda s: F.rtrim(s, F.lit(fv.WHITE_SPACE)))
    only_pipes = lambda s: F.endswith(s, F.lit("|")) & (F.btrim(s, F.lit(fv.WHITE_SPACE + "|")) == "")
    text = F.array_join(F.filter(lines, lambda s: ~only_pipes(s)), "\n")
    text = where_contains(text, "\n\n\n", lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return strip(where_contains(text, "```", fences_apart))


def content_md5(col: Column) -> Column:
    return F.md5(col)


def strip_noise_chars(col: Column) -> Column:
    """NBSP to space; zero-width and non-printing characters away (tab and line breaks stay)."""
    return F.regexp_replace(F.translate(col, "\xa0", " "), f"[{fv.NOISE_CHAR_CLASS}]", "")


def chunk_text(col: Column, max_chars: int = fv.CHUNK_MAX_CHARS) -> Column:
    """Array of chunks cut at blank lines; a paragraph longer than the limit stays whole.

    A fold over the paragraphs of one row: no shuffle, and the state is the chunks plus the open one.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, para: Column) -> Column:
        is_open = acc["open"] != ""
        fits = F.length(acc["open"]) + F.length(para) + 2 <= max_chars
        done = F.when(is_open & ~fits, F.concat(acc["done"], F.array(strip(acc["open"])))).otherwise(acc["done"])
        grown = F.when(is_open & fits, F.concat(acc["open"], F.lit("\n\n"), para)).otherwise(para)
        return F.struct(done.alias("done"), grown.alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.concat(acc["done"], F.array(strip(acc["open"])))).otherwise(acc["done"])

    packed = F.aggregate(F.split(col, "\n\n"), start, step, finish)
    return F.when(F.length(col) <= max_chars, F.array(col)).otherwise(packed)


def summary_input(title: Column, content: Column) -> Column:
    """What a summariser is given: the title and the opening of the content (the cut is the feature)."""
    head, tail = fv.SUMMARY_PROMPT.split("{}")[:2]
    return F.concat(F.lit(head), title, F.lit(tail), F.substring(content, 1, fv.SUMMARY_INPUT_CHARS))


def summary_clamp(col: Column) -> Column:
    """A summary of more than 70 words keeps its first 60 and gets an ellipsis."""
    text = strip(col)
    words = F.split(text, f"[{fv.WHITE_SPACE_CLASS}]+")
    short = F.concat(F.array_join(F.slice(words, 1, fv.SUMMARY_KEEP_WORDS), " "), F.lit("..."))
    return F.when(F.size(words) > fv.SUMMARY_MAX_WORDS, short).otherwise(text)


def iso_timestamp(col: Column) -> Column:
    """ISO 8601 with offset; the fraction is left out when it is zero."""
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ssxxx")
    exact = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.date_format(col, "SSSSSS") == "000000", whole).otherwise(exact)
