"""Output records: Markdown blocks, text blocks, JSON lines, tables of contents, file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions.text import strip


def _filled(template: str, *values: Column) -> Column:
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def page_block(title: Column, url: Column, content: Column, collected_at: Column, summary: Column | None = None) -> Column:
    """Front matter, title, optional summary quote, content, rule."""
    quoted = F.replace(title, F.lit('"'), F.lit('\\"'))
    head = _filled('---\nsource_url: {}\ntitle: "{}"\ncollected_at: {}\n---\n\n# {}\n\n', url, quoted, collected_at, title)
    quote = F.lit("")
    if summary is not None:
        given = F.coalesce(summary, F.lit(""))
        quote = F.when(given != "", _filled(fv.SUMMARY_QUOTE + "\n\n", given)).otherwise("")
    return F.concat(head, quote, strip(content), F.lit("\n\n---\n"))


def text_block(title: Column, url: Column, content: Column) -> Column:
    return _filled(fv.RULE + "\nSOURCE: {}\nURL: {}\n" + fv.RULE + "\n\n{}\n\n", title, url, strip(content))


def text_banner(product: str, url: Column, collected_at: Column) -> Column:
    return _filled(product + " — {}\nCollected: {}\n" + fv.RULE + "\n\n", url, collected_at)


def json_string(col: Column) -> Column:
    """A JSON string literal; non-ASCII is kept, control characters are escaped in lower-case hex."""
    short = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    rare = [(chr(c), f"\\u{c:04x}") for c in range(32) if chr(c) not in "\n\r\t\b\f"]

    def apply(c: Column, pairs: list[tuple[str, str]]) -> Column:
        return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)

    common = apply(col, short)
    escaped = F.when(col.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), apply(common, rare)).otherwise(common)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def json_line(title: Column, url: Column, content: Column, collected_at: Column) -> Column:
    """One record of a JSON Lines output, with its newline."""
    values = [json_string(F.coalesce(c, F.lit(""))) for c in (url, title, strip(content), collected_at)]
    names = ['{"url": ', ', "title": ', ', "content": ', ', "collected_at": ']
    fields = [x for name, value in zip(names, values, strict=True) for x in (F.lit(name), value)]
    return F.concat(*fields, F.lit("}\n"))


def record_text(fmt: str, title: Column, url: Column, content: Column, collected_at: Column, summary: Column | None = None) -> Column:
    if fmt == "md":
        return page_block(title, url, content, collected_at, summary)
    if fmt == "txt":
        return text_block(title, url, content)
    if fmt == "jsonl":
        return json_line(title, url, content, collected_at)
    raise ValueError(f"format must be one of {fv.FORMATS}, not {fmt!r}")


def toc_entry(seq: Column, title: Column, url: Column) -> Column:
    return _filled("{}. [{}]({})", seq.cast("string"), title, url)


def toc_count(n: Column) -> Column:
    return _filled(fv.TOC_COUNT, n.cast("string"))


def part_name(output: Column, part: Column, fmt: str) -> Column:
    suffix = F.when(part == 1, "").otherwise(F.concat(F.lit("_part"), part.cast("string")))
    return F.concat(output, suffix, F.lit(f".{fmt}"))
