"""Pages to tokens: one row per tag, text run or skipped piece of markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions.html import attribute
from foliomill.functions.text import quoted

PAGE_END = 2**62  # later than any position


def tag_in(tags: list[str]) -> str:
    """SQL test of a token's tag against a fixed list."""
    return "tag in (" + ", ".join(quoted(t) for t in tags) + ")"


_TAG = r"^</?([A-Za-z][^\s/>]*)"
_SELF_CLOSED = r"""(?:^<[A-Za-z][^\s/>]*|["'\s])/>\z"""
_KIND = f"""
case
  when not startswith(token, '<') or token = '<' then 'text'
  when startswith(token, '<!--') then 'comment'
  when token rlike '^</[A-Za-z]' then 'close'
  when not token rlike '^<[A-Za-z]' then 'decl'
  when {tag_in(["script", "style"])} and token rlike {quoted(r"(?i)</(?:script|style)\s*>\z")} then 'raw'
  when {tag_in(fv.VOID_TAGS)} or token rlike {quoted(_SELF_CLOSED)} then 'void'
  else 'open'
end"""


def tokenize(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, kind, tag, token); kinds: open, close, void, raw, comment, decl, text.

    Map-only.  A script or style element is one token of kind ``raw``: it opens nothing.
    """
    pieces = F.regexp_extract_all(F.col("html"), F.lit(fv.TOKEN_PATTERN), F.lit(0))
    split = pages.select(key, F.posexplode(pieces).alias("pos", "token"))
    tagged = split.select(key, F.col("pos").cast("bigint").alias("pos"), "token", F.expr(f"lower(regexp_extract(token, {quoted(_TAG)}, 1)) as tag"))
    return tagged.select(key, "pos", F.expr(f"{_KIND} as kind"), "tag", "token")


def with_attributes(tokens: DataFrame) -> DataFrame:
    """Add ``classes`` and ``ident``: class names and id of opening tags, '' elsewhere."""
    opening = F.col("kind").isin("open", "void")

    def value(name: str) -> Column:
        present = opening & F.col("token").rlike(rf"(?i)[\s\"']{name}\s*=")
        return F.when(present, attribute(F.col("token"), name)).otherwise("")

    named = tokens.select("*", value("class").alias("classes"), value("id").alias("ident"))
    return named.withColumn("classes", F.btrim(F.regexp_replace("classes", r"[ \t\r\n\f]+", " ")))


def with_spans(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Add ``end``: the position of the closing tag of each open tag, and ``matched``.

    The close of an element is the next token of its tag at its nesting level, where the level is a
    running balance per (page, tag); so unclosed <b> or <p> do not disturb other tags.  An unclosed
    element whose end tag is optional in HTML ends before the next token of its tag, any other
    unclosed element with the page.

    If the rows are already hash-partitioned by page, the two windows need no further exchange.
    """
    columns = tokens.columns
    same_tag = f"(partition by {key}, balance_tag order by pos)"
    so_far = f"(partition by {key}, balance_tag order by pos rows between unbounded preceding and current row)"
    same_level = f"(partition by {key}, balance_tag, level order by pos)"
    levels = tokens.selectExpr("*", "case when kind in ('open', 'close') then tag else '' end as balance_tag").selectExpr(
        *columns,
        "balance_tag",
        f"sum(case kind when 'open' then 1 when 'close' then -1 else 0 end) over {so_far} + int(kind = 'close') as level",
        f"lead(pos) over {same_tag} as next_same",
    )
    partners = levels.selectExpr(
        *columns, "next_same", f"lead(pos) over {same_level} as next_level", f"lag(pos) over {same_level} as prev_level"
    )
    return partners.selectExpr(
        *columns,
        "case kind when 'open' then next_level is not null when 'close' then prev_level is not null else false end as matched",
        f"""case when kind <> 'open' then pos else coalesce(
              next_level, case when {tag_in(fv.OPTIONAL_END_TAGS)} then next_same - 1 end, {PAGE_END}) end as end""",
    )


def by_page(pages: DataFrame, key: str = "page_id", partitions: int | None = None) -> DataFrame:
    """(key, html), hash-partitioned by page: the one exchange of an extraction.

    Pages travel as HTML, before they are split up.  The number of partitions is explicit (the session's
    shuffle partitions by default): the work grows many times after the exchange, so partitions must
    not be merged by the size of the HTML alone.
    """
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select(key, "html").repartition(n, key)


def page_tokens(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Tokens with attributes and spans, of pages that are partitioned :func:`by_page`."""
    return with_spans(with_attributes(tokenize(pages, key)), key)
