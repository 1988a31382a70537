"""Tokens to content: region, page furniture, Markdown blocks, extraction in two tiers.

Everything here is a window or an aggregate per page.  Pages are hash-partitioned once, with
:func:`foliomill.operators.tokens.by_page`, and all windows below share the order (page, position), so
one exchange and one sort serve region, noise, and rendering.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions import html as H
from foliomill.functions import text as X
from foliomill.operators.selectors import first_matches, is_structural
from foliomill.operators.tokens import page_tokens, tag_in

LINK_DENSITY_LIMIT = 3  # a block is boilerplate when more than 1/3 of its text is link text


def _so_far(key: str) -> str:
    return f"(partition by {key} order by pos rows between unbounded preceding and current row)"


def _whole_page(key: str) -> str:
    return f"(partition by {key} order by pos rows between unbounded preceding and unbounded following)"


def covered_by(condition: str, key: str = "page_id") -> str:
    """SQL: true inside (and at the tags of) any element whose open token meets the condition."""
    return f"coalesce(max(case when kind = 'open' and ({condition}) then end end) over {_so_far(key)} >= pos, false)"


_COMPOUND = re.compile(r"^(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+|\[[\w-]+(?:=(?:'[^']*'|\"[^\"]*\"|[\w-]+))?\])*)$")
_SIMPLE = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=(?:'([^']*)'|\"([^\"]*)\"|([\w-]+)))?\]")


def compound_condition(compound: str) -> Column:
    """Predicate of ``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr='v']`` and their compounds."""
    match = _COMPOUND.match(compound)
    if not compound or match is None:
        raise ValueError(f"unsupported selector: {compound!r}")
    tests = ["kind in ('open', 'void')"]
    if match.group(1) and match.group(1) != "*":
        tests.append(f"tag = {X.quoted(match.group(1).lower())}")
    attributes = []
    for cls, ident, attr, *values in _SIMPLE.findall(match.group(2)):
        value = next((v for v in values if v), "")
        if cls:
            tests.append(f"contains(concat(' ', classes, ' '), {X.quoted(f' {cls} ')})")
        elif ident:
            tests.append(f"ident = {X.quoted(ident)}")
        else:
            present = r"(?i)[\s\"']" + attr + r"[\s=>/]"
            tests.append(f"token rlike {X.quoted(present)}")
            if value:
                attributes.append(H.attribute(F.col("token"), attr) == value)
    condition = F.expr(" and ".join(tests))
    for test in attributes:
        condition = condition & test
    return condition


def with_region(spans: DataFrame, selector: str | None = None, key: str = "page_id") -> DataFrame:
    """Add ``region`` = (rank, pos, end) of the content element, null where the whole page is content.

    Without a selector: the first kind of main element that occurs, and of that kind the first.  With
    one: its first match, or else the whole page; the heuristic is not tried then.  A selector may be
    a chain of ancestors, ``"div#x ul li.y"``, or several of them separated by commas; of all matches the first counts.
    Chains may have children (``>``), siblings (``+``, ``~``) and positions among them (``:nth-child(2)``,
    ``:nth-of-type(2n+1)``, ``:first-child``); then see :mod:`foliomill.operators.selectors`.
    """
    if selector is not None and is_structural(selector):
        return spans.join(first_matches(spans, selector, key, compound_condition), key, "left")
    if selector is None:
        rank = F.lit(None).cast("int")
        for i, sel in reversed(list(enumerate(fv.REGION_SELECTORS))):
            rank = F.when(compound_condition(sel), i + 1).otherwise(rank)
        ranked = spans.withColumn("rank", rank)
    else:
        before = f"(partition by {key} order by pos rows between unbounded preceding and 1 preceding)"
        ranked = spans.withColumn("rank", F.lit(None).cast("int"))
        for chain in selector.split(","):
            *ancestors, last = chain.split() or [""]
            ranked = ranked.withColumn("inside", F.lit(True))
            for ancestor in ancestors:
                ranked = ranked.withColumn("hit", F.col("inside") & compound_condition(ancestor)).withColumn(
                    "inside", F.expr(f"coalesce(max(case when hit then end end) over {before} >= pos, false)")
                )
            ranked = ranked.withColumn("rank", F.when(F.col("inside") & compound_condition(last), 1).otherwise(F.col("rank"))).drop("inside", "hit")
    region = f"min(case when rank is not null then struct(rank, pos, end) end) over {_whole_page(key)}"
    return ranked.selectExpr(*spans.columns, f"{region} as region")


IN_REGION = "region is null or pos between region.pos and region.end"

NOISE_TAG = tag_in(fv.NOISE_TAGS)
_NOISE_WORD = "(?:" + "|".join(fv.NOISE_WORDS) + ")"
# A class or id that contains one of the noise words anywhere, or as a word of its own.
NOISE_CLASS = {
    "substring": f"lower(concat(classes, '\n', ident)) rlike {X.quoted(_NOISE_WORD)}",
    "word": f"lower(concat(classes, '\n', ident)) rlike {X.quoted(r'(?<![a-z0-9])' + _NOISE_WORD + r'(?![a-z0-9])')}",
}


def without_noise(tokens: DataFrame, tags: bool = True, classes: bool = True, key: str = "page_id", match: str = "substring") -> DataFrame:
    """Drop page furniture with everything inside it.  Expects ``end`` and, if cut, only the region.

    ``match``: whether a noise word may be part of a longer word (``shadow`` has ``ad``) or must be a ``word``
    between characters other than letters and digits.
    """
    if match not in NOISE_CLASS:
        raise ValueError(f"match must be one of {sorted(NOISE_CLASS)}")
    noise = " or ".join(test for test, wanted in ((NOISE_TAG, tags), (NOISE_CLASS[match], classes)) if wanted)
    marked = tokens.withColumn("noise", F.expr(covered_by(noise or "false", key)))
    shown = f"not noise and kind not in ('comment', 'decl') and not (kind = 'raw' and {NOISE_TAG if tags else 'false'})"
    return marked.where(shown).drop("noise")


def clean_tokens(pages: DataFrame, selector: str | None = None, key: str = "page_id") -> DataFrame:
    """Region, then noise tags, then noise classes: the tokens that are content.

    ``pages`` should come from :func:`by_page`; otherwise Spark exchanges tokens, which are larger.
    """
    region = with_region(page_tokens(pages, key), selector, key).where(IN_REGION).drop("region")
    return without_noise(region, key=key)


def clean_text(tokens: DataFrame, key: str = "page_id", separator: str = "|") -> DataFrame:
    """(key, text): the text runs of a page, trimmed, non-empty, in order, joined by a separator."""
    run = X.strip(X.decode_entities(F.col("token")))
    texts = tokens.where(F.col("kind") == "text").select(key, "pos", run.alias("run")).where("run <> ''")
    return texts.groupBy(key).agg(X.ordered_concat("pos", "run", separator).alias("text"))


# --- Markdown ---------------------------------------------------------------------------------------


HEADING = tag_in(fv.HEADING_TAGS)
BLOCK = tag_in(fv.BLOCK_TAGS)
INNER_BLOCK = tag_in(["ul", "ol", "li", "hr", "blockquote"])


def with_context(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Add what rendering must know about the surroundings of each token, in two window passes."""
    so_far, order = _so_far(key), f"(partition by {key} order by pos)"
    edge = f"({BLOCK} or {HEADING} or {INNER_BLOCK} or tag in ('pre', 'table')) and (not in_table or tag = 'table') and (not in_pre or tag = 'pre')"
    first = tokens.selectExpr(
        "*",
        f"{covered_by("tag = 'pre'", key)} as in_pre",
        f"{covered_by("tag = 'a' and matched", key)} as in_link",
        f"{covered_by("tag = 'table'", key)} as in_table",
        f"{covered_by("tag = 'blockquote'", key)} as in_quote",
        f"sum(case when tag in ('ul', 'ol') then int(kind = 'open') - int(kind = 'close') else 0 end) over {so_far} as list_depth",
        f"sum(int(kind = 'open' and tag in ('td', 'th'))) over {so_far} as cells",
        f"sum(int(kind = 'open' and tag = 'tr')) over {so_far} as rows",
        f"lead(case when kind = 'open' and tag = 'code' then classes end) over {order} as next_code_classes",
    )
    second = first.selectExpr(
        "*",
        f"last_value(case when kind = 'open' and tag = 'tr' then cells end, true) over {so_far} as cells_before",
        f"last_value(case when kind = 'open' and tag = 'table' then rows end, true) over {so_far} as rows_before",
        f"sum(int({edge})) over {so_far} as block",
    )
    own, inner = H.code_language(F.col("classes")), H.code_language(F.coalesce("next_code_classes", F.lit("")))
    language = F.coalesce(F.nullif(own, F.lit("")), inner)
    return second.withColumn("language", F.when(F.expr("kind = 'open' and tag = 'pre'"), language))


# The Markdown that one token contributes, given its context.  Spaces and newlines that must survive
# later squeezing (code, indentation) are noncharacters until finish_page turns them back; LINE_START
# asks for the start of a line without adding empty ones.
_GAP = "case when in_table then ' ' else '\\n\\n' end"
FRAGMENT = f"""
case
  when kind = 'text' then shown
  when tag = 'pre' then case
    when kind = 'open' then concat('\\n\\n```', language, '\\n')
    when kind = 'close' and matched then '\\n```\\n\\n' else '' end
  when in_pre then case when tag = 'br' then '{fv.KEEP_NEWLINE}' else '' end
  when tag = 'table' then '\\n\\n'
  when in_table and tag = 'tr' then case
    when kind = 'open' then '{fv.LINE_START}'
    when rows - rows_before = 1 and cells > cells_before
      then concat(' |{fv.LINE_START}|', repeat(' --- |', int(cells - cells_before)), '{fv.LINE_START}')
    else ' |{fv.LINE_START}' end
  when in_table and tag in ('td', 'th') then case when kind = 'open' then ' | ' else '' end
  when {HEADING} and not in_table then case
    when kind = 'open' then concat('\\n\\n', repeat('#', int(substring(tag, 2, 1))), ' ') else '\\n\\n' end
  when tag in ('ul', 'ol') and not in_table then case
    when list_depth <= int(kind = 'open') then '\\n\\n' else '{fv.LINE_START}' end
  when tag = 'li' and not in_table then case
    when kind = 'open' then concat('{fv.LINE_START}', repeat('{fv.KEEP_SPACE}', int(greatest(list_depth - 1, 0)) * 2), '- ')
    else '' end
  when tag = 'blockquote' and not in_table then case when kind = 'open' then '\\n\\n> ' else '\\n\\n' end
  when tag = 'hr' and not in_table then '\\n\\n---\\n\\n'
  when tag = 'br' then case when in_table then ' ' else '\\n' end
  when tag = 'p' and list_depth > 0 and kind = 'open' then ''
  when tag = 'p' and not in_table then case when kind = 'open' and in_quote then '\\n\\n> ' else '\\n\\n' end
  when {BLOCK} or {HEADING} or {INNER_BLOCK} then {_GAP}
  when not matched then ''
  when tag = 'code' then '`'
  when tag in ('b', 'strong') then '**'
  when tag in ('i', 'em') then '*'
  else ''
end"""


def shown_text() -> Column:
    """Text of a text token: decoded, and with free white space squeezed except in code."""
    token, keep = F.col("token"), fv.KEEP_SPACE + fv.KEEP_NEWLINE + fv.KEEP_TAB
    as_is = F.translate(F.regexp_replace(X.decode_entities(token), r"\r\n?", "\n"), " \n\t", keep)
    flowing = X.decode_entities(X.collapse_spaces(token))
    return F.when(F.col("kind") == "text", F.when(F.col("in_pre"), as_is).otherwise(flowing))


def blocks(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, block, md, n_text, n_link, has_heading, has_title, ...): one row per block of a page.

    Lists and their items each begin a block, so ``item``, ``list_tag``, ``list_level`` and ``list_start`` are
    those of the token that begins it.
    """
    shown = with_context(tokens, key).withColumn("shown", shown_text()).selectExpr(
        key,
        "pos",
        "block",
        f"{FRAGMENT} as md",
        "case when kind = 'text' then bigint(length(translate(token, ' \\t\\r\\n\\f', ''))) else 0L end as n_text",
        "in_link",
        f"kind = 'open' and {HEADING} as heading",
        "kind = 'open' and tag = 'li' and not in_table and not in_pre as item",
        "case when kind = 'open' and tag in ('ul', 'ol') and not in_table and not in_pre then tag end as list_tag",
        "case when kind = 'open' and tag in ('ul', 'ol', 'li') and not in_table and not in_pre then list_depth end as list_level",
        "token",
        "kind = 'open' and tag = 'title' as title",
    )
    return shown.groupBy(key, "block").agg(
        X.ordered_concat("pos", "md").alias("md"),
        F.sum("n_text").alias("n_text"),
        F.sum(F.when(F.col("in_link"), F.col("n_text")).otherwise(0)).alias("n_link"),
        F.max("heading").alias("has_heading"),
        F.max("item").alias("item"),
        F.max("list_tag").alias("list_tag"),
        F.max("list_level").alias("list_level"),
        F.max(F.when(F.col("list_tag") == "ol", H.attribute(F.col("token"), "start"))).alias("list_start"),
        F.max("title").alias("has_title"),
    )


def is_precise_block() -> Column:
    """Blocks kept by the precise tier: low link density, headings always, never the <title>."""
    linky = F.col("n_link") * LINK_DENSITY_LIMIT > F.col("n_text")
    return (~linky | F.col("has_heading")) & ~F.col("has_title")


def finish_page(md: Column) -> Column:
    """Assembled fragments to Markdown: squeeze free space, then restore the kept one."""
    free, line, keep_nl = f"[ {fv.LINE_START}]*", fv.LINE_START, fv.KEEP_NEWLINE

    def with_code(text: Column) -> Column:
        return F.translate(F.regexp_replace(text, rf"{keep_nl}+\n```", "\n```"), keep_nl + fv.KEEP_TAB, "\n\t")

    text = X.each_line(md, lambda s: F.btrim(s, F.lit(" " + line)))
    text = X.where_contains(text, line, lambda t: F.regexp_replace(t, f" *{line}{free}", "\n"))
    text = X.where_contains(text, "  ", lambda t: F.regexp_replace(t, " {2,}", " "))
    text = X.where_contains(text, "\n> ", lambda t: F.regexp_replace(t, r"(?m)^> *$", ""))
    text = X.where_contains(text, "\n```", with_code)
    return F.replace(text, F.lit(fv.KEEP_SPACE), F.lit(" "))


def render(block_rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, precise, full): fragments of the precise blocks and of all blocks, not yet finished.

    The full text numbers the items of ordered lists; the precise one marks all items alike.
    """
    in_level = f"(partition by {key}, list_level order by block rows between unbounded preceding and current row)"
    counted = block_rows.withColumn("items", F.expr(f"sum(int(item)) over {in_level}"))
    begun = "case when list_tag is not null then struct(list_tag, items, try_cast(list_start as int) as start) end"
    counted = counted.withColumn("of_list", F.expr(f"last_value({begun}, true) over {in_level}"))
    number = F.coalesce(F.col("of_list.start"), F.lit(1)) + F.col("items") - F.col("of_list.items") - 1
    # An item's block begins with a line start, two kept spaces for each level above, and the mark.
    indent = 1 + 2 * F.greatest(F.col("list_level") - 1, F.lit(0))
    numbered = F.concat(
        F.substring("md", F.lit(1), indent.cast("int")), number.cast("string"), F.lit(". "), F.substring(F.col("md"), (indent + 3).cast("int"), F.length("md"))
    )
    full_md = F.when(F.col("item") & (F.col("of_list.list_tag") == "ol"), numbered).otherwise(F.col("md"))
    rows = counted.withColumn("precise_md", F.when(is_precise_block(), F.col("md"))).withColumn("full_md", full_md)
    return rows.groupBy(key).agg(
        X.ordered_concat("block", "precise_md").alias("precise"), X.ordered_concat("block", "full_md").alias("full")
    )


def extract_tiers(
    rendered: DataFrame,
    finish: Callable[[Column], Column] = lambda text: text,
    precise_min: int = fv.PRECISE_MIN_CHARS,
    fallback_min: int = fv.FALLBACK_MIN_CHARS,
) -> DataFrame:
    """Add ``tier`` and ``content``: precise text if long enough, else the full text, else ''.

    In named steps, so that each text is finished once, and the full one only where it is needed.
    """

    def length(column: str) -> Column:
        return F.length(X.strip(F.col(column)))

    first = rendered.withColumn("content", finish(F.col("precise")))
    first = first.withColumn("enough", length("content") >= precise_min)
    chosen = first.withColumn("content", F.when(F.col("enough"), F.col("content")).otherwise(finish(F.col("full"))))
    tier = F.when(F.col("enough"), 1).when(length("content") >= fallback_min, 2).otherwise(0)
    tiers = chosen.withColumn("tier", tier.cast("bigint")).drop("enough")
    return tiers.withColumn("content", F.when(F.col("tier") > 0, X.clean_markdown(F.col("content"))).otherwise(""))


def page_content(
    pages: DataFrame, selector: str | None = None, key: str = "page_id", precise_min: int = fv.PRECISE_MIN_CHARS
) -> DataFrame:
    """(key, tier, content) for every page that has tokens left after cleaning; see :func:`clean_tokens`."""
    rendered = render(blocks(clean_tokens(pages, selector, key), key), key)
    return extract_tiers(rendered, finish_page, precise_min).select(key, "tier", "content")
