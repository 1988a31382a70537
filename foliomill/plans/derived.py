"""Input tables for the catalogue that the test data does not hold as such.

Each is a projection of a whole given table, so it grows with it: select expressions that Spark and
DuckDB both understand (no backslashes in literals, ``chr(10)`` for a newline).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SITE = "'https://docs.example.org/' || source || '/' || doc_id"
_BARE = "regexp_replace(url, '[?#].*', '')"

# Page containers: each kind of region element, none at all, and a page whose body is itself noise.
_OPEN = (
    "case doc_id % 9 when 0 then '<main>' when 1 then '<article>' when 2 then '<section role=\"main\">' "
    "when 3 then '<div class=\"x main-content\">' when 4 then '<div id=\"content\">' when 5 then '<div class=\"content y\">' "
    "when 6 then '<div class=\"contents\">' when 7 then '<div class=\"content\"><article>' else '<div class=\"page-loading\">' end"
)
_CLOSE = (
    "case doc_id % 9 when 0 then '</main>' when 1 then '</article>' when 2 then '</section>' "
    "when 7 then '</article><p>outside the article but long enough to be seen</p></div>' else '</div>' end"
)
_SEPARATOR = "case doc_id % 5 when 0 then ' | ' when 1 then ' - ' when 2 then ' — ' when 3 then ' :: ' else ', ' end"

EXPRESSIONS: dict[str, tuple[str, list[str]]] = {
    "urls": ("pages", ["page_id as ord", "url"]),
    # The page URLs with endings that meet, or just miss, each skip rule.
    "varied_urls": (
        "pages",
        [
            "page_id as ord",
            f"{_BARE} || case page_id % 16 when 0 then '' when 1 then '/doc.PDF' when 2 then '/img.png?x=1' "
            "when 3 then '?file=a.zip' when 4 then '/search.html' when 5 then '/page/3/' when 6 then '/page=4' "
            "when 7 then '?print=1' when 8 then '/tag/x' when 9 then '/Author/y' when 10 then '/genindex.HTML' "
            "when 11 then '/style.css;v=1' when 12 then '/x.jsonl' when 13 then '?page=2' when 14 then '/download.html#a' "
            "else '/page/x' end as url",
        ],
    ),
    "url_lines": (
        "pages",
        [
            "page_id as line_no",
            "case page_id % 6 when 0 then '  ' || url || ' ' || chr(9) when 1 then '#' || url when 2 then '  #' || url "
            "when 3 then url when 4 then '   ' else url || '/file.pdf' end as line",
        ],
    ),
    # Every URL three times over neighbouring positions.
    "repeated_urls": ("documents", ["doc_id as ord", "'https://docs.example.org/' || source || '/' || (doc_id % 97) as url"]),
    "page_results": (
        "pages",
        [
            "page_id",
            "url",
            "case when page_id % 11 = 3 or page_id % 13 = 5 then '' else html end as html",
            "page_id % 11 = 3 as skipped",
            "case when page_id % 11 = 3 then (case page_id % 3 when 0 then '403 Forbidden' when 1 then 'HTTP 500' else 'reset' end) else '' end as reason",
            "case when page_id % 11 = 3 and page_id % 3 = 2 then 'ConnectError' end as error_type",
        ],
    ),
    "docs": (
        "documents",
        [
            "doc_id as ord",
            f"{_SITE} as url",
            "upper(lang) || ' \"' || source || '\" ' || doc_id as title",
            "text as content",
            "source as output",
        ],
    ),
    "rich_pages": (
        "documents",
        [
            "doc_id as page_id",
            f"{_SITE} as url",
            "'<!DOCTYPE html><html><head><title> ' || source || ' &amp; ' || lang || " + _SEPARATOR + " || 'site</title>"
            "<script>if (a < b) { document.write(\"<p>\"); }</script></head><body class=\"' || "
            "case when doc_id % 17 = 0 then 'shadow-sm' else 'page' end || '\"><header><nav><a href=\"/\">home</a></nav></header>' || "
            + _OPEN + " || '<h1>' || source || ' <em>no ' || doc_id || '</em></h1><!-- <h1>not this</h1> --><ul><li>' || "
            "replace(text, chr(10), '</li><li>') || '<ul><li>nested <a href=\"/x?a=1&amp;b=2\">linked words</a></ul></li></ul>"
            "<ol start=3><li>third<li>fourth <ul><li>inner</ul></li><li>fifth</li></ol><ol><li>one <ol><li>deep</ol><li>two</ol>"
            "<table><thead><tr><th>lang</th><th>size</th></tr></thead><tr><td>' || lang || '</td><td><p>' || n_chars || "
            "'</p></td></tr></table><pre class=\"hl language-' || lang || '\"><code>' || text || '</code></pre><p><strong>' || "
            "source || '</strong> and <i>more</i> with <code>x &lt; y</code>.<br/>Next line<p>Unclosed <b>bold<p>"
            "<a href=\"../up\">only a link here</a></p><div class=\"download\">removed</div><p id=\"Toc-1\">removed too</p>"
            "<blockquote><p>first quoted</p><p>second quoted</p></blockquote><hr><h2>End &copy; &#8364; &#x20AC;</h2>' || "
            + _CLOSE + " || '<footer>foot</footer><aside class=menu>side</aside></body></html>' as html",
        ],
    ),
    "markdown_texts": (
        "documents",
        [
            "doc_id",
            "replace(replace(text, chr(10), '  ' || chr(160) || chr(10) || ' |  | ' || chr(10) || chr(10) || chr(10) || chr(10)), "
            "'. ', '.' || chr(13) || chr(10) || '```sh' || chr(10) || 'x = 1' || chr(9) || chr(10) || '```' || '\u2028') || "
            "chr(10) || '||' as text",
        ],
    ),
    "entity_texts": (
        "documents",
        [
            "doc_id",
            "'&amp;lt; &nope; &#0; &#xD800; & ' || replace(replace(replace(replace(text, 'th', '&lt;'), 'an', '&#233;'), "
            "'on', '&#x20AC'), 'e ', '&eacute;&nbsp;') as text",
        ],
    ),
    "noisy_texts": (
        "documents",
        ["doc_id", "replace(replace(text, ' ', chr(160) || '\u200b'), 'a', 'a' || chr(7) || '\ufeff') as text"],
    ),
    "paragraph_texts": ("documents", ["doc_id", "replace(text, chr(10), chr(10) || chr(10)) as text"]),
    "classes": (
        "documents",
        [
            "doc_id",
            "'<code id=c' || doc_id || ' class=\"' || case doc_id % 6 when 0 then 'hl  language-' when 1 then 'lang_' when 2 then "
            "'a highlight-' when 3 then 'xlanguage-' when 4 then 'language:' else 'x lang-' end || lang || '-x extra' || "
            "case when doc_id % 4 = 0 then ' lang-second' else '' end || '\">' as token",
        ],
    ),
    "robots": (
        "documents",
        [
            "'https://' || source || '-' || doc_id || '.example.org' as site",
            "case when doc_id % 5 = 0 then 404 else 200 end as status",
            "replace(replace(replace(text, chr(10) || 'A', chr(10) || 'Sitemap: https://a.example.org/' || doc_id || '/A'), "
            "chr(10) || 'E', chr(10) || ' sitemap: indented'), chr(10) || 'T', chr(13) || chr(10) || 'SITEMAP:T') || chr(10) || "
            "'sitemap:   ' as txt",
        ],
    ),
    "snapshot": (
        "events",
        [
            "'https://u.example.org/' || user_id as url",
            "case when event_type = 'error' then 500 else 200 end as status",
            "ts as fetched_at",
        ],
    ),
    "known_urls": ("documents", ["doc_id as ord", "'https://u.example.org/' || doc_id as url"]),
    "event_links": (
        "events",
        [
            "'https://g.example.org/' || case user_id % 10 when 3 then 'tag/' when 7 then 'private/' when 5 then 'misc/' else 'doc/' end || "
            "user_id as src",
            "'https://' || case when event_id % 23 = 0 then 'other' else 'g' end || '.example.org/' || case (user_id * 7 + event_id) % 10 "
            "when 3 then 'tag/' when 7 then 'private/' when 5 then 'misc/' else 'doc/' end || (user_id * 7 + event_id) % (case when event_id % 3 = 0 then 200 else 1000000007 end) as dst",
            "event_id as pos",
        ],
    ),
    # As many patterns as documents; most are in no URL, some in several, a few are short.
    "url_patterns": (
        "documents",
        [
            "case doc_id % 5 when 0 then '/' || lang || '/' || doc_id || '?' when 1 then lang || '/' || doc_id when 2 then '/' || (doc_id * 7) "
            "|| source when 3 then substr(source, 1, 9) || '/none/' || doc_id else 'zz' || substr(lang, 1, 1) || '~' end as pattern",
        ],
    ),
    "chunk_turns": ("conversations", ["conv_id", "turn", "text"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = EXPRESSIONS[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def derived_sql(name: str) -> str:
    source, expressions = EXPRESSIONS[name]
    return f"select {', '.join(expressions)} from {source}"
