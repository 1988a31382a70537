"""The catalogue's queries once more, as SQL that DuckDB runs on the same tables.

Written from the operators' definitions and sharing with the engine only fixed values (patterns, word
lists, formats) and the select expressions of derived inputs.
"""

from __future__ import annotations

from foliomill import fixed_values as fv
from foliomill.functions.text import ENTITY_TEXT
from foliomill.functions.urls import URL_PATTERN
from foliomill.plans.catalog import COLLECTED_AT, DOC_LIMIT, SITE_LIMIT
from foliomill.plans.derived import derived_sql

ORACLE: dict[str, str] = {}
TOKEN_PATTERN = fv.TOKEN_PATTERN.replace("*+", "*")  # no possessive quantifiers here


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(items: list[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def D(name: str) -> str:
    return f"({derived_sql(name)})"


WS = q(fv.WHITE_SPACE)
NL = "chr(10)"
AT = q(COLLECTED_AT)


# --- scalar pieces ----------------------------------------------------------------------------------


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


_NAMES = "map([" + ", ".join(q(n) for n in ENTITY_TEXT) + "], [" + ", ".join(q(v) for v in ENTITY_TEXT.values()) + "])"


def decode(x: str) -> str:
    pieces = f"regexp_extract_all({x}, {q('&#[xX][0-9a-fA-F]{1,6};?|&#[0-9]{1,7};?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&')})"
    code = (
        "case when p[3] in ('x', 'X') then cast('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1) as int) "
        "else cast(regexp_extract(p, '^&#([0-9]+)', 1) as int) end"
    )
    one = (
        f"case when p[1] <> '&' then p when p[2] = '#' and length(p) > 2 then (case when ({code}) between 1 and 55295 or "
        f"({code}) between 57344 and 1114111 then chr({code}) else '' end) "
        f"else coalesce((select v from entity_names where n = regexp_extract(p, '^&([A-Za-z0-9]+);$', 1)), p) end"
    )
    return f"(case when contains({x}, '&') then array_to_string(list_transform({pieces}, lambda p: {one}), '') else {x} end)"


# A correlated lookup inside a lambda is not possible, so names are replaced by a map constant.
def decode_map(x: str) -> str:
    named = f"coalesce({_NAMES}[regexp_extract(p, '^&([A-Za-z0-9]+);$', 1)], p)"
    head, tail = decode(x).split("coalesce((select", 1)
    rest = tail.split(", p) end", 1)[1]
    return head + named + " end" + rest


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {q(URL_PATTERN)}, 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, {q(URL_PATTERN)}, 2)"


def path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, {q(URL_PATTERN)}, 3), ';[^/]*$', '')"


def site(u: str) -> str:
    return f"({scheme(u)} || '://' || {netloc(u)})"


def slug(u: str) -> str:
    base = f"{netloc(u)} || replace({path(u)}, '/', '_')"
    name = f"regexp_replace(trim(regexp_replace({base}, '[^a-zA-Z0-9_-]', '_', 'g'), '_'), '_+', '_', 'g')"
    return f"coalesce(nullif({name}, ''), '{fv.DEFAULT_SLUG}')"


def has_ext(u: str) -> str:
    return "(" + " or ".join(f"ends_with(lower({path(u)}), {q(e)})" for e in fv.SKIP_EXTENSIONS) + ")"


def has_pattern(u: str) -> str:
    return "(" + " or ".join(f"regexp_matches({u}, {q('(?i)' + p)})" for p in fv.IGNORE_URL_PATTERNS) + ")"


def skippable(u: str) -> str:
    return f"({has_ext(u)} or {has_pattern(u)})"


def attribute(token: str, name: str) -> str:
    pattern = r"""(?is)[\s"']""" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    parts = " || ".join(f"regexp_extract({token}, {q(pattern)}, {g})" for g in (1, 2, 3))
    return decode_map(f"({parts})")


def class_list(token: str) -> str:
    return f"trim(regexp_replace({attribute(token, 'class')}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def language(classes: str) -> str:
    found = f"list_transform(string_split({classes}, ' '), lambda c: regexp_extract(c, {q('^(?:language|lang|highlight)[_-](\\w+)')}, 1))"
    return f"coalesce(list_filter({found}, lambda n: n <> '')[1], '')"


def clean_markdown(x: str) -> str:
    lines = f"string_split(regexp_replace({x}, {q(chr(13) + chr(10) + '|[' + fv.LINE_BREAK_CLASS + ']')}, {NL}, 'g'), {NL})"
    lines = f"list_transform({lines}, lambda s: rtrim(s, {WS}))"
    lines = f"list_filter({lines}, lambda s: not (contains(s, '|') and trim(s, {WS} || '|') = ''))"
    t = f"array_to_string({lines}, {NL})"
    t = f"regexp_replace({t}, '\\n\\n\\n+', {NL} || {NL}, 'g')"
    t = f"regexp_replace({t}, '([^\\n])\\n(```)', '\\1' || {NL} || {NL} || '\\2', 'g')"
    t = f"regexp_replace({t}, '(```)\\n([^\\n])', '\\1' || {NL} || {NL} || '\\2', 'g')"
    return strip(t)


def page_block(title: str, url: str, content: str, summary: str = "''") -> str:
    head, tail = fv.SUMMARY_QUOTE.split("{}")
    return (
        f"('---' || {NL} || 'source_url: ' || {url} || {NL} || 'title: \"' || replace({title}, '\"', '\\\"') || '\"' || {NL} || "
        f"'collected_at: ' || {AT} || {NL} || '---' || {NL} || {NL} || '# ' || {title} || {NL} || {NL} || "
        f"case when coalesce({summary}, '') <> '' then {q(head)} || {summary} || {q(tail)} || {NL} || {NL} else '' end || "
        f"{strip(content)} || {NL} || {NL} || '---' || {NL})"
    )


def text_block(title: str, url: str, content: str) -> str:
    rule = f"repeat('=', 60) || {NL}"
    return f"({rule} || 'SOURCE: ' || {title} || {NL} || 'URL: ' || {url} || {NL} || {rule} || {NL} || {strip(content)} || {NL} || {NL})"


def banner(product: str, url: str) -> str:
    return f"({q(product + ' — ')} || {url} || {NL} || 'Collected: ' || {AT} || {NL} || repeat('=', 60) || {NL} || {NL})"


def json_line(title: str, url: str, content: str) -> str:
    j = "cast(to_json({}) as varchar)".format
    return (
        f"('{{\"url\": ' || {j(url)} || ', \"title\": ' || {j(title)} || ', \"content\": ' || {j(strip(content))} || "
        f"', \"collected_at\": ' || {j(AT)} || '}}' || {NL})"
    )


def page_title(html: str) -> str:
    visible = f"regexp_replace({html}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"

    def strings(tag: str) -> str:
        inner = f"regexp_extract({visible}, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1)"
        return f"array_to_string(list_transform(regexp_split_to_array({inner}, '<[^>]*>'), lambda s: {strip(decode_map('s'))}), '')"

    short = "t"
    for sep in fv.TITLE_SEPARATORS:
        short = strip(f"split_part({short}, {q(sep)}, 1)")
    return (
        f"(select case when t <> '' then {short} when has_h1 then h else 'Untitled' end from (select {strings('title')} as t, "
        f"{strings('h1')} as h, regexp_matches({visible}, '(?i)<h1[\\s>]') as has_h1))"
    )


def h1_title(html: str) -> str:
    visible = f"regexp_replace({html}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"
    inner = f"regexp_extract({visible}, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1)"
    return f"array_to_string(list_transform(regexp_split_to_array({inner}, '<[^>]*>'), lambda s: {strip(decode_map('s'))}), '')"


# --- HTML as common table expressions ---------------------------------------------------------------


def tokens_cte(pages: str, name: str = "tokens", key: str = "page_id") -> str:
    return f"""
    {name}_raw as (
      select {key}, unnest(l) as token, unnest(range(len(l))) as pos
      from (select {key}, regexp_extract_all(html, {q(TOKEN_PATTERN)}) as l from {pages})
    ),
    {name}_tag as (select *, lower(regexp_extract(token, '^</?([A-Za-z][^\\s/>]*)', 1)) as tag from {name}_raw),
    {name} as (
      select {key}, pos, tag, token, case
          when token[1] <> '<' or token = '<' then 'text'
          when token[1:4] = '<!--' then 'comment'
          when regexp_matches(token, '^</[A-Za-z]') then 'close'
          when not regexp_matches(token, '^<[A-Za-z]') then 'decl'
          when tag in ('script', 'style') and regexp_matches(token, '(?i)</(script|style)\\s*>$') then 'raw'
          when tag in {qlist(fv.VOID_TAGS)} or regexp_matches(token, {q(r'''(^<[A-Za-z][^\s/>]*|["'\s])/>$''')}) then 'void'
          else 'open' end as kind
      from {name}_tag
    )"""


def spans_cte(key: str = "page_id") -> str:
    return f"""
    levels as (
      select *, case when kind in ('open', 'close') then tag else '' end as btag,
        sum(case kind when 'open' then 1 when 'close' then -1 else 0 end) over (partition by {key}, case when kind in ('open', 'close') then tag else '' end order by pos)
          + case when kind = 'close' then 1 else 0 end as level
      from tokens
    ),
    partners as (
      select *, lead(pos) over (partition by {key}, btag, level order by pos) as nl, lag(pos) over (partition by {key}, btag, level order by pos) as pl,
        lead(pos) over (partition by {key}, btag order by pos) as ns
      from levels
    ),
    spans as (
      select {key}, pos, kind, tag, token,
        case kind when 'open' then nl is not null when 'close' then pl is not null else false end as matched,
        case when kind = 'open' then coalesce(nl, case when tag in {qlist(fv.OPTIONAL_END_TAGS)} then ns - 1 end, {2**62}) else pos end as span_end
      from partners
    )"""


def has_class(name: str) -> str:
    return f"contains(' ' || {class_list('token')} || ' ', ' {name} ')"


RANK = (
    f"case when tag = 'main' then 1 when tag = 'article' then 2 when {attribute('token', 'role')} = 'main' then 3 "
    f"when tag = 'div' and {has_class('main-content')} then 4 when tag = 'div' and {attribute('token', 'id')} = 'content' then 5 "
    f"when tag = 'div' and {has_class('content')} then 6 end"
)

REGION = f"""
    region as (
      select page_id, pos as first_pos, span_end as last_pos from (
        select *, row_number() over (partition by page_id order by rank, pos) as rn
        from (select *, {RANK} as rank from spans where kind in ('open', 'void')) where rank is not null) where rn = 1
    )"""

NOISE_TAG = f"tag in {qlist(fv.NOISE_TAGS)}"
NOISE_CLASS = "(" + " or ".join(
    f"contains(lower({class_list('token')}), {q(w)}) or contains(lower({attribute('token', 'id')}), {q(w)})" for w in fv.NOISE_WORDS
) + ")"


_WORDS = "'(^|[^a-z0-9])(" + "|".join(fv.NOISE_WORDS) + ")($|[^a-z0-9])'"
NOISE_WORD = f"(regexp_matches(lower({class_list('token')}), {_WORDS}) or regexp_matches(lower({attribute('token', 'id')}), {_WORDS}))"


def kept_cte(source: str, tags: bool, classes: bool, name: str = "kept", noise: str = NOISE_CLASS) -> str:
    conditions = ([NOISE_TAG] if tags else []) + ([noise] if classes else [])
    raw = f" and not ({NOISE_TAG} and kind = 'raw')" if tags else ""
    return f"""
    {name}_flag as (select *, kind = 'open' and ({' or '.join(conditions)}) as noisy from {source}),
    {name} as (
      select * from (select *, max(case when noisy then span_end end) over (partition by page_id order by pos) as cover from {name}_flag)
      where coalesce(cover, -1) < pos and kind not in ('comment', 'decl'){raw}
    )"""


INSIDE = """
    inside as (
      select s.* from spans s left join region r using (page_id)
      where r.page_id is null or s.pos between r.first_pos and r.last_pos
    )"""


def clean_cte(pages: str) -> str:
    return f"{tokens_cte(pages)}, {spans_cte()}, {REGION}, {INSIDE}, {kept_cte('inside', True, True)}"


def clean_text(pages: str) -> str:
    return f"""with {clean_cte(pages)}
    select page_id, string_agg(run, '|' order by pos) as text
    from (select page_id, pos, {strip(decode_map('token'))} as run from kept where kind = 'text') where run <> '' group by page_id"""


def _covered(condition: str) -> str:
    return f"coalesce(max(case when kind = 'open' and {condition} then span_end end) over w, -1) >= pos"


KS, KN, KT, LS = fv.KEEP_SPACE, fv.KEEP_NEWLINE, fv.KEEP_TAB, fv.LINE_START
BLOCKS = qlist(fv.BLOCK_TAGS)
HEADINGS = qlist(fv.HEADING_TAGS)

CONTEXT = f"""
    context_a as (
      select *, {_covered("tag = 'pre'")} as in_pre, {_covered("tag = 'a' and matched")} as in_link,
        {_covered("tag = 'table'")} as in_table, {_covered("tag = 'blockquote'")} as in_quote,
        sum(case when tag in ('ul', 'ol') then (case kind when 'open' then 1 when 'close' then -1 else 0 end) else 0 end) over w as depth,
        case when kind = 'open' and tag = 'pre' and lead(tag) over w = 'code' and lead(kind) over w = 'open' then lead(token) over w end as code_token,
        case when kind = 'open' and tag = 'tr' then pos end as tr_pos, case when kind = 'open' and tag = 'table' then pos end as table_pos
      from kept window w as (partition by page_id order by pos)
    ),
    context_b as (
      select *, last_value(tr_pos ignore nulls) over w as my_tr, last_value(table_pos ignore nulls) over w as my_table,
        (tag in {BLOCKS} or tag in {HEADINGS} or tag in ('ul', 'ol', 'li', 'pre', 'table', 'hr', 'blockquote'))
          and (not in_table or tag = 'table') and (not in_pre or tag = 'pre') as edge
      from context_a window w as (partition by page_id order by pos)
    ),
    context_c as (
      select *, sum(case when edge then 1 else 0 end) over (partition by page_id order by pos) as block,
        sum(case when kind = 'open' and tag in ('td', 'th') then 1 else 0 end) over (partition by page_id, my_tr order by pos) as width,
        sum(case when kind = 'open' and tag = 'tr' then 1 else 0 end) over (partition by page_id, my_table order by pos) as row_no,
        case when kind = 'open' and tag = 'pre' then coalesce(nullif({language(class_list('token'))}, ''), {language(class_list("coalesce(code_token, '')"))}) end as lang
      from context_b
    )"""

_KEPT_TEXT = f"translate(replace(replace({decode_map('token')}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(10) || chr(9), '{KS}{KN}{KT}')"
_FREE_TEXT = decode_map("regexp_replace(token, '[ \\t\\r\\n\\f]+', ' ', 'g')")
_TWO = f"({NL} || {NL})"

FRAGMENT = f"""
    case
      when kind = 'text' then (case when in_pre then {_KEPT_TEXT} else {_FREE_TEXT} end)
      when tag = 'pre' then (case when kind = 'open' then {_TWO} || '```' || lang || {NL} when kind = 'close' and matched then {NL} || '```' || {_TWO} else '' end)
      when in_pre then (case when tag = 'br' then '{KN}' else '' end)
      when tag = 'table' then {_TWO}
      when in_table then (case
        when tag = 'tr' and kind = 'open' then '{LS}'
        when tag = 'tr' then ' |{LS}' || (case when row_no = 1 and width > 0 then '|' || repeat(' --- |', width::int) || '{LS}' else '' end)
        when tag in ('td', 'th') then (case when kind = 'open' then ' | ' else '' end)
        when tag = 'p' and depth > 0 and kind = 'open' then ''
        when tag = 'br' or tag in {BLOCKS} or tag in {HEADINGS} or tag in ('ul', 'ol', 'li', 'blockquote', 'hr') then ' '
        when matched and tag = 'code' then '`' when matched and tag in ('b', 'strong') then '**' when matched and tag in ('i', 'em') then '*'
        else '' end)
      when tag in {HEADINGS} then {_TWO} || (case when kind = 'open' then repeat('#', cast(tag[2] as int)) || ' ' else '' end)
      when tag in ('ul', 'ol') then (case when (kind = 'open' and depth <= 1) or (kind <> 'open' and depth <= 0) then {_TWO} else '{LS}' end)
      when tag = 'li' then (case when kind = 'open' then '{LS}' || repeat('{KS}', 2 * greatest(depth - 1, 0)::int) || '- ' else '' end)
      when tag = 'blockquote' then {_TWO} || (case when kind = 'open' then '> ' else '' end)
      when tag = 'hr' then {_TWO} || '---' || {_TWO}
      when tag = 'br' then {NL}
      when tag = 'p' and depth > 0 and kind = 'open' then ''
      when tag = 'p' then {_TWO} || (case when kind = 'open' and in_quote then '> ' else '' end)
      when tag in {BLOCKS} then {_TWO}
      when matched and tag = 'code' then '`' when matched and tag in ('b', 'strong') then '**' when matched and tag in ('i', 'em') then '*'
      else '' end"""


def finish(x: str) -> str:
    x = f"regexp_replace({x}, '[ {LS}]*\\n[ {LS}]*', {NL}, 'g')"
    x = f"regexp_replace({x}, ' *{LS}[ {LS}]*', {NL}, 'g')"
    x = f"regexp_replace({x}, '  +', ' ', 'g')"
    x = f"regexp_replace({x}, '(?m)^> *$', '', 'g')"
    x = f"regexp_replace({x}, '{KN}+\\n```', {NL} || '```', 'g')"
    return f"translate({x}, '{KS}{KN}{KT}', ' ' || chr(10) || chr(9))"


LISTS = f"""
    list_a as (
      select *, sum(case when kind = 'open' and tag = 'li' and not in_table and not in_pre then 1 else 0 end) over (partition by page_id, depth order by pos) as items
      from context_c
    ),
    list_b as (
      select *, last_value(case when begins then tag end ignore nulls) over w as my_list, last_value(case when begins then items end ignore nulls) over w as list_items,
        last_value(case when begins then coalesce(try_cast({attribute('token', 'start')} as int), 1) end ignore nulls) over w as list_start
      from (select *, kind = 'open' and tag in ('ul', 'ol') and not in_table and not in_pre as begins from list_a)
      window w as (partition by page_id, depth order by pos)
    )"""
_NUMBERED_ITEM = (
    f"case when kind = 'open' and tag = 'li' and not in_table and not in_pre and my_list = 'ol' then '{LS}' || repeat('{KS}', 2 * greatest(depth - 1, 0)::int) "
    f"|| (list_start + items - list_items - 1) || '. ' else {FRAGMENT} end"
)


def content_cte(pages: str, precise_min: int = 100) -> str:
    return f"""{clean_cte(pages)}, {CONTEXT}, {LISTS},
    fragments as (
      select page_id, pos, block, {FRAGMENT} as md, {_NUMBERED_ITEM} as numbered, tag, kind, in_link,
        case when kind = 'text' then length(regexp_replace(token, '[ \\t\\r\\n\\f]+', '', 'g')) else 0 end as n
      from list_b
    ),
    block_rows as (
      select page_id, block, string_agg(md, '' order by pos) as md, string_agg(numbered, '' order by pos) as numbered,
        (sum(case when in_link then n else 0 end) * 3 <= sum(n) or bool_or(kind = 'open' and tag in {HEADINGS}))
          and not bool_or(kind = 'open' and tag = 'title') as precise
      from fragments group by page_id, block
    ),
    rendered as (
      select page_id, {finish("coalesce(string_agg(md, '' order by block) filter (where precise), '')")} as precise, {finish("string_agg(numbered, '' order by block)")} as full_md
      from block_rows group by page_id
    ),
    content as (
      select page_id, tier, {clean_markdown("case tier when 1 then precise when 2 then full_md else '' end")} as content
      from (select *, case when length({strip('precise')}) >= {precise_min} then 1 when length({strip('full_md')}) >= 50 then 2 else 0 end::bigint as tier from rendered)
    )"""


def docs_cte(pages: str) -> str:
    return f"""{content_cte(pages)},
    page_docs as (
      select p.page_id as ord, p.url, {page_title('p.html')} as title, coalesce(c.content, '') as content,
        length(coalesce(c.content, ''))::bigint as n_chars, md5(coalesce(c.content, '')) as content_md5
      from {pages} p left join content c using (page_id)
    )"""


def long_enough(c: str) -> str:
    return f"(length({c}) > 0 and length({strip(c)}) >= {fv.MIN_LENGTH})"


# --- greedy split -----------------------------------------------------------------------------------


def split_cte(records: str, limit: int) -> str:
    """``split`` (output, ord, part, seq) from (output, ord, n, header), one record after the other."""
    return f"""
    numbered as (select *, row_number() over (partition by output order by ord) as seq from {records}),
    split as (
      select output, ord, seq, case when header > 0 and header + n > {limit} then 2 else 1 end::bigint as part,
        case when header > 0 and header + n > {limit} then n else header + n end as fill
      from numbered where seq = 1
      union all
      select r.output, r.ord, r.seq, case when s.fill > 0 and s.fill + r.n > {limit} then s.part + 1 else s.part end,
        case when s.fill > 0 and s.fill + r.n > {limit} then r.n else s.fill + r.n end
      from split s join numbered r on r.output = s.output and r.seq = s.seq + 1
    )"""


DOCS = f"(select ord, url, title, content, output, length(content)::bigint as n_chars, md5(content) as content_md5 from {D('docs')})"
DOC_RECORDS = f"(select output, ord, n_chars as n, 0::bigint as header from {DOCS})"
TOC_FRAME = f"{q(fv.TOC_HEADING)} || {NL} || {NL}"


def toc_text(entries: str = "e") -> str:
    """Aggregate over (seq, title, url): the whole table of contents."""
    head, tail = fv.TOC_COUNT.split("{}")
    return (
        f"({TOC_FRAME} || {q(head)} || count(*) || {q(tail)} || {NL} || {NL} || "
        f"string_agg(seq || '. [' || title || '](' || url || ')' || {NL}, '' order by seq) || {NL} || '---' || {NL})"
    )


# --- queries: sources -------------------------------------------------------------------------------

ORACLE["pages_scan"] = "select url, html, 200::bigint as status, false as skipped, '' as reason from pages"

ORACLE["url_list_lines"] = f"""
select line_no, url from (select line_no, {strip('line')} as url, line from {D('url_lines')})
where url <> '' and line[1] <> '#' and not {skippable('url')}"""


def _sitemap_files() -> str:
    xml = "'<?xml version=\"1.0\"?><{0} xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || {1} || '</{0}>'"
    loc = (
        "'<url><loc> ' || u || ' </loc><image:loc>http://i.example.org/x</image:loc></url><url><loc><![CDATA[' || split_part(u, '?', 1) "
        "|| '<!--in-->]]></loc></url><url><loc>http://a.example.org/b.pdf</loc></url>'"
    )
    parts = [
        f"""p as (select page_id, replace(url, '&', '&amp;') as u, page_id // 100 as leaf, page_id // 1000 as mid, page_id // 10000 as top from pages),
        leaves as (select 'https://maps.example.org/leaf-' || leaf || '.xml.gz' as sitemap_url, {xml.format('urlset', f"string_agg({loc}, '' order by page_id)")} as xml from p group by leaf)"""
    ]
    for level, below in (("mid", "leaf"), ("top", "mid")):
        body = (
            "'<sitemap><loc>https://maps.example.org/top-' || min(t) || '.xml.gz</loc></sitemap><sitemap><loc>https://maps.example.org/none.xml</loc></sitemap>"
            "<sitemap></sitemap>' || string_agg('<sitemap><loc>' || child || '</loc></sitemap>', '' order by b) || '<sitemap><loc>' || min_by(child, b) || '</loc></sitemap>'"
        )
        parts.append(
            f"""{level}s as (select 'https://maps.example.org/{level}-' || l || '.xml.gz' as sitemap_url, {xml.format('sitemapindex', body)} as xml
            from (select distinct {level} as l, {below} as b, top as t, 'https://maps.example.org/{below}-' || {below} || '.xml.gz' as child from p) group by l)"""
        )
    parts.append("files as (select * from leaves union all select * from mids union all select * from tops)")
    return ",\n".join(parts)


def _loc(inner: str) -> str:
    return strip(f"case when contains({inner}, '<![CDATA[') then regexp_extract({inner}, '(?s)<!\\[CDATA\\[(.*?)\\]\\]>', 1) else {decode_map(inner)} end")


LOCATIONS = f"""
    locs as (
      select sitemap_url, min(pos) as pos, url from (
        select sitemap_url, pos, {_loc('body')} as url from (
          select sitemap_url, unnest(l) as body, unnest(range(len(l))) as pos
          from (select sitemap_url, regexp_extract_all(xml, '(?s)<loc>(.*?)</loc>', 1) as l from files where not contains(xml, '<sitemap>'))))
      where url <> '' and not {skippable('url')} group by sitemap_url, url
    )"""

TREE = """
    edges as (
      select parent, pos, regexp_extract(entry, '<loc>(.*?)</loc>', 1) as child from (
        select sitemap_url as parent, unnest(l) as entry, unnest(range(len(l))) as pos
        from (select sitemap_url, regexp_extract_all(xml, '(?s)<sitemap>(.*?)</sitemap>', 1) as l from files where contains(xml, '<sitemap>')))
      where contains(entry, '<loc>')
    ),
    walks as (
      select r.root, e.child, [e.pos] as path, [e.child] as trail from roots r join edges e on e.parent = r.root
      union all
      select w.root, e.child, list_append(w.path, e.pos), list_append(w.trail, e.child)
      from walks w join edges e on e.parent = w.child where not list_contains(w.trail, e.child)
    ),
    tree as (select root, child as sitemap_url, min(path) as path from walks where child in (select sitemap_url from files) group by root, child)"""

_PATH = "coalesce(array_to_string(path, '.'), '')"

ORACLE["sitemap_entries"] = f"with {_sitemap_files()}, {LOCATIONS} select distinct url from locs"
ORACLE["sitemap_urls"] = f"with {_sitemap_files()}, {LOCATIONS} select sitemap_url, pos, url from locs"

ORACLE["sitemap_tree"] = f"""
with recursive {_sitemap_files()}, roots as (select sitemap_url as root from files where contains(sitemap_url, '/top-')), {TREE}
select root, sitemap_url, {_PATH} as path from tree"""

ORACLE["sitemap_union"] = f"""
with recursive {_sitemap_files()}, {LOCATIONS},
    roots as (select sitemap_url as root, case when contains(sitemap_url, '/top-') then 1 else 0 end as source_ord from files where not contains(sitemap_url, '/leaf-')), {TREE},
    placed as (
      select r.source_ord, t.path, l.pos, l.url from roots r join tree t using (root) join locs l using (sitemap_url)
    )
select 'https://maps.example.org' as site, url, source_ord::bigint as source_ord, {_PATH} as path, pos
from (select *, row_number() over (partition by url order by source_ord, path, pos) as rn from placed) where rn = 1"""

ORACLE["robots_sitemaps"] = f"""
select site, pos, sitemap_url from (
  select site, pos, {strip("regexp_extract(line, '(?i)^sitemap:(.+)', 1)")} as sitemap_url from (
    select site, unnest(l) as line, unnest(range(len(l))) as pos
    from (select site, string_split(replace(txt, chr(13) || chr(10), chr(10)), chr(10)) as l from {D('robots')} where status = 200)))
where sitemap_url <> ''"""

_SITES = f"(select distinct {site('url')} as site, length({site('url')}) % 5 as k from pages)"
ORACLE["source_priority"] = f"""
select site, 'robots' as source, pos::bigint as pos, site || '/robots-' || pos || '.xml' as sitemap_url from {_SITES}, (values (0), (1)) v(pos) where k = 0
union all select site, 'well_known', 0, site || case k when 1 then '/sitemap.xml' when 2 then '/sitemap_index.xml' else '/sitemap/' end from {_SITES} where k in (1, 2, 3)
union all select site, 'url_list', null, null from {_SITES} where k = 4"""

ORACLE["source_fallback"] = f"""
select {site('url')} as site, case when length({site('url')}) % 3 = 0 then {site('url')} || '/from-sitemap' else url end as url from pages"""

# --- queries: sinks ---------------------------------------------------------------------------------


def _kept_cte(text: str, output: str, where: str = "true") -> str:
    return f"""
    sized as (select *, {output} as output, {text} as block from page_docs where {long_enough('content')} and {where}),
    winners as (
      select *, row_number() over (partition by output order by ord) as page_no
      from (select *, row_number() over (partition by output, content_md5 order by ord) as copy from sized) where copy = 1
    )"""


_SITE_SLUG = slug(site("url"))


def _parts(fmt: str) -> str:
    text = {"md": page_block, "txt": text_block, "jsonl": json_line}[fmt]("title", "url", "content")
    if fmt == "md":
        headers = f"select output, {toc_text()} as header_text from (select output, page_no as seq, title, url from winners) group by output"
    elif fmt == "txt":
        base = f"'https://' || {netloc('url')} || '/'"
        headers = f"select {_SITE_SLUG} as output, {banner('FOLIOMILL', f'min({base})')} as header_text from pages group by 1"
    else:
        headers = "select distinct output, '' as header_text from winners"
    return f"""with recursive {docs_cte('pages')}, {_kept_cte(text, _SITE_SLUG)},
    headers as ({headers}),
    records as (select output, ord, length(block)::bigint as n, length(header_text)::bigint as header from winners join headers using (output)),
    {split_cte('records', SITE_LIMIT)},
    pieces as (
      select s.output, s.part, s.seq, w.block as text, 1 as is_record from split s join winners w on w.output = s.output and w.ord = s.ord
      union all select output, 1, 0, header_text, 0 from headers where header_text <> '' and output in (select output from winners)
    ),
    files as (select output, part, sum(is_record)::bigint as n_records, string_agg(text, '' order by seq) as body from pieces group by output, part)
    select output, part, output || case when part = 1 then '' else '_part' || part end || '.{fmt}' as filename, n_records, length(body)::bigint as n_chars, md5(body) as content_md5 from files"""


for _fmt in ("md", "txt", "jsonl"):
    ORACLE[f"{_fmt}_parts"] = _parts(_fmt)

_LINE_SHAPE = "regexp_replace({}, '[^z\\n]', '', 'g')".format
_CHOSEN = f"(select * from {D('page_results')} where (contains(url, '/en/') or contains(url, '/fr/') or contains(url, '/de/')) and not contains(url, 'spam'))"
SKIPS = f"""chosen as (select * from {_CHOSEN}), {docs_cte("(select page_id, url, html from chosen where not skipped and html <> '')")},
    states as (
      select ord, row_number() over (partition by {slug(site('url'))}, md5({_LINE_SHAPE('content')}) order by ord) as copy from page_docs where {long_enough('content')}
    ),
    outcome as (
      select url, case when skipped then 'error' when copy is null then 'short' when copy > 1 then 'duplicate' end as stage, reason as why, error_type as kind
      from chosen left join states on ord = page_id
    ),
    skips as (
      select url, stage, case stage when 'error' then why when 'short' then 'Nội dung quá ngắn hoặc rỗng (< 50 chars)' else 'Duplicate content' end as reason,
        case when stage = 'error' then kind end as error_type
      from outcome where stage is not null
    )"""
ORACLE["skip_log"] = f"with {SKIPS} select url, stage, reason, case when error_type is null then '[SKIPPED] ' || url || ' — ' || reason else '[ERROR] ' || url || ' — ' || error_type || ': ' || reason end as line from skips"
ORACLE["skip_counts"] = f"with {SKIPS} select stage, count(*) as n from skips group by stage"

ORACLE["part_names"] = f"""with recursive {split_cte(DOC_RECORDS, DOC_LIMIT)}
select distinct output, part, {', '.join(f"output || case when part > 1 then '_part' || part else '' end || '.{f}' as {f}_name" for f in fv.FORMATS)} from split"""

# --- queries: filters -------------------------------------------------------------------------------

ORACLE["skip_ext"] = f"select ord, url, {has_ext('url')} as skip from {D('varied_urls')}"
ORACLE["skip_pattern"] = f"select ord, url, {has_pattern('url')} as skip from {D('varied_urls')}"
ORACLE["skippable"] = f"select ord, url from {D('varied_urls')} where not {skippable('url')}"
_INCLUDE = "(contains(url, '/en/') or contains(url, 'blog.'))"
ORACLE["include_filter"] = f"select ord, url from {D('urls')} where {_INCLUDE}"
ORACLE["exclude_filter"] = f"select ord, url from {D('urls')} where {_INCLUDE} and not contains(url, 'utm_') and not contains(url, 'spam')"
ORACLE["include_patterns"] = f"select ord, url from {D('urls')} where exists (select 1 from {D('url_patterns')} p where contains(url, p.pattern))"
ORACLE["exclude_patterns"] = f"""select ord, url from {D('urls')} where not exists (
  select 1 from (select pattern from {D('url_patterns')} union select lower(substr(title, 2, 1)) || '/1' from {DOCS}) p where contains(url, p.pattern))"""
ORACLE["same_domain"] = f"select ord, url, not contains({netloc('url')}, 'www.') as same from {D('urls')}"
ORACLE["min_length"] = f"select ord, n_chars from {DOCS} where {long_enough('content')}"
ORACLE["usable_pages"] = f"select page_id, url from {D('page_results')} where not skipped and html <> ''"

_ATTEMPTS = """(
  select 'https://u.example.org/' || event_id as url, attempt, case when k < 5 then [200, 403, 404, 500, 302][k + 1] else 0 end as status,
    case k when 5 then 'timeout' when 6 then 'reset ' || attempt end as error
  from (select event_id, attempt, ((event_id * 7 + attempt * (event_id % 4)) % 7)::int as k from events, (values (1), (2), (3)) a(attempt)
        where not (event_id % 19 = 0 and attempt = 3)))"""
ORACLE["fetch_outcome"] = f"""
with ending as (
  select *, row_number() over (partition by url order by attempt) as rn from {_ATTEMPTS}
  where attempt = 3 or (error is null and (status in (403, 404) or status < 400))
)
select u.url, e.attempt::bigint as attempt, coalesce(case when e.error is null then e.status else 0 end, 0)::bigint as status,
  e.url is null or e.error is not null or e.status >= 400 as skipped,
  case when e.url is null then 'Max retries exceeded' when e.error = 'timeout' then 'Timeout' when e.error is not null then e.error
    when e.status = 403 then '403 Forbidden' when e.status = 404 then '404 Not Found' when e.status >= 400 then 'HTTP ' || e.status else '' end as reason
from (select distinct url from {_ATTEMPTS}) u left join ending e on e.url = u.url and e.rn = 1"""

# --- queries: joins and graph -----------------------------------------------------------------------


def resolved(base: str, href: str) -> str:
    """Segment lists instead of the engine's string fold."""
    return f"""(select case
        when own <> '' and own <> bs then ref
        when rest[1:2] = '//' then bs || ':' || rest
        when rest = '' then split_part({base}, '#', 1)
        when rest[1] = '?' then root || bp || rest
        else root || (case when regexp_matches(whole, '//|/\\.\\.?(/|$)') then folded || (case when regexp_matches(whole, '(/|/\\.|/\\.\\.)$') then '/' else '' end) else whole end) || query end
      from (select *, list_reduce(list_filter(list_prepend('', string_split(whole, '/')), lambda x, i: i = 1 or (x <> '' and x <> '.')),
          lambda acc, x: case when x = '..' then regexp_replace(acc, '/[^/]*$', '') else acc || '/' || x end) as folded
        from (select *, case when rp[1] = '/' then rp else coalesce(nullif(regexp_extract(bp, '^.*/'), ''), '/') || rp end as whole, rest[length(rp) + 1:] as query
          from (select *, regexp_extract(rest, '^[^?]*') as rp
            from (select *, case when own <> '' then ref[length(own) + 2:] else ref end as rest
              from (select *, lower(regexp_extract(ref, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as own, bs || '://' || {netloc(base)} as root
                from (select split_part({strip(href)}, '#', 1) as ref, {scheme(base)} as bs, regexp_extract({base}, {q(URL_PATTERN)}, 3) as bp)))))))"""


_HREFS = [
    "/p?x=1", "p/q", "../p", "./p", "../../../p/./q/../r/", "?q=1", "#f", "", "mailto:a@example.org", "//h.example.org/p",
    "HTTP://other.example.org/a/../b", "https://other.example.org/x#y", " a//b/. ", "..", "p;v=1?z#t",
]
ORACLE["url_join"] = f"""
select ord, i, {resolved('url', 'href')} as joined
from (select ord, url, unnest([{', '.join(q(h) for h in _HREFS)}]) as href, unnest(range({len(_HREFS)})) as i from {D('urls')})"""


def _links(pages: str, same_site: bool) -> str:
    """Each distinct reference of a page is resolved once, step by step."""
    keyed = f"(select url as src, html from {pages})"
    where = f"where {netloc('dst')} = {netloc('src')}" if same_site else ""
    return f"""with {tokens_cte(keyed, key='src')},
    anchors as (select src, pos, {attribute('token', 'href')} as href from tokens where tag = 'a' and kind in ('open', 'void') and regexp_matches(token, {q(r'''(?i)\shref(\s*=|[\s>/])''')})),
    refs as (
      select src, href, split_part({strip('href')}, '#', 1) as ref, {scheme('src')} as bs, {netloc('src')} as bn, regexp_extract(src, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as bp
      from (select distinct src, href from anchors)),
    owned as (select *, lower(regexp_extract(ref, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as own from refs),
    cut as (select *, case when own <> '' then ref[length(own) + 2:] else ref end as rest from owned),
    pathed as (select *, regexp_extract(rest, '^[^?]*') as rp from cut),
    whole as (
      select *, case when rp[1] = '/' then rp else coalesce(nullif(regexp_extract(bp, '^.*/'), ''), '/') || rp end as path, rest[length(rp) + 1:] as query from pathed),
    folded as (
      select *, regexp_matches(path, '//|/\\.\\.?(/|$)') as dotted, case when regexp_matches(path, '//|/\\.\\.?(/|$)') then list_reduce(
          list_filter(list_prepend('', string_split(path, '/')), lambda x, i: i = 1 or (x <> '' and x <> '.')),
          lambda acc, x: case when x = '..' then regexp_replace(acc, '/[^/]*$', '') else acc || '/' || x end) end as parts from whole),
    target as (
      select src, href, case
          when own <> '' and own <> bs then ref
          when rest[1:2] = '//' then bs || ':' || rest
          when rest = '' then split_part(src, '#', 1)
          when rest[1] = '?' then bs || '://' || bn || bp || rest
          when dotted then bs || '://' || bn || parts || (case when regexp_matches(path, '(/|/\\.|/\\.\\.)$') then '/' else '' end) || query
          else bs || '://' || bn || path || query end as dst
      from folded)
    select a.src, t.dst, a.pos from anchors a join target t on t.src = a.src and t.href = a.href {where.replace("dst", "t.dst").replace("src", "a.src")}"""


ORACLE["page_links"] = _links("pages", True)
ORACLE["rich_links"] = _links(D("rich_pages"), False)

_PASS = f"not {skippable('dst')} and not contains(dst, '/private/') and not contains(dst, '9') and contains(dst, '/doc/') and {netloc('dst')} = {netloc('src')}"
CRAWL = f"""
    edges as (select distinct src, dst from {D('event_links')} where {_PASS}),
    reach as (
      select src as base, src as url, 0::bigint as depth from {D('event_links')} where contains(src, '/misc/') and not {skippable('src')} and not contains(src, '/private/') and not contains(src, '9')
      union
      select r.base, e.dst, r.depth + 1 from reach r join edges e on e.src = r.url where r.depth < 2
    )"""
ORACLE["crawl_bfs"] = f"with recursive {CRAWL} select base, url, min(depth) as depth from reach group by base, url"
ORACLE["crawl_bfs_filtered"] = f"with recursive {CRAWL} select base, url, min(depth) as depth from reach where contains(url, '/doc/') group by base, url"

_HUB = "'https://g.example.org/doc/hub'"
ORACLE["crawl_hub"] = f"""with recursive
    link as (
      select src, dst from {D('event_links')} union select src, {_HUB} from {D('event_links')} union select {_HUB}, dst from {D('event_links')} where pos % 3 = 0),
    edges as (
      select distinct src, dst from link
      where contains(dst, '/doc/') and not {skippable('dst')} and {netloc('dst')} = {netloc('src')}),
    reach as (
      select src as base, src as url, 0::bigint as depth from {D('event_links')} where contains(src, '/misc/') and not {skippable('src')}
      union
      select r.base, e.dst, r.depth + 1 from reach r join edges e on e.src = r.url where r.depth < 3
    )
select base, url, min(depth) as depth from reach group by base, url"""

ORACLE["order_restore"] = f"""
select page_id, p.url, u.last_ord::bigint as restored_ord
from (select ord as page_id, url || case when ord % 10 = 0 then 'x' else '' end as url from {D('repeated_urls')}) p
left join (select url, max(ord) as last_ord from {D('repeated_urls')} group by url) u on u.url = p.url"""

_FRESH = f"(select url from {D('snapshot')} where status = 200 and fetched_at > timestamp '2024-01-29 12:00:00')"
ORACLE["refetch_set"] = f"select ord, url from {D('known_urls')} where url not in {_FRESH}"
ORACLE["reusable_set"] = f"select ord, url from {D('known_urls')} where url in {_FRESH}"

# --- queries: aggregates, windows, order ------------------------------------------------------------

ORACLE["run_totals"] = f"with {SKIPS} select count(*) filter (where stage is null) as kept, count(*) as total, count(stage) as skipped from outcome"
ORACLE["size_estimate"] = f"""
select source as output, count(*) as n_urls, count(*) * 5000 as est_chars, greatest(1, count(*) * 5000 // {DOC_LIMIT} + 1)::bigint as est_parts,
  count(*) / 5 * 1.5::double as est_seconds from documents group by source"""
ORACLE["part_summary"] = f"""with recursive {split_cte(DOC_RECORDS, DOC_LIMIT)}
select s.output, s.part, count(*) as n_records, sum(d.n_chars)::bigint as n_chars from split s join {DOCS} d on d.ord = s.ord group by s.output, s.part"""
ORACLE["dup_groups"] = f"select content_md5, count(*) as n_docs, min(ord) as first_ord, min_by(url, ord) as first_url from {DOCS} group by content_md5"
ORACLE["content_dedup"] = f"""
select ord, url, content_md5 from (select *, row_number() over (partition by content_md5 order by ord) as rn from {DOCS} where {long_enough('content')}) where rn = 1"""
ORACLE["content_dedup_by_output"] = f"""
select output, ord, content_md5 from (select *, row_number() over (partition by output, content_md5 order by ord) as rn from {DOCS}) where rn = 1"""
ORACLE["url_dedup"] = f"select url, ord from (select *, row_number() over (partition by url order by ord) as rn from {D('repeated_urls')}) where rn = 1"
ORACLE["greedy_split"] = f"with recursive {split_cte(DOC_RECORDS, DOC_LIMIT)} select output, ord, part, seq from split"
ORACLE["greedy_split_one_output"] = f"""
with recursive {split_cte(f"(select 'all' as output, ord, n_chars as n, 0::bigint as header from {DOCS})", DOC_LIMIT)} select output, ord, part, seq from split"""
ORACLE["greedy_split_header"] = f"""
with recursive headers as (
  select output, length({toc_text()}) as header from (select output, row_number() over (partition by output order by ord) as seq, title, url from {DOCS}) group by output),
records as (select output, ord, n_chars as n, header from {DOCS} join headers using (output)), {split_cte('records', DOC_LIMIT)}
select output, ord, part, seq from split"""
_NUMBERED = f"(select output, row_number() over (partition by output order by ord) as seq, title, url from {DOCS})"
ORACLE["toc_entries"] = f"select output, seq, title, url from {_NUMBERED}"
ORACLE["toc_text"] = f"""
select output, unnest(l) as line, unnest(range(len(l))) as line_no
from (select output, list_slice(string_split(t, {NL}), 1, -2) as l from (select output, {toc_text()} as t from {_NUMBERED} group by output))"""
ORACLE["max_pages"] = f"""
select output, ord, url from (select *, row_number() over (partition by output order by ord) as rn from {DOCS}) where rn <= 7"""
ORACLE["max_pages_run"] = f"select ord, url from {D('urls')} where not contains(url, 'utm_') order by ord limit 25"
ORACLE["preview"] = "select page_id as ord, url, (select greatest(count(*) - 20, 0) from pages)::bigint as n_more from pages order by page_id limit 20"

# --- queries: HTML to content -----------------------------------------------------------------------

RICH = D("rich_pages")
ORACLE["html_tokens"] = f"with {tokens_cte('pages')} select page_id, pos, kind, tag, token from tokens"
ORACLE["rich_tokens"] = f"with {tokens_cte(RICH)} select page_id, pos, kind, tag, token from tokens"
ORACLE["content_region"] = f"""with {tokens_cte(RICH)}, {spans_cte()}, {REGION}
select page_id, first_pos, last_pos from (select page_id from {RICH}) left join region using (page_id)"""
ORACLE["selector_region"] = f"""with {tokens_cte(RICH)}, {spans_cte()},
    boxes as (select page_id, pos, span_end from spans where kind in ('open', 'void') and tag = 'div' and {has_class('content')}),
    articles as (select page_id, pos, span_end from spans s where kind in ('open', 'void') and tag = 'article'
      and exists (select 1 from boxes b where b.page_id = s.page_id and b.pos < s.pos and b.span_end >= s.pos)),
    heads as (select page_id, pos, span_end from spans s where kind in ('open', 'void') and tag = 'h1'
      and exists (select 1 from articles b where b.page_id = s.page_id and b.pos < s.pos and b.span_end >= s.pos))
select page_id, min(pos) as first_pos, min_by(span_end, pos) as last_pos from (select page_id from {RICH}) left join heads using (page_id) group by page_id"""
_SELECTED = [("blockquote", "true", "p"), ("div", has_class("content"), "h1"), ("section", "true", "ul")]
_MATCHES = " union all ".join(
    f"""select s.page_id, s.pos, s.span_end from spans s where kind in ('open', 'void') and tag = {q(inner)} and exists (
      select 1 from outers o where o.page_id = s.page_id and o.kind = {i} and o.pos < s.pos and o.span_end >= s.pos)"""
    for i, (_, _, inner) in enumerate(_SELECTED)
)
_OUTERS = " union all ".join(
    f"select page_id, pos, span_end, {i} as kind from spans where kind = 'open' and tag = {q(outer)} and {test}" for i, (outer, test, _) in enumerate(_SELECTED)
)
ORACLE["selector_list"] = f"""with {tokens_cte(RICH)}, {spans_cte()}, outers as ({_OUTERS}), matches as ({_MATCHES})
select page_id, min(pos) as first_pos, min_by(span_end, pos) as last_pos from (select page_id from {RICH}) left join matches using (page_id) group by page_id"""
# The tree of spans, element by element: an element that is not closed ends with its parent.
_TREE = f"""
    element as (select *, row_number() over (partition by page_id order by pos) as i from spans where kind in ('open', 'void', 'raw')),
    walk as (
      select page_id, i, pos, null::bigint as parent, case when kind = 'open' then [{{'p': pos, 'e': span_end}}] else [] end as stack from element where i = 1
      union all
      select e.page_id, e.i, e.pos, x.alive[-1].p, case when e.kind = 'open' then list_append(x.alive, {{'p': e.pos, 'e': least(e.span_end, coalesce(x.alive[-1].e, e.span_end))}}) else x.alive end
      from (select w.page_id, w.i + 1 as i, list_filter(w.stack, lambda f: f.e >= n.pos) as alive from walk w join element n on n.page_id = w.page_id and n.i = w.i + 1) x
      join element e on e.page_id = x.page_id and e.i = x.i
    ),
    node as (
      select e.*, w.parent, row_number() over (partition by e.page_id, w.parent order by e.pos) as nth,
        row_number() over (partition by e.page_id, w.parent, e.tag order by e.pos) as nth_type,
        lag(e.pos) over (partition by e.page_id, w.parent order by e.pos) as prev
      from element e join walk w on w.page_id = e.page_id and w.pos = e.pos
    ),
    el as (select * from node where kind in ('open', 'void'))"""


def _first_of(matches: str) -> str:
    return f"""with recursive {tokens_cte(RICH)}, {spans_cte()}, {_TREE}, matches as ({matches})
select page_id, min(pos) as first_pos, min_by(span_end, pos) as last_pos from (select page_id from {RICH}) left join matches using (page_id) group by page_id"""


ORACLE["selector_child"] = _first_of("""
  select l.page_id, l.pos, l.span_end from el l join el o on o.page_id = l.page_id and o.pos = l.parent join el d on d.page_id = l.page_id and d.pos = o.parent
    join el b on b.page_id = l.page_id and b.pos = d.parent
  where l.tag = 'li' and l.nth = 1 and o.tag = 'ol' and o.nth_type = 2 and d.tag = 'div' and b.tag = 'body'
  union all
  select l.page_id, l.pos, l.span_end from el l join el u on u.page_id = l.page_id and u.pos = l.parent join el a on a.page_id = l.page_id and a.pos = u.parent
    join el b on b.page_id = l.page_id and b.pos = a.parent
  where l.tag = 'li' and l.nth = 3 and u.tag = 'ul' and a.tag = 'article' and b.tag = 'body'""")
ORACLE["selector_position"] = _first_of(f"""
  select d.page_id, d.pos, d.span_end from el d join el m on m.page_id = d.page_id and m.pos = d.parent
  where d.tag = 'div' and m.tag = 'main' and exists (
    select 1 from el p where p.page_id = d.page_id and p.parent = d.parent and p.pos < d.pos and p.tag = 'p' and p.nth_type % 2 = 1)
  union all
  select l.page_id, l.pos, l.span_end from el l where l.tag = 'li' and l.nth % 2 = 0 and exists (
    with recursive up as (
      select u.pos, u.parent, u.tag, u.prev from el u where u.page_id = l.page_id and u.pos = l.parent
      union all select a.pos, a.parent, a.tag, a.prev from up join el a on a.page_id = l.page_id and a.pos = up.parent)
    select 1 from up join el h on h.page_id = l.page_id and h.pos = up.prev join el s on s.page_id = l.page_id and s.pos = h.parent
    where up.tag = 'ul' and h.tag = 'h1' and h.nth = 1 and s.tag = 'section')
  union all
  select c.page_id, c.pos, c.span_end from el c join el d on d.page_id = c.page_id and d.pos = c.parent where c.nth = 4 and {has_class('content').replace('token', 'd.token')}""")
for _name, _tags, _classes, _noise in (
    ("noise_tags", True, False, NOISE_CLASS), ("noise_class", False, True, NOISE_CLASS), ("noise_class_word", False, True, NOISE_WORD),
):
    ORACLE[_name] = f"""with {tokens_cte(RICH)}, {spans_cte()}, {kept_cte('spans', _tags, _classes, noise=_noise)}
    select page_id, pos, kind, tag, token from kept"""
ORACLE["clean_pages"] = clean_text("pages")
ORACLE["clean_rich_pages"] = clean_text(RICH)
_NO_TITLE = "regexp_replace(html, '<title>[^<]*</title>', '', 'g')"
ORACLE["page_title"] = f"""
select variant, page_id, {page_title('html')} as title from (
  select 'as is' as variant, page_id, html from pages
  union all select 'no title', page_id, regexp_replace(html, '<title>[^<]*</title>', case when page_id % 2 = 0 then '' else '<title> </title>' end, 'g') from pages
  union all select 'nothing', page_id, regexp_replace({_NO_TITLE}, '</?h1>', '', 'g') from pages
  union all select 'rich', page_id, html from {RICH})"""
ORACLE["h1_title"] = f"select page_id, {h1_title('html')} as h1 from {RICH}"
ORACLE["extract_tiers"] = f"""
select page_id, tier, length(content)::bigint as n_chars, md5(content) as content_md5 from (
  select page_id, tier, {clean_markdown("case tier when 1 then precise when 2 then whole else '' end")} as content from (
    select *, case when length({strip('precise')}) >= 100 then 1 when length({strip('whole')}) >= 50 then 2 else 0 end::bigint as tier
    from (select doc_id as page_id, split_part(text, {NL}, 1) as precise, text as whole from documents)))"""
ORACLE["page_markdown"] = f"with {content_cte('pages')} select page_id, tier, content from content"
ORACLE["full_markdown"] = f"with {content_cte(RICH, 2**31 - 1)} select page_id, tier, content from content"
ORACLE["rich_markdown"] = f"with {content_cte(RICH)} select page_id, tier, content from content"
ORACLE["code_language"] = f"select doc_id, {language(class_list('token'))} as language from {D('classes')}"
ORACLE["entities"] = f"select doc_id, {decode_map('text')} as text from {D('entity_texts')}"

# --- queries: scalar functions ----------------------------------------------------------------------

ORACLE["url_parts"] = f"""
select ord, {scheme('url')} as scheme, {netloc('url')} as netloc, {path('url')} as path, regexp_matches(url, '^https?://') as is_web from {D('varied_urls')}"""
ORACLE["site_slug"] = f"select ord, {slug('url')} as slug from {D('varied_urls')}"
ORACLE["page_block"] = f"select ord, {page_block('title', 'url', 'content', 'case when ord % 2 = 0 then output end')} as block from {DOCS}"
ORACLE["txt_block"] = f"select ord, {text_block('title', 'url', 'content')} as block from {DOCS}"
ORACLE["txt_banner"] = f"select ord, {banner('CORPUS', 'url')} as banner from {DOCS}"
ORACLE["jsonl_line"] = f"select ord, {json_line('title', 'url', 'content')} as line from {DOCS}"
ORACLE["content_md5"] = "select doc_id as ord, md5(text) as content_md5 from documents"
ORACLE["clean_markdown"] = f"select doc_id, {clean_markdown('text')} as text from {D('markdown_texts')}"


def chunks_cte(limit: int) -> str:
    """``chunks`` (doc_id, chunk_no, chunk): paragraph after paragraph, the open chunk as text."""
    fits = f"length(c.open) + length(p.para) + 2 <= {limit}"
    return f"""
    paras as (
      select doc_id, unnest(l) as para, unnest(range(len(l))) as i, len(l) as n
      from (select doc_id, string_split(text, {NL} || {NL}) as l from {D('paragraph_texts')} where length(text) > {limit})
    ),
    packing as (
      select doc_id, i, n, 0::bigint as chunk_no, para as open, null::varchar as done from paras where i = 0
      union all
      select c.doc_id, p.i, p.n, case when c.open <> '' and not ({fits}) then c.chunk_no + 1 else c.chunk_no end,
        case when c.open <> '' and {fits} then c.open || {NL} || {NL} || p.para else p.para end,
        case when c.open <> '' and not ({fits}) then c.open end
      from packing c join paras p on p.doc_id = c.doc_id and p.i = c.i + 1
    ),
    chunks as (
      select doc_id, chunk_no - 1 as chunk_no, {strip('done')} as chunk from packing where done is not null
      union all select doc_id, chunk_no, {strip('open')} from packing where i = n - 1 and open <> ''
      union all select doc_id, 0, text from {D('paragraph_texts')} where length(text) <= {limit}
    )"""


ORACLE["chunk_text"] = f"with recursive {chunks_cte(2000)} select doc_id, chunk_no, chunk from chunks"
ORACLE["summary_input"] = f"select ord, 'Tiêu đề: ' || title || {NL} || {NL} || 'Nội dung:' || {NL} || content[1:3000] as prompt from {DOCS}"
_WORDS = f"regexp_split_to_array({strip('content')}, '[{fv.WHITE_SPACE_CLASS}]+')"
ORACLE["summary_clamp"] = f"""
select ord, case when len({_WORDS}) > 70 then array_to_string({_WORDS}[1:60], ' ') || '...' else {strip('content')} end as summary from {DOCS}"""
ORACLE["strip_noise_chars"] = f"select doc_id, replace(replace(replace(replace(text, chr(160), ' '), chr(8203), ''), chr(7), ''), chr(65279), '') as text from {D('noisy_texts')}"
ORACLE["iso_timestamp"] = """
select event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || case when microsecond(t) % 1000000 = 0 then '' else strftime(t, '.%f') end || '+00:00' as iso
from (select event_id, case when event_id % 3 = 0 then date_trunc('second', ts) else ts end as t from events)"""
ORACLE["rejoin_chunks"] = f"select conv_id, string_agg(text, {NL} || {NL} order by turn) as text from conversations group by conv_id"

# --- queries: enrichment ----------------------------------------------------------------------------

ORACLE["refine_hook"] = f"""with recursive {chunks_cte(2000)}
select t.doc_id, case when {strip('t.text')} = '' or contains(t.text, '!') then t.text else c.joined end as content
from {D('paragraph_texts')} t
left join (select doc_id, string_agg(replace(chunk, 'a', ''), {NL} || {NL} order by chunk_no) as joined from chunks group by doc_id) c using (doc_id)"""
_FIRST = f"{strip("split_part(content[1:3000], '.', 1)")}"
_FIRST_WORDS = f"regexp_split_to_array({_FIRST}, '[{fv.WHITE_SPACE_CLASS}]+')"
ORACLE["summary_hook"] = f"""
select ord, case when {strip('content')} = '' or not contains(content[1:3000], '.') then null
  when len({_FIRST_WORDS}) > 70 then array_to_string({_FIRST_WORDS}[1:60], ' ') || '...' else {_FIRST} end as summary from {DOCS}"""

# --- queries: streaming and whole runs --------------------------------------------------------------

ORACLE["stream_ingest"] = f"""with {docs_cte('pages')}
select ord, url, title, n_chars, content_md5 from (select *, row_number() over (partition by content_md5 order by ord) as rn from page_docs where {long_enough('content')}) where rn = 1"""
ORACLE["stream_ingest_batches"] = ORACLE["stream_ingest"]
ORACLE["stream_dedup"] = """with recursive kept as (
    select user_id, min(ts) as ts from events group by user_id
    union all select e.user_id, min(e.ts) from kept k join events e on e.user_id = k.user_id and e.ts > k.ts + interval 24 hour group by e.user_id, k.ts
)
select 'https://u.example.org/' || user_id as url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as fetched_at from kept"""
ORACLE["stream_dedup_late"] = """with recursive fetched as (select case when event_id % 3 = 0 then 7 else user_id end as user_id, ts from events),
kept as (
    select user_id, min(ts) as ts from fetched group by user_id
    union all select e.user_id, min(e.ts) from kept k join fetched e on e.user_id = k.user_id and e.ts > k.ts + interval 24 hour group by e.user_id, k.ts
)
select 'https://u.example.org/' || user_id as url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as fetched_at from kept"""

ORACLE["corpus"] = f"""with recursive {docs_cte('pages')}, {_kept_cte(page_block('title', 'url', 'content'), "'corpus'")},
    records as (select output, ord, length(block)::bigint as n, (select length({toc_text()}) from (select page_no as seq, title, url from winners))::bigint as header from winners),
    {split_cte('records', 100_000)}
select s.output, s.part, s.seq, s.ord, w.url, w.title, w.n_chars, w.content_md5, w.content from split s join winners w using (ord)"""
ORACLE["site_corpus"] = f"""with recursive {docs_cte('pages')}, {_kept_cte(json_line('title', 'url', 'content'), _SITE_SLUG, "not contains(url, 'spam')")},
    records as (select output, ord, length(block)::bigint as n, 0::bigint as header from winners), {split_cte('records', SITE_LIMIT)}
select s.output, s.part, s.seq, s.ord, w.url, w.title, w.n_chars, w.content_md5, w.content from split s join winners w using (ord)"""

_SHAPE = "regexp_replace({}, '[^z\\n]', '', 'g')".format
ORACLE["refined_corpus"] = f"""with recursive {docs_cte('pages')},
    refined as (select *, {_SHAPE('content')} as refined, split_part(content[1:3000], ' ', 1) as word from page_docs where {long_enough('content')}),
    sized as (select *, {_SITE_SLUG} as output, length({page_block('title', 'url', 'refined', strip('word'))})::bigint as n from refined),
    winners as (
      select *, row_number() over (partition by output order by ord) as page_no
      from (select *, row_number() over (partition by output, md5(refined) order by ord) as copy from sized) where copy = 1
    ),
    headers as (select output, length({toc_text()})::bigint as header from (select output, page_no as seq, title, url from winners) group by output),
    records as (select output, ord, n, header from winners join headers using (output)), {split_cte('records', SITE_LIMIT)}
select s.output, s.part, s.seq, s.ord, md5(w.refined) as content_md5 from split s join winners w using (ord)"""
