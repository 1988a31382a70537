"""The numbered queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_OP1 = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
pattern as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as p
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as i from item where len(w) > 0)),
lengths as (select distinct n from pattern),
gram as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as p
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, lengths where len(w) >= n)),
hit as (select g.doc_id, g.n, g.i, p.item_id from gram g join pattern p using (n, p)),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from hit) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join covered using (doc_id) left join items using (doc_id)
"""

_OP3 = r"""
with doc as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
gram as (
  select doc_id, i, array_to_string(w[i : i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from doc where len(w) >= 5)),
again as (select doc_id, i, count(*) over (partition by doc_id, g) as n from gram),
repeats as (
  select doc_id, count(distinct pos) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 5)) as pos from again where n > 1) group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct l) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as l from doc) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
measured as (
  select doc.doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from doc left join lines using (doc_id) left join repeats using (doc_id)),
rule as (
  select *, unnest([1, 2, 3, 4, 5]) as r,
    unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > word_chars, 3 * n_dup_lines > n_words,
      n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > word_chars or 3 * n_dup_lines > n_words]) as failed
  from measured where source is not null),
host as (select source, r, count(*) as n, sum(cast(failed as bigint)) as k from rule group by source, r),
moment as (select r, count(*) as h, sum(n) as n, sum(k) / sum(n) as m, sum(k * k / n) as q from host group by r),
alike as (select r, m, case when m > 0 and m < 1 and n > h then ((q - n * m * m) / (m * (1 - m)) - h) / (n - h) else 0 end as rho from moment),
prior as (select r, m, case when rho > 0 then least(greatest(1 / rho - 1, 1), 1000) else 1000 end as s from alike),
bad as (select distinct source from host join prior using (r) where (k + m * s) / (n + s) > case when r = 5 then 0.75 else 0.6 end)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and bad.source is null as kept
from measured left join bad using (source)
"""

_OP13 = r"""
with doc as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
cut as (
  select doc_id, t, u, cast(len(u) as bigint) as n, cast('0x' || h[1:8] as bigint) % (len(u) + 1) as r1, cast('0x' || h[9:16] as bigint) % (len(u) + 1) as r2,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 50 then 'plain'
      when cast('0x' || h[25:32] as bigint) % 100 < 80 then 'spm' else 'psm' end as form
  from (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from doc)),
three as (
  select doc_id, t, n, form, array_to_string(u[1 : least(r1, r2)], '') as p,
    array_to_string(u[least(r1, r2) + 1 : greatest(r1, r2)], '') as m, array_to_string(u[greatest(r1, r2) + 1 : n], '') as s
  from cut)
select doc_id, n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from three
"""

ORACLE: dict[str, str] = {"op1_decontaminate": _OP1, "op3_quality_rules": _OP3, "op13_fill_in_middle": _OP13}
