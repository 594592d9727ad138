"""DuckDB SQL of the queries that SQL can express.

Not here: packing and token shards need a tokenizer, and the two classifiers and the
search need trained models or a seeded projection; tests hold these against brute force,
exact round trips and held-out labels.
"""

from __future__ import annotations

from docloom.llm import revisits, rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_MIX = f"""
with sizes as (
  select doc_id, source, len({_WORDS}) as size, ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as u
  from documents),
totals as (
  select source, sum(size)::bigint as size, row_number() over (order by source nulls last) - 1 as k from sizes group by source),
weighed as (
  select source, size, [5.0, 2.0, 1.0][(k % 3 + 1)::int]::double as w, 2.0::double * size as cap from totals),
ordered as (
  select *, row_number() over (order by cap / w, source nulls last) as r, 1.5::double * sum(size) over () as budget,
    sum(cap) over () as all_cap, sum(w) over () as all_w from weighed),
levels as (
  select r, cap / w as ratio, budget,
    (budget - (sum(cap) over (order by r) - cap)) / (all_w - (sum(w) over (order by r) - w)) as level from ordered),
filled as (
  select o.source, o.size, least(o.w * l.level, o.cap) as target
  from ordered o, (select level from levels where level <= ratio order by r limit 1) l),
parts as (
  select source, size as source_size, target, case when size > 0 then floor(target / size)::bigint else 0 end as whole,
    target - (case when size > 0 then floor(target / size)::bigint else 0 end) * size as part from filled),
run_ as (
  select s.*, p.source_size, p.target, p.whole, p.part,
    coalesce(sum(s.size) over (partition by s.source order by s.u rows between unbounded preceding and 1 preceding), 0) as before
  from sizes s join parts p on s.source is not distinct from p.source),
taken as (select *, whole + case when part > 0 and before + size / 2 <= part then 1 else 0 end as copies from run_)
select doc_id, size::bigint as size, source_size, target, (size * copies)::bigint as taken from taken"""

_LINES = f"""
with docs as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
flat as (select rid, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from docs),
keyed as (select *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') as k from flat),
shared as (select k from keyed where len(k) >= 1 group by k having count(distinct rid) >= 10),
marked as (select f.*, s.k is not null as gone from keyed f left join shared s using (k))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by rid"""

_NEAR = f"""
with recursive words as (select doc_id, {_WORDS.replace('coalesce(text, ' + chr(39) * 2 + ')', f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as ws from documents),
sets as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from words),
flat as (select doc_id, len(sh) as n, unnest(sh) as x from sets),
hashed as (select doc_id, n, x from flat where x in (select x from flat group by x having count(*) > 1)),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common
  from hashed a join hashed b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs where 100 * common >= 70 * (na + nb - common)),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, a from edges union select b, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
comps as (select a, min(b) as c from reach group by a)
select s.doc_id, len(s.sh) as n_shingles, coalesce(c.c, s.doc_id) as component_id, s.doc_id = coalesce(c.c, s.doc_id) as kept
from sets s left join comps c on s.doc_id = c.a"""

_HOST = f"regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^[^@]*@', '')), ':(80|443)$', ''), '{revisits.MOBILE}', '')"
_PATH = "regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/index\\.[A-Za-z]+$', '/'), '/+$', '')"
_KEPT = f"list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{revisits.TRACKING}')))"
_WARC = f"""
with seen as (select page_id as p, url, sha1(coalesce(html, '')) as h, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') as rest from pages),
told as (select p, url, h, {_HOST} as host, regexp_extract({_HOST} || {_PATH}, '^[^/]*/([^/?]*)', 1) as section from seen),
named as (select *, case when host = '' then null when p % 2 = 0 then regexp_extract(host, '[^.]+\\.[^.]+$') else host || '/' || section end as topic from told),
recs as (
  select p, p || '-page' as id, url, p * 10 as ts, 1 as whole, p % 11 <> 5 as good, '"' || substr(h, 1, 12) || '"' as etag, null as lm, 'sha1:' || h as digest from named
  union all
  select p, p || '-again', case when p % 13 <> 6 then url end, p * 10 + 5, 0, true, '"' || substr(h, 1, 12) || '"', null, case when p % 4 < 2 then 'sha1:' || h end from named
  union all
  select p, p || '-shared', case when p % 2 = 0 then 'http://' else 'https://' end || topic, (p - p % 4) * 10, (p % 5 = 0)::int, true,
    case when p % 5 = 0 or p % 7 in (1, 2, 6) then '"' || substr(md5(topic || ':' || (p // 97)), 1, 12) || '"' when p % 7 = 3 then '"' || substr(md5(topic || ':' || (p // 97 - 1)), 1, 12) || '"' end,
    case when p % 5 = 0 or p % 7 = 4 then 'day ' || (p // 61) end, case when p % 5 = 0 or p % 7 in (5, 6) then 'sha1:' || sha1(topic || ':' || (p // 41)) end from named),
bare as (select * exclude (url), regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') as rest from recs where good),
keyed as (select *, case when {_HOST} <> '' then {_HOST} || {_PATH} || case when len({_KEPT}) > 0 then '?' || array_to_string({_KEPT}, '&') else '' end end as url_key from bare),
met as (select *, case when url_key is not null then last_value(case when whole = 1 then {{'id': id, 'p': p, 'etag': etag, 'lm': lm, 'digest': digest, 'ts': ts}} end ignore nulls)
  over (partition by url_key order by ts, id rows between unbounded preceding and current row) end as r from keyed),
compared as (select *, [case when etag <> '' and r.etag <> '' then 'etag' end, case when lm <> '' and r.lm <> '' then 'last_modified' end, case when digest <> '' and r.digest <> '' then 'digest' end] as c from met where whole = 0),
judged as (select *, list_filter(c, lambda x: x is not null) as cs, case when r is null then 'no-response'
  when coalesce(etag <> r.etag, false) or coalesce(lm <> r.lm, false) or coalesce(digest <> r.digest, false) then 'validator-mismatch'
  when len(list_filter(c, lambda x: x is not null)) = 0 then 'unvalidated' else 'resolved' end as status from compared)
select id as record_id, url_key, r.id as response_id, status, case when r is null then '' else array_to_string(cs, ',') end as checked,
  case when status = 'resolved' then 'cache-control=max-age=60;content-type=text/html;date=t' || ts || ';etag=' || r.etag || ';x-page=' || r.p
    else 'cache-control=max-age=60;date=t' || ts || ';server=cache' end as headers
from judged"""

_RULES = {
    "symbols": ("n_symbols / n_words", 1.0, 0.02), "dup_lines": ("coalesce(n_dup_lines / nullif(n_lines, 0), 0)", 1.0, 0.15), "repeats": ("n_repeat_words / n_words", 0.3, 0.1),
    "upper": ("n_upper / word_chars", 1.0, 0.05), "bangs": ("n_bangs / n_words", 1.0, 0.02), "long_words": ("word_chars / n_words", 40.0, 6.0), "short_words": ("8.0 - word_chars / n_words", 8.0, 4.0),
}
_S, _SHARE = rules.STEPS, rules.ALLOWED
_FIRST = ", ".join(f"floor(({loose}::double - v{k}) / {(loose - strict) / (_S - 1)!r}::double) + case when v{k} > {loose} then 0 else 1 end" for k, (_, loose, strict) in enumerate(_RULES.values()))
_VALUES = ", ".join(f"({value})::double as v{k}" for k, (value, _, _) in enumerate(_RULES.values()))
_QUALITY = f"""
with docs as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text from documents),
ws as (select rid, {_WORDS} as w from docs),
win as (select rid, i, hash(w[i:i + 7]) as h, array_to_string(w[i:i + 7], ' ') as x from (select rid, w, unnest(range(1, len(w) - 6)) as i from ws where len(w) >= 8)),
twice as (select rid, i from win where (rid, x) in (select (rid, x) from win group by rid, x having count(*) > 1)),
covered as (select rid, count(distinct i + k) as n from twice, (select unnest(range(8)) as k) group by rid),
lines as (select rid, count(*) as n, count(*) - count(distinct l) as dup from (select rid, unnest(string_split(text, chr(10))) as l from docs) where trim(l, {_SPACE}) <> '' group by rid),
stats as (
  select d.rid, d.doc_id, d.lang, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
    coalesce(l.dup, 0) as n_dup_lines, coalesce(l.n, 0) as n_lines, coalesce(c.n, 0) as n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) as n_upper, len(regexp_extract_all(text, '!')) as n_bangs
  from docs d join ws using (rid) left join lines l using (rid) left join covered c using (rid)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from stats),
good as (select doc_id, min(quality) as q from labels where quality is not null group by doc_id having min(quality) = max(quality)),
valued as (select rid, lang, q, {_VALUES} from judged left join good using (doc_id) where not base_failed),
stepped as (select rid, lang, q, least({_S}, greatest(0, least({_FIRST})))::int as step from valued),
counts as (select lang, step, count(*) filter (q > 0) as good, count(*) filter (q <= 0) as bad from stepped where q is not null group by lang, step),
tests as (select greatest(1, count(distinct coalesce(lang, ''))) as m from counts),
full_ as (select g.lang, s.step, coalesce(c.good, 0) as good, coalesce(c.bad, 0) as bad
  from (select distinct lang from counts) g cross join (select unnest(range({_S} + 1)) as step) s left join counts c on c.lang is not distinct from g.lang and c.step = s.step),
summed as (select *, sum(good) over w as g, sum(bad) over w as b, sum(good) over (partition by lang) as n from full_ window w as (partition by lang order by step)),
bound as (
  select *, n > 0 and g < n * {_SHARE!r} and list_sum(list_transform(range((g + 1)::int), lambda i: exp(lgamma(n + 1) - (case when i > 0 then lgamma(i + 1) else 0 end) - lgamma(n - i + 1) + i * ln({_SHARE!r}) + (n - i) * ln(1 - {_SHARE!r})))) <= {rules.LEVEL} / m as ok
  from summed, tests where step < {_S}),
sure as (select *, b - {rules.GOOD_WEIGHT} * g as value from (select *, bool_and(ok) over (partition by lang order by step) as all_ok from bound) where all_ok),
cuts as (select lang, arg_max(step, value * 1000 - step) as cut from sure where value > 0 group by lang),
failed as (select s.rid from stepped s join cuts c on s.lang is not distinct from c.lang where s.step <= c.cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rid not in (select rid from failed) as kept from judged"""

SQL: dict[str, str] = {
    "op1_mix_sources": _MIX,
    "op3_line_dedup": _LINES,
    "op4_near_dedup": _NEAR,
    "op6_warc_revisits": _WARC,
    "op8_quality_rules": _QUALITY,
}
