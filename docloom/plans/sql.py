"""DuckDB SQL for the same rows as the queries beside it.

Patterns are those of the rules, without what RE2 lacks: a look-around becomes a group
that is put back, and is applied twice because neighbouring matches share a character.
Each rule leaves a private-use character that only at the end becomes its token.
"""

from __future__ import annotations

import re

from docloom.functions.paths import BUCKETS
from docloom.operators.redaction.rules import BY_NAME, RULES
from docloom.plans.queries import ALLOWED, CHAT, DENIED, ENDINGS, VECTORS
from docloom.sources.tables import FIXED_TIME

SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(rule: str) -> str:
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", BY_NAME[rule].pattern)


def values(rows) -> str:
    return ", ".join("(" + ", ".join(s(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


TEXTS = f"texts as (select doc_id, text from documents union all select * from (values {values(VECTORS)}) v(doc_id, text))"
CHATS = f"chat as (select conv_id, turn, role, text from conversations union all select * from (values {values(CHAT)}) v(conv_id, turn, role, text))"
DOCS = f"""recs as (select doc_id, coalesce(source, 'none') || '/' || doc_id || '.txt' as path, doc_id || '.txt' as name, coalesce(source, 'none') as folder,
 strlen(coalesce(text, '')) as size_bytes, timestamp '{FIXED_TIME}' as modified, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents)"""
_PATHS = f"paths as (select doc_id, 'root/' || coalesce(source, 'none') || '/File ' || doc_id || ([{', '.join(s(e) for e in ENDINGS)}])[(doc_id % {len(ENDINGS)} + 1)::int] as path from documents)"
_EXT = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"


def simple(expr: str, rule: str, token: str | None = None) -> str:
    return f"regexp_replace({expr}, {s(re2(rule))}, {s(token if token is not None else BY_NAME[rule].token)}, 'g')"


def between(expr: str, inner: str, edge: str, token: str) -> str:
    """A pattern that may not touch the edge class, applied twice."""
    pattern = s(f"(^|[^{edge}])(?:{inner})($|[^{edge}])")
    once = lambda e: f"regexp_replace({e}, {pattern}, '\\1' || {token} || '\\2', 'g')"
    return once(once(expr))


def phone(expr: str, token: str) -> str:
    inner = re2("phone").removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)")
    return between(expr, inner, "0-9", token)


def v6(expr: str, token: str) -> str:
    inner = re2("ipv6").removeprefix(r"(?<![:\w])(?:").removesuffix(r")(?![:\w])")
    return between(expr, inner, "0-9A-Za-z_:", token)


def luhn(value: str) -> str:
    digits = f"list_reverse(string_split(regexp_replace({value}, '[^0-9]', '', 'g'), ''))"
    doubled = "case when i % 2 = 0 then case when d::int * 2 > 9 then d::int * 2 - 9 else d::int * 2 end else d::int end"
    return f"(len({digits}) between 13 and 16 and list_sum(list_transform({digits}, lambda d, i: {doubled})) % 10 = 0)"


def cards(expr: str, hit: str) -> str:
    """hit: an expression of v, the matched value."""
    marked = f"regexp_replace({expr}, {s('(' + re2('card') + ')')}, chr(57344) || '\\1' || chr(57345), 'g')"
    value = "split_part(p, chr(57345), 1)"
    rest = f"split_part(p, chr(57345), 2)"
    letter = r"^[ -]([\p{L}\p{N}_])"
    # a wide letter behind a trailing separator: the match ends behind the separator
    wide = f"regexp_matches({rest}, {s(letter)}) and not regexp_matches({rest}, '^[ -][0-9A-Za-z_]')"
    full = f"({value} || case when {wide} then {rest}[1] else '' end)"
    tail = f"case when {wide} then {rest}[2:] else {rest} end"
    return f"""array_to_string(list_transform(string_split({marked}, chr(57344)), lambda p: case when contains(p, chr(57345)) then
 case when {luhn(value)} then {hit.replace('{v}', full)} || {tail} else {value} || {rest} end else p end), '')"""


def engine(source: str, aggressive: bool, skip: tuple[str, ...] = (), pick: str = "doc_id") -> tuple[str, str]:
    """CTEs that run all rules over a CTE with column t, and the name of the last; column t then has a mark for each claim."""
    ctes, last = [], source
    for k, r in enumerate(RULES):
        if r.aggressive and not aggressive or r.category in skip or r.name == "secret_entropy":
            continue
        mark = f"chr({57354 + k})"
        if r.name == "card":
            expr = cards("t", mark)
        elif r.name == "phone":
            expr = phone("t", mark)
        elif r.name == "ipv6":
            expr = v6("t", mark)
        else:
            expr = f"regexp_replace(t, {s(re2(r.name))}, {mark}, 'g')"
        ctes.append(f"e{k} as (select {pick}, {expr} as t from {last})")
        last = f"e{k}"
    if aggressive and "Secret" not in skip:
        k = len(RULES) - 1
        ctes.append(f"e{k} as (select {pick}, {entropy_replaced('t', f'chr({57354 + k})')} as t from {last})")
        last = f"e{k}"
    return ", ".join(ctes), last


def bits(value: str) -> str:
    letters = f"string_split({value}, '')"
    return f"list_sum(list_transform(list_distinct({letters}), lambda c: -(len(list_filter({letters}, lambda x: x = c)) / len({value})) * log2(len(list_filter({letters}, lambda x: x = c)) / len({value}))))"


def random_looking(value: str) -> str:
    return f"(len({value}) >= 32 and regexp_matches({value}, '[A-Za-z]') and regexp_matches({value}, '[0-9]') and {bits(value)} >= 4.0)"


_BLOB = "[-+/0-9A-Z_a-z]{32,}={0,2}"


def entropy_replaced(expr: str, token: str) -> str:
    """The blob pattern is greedy, so its own letters cannot stand before it; behind its signs of equality they may, and then it is not taken."""
    marked = f"regexp_replace({expr}, '({_BLOB})', chr(57344) || '\\1' || chr(57345), 'g')"
    value, rest = "split_part(p, chr(57345), 1)", "split_part(p, chr(57345), 2)"
    ok = f"(not regexp_matches({rest}, '^[-+/0-9A-Z_a-z]') and {random_looking(value)})"
    return f"array_to_string(list_transform(string_split({marked}, chr(57344)), lambda p: case when contains(p, chr(57345)) then case when {ok} then {token} || {rest} else {value} || {rest} end else p end), '')"


def tokens(expr: str, skip: tuple[str, ...] = ()) -> str:
    for k, r in enumerate(RULES):
        expr = f"replace({expr}, chr({57354 + k}), {s(r.token)})"
    return expr


def whole_engine(aggressive: bool, skip: tuple[str, ...] = ()) -> str:
    ctes, last = engine("start", aggressive, skip)
    return f"with {TEXTS}, start as (select doc_id, text as t from texts), {ctes} select doc_id, {tokens('t')} as text from {last}"


def counts(aggressive: bool) -> str:
    ctes, last = engine("start", aggressive)
    n = lambda cat: " + ".join(f"(len(t) - len(replace(t, chr({57354 + k}), '')))" for k, r in enumerate(RULES) if r.category == cat)
    parts = " union all ".join(f"select {s(c)} as category, {n(c)} as n from {last}" for c in dict.fromkeys(r.category for r in RULES))
    return f"with {TEXTS}, start as (select doc_id, text as t from texts), {ctes}, c as ({parts}) select category, sum(n)::bigint as n_values, count(*) as n_texts from c where n > 0 group by category"


def normal(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {s(SPACE + '+')}, ' ', 'g'))"


def unescaped(expr: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        expr = f"replace({expr}, {s(entity)}, {s(char)})"
    return expr


def stripped(expr: str, *patterns: tuple[str, str]) -> str:
    for pattern, new in patterns:
        expr = f"regexp_replace({expr}, {s(pattern)}, {new}, 'g')"
    return expr


_HIDDEN = (("(?is)<script\\b[^>]*>.*?</script\\s*>", "' '"), ("(?is)<style\\b[^>]*>.*?</style\\s*>", "' '"))
_TITLE = "(?is)<title\\b[^>]*>(.*?)</title\\s*>"


def chunk_ctes(source: str, columns: str, snap: bool) -> str:
    n, most, step = "len(text)", 1000, 900
    more = f"ceil(greatest({n} - {most}, 0) / {step}.0)::int"
    head = f"regexp_extract(w, {s('(?s)^(.+' + SPACE + ')')}, 1)"
    text = f"case when start_offset + {most} < n and len({head}) >= {step} then {head} else w end" if snap else "w"
    return f"""cut as (select {columns}, text, {n} as n, {more} + 1 as "count", unnest(range({more} + 1)) as "index" from {source} where {n} > 0),
 win as (select {columns}, n, "count"::int as "count", "index"::int as "index", ("index" * {step})::int as start_offset, substring(text, "index"::int * {step} + 1, {most}) as w from cut),
 chunks as (select {columns}, "count", "index", start_offset, {text} as text from win)"""


_OLD = f"""{DOCS}, old as (select path, size_bytes + case when doc_id % 5 = 0 then 1 else 0 end as size_bytes, md5(path) as content_hash from recs where doc_id % 7 <> 0
 union all select 'gone/' || path, size_bytes, null from recs where doc_id % 11 = 3)"""
_TICKS = f"(epoch_us(timestamp '{FIXED_TIME}') * 10 + 621355968000000000)"
_JSON_META = "json_object('lang', lang, 'source', source)"


def json(**parts: str) -> str:
    return "'{' || " + " || ',' || ".join(f"{s(chr(34) + k + chr(34) + ':')} || {v}" for k, v in parts.items()) + " || '}'"


def js(expr: str) -> str:
    return f"to_json({expr})::varchar"


def csv_field(expr: str) -> str:
    return f"case when regexp_matches({expr}, '[,\"\\r\\n]') then '\"' || replace({expr}, '\"', '\"\"') || '\"' else {expr} end"


_ISO = "strftime(modified, '%Y-%m-%dT%H:%M:%SZ')"


def scanned(final: str) -> str:
    """CTEs up to ``scan``: path, n (values redacted at Standard in text and metadata), clipped and t."""
    ctes, last = engine("start", False, pick="path, clipped")
    marks = " + ".join(f"(len(t) - len(replace(t, chr({57354 + k}), '')))" for k in range(len(RULES)))
    first = f"norm as (select path, {normal('text')} as t from recs), start as (select path, len(t) > 20000 as clipped, left(t, 20000) as t from norm)"
    return f"with {DOCS}, {first}, {ctes}, scan as (select path, clipped, {tokens('t')} as text, ({marks})::bigint as n from {last}) {final}"


_DENY = "|".join(DENIED)
_EMAIL = re2("email")

SQL: dict[str, str] = {
    "type_bucket": f"with {_PATHS}, e as (select doc_id, {_EXT} as x from paths) select doc_id, case "
    + " ".join(f"when x in ({', '.join(s(x) for x, c in BUCKETS.items() if c == b)}) then {s(b)}" for b in dict.fromkeys(BUCKETS.values()))
    + " else 'Other' end as type_bucket from e",
    "path_parts": f"with {_PATHS} select path, regexp_extract(path, '([^/]*)$', 1) as name, {_EXT} as extension, regexp_extract(path, '([^/]*)/[^/]*$', 1) as folder from paths",
    "normalize_text": f"with {TEXTS} select doc_id, {normal('text')} as text from texts",
    "clip_text": f"with {TEXTS} select doc_id, left(text, 1000) as text, len(text) > 1000 as clipped from texts",
    "html_title": f"select page_id, nullif({normal(unescaped(stripped(f'regexp_extract(html, {s(_TITLE)}, 1)', ('<[^>]+>', chr(39) + ' ' + chr(39)))))}, '') as title from pages",
    "html_text": f"select page_id, {normal(unescaped(stripped('html', *_HIDDEN, ('(?s)<!--.*?-->', chr(39) + ' ' + chr(39)), (_TITLE, chr(39) + ' ' + chr(39)), ('<[^>]+>', chr(39) + ' ' + chr(39)))))} as text from pages",
    "html_block_text": "select page_id, regexp_replace(" + stripped(
        unescaped(stripped("html", ("(?is)<script\\b[^>]*>.*?</script>", "' '"), ("(?is)<style\\b[^>]*>.*?</style>", "' '"), ("(?i)</?(?:p|div|h[1-6]|li|tr|br|blockquote|section)\\b[^>]*>", "chr(10)"), ("<[^>]+>", "' '"))),
        ("[ \\t\\f\\v]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{2,}", "chr(10)"),
    ) + f", {s('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g') as text from pages",
    "iso_timestamps": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc, strftime(ts + interval 330 minute, '%Y-%m-%dT%H:%M:%S') || '+05:30' as local from events",
    "chunk_windows": f"with {chunk_ctes('documents', 'doc_id', False)} select doc_id, \"index\", \"count\", start_offset, text from chunks",
    "chunk_snapped": f"with {chunk_ctes('documents', 'doc_id', True)} select doc_id, \"index\", \"count\", start_offset, text from chunks",
    "record_jsonl": f"with {DOCS} select path, " + json(
        path=js("path"), name=js("name"), extension=s('".txt"'), folder=js("folder"), sizeBytes="size_bytes::varchar", modified=js(_ISO), typeBucket=s('"Text"'),
        metadata=json(lang=js("lang"), source=js("source")), text=js("text"), redactions=s("{}"), warnings=s("[]"), contentHash=s("null"),
    ) + " as line from recs",
    "chunk_jsonl": f"with {DOCS}, {chunk_ctes('recs', 'path, name, lang, source', True)} select path, \"index\", " + json(
        path=js("path"), name=js("name"), typeBucket=s('"Text"'), index='"index"::varchar', count='"count"::varchar', startOffset="start_offset::varchar", text=js("text"), metadata=json(lang=js("lang"), source=js("source")),
    ) + " as line from chunks",
    "csv_row": f"with {DOCS} select path, concat_ws(',', {csv_field('path')}, {csv_field('name')}, '.txt', {csv_field('folder')}, size_bytes::varchar, {_ISO}, 'Text', {csv_field('text')}, '', '', '') as line from recs",
    "parquet_projection": f"with {DOCS} select path as \"Path\", name as \"Name\", '.txt' as \"Extension\", folder as \"Folder\", size_bytes as \"SizeBytes\", modified as \"Modified\", 'Text' as \"TypeBucket\", text as \"Text\", '' as \"Warnings\", '' as \"Redactions\", null::varchar as \"ContentHash\" from recs",
    "memory_rows": f"with {DOCS}, {chunk_ctes('recs', 'path, name, lang, source', True)} select path || '#chunk' || \"index\" as chunk_id, text, name as description, {json(lang=js('lang'), source=js('source'))} as metadata_json from chunks",
    "inc_changed": f"with {_OLD} select r.path, r.size_bytes from recs r left join old o using (path) where o.path is null or o.size_bytes <> r.size_bytes",
    "inc_unchanged": f"with {_OLD} select o.path, o.size_bytes, o.content_hash from recs r join old o using (path) where o.size_bytes = r.size_bytes",
    "inc_removed": f"with {_OLD} select o.path from old o anti join recs r using (path)",
    "inc_manifest": f"with {_OLD} select r.path, r.size_bytes, case when o.size_bytes = r.size_bytes then o.content_hash end as content_hash from recs r left join old o using (path)",
    "manifest_from_records": f"with {DOCS} select path, size_bytes, {_TICKS} as ticks, null::varchar as content_hash from recs",
    "manifest_parse": f"""with {DOCS} select path, size_bytes, epoch_us(modified) as micros, md5(path) as content_hash from recs where not (
 (doc_id % 6 = 1 and doc_id % 4 in (1, 3)) or (doc_id % 6 = 2 and doc_id % 4 in (0, 2)) or doc_id % 6 = 3)""",
    "manifest_dedupe": f"with {DOCS} select folder || '/' || (doc_id % 50) as path, arg_max(size_bytes, doc_id) as size_bytes, max(doc_id)::varchar as content_hash from recs group by 1",
    "redact_api_key": f"with {TEXTS} select doc_id, {simple(simple(simple(simple('text', 'api_key_aws'), 'api_key_google'), 'api_key_github'), 'api_key_slack')} as text from texts",
    "redact_phone": f"with {TEXTS} select doc_id, {phone('text', s('[PHONE]'))} as text from texts",
    "redact_ipv6": f"with {TEXTS} select doc_id, {v6('text', s('[IP]'))} as text from texts",
    "redact_ip": f"with {TEXTS} select doc_id, {v6(simple('text', 'ipv4'), s('[IP]'))} as text from texts",
    "redact_card": f"with {TEXTS} select doc_id, {cards('text', s('[CARD]'))} as text from texts",
    "mask_card_last4": f"with {TEXTS} select doc_id, {cards('text', chr(40) + 'case when len(regexp_replace({v}, ' + s('[^0-9]') + ', ' + s('') + ', ' + s('g') + ')) > 4 then regexp_replace(regexp_extract({v}, ' + s('^(.*?)((?:[0-9][^0-9]*){4})$') + ', 1), ' + s('[0-9]') + ', ' + s('*') + ', ' + s('g') + ') || regexp_extract({v}, ' + s('^(.*?)((?:[0-9][^0-9]*){4})$') + ', 2) else {v} end' + chr(41))} as text from texts",
    "entropy_tokens": f"""with {TEXTS}, p as (select doc_id, regexp_extract_all(text, {s(_BLOB)}) as vs from texts), u as (select doc_id, unnest(vs) as value, generate_subscripts(vs, 1) - 1 as pos from p)
 select doc_id, pos::int as "at", value, round({bits('value')}, 6) as bits from u where {random_looking('value')}""",
    "redact_entropy": f"with {TEXTS} select doc_id, {entropy_replaced('text', s('[SECRET]'))} as text from texts",
    "redact_secret": f"with {TEXTS}, a as (select doc_id, {simple('text', 'secret_assignment', chr(57355))} as t from texts) select doc_id, replace({entropy_replaced('t', s('[SECRET]'))}, chr(57355), '[SECRET]') as text from a",
    "redact_standard": whole_engine(False),
    "redact_aggressive": whole_engine(True),
    "redaction_counts_std": counts(False),
    "redaction_counts_agg": counts(True),
    "redact_disable_phone": whole_engine(False, ("Phone",)),
    "redaction_spans": f"""with {TEXTS}, p as (select doc_id, text, regexp_extract_all(text, {s(_EMAIL)}) as vs, string_split(regexp_replace(text, {s(_EMAIL)}, chr(57344), 'g'), chr(57344)) as gaps from texts),
 u as (select doc_id, vs, gaps, unnest(range(len(vs))) as k from p where len(vs) > 0)
 select doc_id, k::int as at, (list_sum(list_transform(gaps[1:k + 1], lambda g: len(g))) + coalesce(list_sum(list_transform(vs[1:k], lambda v: len(v))), 0))::int as start, len(vs[k + 1])::int as length, 'Email' as category from u""",
    "sensitive_docs": scanned("select path, n as n_values from scan where n > 0"),
    "run_summary": scanned(f"select count(*) as files, coalesce(sum(n), 0)::bigint as redacted, count(*) filter (clipped) as with_warnings, (select count(*) from recs where doc_id % 11 = 3) as removed from scan"),
    "leak_gate": scanned("select coalesce(sum(n), 0)::bigint as redacted, coalesce(sum(n), 0) > 0 as failed from scan"),
    "diagnostics": scanned("select path, 0 as ordinal, 'text-clipped' as event, 'text-clipped' as message, true as is_warning from scan where clipped union all select path, case when clipped then 1 else 0 end, 'read', 'Text, ' || len(text) || ' chars', false from scan"),
    "redact_deny": f"with {TEXTS} select doc_id, regexp_replace(text, '(?i){_DENY}', '[REDACTED]', 'g') as text from texts",
    "redact_custom_rule": f"with {TEXTS} select doc_id, regexp_replace(text, '\\bTh[a-z]{{6}}\\b', '[IDENT]', 'g') as text from texts",
    "redact_allow": f"with {TEXTS} select doc_id, replace({v6(simple(f'replace(text, {s(ALLOWED)}, chr(57344))', 'ipv4'), s('[IP]'))}, chr(57344), {s(ALLOWED)}) as text from texts",
    "redact_custom_token": f"with {TEXTS} select doc_id, {simple('text', 'email', '<mail>')} as text from texts",
    "stable_token_email": f"""with {TEXTS} select doc_id, array_to_string(list_transform(string_split(regexp_replace(text, {s('(' + _EMAIL + ')')}, chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)),
 lambda p: case when contains(p, chr(57345)) then '[EMAIL_' || left(sha256('pepper' || chr(0) || split_part(p, chr(57345), 1)), 8) || ']' || split_part(p, chr(57345), 2) else p end), '') as text from texts""",
    "stable_token_join": f"""with {TEXTS}, c as (select distinct doc_id, left(sha256(chr(0) || v), 8) as code from (select doc_id, unnest(regexp_extract_all(text, {s(_EMAIL)})) as v from texts))
 select code, count(*) as n_texts, min(doc_id) as first_doc, max(doc_id) as last_doc from c group by code""",
    "embedding_inputs": f"with {TEXTS} select doc_id, coalesce({simple('case when doc_id % 13 <> 5 then text end', 'email')}, '') as text from texts",
    "source_chunks": f"with {DOCS}, short as (select folder, {simple(f'left({normal(chr(116) + chr(101) + chr(120) + chr(116))}, 20000)', 'email')} as text from recs), {chunk_ctes('short', 'folder', True)} select folder, count(*) as n_chunks, sum(len(text))::bigint as n_chars from chunks group by folder",
}
for _name, _rule in {
    "redact_private_key": "private_key", "redact_jwt": "jwt", "redact_conn": "connection", "redact_email": "email", "redact_iban": "iban", "redact_ssn": "ssn", "redact_mac": "mac",
    "redact_ipv4": "ipv4", "redact_geo": "geo", "redact_dob": "dob", "redact_secret_assignment": "secret_assignment", "redact_long_number": "long_number",
}.items():
    SQL[_name] = f"with {TEXTS} select doc_id, {simple('text', _rule)} as text from texts"
for _name, _who in (("chat_redact_user", "role = 'user'"), ("chat_redact_all", "true")):
    _ctes, _last = engine("start", False, pick="conv_id, turn, role, raw")
    SQL[_name] = f"with {CHATS}, start as (select conv_id, turn, role, text as raw, text as t from chat), {_ctes} select conv_id, turn, role, case when {_who} then {tokens('t')} else raw end as text from {_last}"


def _found(*rows: tuple[str, str, str, str]) -> str:
    return f"select * from (values {values(rows)}) v(name, text, metadata, warnings)"


_CAMERA = "Make=Canon;Model=EOS 5D Mark;Software=v1"
SQL |= {
    "extract_ooxml": _found(("report.docx", "Hello world & all", "Author=Jane;Title=The Title", ""), ("deck.pptx", "one ten two", "", ""), ("book.xlsx", "a b", "", ""), ("empty.docx", "", "", "")),
    "extract_open_document": _found(("letter.odt", "Head one twonested", "Title=T", "")),
    "extract_epub": _found(("novel.epub", "One First & best Second line", "Author=Ann;Title=Book", "")),
    "extract_rtf": _found(("note.rtf", "café a—b end", "", ""), ("code.rtf", "€5 {x}", "", "")),
    "extract_eml": _found(("mail.eml", "café! =ZZ", "From=Jürg <a@b.c>;Subject=Hi there", ""), ("raw.eml", "hello", "Subject=s", "")),
    "extract_msg": "select 'mail.msg' as name, 'line two' || repeat(' long', 900) as text, 'Date=2020-01-01T00:00:00Z;From=Jane <j@x.org>;Subject=Hi é;To=Bob' as metadata, '' as warnings",
    "extract_legacy_office": _found(
        ("old.doc", "Hello närrowwide ☃ x", "Author=Ann;Title=Doc title", ""), ("old.xls", "wïde plain rich inline", "", ""), ("split.xls", "splitü plain rich inline", "", ""),
        ("old.ppt", "Hello there Wörld x", "", ""), ("summary.xls", "", "Title=Tïtle", ""),
    ),
    "extract_exif": _found(("photo.jpg", "", _CAMERA, ""), ("photo.png", "", _CAMERA, ""), ("photo.tif", "", _CAMERA, ""), ("plain.gif", "", "", "")),
    "extract_pdf": _found(*((name, "Hello World againABé", "Author=Me;Pages=2;Title=My (title)", "") for name in ("paper.pdf", "packed.pdf"))),
    "extract_failed": _found(
        ("bad.docx", "", "", "extract-failed: BadZipFile"), ("bad.msg", "", "", "extract-failed: ValueError"), ("bad.pdf", "", "", "extract-failed: ValueError"), ("bad.jpg", "", "", "extract-failed: ValueError"), ("data.bin", "", "", ""),
    ),
    "extract_plain_documents": f"select doc_id || '.md' as name, left({normal('coalesce(text, ' + s('') + ')')}, 20000) as text, case when len({normal('coalesce(text, ' + s('') + ')')}) > 20000 then 'text-clipped' else '' end as warnings from documents",
    "extract_mail_documents": f"select doc_id || '.eml' as name, left({normal('coalesce(text, ' + s('') + ')')}, 20000) as text, 'Subject=café' as metadata, case when len({normal('coalesce(text, ' + s('') + ')')}) > 20000 then 'text-clipped' else '' end as warnings from documents",
    "oversize_documents": f"""select doc_id || case when doc_id % 2 = 0 then '.zip' else '.txt' end as name, case when doc_id % 2 = 1 and strlen(coalesce(text, '')) <= 1000 then {normal('coalesce(text, ' + s('') + ')')} else '' end as text,
 case when doc_id % 2 = 1 and strlen(coalesce(text, '')) > 1000 then 'skipped-content: ' || strlen(text) || ' bytes over limit' else '' end as warnings from documents""",
    "inc_touched": f"with {DOCS} select path, size_bytes from recs where doc_id % 7 = 0 or doc_id % 4 = 1",
    "redact_metadata": f"with {DOCS} select path, 'mail [EMAIL] now' as text, '[EMAIL]' as author, case when doc_id % 2 = 0 then 'no value' else 'call [SSN]' end as title, case when doc_id % 2 = 0 then 'Email=2' else 'Email=2;SSN=1' end as counts from recs",
    "mask_engine_last4": f"""with {TEXTS} select doc_id, array_to_string(list_transform(string_split(regexp_replace(text, {s('(' + _EMAIL + ')')}, chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)),
 lambda p: case when contains(p, chr(57345)) then regexp_replace(regexp_extract(split_part(p, chr(57345), 1), '^(.*?)((?:[A-Za-z0-9][^A-Za-z0-9]*){{4}})$', 1), '[A-Za-z0-9]', '*', 'g')
   || regexp_extract(split_part(p, chr(57345), 1), '^(.*?)((?:[A-Za-z0-9][^A-Za-z0-9]*){{4}})$', 2) || split_part(p, chr(57345), 2) else p end), '') as text from texts""",
    "first_by_path": f"with {DOCS} select path, size_bytes from recs order by path limit 100",
}
