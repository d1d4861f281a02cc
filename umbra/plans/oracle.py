"""DuckDB SQL for the queries, written apart from the expressions that it checks."""

from __future__ import annotations

from .. import lexicons as L
from .queries import ADDRESSES, MEMO, NAME_PAIRS, NAMES, RANGES, TERMS, WORDS

_q = lambda s: "'" + s.replace("'", "''") + "'"
_filled = lambda rows, n: f"(select c_custkey as i, replace((['" + "', '".join(r.replace("'", "''") for r in rows) + f"'])[c_custkey % {len(rows)} + 1], '{{n}}', {n}) as x from customer)"
_in = lambda rows: "(" + ", ".join(map(_q, rows)) + ")"
_M = f"(select c_custkey as doc_id, {MEMO.format(s='varchar')} as text from customer)"
_corpus = f"(select doc_id, text from documents union all select -1 - doc_id, text from {_M})"
_ws = r"[\s\x1c-\x1f]"


def _hits(source: str, pattern: str) -> str:
    """Matches with their offsets: each is looked for behind the end of the one before."""
    return f"""select doc_id, cast(r.at as int) as start, r.m as text from (select doc_id, unnest(list_reduce(regexp_extract_all(text, {_q(pattern)}),
      lambda acc, m: list_append(acc, {{'at': strpos(substr(text, acc[-1].at + length(acc[-1].m) + 1), m) + acc[-1].at + length(acc[-1].m) - 1, 'm': m}}),
      [{{'at': 0::bigint, 'm': ''}}])[2:]) r from {source})"""


_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_D = r"\-\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2212}"
_CORE = rf"(?:\+\d{{1,3}}[ .{_D}]?)?(?:\(\d{{2,4}}\)[ .{_D}]?)?\d{{3,4}}[ .{_D}]\d{{3,4}}"
_PHONES = f"""select doc_id, cast(k.s as int) as start, k.m as text from (select doc_id, unnest(list_reduce(list_filter(list_transform(range(1, length(text) + 1), lambda i:
   case when regexp_matches(substr(text, i, 1), '[+(0-9]') and (i = 1 or not regexp_matches(substr(text, i - 1, 1), '[\\p{{L}}\\p{{N}}\\p{{M}}_{_D}]'))
   then {{'s': i - 1, 'm': regexp_extract(substr(text, i, 40), '^({_CORE})(?:[^0-9]|$)', 1)}} end), lambda x: x is not null and x.m <> ''),
   lambda acc, x: case when x.s >= acc[-1].s + length(acc[-1].m) then list_append(acc, x) else acc end, [{{'s': -1::bigint, 'm': ''}}])[2:]) k from documents)
   where length(regexp_replace(k.m, '[^0-9]', '', 'g')) >= 7 and not {{year}}"""


def _year(x: str) -> str:
    a, b = (f"try_cast(regexp_extract({x}, '^([0-9]{{4}})[ .{_D}]([0-9]{{4}})$', {i}) as int)" for i in (1, 2))
    return f"coalesce({a} between 1900 and 2099 and {b} between 1900 and 2099 and {b} - {a} between 0 and 1, false)"


_streets = "|".join(sorted({*L.STREET_WORDS, "gardens?"}, key=lambda w: (-len(w), w)))
_ADDRESS = rf"(?i)\b\d{{1,4}}[A-Za-z]?\s+[A-Z][A-Za-z'.]*(?:\s+[A-Z][A-Za-z'.]*)*\s+(?:{_streets})\b(?:\s*,?\s*#\d{{1,3}}-\d{{1,5}})?(?:,?\s*Singapore(?:\s+\d{{6}})?)?"
_UEN, _ABN = r"\b(?:\d{9}[A-Za-z]|[A-Za-z]\d{2}[A-Za-z]{2}\d{4}[A-Za-z]|\d{7,8}[A-Za-z])\b", r"\b\d{2}\s\d{3}\s\d{3}\s\d{3}\b"
_squash = lambda x: f"regexp_replace(lower({x}), '{_ws}', '', 'g')"


def _count(v: str) -> str:
    """Whole-word hits of an entity: what bounds a word is doubled, so that neighbours do not share it."""
    words = r"\s*".join(v.split())
    return f"len(regexp_extract_all(regexp_replace(' ' || text || ' ', '([^A-Za-z0-9_])', '\\1\\1', 'g'), '(?i)[^A-Za-z0-9_]{words}[^A-Za-z0-9_]'))"


def _claims() -> str:
    """The memo's candidates by place, folded in the order of the tiers."""
    one = lambda tier, cat, x: f"list_transform(list_filter([{x}], lambda x: x is not null and x <> '' and strpos(text, x) > 0), lambda x: {{'tier': {tier}, 'start': strpos(text, x) - 1, 'end': strpos(text, x) - 1 + length(x), 'text': x, 'category': '{cat}'}})"
    # Every place of the shortest entity, in any case, between word boundaries.
    acme = "list_transform(list_filter(range(1, length(text)), lambda i: lower(substr(text, i, 4)) = 'acme' and not regexp_matches(substr(' ' || text, i, 1), '[A-Za-z0-9_]') and not regexp_matches(substr(text, i + 4, 1), '[A-Za-z0-9_]')), lambda i: {'tier': 0, 'start': i - 1, 'end': i + 3, 'text': substr(text, i, 4), 'category': '=Azure'})"
    parts = [
        one(0, "Client", "case when text like '%Acme Holdings 7 Pte Ltd%' then 'Acme Holdings 7 Pte Ltd' end"), one(0, "Entity", "'Acme Holdings'"), acme, one(1, "Email", f"regexp_extract(text, {_q(_EMAIL)})"),
        one(2, "Phone", r"regexp_extract(text, '\+65 8[0-9]{3}-[0-9]{4}')"), one(3, "UEN", f"regexp_extract(text, {_q(_UEN)})"), one(4, "ABN", f"regexp_extract(text, {_q(_ABN)})"), one(5, "Address", f"regexp_extract(text, {_q(_ADDRESS)})"),
    ]
    cands = " || ".join(f"list_transform({p}, lambda z: cast(z as struct(tier int, start bigint, \"end\" bigint, text varchar, category varchar)))" for p in parts)
    fold = f"""list_reduce({cands}, lambda acc, x: case when len(list_filter(acc, lambda a: a.start < x."end" and a."end" > x.start)) = 0 then list_append(acc, x) else acc end,
      cast([] as struct(tier int, start bigint, "end" bigint, text varchar, category varchar)[]))"""
    return f"""select doc_id, cast(i - 1 as int) as seq, k[i].tier as tier, cast(k[i].start as int) as start, cast(k[i]."end" as int) as "end", k[i].text as text, k[i].category as category
      from (select doc_id, k, unnest(range(1, len(k) + 1)) as i from (select doc_id, {fold} as k from {_M}))"""


def _mod(x: str, m: int) -> str:
    return f"list_reduce(list_transform(range(0, 8), lambda i: ('0x' || substr(md5(lower(trim({x}))), cast(i * 4 + 1 as int), 4))::bigint), lambda a, v: (a * 65536 + v) % {m})"


_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
_n = len(L.FIRST_NAMES)
_first = lambda r: f"{_list(L.FIRST_NAMES)}[cast({r} % {_n} as int) + 1]"
_last = lambda r: f"{_list(L.LAST_NAMES)}[cast({r} // {_n} as int) + 1]"
_letters = """case when n > 702 then chr(cast(65 + ((n - 703) // 676) % 26 as int)) else '' end || case when n > 26 then chr(cast(65 + ((n - 27) // 26) % 26 as int)) else '' end || chr(cast(65 + (n - 1) % 26 as int))"""
_map = lambda d: "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in d.items()) + "}"
_sq = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_COUNTRIES = _map({x.lower(): x for x in L.COUNTRIES} | L.COUNTRY_ALIASES)
_country = lambda x: f"({_COUNTRIES})[regexp_replace(lower({_sq(x)}), '^the\\s+', '')]"
_known = lambda x: f"lower({x}) in {_in([r.lower() for r in L.REGIONS])}"
_region = lambda x: f"case when {_known(_sq(x))} or (len(string_split({_sq(x)}, '/')) > 1 and len(list_filter(string_split({_sq(x)}, '/'), lambda p: not ({_country('p')} is not null or {_known('trim(p)')}))) = 0) then {_sq(x)} end"
_ranged = "select doc_id, seg_no, text, coalesce(sum(length(text) + 1) over (partition by doc_id order by seg_no rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seg_no from documents)"
_word = lambda t, o, p: f"regexp_replace(regexp_replace({t}, '(^|[^A-Za-z0-9_]){o}($|[^A-Za-z0-9_])', '\\1{p}\\2', 'g'), '(^|[^A-Za-z0-9_]){o}($|[^A-Za-z0-9_])', '\\1{p}\\2', 'g')"
_masked = _word(_word(_word(_word("text", "that", "<$1\\\\>"), "the", "Client A"), "que", "Name 1"), "of", "Azure")
_email = _hits("documents", _EMAIL)
_stem = "regexp_replace(name, '\\.[^.]+$', '')"


def _renamed() -> str:
    out = "regexp_replace(x, '\\.[^.]+$', '')"
    for o, p in sorted(NAME_PAIRS, key=lambda x: -len(x[0])):
        for _ in range(2):  # neighbours share what bounds them
            out = f"regexp_replace({out}, '(?i)(^|[^A-Za-z0-9])' || '{o.replace(' ', '[ _-]*')}' || '($|[^A-Za-z0-9])', '\\1{p.replace(' ', '_')}\\2', 'g')"
    return out


_leak = " + ".join(f"({_count(v)} > 0)::int" for v, _ in WORDS)
_spoilt = "translate(text, 'e', chr(1))"

ORACLE = {
    "scan_email": _email,
    "scan_phone": _PHONES.replace("{year}", _year("k.m")),
    "scan_uen": _hits(_corpus, _UEN),
    "scan_abn": _hits(_corpus, _ABN),
    "scan_sg_address": _hits(_corpus, _ADDRESS),
    "scan_known_entities": " union all ".join(f"select doc_id, {_q(c)} as category, {_count(v)}::bigint as n from documents where {_count(v)} > 0" for v, c in WORDS),
    "claims_resolved": _claims(),
    "distinct_items": " union all ".join(f"select doc_id, '{c}' as category, {x} as text from {_M}" for c, x in (("Email", f"regexp_extract(text, {_q(_EMAIL)})"), ("Phone", r"regexp_extract(text, '\+65 8[0-9]{3}-[0-9]{4}')"), ("UEN", f"regexp_extract(text, {_q(_UEN)})"), ("ABN", f"regexp_extract(text, {_q(_ABN)})"), ("Address", f"regexp_extract(text, {_q(_ADDRESS)})"))),
    "placeholders_scrambled": f"""select c_custkey, {_first('r')} || ' ' || {_last('r')} as name, lower(replace({_first('e')}, ' ', '')) || '.' || lower({_last('e')}) || cast(x as varchar) || '@example.com' as email
      from (select c_custkey, {_mod('c_name', _n * len(L.LAST_NAMES))} as r, {_mod("'user' || c_custkey || '@acme.example.com'", _n * len(L.LAST_NAMES))} as e, {_mod("'user' || c_custkey || '@acme.example.com'", 10000)} as x from customer)""",
    "placeholders_lettered": f"select doc_id, category, category || ' ' || {_letters} as placeholder from (select s_suppkey as doc_id, n_name as category, row_number() over (partition by n_name order by s_suppkey) as n from supplier join nation on s_nationkey = n_nationkey)",
    "redact_hash": rf"select doc_id, md5(regexp_replace(text, '[\p{{L}}\p{{N}}]', '#', 'g')) as redacted_md5 from {_corpus}",
    "address_collapse": f"""select i, coalesce({_country('x')}, {_region('x')}, case when n > 1 then coalesce({_country('tail')}, {_region('tail')}, ({_map(L.STATE_COUNTRIES)})[lower(regexp_extract(tail, '[^ ]+$'))]) end,
      case when regexp_matches(x, '(?i)\\bsingapore\\b') then 'Singapore' end, 'Address') as address from (select i, x, len(string_split(x, ',')) as n, trim(regexp_replace(trim(string_split(x, ',')[-1]), '[0-9]{{4,6}}\\s*$', '')) as tail from {_filled(ADDRESSES, "lpad(c_custkey::varchar, 5, '0')")})""",
    "year_range": f"select i, {_year('x')} as is_range, cast(length(regexp_replace(x, '[^0-9]', '', 'g')) as int) as n_digits from {_filled(RANGES, '(1990 + c_custkey % 50)::varchar')}",
    "plausibility_flags": f"""select i, trim(lower(string_split(x, ' ')[-1]), '.,()[]') in {_in(L.BUILDING_WORDS)} as building, trim(lower(x), '.,;:()[]"''') in {_in(L.DEFINED_TERMS)} as defined,
      trim(lower(x), '.,;:()[]') in {_in(L.CORPORATE_SUFFIXES)} as suffix, contains(x, chr(10)) or length(x) > 60 or len(regexp_extract_all(x, '[0-9]+')) >= 3 as implausible from {_filled(TERMS, 'c_custkey::varchar')}""",
    "context_snippet": f"""select doc_id, e as text, (case when pos > 46 then '…' else '' end) || substr(t, greatest(pos - 45, 1), pos - greatest(pos - 45, 1)) || '[[' || e || ']]' || substr(t, pos + length(e), 45)
      || (case when pos + length(e) + 44 < length(t) then '…' else '' end) as context from (select distinct d.doc_id, d.text as t, h.text as e, strpos(d.text, h.text) as pos from documents d join ({_email}) h using (doc_id))""",
    "segment_offsets": f'select doc_id, cast(seg_no as int) as seg_no, start, start + length(text) as "end" from ({_ranged})',
    "sheet_lookup": f"select h.doc_id, h.start, 'line ' || r.seg_no as sheet from ({_email}) h left join ({_ranged}) r on h.doc_id = r.doc_id and h.start >= r.start and h.start < r.start + length(r.text)",
    "mask_text": f"select doc_id, md5({_masked}) as masked_md5 from documents",
    "apply_review": f"""select c_custkey as doc_id, 'Invoice for ' || if(c_nationkey = 7, 'Client A', 'Entity A ' || c_nationkey || ' Pte Ltd') || ' re ' || c_name || ', UEN ##########, ABN ## ### ### ###, tel +## ####-####, mail '
      || if(c_custkey % 2 = 0, 'user' || c_custkey || '@Azure.example.com', {_first('e')} || '.' || {_last('e')} || x || '@example.com') || ', at Singapore. FY 2025-2026.' as masked, true as changed, false as any_grey
      from (select *, {_mod("m", _n * len(L.LAST_NAMES))} as e, {_mod("m", 10000)} as x from (select *, 'user' || c_custkey || '@acme' || c_nationkey || '.example.com' as m from customer))""".replace(_first("e") + " || '.'", f"lower(replace({_first('e')}, ' ', '')) || '.'").replace(_last("e") + " || x", f"lower({_last('e')}) || x"),
    "mapping_log": "select o_orderpriority as original, arg_max(o_orderstatus, (o_custkey, o_orderkey)) as placeholder, arg_min(o_custkey, (o_custkey, o_orderkey)) as first_doc, arg_min(o_orderkey, (o_custkey, o_orderkey)) as first_seq from orders group by 1",
    "review_merge": "select c_custkey as id, case when c_acctbal < 3000 and c_nationkey = 5 then 'X' else c_name end as placeholder, c_acctbal >= 3000 or c_mktsegment <> 'MACHINERY' as include from customer",
    "sanitize_names": f"select i, {_renamed()} || lower(regexp_extract(x, '\\.[^.]+$')) as name from {_filled(NAMES, 'c_custkey::varchar')}",
    "verify_leaks": f"select doc_id, cast({_leak} as int) as n_leaks from documents where {_leak} > 0",
    "verify_clean": f"select doc_id from documents where {_leak} = 0",
    "category_summary": f"""select category, count(*) as n, count(distinct g) as n_groups from (select 'Email' as category, text as g from ({_email}) union all select 'Phone', text from ({{phones}}) union all
      select category, case when tier = 0 then case category when '=Azure' then 'list:acme' when 'Entity' then 'list:acme holdings' else 'list:acme holdings 7 pte ltd' end else text end from ({_claims()})) group by 1""",
    "blob_dedupe": "select doc_id, md5(text) as digest, min(doc_id) over (partition by text) as first_id, count(*) over (partition by text) as n from documents",
    "usable_text": f"select doc_id, length(s) > 0 and length(regexp_replace(x, '[^\\x00-\\x08\\x0E-\\x1B]', '', 'g')) / greatest(length(s), 1) < 0.1 as usable from (select doc_id, {_spoilt} as x, regexp_replace({_spoilt}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]', '', 'g') as s from documents)",
    "usable_documents": "select doc_id, length(s) > 0 and length(regexp_replace(text, '[^\\x00-\\x08\\x0E-\\x1B]', '', 'g')) / greatest(length(s), 1) < 0.1 as usable from (select doc_id, text, regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]', '', 'g') as s from documents)",
    "ocr_lines": """select l_orderkey as block, l_suppkey % 2 as par, cast(l_quantity as int) % 2 as line, string_agg(l_returnflag || cast(l_partkey as varchar), ' ' order by l_linenumber, l_returnflag || cast(l_partkey as varchar)) as text,
      min(l_partkey) * 72 / 200 as x0, min(l_suppkey) * 72 / 200 as y0, max(l_partkey + cast(l_quantity as int)) * 72 / 200 as x1, max(l_suppkey + l_linenumber) * 72 / 200 as y1 from lineitem where cast(l_quantity as int) * 2 >= 40 group by 1, 2, 3""",
    "zip_names": "select o_orderkey, o_custkey || case when n > 1 then ' (' || (n - 1) || ')' else '' end || '.txt' as zip_name from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)",
}
ORACLE["category_summary"] = ORACLE["category_summary"].replace("{phones}", ORACLE["scan_phone"])
