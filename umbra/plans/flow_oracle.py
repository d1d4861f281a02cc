"""DuckDB SQL for the queries of flow.py, written apart from the expressions that it checks."""

from __future__ import annotations

from .. import lexicons as L
from .flow import EXTENSIONS, FONTS
from .oracle import _count, _first, _in, _last, _letters, _list, _mod, _n, _q, _word
from .queries import WORDS

_FREE = "coalesce(len(list_filter(acc, lambda a: a.s < x.e and a.e > x.s)), 0) = 0"
_items = "(select o_custkey as file_index, o_orderkey as seq, o_orderpriority as text, o_orderstatus as placeholder, o_totalprice >= 100000 as include, if(o_orderstatus = 'F', 'Address', 'Client') as category from orders)"
_slots = "(select o_custkey as file_index, 'word/media/' || lpad(o_orderkey::varchar, 9, '0') || if(o_orderkey % 3 = 0, '.JPG', '.png') as id, md5(o_orderpriority) as digest, o_orderstatus as status, o_totalprice as price from orders)"
_usable = lambda x: f"(length({x}) > 0 and length(regexp_replace({x}, '[^\\x00-\\x08\\x0E-\\x1B]', '', 'g')) / greatest(length({x}), 1) < 0.1)"
_leak = " + ".join(f"({_count(v)} > 0)::int" for v, _ in WORDS)
_lines = "(select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seg_no from documents)"
_line_masked = _word(_word(_word("text", "that", "<$1\\\\>"), "the", "Client A"), "of", "Address")
_cells = "(select o_custkey as file_index, o_orderkey as seg_no, 'Sheet ' || (o_orderkey // 3000) as sheet, o_orderpriority || chr(10) || o_orderkey as text from orders where o_orderstatus <> 'P' and o_orderkey % 7 <> 0)"
_placed = f"(select *, coalesce(sum(length(text) + 1) over (partition by file_index order by seg_no rows between unbounded preceding and 1 preceding), 0) as start from {_cells})"
_box = "struct_pack(id := o_orderkey, x0 := (o_orderkey * 7 % 60)::double, y0 := (o_orderkey * 13 % 60)::double, x1 := (o_orderkey * 7 % 60 + 5 + o_orderkey % 30)::double, y1 := (o_orderkey * 13 % 60 + 1 + o_orderkey % 9)::double)"
_boxes = f"(select o_custkey as page, o_orderkey as id, {_box} as b, o_orderpriority as text, o_orderstatus as status from orders)"
_area = "greatest(least(r.b.x1, s.b.x1) - greatest(r.b.x0, s.b.x0), 0) * greatest(least(r.b.y1, s.b.y1) - greatest(r.b.y0, s.b.y0), 0)"
# A box less 0.75 on each side, or whole where nothing is left (all are at least 5 wide).
_thin = "x.y1 - x.y0 <= 1.5"
_low = lambda side: f"if({_thin}, x.{side}0, x.{side}0 + 0.75)"
_high = lambda side: f"if({_thin}, x.{side}1, x.{side}1 - 0.75)"
_kept = f"len(list_filter(acc, lambda k: least({_high('x')}, k.x1) > greatest({_low('x')}, k.x0) and least({_high('y')}, k.y1) > greatest({_low('y')}, k.y0))) = 0"


def _any(t: str, words: str, mark: str, edge: str) -> str:
    """Whole words in any case, twice, since neighbours share what lies between them."""
    one = lambda x: f"regexp_replace({x}, '(?i)(^|[^{edge}])(?:{words})($|[^{edge}])', '\\1{mark}\\2', 'g')"
    return one(one(t))


_U = r"\p{L}\p{N}"
_gap = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]"
_marks = _any(_any(_any(_any("text", f"of{_gap}+the", "\x01", _U), "the", "\x02", _U), f"de{_gap}+la", "\x03", _U), "la", "\x04", _U)
_unmarked = "replace(replace(replace(replace(m, '\x01', '<1>'), '\x02', 'Of The'), '\x03', '\\2$'), '\x04', '3')"
_A = "A-Za-z0-9_"
_recognised = _any(_any(_any("text", f"of{_gap}*the", "$1", _A), "the", "Of", _A), f"de{_gap}*la", "2", _A)


def _tagged(only: bool) -> str:
    n = "(100 + s_suppkey % 900)"
    k = "s_suppkey % 3"
    rows = [(0, 0, "Address", 3, f"{n} || ' Raffles Place , Singapore 048' || {n}"), (1, 0, "Address", 0, f"{n} || ' The Esplanade , Perth WA 6000'"), (1, 1, "Location", 40, "'Manulife Tower'"),
            (2, 0, "Address", 0, "'Jalan Besar'"), (2, 1, "Address", 16, f"'Singapore 048' || {n}"), (2, 2, "Location", 59, "'Sentosa'")]
    if not only:
        rows += [(0, 1, "Individual", 47, "'Jane Tan'"), (0, 2, "Entity", 59, "'Acme Ltd'")]
    return " union all ".join(f"select s_suppkey as doc_id, {str(only).lower()} as address_only, {i} as seq, '{c}' as category, {at} as start, {t} as text from supplier where {k} = {kind}" for kind, i, c, at, t in rows)


_value = "case when s_nationkey % 5 = 0 then '' when s_nationkey % 3 = 0 then s_name || ', \"Ltd\"' when s_nationkey % 2 = 0 then s_name else substr(s_name, 1, 14) end"
_category = "case when s_nationkey % 3 <> 0 and s_nationkey % 2 = 0 then 'Client' else 'Entity' end"
_c = "case o_orderkey % 5 when 0 then '= ' || o_orderpriority || ' ' when 1 then 'Name ' || o_custkey || ' ' when 2 then 'Location' when 3 then 'Address' else o_orderpriority end"
_ext = f"({_list(EXTENSIONS)})[o_orderkey % {len(EXTENSIONS)} + 1]"
_font = f"lower(({_list(FONTS)})[p_partkey % {len(FONTS)} + 1])"
_words_of = lambda t: f"list_sort(list_filter([{', '.join(t)}], lambda x: x is not null))"
_supplier_text = "'From ' || s_name || ' & <Co>' || chr(10) || {mid} || chr(10) || {last}"
_office = lambda name: f"case s_suppkey % 3 when 0 then 'From ' || {name} || ' & <Co>' || chr(10) || 'To ' || {name} || ' & <Co>' || chr(10) || 'For ' || {name} || ' & <Co>' else 'From ' || {name} || ' & <Co>' || chr(10) || 'For ' || {name} || ' & <Co>' || chr(10) || 'To ' || {name} || ' & <Co>' end"
_new = "if(s_suppkey % 10 <> 1, '$' || s_nationkey || '\\ X', s_name)"

ORACLE = {
    "entity_list": f"select row_number() over (order by -length(v), k) as place, v as value, c as category from (select s_suppkey as k, {_value} as v, {_category} as c from supplier) where v <> ''",
    "long_entity_list": "select c_custkey as doc_id, (i - 1)::int as seq, (case i when 1 then 5 + length(c_name) + 5 else 5 + length(c_name) + 5 + length(c_name) + 5 end)::int as start, if(i = 1, lower(c_name), c_name) as text, c_mktsegment as category from customer, (values (1), (2)) t(i)",
    "upload_list": f"select o_orderkey as file_index, 'file.' || o_orderkey || {_ext} as file_name, case when {_ext} = '' then '.' || o_orderkey else lower({_ext}) end as extension, case when o_orderkey % 6 >= 4 then 'unsupported file type ' || case when {_ext} = '' then '.' || o_orderkey else lower({_ext}) end when o_orderstatus <> 'O' then 'no extractable text found' end as skip_reason from orders",
    "page_routing": f"""select doc_id, case when ok then 'native' when lang = 'en' and length(solid) > 0 then 'ocr' else 'none' end as route, md5(case when ok then native when lang = 'en' and length(solid) > 0 then 'seen: ' || text end) as digest
      from (select *, {_usable('solid')} as ok from (select doc_id, lang, text, translate(text, 'eo', chr(1) || chr(2)) as native, regexp_replace(translate(text, 'eo', chr(1) || chr(2)), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]', '', 'g') as solid from documents))""",
    "ocr_languages": "select n_nationkey, case when n_nationkey <= 2 then 'eng' when n_nationkey % 2 = 0 then list_aggregate(list_sort([lower(n_name), lower(r_name)]), 'string_agg', '+') else lower(n_name) end as languages from nation join region on n_regionkey = r_regionkey",
    "fonts": f"""select p_partkey, case when regexp_matches(f, 'times|serif|georgia|garamond') then 'ti' when regexp_matches(f, 'courier|mono|consolas') then 'co' else 'he' end
      || case when b and i then 'bi' when b then 'bo' when i then 'it' when regexp_matches(f, 'times|serif|georgia|garamond') then 'ro' when regexp_matches(f, 'courier|mono|consolas') then 'ur' else 'lv' end as code,
      case when needed > available and available > 0 then greatest(5.0::double, size * available / needed) else size end as fitted, greatest(6.0::double, least(11.0::double, size * 0.7::double)) as guessed, greatest(5.0::double, least(14.0::double, size * 0.75::double)) as line
      from (select *, contains(f, 'bold') or (p_size & 16) > 0 as b, contains(f, 'italic') or contains(f, 'oblique') or (p_size & 2) > 0 as i from (select p_partkey, {_font} as f, p_size, p_size::double as size, (p_partkey % 40)::double as available, (p_partkey % 70)::double as needed from part))""",
    "image_manifest": f"select file_index, digest, min(id) as id, string_agg(id, ',' order by id) as all_ids, count(*) as count from {_slots} group by 1, 2",
    "flagged_images": f"""select s.file_index, s.id, if(f.status = 'F', 'replace', 'blank') as action, if(s.id like '%.JPG', 'JPEG', 'PNG') as format from {_slots} s
      join (select file_index, digest, min(id) as id from {_slots} group by 1, 2) m on s.file_index = m.file_index and s.digest = m.digest join {_slots} f on f.file_index = m.file_index and f.id = m.id where f.price > 200000""",
    "item_ids": "select row_number() over (order by o_custkey, o_orderkey) - 1 as id, o_custkey as file_index, o_orderkey as seq from orders",
    "review_totals": f"""with t as (select file_index, count(distinct text) as i, 0 as m from {_items} where (file_index % 2 = 1 or include) and include group by 1 union all select file_index, 0, count(*) from {_slots} where status = 'F' group by 1)
      select sum(i)::bigint as n_items, sum(m)::bigint as n_images, count(distinct file_index) as n_files from t""",
    "review_round_trip": "select s_suppkey as id, s_suppkey as file_index, s_name || '.docx' as file_name, s_name || ' \"é' || chr(10) || '\"' as text, s_name as placeholder, '[[' || s_name || ']]' as context, s_acctbal > 0 as include, if(s_nationkey = 3, 'Sheet 1', null) as sheet from supplier",
    "mapping_json": f"""select '[' || string_agg('{{"original":"' || text || '","placeholder":"' || p || '"}}', ',' order by first_at) || ']' as value from
      (select text || ' ' || placeholder as text, arg_max(placeholder, (file_index, seq)) as p, min((file_index, seq)) as first_at from {_items} group by 1)""",
    "mapping_pairs": f"""select file_index, string_agg(text || '>' || p || if(c = 'Address' and p = 'Address', '!', ''), '|' order by -length(text), s) as pairs from
      (select file_index, text, arg_max(if(category = 'Address', 'Address', placeholder), seq) as p, arg_max(category, seq) as c, min(seq) as s from {_items} where include group by 1, 2) group by 1""",
    "verify_report": f"select doc_id, cast({_leak} as int) as n_leaks, {_leak} = 0 as clean, bool_or({_leak} > 0) over () as any_leak from documents",
    "category_flags": rf"select o_orderkey, c like '=%' or regexp_matches(c, '[0-9]\s*$') as numbered, if(c like '=%', trim(substr(c, 2)), c) as literal, o_orderkey % 5 in (2, 3) and o_orderstatus = 'F' as grey from (select *, {_c} as c from orders)",
    "category_order": f"select (row_number() over (order by p, c) - 1)::int as place, c as category from (select i as p, x as c from (values {', '.join(f'({i}, {_q(x)})' for i, x in enumerate(L.CATEGORY_ORDER))}) t(i, x) union all select 99, n_name from nation)",
    "longest_spans": f"""select o_custkey, list_aggregate(list_transform(list_sort(list_transform(k, lambda x: struct_pack(s := x.s, e := x.e))), lambda x: x.s || '-' || x.e), 'string_agg', ',') as kept from
      (select o_custkey, list_reduce(list({{'s': o_orderkey * 7 % 60, 'e': o_orderkey * 7 % 60 + 1 + o_orderkey % 9}} order by -(1 + o_orderkey % 9), o_orderkey * 7 % 60), lambda acc, x: case when {_FREE} then list_append(acc, x) else acc end, cast([] as struct(s bigint, e bigint)[])) as k from orders group by 1)""",
    "text_chunks": "select doc_id, (i * 1000)::int as \"offset\", md5(substr(text, i * 1000 + 1, 1000)) as digest from (select doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) as i from documents)",
    "tagged_places": f"{_tagged(True)} union all {_tagged(False)}",
    "tagged_items": f"select doc_id, category, text, 'ner' as source from ({_tagged(True)}) where doc_id % 3 <> 0 union all select s_suppkey, 'Client', 'Raffles Place', 'list' from supplier where s_suppkey % 3 = 0",
    "claimed_boxes": f"select page, list_aggregate(list_transform(k, lambda x: x.id::varchar), 'string_agg', ',') as kept from (select page, list_reduce(list(b order by id), lambda acc, x: case when {_kept} then list_append(acc, x) else acc end, cast([] as struct(id bigint, x0 double, y0 double, x1 double, y1 double)[])) as k from {_boxes} group by 1)",
    "best_spans": f"select r.page, r.id as rect_id, arg_max(s.id, ({_area}, -s.id)) as span_id from {_boxes} r join {_boxes} s on r.page = s.page and r.status = 'F' and s.status <> 'F' where {_area} > 0 group by 1, 2",
    "rect_words": f"""select page, rect_id, original, t <> '' and i > 0 and not regexp_matches(if(i > 1, substr(w, i - 1, 1), ''), '[\\p{{L}}\\p{{N}}]') and not regexp_matches(substr(w, i + length(t), 1), '[\\p{{L}}\\p{{N}}]') as whole from
      (select *, lower(trim(original)) as t, strpos(w, lower(trim(original))) as i from (select r.page, r.id as rect_id, substr(r.text, 1, 3 + (r.id % 9)::int) as original, lower(coalesce(string_agg(s.text, ' ' order by s.id % 2, s.id) filter ({_area} > 0), '')) as w
      from {_boxes} r join {_boxes} s on r.page = s.page where r.status = 'F' group by 1, 2, 3))""",
    "sheet_texts": f"select file_index, md5(string_agg(text, chr(10) order by seg_no)) as digest from {_cells} group by 1",
    "sheet_ranges": f"select file_index, sheet, greatest(arg_min(start, seg_no) - 1, 0)::bigint as start, max(start + length(text))::bigint as \"end\" from {_placed} group by 1, 2",
    "segment_masks": f"select doc_id, cast(seg_no as int) as seg_no, md5(m) as digest, regexp_matches(text, '(^|[^A-Za-z0-9_])of($|[^A-Za-z0-9_])') as any_grey from (select *, {_line_masked} as m from {_lines}) where m <> text",
    "mask_any_case": f"select doc_id, md5({_unmarked}) as digest, length(regexp_replace(m, '[^\\x01-\\x04]', '', 'g'))::int as n from (select doc_id, {_marks} as m from documents)",
    "mask_lines": f"select doc_id, md5({_recognised}) as digest from documents",
    "office_texts": f"select s_suppkey as file_index, {_office('s_name')} as text from supplier",
    "office_masked": f"""select s_suppkey as file_index, if(s_suppkey % 10 <> 1, '$' || s_nationkey || '\\_X', s_name) || ' list' || (['.docx', '.xlsx', '.pptx'])[s_suppkey % 3 + 1] as file_name, (s_suppkey % 10 <> 1)::int as n_items, if(s_suppkey % 2 = 0, 2, 0) as n_images,
      null::varchar as error, text from (select *, {_office('nm')} as text from (select *, {_new} as nm from supplier)) where s_suppkey % 10 <> 1 or s_suppkey % 2 = 0""",
    "sql_functions": f"""select c_custkey, {_first('r')} || ' ' || {_last('r')} as name, lower(replace({_first('r')}, ' ', '')) || '.' || lower({_last('r')}) || cast(x as varchar) || '@example.com' as email, regexp_replace(c_name, '[\\p{{L}}\\p{{N}}]', '#', 'g') as tags,
      9 as digits, {_letters} as letters, true as numbered, c_name as literal, c_nationkey > 9 as grey, '.txt' as ext, 'Email' as category, 8 as start, 'c' || c_custkey || '@example.org' as text
      from (select *, c_custkey + 1 as n, {_mod('c_name', _n * len(L.LAST_NAMES))} as r, {_mod('c_name', 10000)} as x from customer)""",
}
