"""DuckDB SQL for the queries of scale.py, written apart from the expressions that it checks."""

from __future__ import annotations

from .. import lexicons as L
from .flow import EXTENSIONS
from .oracle import _claims, _country, _filled, _list, _map, _region
from .queries import ADDRESSES, WORDS

_runs = "regexp_extract_all(text, '[A-Za-z0-9_]+')"
_listed = f"(select distinct lower(w) as w from (select unnest({_runs}) as w from documents where lang = 'en') where regexp_full_match(w, '[A-Za-z]{{5,}}'))"
# Words with their places: every run of word characters, behind the run before it.
_placed = """(select doc_id, lower(w) as w, sum(length(g) + length(w)) over (partition by doc_id order by i) - length(w) as start from
 (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as w, unnest(regexp_split_to_array(text, '[A-Za-z0-9_]+')[1:len(regexp_extract_all(text, '[A-Za-z0-9_]+'))]) as g,
  unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9_]+')))) as i from documents))"""
_stem = "'f' || (o_custkey % 100)"
_name = f"case when o_orderkey % 5 = 0 then {_stem} || ' (' || (o_orderkey % 7) || ').txt' else {_stem} || '.txt' end"
_ext = f"({_list(EXTENSIONS)})[doc_id % {len(EXTENSIONS)} + 1]"
_has = lambda w: f"len(list_filter({_runs}, lambda r: lower(r) = '{w}')) > 0"
_leaks = " + ".join(f"({_has(w)})::int" for w, _ in WORDS)
_tail = "trim(regexp_replace(trim(string_split(x, ',')[-1]), '[0-9]{4,6}\\s*$', ''))"

# Words with what lies before each; runs of capitalised ones a blank apart.
_names = """with t as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) as w, unnest(range(len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')))) as i from documents),
 p as (select *, sum(length(w)) over (partition by doc_id order by i) - length(w) as start, regexp_full_match(w, '[A-Z][a-z]+') as cap from t),
 c as (select *, cap and not coalesce(lag(w, 1) over o = ' ' and lag(cap, 2) over o, false) as new from p window o as (partition by doc_id order by i)),
 r as (select doc_id, w, i, start, sum(new::int) over (partition by doc_id order by i) as run, cap from c),
 n as (select doc_id, min(start) as start, string_agg(w, ' ' order by i) as text, count(*) as k from r where cap group by doc_id, run)
select doc_id, start::int as start, text from n where k > 1 and length(text) <= 60"""

ORACLE = {
    "known_words": f"select d.doc_id, count(distinct l.w)::int as n_leaks, count(l.w) = 0 as clean from documents d left join {_placed} p using (doc_id) left join {_listed} l on l.w = p.w group by 1",
    "known_word_claims": f"select doc_id, if(length(w) % 2 = 0, 'Entity', 'Client') as category, count(*) as n, min(start)::int as first, count(distinct w) as n_words from {_placed} join {_listed} using (w) group by 1, 2",
    "item_ids_hashed": "select row_number() over (order by md5(o_custkey::varchar), o_orderkey) - 1 as id, md5(o_custkey::varchar) as file, o_orderkey as seq from orders",
    "item_ids_alike": "select row_number() over (order by file, seq) - 1 as id, file, seq from (select 'https://example.org/in/' || if(o_orderkey % 3 = 0, '', o_custkey::varchar) as file, o_orderkey as seq from orders)",
    "folder_names": f"""with f as (select o_orderkey, {_name} as name, row_number() over (partition by {_name} order by o_orderkey) - 1 as j from orders),
      t as (select regexp_extract(name, '^(.*) \\(([1-9][0-9]*)\\)\\.txt$', 1) as stem, list(regexp_extract(name, '^(.*) \\(([1-9][0-9]*)\\)\\.txt$', 2)::bigint) as taken from (select distinct name from f) where regexp_matches(name, '^.* \\([1-9][0-9]*\\)\\.txt$') group by 1)
      select o_orderkey, case when j = 0 then name else replace(name, '.txt', '') || ' (' || list_filter(range(1, j + 1 + coalesce(len(taken), 0)), lambda x: not coalesce(list_contains(taken, x), false))[j] || ').txt' end as folder_name
      from f left join t on t.stem = replace(name, '.txt', '')""",
    "verify_files": f"""select doc_id as file_index, case when doc_id % 6 >= 4 then 'skipped' when reason is not null then 'unread' when n > 0 then 'leak' else 'clean' end as verdict, case when reason is null then n else 0 end as n_leaks, reason from
      (select doc_id, ({_leaks})::int as n, case when doc_id % 6 >= 4 then 'unsupported file type ' || lower({_ext}) when doc_id % 6 = 3 then 'can''t be read: there is no reader for PDF files' when doc_id % 11 = 0 then 'can''t be read: BadZipFile: no zip' end as reason from documents)""",
    "sql_addresses": f"""select i, {_country('x')} as country, {_region('x')} as region, coalesce({_country('x')}, {_region('x')}, case when len(string_split(x, ',')) > 1 then coalesce({_country(_tail)}, {_region(_tail)}, ({_map(L.STATE_COUNTRIES)})[lower(regexp_extract({_tail}, '[^ ]+$'))]) end,
      case when regexp_matches(x, '(?i)\\bsingapore\\b') then 'Singapore' end, 'Address') as address from {_filled(ADDRESSES, "lpad(c_custkey::varchar, 5, '0')")}""",
    "sql_scan": _claims(),
    "tagged_documents": _names,
    # A word that is listed goes wherever it stands whole, so each run of word characters is looked up by itself.
    "mask_many": f"""with m as (select map_from_entries(list((w, '<' || upper(w) || '>'))) as m from (select distinct w from (select unnest({_runs}) as w from benchmark) where regexp_full_match(w, '[a-z]{{4,}}'))),
      t as (select doc_id, text, {_runs} as ws, regexp_split_to_array(text, '[A-Za-z0-9_]+') as gs from documents)
      select doc_id, md5(array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || coalesce(m[ws[i]], ws[i], '')), '')) as digest, len(list_filter(ws, lambda w: m[w] is not null)) > 0 as changed from t, m""",
}
