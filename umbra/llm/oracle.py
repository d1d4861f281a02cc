"""DuckDB SQL for the queries that SQL can express on whole tables, written apart from the expressions that it checks."""

from __future__ import annotations

from . import fingerprints as fp
from . import quality as q
from .chat import Template

_s = lambda x: "'" + x.replace("'", "''") + "'"
#: A word, and white space, in the dialect of the patterns here.
_W, _B = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def _tree(text: str) -> str:
    """Hashes of leaves by section and paragraph."""
    leaf = f"list_transform(regexp_extract_all(p, {_s(fp.LEAF)}), lambda l: substr(md5(l), 1, 16))"
    section = fp.SECTION.replace(r"\z", "$")
    return f"list_transform(regexp_extract_all({text}, {_s(section)}), lambda s: list_transform(regexp_extract_all(s, {_s(fp.PARAGRAPH)}), lambda p: {leaf}))"


_node = lambda x: f"substr(md5(array_to_string({x}, '')), 1, 16)"
_paragraphs = lambda s: f"list_transform({s}, lambda p: {_node('p')})"


def _print(tree: str) -> str:
    leaves = f"flatten(flatten({tree}))"
    root = f"md5(array_to_string(list_transform({tree}, lambda s: {_node(_paragraphs('s'))}), ''))"
    d = f"list_sort(list_distinct(list_transform({leaves}, lambda x: substr(x, 1, 8))))"
    return f"{root} || ':' || len({leaves}) || ':' || len({d}) || ':' || array_to_string(({d})[1:{fp.SKETCH}], '')"


def _near(a: str, b: str) -> str:
    part = lambda x, i: f"split_part({x}, ':', {i})"
    n, m, d, e = (f"{part(x, i)}::bigint" for i in (2, 3) for x in (a, b))
    u, v = (f"regexp_extract_all({part(x, 4)}, '.{{8}}')" for x in (a, b))
    every = f"list_sort(list_distinct({u} || {v}))"
    some = f"(case when {d} <= {fp.SKETCH} and {e} <= {fp.SKETCH} then {every} else ({every})[1:{fp.SKETCH}] end)"
    j = f"(len(list_intersect({some}, list_intersect({u}, {v}))) / len({some}))"
    return f"case when {part(a, 1)} = {part(b, 1)} then 1.0::double when {n} = 0 or {m} = 0 then 0.0::double else (2.0::double * {j} / (1.0::double + {j})) * (least({n} / {d}, {m} / {e}) / greatest({n} / {d}, {m} / {e})) end"


_every = lambda t: f"flatten(list_transform({t}, lambda s: {_paragraphs('s')}))"
OP10 = f"""with base as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
  followed as (select *, coalesce(lead(text) over w, first_value(text) over w) as next_text from base window w as (order by doc_id, text rows between unbounded preceding and unbounded following)),
  edited as (select *, substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) as edited from followed),
  trees as (select *, {_tree('text')} as t, {_tree('next_text')} as u, {_tree('edited')} as v from edited),
  prints as (select *, {_print('t')} as a, {_print('u')} as b, {_print('v')} as c from trees)
  select doc_id, n as n_chars, sha256(edited) as edited_sha256, a as fingerprint, c as edited_fingerprint, {_near('a', 'c')} as near_edited, {_near('a', 'b')} as near_next,
    len(list_filter(list_distinct({_every('v')}), lambda x: not list_contains({_every('t')}, x)))::bigint as n_edited_paragraphs from prints"""


def _windows(width: int) -> str:
    """doc_id, i, w and g: every word, and the text of the window of `width` words that begins with it, null where there is none."""
    return f"""(select doc_id, i, w, case when count(*) over s = {width} then string_agg(w, ' ') over s end as g from
      (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_W}')) as w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_W}'), 1) as i from documents)
      window s as (partition by doc_id order by i rows between current row and {width - 1} following))"""


OP6 = f"""with w as {_windows(20)}, again as (select *, coalesce(g is not null and row_number() over (partition by g order by doc_id, i) > 1, false) as later from w),
  gone as (select doc_id, i, w, bool_or(later) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from again),
  kept as (select doc_id, count(*) as n, count(*) filter (gone) as r, string_agg(w, ' ' order by i) filter (not gone) as t from gone group by 1)
  select d.doc_id, coalesce(n, 0) as n_words, coalesce(r, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from documents d left join kept k on d.doc_id = k.doc_id"""

OP2 = f"""with every as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as p from documents),
  own as (select doc_id, line, row_number() over (partition by doc_id order by min(p)) - 1 as i from every where regexp_matches(line, '{_W}') group by 1, 2),
  class as (select line, min(struct_pack(doc_id := doc_id, i := i)) as spot, row_number() over () as id from own group by 1),
  token as (select distinct id, unnest(regexp_extract_all(line, '{_W}')) as w from class),
  sized as (select id, count(*) as n from token group by 1),
  rare as (select t.id, t.w, s.n, row_number() over (partition by t.id order by f.c, t.w) as r from token t join (select w, count(*) as c from token group by 1) f on t.w = f.w join sized s on t.id = s.id),
  head as (select h.id, w, n, c.spot from rare h join class c on h.id = c.id where r <= n - (4 * n + 4) // 5 + 1),
  pair as (select distinct a.id as x, b.id as y, a.n as n, b.n as m from head a join head b on a.w = b.w and a.spot < b.spot and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
  near as (select distinct y from (select x, y, n, m, count(*) as s from pair join token t on t.id = x join token u on u.id = y and u.w = t.w group by 1, 2, 3, 4) where 5 * s >= 4 * (n + m - s)),
  kept as (select spot.doc_id as doc_id, spot.i as i from class where id not in (select y from near))
  select d.doc_id, coalesce(n, 0) as n_lines, coalesce(n, 0) - coalesce(k, 0) as n_removed, coalesce(l, '') as kept_lines from documents d
  left join (select doc_id, count(*) as n from own group by 1) o on d.doc_id = o.doc_id left join (select doc_id, count(*) as k, string_agg(i::varchar, ',' order by i) as l from kept group by 1) z on d.doc_id = z.doc_id"""

_t = Template()
_heads = "[" + "".join(sorted({"\\" + c[0] if c[0] in "[]^" else c[0] for c in _t.controls})) + "]"
_rests = "|".join(sorted({"".join("\\" + c if c in "[]()|/." else c for c in x[1:]) for x in _t.controls})).replace("\\/", "/")
_long = lambda x: f"(length({x}) + len(regexp_extract_all({x}, {_s(_heads + chr(92) * 2 + '*(?:' + _rests + ')')})))"
_marks = "case role " + " ".join(f"when {_s(r)} then {len(m.open) + len(m.close)}" for r, m in _t.turns.items()) + f" else {len(_t.role) + len(_t.named) + len(_t.role_close)} + {_long('role')} end"
_moves = "case s || ' ' || r " + " ".join(f"when {_s(f'{a} {b}')} then {_s(b)}" for a, bs in _t.moves.items() for b in bs) + " else '' end"
_loss = ", ".join(_s(r) for r, m in _t.turns.items() if m.loss)
OP3 = f"""with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, i, x, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) t(i, x)),
  made as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns, coalesce(string_agg(text, '' order by turn, role, text) filter (role in ({_loss})), '') as loss,
    sum({_long('text')} + {_marks})::bigint as formatted_chars, list(role order by turn, role, text) as roles from rows group by 1)
  select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, list_reduce([{_s(_t.start)}] || roles, lambda s, r: {_moves}) in ({', '.join(map(_s, _t.ends))}) as valid from made"""


def _left(i: int) -> str:
    """What is left of the text when the first i classes of characters are taken out."""
    out = "text"
    for _, pattern in q._STEPS[:i]:
        out = f"regexp_replace({out}, {_s(pattern)}, '', 'g')"
    return out


_n = len(q._STEPS)
_js = lambda p, r: f"sqrt(greatest(0.0::double, list_sum(list_transform(list_zip({p}, {r}), lambda z: (case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0.0 end) + (case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0.0 end))) / 2))"
_rest = lambda x: f"({x} || [greatest(0.0::double, 1.0::double - coalesce(list_sum({x}), 0.0))])"
_own_words = "list_transform(top, lambda x: coalesce(len(list_filter(ws, lambda y: y = x.w)), 0) / greatest(n_words, 1)::double)"
_pad = lambda x: f"list_resize(coalesce({x}, []::double[]), {q.COMMON}, 0.0::double)"
OP1 = f"""with own as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents),
  word as (select lang, w, count(*) as n from (select lang, unnest(string_split_regex(text, '{_B}+')) as w from own) where regexp_matches(w, '^[\\p{{L}}\\p{{M}}]+$') group by 1, 2),
  tops as (select lang, list(struct_pack(w := w, n := n) order by r) as top from (select *, row_number() over (partition by lang order by n desc, w) as r from word) where r <= {q.COMMON} group by 1),
  five as {_windows(5)}, twice as (select *, g is not null and count(*) over (partition by doc_id, g) > 1 as again from five),
  covered as (select doc_id, count(*) filter (c) as n from (select doc_id, bool_or(again) over (partition by doc_id order by i rows between 4 preceding and current row) as c from twice) group by 1),
  counted as (select doc_id, own.lang, regexp_extract_all(text, '{_W}') as ws, len(regexp_extract_all(text, '{_W}')) as n_words, length(text) as n_chars, [{', '.join(f'length({_left(i)}) - length({_left(i + 1)})' for i in range(_n))}, length({_left(_n)})] as classes,
    length(text) - length(regexp_replace(text, '{_B}+', '', 'g')) as n_space, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) as ls, coalesce(c.n, 0) as n_repeat_words, top from own left join covered c using (doc_id) left join tops on own.lang = tops.lang),
  refs as (select lang, list_transform([{', '.join(f'sum(classes[{i + 1}])' for i in range(_n + 1))}], lambda x: x / greatest(sum(n_chars), 1)::double) as cs, any_value(list_transform(top, lambda x: x.n::double)) as ns, greatest(sum(n_words), 1)::double as total from counted group by 1),
  judged as (select c.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    case when n_chars >= {q.LEAST_CHARS} then {_js('list_transform(classes, lambda x: x / greatest(n_chars, 1)::double)', 'cs')} end as cd,
    case when n_words >= {q.LEAST_WORDS} then {_js(_rest(_pad(_own_words)), _rest(_pad('list_transform(ns, lambda x: x / total)')))} end as wd from counted c join refs r on c.lang = r.lang)
  select doc_id, n_words, n_chars - n_space as word_chars, n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, n_repeat_words, base_failed, round(cd, 6) as class_distance, round(wd, 6) as word_distance,
    not base_failed and coalesce(cd, 0) <= {q.CLASS_DISTANCE} and coalesce(wd, 0) <= {q.WORD_DISTANCE} as kept from judged"""

def _lloyd(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Every distance of every round, without bounds."""
    steps = [
        """kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"parted as materialized (select vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] as x from kept, unnest(range({parts})) as u(p))",
        f"seeds as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < {entries})",
        "book0 as materialized (select p, e, x as c from parted join seeds using (vec_id))",
    ]
    for r in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        steps.append(f"near{r} as materialized (select vec_id, p, any_value(x) as x, min({d}) as d, arg_min(e, {d} * {entries} + e) as e from parted join book{r} using (p) group by vec_id, p)")
        if r < rounds:
            mean = f"select p, e, i, floor(sum(y)::double / count(*))::bigint as y from (select p, e, unnest(x) as y, unnest(range(len(x))) as i from near{r}) group by p, e, i"
            steps.append(f"book{r + 1} as materialized (select b.p, b.e, coalesce(m.c, b.c) as c from book{r} b left join (select p, e, list(y order by i) as c from ({mean}) group by p, e) m on b.p = m.p and b.e = m.e)")
    return f"""with {", ".join(steps)},
 coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near{rounds} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
 (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from book{rounds}) as codebooks_sha256 from coded join kept using (vec_id)"""


OP13 = """with given as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings),
 own as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from given
 where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 scored as materialized (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
 from own a join own b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
 positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same
 qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by n.score desc, n.vec_id)::int as rank, n.vec_id as negative_id, positive_score, n.score as negative_score
 from positives join scored n using (anchor_id) where not n.same and 30 * positive_score <= 100 * n.score and 100 * n.score <= 90 * positive_score
 qualify rank <= 10"""

OP5 = """with d as materialized (select doc_id, encode(coalesce(text, '')) as b from documents),
 w as materialized (select doc_id, i, b[i:i + 99] as g from d, unnest(range(1, octet_length(b) - 98)) as u(i) where octet_length(b) >= 100),
 again as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from w) where r > 1),
 cut as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) as new from again),
 run as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as r from cut),
 gone as (select doc_id, r, min(i) as lo, max(i) + 99 as hi from run group by doc_id, r),
 kept as (select doc_id, coalesce(lag(hi) over (partition by doc_id order by r), 0) as from_, lo, hi, row_number() over (partition by doc_id order by r desc) as last from gone),
 left_ as (select d.doc_id, list(b[from_ + 1:lo - 1] order by from_) as l, max(hi) as hi, count(*) as n_spans, sum(hi - lo + 1) as n_removed from d join kept using (doc_id) group by d.doc_id)
select d.doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
 sha256(case when l is null then b else list_reduce(l || [b[hi + 1:octet_length(b)]], lambda x, y: x || y) end) as kept_sha256 from d left join left_ using (doc_id)"""

ORACLE = {"op1_quality_rules": OP1, "op2_line_dedup": OP2, "op3_chat_formatting": OP3, "op5_suffix_dedup": OP5, "op6_substring_dedup": OP6, "op10_fingerprints": OP10, "op11_code_compression": _lloyd(), "op13_hard_negatives": OP13}
