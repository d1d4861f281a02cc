"""Find, number, replace and verify sensitive text: DataFrame to DataFrame, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as L
from ..functions import scalars as S
from . import mapped
from .entities import LITERAL, SPAN, entity_rows, known_entities, listed, squashed, with_near  # noqa: F401
from .numbering import folder_names, numbered, zip_names  # noqa: F401

NONE = f"cast(array() as array<{SPAN}>)"
#: A code point that is no character, and so in hardly any text.
EDGE = "\ufdd0"
#: Candidates, and those of a cluster, up to which each is compared with all that are kept.
FOLD = 64
#: Numbers that a running sum adds up at a time.
CHUNK = 64
DETECTORS = {"Email": L.EMAIL, "Phone": L.PHONE, "UEN": L.UEN, "ABN": L.ABN, "Address": L.ADDRESS}
#: What finds spans in a text: a function of the text's Column to an array of SPAN. spans() makes one of a pattern.
Detector = Callable[[Column], Column]
#: A list of known entities: (value, category) pairs, or rows of value, category and row_no as entity_rows() gives them.
Entities = list | DataFrame


def before(sizes: Column) -> Column:
    """The sums of what lies before each of an array of numbers. Added up in chunks, so that long arrays are not copied for each number."""
    add = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    last = lambda x, i: F.least((i + 1) * CHUNK, F.size(x)) - 1
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.transform(F.sequence(i * CHUNK, last(x, i)), lambda j: F.get(x, j)))

    def summed(c: Column) -> Column:
        totals = F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return S.let(F.aggregate(totals, F.array(F.lit(0)), add), lambda base: F.flatten(F.transform(c, lambda x, i: F.slice(F.aggregate(x, F.array(F.get(base, i)), add), F.lit(1), F.size(x)))))

    return S.let(sizes, lambda x: F.when(F.size(x) > 0, S.let(cut(x), summed)).otherwise(F.expr("cast(array() as array<int>)")))


def spans(text: Column, pattern: Column, tier: Column, category: Column, source: str, group: Column | None = None) -> Column:
    """Every match of pattern, none of which is empty, as SPAN; offsets are the lengths of what lies before, added up.

    The pattern goes through the text once, to put EDGE on either side of each match. A text that has that character itself is searched twice instead.
    """

    def made(x: Column) -> Column:
        def one(i: Column) -> Column:
            t, start = F.get(x["parts"], i), F.get(x["at"], i)
            return F.struct(tier.cast("int").alias("tier"), start.alias("start"), (start + F.length(t)).alias("end"), t.alias("text"), category.alias("category"), F.lit(source).alias("source"), (t if group is None else group).alias("group_key"))

        return F.transform(F.sequence(F.lit(1), F.size(x["parts"]) - 2, F.lit(2)), one)

    def placed(parts: Column) -> Column:
        some = S.let(F.struct(parts.alias("parts"), before(F.transform(parts, F.length)).alias("at")), made)
        return F.when(F.size(parts) > 1, some).otherwise(F.expr(NONE))

    def woven(m: Column) -> Column:
        # What lies between matches and the matches, in turn.
        return F.flatten(F.transform(F.split(text, pattern, -1), lambda g, i: F.when(i < F.size(m), F.array(g, F.get(m, i))).otherwise(F.array(g))))

    edged = F.split(F.regexp_replace(text, pattern, F.lit(f"{EDGE}$0{EDGE}")), EDGE, -1)
    return S.let(F.when(F.contains(text, F.lit(EDGE)), S.let(F.regexp_extract_all(text, pattern, F.lit(0)), woven)).otherwise(edged), placed)


def detected(text: Column, near: Column | None = None, detectors: tuple[str | Detector, ...] = tuple(DETECTORS), found: Column | None = None, hits: Column | None = None) -> Column:
    """Candidates in the order of their claims: known entities (longest first), email, phone, UEN, ABN, then what a tagger found or else addresses.

    near: array of value and category. detectors: those that run, by category; functions among them go last, in their order. found: array of text, category, start, end, from ner.candidates().
    hits: the known entities' claims where they are settled; null where those in near are to be found.
    """
    out = []
    if near is not None:
        group = lambda e: F.concat(F.lit("list:"), F.lower(S.squeeze(e["value"])))
        listed_spans = F.flatten(F.transform(near, lambda e: spans(text, S.flexible(e["value"]), F.lit(0), e["category"], "list", group(e))))
        out.append(listed_spans if hits is None else F.when(hits.isNotNull(), hits).otherwise(listed_spans))
    for tier, (category, pattern) in enumerate(DETECTORS.items(), 1):
        if category not in detectors or (category == "Address" and found is not None):
            continue
        # A text without the character that every match has is not searched.
        worth = F.contains(text, F.lit("@")) if category == "Email" else text.rlike(r"\p{Nd}")
        some = F.when(worth, spans(text, F.lit(pattern), F.lit(tier), F.lit(category), "regex")).otherwise(F.expr(NONE))
        if category == "Phone":
            some = F.filter(some, lambda s: (S.digits(s["text"]) >= 7) & ~S.is_year_range(s["text"]))
        out.append(some)
    if found is not None:
        own = lambda s: F.struct(F.lit(len(DETECTORS)).alias("tier"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["category"].alias("category"), F.lit("ner").alias("source"), s["text"].alias("group_key"))
        out.append(F.transform(found, own))
    out += [d(text) for d in detectors if callable(d)]
    return F.concat(*out) if out else F.expr(NONE)


def overlapping(candidates: Column) -> Column:
    """Whether any two of the spans overlap: if so, two neighbours by start do."""

    def neighbours(x: Column) -> Column:
        return F.exists(F.transform(x, lambda s, i: (i > 0) & (F.get(x, F.greatest(i - 1, F.lit(0)))["end"] > s["start"])), lambda b: b)

    return S.let(F.sort_array(F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), neighbours)


def arbitrate(candidates: Column) -> Column:
    """Keep each candidate, in order, that overlaps none kept before it. Each is compared with all that are kept: arbitrated() is for any number."""
    return S.let(candidates, lambda c: F.when(overlapping(c), _fold(c)).otherwise(c))


def _fold(c: Column) -> Column:
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (k["end"] > s["start"]))
    return F.aggregate(c, F.slice(c, 1, 0), lambda kept, s: F.when(free(kept, s), F.concat(kept, F.array(s))).otherwise(kept))


def arbitrated(rows: DataFrame, candidates: Column, name: str) -> DataFrame:
    """rows with a column of arbitrate(candidates), for any number of them in a row.

    Where there are many, those that hang together by overlaps are a cluster, and each cluster is decided for itself. Starts and ends are put in
    order, an end before the starts at its place; a cluster is over where as many have ended as have begun. From there on a span is the places
    of its start and end in that order, which overlap as the spans do and of which no two are equal. Each step is a column of its own, null
    where candidates are few, since an expression as deep as all of them together is beyond the analyser.
    """
    keep = [F.col(f"`{x}`") for x in rows.columns]
    own = rows.select(*keep, candidates.alias("_c")).select("*", overlapping(F.col("_c")).alias("_o"))
    for step in _STEPS:
        own = own.selectExpr("*", step)
    return own.select(*keep, F.expr(f"case when _h then {_let('_k', 'k', _let('_c', 'c', 'transform(array_sort(transform(k, x -> x.i)), i -> get(c, i))'))} when _o then {_fold_sql('_c')} else _c end").alias(name))


# SQL here, since an expression of Columns as long as this takes seconds to make.
_let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
_fold_sql = lambda c: f"aggregate({c}, slice({c}, 1, 0), (kept, s) -> if(exists(kept, k -> k.start < s.end and k.end > s.start), kept, concat(kept, array(s))))"


def _before_sql(numbers: str) -> str:
    """before()."""
    add = "(a, z) -> concat(a, array(element_at(a, -1) + z))"
    cut = f"transform(sequence(0, cast(floor((size(x) - 1) / {CHUNK}) as int)), i -> transform(sequence(i * {CHUNK}, least((i + 1) * {CHUNK}, size(x)) - 1), j -> get(x, j)))"
    base = f"aggregate(transform(c, y -> aggregate(y, 0, (a, z) -> a + z)), array(0), {add})"
    sums = f"flatten(transform(c, (y, i) -> slice(aggregate(y, array(get(base, i)), {add}), 1, size(y))))"
    return _let(numbers, "x", f"if(size(x) > 0, {_let(cut, 'c', _let(base, 'base', sums))}, cast(array() as array<int>))")


def _buckets_sql(c: str) -> str:
    """Decides a large cluster of spans, whose starts and ends differ.

    The line is cut into about sqrt(n) buckets, and what is kept is entered in each bucket that it reaches into. So a candidate is only compared with
    the kept ones of its own buckets. What an aggregate hands on is copied each time, so a kept span is one number, start * 2^32 + end.
    """
    bucket = lambda at: f"cast(floor(({at} - f.low) / f.w) as int)"
    code, pair = "(cast(s.start as bigint) * 4294967296 + s.end)", 1 << 32
    low, high, side = f"array_min(transform({c}, s -> s.start))", f"array_max(transform({c}, s -> s.end))", f"cast(ceil(sqrt(size({c}))) as int)"
    frame = f"named_struct('low', {low}, 'w', cast(ceil(({high} - {low} + 1) / {side}) as int), 'side', {side})"
    first, last = bucket("s.start"), bucket("s.end")
    own = f"slice(have, {first} + 1, {last} - {first} + 1)"
    taken = f"exists({own}, b -> exists(b, k -> shiftright(k, 32) < s.end and k % {pair} > s.start))"
    entered = f"concat(slice(have, 1, {first}), transform({own}, b -> concat(b, array({code}))), slice(have, {last} + 2, size(have)))"
    have = f"aggregate({c}, array_repeat(cast(array() as array<bigint>), f.side + 1), (have, s) -> if({taken}, have, {entered}))"
    return _let(frame, "f", _let(have, "h", f"filter({c}, s -> array_contains(get(h, {first}), {code}))"))


_PLACED = "transform(_e, (y, at) -> named_struct('i', y.i, 'at', at, 'cluster', get(n, at) + int(get(d, at) = 0)))"
_SPANS = "transform(sequence(0, cast(size(p) / 2 as int) - 1), i -> named_struct('cluster', get(p, 2 * i).cluster, 'i', i, 'start', get(p, 2 * i).at, 'end', get(p, 2 * i + 1).at))"
#: Bound by _let() is what a lambda looks into, for the optimiser puts what a column stands for in its place.
_STEPS = [
    f"_o and size(_c) > {FOLD} as _h",
    "if(_h, sort_array(flatten(transform(_c, (s, i) -> array(named_struct('at', s.start, 'kind', 1, 'i', i), named_struct('at', s.end, 'kind', 0, 'i', i))))), null) as _e",
    # How many are open before each place, and how many clusters have begun there.
    f"if(_h, {_before_sql('transform(_e, x -> 2 * x.kind - 1)')}, null) as _d",
    f"if(_h, {_before_sql('transform(_d, d -> int(d = 0))')}, null) as _n",
    # By candidate, its start's place and then its end's.
    f"if(_h, sort_array({_let('_d', 'd', _let('_n', 'n', _PLACED))}), null) as _p",
    f"if(_h, sort_array({_let('_p', 'p', _SPANS)}), null) as _s",
    f"if(_h, {_let('_s', 's', 'filter(sequence(0, size(s) - 1), j -> j = 0 or get(s, greatest(j - 1, 0)).cluster <> get(s, j).cluster)')}, null) as _b",
    f"if(_h, {_let('_b', 'b', _let('_s', 's', 'transform(b, (j, k) -> transform(sequence(j, coalesce(get(b, k + 1), size(s)) - 1), y -> get(s, y)))'))}, null) as _g",
    f"if(_h, flatten(transform(_g, g -> case when size(g) = 1 then g when size(g) <= {FOLD} then {_fold_sql('g')} else {_buckets_sql('g')} end)), null) as _k",
]


def longest_spans(candidates: Column) -> Column:
    """Of overlapping spans the longest, of equals the first; in the order of the text."""
    rank = lambda s: F.struct((s["start"] - s["end"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s.alias("s"))
    kept = arbitrate(F.sort_array(F.transform(candidates, rank)))
    by_place = F.sort_array(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["s"].alias("s"))))
    return F.transform(by_place, lambda s: s["s"])


def claims(docs: DataFrame, entities: Entities = (), use_regex: bool = True, key: str = "doc_id", text: str = "text", detectors: tuple[str | Detector, ...] = tuple(DETECTORS), found: str | None = None) -> DataFrame:
    """key, seq and the span of every claim, in the order of the claims. Null text has none. found: a column of ner.candidates()."""
    kept = _kept(docs, entities, use_regex, key, text, detectors, found)
    return _each(kept, F.col("_kept"), "_key").select(F.col("_key").alias(key), "seq", "s.*")


def _each(rows: DataFrame, found: Column, *keep: str) -> DataFrame:
    """keep, seq and s: a row for each of an array. An inner explode would have the optimiser make the array a second time, to see whether it is empty."""
    return rows.select(*keep, F.posexplode_outer(found).alias("seq", "s")).where("seq is not null")


def _kept(docs: DataFrame, entities: Entities, use_regex: bool, key: str, text: str, detectors: tuple[str | Detector, ...], found: str | None) -> DataFrame:
    """_key, _text and _kept, the claims, of each row whose text is not null."""
    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *([F.col(found).alias("_found")] if found else []))
    own, near, hits = with_near(given, entities, "_text")
    candidates = detected(F.col("_text"), near, detectors if use_regex else (), F.col("_found") if found else None, hits)
    return arbitrated(own, candidates, "_kept").select("_key", "_text", "_kept")


def first_texts(kept: Column) -> Column:
    """Of the spans with one text the first."""

    def firsts(x: Column) -> Column:
        return F.filter(x, lambda s, i: (i == 0) | (F.get(x, F.greatest(i - 1, F.lit(0)))["text"] != s["text"]))

    by_text = F.sort_array(F.transform(kept, lambda s, i: F.struct(s["text"].alias("text"), i.alias("i"), s.alias("s"))))
    return F.transform(F.sort_array(F.transform(S.let(by_text, firsts), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])


def items(docs: DataFrame, entities: Entities = (), use_regex: bool = True, key: str = "doc_id", text: str = "text", detectors: tuple[str | Detector, ...] = tuple(DETECTORS), found: str | None = None) -> DataFrame:
    """The claims whose text a document has first, with their context."""
    kept = _kept(docs, entities, use_regex, key, text, detectors, found)
    rows = _each(kept, first_texts(F.col("_kept")), "_key", "_text")
    return rows.select(F.col("_key").alias(key), "seq", "s.*", S.snippet(F.col("_text"), F.col("s.text")).alias("context"))


def with_item_ids(found: DataFrame, key: str = "doc_id", keys: DataFrame | None = None) -> DataFrame:
    """found with an id from 0 in the order of (key, seq). keys: see numbered()."""
    return numbered(found, [], key, ["seq"], "id", keys=keys).withColumn("id", F.col("id") - 1)


def with_placeholders(found: DataFrame, key: str = "doc_id", keys: DataFrame | None = None) -> DataFrame:
    """found with a placeholder for each group_key, numbered per category in the order of first appearance by (key, seq). keys: see numbered()."""
    order = F.struct(key, "seq")
    first = found.groupBy("group_key").agg(F.min(F.struct(order.alias("at"), "category", "text", "source")).alias("f")).select("group_key", "f.*")
    counted = ~(((F.col("source") == "list") & S.is_numbered(F.col("category"))) | F.col("category").isin(list(L.GENERATORS)))
    own = first.withColumn("_k", F.col(f"at.{key}"))
    rows = numbered(own.where(counted), ["category"], "_k", ["at"], "n", keys=keys.select(F.col(key).alias("_k")) if keys is not None else None).unionByName(own.where(~counted).withColumn("n", F.lit(0).cast("long")))
    named = rows.select("group_key", S.placeholder(F.col("category"), F.col("text"), F.col("source"), F.col("n")).alias("placeholder"))
    return found.join(named, "group_key").withColumn("category", F.when(F.col("category").startswith("="), "Custom").otherwise(F.col("category")))


def _pairs(items: DataFrame, key: str) -> DataFrame:
    """key and pair, a row for each original of a document; of equal originals the last counts."""
    last = items.groupBy(key, "text").agg(F.max_by("placeholder", "seq").alias("p"), F.max_by("category", "seq").alias("c"), F.min("seq").alias("seq"))
    return last.select(key, F.struct((-F.length("text")).alias("rank"), "seq", F.col("text").alias("o"), "p", S.is_grey(F.col("c"), F.col("p")).alias("grey")).alias("pair"))


def mapping(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pairs: for each document the longest originals first, of equal length the one seen first; of equal originals the last counts."""
    return _pairs(items, key).groupBy(key).agg(F.sort_array(F.collect_list("pair")).alias("pairs"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def indexed(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """docs whose mapping is not empty with pairs: those of the mapping that can make a difference to the text, in their order.

    A whole-word original has each of its runs of word characters as a whole run of the text, or of a placeholder that was put in before. So
    mapping and texts meet by (key, the original's longest run); originals whose run is in a placeholder, or that have none, go with
    every text. Texts are told apart by a digest.
    """
    found = _pairs(items, key)
    longest = F.array_max(F.transform(_tokens(F.col("pair.o")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    rows = found.select(F.col(key).alias("_k"), "pair", longest.alias("_w"))
    put_in = found.select(F.col(key).alias("_pk"), F.explode(_tokens(F.col("pair.p"))).alias("_pw")).distinct().withColumn("_in", F.lit(True))
    rows = rows.join(put_in, (F.col("_k") == F.col("_pk")) & (F.col("_w") == F.col("_pw")), "left").withColumn("_all", F.col("_w").isNull() | F.col("_in").isNotNull()).select("_k", "_w", "_all", "pair")
    # A row for each document with a mapping, with what goes with every text.
    every = rows.groupBy("_k").agg(F.collect_list(F.when(F.col("_all"), F.col("pair"))).alias("_every"))
    own = docs.withColumn("_t", F.md5(F.col(text)))
    words = own.select(F.col(key).alias("_k"), "_t", F.explode(F.array_distinct(_tokens(F.col(text)))).alias("_w"))
    near = words.join(rows.where("not _all").select("_k", "_w", "pair"), ["_k", "_w"]).groupBy("_k", "_t").agg(F.collect_set("pair").alias("_near"))
    near = near.select(F.col("_k").alias("_nk"), F.col("_t").alias("_nt"), "_near")
    joined = own.join(every, F.col(key) == F.col("_k")).join(near, (F.col("_k") == F.col("_nk")) & (F.col("_t") == F.col("_nt")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.sort_array(F.concat("_every", F.coalesce("_near", F.slice("_every", 1, 0)))).alias("pairs"))


def replace_word(text: Column, original: Column, placeholder: Column) -> Column:
    """Whole-word, case-sensitive; the regular expression runs only where the original is in the text at all."""
    pattern = F.concat(F.lit("(?<![A-Za-z0-9_])"), S.quote(original), F.lit("(?![A-Za-z0-9_])"))
    return F.when(F.contains(text, original), F.regexp_replace(text, pattern, S.literal(placeholder))).otherwise(text)


def folded(text: Column, pairs: Column) -> Column:
    """text, changed, grey: the replacements of a mapping one after the other, each on what the last has left; whether any was made, and any grey one."""
    zero = F.struct(text.alias("text"), F.lit(False).alias("changed"), F.lit(False).alias("grey"))

    def step(a: Column, m: Column) -> Column:
        made = lambda new: F.struct(new.alias("text"), (a["changed"] | (new != a["text"])).alias("changed"), (a["grey"] | (m["grey"] & (new != a["text"]))).alias("grey"))
        return F.when(F.contains(a["text"], m["o"]), S.let(replace_word(a["text"], m["o"], m["p"]), made)).otherwise(a)

    return F.aggregate(pairs, zero, step)


def masked(text: Column, pairs: Column) -> Column:
    """The replacements of a mapping one after the other, each on what the last has left."""
    return F.aggregate(pairs, text, lambda t, m: replace_word(t, m["o"], m["p"]))


def masked_any_case(text: Column, pairs: Column) -> Column:
    """text, n: originals replaced in any case and with any white space between their words, as in text laid out on pages, and how many were.

    Letters or digits of any script bound a word. Places are those of the text as given: earlier pairs claim theirs, and what is put in is not
    searched again.
    """

    def pattern(o: Column) -> Column:
        words = F.filter(F.split(o, S.SPACE + "+"), lambda w: w != "")
        return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), F.array_join(F.transform(words, S.quote), r"(?U:[\s\x1c-\x1f]+)"), F.lit(r"(?![\p{L}\p{N}])"))

    near = F.filter(pairs, lambda m: F.contains(squashed(text), squashed(m["o"])) & (S.strip(m["o"]) != ""))
    hits = F.flatten(F.transform(near, lambda m: spans(text, pattern(m["o"]), F.lit(0), m["p"], "pairs")))
    in_order = F.sort_array(F.transform(arbitrate(hits), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("p"))))

    def rebuilt(s: Column) -> Column:
        end = lambda i: F.when(i == 0, 0).otherwise(F.get(s, F.greatest(i - 1, F.lit(0)))["end"])
        parts = F.transform(s, lambda x, i: F.concat(F.substring(text, end(i) + 1, x["start"] - end(i)), x["p"]))
        rest = F.substring(text, end(F.size(s)) + 1, F.length(text))
        return F.struct(F.concat(F.array_join(parts, ""), rest).alias("text"), F.size(s).alias("n"))

    return S.let(in_order, rebuilt)


def masked_lines(text: Column, pairs: Column) -> Column:
    """As masked(), but a pair is found as a known entity is: in any case, with any white space or none between its words. For recognised lines."""
    near = lambda t, m: F.contains(squashed(t), squashed(m["o"])) & (S.strip(m["o"]) != "")
    step = lambda t, m: F.when(near(t, m), F.regexp_replace(t, S.flexible(m["o"]), S.literal(m["p"]))).otherwise(t)
    return F.aggregate(pairs, text, step)


def chosen(reviewed: DataFrame) -> DataFrame:
    """The items that are included; all that do not say."""
    return reviewed.where(F.coalesce(F.col("include"), F.lit(True))) if "include" in reviewed.columns else reviewed


def _held_mappings(docs: DataFrame, items: DataFrame, key: str) -> dict | None:
    """The pairs of all mappings by key, in their order; None if they are more than tasks should hold, or keys and texts are of kinds that are compared otherwise."""
    kinds = [df.schema[key].dataType for df in (docs, items)]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not (all(isinstance(k, whole) for k in kinds) or all(k == T.StringType() for k in kinds)):
        return None
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("placeholder"), F.lit(0)) + 64)).first()[0] or 0
    if size > mapped.HELD:
        return None
    rows = mapping(items.where(F.col(key).isNotNull()), key).select(F.col(key), F.transform("pairs", lambda p: F.struct(p["o"].alias("o"), p["p"].alias("p"), p["grey"].alias("grey"))).alias("pairs")).collect()
    pairs = {r[0]: [(p["o"], p["p"], p["grey"]) for p in r[1]] for r in rows}
    return None if any(None in p for own in pairs.values() for p in own) else pairs


def apply(docs: DataFrame, reviewed: DataFrame, key: str = "doc_id", text: str = "text", many: bool = False) -> DataFrame:
    """docs whose mapping is not empty, with masked text, changed and any_grey. reviewed: key, seq, text, category, placeholder, include.

    docs may hold a document in several rows (cells, paragraphs), each masked by the mapping of the document. A null text stays null.
    many: mappings have hundreds of entries or more. Up to mapped.HELD bytes of them are held by the tasks; of more, each text is first told which
    entries concern it. The result is the same.
    """
    held = _held_mappings(docs, chosen(reviewed), key) if many else None
    if held is not None:
        done = mapped.apply(docs, held, key, text)
    else:
        joined = indexed(docs, chosen(reviewed), key, text) if many else docs.join(mapping(chosen(reviewed), key), key)
        done = joined.withColumn("_m", folded(F.col(text), F.col("pairs")))
    return done.select(*docs.columns, F.col("_m.text").alias("masked"), F.col("_m.changed").alias("changed"), F.col("_m.grey").alias("any_grey"))


def mapping_log(reviewed: DataFrame, key: str = "doc_id") -> DataFrame:
    """original, placeholder over the batch, in the order first seen; the last value of an original counts."""
    at = F.struct(key, "seq")
    return reviewed.groupBy(F.col("text").alias("original")).agg(F.max_by("placeholder", at).alias("placeholder"), F.min(at).alias("at"))


def review(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with a person's decisions by id: id, include, placeholder; what is not decided stays included as it is."""
    d = decisions.select("id", F.col("include").alias("_i"), F.col("placeholder").alias("_p"))
    return found.join(d, "id", "left").withColumn("include", F.coalesce("_i", F.lit(True))).withColumn("placeholder", F.coalesce("_p", "placeholder")).drop("_i", "_p")


def verified(docs: DataFrame, entities: Entities, text: str = "text") -> DataFrame:
    """docs with values: the known entities that a text still holds, longest first. A row for each text that is not null."""
    if not isinstance(entities, DataFrame) and len(entities) <= LITERAL:
        return docs.where(F.col(text).isNotNull()).withColumn("values", _held(text, sorted(entities, key=lambda e: -len(e[0]))))
    own, near, hits = with_near(docs, entities, text, "values")
    held = F.transform(F.filter(near, lambda e: F.rlike(F.col(text), S.flexible(e["value"]))), lambda e: e["value"])
    return own.select(*(F.col(f"`{c}`") for c in docs.columns), (held if hits is None else F.when(hits.isNotNull(), hits).otherwise(held)).alias("values"))


def _held(text: str, entities: list[tuple[str, str]]) -> Column:
    """The values of a short list that a text holds. Their patterns are constants, which a task compiles once, and run only where the characters are there."""
    if not entities:
        return F.expr("cast(array() as array<string>)")
    q = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    space = q(S.SPACE)
    low = lambda x: f"lower(regexp_replace({x}, {space}, ''))"
    one = lambda v: f"if(contains(low, {low(q(v))}) and rlike(`{text}`, {q(S.flexible_text(v))}), {q(v)}, null)"
    return F.expr(f"array_compact(transform(array({low(f'`{text}`')}), low -> array({', '.join(one(v) for v, _ in entities)}))[0])")


def verify(docs: DataFrame, entities: Entities, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_leaks, values (the known entities that a text still holds, longest first), clean: a row for each text that is not null."""
    found = verified(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), entities, "_text")
    return found.select(F.col("_key").alias(key), F.size("values").alias("n_leaks"), "values", (F.size("values") == 0).alias("clean"))


def leaks(docs: DataFrame, entities: Entities, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_leaks, values of the texts that still hold any known entity."""
    return verify(docs, entities, key, text).where("n_leaks > 0").drop("clean")


def any_leak(verified: DataFrame) -> bool:
    return bool(verified.agg(F.bool_or(~F.col("clean"))).first()[0])


def segment_offsets(segments: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Where each segment lies in its document's text, the segments being joined by line feeds."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    return segments.withColumn("start", start).withColumn("end", start + F.length(text))


def locate(position: Column, ranges: Column) -> Column:
    """The name of the range [start, end) that holds position; null if none does."""
    return F.get(F.filter(ranges, lambda r: (position >= r["start"]) & (position < r["end"])), F.lit(0))["name"]


def sanitize_name(stem: Column, pairs: Column) -> Column:
    """A file's stem with its words replaced: letters and digits bound a word, words of an original may be parted by blank, _ or -."""

    def step(t: Column, m: Column) -> Column:
        words = F.filter(F.split(m["o"], S.SPACE + "+"), lambda w: w != "")
        pattern = F.concat(F.lit("(?iu)(?<![A-Za-z0-9])"), F.array_join(F.transform(words, S.quote), r"[\s_-]*"), F.lit("(?![A-Za-z0-9])"))
        return F.regexp_replace(t, pattern, S.literal(F.regexp_replace(m["p"], S.SPACE + "+", "_")))

    return F.aggregate(pairs, stem, step)


def dedupe_blobs(blobs: DataFrame, content: Column, key: str) -> DataFrame:
    """key, digest, first_id (the first key with that content), n (how many have it): a row for each blob, so no group is gathered in one place."""
    own = blobs.select(key, F.md5(content).alias("digest"))
    groups = own.groupBy("digest").agg(F.min(key).alias("first_id"), F.count("*").alias("n"))
    return own.join(groups, "digest").select(key, "digest", "first_id", "n")


def ocr_lines(words: DataFrame, least: int = 40, dpi: int = 200) -> DataFrame:
    """Words of confidence `least` or more, by block, par and line: their text in order and the box around them, in points (72 an inch)."""
    good = words.where((F.col("conf") >= least) & (F.trim("text") != ""))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    point = lambda c, name: (c * F.lit(72) / F.lit(dpi)).alias(name)
    box = [point(F.min("left"), "x0"), point(F.min("top"), "y0"), point(F.max(F.col("left") + F.col("width")), "x1"), point(F.max(F.col("top") + F.col("height")), "y1")]
    return good.groupBy("block", "par", "line").agg(text.alias("text"), *box)


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("group_key").alias("n_groups"))
