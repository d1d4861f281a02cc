"""Which entities of a list may be in a text: a constant of the plan, an automaton in the tasks, or a join, by the list's size.

All three give the same: the entities whose characters but white space, in lower case, are in the text's, in the list's order (longest
first). The two for longer lists also leave out places where the text's own characters bound no word, as the pattern that searches the
text afterwards does.

Where an entity lies in a text is then told by one pass over the text's words, however many entities are near; only texts with letters whose
folding the two engines' libraries may see differently are searched by a pattern for each entity.
"""

from __future__ import annotations

import bisect
import functools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

#: Rows of a list up to which it becomes a constant of the plan.
LITERAL = 250
#: Bytes of a list up to which tasks build an automaton of it; one takes about forty times as much memory.
AUTOMATON = 4 << 20
#: Squashed characters on which a longer list is joined: as many as an entity has of these. The last are also those that are compared.
LEVELS = (1, 2, 3, 4, 8, 16)
#: Bytes of a list up to which it is broadcast.
SMALL_LIST = 32 << 20
NEAR = "array<struct<value:string,category:string>>"
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLANK = "[" + "".join(map(chr, _SPACES)) + "]"
#: Letters that patterns in any case take for an ASCII letter.
ODD = "[\u0130\u0131\u017f\u212a]"
#: Rows that are searched at a time: what is found in them is in memory at once.
BATCH = 256
SPAN = "struct<tier:int,start:int,end:int,text:string,category:string,source:string,group_key:string>"
_WORD = [*range(48, 58), *range(65, 91), 95, *range(97, 123)]


def squashed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, S.SPACE, ""))


def _literals(entities: list[tuple[str, str]]) -> Column:
    one = lambda v, c: F.struct(F.lit(v).alias("value"), F.lit(c).alias("category"), squashed(F.lit(v)).alias("squashed"))
    return F.array(*(one(v, c) for v, c in entities))


def listed(text: Column, entities: list[tuple[str, str]]) -> Column:
    """Those of a short list, in its order, whose characters but white space are in the text. The text is squashed once for all of them."""
    if not entities:
        return F.expr(f"cast(array() as {NEAR})")
    pick = lambda t: F.filter(_literals(entities), lambda e: F.contains(t, e["squashed"]))
    return F.transform(S.let(squashed(text), pick), lambda e: F.struct(e["value"].alias("value"), e["category"].alias("category")))


def entity_rows(rows: DataFrame) -> DataFrame:
    """value, category and row_no of a list: stripped, blank values dropped, Entity where there is no category."""
    if "row_no" not in rows.columns:
        rows = rows.withColumn("row_no", F.monotonically_increasing_id())
    category = F.coalesce(F.nullif(S.strip(F.col("category")), F.lit("")), F.lit("Entity")).alias("category")
    return rows.select(S.strip(F.col("value")).alias("value"), category, "row_no").where("value <> ''")


def known_entities(rows: DataFrame) -> list | DataFrame:
    """entity_rows() as pairs, the longest first, of equals the one listed first; if there are more than LITERAL, the rows themselves."""
    own = entity_rows(rows)
    got = own.orderBy(F.length("value").desc(), "row_no").limit(LITERAL + 1).collect()
    return [(r["value"], r["category"]) for r in got] if len(got) <= LITERAL else own


@functools.cache
def _unsure() -> re.Pattern:
    """Characters of which another library may hold that they equal others than those with the same lower case."""

    def sure(c: str) -> bool:
        low, up = c.lower(), c.upper()
        if low == up == c:
            return True
        known = ord(c) < 0x530 or 0x1E00 <= ord(c) < 0x1F00
        return known and len(low) == 1 and (c == "ß" or len(up) == 1 and up.lower() == low) and c != "Σ" and (c.isascii() or not low.isascii())

    unsure = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not sure(c)]
    return re.compile(f"[{''.join(map(re.escape, unsure))}\ud800-\udfff]")


_RUN = re.compile("[A-Za-z0-9_]+")


@functools.lru_cache(1 << 14)
def _pattern(value: str) -> re.Pattern | None:
    """The pattern of an entity; None if its letters' folding is unsure."""
    if _unsure().search(value):
        return None
    words = [re.escape(w) for w in re.split(_BLANK + "+", value) if w]
    return re.compile(f"(?<![A-Za-z0-9_]){f'{_BLANK}*'.join(words)}(?![A-Za-z0-9_])", re.IGNORECASE)


def plain(text: str) -> bool:
    return text.isascii() or not _unsure().search(text)


def hits(text: str, single: dict[str, list[int]], others: list[tuple[int, str]]) -> list[tuple[int, int, int]] | None:
    """Number, start and end of each place, in the order of numbers and places, in a plain text; None if an entity is not plain.

    single: numbers of the entities that are one run of ASCII word characters, by their lower case: they stand where such a run begins and ends.
    """
    out = []
    if single:
        for m in _RUN.finditer(text):
            for i in single.get(m[0].lower(), ()):
                out.append((i, m.start(), m.end()))
    for i, value in others:
        pattern = _pattern(value)
        if pattern is None:
            return None
        out += [(i, *m.span()) for m in pattern.finditer(text)]
    out.sort()
    return out


def kept(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those that overlap none kept before."""
    by_place = sorted((a, b) for _, a, b in found)
    if all(x[1] <= y[0] for x, y in zip(by_place, by_place[1:], strict=False)):
        return found
    taken, out = [], []
    for f in found:
        at = bisect.bisect_left(taken, f[1:])
        if (at == len(taken) or taken[at][0] >= f[2]) and (at == 0 or taken[at - 1][1] <= f[1]):
            taken.insert(at, f[1:])
            out.append(f)
    return out


def _as_arrow(rows: list, what: str) -> pa.Array:
    """What was found in each text: None, or its places and (value, category) by number."""
    sizes = [0]
    texts, starts, ends, values, categories = [], [], [], [], []
    for r in rows:
        if r is not None:
            text, found, entity = r
            if what == "values":
                values += [entity(i)[0] for i in sorted({i for i, _, _ in found})]
                sizes.append(len(values))
                continue
            for i, a, b in kept(found):
                value, category = entity(i)
                starts.append(a), ends.append(b), texts.append(text[a:b]), values.append(value), categories.append(category)
        sizes.append(len(values))
    mask = pa.array([r is None for r in rows], pa.bool_())
    if what == "values":
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.string()), mask=mask)
    n = len(values)
    groups = ["list:" + _squeezed(v) for v in values]
    columns = [pa.array([0] * n, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string()), pa.array(categories, pa.string()), pa.array(["list"] * n, pa.string()), pa.array(groups, pa.string())]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, ["tier", "start", "end", "text", "category", "source", "group_key"]), mask=mask)


@functools.lru_cache(1 << 16)
def _squeezed(value: str) -> str:
    return " ".join(w for w in re.split(_BLANK + "+", value) if w).lower()


def _kind(what: str) -> str:
    return "array<string>" if what == "values" else f"array<{SPAN}>"


class Automaton:
    """Finds the entities of a list (squashed, value, category; in the list's order) in texts. All places of all entities in one pass over a text."""

    def __init__(self, entities: list[tuple[str, str, str]]):
        import ahocorasick

        self.entities = entities
        self.machine = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, (s, _, _) in enumerate(entities):
            if s:
                places.setdefault(s, []).append(i)
        for s, own in places.items():
            self.machine.add_word(s, (len(s), own))
        self.machine.make_automaton()
        self.empty = not places
        # The others of plain texts by an automaton of their own, so that it is not stopped by the words.
        self.single: dict[str, list[int]] = {}
        for i, (_, v, _) in enumerate(entities):
            if _RUN.fullmatch(v):
                self.single.setdefault(v.lower(), []).append(i)
        rest = [(i, e) for i, e in enumerate(entities) if not _RUN.fullmatch(e[1])]
        self.numbers = [i for i, _ in rest]
        self.rest = (self if len(rest) == len(entities) else Automaton([e for _, e in rest])) if rest else None

    def hits(self, text: str, low: str) -> list[tuple[int, int, int]] | None:
        """hits(); None if the text is not plain."""
        if not plain(text):
            return None
        others = [self.numbers[k] for k in self.rest.found(text, low)] if self.rest else []
        return hits(text, self.single, [(i, self.entities[i][1]) for i in others])

    def found(self, text: str, low: str) -> list[int]:
        """Numbers of the entities in a text; low: the text squashed."""
        if self.empty or not low:
            return []
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = np.flatnonzero(~np.isin(c, _SPACES))
        out: set[int] = set()
        if len(solid) != len(low) or not plain(text):  # a letter became two, or may equal others: places can't be told, so all that is in low counts
            for _, (_, own) in self.machine.iter(low):
                out.update(own)
            return sorted(out)
        word = np.isin(c, _WORD)
        before = np.r_[False, word][solid]  # whether a word character stands before each solid one
        after = np.r_[word, False][solid + 1]
        begins, ends = (~before).tolist(), (~after).tolist()
        for end, (size, own) in self.machine.iter(low):
            if ends[end] and begins[end - size + 1]:
                out.update(own)
        return sorted(out)


@functools.lru_cache(1)
def _built(name: str, holder) -> Automaton:
    """The automaton of a list, built once in each Python worker."""
    return Automaton(holder.entities)


class _Holder:
    """A list, told from others by its name alone."""

    def __init__(self, entities: list[tuple[str, str, str]]):
        self.entities, self.name = entities, uuid.uuid4().hex

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return self.name == other.name


def near_by_automaton(docs: DataFrame, entities: list[tuple[str, str, str]], text: str, what: str) -> DataFrame:
    """docs with _hits and, where that is null, _near, which tasks find as they go through their rows: nothing is shuffled, and no key is needed."""
    holder = _Holder(entities)
    kind = pa.list_(pa.struct([("value", pa.string()), ("category", pa.string())]))

    def run(batches):
        machine = _built(holder.name, holder)
        entity = lambda i: machine.entities[i][1:]
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                pairs = list(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True))
                got = [machine.hits(t, s) for t, s in pairs]
                near = [None if h is not None else [{"value": v, "category": c} for v, c in map(entity, machine.found(t, s))] for h, (t, s) in zip(got, pairs, strict=True)]
                found = _as_arrow([None if h is None else (t, h, entity) for h, (t, _) in zip(got, pairs, strict=True)], what)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(near, kind), found], [*b.schema.names[:-2], "_near", "_hits"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_near", T._parse_datatype_string(NEAR)), T.StructField("_hits", T._parse_datatype_string(_kind(what)))])
    return docs.select("*", F.col(text).alias("_own"), squashed(F.col(text)).alias("_low")).mapInArrow(run, schema)


def hits_of_near(docs: DataFrame, text: str, what: str) -> DataFrame:
    """docs, which have _near, with _hits: the places of these entities, or null where patterns have to find them."""

    def one(t: str, near: list[dict]):
        if not plain(t):
            return None
        single: dict[str, list[int]] = {}
        others = []
        for i, e in enumerate(near):
            if _RUN.fullmatch(e["value"]):
                single.setdefault(e["value"].lower(), []).append(i)
            else:
                others.append((i, e["value"]))
        found = hits(t, single, others)
        return None if found is None else (t, found, lambda i: (near[i]["value"], near[i]["category"]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                rows = [one(t, near) for t, near in zip(b.column(b.num_columns - 1).to_pylist(), b.column(b.num_columns - 2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _as_arrow(rows, what)], [*b.schema.names[:-1], "_hits"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_hits", T._parse_datatype_string(_kind(what)))])
    return docs.select("*", F.col(text).alias("_own")).mapInArrow(run, schema)


def single_run(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[A-Za-z0-9_]", "")) == 0


def near_by_runs(docs: DataFrame, entities: DataFrame, text: str, n_bytes: int) -> DataFrame:
    """near_by_join() for entities that are one run of ASCII word characters each: they meet the whole runs of a text at once, without beginnings."""
    own = entities.select(F.lower("value").alias("_run"), "value", "category", "row_no")
    if n_bytes <= SMALL_LIST:
        own = F.broadcast(own)
    met = lambda rows: rows.select(F.md5(F.col(text)).alias("_t"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("_run")).join(own, "_run").select("_t", "row_no", "value", "category")
    odd = F.col(text).rlike(ODD)
    if docs.where(odd).isEmpty():
        return _with_pairs(docs, met(docs), text)
    rest = docs.where(~odd)
    return _with_pairs(rest, met(rest), text).unionByName(near_by_join(docs.where(odd), entities, text))


def near_by_join(docs: DataFrame, entities: DataFrame, text: str) -> DataFrame:
    """docs with _near, by an equi-join on the beginnings of entities and of the places of a text where one can begin.

    An entity begins where no ASCII word character stands before it. From each such place on the first LEVELS[-1] squashed characters are
    taken, each distinct beginning once a text, and cut to the levels that the list uses; each entity meets them at the longest level
    that it fills, so that many entities that begin alike meet few texts, and the rest is compared. Texts are told apart by a digest, so
    rows without a key or with one key keep apart, and copies share their result.
    """
    own = entities.select("value", "category", "row_no", squashed(F.col("value")).alias("_s")).where("_s <> ''")
    level = functools.reduce(lambda a, n: F.when(F.length("_s") >= n, F.lit(n)).otherwise(a), LEVELS, F.lit(1))
    own = own.withColumn("_l", level).select("value", "category", "row_no", F.expr("substring(_s, 1, _l)").alias("_head"), F.substring("_s", 1, LEVELS[-1]).alias("_reach"), "_l")
    size, used = own.agg(F.sum(F.octet_length("value") + 64), F.collect_set("_l")).first()
    if (size or 0) <= SMALL_LIST:
        own = F.broadcast(own)
    digest = F.md5(F.col(text))
    starts = F.regexp_extract_all(F.col(text), F.lit(rf"(?<![A-Za-z0-9_])(?=((?:\S(?U:[\s\x1c-\x1f]*)){{1,{LEVELS[-1]}}}))"), F.lit(1))
    begins = F.array_distinct(F.transform(starts, lambda x: F.substring(squashed(x), 1, LEVELS[-1])))
    places = docs.select(digest.alias("_t"), F.explode(begins).alias("_begin"))
    cut = [F.when(F.length("_begin") >= n, F.substring("_begin", 1, n)) for n in sorted(used or [1])]
    heads = places.select("_t", "_begin", F.explode(F.array_compact(F.array(*cut))).alias("_head"))
    return _with_pairs(docs, heads.join(own, "_head").where(F.startswith("_begin", F.col("_reach"))).select("_t", "row_no", "value", "category"), text)


def _with_pairs(docs: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """docs with _near: of the entities that have met a text, by its digest, each once, in the list's order."""
    digest = F.md5(F.col(text))
    row = F.struct((-F.length("value")).alias("rank"), "row_no", "value", "category")
    near = pairs.groupBy("_t").agg(F.sort_array(F.collect_set(row)).alias("_n"))
    near = near.select("_t", F.transform("_n", lambda e: F.struct(e["value"].alias("value"), e["category"].alias("category"))).alias("_near"))
    joined = docs.withColumn("_t", digest).join(near, "_t", "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce("_near", listed(F.lit(""), [])).alias("_near"))


def with_near(docs: DataFrame, entities: list | DataFrame, text: str, what: str = "spans") -> tuple[DataFrame, Column | None, Column | None]:
    """docs whose text is not null, a column of the entities that may be in it (None if there is no list), and for longer lists one of those that are.

    what: "spans", the claims of the list in their order, or "values", the entities' own texts in the list's order. It is null where the
    entities that may be there have to be looked for.
    """
    docs = docs.where(F.col(text).isNotNull())
    if not isinstance(entities, DataFrame):
        if len(entities) <= LITERAL:
            longest = sorted(entities, key=lambda e: -len(e[0]))
            return docs, listed(F.col(text), longest) if longest else None, None
        rows = [(v, c, i) for i, (v, c) in enumerate(entities)]
        entities = docs.sparkSession.createDataFrame(rows, "value string, category string, row_no long")
    # Rows are fetched up to the size that an automaton may have, and no further.
    n_bytes, n, all_single = entities.agg(F.sum(F.octet_length("value") + F.octet_length("category")), F.count("*"), F.bool_and(single_run(F.col("value")))).first()
    if (n_bytes or 0) <= AUTOMATON and _has_automaton():
        own = entities.select(squashed(F.col("value")).alias("s"), "value", "category", "row_no").orderBy(F.length("value").desc(), "row_no").collect()
        return near_by_automaton(docs, [(r["s"], r["value"], r["category"]) for r in own], text, what), F.col("_near"), F.col("_hits")
    near = near_by_runs(docs, entities, text, n_bytes + 64 * n) if all_single else near_by_join(docs, entities, text)
    return hits_of_near(near, text, what), F.col("_near"), F.col("_hits")


def _has_automaton() -> bool:
    try:
        import ahocorasick  # noqa: F401
    except ModuleNotFoundError:
        return False
    return True

