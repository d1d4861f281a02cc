"""Street addresses and named entities from the tokens and labels of a tagger, in built-in expressions.

A tagger is any function that adds two columns to a table of texts: tokens, TOKENS in the order of the text, and ents, ENTS that do not
overlap, as token ranges [first, last). Each token becomes one letter that says what it can be in a street's name, so the street
patterns are regular expressions over the string of these letters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as L
from ..functions import scalars as S
from . import mask as M

TOKENS = "array<struct<text:string,start:int,pos:string,punct:boolean>>"
ENTS = "array<struct<first:int,last:int,label:string>>"
FOUND = "array<struct<text:string,category:string,start:int,end:int>>"
Tagger = Callable[[DataFrame], DataFrame]
#: A model of a tagger: texts to (tokens, entities) of each, as dicts of what TOKENS and ENTS hold.
Model = Callable[[list[str]], list[tuple[list[dict], list[dict]]]]
#: Characters of a text that are a tagger's own to tell at a time, and those on either side that it is shown besides.
CHUNK, OVERLAP = 100_000, 1_000
#: One letter for each set of the five kinds of token.
_LETTERS = "0123456789abcdefghijklmnopqrstuv"
NUMBER, DETERMINER, NOUN, SUFFIX, PREFIX = range(5)


def _kind(k: int) -> str:
    return "[" + "".join(c for i, c in enumerate(_LETTERS) if i >> k & 1) + "]"


STREET = f"^(?:{_kind(NUMBER)}{_kind(DETERMINER)}?{_kind(NOUN)}*{_kind(SUFFIX)}|{_kind(PREFIX)}{_kind(NOUN)}+)"
_POSTCODE = r"^\d{4,6}$"


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """key, own, offset, chunk: each text in parts of `size` characters, from own on, with `overlap` more on either side; a chunk begins at offset. Empty and null texts have none."""
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size)))
    parts = docs.select(key, text, F.explode(at).alias("own"))
    parts = parts.withColumn("offset", F.greatest(F.col("own") - overlap, F.lit(0)))
    return parts.select(key, "own", "offset", F.substring(F.col(text), F.col("offset") + 1, F.col("own") + size + overlap - F.col("offset")).alias("chunk"))


#: Models by provider, for all tasks of a Python worker.
_MODELS: dict[str, Model] = {}


def _model(name: str, load: Callable[[], Model]) -> Model:
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def provider(load: Callable[[], Model], batch_chars: int = 1_000_000) -> Tagger:
    """A tagger of a model that is loaded once in each Python worker, when its first task begins, and is given up to batch_chars characters at a time.

    load is sent to the workers, and so must be small; what it returns stays there.
    """
    name = uuid.uuid4().hex
    token = pa.struct([("text", pa.string()), ("start", pa.int32()), ("pos", pa.string()), ("punct", pa.bool_())])
    ent = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("label", pa.string())])

    def run(batches):
        model = _model(name, load)
        for b in batches:
            at, texts = 0, [t.as_py() for t in b.column("chunk")]
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_chars):
                    size += len(texts[end])
                    end += 1
                tokens, ents = zip(*model(texts[at:end]), strict=True)
                yield pa.RecordBatch.from_arrays([*b.slice(at, end - at).columns, pa.array(tokens, pa.list_(token)), pa.array(ents, pa.list_(ent))], [*b.schema.names, "tokens", "ents"])
                at = end

    def tagger(parts: DataFrame) -> DataFrame:
        kinds = [T.StructField(n, T._parse_datatype_string(k)) for n, k in (("tokens", TOKENS), ("ents", ENTS))]
        return parts.mapInArrow(run, T.StructType([*parts.schema.fields, *kinds]))

    return tagger


def _letter(t: Column) -> Column:
    low = F.lower(t["text"])
    kinds = (t["text"].rlike(r"^\d+[A-Za-z]?$"), t["pos"] == "DET", t["pos"].isin("PROPN", "NOUN"), low.isin(L.STREET_WORDS), low.isin(L.STREET_PREFIXES))
    return F.substring(F.lit(_LETTERS), sum((F.when(k, 1 << i).otherwise(0) for i, k in enumerate(kinds)), F.lit(1)), F.lit(1))


def streets(tokens: Column) -> Column:
    """Token ranges that look like a street: number, article, nouns, street word; or street word and nouns. The longest of overlapping ones."""

    def matched(codes: Column) -> Column:
        may = F.filter(F.sequence(F.lit(0), F.length(codes)), lambda i: F.substring(codes, i + 1, F.lit(1)).rlike(f"{_kind(NUMBER)}|{_kind(PREFIX)}"))
        size = lambda i: F.length(F.regexp_extract(F.substring(codes, i + 1, F.length(codes)), STREET, 0))
        return F.filter(F.transform(may, lambda i: F.struct(i.alias("start"), (i + size(i)).alias("end"))), lambda s: s["end"] > s["start"])

    return M.longest_spans(S.let(F.array_join(F.transform(tokens, _letter), ""), matched))


def _text(text: Column, tokens: Column, first: Column, last: Column) -> Column:
    """The text of the tokens [first, last)."""
    begin, end = F.get(tokens, first)["start"], F.get(tokens, last - 1)
    return F.substring(text, begin + 1, end["start"] + F.length(end["text"]) - begin)


def _is(tokens: Column, i: Column, pattern: str) -> Column:
    return F.coalesce(F.get(tokens, i)["text"].rlike(pattern), F.lit(False))


def extended(tokens: Column, ents: Column, street: Column) -> Column:
    """start, end, taken: a street with what follows it behind punctuation: a place that the tagger names, with its postcode; or a
    capitalised word that a state's letters or a postcode confirm. taken: the token at which the place begins, -1 if there is none."""
    after = F.filter(F.sequence(street["end"], F.size(tokens)), lambda i: ~F.coalesce(F.get(tokens, i)["punct"], F.lit(False)))

    def ended(i: Column) -> Column:
        place = F.try_element_at(F.filter(ents, lambda e: (e["first"] == i) & e["label"].isin("GPE", "LOC", "FAC")), F.lit(-1))
        word = _is(tokens, i, r"(?U)^\p{L}+$") & _is(tokens, i, r"(?U)^\p{Lu}")
        state, code = _is(tokens, i + 1, r"^[A-Z]{2,3}$"), lambda j: _is(tokens, j, _POSTCODE).cast("int")
        by_word = F.when(word & state, i + 2 + code(i + 2)).when(word & (code(i + 1) > 0), i + 2).otherwise(street["end"])
        by_place = lambda p: F.when(p.isNotNull(), p["last"] + code(p["last"])).otherwise(by_word)
        return S.let(place, lambda p: F.struct(street["start"].alias("start"), by_place(p).alias("end"), F.when(p.isNotNull(), i).otherwise(-1).alias("taken")))

    return S.let(F.get(after, F.lit(0)), ended)


def is_place_name(tokens: Column, ent: Column) -> Column:
    """Whether all tokens of an entity but punctuation and white space are proper nouns, and there are any."""
    own = F.filter(F.slice(tokens, ent["first"] + 1, ent["last"] - ent["first"]), lambda t: ~t["punct"] & (S.strip(t["text"]) != ""))
    return (F.size(own) > 0) & F.forall(own, lambda t: t["pos"] == "PROPN")


def candidates(text: Column, tokens: Column, ents: Column, address_only: bool = True, offset: Column | None = None) -> Column:
    """FOUND: street addresses, then the entities that are part of none. offset: of the text in the whole it is a chunk of.

    Of places (LOC, FAC), defined terms, implausible spans and what is not a name are left out; of a person's name that ends like a
    building's a place is made; persons and organisations are left out if address_only; a country or city takes the postcode behind it.
    """
    at = offset if offset is not None else F.lit(0)
    one = lambda t, category, start, end: F.struct(t.alias("text"), category.alias("category"), (at + start).cast("int").alias("start"), (at + end).cast("int").alias("end"))

    def address(s: Column) -> Column:
        begin = F.get(tokens, s["start"])["start"]
        return S.let(S.strip(F.regexp_replace(S.strip(_text(text, tokens, s["start"], s["end"])), ",+$", "")), lambda t: one(t, F.lit("Address"), begin, begin + F.length(t)))

    def entity(e: Column) -> Column:
        own, label = _text(text, tokens, e["first"], e["last"]), e["label"]
        with_code = F.when((label == "GPE") & _is(tokens, e["last"], _POSTCODE), e["last"] + 1).otherwise(e["last"])
        place = label.isin("LOC", "FAC")
        building = (label == "PERSON") & S.is_building(own)
        sound = ~S.is_implausible(own) & (~label.isin("LOC", "FAC", "GPE") | is_place_name(tokens, e)) & ~((label == "ORG") & S.is_corporate_suffix(own))
        wanted = F.lit(True) if not address_only else label.isin("LOC", "FAC", "GPE")
        good = label.isin("LOC", "FAC", "GPE", "PERSON", "ORG") & ~S.is_defined_term(own) & (building | (wanted & sound))
        category = F.when(place | building, "Location").when(label == "GPE", "Address").when(label == "ORG", "Entity").otherwise("Individual")
        begin = F.get(tokens, e["first"])["start"]
        return S.let(F.when(building, own).otherwise(_text(text, tokens, e["first"], with_code)), lambda t: F.when(good, one(t, category, begin, begin + F.length(t))))

    def both(s: Column) -> Column:
        free = F.filter(ents, lambda e: ~F.exists(s, lambda x: ((e["first"] < x["own"]) & (e["last"] > x["start"])) | (e["first"] == x["taken"])))
        found = F.concat(F.filter(F.transform(s, address), lambda c: c["text"] != ""), F.filter(F.transform(free, entity), lambda c: c.isNotNull()))
        return F.when(F.size(tokens) > 0, found)

    grown = lambda s: F.transform(s, lambda x: S.let(extended(tokens, ents, x), lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"), y["taken"].alias("taken"), x["end"].alias("own"))))
    return F.coalesce(S.let(S.let(streets(tokens), grown), both), F.expr(f"cast(array() as {FOUND})"))


def tagged(docs: DataFrame, tagger: Tagger, address_only: bool = True, key: str = "doc_id", text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a column found for claims() and items(). The tagger sees chunks: a table with the columns offset and chunk. key is not needed.

    Chunks overlap, and what two of them have found is parted at a seam: the first place from where the second one's own part begins at which both
    have a token and neither has an entity that goes on (else the last one before it). Both have seen what lies around it, so what reaches
    over the seam is found by the first chunk, whole, and left out by the second. Without overlap texts are cut where size says. A text is
    tagged once, however many rows have it.
    """
    own = docs.where(F.col(text).isNotNull()).select(F.md5(F.col(text)).alias("_t"), F.col(text).alias("_text")).groupBy("_t").agg(F.any_value("_text").alias("_text"))
    parts = tagger(chunks(own, "_t", "_text", size, overlap))
    half = overlap // 2
    goes_on = lambda j: F.exists("ents", lambda e: (e["first"] < j) & (j < e["last"]))
    places = F.filter(F.transform("tokens", lambda t, j: F.struct((t["start"] + F.col("offset")).alias("at"), j.alias("j"))), lambda x: F.least(F.abs(x["at"] - F.col("_begin")), F.abs(x["at"] - F.col("_begin") - size)) <= half)
    placed = parts.withColumn("_begin", F.col("own")).select("_t", "_begin", candidates(F.col("chunk"), F.col("tokens"), F.col("ents"), address_only, F.col("offset")).alias("found"), F.transform(F.filter(places, lambda x: ~goes_on(x["j"])), lambda x: x["at"]).alias("_at"))
    in_order = Window.partitionBy("_t").orderBy("_begin")
    after = F.col("_begin") + size

    def seam(common: Column) -> Column:
        return F.coalesce(F.get(F.filter(common, lambda x: x >= after), F.lit(0)), F.try_element_at(F.filter(common, lambda x: x < after), F.lit(-1)), after)

    ahead = F.lead("_at").over(in_order)
    near = lambda c: F.filter(c, lambda x: F.abs(x - after) <= half)
    seams = placed.withColumn("_next", ahead).withColumn("_to", F.when(F.col("_next").isNotNull(), S.let(F.array_sort(F.array_intersect(near("_at"), near("_next"))), seam)))
    seams = seams.withColumn("_from", F.coalesce(F.lag("_to").over(in_order), F.lit(0)))
    kept = seams.select("_t", "_begin", F.filter("found", lambda c: (c["start"] >= F.col("_from")) & (F.col("_to").isNull() | (c["start"] < F.col("_to")))).alias("found"))
    whole = kept.groupBy("_t").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_begin", "found"))), lambda x: x["found"])).alias("_found"))
    joined = docs.withColumn("_t", F.md5(F.col(text))).join(whole, "_t", "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce("_found", F.expr(f"cast(array() as {FOUND})")).alias("found"))
