"""Scalar functions of text as built-in Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L

SPACE = r"(?U)[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE + "+", " "))


def table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


def quote(text: Column) -> Column:
    """A pattern that matches text literally."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def literal(text: Column) -> Column:
    """A replacement that inserts text as it is."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _hash_mod(text: Column, m: int) -> Column:
    """The md5 of the folded text, as a 128-bit number, modulo m: Horner over its eight 16-bit digits."""
    step = lambda h: F.aggregate(
        F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda a, i: (a * 65536 + F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("long")) % m
    )
    return let(F.md5(F.lower(strip(text))), step)


def _names(text: Column, body) -> Column:
    n = len(L.FIRST_NAMES)
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    return let(_hash_mod(text, n * len(L.LAST_NAMES)), lambda r: body(pick(L.FIRST_NAMES, r % n), pick(L.LAST_NAMES, F.floor(r / n))))


def fake_name(text: Column) -> Column:
    return _names(text, lambda a, b: F.concat_ws(" ", a, b))


def fake_email(text: Column) -> Column:
    """As fake_name; a blank in the last name stays, as it does in the results to match."""
    number = _hash_mod(text, 10000).cast("string")
    return F.concat(_names(text, lambda a, b: F.concat(F.lower(F.replace(a, F.lit(" "), F.lit(""))), F.lit("."), F.lower(b))), number, F.lit("@example.com"))


def hashtags(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{L}\p{N}]", "#")


def country(text: Column) -> Column:
    key = F.regexp_replace(F.lower(squeeze(text)), r"(?U)^the\s+", "")
    return F.coalesce(table({x.lower(): x for x in L.COUNTRIES})[key], table(L.COUNTRY_ALIASES)[key])


def region(text: Column) -> Column:
    """The squeezed text if it is a region, or countries and regions joined by slashes; else null."""
    known = lambda x: F.lower(x).isin([r.lower() for r in L.REGIONS])

    def judged(t: Column) -> Column:
        some = F.filter(F.transform(F.split(t, "/"), strip), lambda p: p != "")
        return F.when(known(t) | ((F.size(some) > 1) & F.forall(some, lambda p: country(p).isNotNull() | known(p))), t)

    return let(squeeze(text), judged)


def collapse_address(text: Column) -> Column:
    """A country or region if that is all that is left of an address, else the word Address; never a part of an address."""
    some = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    tail = strip(F.regexp_replace(F.element_at(some, -1), r"\d{4,6}\s*$", ""))
    state = table(L.STATE_COUNTRIES)[F.lower(F.element_at(F.split(tail, r"\s+"), -1))]
    of_tail = F.when(F.size(some) > 1, F.coalesce(country(tail), region(tail), state))
    named = F.when(text.rlike(r"(?iU)\bSingapore\b"), F.lit("Singapore"))
    return F.coalesce(country(text), region(text), of_tail, named, F.lit("Address"))


def is_grey(category: Column, placeholder: Column) -> Column:
    return category.isin("Address", "Location") & (placeholder == "Address")


def is_numbered(category: Column) -> Column:
    return category.startswith("=") | category.rlike(r"(?U)\d\s*$")


def literal_category(category: Column) -> Column:
    return F.when(category.startswith("="), strip(F.substring(category, 2, 1 << 20))).otherwise(category)


def letters(n: Column) -> Column:
    """1 to A, 26 to Z, 27 to AA and so on, for any long above 0."""
    out = F.lit("")
    for width in range(14):
        # the letters of longer numbers: n less the count of shorter ones, in base 26
        less = sum(26**i for i in range(1, width + 1))
        digit = F.call_function("div", n.cast("long") - F.lit(1 + less), F.lit(26**width)) % 26
        out = F.concat(F.when(n > less, F.char((65 + digit).cast("int"))).otherwise(F.lit("")), out)
    return out


def snippet(text: Column, target: Column, window: int = 45) -> Column:
    """The first occurrence as prefix[[target]]suffix with `window` characters on either side; null if there is none."""

    def around(at: Column) -> Column:
        begin, end = F.greatest(at - window, F.lit(1)), at + F.length(target)
        left = F.concat(F.when(at - window > 1, F.lit("…")).otherwise(""), F.substring(text, begin, at - begin))
        right = F.concat(F.substring(text, end, F.lit(window)), F.when(end + window - 1 < F.length(text), F.lit("…")).otherwise(""))
        return F.when(at > 0, F.concat(left, F.lit("[["), target, F.lit("]]"), right))

    return let(F.position(target, text), around)


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))


def is_year_range(text: Column) -> Column:
    sep = f"[ .{L.DASHES}]"
    a, b = (F.regexp_extract(text, rf"^(\d{{4}}){sep}(\d{{4}})$", i) for i in (1, 2))
    x, y = F.try_to_number(a, F.lit("9999")).cast("int"), F.try_to_number(b, F.lit("9999")).cast("int")
    return F.coalesce(x.between(1900, 2099) & y.between(1900, 2099) & (y - x).between(0, 1), F.lit(False))


def _bare(text: Column, marks: str) -> Column:
    return F.lower(strip(F.regexp_replace(strip(text), f"^[{marks}]+|[{marks}]+$", "")))


def is_building(text: Column) -> Column:
    last = F.element_at(F.split(strip(text), SPACE + "+"), -1)
    return F.lower(F.regexp_replace(last, r"^[.,()\[\]]+|[.,()\[\]]+$", "")).isin(L.BUILDING_WORDS)


def is_defined_term(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip(text), r"""^[.,;:()\[\]"']+|[.,;:()\[\]"']+$""", "")).isin(L.DEFINED_TERMS)


def is_corporate_suffix(text: Column) -> Column:
    return _bare(text, r".,;:()\[\]").isin(L.CORPORATE_SUFFIXES)


def is_implausible(text: Column) -> Column:
    return text.contains("\n") | (F.length(text) > 60) | (F.size(F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0))) >= 3)


def is_usable(text: Column) -> Column:
    """Not blank, and under a tenth of what is not white space are control characters."""
    marks = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0E-\x1B]", ""))
    solid = F.length(F.regexp_replace(text, SPACE, ""))
    return (solid > 0) & (marks / F.greatest(solid, F.lit(1)) < 0.1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def flexible(value: Column) -> Column:
    """A pattern for a known entity: any case, any white space or none between its words, no ASCII word character at either end."""
    words = F.filter(F.split(value, SPACE + "+"), lambda w: w != "")
    return F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9_])"), F.array_join(F.transform(words, quote), r"(?U:[\s\x1c-\x1f]*)"), F.lit("(?![A-Za-z0-9_])"))


def flexible_text(value: str) -> str:
    """flexible() of a constant, as text."""
    words = [w for w in re.split(r"[\s\x1c-\x1f]+", value) if w]
    quoted = ["\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words]
    return "(?iu)(?<![A-Za-z0-9_])" + r"(?U:[\s\x1c-\x1f]*)".join(quoted) + "(?![A-Za-z0-9_])"


def category_key(category: Column) -> Column:
    """Sorts known categories in their order and the others after them by name."""
    place = F.array_position(F.array(*map(F.lit, L.CATEGORY_ORDER)), category)
    return F.struct(F.when(place > 0, place).otherwise(len(L.CATEGORY_ORDER) + 1).alias("place"), category.alias("name"))


def placeholder(category: Column, text: Column, source: Column, n: Column) -> Column:
    """What replaces the n-th group of a category."""
    kind = table(L.GENERATORS)[category]
    return (
        F.when((source == "list") & is_numbered(category), literal_category(category))
        .when(kind == "name", fake_name(text)).when(kind == "hash", hashtags(text)).when(kind == "address", collapse_address(text)).when(kind == "email", fake_email(text))
        .otherwise(F.concat(category, F.lit(" "), letters(n)))
    )
