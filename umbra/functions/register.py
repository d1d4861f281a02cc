"""The library's functions for SQL: temporary functions of one text, and a table function that scans it."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .. import lexicons as L
from .scanner import scanner

_q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
_strip = r"regexp_replace({0}, '(?U)^[\\s\\x1c-\\x1f]+|(?U)[\\s\\x1c-\\x1f]+$', '')"
_list = lambda xs: "array(" + ", ".join(map(_q, xs)) + ")"
_names = len(L.FIRST_NAMES) * len(L.LAST_NAMES)


def _mod(m: int) -> str:
    return f"aggregate(sequence(0, 7), 0L, (a, i) -> (a * 65536 + cast(conv(substring(md5(lower({_strip.format('x')})), i * 4 + 1, 4), 16, 10) as bigint)) % {m})"


_first = f"get({_list(L.FIRST_NAMES)}, cast({_mod(_names)} % {len(L.FIRST_NAMES)} as int))"
_last = f"get({_list(L.LAST_NAMES)}, cast({_mod(_names)} div {len(L.FIRST_NAMES)} as int))"
_letters = "concat(" + ", ".join(
    f"if(n > {(less := sum(26**i for i in range(1, w + 1)))}, char(65 + cast(((n - {1 + less}) div {26**w}) % 26 as int)), '')" for w in range(13, -1, -1)
) + ")"
_squeeze = _strip.format(r"regexp_replace({0}, '(?U)[\\s\\x1c-\\x1f]+', ' ')")
_map = lambda entries: "map(" + ", ".join(_q(x) for kv in entries.items() for x in kv) + ")"


def _country(x: str) -> str:
    key = rf"regexp_replace(lower({_squeeze.format(x)}), '(?U)^the\\s+', '')"
    return f"coalesce({_map({c.lower(): c for c in L.COUNTRIES})}[{key}], {_map(L.COUNTRY_ALIASES)}[{key}])"


def _region(x: str) -> str:
    known = lambda y: f"lower({y}) in ({', '.join(_q(r.lower()) for r in L.REGIONS)})"
    some = f"filter(transform(split({_squeeze.format(x)}, '/'), y -> {_strip.format('y')}), y -> y <> '')"
    return f"if({known(_squeeze.format(x))} or (size({some}) > 1 and forall({some}, y -> {_country('y')} is not null or {known('y')})), {_squeeze.format(x)}, null)"


_some = f"filter(transform(split(x, ','), y -> {_strip.format('y')}), y -> y <> '')"
_tail = _strip.format(rf"regexp_replace(element_at({_some}, -1), '\\d{{4,6}}\\s*$', '')")
_state = rf"{_map(L.STATE_COUNTRIES)}[lower(element_at(split({_tail}, '\\s+'), -1))]"
_address = rf"coalesce({_country('x')}, {_region('x')}, if(size({_some}) > 1, coalesce({_country(_tail)}, {_region(_tail)}, {_state}), null), if(x rlike '(?iU)\\bSingapore\\b', 'Singapore', null), 'Address')"
#: Name, parameters, type and body of each function.
FUNCTIONS = [
    ("fake_name", "x string", "string", f"concat({_first}, ' ', {_last})"),
    ("fake_email", "x string", "string", f"concat(lower(replace({_first}, ' ', '')), '.', lower({_last}), {_mod(10000)}, '@example.com')"),
    ("hashtags", "x string", "string", r"regexp_replace(x, '[\\p{L}\\p{N}]', '#')"),
    ("n_digits", "x string", "int", r"length(regexp_replace(x, '[^\\p{Nd}]', ''))"),
    ("letter_suffix", "n bigint", "string", _letters),
    ("is_numbered_category", "x string", "boolean", r"x like '=%' or x rlike '(?U)\\d\\s*$'"),
    ("literal_category", "x string", "string", f"if(x like '=%', {_strip.format('substring(x, 2)')}, x)"),
    ("should_grey", "category string, placeholder string", "boolean", "category in ('Address', 'Location') and placeholder = 'Address'"),
    ("country_of", "x string", "string", _country("x")),
    ("region_of", "x string", "string", _region("x")),
    ("collapse_address", "x string", "string", _address),
    ("file_extension", "x string", "string", r"lower(regexp_extract(x, '(\\.[^.]+)$', 1))"),
]


_CLAIM = [StructField(n, IntegerType()) for n in ("seq", "tier", "start", "end")] + [StructField(n, StringType()) for n in ("text", "category", "source")]
_LIST = "an entity list is an array of structs of value and category, both strings"


def _listed(argument: AnalyzeArgument | None) -> None:
    kind = argument.dataType if argument is not None else None
    if kind is not None and kind.simpleString() != "void" and not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and [f.dataType.simpleString() for f in kind.elementType] == ["string", "string"]):
        raise ValueError(f"{_LIST}, not {kind.simpleString()}")


def _scanner(entities):
    pairs = tuple((e[0].strip(), (e[1] or "").strip() or "Entity") for e in entities or () if e is not None and e[0] and e[0].strip())
    return scanner(pairs)


@udtf
class ScanText:
    """scan_text(text [, entities]): the claims of a text, for lateral joins. entities: an array of (value, category) structs."""

    @staticmethod
    def analyze(text: AnalyzeArgument, entities: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.isTable or text.dataType.simpleString() not in ("string", "void"):
            raise ValueError("scan_text() takes a string; tables are for scan_table()")
        _listed(entities)
        return AnalyzeResult(schema=StructType(_CLAIM))

    def eval(self, text, entities=None):
        for seq, claim in enumerate(_scanner(entities).claims(text or "")):
            yield seq, *claim


@udtf
class ScanTable:
    """scan_table(table [partition by ...], key, text [, entities]): the claims of every text of a table, each with its key.

    key and text name columns of the table; the result has the key's name and type. A null text has no claims.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, entities: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("scan_table() takes a table")
        columns = {f.name: f for f in rows.dataType.fields}
        for name in (key, text):
            if not name.isConstantExpression or name.value not in columns:
                raise ValueError(f"key and text name columns of the table, which are {', '.join(columns)}")
        if columns[text.value].dataType.simpleString() != "string":
            raise ValueError(f"{text.value} is no string")
        _listed(entities)
        return AnalyzeResult(schema=StructType([StructField(key.value, columns[key.value].dataType), *_CLAIM]))

    def eval(self, row, key, text, entities=None):
        found = _scanner(entities).claims(row[text]) if row[text] is not None else []
        for seq, claim in enumerate(found):
            yield row[key], seq, *claim


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL of this session; their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    spark.udtf.register("scan_text", ScanText)
    spark.udtf.register("scan_table", ScanTable)
    return [f[0] for f in FUNCTIONS] + ["scan_text", "scan_table"]


