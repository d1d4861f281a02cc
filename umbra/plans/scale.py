"""Queries of what has to hold at any size: long lists, sparse keys, many names, every file's verdict, tables scanned from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mask as M
from ..operators import ner
from ..operators import numbering as N
from ..operators import review as R
from ..sources import office
from .flow import EXTENSIONS, _literals, _table
from .queries import ADDRESSES, ENTITIES, WORDS, _docs, _filled, _memos


def _words(spark: SparkSession, d: str) -> DataFrame:
    """A long list: every word of five ASCII letters or more in the English documents, with a category by its length."""
    en = _table(spark, d, "documents").where("lang = 'en'")
    found = en.select(F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, '(?<![A-Za-z0-9_])[A-Za-z]{5,}(?![A-Za-z0-9_])', 0)"))).alias("w"))
    own = found.select(F.lower("w").alias("value")).distinct()
    return own.select("value", F.when(F.length("value") % 2 == 0, "Entity").otherwise("Client").alias("category"), F.xxhash64("value").alias("row_no"))


def known_words(spark, d):
    """How many words of a list of thousands each document holds."""
    return M.verify(_docs(spark, d), _words(spark, d)).select("doc_id", "n_leaks", "clean")


def known_word_claims(spark, d):
    """The places of a list of thousands in every document, by category."""
    found = M.claims(_docs(spark, d), _words(spark, d), use_regex=False)
    return found.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.countDistinct("group_key").alias("n_words"))


def item_ids_hashed(spark, d):
    """Items numbered over a batch whose keys are digests."""
    o = _table(spark, d, "orders").select(F.md5(F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderkey").alias("seq"))
    return M.with_item_ids(o, "file").select("id", "file", "seq")


def item_ids_alike(spark, d):
    """Items numbered over a batch whose keys begin alike, as addresses do; a third of them have one key."""
    key = F.when(F.col("o_orderkey") % 3 == 0, "https://example.org/in/").otherwise(F.concat(F.lit("https://example.org/in/"), F.col("o_custkey").cast("string")))
    o = _table(spark, d, "orders").select(key.alias("file"), F.col("o_orderkey").alias("seq"))
    return M.with_item_ids(o, "file").select("id", "file", "seq")


def folder_names(spark, d):
    """Names for one folder, many alike, some of which look as if they had been numbered."""
    stem = F.concat(F.lit("f"), (F.col("o_custkey") % 100).cast("string"))
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat(stem, F.lit(" ("), (F.col("o_orderkey") % 7).cast("string"), F.lit(").txt"))).otherwise(F.concat(stem, F.lit(".txt")))
    return N.folder_names(_table(spark, d, "orders").select("o_orderkey", name.alias("name")), "name", "o_orderkey").select("o_orderkey", "folder_name")


def verify_files(spark, d):
    """A verdict for every document as a file: some are PDF or broken, so that nothing can be said of them."""
    ext = F.get(_literals(EXTENSIONS), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    files = _docs(spark, d).select(F.col("doc_id").alias("file_index"), ext.alias("extension"), F.lit("").alias("content"), "text", ((F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 6 < 3)).alias("broken"))
    read = files.where("file_index % 6 < 3")
    lines = read.where("not broken").select("file_index", F.posexplode(F.split("text", "\n")).alias("seg_no", "text")).select("file_index", "seg_no", F.lit("s").alias("cell_type"), "text", F.lit(None).cast("string").alias("error"))
    found = lines.unionByName(read.where("broken").select("file_index", F.lit(None).cast("int").alias("seg_no"), F.lit(None).cast("string").alias("cell_type"), F.lit(None).cast("string").alias("text"), F.lit("BadZipFile: no zip").alias("error")))
    whole = office.with_texts(files.drop("text", "broken"), found)
    return R.verify_files(whole, WORDS).select("file_index", "verdict", "n_leaks", "reason")


def sql_addresses(spark, d):
    """Countries, regions and collapsed addresses by SQL functions."""
    from ..functions.register import register

    register(spark)
    rows = _filled(spark, d, ADDRESSES, "lpad(cast(c_custkey as string), 5, '0')")
    return rows.selectExpr("i", "country_of(x) as country", "region_of(x) as region", "collapse_address(x) as address")


def sql_scan(spark, d):
    """All five categories and a list, by the table function over a table."""
    from ..functions.register import register

    register(spark)
    _memos(spark, d).createOrReplaceTempView("umbra_memos")
    listed = "array(" + ", ".join(f"named_struct('value', '{v}', 'category', '{c}')" for v, c in ENTITIES) + ")"
    return spark.sql(f"select doc_id, seq, tier, start, end, text, category from scan_table(table(umbra_memos) partition by (doc_id), 'doc_id', 'text', {listed})")


def _benchmark_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A mapping of every word of the benchmark passages of four ASCII letters or more."""
    words = _table(spark, d, "benchmark").select(F.explode(F.expr(r"regexp_extract_all(text, '(?<![A-Za-z0-9_])[a-z]{4,}(?![A-Za-z0-9_])', 0)")).alias("text")).distinct()
    return words.select("text", F.lit("Client").alias("category"), F.concat(F.lit("<"), F.upper("text"), F.lit(">")).alias("placeholder"), F.xxhash64("text").alias("seq"))


def mask_many(spark, d):
    """Every document masked by one mapping of many entries, through an index of their words."""
    docs = _docs(spark, d).withColumn("batch", F.lit(1))
    reviewed = _benchmark_pairs(spark, d).withColumn("batch", F.lit(1))
    return M.apply(docs, reviewed, "batch", many=True).select("doc_id", F.md5("masked").alias("digest"), "changed")


def capitals():
    """A rule as a model: letters, digits and other characters are tokens; two or more capitalised words in a row are a person."""
    import re

    def one(text: str) -> tuple[list[dict], list[dict]]:
        tokens = [{"text": m[0], "start": m.start(), "pos": "PROPN" if re.fullmatch("[A-Z][a-z]+", m[0]) else "NUM" if m[0].isdigit() else "NOUN" if m[0].isalpha() else "PUNCT", "punct": not m[0].isalnum()} for m in re.finditer(r"[A-Za-z]+|[0-9]+|[^ \t\n\x0b\f\r]", text)]
        ents, at = [], 0
        while at < len(tokens):
            end = at
            while end < len(tokens) and tokens[end]["pos"] == "PROPN" and (end == at or (tokens[end]["start"] == tokens[end - 1]["start"] + len(tokens[end - 1]["text"]) + 1 and text[tokens[end]["start"] - 1] == " ")):
                end += 1
            if end - at > 1:
                ents.append({"first": at, "last": end, "label": "PERSON"})
            at = max(end, at + 1)
        return tokens, ents

    return lambda texts: [one(t) for t in texts]


def tagged_documents(spark, d):
    """Names in all documents, by a model that workers load, over chunks that overlap."""
    found = ner.tagged(_docs(spark, d), ner.provider(capitals, 100_000), False, size=1_000, overlap=400)
    return found.select("doc_id", F.posexplode("found").alias("seq", "f")).where("f.category = 'Individual'").select("doc_id", "f.start", "f.text")


_ALL = (tagged_documents, known_words, known_word_claims, item_ids_hashed, item_ids_alike, folder_names, verify_files, sql_addresses, sql_scan, mask_many)
QUERIES = {f.__name__: f for f in _ALL}
