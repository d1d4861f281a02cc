"""From raw documents to packed sequences: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import NO_ID, drop_tables, scope, shared_path, stored
from umbra.llm.line_dedup import line_dedup
from umbra.llm.packing import pack
from umbra.llm.quality import judge
from umbra.llm.simhash import simhash_groups
from umbra.llm.substring_dedup import substring_dedup


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of one value a row, in the order of doc_id (null first) and then of the texts; and its name.

    Operators decide on it in place of doc_id, so that each decision comes back to its own row. Where doc_ids are distinct they serve as they are.
    """
    own, (row,) = F.col("doc_id").cast("long"), _fresh(docs, "_row")
    if docs.select(own.alias("id")).groupBy("id").count().where(f"count > 1 or id is null or id = {NO_ID}").isEmpty():
        return docs.withColumn(row, own), row
    # The place in the input parts equal rows of one large group.
    placed = docs.withColumn(row, F.monotonically_increasing_id()).orderBy(own.asc_nulls_first(), "text", row)
    return stored(placed.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _decided(docs: DataFrame, decide, text: str | None = None, default: bool = False) -> DataFrame:
    """docs as decide() leaves them: rows in doc_id, text (and lang, source) to decisions by doc_id.

    Without `text` the rows that decisions name stay as they are. With it, decisions have a column of that name, which takes the place of the
    text; rows without a decision go, or stay with their own text if `default`. Other columns, whatever their names, stay with their rows.
    """
    rows, row = _keyed(docs)
    given = [F.col(row).alias("doc_id"), *(F.col(c) for c in ("text", "lang", "source") if c in docs.columns)]
    found, columns = decide(rows.select(*given)), [F.col(f"`{c}`") for c in docs.columns]
    if text is None:
        return rows.join(found.select(F.col("doc_id").alias(row)), row, "left_semi").select(columns)
    new, hit = _fresh(rows, "_new", "_hit")
    joined = rows.join(found.select(F.col("doc_id").alias(row), F.col(text).alias(new), F.lit(True).alias(hit)), row, "left" if default else "inner")
    joined = joined.withColumn("text", F.when(F.col(hit), F.col(new)).otherwise(F.col("text")))
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(columns) if "n_chars" in docs.columns else joined.select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts among them. Repeated rows are judged each, so all or none of them stay.

    A null or repeated doc_id parts no rows and joins none. An empty table gives none.
    """
    return _decided(docs, lambda d: judge(d).where("kept"))


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like earlier ones go; a document of which no line is left goes with them, and so do null and empty texts.

    Rows that share a doc_id, or have none, are documents of their own, in the order of their texts; of equal rows the first stays. An empty
    table gives none.
    """
    return _decided(docs, lambda d: line_dedup(d).where("n_kept > 0"), "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays; null and empty texts are one group.

    Rows that share a doc_id, or have none, are documents of their own, in the order of their texts. An empty table gives none.
    """
    return _decided(docs, lambda d: simhash_groups(d).where("doc_id = component_id"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go, and documents of which none is left. Where nothing is removed a text stays as it is, white space included.

    Null and empty texts go. Rows that share a doc_id, or have none, are documents of their own, in the order of their texts; of equal rows
    of 20 words or more the first stays. An empty table gives none.
    """
    return _decided(docs, lambda d: substring_dedup(d).where("n_removed > 0"), "kept_text", default=True).where("text <> ''")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences. Repeated rows, and rows without a doc_id or text, are packed each; an empty table gives none."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_repeats), ("simhash_near_dedup", near_copies), ("substring_dedup", substrings), ("packing", packing)]

#: SQL has no tokenizer, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage has stored on its way goes when its result is written, and a result when the next one is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with scope() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
        drop_tables(spark, made + last)
        docs, last = spark.read.parquet(path), [path]
    return docs
