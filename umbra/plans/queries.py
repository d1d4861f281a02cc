"""One query per operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import mask as M

ENTITIES = [("Acme Holdings 7 Pte Ltd", "Client"), ("Acme Holdings", "Entity"), ("Acme", "=Azure")]
#: Frequent words of the documents, as a list to find and to mask.
WORDS = [("therefore", "Entity"), ("the", "Client"), ("of", "=Azure"), ("que", "Name 1")]
#: Makes every detector find something: the same text in both engines.
MEMO = """concat('Invoice for Acme Holdings ', cast(c_nationkey as {s}), ' Pte Ltd re ', c_name,
 ', UEN ', lpad(cast(c_custkey as {s}),9,'0'), 'A, ABN 34 009 200 ', lpad(cast(c_custkey % 1000 as {s}),3,'0'),
 ', tel +65 8', lpad(cast(c_custkey % 1000 as {s}),3,'0'), '-', lpad(cast((c_custkey*7) % 10000 as {s}),4,'0'),
 ', mail user', cast(c_custkey as {s}), '@acme',
 case when c_custkey % 2 = 0 then '' else cast(c_nationkey as {s}) end, '.example.com, at ',
 cast(1 + c_custkey % 99 as {s}), ' Raffles Place, Singapore ', lpad(cast(c_custkey as {s}),6,'0'), '. FY 2025-2026.')"""
ADDRESSES = [
    "{n} Raffles Place, Singapore 0{n}", "{n} The Esplanade, Perth WA 6000", "{n} The Esplanade, Perth WA {n}, Australia", "{n} Rose Street", "Taiwan", "the United Kingdom", "UK", "U.S.A.",
    "Middle  East/Africa", "Australia/New Zealand", "Singapore {n}", "Manulife Tower {n}", "the Netherlands", "{n} Rue X, France/Nowhere", "{n} Road, Asia",
]
TERMS = ["Vessel", "Cyan Vessel {n} Holdings", "LTD", "Co.", "Acme {n} Ltd", "{n} Manulife Tower", "a 1 b 2 c {n}", "two\n{n} lines", "x" * 57 + "{n}", "(Background)", "Q1", "Tower of London {n}"]
RANGES = ["{n}-2026", "2025-{n}", "{n}-0018", "1999.2000", "2026 {n}", "2020-2020", "abc {n}", "{n} {n}"]
NAMES = ["ORA_Financials {n}.xlsx", "Cyan_group_listing-{n}.docx", "Cyanide {n}.PDF", "{n} Bed-Rock plan.docx", "bedrock.{n}.docx", "Rock Bed Rock Bed {n}"]
#: Two of which begin alike: the longer one goes first.
NAME_PAIRS = [("Bed Rock", "Azure"), ("ORA", "Onyx Ridge"), ("Rock", "X"), ("Cyan", "$1")]


def spread(texts: DataFrame) -> DataFrame:
    """texts over all cores where its files have fewer parts than that, as one small file has. Larger inputs stay as they are read."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def _memos(spark: SparkSession, d: str) -> DataFrame:
    keys = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"))
    return keys.selectExpr("c_custkey as doc_id", MEMO.format(s="string") + " as text")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of documents, and memos, whose ids are below 0."""
    return _docs(spark, d).unionByName(_memos(spark, d).withColumn("doc_id", -1 - F.col("doc_id")))


def _filled(spark: SparkSession, d: str, rows: list[str], n: str) -> DataFrame:
    """A customer each: i and one of the rows in turn, its {n} filled in."""
    x = F.replace(F.get(F.array(*map(F.lit, rows)), (F.col("c_custkey") % len(rows)).cast("int")), F.lit("{n}"), F.expr(n))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("i"), x.alias("x"))


def _found(df: DataFrame, *detectors: str) -> DataFrame:
    """Claims of the last of the detectors; those before it claim their places first."""
    return M.claims(df, detectors=detectors).where(F.col("category") == detectors[-1]).select("doc_id", F.col("start").cast("int").alias("start"), "text")


def scan_email(spark, d):
    return _found(_docs(spark, d), "Email")


def scan_phone(spark, d):
    return _found(_docs(spark, d), "Email", "Phone")


def scan_uen(spark, d):
    return _found(_corpus(spark, d), "Email", "Phone", "UEN")


def scan_abn(spark, d):
    return _found(_corpus(spark, d), "Email", "Phone", "UEN", "ABN")


def scan_sg_address(spark, d):
    return _found(_corpus(spark, d), "Email", "Phone", "UEN", "ABN", "Address")


def scan_known_entities(spark, d):
    return M.claims(_docs(spark, d), WORDS, use_regex=False).groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def claims_resolved(spark, d):
    return M.claims(_memos(spark, d), ENTITIES).select("doc_id", "seq", "tier", "start", "end", "text", "category")


def distinct_items(spark, d):
    out = M.items(_memos(spark, d).withColumn("text", F.concat("text", F.lit("\n"), "text")))
    return out.select("doc_id", "category", "text")


def placeholders_scrambled(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    mail = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@acme.example.com"))
    return c.select("c_custkey", S.fake_name(F.col("c_name")).alias("name"), S.fake_email(mail).alias("email"))


def placeholders_lettered(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = s.select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("seq"), F.col("s_name").alias("text"), F.col("n_name").alias("category"), F.lit("ner").alias("source"), F.col("s_name").alias("group_key"))
    return M.with_placeholders(found).select("doc_id", "category", "placeholder")


def redact_hash(spark, d):
    return _corpus(spark, d).select("doc_id", F.md5(S.hashtags(F.col("text"))).alias("redacted_md5"))


def address_collapse(spark, d):
    return _filled(spark, d, ADDRESSES, "lpad(cast(c_custkey as string), 5, '0')").select("i", S.collapse_address(F.col("x")).alias("address"))


def year_range(spark, d):
    return _filled(spark, d, RANGES, "cast(1990 + c_custkey % 50 as string)").select("i", S.is_year_range(F.col("x")).alias("is_range"), S.digits(F.col("x")).alias("n_digits"))


def plausibility_flags(spark, d):
    x = F.col("x")
    flags = [S.is_building(x).alias("building"), S.is_defined_term(x).alias("defined"), S.is_corporate_suffix(x).alias("suffix"), S.is_implausible(x).alias("implausible")]
    return _filled(spark, d, TERMS, "cast(c_custkey as string)").select("i", *flags)


def context_snippet(spark, d):
    return M.items(_docs(spark, d)).where("category = 'Email'").select("doc_id", "text", "context")


def _segments(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "text"))


def segment_offsets(spark, d):
    out = M.segment_offsets(_segments(spark, d), "doc_id", "seg_no")
    return out.select("doc_id", F.col("seg_no").cast("int").alias("seg_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def sheet_lookup(spark, d):
    ranges = M.segment_offsets(_segments(spark, d), "doc_id", "seg_no").withColumn("name", F.concat(F.lit("line "), F.col("seg_no").cast("string")))
    listed = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "name"))).alias("ranges"))
    hits = _found(_docs(spark, d), "Email")
    return hits.join(listed, "doc_id").select("doc_id", "start", M.locate(F.col("start"), F.col("ranges")).alias("sheet"))


def _reviewed(spark, d):
    return M.with_placeholders(M.items(_memos(spark, d), ENTITIES))


def mask_text(spark, d):
    pairs = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(p).alias("p")) for o, p in (("that", "<$1\\>"), ("the", "Client A"), ("que", "Name 1"), ("of", "Azure"))))
    return _docs(spark, d).select("doc_id", F.md5(M.masked(F.col("text"), pairs)).alias("masked_md5"))


def apply_review(spark, d):
    """Masked memos."""
    return M.apply(_memos(spark, d), _reviewed(spark, d)).select("doc_id", "masked", "changed", "any_grey")


def mapping_log(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey as doc_id", "o_orderkey as seq", "o_orderpriority as text", "o_orderstatus as placeholder")
    return M.mapping_log(o).select("original", "placeholder", F.col("at.doc_id").alias("first_doc"), F.col("at.seq").alias("first_seq"))


def review_merge(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    items = c.selectExpr("c_custkey as id", "c_name as placeholder")
    return M.review(items, c.where("c_acctbal < 3000").selectExpr("c_custkey as id", "c_mktsegment <> 'MACHINERY' as include", "case when c_nationkey = 5 then 'X' end as placeholder"))


def sanitize_names(spark, d):
    pairs = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(p).alias("p")) for o, p in sorted(NAME_PAIRS, key=lambda x: -len(x[0]))))
    stem = F.regexp_extract("x", r"^(.*?)(\.[^.]+)?$", 1)
    return _filled(spark, d, NAMES, "cast(c_custkey as string)").select("i", F.concat(M.sanitize_name(stem, pairs), S.extension(F.col("x"))).alias("name"))


def verify_leaks(spark, d):
    return M.leaks(_docs(spark, d), WORDS).select("doc_id", "n_leaks")


def verify_clean(spark, d):
    return M.verify(_docs(spark, d), WORDS).where("clean").select("doc_id")


def category_summary(spark, d):
    both = M.claims(_docs(spark, d)).unionByName(M.claims(_memos(spark, d), ENTITIES))
    return M.by_category(both).orderBy(S.category_key(F.col("category")))


def blob_dedupe(spark, d):
    return M.dedupe_blobs(_docs(spark, d), F.col("text"), "doc_id")


def usable_text(spark, d):
    """The verdict on whole texts in which one letter is lost to control characters, as a broken font does."""
    return _docs(spark, d).select("doc_id", S.is_usable(F.translate("text", "e", "\x01")).alias("usable"))


def usable_documents(spark, d):
    """The verdict on the whole unchanged text of every document."""
    return _docs(spark, d).select("doc_id", S.is_usable(F.col("text")).alias("usable"))


def ocr_lines(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "l_orderkey as block", "l_suppkey % 2 as par", "cast(l_quantity as int) % 2 as line", "l_linenumber as word", "concat(l_returnflag, cast(l_partkey as string)) as text",
        "cast(l_quantity as int) * 2 as conf", "cast(l_partkey as int) as left", "cast(l_suppkey as int) as top", "cast(l_quantity as int) as width", "l_linenumber as height")
    return M.ocr_lines(li)


def zip_names(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "concat(cast(o_custkey as string), '.txt') as name")
    return M.zip_names(o, "name", "o_orderkey").select("o_orderkey", "zip_name")


_ALL = (
    scan_email, scan_phone, scan_uen, scan_abn, scan_sg_address, scan_known_entities, claims_resolved, distinct_items, placeholders_scrambled, placeholders_lettered, redact_hash, address_collapse,
    year_range, plausibility_flags, context_snippet, segment_offsets, sheet_lookup, mask_text, apply_review, mapping_log, review_merge, sanitize_names, verify_leaks, verify_clean, category_summary,
    blob_dedupe, usable_text, usable_documents, ocr_lines, zip_names,
)
QUERIES = {f.__name__: f for f in _ALL}
