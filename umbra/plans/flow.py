"""Queries of the flow around the detectors: lists, files, segments, review, images, boxes, taggers, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry as G
from ..operators import mask as M
from ..operators import ner
from ..operators import review as R
from ..sources import office, ooxml
from . import samples
from .queries import WORDS, _docs

EXTENSIONS = [".docx", ".XLSX", ".pptx", ".pdf", ".txt", ""]
FONTS = ["Arial", "Times New Roman Bold", "CourierNew-Oblique", "Georgia-BoldItalic", "Consolas", "Calibri Bold", "DejaVuSansMono-BoldOblique", "Garamond Italic"]
#: Originals, categories and placeholders that every document's mapping holds.
PAIRS = [("the", "Client", "Client A"), ("that", "Custom", "<$1\\>"), ("of", "Address", "Address"), ("que", "Name 1", "Name 1")]
#: Words of three made-up texts with parts of speech, and entities as token ranges. {n} is a number.
TAGGED = [
    ("At|{n}|Raffles|Place|,|Singapore|048{n}|we|met|Jane|Tan|of|Acme|Ltd", "ADP NUM PROPN PROPN PUNCT PROPN NUM PRON VERB PROPN PROPN ADP PROPN PROPN", [(5, 6, "GPE"), (9, 11, "PERSON"), (12, 14, "ORG")]),
    ("{n}|The|Esplanade|,|Perth|WA|6000|;|see|Manulife|Tower|or|LTD", "NUM DET PROPN PUNCT PROPN PROPN NUM PUNCT VERB PROPN PROPN CCONJ PROPN", [(9, 11, "PERSON"), (12, 13, "ORG")]),
    ("Jalan|Besar|and|Singapore|048{n}|,|Background|of|Vessel|in|Sentosa", "PROPN PROPN CCONJ PROPN NUM PUNCT NOUN ADP PROPN ADP PROPN", [(0, 2, "GPE"), (3, 4, "GPE"), (6, 7, "LOC"), (8, 9, "ORG"), (10, 11, "FAC")]),
]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _literals(rows: list[str]):
    return F.array(*map(F.lit, rows))


def entity_list(spark, d):
    """Lines of a list with a mark, a heading, blank and quoted lines, longest value first."""
    made = F.when(F.col("s_nationkey") % 5 == 0, "  ").when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit('"'), "s_name", F.lit(', "'), F.lit('"Ltd"""'))).when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("  "), "s_name", F.lit(" , Client "))).otherwise(F.substring("s_name", 1, 14))
    lines = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_no"), made.alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("row_no"), F.lit("﻿Value ,category").alias("line"))
    own = R.entity_lines(lines.unionByName(head)).withColumn("rank", (-F.length("value")).cast("long"))
    return M.numbered(own, [], "rank", ["row_no"], "place").select("place", "value", "category")


def long_entity_list(spark, d):
    """A list of every customer's name, met with sentences by an equi-join."""
    c = _table(spark, d, "customer")
    names = c.selectExpr("c_name as value", "c_mktsegment as category", "c_custkey as row_no")
    texts = c.selectExpr("c_custkey as doc_id", "concat('From ', upper(c_name), 'x to ', lower(c_name), ', or ', c_name, '.') as text")
    return M.claims(texts, names, use_regex=False).select("doc_id", "seq", "start", "text", "category")


def upload_list(spark, d):
    """Files by name and text, and why some are not scanned."""
    o = _table(spark, d, "orders")
    name = F.concat(F.lit("file."), F.col("o_orderkey").cast("string"), F.get(_literals(EXTENSIONS), (F.col("o_orderkey") % len(EXTENSIONS)).cast("int")))
    files = o.select(F.col("o_orderkey").alias("file_index"), name.alias("file_name"), S.extension(name).alias("extension"))
    texts = o.where("o_orderstatus <> 'P'").selectExpr("o_orderkey as file_index", "if(o_orderstatus = 'F', ' \n', o_orderpriority) as text")
    return R.with_reasons(files, texts)


def page_routing(spark, d):
    """Every document as a page: native text in which one letter is lost, and what a recogniser would see of some."""
    pages = _table(spark, d, "documents").select("doc_id", F.translate("text", "eo", "\x01\x02").alias("native"), F.when(F.col("lang") == "en", F.concat(F.lit("seen: "), "text")).alias("recognised"))
    return office.page_texts(pages).select("doc_id", "route", F.md5("text").alias("digest"))


def ocr_languages(spark, d):
    n = _table(spark, d, "nation").join(F.broadcast(_table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    installed = F.filter(F.array(F.lower("n_name"), F.lit("osd"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("r_name"))), lambda x: x.isNotNull())
    return n.select("n_nationkey", office.ocr_languages(F.when(F.col("n_nationkey") > 2, installed).otherwise(F.array(F.lit("osd")))).alias("languages"))


def fonts(spark, d):
    p = _table(spark, d, "part").withColumn("font", F.get(_literals(FONTS), (F.col("p_partkey") % len(FONTS)).cast("int")))
    size, available, needed = F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double"), (F.col("p_partkey") % 70).cast("double")
    return p.select("p_partkey", G.base14(F.col("font"), F.col("p_size")).alias("code"), G.fitted_size(size, available, needed).alias("fitted"), G.guessed_size(size).alias("guessed"), G.line_size(size).alias("line"))


def _slots(spark, d):
    o = _table(spark, d, "orders")
    name = F.concat(F.lit("word/media/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.when(F.col("o_orderkey") % 3 == 0, ".JPG").otherwise(".png"))
    return o.select(F.col("o_custkey").alias("file_index"), name.alias("id"), F.encode("o_orderpriority", "utf-8").alias("content"), name.alias("location"), F.lit(None).cast("string").alias("error"), "o_orderstatus", "o_totalprice")


def image_manifest(spark, d):
    """Equal images of a file in one row."""
    return office.image_manifest(_slots(spark, d)).select("file_index", "digest", "id", F.array_join("all_ids", ",").alias("all_ids"), "count")


def flagged_images(spark, d):
    """Decisions on some rows of the manifest, spread to all copies, with the format of each slot."""
    slots = _slots(spark, d)
    action = F.when(F.col("o_orderstatus") == "F", "replace").when(F.col("o_orderstatus") == "P", "blank")
    decisions = slots.select("file_index", "id", (F.col("o_totalprice") > 200000).alias("include"), action.alias("action"))
    out = office.flagged_images(office.image_manifest(slots), decisions, has_logo=True)
    return out.select("file_index", "id", "action", office.slot_format(F.col("id")).alias("format"))


def _items(spark, d):
    return _table(spark, d, "orders").selectExpr("o_custkey as file_index", "o_orderkey as seq", "o_orderpriority as text", "o_orderstatus as placeholder", "o_totalprice >= 100000 as include", "if(o_orderstatus = 'F', 'Address', 'Client') as category")


def item_ids(spark, d):
    """Items numbered over the batch."""
    return M.with_item_ids(_items(spark, d), "file_index").select("id", "file_index", "seq")


def review_totals(spark, d):
    images = _slots(spark, d).select("file_index", (F.col("o_orderstatus") == "F").alias("include"))
    return R.totals(_items(spark, d).where("file_index % 2 = 1 or include"), images)


def review_round_trip(spark, d):
    """A review as JSON and back: items that leave `include` out are included."""
    s = _table(spark, d, "supplier")
    items = s.selectExpr("s_suppkey as id", "s_suppkey as file_index", "concat(s_name, '.docx') as file_name", "concat(s_name, ' \"é\\n\"') as text", "'Entity' as category", "'list' as source", "s_name as placeholder", "concat('[[', s_name, ']]') as context", "if(s_acctbal > 0, null, false) as include", "if(s_nationkey = 3, 'Sheet 1', null) as sheet")
    files = s.selectExpr("s_suppkey as file_index", "concat('/in/', s_name) as input_file", "concat(s_name, '.docx') as file_name", "'.docx' as extension")
    _, back, _ = R.review_rows(R.review_json(files, items))
    return back.select("id", "file_index", "file_name", "text", "placeholder", "context", "include", "sheet")


def mapping_json(spark, d):
    """The mapping log as one JSON text, in the order first seen."""
    items = _items(spark, d).withColumn("text", F.concat("text", F.lit(" "), "placeholder"))
    return R.log_json(M.mapping_log(items, "file_index"))


def mapping_pairs(spark, d):
    """Each file's mapping: longest originals first, of equals the last placeholder, and those of it that are shaded."""
    items = _items(spark, d).withColumn("placeholder", F.when(F.col("category") == "Address", "Address").otherwise(F.col("placeholder")))
    line = F.transform("pairs", lambda p: F.concat(p["o"], F.lit(">"), p["p"], F.when(p["grey"], "!").otherwise("")))
    return M.mapping(items.where("include"), "file_index").select("file_index", F.array_join(line, "|").alias("pairs"))


def verify_report(spark, d):
    return R.verify_report(_docs(spark, d), WORDS, "doc_id").select("doc_id", "n_leaks", "clean", "any_leak")


def category_flags(spark, d):
    o = _table(spark, d, "orders").selectExpr("o_orderkey", "case o_orderkey % 5 when 0 then concat('= ', o_orderpriority, ' ') when 1 then concat('Name ', o_custkey, ' ') when 2 then 'Location' when 3 then 'Address' else o_orderpriority end as c", "if(o_orderstatus = 'F', 'Address', 'Australia') as p")
    return o.select("o_orderkey", S.is_numbered(F.col("c")).alias("numbered"), S.literal_category(F.col("c")).alias("literal"), S.is_grey(F.col("c"), F.col("p")).alias("grey"))


def category_order(spark, d):
    """Known categories in their order, then others by name, numbered."""
    from .. import lexicons as L

    names = spark.createDataFrame([(c,) for c in L.CATEGORY_ORDER], "category string").unionByName(_table(spark, d, "nation").select(F.col("n_name").alias("category")))
    key = F.struct(S.category_key(F.col("category")).alias("key"), F.col("category").alias("category"))
    listed = names.agg(F.sort_array(F.collect_list(key)).alias("all"))  # categories are few
    return listed.select(F.posexplode("all").alias("place", "c")).select("place", "c.category")


def longest_spans(spark, d):
    """Spans of one file each, of which overlapping ones give way to the longest."""
    s = _table(spark, d, "orders").selectExpr("o_custkey", "struct(cast(o_orderkey * 7 % 60 as int) as start, cast(o_orderkey * 7 % 60 + 1 + o_orderkey % 9 as int) as end) as s")
    kept = s.groupBy("o_custkey").agg(M.longest_spans(F.sort_array(F.collect_list("s"))).alias("kept"))
    return kept.select("o_custkey", F.array_join(F.transform("kept", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias("kept"))


def text_chunks(spark, d):
    return ner.chunks(_docs(spark, d), size=1000).select("doc_id", "offset", F.md5("chunk").alias("digest"))


def _tagged(spark, d):
    """Made-up texts with their tokens and entities, as a tagger gives them."""
    own = _table(spark, d, "supplier").selectExpr("s_suppkey as doc_id", "cast(100 + s_suppkey % 900 as string) as n", "cast(s_suppkey % 3 as int) as kind")
    words = F.split(F.replace(F.get(_literals([t for t, _, _ in TAGGED]), F.col("kind")), F.lit("{n}"), F.col("n")), r"\|")
    tags = F.split(F.get(_literals([p for _, p, _ in TAGGED]), F.col("kind")), " ")
    ents = F.get(F.array(*(F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(c).alias("label")) for a, b, c in e)) for _, _, e in TAGGED)), F.col("kind"))
    own = own.select("doc_id", words.alias("w"), tags.alias("p"), ents.alias("ents")).withColumn("at", M.before(F.transform("w", lambda x: F.length(x) + 1)))
    token = lambda x, i: F.struct(x.alias("text"), F.get("at", i).alias("start"), F.get("p", i).alias("pos"), (F.get("p", i) == "PUNCT").alias("punct"))
    return own.select("doc_id", F.array_join("w", " ").alias("text"), F.transform("w", token).alias("tokens"), "ents")


def tagged_places(spark, d):
    """Streets with what follows them, and the entities that are part of none, with and without persons and organisations."""
    own = _tagged(spark, d)
    found = lambda only: own.select("doc_id", F.lit(only).alias("address_only"), F.posexplode(ner.candidates(F.col("text"), F.col("tokens"), F.col("ents"), only)).alias("seq", "c"))
    return found(True).unionByName(found(False)).select("doc_id", "address_only", "seq", "c.category", "c.start", "c.text")


def tagged_items(spark, d):
    """Items of texts whose addresses come from a tagger instead of the address pattern."""
    own = _tagged(spark, d).withColumn("found", ner.candidates(F.col("text"), F.col("tokens"), F.col("ents")))
    return M.items(own, [("Raffles Place", "Client")], found="found").select("doc_id", "category", "text", "source")


def _boxes(spark, d):
    number = lambda x: f"cast({x} as double)"
    x, y = "o_orderkey * 7 % 60", "o_orderkey * 13 % 60"
    return _table(spark, d, "orders").selectExpr("o_custkey as page", "o_orderkey as id", f"struct({number(x)} as x0, {number(y)} as y0, {number(f'{x} + 5 + o_orderkey % 30')} as x1, {number(f'{y} + 1 + o_orderkey % 9')} as y1) as b", "o_orderpriority as text", "o_orderstatus as status")


def claimed_boxes(spark, d):
    """Of each page's boxes in the order of their ids, those that overlap none kept before."""
    rows = _boxes(spark, d).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", "b"))).alias("all"))
    kept = G.unclaimed(F.transform("all", lambda x: F.struct(x["b"]["x0"].alias("x0"), x["b"]["y0"].alias("y0"), x["b"]["x1"].alias("x1"), x["b"]["y1"].alias("y1"), x["id"].alias("id"))))
    return rows.select("page", F.array_join(F.transform(kept, lambda x: x["id"].cast("string")), ",").alias("kept"))


def best_spans(spark, d):
    b = _boxes(spark, d)
    return G.best_spans(b.where("status = 'F'").select("page", F.col("id").alias("rect_id"), "b"), b.where("status <> 'F'").select("page", F.col("id").alias("span_id"), "b"))


def rect_words(spark, d):
    """Whether the words under a box hold a text as whole words."""
    b = _boxes(spark, d)
    rects = b.where("status = 'F'").selectExpr("page", "id as rect_id", "substring(text, 1, 3 + cast(id % 9 as int)) as original", "b")
    words = b.selectExpr("page", "0 as block", "cast(id % 2 as int) as line", "id as word", "text", "b")
    return G.rect_words(rects, words)


def _cells(spark, d):
    o = _table(spark, d, "orders")
    return o.selectExpr("o_custkey as file_index", "cast(o_orderkey as int) as seg_no", "concat('Sheet ', o_orderkey div 3000) as container", "if(o_orderstatus = 'P', 'f', 's') as cell_type", "if(o_orderkey % 7 = 0, ' ', concat(o_orderpriority, '\\n', o_orderkey)) as text")


def sheet_texts(spark, d):
    """Text of the text cells of each workbook, without formulas and blanks."""
    return office.full_texts(_cells(spark, d)).select("file_index", F.md5("text").alias("digest"))


def sheet_ranges(spark, d):
    return office.sheet_ranges(_cells(spark, d)).select("file_index", "sheet", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def segment_masks(spark, d):
    """Every line of every document masked by its document's mapping; lines in which nothing changes are not written."""
    docs = _docs(spark, d)
    pair = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(o).alias("text"), F.lit(c).alias("category"), F.lit(p).alias("placeholder"), F.lit(o != "que").alias("include")) for i, (o, c, p) in enumerate(PAIRS)))
    reviewed = docs.select("doc_id", F.explode(pair).alias("x")).select("doc_id", "x.*")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "text"))
    out = M.apply(lines, reviewed)
    return out.where("changed").select("doc_id", "seg_no", F.md5("masked").alias("digest"), "any_grey")


def mask_any_case(spark, d):
    """Pages' text masked in any case and across line ends, and how many places were."""
    pairs = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(p).alias("p")) for o, p in (("of the", "<1>"), ("the", "Of The"), ("de la", "\\2$"), ("la", "3"))))
    return _docs(spark, d).withColumn("m", M.masked_any_case(F.col("text"), pairs)).select("doc_id", F.md5("m.text").alias("digest"), F.col("m.n").alias("n"))


def mask_lines(spark, d):
    """Recognised lines masked in any case, with or without white space between the words."""
    pairs = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(p).alias("p")) for o, p in (("of the", "$1"), ("the", "Of"), ("de la", "2"))))
    return _docs(spark, d).select("doc_id", F.md5(M.masked_lines(F.col("text"), pairs)).alias("digest"))


def _made_files(spark, d):
    """Office files made of suppliers: a line for each of three sentences."""
    s = _table(spark, d, "supplier").selectExpr("s_suppkey as file_index", "s_name", "element_at(array('.docx', '.xlsx', '.pptx'), cast(s_suppkey % 3 + 1 as int)) as extension")

    def make(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                index, name, ext = (b.column(c)[i].as_py() for c in ("file_index", "s_name", "extension"))
                rows = [ooxml.Segment(f"Part {k % 2}", "s", f"{t} {name} & <Co>") for k, t in enumerate(("From", "To", "For"))] + [ooxml.Segment("Part 1", "f", f"=A1&{name}"), ooxml.Segment("Part 0", "s", "\t")]
                if ext != ".xlsx":
                    rows = [r for r in rows if r.cell_type == "s"]
                media = {ooxml.MEDIA[ext] + "logo.png": ooxml.blank("PNG", 2), ooxml.MEDIA[ext] + "seal.jpeg": ooxml.blank("JPEG", 8)}
                yield pa.RecordBatch.from_pydict({"file_index": pa.array([index], pa.int64()), "file_name": [f"{name} list{ext}"], "extension": [ext], "content": pa.array([samples.build(ext, sorted(rows, key=lambda r: r.container) if ext != ".docx" else rows, media)], pa.binary())})

    return s.mapInArrow(make, "file_index long, file_name string, extension string, content binary")


def office_texts(spark, d):
    """Text of DOCX, XLSX and PPTX files that are made here, by the readers."""
    return office.full_texts(office.segments(_made_files(spark, d)))


def office_masked(spark, d):
    """The same files masked and read again: names, texts, images that were blanked."""
    files = _made_files(spark, d)
    items = _table(spark, d, "supplier").selectExpr("s_suppkey as file_index", "0 as seq", "s_name as text", "'Client' as category", "concat('$', s_nationkey, '\\\\ X') as placeholder").where("file_index % 10 <> 1")
    manifest = office.image_manifest(office.images(files))
    flagged = office.flagged_images(manifest, manifest.select("file_index", "id", F.lit(True).alias("include"), F.lit("replace").alias("action")).where("file_index % 2 = 0"), has_logo=False)
    done = office.masked_files(files, M.mapping(items, "file_index"), flagged)
    texts = office.full_texts(office.segments(done.withColumn("extension", S.extension(F.col("file_name")))))
    return done.select("file_index", "file_name", "n_items", "n_images", "error").join(texts, "file_index")


def sql_functions(spark, d):
    """The functions and the table function from SQL."""
    from ..functions.register import register

    register(spark)
    _table(spark, d, "customer").createOrReplaceTempView("umbra_customer")
    return spark.sql("""select c_custkey, fake_name(c_name) as name, fake_email(c_name) as email, hashtags(c_name) as tags, n_digits(c_name) as digits, letter_suffix(c_custkey + 1) as letters, is_numbered_category(c_name) as numbered,
      literal_category(concat('= ', c_name)) as literal, should_grey('Address', if(c_nationkey > 9, 'Address', c_name)) as grey, file_extension(concat(c_name, '.TXT')) as ext, s.category, s.start, s.text
      from umbra_customer, lateral scan_text(concat('mail to c', c_custkey, '@example.org in 2025-2026')) s""")


_ALL = (
    entity_list, long_entity_list, upload_list, page_routing, ocr_languages, fonts, image_manifest, flagged_images, item_ids, review_totals, review_round_trip, mapping_json, mapping_pairs, verify_report, category_flags, category_order,
    longest_spans, text_chunks, tagged_places, tagged_items, claimed_boxes, best_spans, rect_words, sheet_texts, sheet_ranges, segment_masks, mask_any_case, mask_lines, office_texts, office_masked, sql_functions,
)
QUERIES = {f.__name__: f for f in _ALL}
