"""Scan, review, apply and verify as tables, and the files that people edit in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import office
from ..sources.folder import write_folder
from . import mask as M
from . import ner

ITEMS = "id long, file_index long, file_name string, text string, category string, source string, placeholder string, context string, include boolean, sheet string"
IMAGES = "file_index long, id string, include boolean, action string"
FILES = "file_index long, input_file string, file_name string, extension string"
REVIEW = ", ".join(f"{n} array<struct<{', '.join(c.replace(' ', ':', 1) for c in s.split(', '))}>>" for n, s in (("files", FILES), ("items", ITEMS), ("images", IMAGES)))


def entity_lines(lines: DataFrame, value: str = "line") -> DataFrame:
    """value, category, row_no of lines of a list: a line each, of one or two quoted or plain cells; row_no orders them.

    A byte order mark, blank lines and a heading (first cell `value`) are dropped.
    """
    line = F.regexp_replace(F.col(value), r"^\x{FEFF}", "")
    cells = F.from_csv(line, "value string, category string", {"mode": "PERMISSIVE", "escape": '"'})
    rows = lines.withColumn("_c", cells).select(F.col("_c.value").alias("value"), F.col("_c.category").alias("category"), "row_no").where(S.strip(F.coalesce("value", F.lit(""))) != "")
    first = rows.agg(F.min(F.struct("row_no", "value")).alias("f")).select("f.*")
    heading = first.where(F.lower(S.strip(F.col("value"))) == "value").select("row_no")
    return M.entity_rows(rows.join(F.broadcast(heading), "row_no", "left_anti"))  # the heading is one row at most


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """value, category, row_no of a CSV file in UTF-8, by the rules of entity_lines(); quoted cells may hold line feeds."""
    rows = spark.read.csv(path, schema="value string, category string", multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.withColumn("row_no", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace("value", r"^\x{FEFF}", ""))
    rows = rows.where(S.strip(F.coalesce("value", F.lit(""))) != "")
    first = rows.agg(F.min(F.struct("row_no", "value")).alias("f")).select("f.*")
    heading = first.where(F.lower(S.strip(F.col("value"))) == "value").select("row_no")
    return M.entity_rows(rows.join(F.broadcast(heading), "row_no", "left_anti"))


def with_reasons(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files with skip_reason, null where a file is scanned. files: file_index, file_name, extension; texts: file_index, text."""
    return files.join(texts.select("file_index", F.col("text").alias("_t")), "file_index", "left").withColumn("skip_reason", office.skip_reason(F.col("extension"), F.col("_t"))).drop("_t")


def scan(texts: DataFrame, entities: M.Entities = (), use_regex: bool = True, tagger: ner.Tagger | None = None, address_only: bool = True, sheets: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Review items of a batch: ITEMS. texts: file_index, file_name, text; sheets: of office.sheet_ranges(); keys: the batch's file_index column, where that is at hand.

    Placeholders are given over the whole batch, ids in the order of files and of claims within a file.
    """
    own, found = texts.select("file_index", "file_name", "text"), None
    if tagger is not None:
        own, found = ner.tagged(own, tagger, address_only, "file_index"), "found"
    items = M.items(own, entities, use_regex, "file_index", found=found)
    keys = texts.select("file_index") if keys is None else keys
    named = M.with_item_ids(M.with_placeholders(items, "file_index", keys), "file_index", keys)
    named = named.join(texts.select("file_index", "file_name"), "file_index")
    if sheets is not None:
        # The first place of an item's text, not that of the claim.
        ranges = sheets.groupBy("file_index").agg(F.collect_list(F.struct("start", "end", F.col("sheet").alias("name"))).alias("_r"))
        at = texts.select("file_index", F.col("text").alias("_whole"))
        named = named.join(at, "file_index").join(ranges, "file_index", "left").withColumn("sheet", M.locate(F.position(F.col("text"), F.col("_whole")) - 1, F.col("_r")))
    else:
        named = named.withColumn("sheet", F.lit(None).cast("string"))
    return named.select("id", "file_index", "file_name", "text", "category", "source", "placeholder", "context", F.lit(True).alias("include"), "sheet")


def review_json(files: DataFrame, items: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row, one column `value`: the review of a batch as JSON, for a person to edit. What a person edits is small by nature."""
    names = lambda s: [c.split()[0] for c in s.split(", ")]

    def listed(rows: DataFrame, schema: str, order: str) -> DataFrame:
        cols = [c for c in names(schema) if c in rows.columns]
        each = rows.select(F.col(order).alias("_o"), F.struct(*cols).alias("_s"))
        return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_s"))), lambda x: x["_s"]).alias("rows"))

    out = listed(files, FILES, "file_index").select(F.col("rows").alias("files")).crossJoin(listed(items, ITEMS, "id").select(F.col("rows").alias("items")))  # one row each
    empty = F.expr(f"cast(array() as array<struct<{', '.join(c.replace(' ', ':', 1) for c in IMAGES.split(', '))}>>)")
    out = out.withColumn("images", empty) if images is None else out.crossJoin(listed(images, IMAGES, "id").select(F.col("rows").alias("images")))
    return out.select(F.to_json(F.struct("files", "items", "images"), {"ignoreNullFields": "true"}).alias("value"))


def parsed_review(value: Column) -> Column:
    return F.from_json(value, REVIEW)


def review_rows(reviews: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, items and images of a review as JSON. Items and images without `include` are included."""
    own = reviews.select(parsed_review(F.col(value)).alias("r"))
    one = lambda name: own.select(F.explode(f"r.{name}").alias("x")).select("x.*")
    known = lambda df: df.withColumn("include", F.coalesce("include", F.lit(True)))
    return one("files"), known(one("items")), known(one("images"))


def read_review(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return review_rows(spark.read.text(path, wholetext=True))


def _values(rows: DataFrame, section: str, place: int, order: Column, schema: str) -> DataFrame:
    cols = [n for n in (c.split()[0] for c in schema.split(", ")) if n in rows.columns]
    return rows.select(F.lit(place).alias("place"), order.alias("order"), F.lit(section).alias("section"), F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("value"))


def _document(values: DataFrame, path: str, sections: tuple[str, ...]) -> None:
    """Values by place and order, written by their tasks; the commit joins them."""
    folder, _, name = path.rpartition("/")
    nothing = F.lit(None)
    rows = values.orderBy("place", "order").select(nothing.cast("string").alias("path"), nothing.cast("binary").alias("content"), "section", "value")
    write_folder(rows, folder or ".", name, sections)


def write_review(path: str, files: DataFrame, items: DataFrame, images: DataFrame | None = None) -> int:
    """The review as a JSON file, a line an entry; how many items it has. Tasks write it in order, so no row holds a batch."""
    counted = Observation("items")
    parts = [_values(files, "files", 0, F.col("file_index"), FILES), _values(items.observe(counted, F.count(F.lit(1)).alias("n")), "items", 1, F.col("id"), ITEMS)]
    if images is not None:
        ids = images.withColumn("_n", F.monotonically_increasing_id())
        parts.append(_values(ids, "images", 2, F.col("_n"), IMAGES))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    _document(values, path, ("files", "items", "images"))
    return counted.get["n"]


def write_log(path: str, log: DataFrame) -> None:
    """A mapping log as a JSON array, in the order first seen. log: of M.mapping_log()."""
    rows = log.select(F.lit(0).alias("place"), F.col("at").alias("order"), F.lit("").alias("section"), F.to_json(F.struct("original", "placeholder"), {"ignoreNullFields": "false"}).alias("value"))
    _document(rows, path, ("",))


def log_json(log: DataFrame) -> DataFrame:
    """One row, one column `value`: original and placeholder in the order first seen."""
    rows = F.sort_array(F.collect_list(F.struct("at", "original", "placeholder")))
    pairs = F.transform(rows, lambda x: F.struct(x["original"].alias("original"), x["placeholder"].alias("placeholder")))
    return log.agg(F.to_json(pairs).alias("value"))


def totals(items: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """n_items, n_images, n_files over what is included. An original counts once a file, however often it occurs."""
    chosen = items.where(F.coalesce("include", F.lit(True)))
    per = chosen.groupBy("file_index").agg(F.countDistinct("text").alias("i")).withColumn("m", F.lit(0).cast("long"))
    if images is not None:
        per = per.unionByName(images.where(F.coalesce("include", F.lit(True))).groupBy("file_index").agg(F.count("*").alias("m")).withColumn("i", F.lit(0).cast("long")))
    return per.groupBy("file_index").agg(F.sum("i").alias("i"), F.sum("m").alias("m")).agg(F.coalesce(F.sum("i"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_images"), F.count("*").alias("n_files"))


def verify_report(texts: DataFrame, entities: M.Entities, key: str = "file_index") -> DataFrame:
    """key, n_leaks, values, clean, any_leak: a row a text; any_leak is the batch's verdict in every row."""
    found = M.verify(texts, entities, key)
    return found.crossJoin(F.broadcast(found.agg(F.coalesce(F.bool_or(~F.col("clean")), F.lit(False)).alias("any_leak"))))  # one row


def verify_files(files: DataFrame, entities: M.Entities, key: str = "file_index") -> DataFrame:
    """key, extension, verdict, n_leaks, values, reason: a row a file. files: key, extension, text, error (null where the text is all that the file holds).

    leak: a known entity is left. clean: the text is known and none is. skipped: of a kind that is never masked. unread: the text is not known,
    so nothing is said of it; reason tells why.
    """
    reason = office.unread_reason(F.col("extension"), F.col("error"))
    own = files.select(key, "extension", F.coalesce("text", F.lit("")).alias("text"), reason.alias("reason"), office.is_supported(F.coalesce("extension", F.lit(""))).alias("_s"))
    found = M.verified(own.where("reason is null"), entities).select(key, "extension", F.when(F.size("values") > 0, "leak").otherwise("clean").alias("verdict"), F.size("values").alias("n_leaks"), "values", "reason")
    none = F.expr("cast(array() as array<string>)")
    rest = own.where("reason is not null").select(key, "extension", F.when(F.col("_s"), "unread").otherwise("skipped").alias("verdict"), F.lit(0).alias("n_leaks"), none.alias("values"), "reason")
    return found.unionByName(rest)


def exit_code(verdicts: DataFrame) -> int:
    """1 if anything leaks, else 2 if a file of a known kind was not read, else 0."""
    got = {r["verdict"] for r in verdicts.select("verdict").distinct().collect()}  # four at most
    return 1 if "leak" in got else 2 if "unread" in got else 0
