"""Scan, extract images, apply and verify over files as tables. The command line and callers with files in memory go through these.

files: file_index, input_file, file_name, extension, content, as office.read_files() or office.given_files() give them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mask as M
from .operators import ner
from .operators import review as R
from .sources import office
from .sources.folder import write_folder

OUTCOME = "file_index long, input_file string, written string, n_items int, n_images int, outcome string"


@dataclass
class Scanned:
    """texts: files with text, error and skip_reason; listed: those that the review names; items: R.ITEMS."""

    texts: DataFrame
    listed: DataFrame
    items: DataFrame

    def skipped(self) -> DataFrame:
        return self.texts.where("skip_reason is not null").select("file_index", "input_file", "skip_reason")


def texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files with text, error and skip_reason instead of content; and their segments."""
    found = office.segments(files)
    whole = office.with_texts(files, found)
    return whole.withColumn("skip_reason", office.skip_reason(F.col("extension"), F.col("text"), F.col("error"))), found


def scan(files: DataFrame, entities: M.Entities = (), use_regex: bool = True, tagger: ner.Tagger | None = None, address_only: bool = True) -> Scanned:
    """What files hold. A file that can't be read, or has no text, has no items and says why."""
    whole, found = texts(files)
    sheets = office.sheet_ranges(found.join(files.where("lower(extension) = '.xlsx'").select("file_index"), "file_index", "left_semi"))
    items = R.scan(whole.where("skip_reason is null"), entities, use_regex, tagger, address_only, sheets, files.select("file_index"))
    listed = whole.where(office.is_supported(F.col("extension"))).select("file_index", "input_file", "file_name", "extension")
    return Scanned(whole, listed, items)


def manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct images of each file with the names of their files, and the images."""
    found = office.images(files)
    return office.image_manifest(found).join(files.select("file_index", "input_file", "file_name"), "file_index"), found


def applied(files: DataFrame, items: DataFrame, images: DataFrame | None = None, logo: bytes | None = None) -> DataFrame:
    """file_index, input_file, path, content, n_items, n_images, outcome: a row a file.

    outcome: masked; nothing to mask; or why not. Only masked files have a path (a masked name of its own) and content. A reviewed file of a
    kind that can't be written here, with something to mask, is one that failed.
    """
    pairs = M.mapping(M.chosen(items.withColumn("seq", F.col("id"))), "file_index")
    flagged = None
    if images is not None:
        flagged = images.where(F.coalesce("include", F.lit(True))).select("file_index", "id", office.image_action(F.col("action"), logo is not None).alias("action"))
    done = office.masked_files(files, pairs, flagged, logo).select("file_index", "content", "n_items", "n_images", "error")
    paths = office.placed_names(office.masked_names(files, pairs, flagged)).select(F.col("order").alias("file_index"), "path")
    wanted = pairs.select("file_index")
    if flagged is not None:
        wanted = wanted.unionByName(flagged.select("file_index")).distinct()
    wanted = wanted.withColumn("_wanted", F.lit(True))
    rows = files.select("file_index", "input_file", "extension").join(wanted, "file_index", "left").join(done, "file_index", "left").join(paths, "file_index", "left")
    outcome = F.when(F.col("content").isNotNull(), "masked").when(F.col("_wanted").isNull(), "nothing to mask").otherwise(F.concat(F.lit("failed: "), F.coalesce("error", office.unread_reason(F.col("extension")), F.lit("files of this kind can't be written here"))))
    path = F.when(F.col("content").isNotNull(), F.col("path")).alias("path")
    return rows.select("file_index", "input_file", path, "content", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_images", F.lit(0)).alias("n_images"), outcome.alias("outcome"))


def write_applied(done: DataFrame, folder: str) -> DataFrame:
    """Write the masked files to folder; OUTCOME of each file, read from what the tasks that wrote them have noted. Each file is masked once."""
    noted = "outcomes.json"
    value = F.to_json(F.struct("file_index", "input_file", F.col("path").alias("written"), "n_items", "n_images", "outcome"))
    write_folder(done.select("path", "content", F.lit("").alias("section"), value.alias("value")), folder, noted)
    return done.sparkSession.read.schema(OUTCOME).json(f"{folder}/{noted}", multiLine=True)


# In memory: what a page or a service has at hand is small, and goes to and fro as Python values.


def _uploads(spark: SparkSession, uploads: list[tuple[str, bytes]]) -> DataFrame:
    rows = [(i, name, bytearray(data)) for i, (name, data) in enumerate(uploads)]
    return office.given_files(spark.createDataFrame(rows, "file_index long, name string, content binary"))


def run_scan(spark: SparkSession, uploads: list[tuple[str, bytes]], entities: list[tuple[str, str]] = (), use_regex: bool = True, tagger: ner.Tagger | None = None, address_only: bool = True) -> tuple[dict, list[tuple[str, str]]]:
    """The review of (name, content) pairs, as a dict of files, items and images; and (name, reason) of what was skipped."""
    found = scan(_uploads(spark, uploads), list(entities), use_regex, tagger, address_only)
    listed = [{"file_index": r.file_index, "file_name": r.file_name, "extension": r.extension} for r in found.listed.orderBy("file_index").collect()]
    items = [{k: v for k, v in r.asDict().items() if k != "sheet" or v is not None} for r in found.items.orderBy("id").collect()]
    return {"files": listed, "items": items, "images": []}, [(r.input_file, r.skip_reason) for r in found.skipped().orderBy("file_index").collect()]


def run_extract_images(spark: SparkSession, uploads: list[tuple[str, bytes]]) -> list[dict]:
    """The distinct images of each file: file_index, file_name, id, all_ids, count and content."""
    entries, found = manifest(_uploads(spark, uploads))
    rows = entries.join(found.where("error is null").select("file_index", "id", "content"), ["file_index", "id"]).orderBy("file_index", "id").collect()
    return [{"file_index": r.file_index, "file_name": r.file_name, "id": r.id, "all_ids": list(r.all_ids), "count": r["count"], "content": bytes(r.content)} for r in rows]


def run_apply(spark: SparkSession, review: dict, uploads: list[tuple[str, bytes]], logo: bytes | None = None) -> tuple[list[tuple[str, bytes]], list[dict], list[dict]]:
    """The masked files as (name, content), the mapping log, and each file's outcome. review: as run_scan() gives it, edited."""
    _, items, images = R.review_rows(spark.createDataFrame([(json.dumps(review),)], "value string"))
    done = applied(_uploads(spark, uploads), items, images, logo).orderBy("file_index").collect()
    log = M.mapping_log(M.chosen(items.withColumn("seq", F.col("id"))), "file_index").orderBy("at").collect()
    outcomes = [{"file_index": r.file_index, "name": r.input_file, "written": r.path, "n_items": r.n_items, "n_images": r.n_images, "outcome": r.outcome} for r in done]
    return [(r.path, bytes(r.content)) for r in done if r.content is not None], [{"original": r.original, "placeholder": r.placeholder} for r in log], outcomes
