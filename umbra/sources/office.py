"""Office files as tables: files in, segments and images out, masked files back."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import mask as M
from . import ooxml
from .folder import write_folder

SUPPORTED = (".docx", ".xlsx", ".pptx", ".pdf")
SEGMENTS = "file_index long, seg_no int, container string, cell_type string, text string, error string"
IMAGES = "file_index long, id string, content binary, location string, error string"


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_index (the place in paths; files of one folder or pattern by name), input_file, file_name, extension, content."""
    read = spark.read.format("binaryFile")
    found = [read.load(p).select(F.lit(i).cast("long").alias("given"), "path", "content") for i, p in enumerate(paths)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    named = rows.select("given", F.url_decode(F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"\+", "%2B")).alias("input_file"), "content")
    own = named.withColumn("file_name", F.element_at(F.split("input_file", "/"), -1)).withColumn("extension", S.extension(F.col("file_name")))
    # Numbers are made from names alone, so contents are not sorted.
    keys = M.numbered(own.select("given", "input_file"), [], "given", ["input_file"], "file_index").withColumn("file_index", F.col("file_index") - 1)
    return own.join(keys, ["given", "input_file"]).drop("given")


def given_files(rows: DataFrame, name: str = "name", content: str = "content", order: str = "file_index") -> DataFrame:
    """Files that are rows already, as uploads are, in the form of read_files(). order: a long that gives each its file_index."""
    own = rows.select(F.col(order).cast("long").alias("file_index"), F.col(name).alias("input_file"), F.element_at(F.split(name, "/"), -1).alias("file_name"), F.col(content).alias("content"))
    return own.withColumn("extension", S.extension(F.col("file_name"))).select("input_file", "content", "file_name", "extension", "file_index")


def is_supported(extension: Column) -> Column:
    return F.lower(extension).isin(*SUPPORTED)


def unread_reason(extension: Column, error: Column | None = None) -> Column:
    """Why a file's text is not known; null if it is."""
    why = F.when(~is_supported(F.coalesce(extension, F.lit(""))), F.concat(F.lit("unsupported file type "), F.coalesce(F.lower(extension), F.lit(""))))
    return why if error is None else why.when(error.isNotNull(), F.concat(F.lit("can't be read: "), error))


def skip_reason(extension: Column, text: Column, error: Column | None = None) -> Column:
    """Why a file is not scanned; null if it is."""
    return F.coalesce(unread_reason(extension, error), F.when(F.coalesce(S.strip(text), F.lit("")) == "", "no extractable text found"))


def with_texts(files: DataFrame, found: DataFrame) -> DataFrame:
    """files of read_files() with text and error instead of content: PDF files, of which nothing here reads the text, and broken ones have an error.

    found: segments(files).
    """
    errors = found.where("error is not null").groupBy("file_index").agg(F.min("error").alias("error"))
    whole = files.drop("content").join(full_texts(found), "file_index", "left").join(errors, "file_index", "left")
    return whole.withColumn("error", F.when(F.lower("extension") == ".pdf", "there is no reader for PDF files").otherwise(F.col("error")))


def _parsed(make, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]):
        types = {"file_index": pa.int64(), "seg_no": pa.int32(), "content": pa.binary()}
        for b in batches:
            for i in range(b.num_rows):  # a file at a time: only its own rows are held
                index, extension, content = (b.column(c)[i].as_py() for c in ("file_index", "extension", "content"))
                try:
                    rows = make(index, extension, content)
                except Exception as e:  # a broken file is a row that says so, not the end of the job
                    rows = [tuple([index] + [None] * (len(names) - 2) + [f"{type(e).__name__}: {e}"])]
                for at in range(0, len(rows), 10_000):
                    columns = zip(*rows[at : at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)

    return run


def segments(files: DataFrame) -> DataFrame:
    """SEGMENTS of the DOCX, XLSX and PPTX files of read_files(). A file that can't be read has one row with an error and no text."""

    def make(index: int, extension: str, content: bytes) -> list[tuple]:
        return [(index, i, *s, None) for i, s in enumerate(ooxml.segments(content, extension))]

    return files.where(F.lower("extension").isin(*ooxml.MEDIA)).select("file_index", F.lower("extension").alias("extension"), "content").mapInArrow(_parsed(make, SEGMENTS), SEGMENTS)


def text_segments(found: DataFrame) -> DataFrame:
    """The segments that make a file's text: formulas, numbers, dates and blanks are left out."""
    return found.where((F.col("cell_type") == "s") & (S.strip(F.col("text")) != ""))


def full_texts(found: DataFrame, key: str = "file_index") -> DataFrame:
    """key, text: the text segments of each file joined by line feeds, in order."""
    rows = F.sort_array(F.collect_list(F.struct("seg_no", "text")))
    return text_segments(found).groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def sheet_ranges(found: DataFrame, key: str = "file_index") -> DataFrame:
    """key, sheet, start, end: where each sheet's text lies in the file's; the line feed before its first cell is part of it."""
    placed = M.segment_offsets(text_segments(found), key, "seg_no")
    first = F.min(F.struct("seg_no", "start"))["start"]
    return placed.groupBy(key, F.col("container").alias("sheet")).agg(F.greatest(first - 1, F.lit(0)).alias("start"), F.max("end").alias("end"))


def images(files: DataFrame) -> DataFrame:
    """IMAGES embedded in the files, by name."""

    def make(index: int, extension: str, content: bytes) -> list[tuple]:
        return [(index, name, data, name, None) for name, data in ooxml.images(content, extension)]

    return files.where(F.lower("extension").isin(*ooxml.MEDIA)).select("file_index", F.lower("extension").alias("extension"), "content").mapInArrow(_parsed(make, IMAGES), IMAGES)


def image_manifest(found: DataFrame) -> DataFrame:
    """file_index, digest, id (the first), all_ids, count, location: equal images of a file are one row."""
    good = found.where("error is null").withColumn("digest", F.md5("content"))
    ids = F.sort_array(F.collect_list("id"))
    return good.groupBy("file_index", "digest").agg(ids.alias("all_ids"), F.count("*").alias("count"), F.min("location").alias("location")).withColumn("id", F.get("all_ids", F.lit(0)))


def slot_format(image: Column) -> Column:
    """The format that an image's place in a file asks for, by its name: what ooxml.image_format() says of it."""
    return F.when(F.lower(F.element_at(F.split(image, r"\."), -1)).isin("jpg", "jpeg"), "JPEG").otherwise("PNG")


def image_action(action: Column, has_logo: bool) -> Column:
    """replace where that is asked for and there is something to replace with, else blank."""
    return F.when((F.coalesce(action, F.lit("blank")) == "replace") & F.lit(has_logo), "replace").otherwise("blank")


def flagged_images(manifest: DataFrame, decisions: DataFrame, has_logo: bool) -> DataFrame:
    """file_index, id, action of every image that a decision on its manifest row flags, copies included.

    decisions: file_index, id, include, action; not included or undecided ones have no row.
    """
    chosen = decisions.where(F.coalesce("include", F.lit(True))).select("file_index", "id", image_action(F.col("action"), has_logo).alias("action"))
    return manifest.select("file_index", "id", "all_ids").join(chosen, ["file_index", "id"]).select("file_index", F.explode("all_ids").alias("id"), "action")


def _to_mask(files: DataFrame, pairs: DataFrame, flagged: DataFrame | None) -> DataFrame:
    own = files.where(F.lower("extension").isin(*ooxml.MEDIA)).join(pairs.select("file_index", "pairs"), "file_index", "left")
    if flagged is not None:
        ids = flagged.groupBy("file_index").agg(F.sort_array(F.collect_list(F.struct("id", "action"))).alias("flags"))
        own = own.join(ids, "file_index", "left")
    else:
        own = own.withColumn("flags", F.expr("cast(null as array<struct<id:string,action:string>>)"))
    none = F.expr("cast(array() as array<struct<rank:int,seq:int,o:string,p:string,grey:boolean>>)")
    own = own.where(F.col("pairs").isNotNull() | F.col("flags").isNotNull()).withColumn("pairs", F.coalesce("pairs", none))
    stem = F.regexp_extract("file_name", r"^(.*?)(\.[^.]+)?$", 1)
    return own.withColumn("file_name", F.concat(M.sanitize_name(stem, F.col("pairs")), F.col("extension")))


def masked_names(files: DataFrame, pairs: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """file_index and file_name, masked, of the files that masked_files() gives; no content is read for it."""
    return _to_mask(files, pairs, flagged).select("file_index", "file_name")


def masked_files(files: DataFrame, pairs: DataFrame, flagged: DataFrame | None = None, logo: bytes | None = None) -> DataFrame:
    """file_index, file_name, content of every DOCX, XLSX and PPTX with something to mask, and n_items, n_images, error.

    pairs: file_index and pairs, of M.mapping(); flagged: of flagged_images(). File names are masked too.
    """
    own = _to_mask(files, pairs, flagged)
    schema = "file_index long, file_name string, content binary, n_items int, n_images int, error string"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                change = _change([(p["o"], p["p"], p["grey"]) for p in row["pairs"]])
                data, n, error = row["content"], 0, None
                try:
                    if row["pairs"]:
                        data = ooxml.rewrite(data, row["extension"].lower(), change)
                    for action in ("blank", "replace"):
                        ids = [f["id"] for f in row["flags"] or () if f["action"] == action]
                        data, more = ooxml.replace_images(data, ids, logo if action == "replace" else None) if ids else (data, 0)
                        n += more
                except Exception as e:
                    data, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"file_index": row["file_index"], "file_name": row["file_name"], "content": data, "n_items": len(row["pairs"]), "n_images": n, "error": error}], pa.schema([("file_index", pa.int64()), ("file_name", pa.string()), ("content", pa.binary()), ("n_items", pa.int32()), ("n_images", pa.int32()), ("error", pa.string())]))

    return own.select("file_index", "file_name", "extension", "content", "pairs", "flags").mapInArrow(run, schema)


def _change(pairs: list[tuple[str, str, bool]]) -> ooxml.Rewrite:
    """What M.folded() does to a text, for texts inside files."""
    import re

    found = [(o, re.compile(rf"(?<![A-Za-z0-9_]){re.escape(o)}(?![A-Za-z0-9_])"), p, grey) for o, p, grey in pairs]

    def change(text: str) -> tuple[str, bool, bool]:
        changed = any_grey = False
        for o, pattern, p, grey in found:
            if o in text:
                text, n = pattern.subn(lambda _, p=p: p, text)
                changed, any_grey = changed or n > 0, any_grey or (n > 0 and grey)
        return text, changed, any_grey

    return change


def placed_names(outputs: DataFrame, name: str = "file_name", order: str = "file_index", inside: str | None = None) -> DataFrame:
    """order and path: where each row goes below a folder, no two to one place; inside: a column that names a folder in it."""
    bare = lambda c: F.regexp_replace(F.element_at(F.split(F.coalesce(c, F.lit("")), r"[/\\\\]"), -1), r"^(|\.|\.\.)$", "file")
    path = bare(F.col(name)) if inside is None else F.concat(bare(F.col(inside)), F.lit("/"), bare(F.col(name)))
    return M.folder_names(outputs.select(F.col(order).alias("order"), path.alias("path")), "path", "order").select("order", F.col("folder_name").alias("path"))


def save_files(outputs: DataFrame, folder: str, name: str = "file_name", content: str = "content", order: str = "file_index", inside: str | None = None) -> None:
    """Write each row's content to a file of its name below folder; where names are alike the first by order has it, others get a number that is free.

    order: distinct values. Rows without content have no file and no name. Files appear when all are written, see write_folder().
    """
    named = placed_names(outputs.where(F.col(content).isNotNull()), name, order, inside)
    rows = outputs.where(F.col(content).isNotNull()).join(named, F.col(order) == F.col("order"))
    write_folder(rows.select("path", F.col(content).alias("content"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("value")), folder)


def page_texts(pages: DataFrame) -> DataFrame:
    """key, page, text, route: the native text of a page if it is usable, else what was recognised, else nothing.

    pages: key, page, native, recognised (null where no recogniser ran).
    """
    native, seen = S.is_usable(F.coalesce("native", F.lit(""))), S.strip(F.coalesce("recognised", F.lit(""))) != ""
    text = F.when(native, F.col("native")).when(seen, F.col("recognised"))
    return pages.withColumn("text", text).withColumn("route", F.when(native, "native").when(seen, "ocr").otherwise("none"))


def ocr_languages(installed: Column) -> Column:
    """The recogniser's language parameter: all installed ones but the orientation data, sorted, joined by +; eng if there are none."""
    own = F.array_sort(F.array_distinct(F.array_remove(installed, "osd")))
    return F.when(F.size(own) > 0, F.array_join(own, "+")).otherwise("eng")
