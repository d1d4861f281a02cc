"""python -m umbra.cli: extract-text, extract-images, scan, apply and verify over DOCX, XLSX and PPTX files."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batch
from .operators import mask as M
from .operators import review as R
from .sources import office
from .sources.folder import write_folder


def _report(skipped: DataFrame) -> None:
    for r in skipped.orderBy("file_index").toLocalIterator():
        print(f"Skipped {r.input_file}: {r.skip_reason}", file=sys.stderr)


def extract_text(spark: SparkSession, inputs: list[str], out_dir: str | None = None) -> int:
    """Each file's text to standard output, or to a .txt file of its name in out_dir."""
    texts, _ = batch.texts(office.read_files(spark, inputs))
    _report(texts.where("skip_reason is not null"))
    good = texts.where("skip_reason is null")
    if out_dir:
        stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
        office.save_files(good.select("file_index", F.concat(stem, F.lit(".txt")).alias("file_name"), F.encode("text", "utf-8").alias("content")), out_dir)
        return 0
    for r in good.orderBy("file_index").toLocalIterator():
        print(f"--- {r.input_file}, {len(r.text)} characters\n{r.text}")
    return 0


def extract_images(spark: SparkSession, inputs: list[str], out_dir: str = "extracted_images") -> int:
    """Each file's images to a folder of its name, and images_manifest.json; nothing is written where there are none."""
    files = office.read_files(spark, inputs)
    entries, found = batch.manifest(files)
    # Files of one name get folders of their own.
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    folders = office.placed_names(files.select("file_index", stem.alias("file_name"))).select(F.col("order").alias("file_index"), F.col("path").alias("folder"))
    good = found.where("error is null").join(folders, "file_index").select(F.struct("file_index", "id").alias("file_index"), F.element_at(F.split("id", "/"), -1).alias("file_name"), "content", "folder")
    named = office.placed_names(good, inside="folder").select("order.*", "path")
    listed = entries.join(named, ["file_index", "id"]).orderBy("file_index", "id")
    n = entries.count()
    if not n:
        print("There are no images in these files.")
        return 0
    office.save_files(good, out_dir, inside="folder")
    rows = listed.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit("").alias("section"), F.to_json(F.struct("id", "file_index", "location", "all_ids", "count", "input_file", F.concat(F.lit(out_dir.rstrip("/") + "/"), "path").alias("path"))).alias("value"))
    write_folder(rows, out_dir, "images_manifest.json")
    print(f"{n} image(s), listed in {out_dir}/images_manifest.json")
    return 0


def scan(spark: SparkSession, inputs: list[str], known_entities: str | None = None, out: str = "candidates.json", use_regex: bool = True, tagger=None, address_only: bool = True) -> int:
    """What the files hold, as a review file. 2 if a file of a known kind could not be read."""
    entities = M.known_entities(R.read_entities(spark, known_entities)) if known_entities else ()
    found = batch.scan(office.read_files(spark, inputs), entities, use_regex, tagger, address_only)
    _report(found.skipped())
    print(f"{R.write_review(out, found.listed, found.items)} item(s) to review in {out}")
    return 2 if not found.texts.where("error is not null").isEmpty() else 0


def apply(spark: SparkSession, review_file: str, output_dir: str = ".", replacement_logo: str | None = None) -> int:
    """The files of a review, masked, and mapping_log.json; what became of each file. 1 if any failed."""
    files, items, images = R.read_review(spark, review_file)
    logo = None
    if replacement_logo:
        with open(replacement_logo, "rb") as f:
            logo = f.read()
    read = office.read_files(spark, [r.input_file for r in files.orderBy("file_index").collect()]).select("input_file", "content")
    done = batch.applied(files.join(read, "input_file"), items, images, logo)
    outcomes = batch.write_applied(done, output_dir)
    masked = failed = 0
    for r in outcomes.orderBy("file_index").toLocalIterator():
        if r.written:
            masked += 1
            print(f"{r.input_file}: {r.n_items} text(s) and {r.n_images} image(s) replaced, written to {output_dir}/{r.written}")
        else:
            failed += r.outcome != "nothing to mask"
            print(f"{r.input_file}: {r.outcome}", file=sys.stderr if r.outcome != "nothing to mask" else sys.stdout)
    R.write_log(os.path.join(output_dir, "mapping_log.json"), M.mapping_log(M.chosen(items.withColumn("seq", F.col("id"))), "file_index"))
    t = outcomes.where("outcome = 'masked'").agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("n_images"), F.lit(0)).alias("n_images")).first()
    print(f"{t.n_items} text(s) and {t.n_images} image(s) replaced in {masked} file(s); the mapping is in {output_dir}/mapping_log.json, for internal use only")
    return 1 if failed else 0


def verify(spark: SparkSession, inputs: list[str], known_entities: str) -> int:
    """1 if any known entity is left in any file; else 2 if a file of a known kind could not be read, of which nothing is said; else 0."""
    texts, _ = batch.texts(office.read_files(spark, inputs))
    entities = M.known_entities(R.read_entities(spark, known_entities))
    found = R.verify_files(texts, entities).join(texts.select("file_index", "input_file"), "file_index").orderBy("file_index").toLocalIterator()
    seen = set()
    for r in found:
        seen.add(r.verdict)
        if r.verdict in ("leak", "clean"):
            print(f"clean: {r.input_file}" if r.verdict == "clean" else f"leak: {r.input_file} holds {r.n_leaks} listed value(s): {list(r['values'])}")
        else:
            print(f"{'skipped' if r.verdict == 'skipped' else 'NOT CHECKED'}: {r.input_file}: {r.reason}", file=sys.stderr)
    return 1 if "leak" in seen else 2 if "unread" in seen else 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="umbra", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = {n: commands.add_parser(n) for n in ("extract-text", "extract-images", "scan", "apply", "verify")}
    for n in ("extract-text", "extract-images", "scan", "verify"):
        one[n].add_argument("inputs", nargs="+")
    one["extract-text"].add_argument("--out-dir")
    one["extract-images"].add_argument("--out-dir", default="extracted_images")
    one["scan"].add_argument("--known-entities")
    one["scan"].add_argument("--out", default="candidates.json")
    one["scan"].add_argument("--no-pattern-matching", action="store_true")
    one["scan"].add_argument("--tagger", help="module:function of a tagger; without it addresses are found by pattern")
    one["scan"].add_argument("--full-ner", action="store_true", help="the tagger's persons and organisations too")
    one["apply"].add_argument("review_file")
    one["apply"].add_argument("--output-dir", default=".")
    one["apply"].add_argument("--replacement-logo")
    one["verify"].add_argument("--known-entities", required=True)
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("umbra").getOrCreate()
    if a.command == "extract-text":
        return extract_text(spark, a.inputs, a.out_dir)
    if a.command == "extract-images":
        return extract_images(spark, a.inputs, a.out_dir)
    if a.command == "scan":
        tagger = None
        if a.tagger:
            from importlib import import_module

            module, _, name = a.tagger.partition(":")
            tagger = getattr(import_module(module), name)
        return scan(spark, a.inputs, a.known_entities, a.out, not a.no_pattern_matching, tagger, not a.full_ner)
    if a.command == "apply":
        return apply(spark, a.review_file, a.output_dir, a.replacement_logo)
    return verify(spark, a.inputs, a.known_entities)


if __name__ == "__main__":
    sys.exit(main())
