"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves, and a bounded sketch of its leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, let, parts

#: A section ends after a blank line, a paragraph after its line feeds.
SECTION = r"(?s).+?(?:\n[\x20\t\r]*\n[\x20\t\r\n]*|\z)"
PARAGRAPH = r"[^\n]+\n*|\n+"
#: Where a leaf can end in text without blanks: after one character in thirty or so, in scripts written so and in unspaced ASCII.
_MARKS = r"7wWmM_/+=\-\x{3002}\x{3001}\x{FF0C}\x{306E}\x{306F}\x{3092}\x{30A2}\x{30F3}\x{0E00}-\x{0E0F}\x{4E00}-\x{4EFF}\x{6500}-\x{65FF}\x{8000}-\x{80FF}\x{AC00}-\x{ADFF}\x{C700}-\x{C7FF}"
#: A leaf ends where its own text says so, so leaves behind an edit stay as they were: from 16 characters on at the first word that ends in one
#: of these, or where no blank comes at one of the marks, or after 256.
LEAF = rf"(?s).{{16,256}}?[aeo,.;:!?][\x20\t\r\n]+|[^\x20\t\r\n]{{16,255}}?[{_MARKS}]|.{{1,256}}"
#: Leaves in a sketch, of 8 hex digits each: those of least hash.
SKETCH = 128
#: Bytes of text that one task sorts by doc_id and looks at beside their neighbours.
RANGE_BYTES = 64 << 20
#: Ranges that are cut at one level; more are cut again inside of each.
RANGES = 512


def _digest(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 16)


def tree(text: Column) -> Column:
    """The hashes of the leaves by section and paragraph: an array of arrays of arrays. Every character of text is in one leaf."""
    pieces = lambda x, pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    return F.transform(pieces(text, SECTION), lambda s: F.transform(pieces(s, PARAGRAPH), lambda p: F.transform(pieces(p, LEAF), _digest)))


def paragraph_nodes(section: Column) -> Column:
    """The hash of each paragraph of a section, over those of its leaves."""
    return F.transform(section, lambda p: _digest(F.array_join(p, "")))


def section_nodes(sections: Column) -> Column:
    """The hash of each section, over those of its paragraphs."""
    return F.transform(sections, lambda s: _digest(F.array_join(paragraph_nodes(s), "")))


def root(sections: Column) -> Column:
    return F.md5(F.array_join(section_nodes(sections), ""))


def fingerprint(sections: Column) -> Column:
    """The root in 32 hex digits, the leaves, the distinct ones, and the SKETCH of them with the least hashes; parted by colons."""

    def made(leaves: Column) -> Column:
        distinct = F.array_sort(F.array_distinct(F.transform(leaves, lambda x: F.substring(x, 1, 8))))
        return let(distinct, lambda d: F.concat_ws(":", root(sections), F.size(leaves).cast("string"), F.size(d).cast("string"), F.array_join(F.slice(d, 1, SKETCH), "")))

    return let(F.flatten(F.flatten(sections)), made)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: twice the distinct leaves that both texts have over those that each has, times the lesser of the mean numbers
    of copies of a leaf over the greater; 1 if neither has any.

    Exact for up to SKETCH distinct leaves each; else estimated by the SKETCH least hashes of both together.
    """

    def of(x: Column) -> Column:
        p, q = x["p"], x["q"]
        n, m, d, e = (z[i].cast("long") for i in (1, 2) for z in (p, q))
        cut = lambda z: F.regexp_extract_all(z[3], F.lit(".{8}"), F.lit(0))
        whole = (d <= SKETCH) & (e <= SKETCH)

        def shares(y: Column) -> Column:
            every = F.array_sort(F.array_union(y["u"], y["v"]))
            some = F.when(whole, every).otherwise(F.slice(every, 1, SKETCH))
            both = F.array_intersect(y["u"], y["v"])
            return let(some, lambda s: F.size(F.array_intersect(s, both)) / F.size(s))

        dice = let(let(F.struct(cut(p).alias("u"), cut(q).alias("v")), shares), lambda j: 2.0 * j / (1.0 + j))
        copies = lambda k, z: k / z
        ratio = F.least(copies(n, d), copies(m, e)) / F.greatest(copies(n, d), copies(m, e))
        return F.when(p[0] == q[0], F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(dice * ratio)

    return let(F.struct(F.split(a, ":").alias("p"), F.split(b, ":").alias("q")), of)


def edits(a: Column, b: Column) -> Column:
    """Where two trees differ, as section, paragraph and leaf of b from 0 that a has not; empty if all of b is in a.

    Branches are met by hash, not by place, so what is put in or moved does not mark what stands behind it: only in sections that a has not
    paragraphs are looked at, against those of the sections that b has not; and so on to the leaves. Each differing leaf is looked for among all
    of a's differing ones; n_edited() counts without that.
    """
    none = F.expr("cast(array() as array<struct<section:int,paragraph:int,leaf:int>>)")

    def told(x: Column) -> Column:
        known, old = x["known"], x["old"]

        def section(s: Column, i: Column) -> Column:
            def paragraph(p: Column, j: Column) -> Column:
                new = F.filter(F.transform(p, lambda h, k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf"), h.alias("h"))), lambda z: ~F.array_contains(x["leaves"], z["h"]))
                found = F.transform(new, lambda z: F.struct(z["section"].alias("section"), z["paragraph"].alias("paragraph"), z["leaf"].alias("leaf")))
                return F.when(F.array_contains(old, _digest(F.array_join(p, ""))), none).otherwise(found)

            return F.when(F.array_contains(known, _digest(F.array_join(paragraph_nodes(s), ""))), none).otherwise(F.flatten(F.transform(s, paragraph)))

        return F.flatten(F.transform(b, section))

    def compared(x: Column) -> Column:
        # The paragraphs of a's sections that b has not, and their leaves.
        gone = F.flatten(F.filter(a, lambda s: ~F.array_contains(x["b"], _digest(F.array_join(paragraph_nodes(s), "")))))
        return let(gone, lambda g: let(F.struct(x["a"].alias("known"), F.transform(g, lambda p: _digest(F.array_join(p, ""))).alias("old"), F.flatten(g).alias("leaves")), told))

    return let(F.struct(section_nodes(a).alias("a"), section_nodes(b).alias("b")), compared)


def n_edited(a: Column, b: Column) -> Column:
    """Distinct paragraphs of b that a has not, by the nodes of both trees. In linear time, for texts of any length."""
    every = lambda x: F.flatten(F.transform(x, paragraph_nodes))
    return F.size(F.array_except(every(b), every(a)))


def _ranged(own: DataFrame) -> DataFrame:
    """own with a column range, in the order of doc_id. Ranges grow in number with the bytes of text."""
    n_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(8 * parts(own.sparkSession), n_bytes // RANGE_BYTES)
    coarse = min(wanted, RANGES)
    fine = -(-wanted // coarse)
    ends = lambda n: F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)
    place = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))).cast("long")
    cuts = sorted(set(own.agg(ends(coarse)).first()[0] or [])) if coarse > 1 else []
    ranged = own.withColumn("range", place(F.array(*map(F.lit, cuts)).cast("array<bigint>")))
    if fine > 1:
        inner = ranged.groupBy("range").agg(F.array_sort(F.array_distinct(ends(fine))).alias("cuts"))  # at most RANGES rows of `fine` numbers
        ranged = ranged.join(F.broadcast(inner), "range").withColumn("range", F.col("range") * fine + place(F.col("cuts"))).drop("cuts")
    return ranged


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint: each row beside the next by doc_id, then text; after the last the first.

    Rows are dealt by ranges of doc_id. The first row of each range is also given to the range before it, so no row is
    sent anywhere else and no task sees more than its range.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranged = _ranged(own)
    # A row a range, of 24 bytes: also what one task numbers.
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("doc_id"))
    before = firsts.select("doc_id", F.col("range").alias("own"), F.lag("range").over(Window.orderBy("range")).alias("before"), F.max("range").over(Window.partitionBy()).alias("last"))
    heads = ranged.join(F.broadcast(before), (F.col("range") == F.col("own")) & (ranged["doc_id"] == before["doc_id"]))
    heads = heads.groupBy(F.coalesce("before", "last").alias("range"), ranged["doc_id"].alias("doc_id")).agg(F.min("text").alias("text"))
    both = ranged.select("doc_id", "text", "range", F.lit(0).alias("head")).unionByName(heads.select("doc_id", "text", "range", F.lit(1).alias("head")))
    both = both.withColumn("fingerprint", fingerprint(tree(F.col("text"))))
    w = Window.partitionBy("range").orderBy("head", "doc_id", "text")
    ahead = F.lead(F.struct("text", "fingerprint")).over(w).alias("ahead")
    return both.select("doc_id", "text", "fingerprint", "head", ahead).where("head = 0").select("doc_id", "text", "fingerprint", F.col("ahead.text").alias("next_text"), F.col("ahead.fingerprint").alias("next_fingerprint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, root (32 hex digits) and leaves (the tree) for each row of docs.

    Equal texts have equal fingerprints; texts that differ have different roots, but for a collision of 64 bits. A fingerprint has about a
    thousand characters at most. Null text: empty, a tree without sections. A null doc_id stays null; repeated rows count each. An empty
    table gives none. Other columns are not read.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree(F.coalesce(F.col("text"), F.lit(""))).alias("leaves"))
    return made.select("doc_id", fingerprint(F.col("leaves")).alias("fingerprint"), root(F.col("leaves")).alias("root"), "leaves")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    near = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    m = F.floor(n / 4).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)))
    trees = edited.withColumn("tree", tree(F.col("text"))).withColumn("edited_tree", tree(F.col("edited"))).withColumn("edited_fingerprint", fingerprint(F.col("edited_tree")))
    return trees.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), n_edited(F.col("tree"), F.col("edited_tree")).cast("long").alias("n_edited_paragraphs"),
    )
