"""Quality rules: base counts, and the divergence of a document's histograms from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, let, stored

#: Common words of a language's reference.
COMMON = 16
#: Greatest Jensen-Shannon distances (base 2, from 0 to 1) of a document that is kept.
CLASS_DISTANCE, WORD_DISTANCE = 0.3, 0.3
#: A shorter document's histogram says too little, and is not judged.
LEAST_CHARS, LEAST_WORDS = 200, 80
#: Languages up to which the references, of a few hundred bytes each, are broadcast.
LANGUAGES = 1000
CLASSES = ("lower", "space", "upper", "letter", "digit", "stop", "symbol")
#: What is taken out of the text, one class after the other; the next is looked for in what is left.
_STEPS = (("lower", "[a-z]+"), ("space", WS + "+"), ("upper", "[A-Z]+"), ("letter", r"\p{L}+"), ("digit", r"\p{N}+"), ("stop", r"[.,;:!?'\"()\-]+"))


def repeated_words(words: Column) -> Column:
    """Words in windows of five that are found twice or more in the array of words. Windows are compared by 64 bits."""

    def window(w: Column, x: Column, i: Column) -> Column:
        return F.xxhash64(x, *(F.get(w, i + j) for j in range(1, 5)))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i + 1)["g"] == x["g"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["g"] == x["g"])))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    # Where the hashes of all windows are distinct nothing is left to do; few documents go further.
    hashes = F.slice(let(words, lambda w: F.transform(w, lambda x, i: window(w, x, i))), 1, F.greatest(F.size(words) - 4, F.lit(0)))
    sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(words) - 4, let(sorted_, covered)).otherwise(F.lit(0))


def _classes(docs: DataFrame) -> DataFrame:
    """docs with a column n_<class> for each of CLASSES, and what is left of the text in `rest`."""
    docs, text = docs.withColumn("rest", F.col("text")), "rest"
    docs = docs.withColumn("left_0", F.length("text"))
    for i, (name, pattern) in enumerate(_STEPS, 1):
        docs = docs.withColumn(text, F.regexp_replace(text, pattern, "")).withColumn(f"left_{i}", F.length(text))
        docs = docs.withColumn(f"n_{name}", F.col(f"left_{i - 1}") - F.col(f"left_{i}"))
    return docs.withColumn("n_symbol", F.col(f"left_{len(_STEPS)}"))


def _own(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select("doc_id", empty("text"), empty("lang"))


def common_words(docs: DataFrame) -> DataFrame:
    """lang, top: its COMMON most frequent words of letters and marks, of any script and length, with their counts over all of docs."""
    each = _own(docs).select("lang", F.explode(F.split("text", WS + "+")).alias("word")).where(F.col("word").rlike(r"^[\p{L}\p{M}]+\z"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counts = each.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= COMMON)
    return counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    Words are [^\\x20\\x09-\\x0D]+. base_failed: under 10 words, or over a fifth of them in repeated windows of five. kept: base passed,
    and neither histogram (character classes, common words) lies beyond its greatest distance from the language's reference, which
    is counted over all of docs. Histograms of under 200 characters or 80 words are not judged.

    Null or empty text: no words, so rejected. A null language is a language. Repeated rows are judged each. An empty table gives
    none. Other columns are not read.
    """
    few = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(""))).distinct().limit(LANGUAGES + 1).count() <= LANGUAGES
    maybe = F.broadcast if few else lambda df: df
    top = stored(common_words(docs), "common-words")
    base = _classes(_own(docs)).join(maybe(top.select("lang", F.transform("top", lambda x: x["word"]).alias("common"))), "lang", "left")
    base = base.withColumn("words", F.array_remove(F.split("text", WS + "+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c, name: c.cast("long").alias(name)
    n = F.size("words")
    counted = base.select(
        "doc_id", "lang", long(n, "n_words"), long(F.col("left_0") - F.col("n_space"), "word_chars"), long(F.length(F.regexp_replace("rest", r"[^#*$%&|<>]+", "")), "n_symbols"),
        long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"), long(repeated_words(F.col("words")), "n_repeat_words"), long(F.col("left_0"), "n_chars"),
        *(long(F.col(f"n_{c}"), f"n_{c}") for c in CLASSES if c != "symbol"), long(F.col("n_symbol"), "n_symbol"),
        F.array(*(long(F.coalesce(n - F.size(F.array_remove("words", F.get("common", i))), F.lit(0)), "n") for i in range(COMMON))).alias("n_common"),
    )
    # A few numbers a document: the references' sums and the distances are made from them, not from the texts again.
    counted = stored(counted.withColumnRenamed("n_symbols", "symbols"), "counts")
    sums = counted.groupBy("lang").agg(F.sum("n_words").alias("words"), F.sum("n_chars").alias("chars"), *(F.sum(f"n_{c}").alias(c) for c in CLASSES))
    chars, words = F.greatest("chars", F.lit(1)), F.greatest("words", F.lit(1))

    def rest(shares: Column) -> Column:
        return F.concat(shares, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))))

    refs = sums.join(top, "lang", "left").select(
        "lang", F.array(*(F.col(c) / chars for c in CLASSES)).alias("class_shares"),
        rest(F.array(*(F.coalesce(F.get("top", i)["n"], F.lit(0)) / words for i in range(COMMON)))).alias("word_shares"),
    )
    judged = counted.join(maybe(refs), "lang", "left")
    own_classes = F.array(*(F.col(f"n_{c}") / F.greatest("n_chars", F.lit(1)) for c in CLASSES))
    own_words = rest(F.transform("n_common", lambda x: x / F.greatest("n_words", F.lit(1))))
    judged = judged.withColumn("class_distance", F.when(F.col("n_chars") >= LEAST_CHARS, distance(own_classes, F.col("class_shares"))))
    judged = judged.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, distance(own_words, F.col("word_shares"))))
    judged = judged.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    fine = (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_DISTANCE)
    return judged.select("doc_id", "n_words", "word_chars", F.col("symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & fine).alias("kept"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The judgement of every document, distances to six digits."""
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.withColumn("class_distance", F.round("class_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))
