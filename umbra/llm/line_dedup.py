"""Line dedup by an exact set-similarity join.

Tokens of a line are ordered by rarity, so its prefix, of which a similar line must share a token, is rare. Equal lines are one
class from the start. A token in few prefixes is joined with itself, under length, positional and bitmap filters; what passes is
verified. A token in many prefixes, as in a group of near copies, would make the square of them; there the first line of
each token settles the later ones similar to it, round by round, and only what no round settles is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, let, stored

#: Jaccard similarity of 4 / 5.
OVER, UNDER = 4, 5
#: Cells that tokens are hashed to in order to count them; the counts order tokens by rarity. A rank is a byte, so they make a megabyte.
CELLS = 1 << 20
#: Cells of which one row gathers the ranks.
CHUNK = 1 << 10
#: A token in the prefixes of more classes is handled in rounds.
HOT = 256
#: Tokens from which a line has twice as wide a bitmap.
LONG = 64
#: Longs of the bitmaps of lines with hot tokens, of which the pairs of a group of near copies are told apart.
WIDE = 8
#: Lines of a token that settle later ones in each round but the first, which has one.
HEADS = 32
#: Rows of ids, of under 50 bytes, up to which they are broadcast.
SMALL = 1_000_000


def _lines(text: Column) -> Column:
    """The distinct lines of a text that hold a word, in order."""
    return F.array_distinct(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))


def _own(docs: DataFrame) -> DataFrame:
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        return own
    return own.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))


def _blanks(line: Column) -> Column:
    """A line with blanks for its other white space. A split at one plain character is twice as fast as one at a pattern."""
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), "\t\v\f\r", line)


def _words(line: Column) -> Column:
    """The words of a line that has been through _blanks(), each once."""
    return F.array_distinct(F.array_remove(F.split(line, " "), ""))


def _ranks(classes: DataFrame) -> DataFrame:
    """The rank of each cell by the tokens in it, rare first (three times the binary logarithm of their count), as one array of bytes."""
    cell = F.xxhash64("w").bitwiseAND(CELLS - 1)
    words = classes.select(F.explode(F.split("line", " ")).alias("w"))  # empty ones too: they are no tokens, so their rank is not asked for
    counts = words.groupBy(cell.alias("cell")).count().unionByName(classes.sparkSession.range(CELLS).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("count")))
    rank = F.floor(3 * F.log2(F.sum("count") + 1)).cast("byte").alias("rank")
    chunk = F.floor(F.col("cell") / CHUNK).alias("chunk")
    part = counts.groupBy("cell").agg(rank).groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct("cell", "rank"))).getField("rank").alias("ranks"))
    return part.agg(F.flatten(F.sort_array(F.collect_list(F.struct("chunk", "ranks"))).getField("ranks")).alias("ranks"))


def _need(n: Column) -> Column:
    """Tokens that two lines of n tokens together must share."""
    return F.floor((OVER * n + OVER + UNDER - 1) / (OVER + UNDER))


def _flipped(hashes: Column, by) -> Column:
    """64 bits, of which each hash flips the one of its lowest six bits if by(hash) is 1, not if it is 0."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", by(h), h.bitwiseAND(63).cast("int"))))


def _wide(hashes: Column) -> list[Column]:
    """The bitmap of hashes, of 64 * WIDE bits."""
    return [_flipped(F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(WIDE - 1) == k), lambda h: F.lit(1).cast("long")).alias(f"wide{k}") for k in range(WIDE)]


def _differ(a: str, b: str, bitmap: list[str]) -> Column:
    """Bits in which the bitmaps of two lines differ. Each word that only one of them has flips one bit, so there are as many such words at least."""
    x = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in bitmap]
    if bitmap != ["sig", "half"]:
        return reduce(Column.__add__, map(F.bit_count, x))
    return F.when(F.least(f"{a}.n", f"{b}.n") >= LONG, F.bit_count(x[0].bitwiseXOR(x[1])) + F.bit_count(x[1])).otherwise(F.bit_count(x[0]))


def _filters(a: str, b: str, bitmap: list[str]) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (UNDER * F.least(na, nb) >= OVER * F.greatest(na, nb)) & (_differ(a, b, bitmap) <= na + nb - 2 * _need(na + nb))


def _reach(a: str, b: str) -> Column:
    """From their first shared token on, both have enough tokens left. Where it is not the first, that one's row passes instead."""
    left = [F.col(f"{x}.n") - F.col(f"{x}.pos") for x in (a, b)]
    return F.least(*left) >= _need(F.col(f"{a}.n") + F.col(f"{b}.n"))


def _similar(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return UNDER * shared >= OVER * (F.size(a) + F.size(b) - shared)


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (distinct lines with a word), kept (their numbers from 0, in order) for each doc_id."""
    own = _own(docs)
    each = own.select("doc_id", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    classes = each.groupBy("line").agg(F.min("doc_id").alias("doc"), F.min_by("at", "doc_id").alias("at"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "doc", "at", _blanks(F.col("line")).alias("line")), "lines")
    ranks = stored(_ranks(classes), "ranks").scalar()  # a subquery: a megabyte that plans do not print
    rank = lambda h: F.coalesce(F.get("ranks", h.bitwiseAND(CELLS - 1).cast("int")), F.lit(0).cast("byte")).cast("long")
    key = lambda w: F.shiftleft(rank(F.xxhash64(w)), 55).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 9))
    tokens = classes.select("id", "line", ranks.alias("ranks")).select("id", F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split("line", " "), ""), key))).alias("tokens"))
    prefix = F.col("n") - F.floor((OVER * F.col("n") + UNDER - 1) / UNDER).cast("int") + 1
    # Bitmaps come before the prefix is taken apart, or they would be made for each row of it: one of all tokens, and of long lines one of those of every other hash.
    sig, half = _flipped(F.col("tokens"), lambda h: F.lit(1).cast("long")), _flipped(F.col("tokens"), lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(1))
    tokens = tokens.select("id", "tokens", F.size("tokens").alias("n"), sig.alias("sig"), F.when(F.size("tokens") >= LONG, half).otherwise(0).alias("half"))
    rows = tokens.select("id", "n", "sig", "half", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("pos", "key"))
    counted = rows.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1")
    # One query over one exchange, which the same columns on both sides make possible: candidate pairs (x, y) of the others, and the rows of hot tokens.
    a, b = counted.where(F.col("c") <= HOT).alias("a"), counted.where(F.col("c") <= HOT).alias("b")
    possible = (F.col("a.id") < F.col("b.id")) & _filters("a", "b", ["sig", "half"]) & _reach("a", "b")
    null = F.lit(None).cast("long")
    cold = a.join(b, (F.col("a.key") == F.col("b.key")) & possible).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    cold = cold.select("x", "y", *[null.alias(c) for c in ("key", "n", "sig", "half", "pos")])
    # All columns, needed or not: without them there would be another exchange, and all tokens made again for it.
    warm = counted.where(F.col("c") > HOT).select(F.col("id").alias("x"), null.alias("y"), "key", F.col("n").cast("long").alias("n"), "sig", "half", F.col("pos").cast("long").alias("pos"))
    both = stored(cold.unionByName(warm), "candidates")
    pairs = both.where("key is null").select("x", "y")
    hot = both.where("key is not null").select("key", F.col("x").alias("id"), "pos")

    def ids_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id")))

    def lines_of(ids: DataFrame, lines: DataFrame) -> DataFrame:
        ids = stored(ids.distinct(), "ids")
        return lines.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "id", "left_semi")

    # Most lines are in no pair and have no hot token. The others are put aside once, with their words.
    near = stored(lines_of(ids_of(pairs).unionByName(hot.select("id")), classes).select("id", "doc", "at", _words(F.col("line")).alias("words")), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        """The later line of each pair (x, y) that is similar."""
        sets = lines_of(ids_of(pairs), near)
        first = sets.select(F.col("id").alias("x"), F.struct("doc", "at").alias("p"), F.col("words").alias("u"))
        second = sets.select(F.col("id").alias("y"), F.struct("doc", "at").alias("q"), F.col("words").alias("v"))
        found = pairs.join(first, "x").join(second, "y").where(_similar(F.col("u"), F.col("v")))
        return found.select(F.when(F.col("p") > F.col("q"), F.col("x")).otherwise(F.col("y")).alias("id")).distinct()

    found = stored(verified(pairs), "found")
    # Hot tokens: in rounds, the first open lines of each token settle those later ones that are similar to them, which takes a group of
    # near copies a few rows a line. When a round settles little, what is open is compared with all earlier lines of its tokens.
    wide = [f"wide{k}" for k in range(WIDE)]
    h = lines_of(hot.select("id"), near).select("id", "doc", "at", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    hot = stored(hot.join(h.select("id", "doc", "at", F.size("h").alias("n"), *_wide(F.col("h"))), "id").select("key", "id", "n", "pos", "doc", "at", *wide), "hot")
    place = lambda x: F.struct(f"{x}.doc", f"{x}.at")

    def similar(late: DataFrame, early: DataFrame) -> DataFrame:
        near = late.alias("l").join(early.alias("e"), (F.col("l.key") == F.col("e.key")) & (place("e") < place("l")) & _filters("l", "e", wide) & _reach("l", "e"))
        return verified(stored(near.select(F.col("l.id").alias("y"), F.col("e.id").alias("x")).distinct(), "pairs"))

    still = hot.join(F.broadcast(found) if found.count() <= SMALL else found, "id", "left_anti")
    source, rounds, most = still, [], 1
    while True:
        nth = F.row_number().over(Window.partitionBy("key").orderBy("doc", "at"))
        heads = stored(source.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), "heads")
        rounds.append(stored(similar(still, heads), "settled"))
        still = stored(still.join(rounds[-1], "id", "left_anti"), "open")
        if most > 1 and 100 * rounds[-1].count() <= still.select("id").distinct().count():
            break
        source, most = still.join(heads.select("key", "id"), ["key", "id"], "left_anti"), HEADS
    repeats = similar(still, hot.join(still.select("key").distinct(), "key", "left_semi"))
    for settled in rounds:
        repeats = repeats.unionByName(settled)
    removed = stored(found.unionByName(repeats).distinct(), "removed")
    gone = F.broadcast(removed) if removed.count() <= SMALL else removed
    kept = classes.select("id", "doc", "at").join(gone, "id", "left_anti").groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_list("at")).alias("kept"))
    none = F.expr("cast(array() as array<int>)")
    return own.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines")).join(kept, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("kept", none).alias("kept"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (the kept lines, joined by line feeds), n_lines, n_kept.

    A line is removed if an earlier one (smaller doc_id, or the same document and further up) has a word set whose Jaccard
    similarity with its own is 0.8 or more, whether or not that one is itself removed. Words are [^\\x20\\x09-\\x0D]+. Lines
    without a word go. Tokens are ordered and prefixes met by 55 bits of hash and more; similarity is verified on the words.

    Null text: empty. A null doc_id counts as the smallest and stays null. Rows that share a doc_id are one document, of their texts
    in ascending order. An empty table gives none. Other columns are not read.
    """
    own = _own(docs)
    joined = own.join(kept_lines(docs), "doc_id")
    text = let(_lines(F.col("text")), lambda x: F.array_join(F.transform("kept", lambda i: F.get(x, i)), "\n"))
    return joined.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), text.alias("text"), "n_lines", F.size("kept").cast("long").alias("n_kept"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the lines kept, joined by commas."""
    made = kept_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return made.select(doc, "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept_lines"))
