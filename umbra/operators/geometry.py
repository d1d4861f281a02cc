"""Boxes, words and fonts of laid-out pages, as Columns and joins. A box is a struct of x0, y0, x1, y1 in points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .mask import before

#: What a box is shrunk by on each side before it is compared with others: lines that touch by a hair do not overlap.
SHRINK = 0.75


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def shared_area(a: Column, b: Column) -> Column:
    """0 where two boxes share no area."""
    side = lambda lo, hi: F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])
    w, h = side("x0", "x1"), side("y0", "y1")
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def shrunk(b: Column, by: float = SHRINK) -> Column:
    """The box less `by` on each side; as it is where nothing would be left."""
    small = box(b["x0"] + by, b["y0"] + by, b["x1"] - by, b["y1"] - by)
    return F.when((small["x1"] > small["x0"]) & (small["y1"] > small["y0"]), small).otherwise(box(b["x0"], b["y0"], b["x1"], b["y1"]))


def overlaps(b: Column, claimed: Column) -> Column:
    """Whether a box, shrunk, shares area with another that was claimed before."""
    return shared_area(shrunk(b), claimed) > 0


def clusters(lo: Column, hi: Column) -> Column:
    """Of intervals [lo, hi], arrays of numbers, those that hang together by touching or overlapping: arrays of their places, ascending."""
    edges = F.sort_array(F.flatten(F.transform(lo, lambda x, i: F.array(F.struct(x.alias("at"), F.lit(0).alias("kind"), i.alias("i")), F.struct(F.get(hi, i).alias("at"), F.lit(1).alias("kind"), i.alias("i"))))))

    def named(e: Column) -> Column:
        first = F.transform(before(F.transform(e, lambda x: 1 - 2 * x["kind"])), lambda d: (d == 0).cast("int"))  # where none is open
        number = lambda f, n: F.transform(e, lambda x, j: F.struct((F.get(n, j) + F.get(f, j)).alias("cluster"), x["i"].alias("i"), x["kind"].alias("kind")))
        every = S.let(first, lambda f: S.let(before(f), lambda n: number(f, n)))
        return F.sort_array(F.filter(every, lambda x: x["kind"] == 0))

    def parted(x: Column) -> Column:
        new = lambda j: (j == 0) | (F.get(x, F.greatest(j - 1, F.lit(0)))["cluster"] != F.get(x, j)["cluster"])
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), new)
        own = lambda b: F.transform(b, lambda j, k: F.transform(F.sequence(j, F.coalesce(F.get(b, k + 1), F.size(x)) - 1), lambda y: F.get(x, y)["i"]))
        return S.let(starts, own)

    return F.when(F.size(lo) > 0, S.let(S.let(edges, named), parted)).otherwise(F.expr("cast(array() as array<array<int>>)"))


def unclaimed(boxes: Column) -> Column:
    """Of an array of boxes in the order of their claims, those that overlap none kept before them.

    Boxes that share no height know nothing of each other: those that hang together by their heights, as a line of text does, are decided for
    themselves, so a page costs its lines squared and not its boxes squared.
    """
    free = lambda kept, b: ~F.exists(kept, lambda k: overlaps(b["b"], k["b"]))
    fold = lambda c: F.aggregate(c, F.slice(c, 1, 0), lambda kept, b: F.when(free(kept, b), F.concat(kept, F.array(b))).otherwise(kept))
    rows = F.transform(boxes, lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    lines = clusters(F.transform(boxes, lambda b: b["y0"]), F.transform(boxes, lambda b: b["y1"]))
    groups = S.let(rows, lambda r: F.transform(lines, lambda g: F.transform(g, lambda i: F.get(r, i))))
    kept = F.flatten(F.transform(groups, fold))
    return F.transform(F.array_sort(F.transform(kept, lambda x: x["i"])), lambda i: F.get(boxes, i))


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes of one page that share area, each once. left: page, p and more; right: page, q and more, named otherwise.

    A page is laid out in cells: about as many as it has boxes, and none smaller than its boxes are on average. Boxes are sent to all cells that
    they reach into and meet there, by (page, cell); a pair counts in the cell of the upper left corner of what both share. So
    no page meets in one place, and boxes far apart never meet.
    """
    both = left.select("page", F.col("p").alias("b")).unionByName(right.select("page", F.col("q").alias("b")))
    sizes = both.groupBy("page").agg(*(F.min(f"b.{c}0").alias(f"_{c}") for c in "xy"), *(F.max(f"b.{c}1").alias(f"_{c}1") for c in "xy"), F.sqrt(F.count("*")).alias("_n"), *(F.avg(F.col(f"b.{c}1") - F.col(f"b.{c}0")).alias(f"_{c}a") for c in "xy"))
    side = lambda c: F.greatest((F.col(f"_{c}1") - F.col(f"_{c}")) / F.ceil("_n"), F.col(f"_{c}a"), F.lit(1e-9)).alias(f"_{c}w")
    pages = sizes.select(F.col("page").alias("_page"), "_x", "_y", side("x"), side("y"))
    place = lambda at, c: F.floor((at - F.col(f"_{c}")) / F.col(f"_{c}w"))

    def dealt(rows: DataFrame, b: str, *keep: str) -> DataFrame:
        own = rows.where(F.col(b).isNotNull()).join(pages, F.col("page") == F.col("_page"))
        reach = lambda c: F.sequence(place(F.col(f"{b}.{c}0"), c), F.greatest(place(F.col(f"{b}.{c}1"), c), place(F.col(f"{b}.{c}0"), c)))
        return own.withColumn("_cx", F.explode(reach("x"))).withColumn("_cy", F.explode(reach("y"))).drop("_page", *(() if keep else ("_x", "_y", "_xw", "_yw")))

    a, c = dealt(left, "p", "sizes"), dealt(right, "q")
    corner = [place(F.greatest(F.col(f"p.{x}0"), F.col(f"q.{x}0")), x) == F.col(f"_c{x}") for x in "xy"]
    pairs = a.join(c, ["page", "_cx", "_cy"]).where(corner[0] & corner[1])
    return pairs.withColumn("area", shared_area(F.col("p"), F.col("q"))).where("area > 0").drop("_cx", "_cy", "_x", "_y", "_xw", "_yw")


def best_spans(rects: DataFrame, spans: DataFrame) -> DataFrame:
    """page, rect_id, span_id: the span that shares most area with each box, of equals the first; no row where none does.

    rects: page, rect_id, b; spans: page, span_id, b. Boxes meet by page.
    """
    area = met(rects.select("page", "rect_id", F.col("b").alias("p")), spans.select("page", "span_id", F.col("b").alias("q")))
    return area.groupBy("page", "rect_id").agg(F.max_by("span_id", F.struct("area", -F.col("span_id"))).alias("span_id"))


def whole_words(original: Column, words: Column) -> Column:
    """Whether words (array of block, line, word, text, those under a box) hold the original with no letter or digit beside it."""
    target = F.lower(S.squeeze(original))
    joined = F.lower(F.array_join(F.transform(F.sort_array(words), lambda w: w["text"]), " "))

    def at(t: Column) -> Column:
        i = F.position(t["o"], t["all"])
        edge = lambda c: ~c.rlike(r"[\p{L}\p{N}]")
        return (t["o"] != "") & (i > 0) & edge(F.substring(t["all"], i - 1, F.when(i > 1, 1).otherwise(0))) & edge(F.substring(t["all"], i + F.length(t["o"]), F.lit(1)))

    return S.let(F.struct(target.alias("o"), joined.alias("all")), at)


def rect_words(rects: DataFrame, words: DataFrame) -> DataFrame:
    """page, rect_id, original, whole: whether the words that a box touches hold its original as whole words.

    rects: page, rect_id, original, b; words: page, block, line, word, text, b.
    """
    w = words.select("page", F.col("b").alias("q"), F.struct("block", "line", "word", "text").alias("w"))
    own = rects.select("page", "rect_id", "original", F.col("b").alias("p"))
    found = met(own, w).select("page", "rect_id", "original", "w")
    under = found.unionByName(own.select("page", "rect_id", "original", F.lit(None).cast(w.schema["w"].dataType).alias("w"))).groupBy("page", "rect_id", "original").agg(F.collect_list("w").alias("words"))
    return under.select("page", "rect_id", "original", whole_words(F.col("original"), F.col("words")).alias("whole"))


def base14(font: Column, flags: Column | None = None) -> Column:
    """The code of the standard font nearest to an embedded one, by family and style."""
    name, bits = F.lower(F.coalesce(font, F.lit(""))), F.coalesce(flags, F.lit(0)) if flags is not None else F.lit(0)
    bold = name.contains("bold") | (bits.bitwiseAND(16) > 0)
    italic = name.contains("italic") | name.contains("oblique") | (bits.bitwiseAND(2) > 0)
    pick = lambda plain, b, i, both: F.when(bold & italic, both).when(bold, b).when(italic, i).otherwise(plain)
    serif = name.rlike("times|serif|georgia|garamond")
    return F.when(serif, pick("tiro", "tibo", "tiit", "tibi")).when(name.rlike("courier|mono|consolas"), pick("cour", "cobo", "coit", "cobi")).otherwise(pick("helv", "hebo", "heit", "hebi"))


def fitted_size(size: Column, available: Column, needed: Column) -> Column:
    """A font size that lets `needed` fit into `available`, not under 5."""
    return F.when((needed > available) & (available > 0), F.greatest(F.lit(5.0), size * available / needed)).otherwise(size)


def guessed_size(height: Column) -> Column:
    """The font size of a box of which no font is known."""
    return F.greatest(F.lit(6.0), F.least(F.lit(11.0), height * 0.7))


def line_size(height: Column) -> Column:
    """The font size of a recognised line."""
    return F.greatest(F.lit(5.0), F.least(F.lit(14.0), height * 0.75))
