"""Numbers in an order that is too long for one task: parted into ranges, counted, and numbered inside of the ranges."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import let

#: Keys that the ranges are learned from, those of least hash; and rows that a range has, on average. A range's bounds decide who numbers a row,
#: never its number.
SAMPLE, ROWS = 1 << 14, 50_000
#: Ranges at most: then each has an equal share of the rows.
MOST = 1 << 11
#: Ranges whose bounds a row is compared with at a time.
SIDE = 1 << 5


def ranges(keys: DataFrame, rows: int = ROWS) -> list[str]:
    """Bounds between ranges of about `rows` rows: values of the one column of keys, a struct, as JSON, ascending."""
    (name,) = keys.columns
    h = F.xxhash64(name, F.monotonically_increasing_id())
    sample = keys.select(h.alias("_h"), name).orderBy("_h").limit(SAMPLE).orderBy(name).select("_h", F.to_json(name).alias("_j")).collect()
    if not sample:
        return []
    # Hashes are even over 64 bits, so the greatest of the least ones tells how many rows there are.
    n = len(sample) if len(sample) < SAMPLE else int(len(sample) / max(1e-18, (max(r["_h"] for r in sample) + 2.0**63) / 2.0**64))
    wanted = min(MOST, -(-n // rows), len(sample))
    cuts = [sample[i * len(sample) // wanted]["_j"] for i in range(1, wanted)]
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def range_of(key: Column, cuts: list[str], kind: T.DataType) -> Column:
    """How many of the bounds are not above key, a struct of type `kind`. They are constants: rows are compared with every SIDE-th, and then with those behind it."""
    if not cuts:
        return F.lit(0)
    constant = lambda text, k: F.from_json(F.lit(f'{{"b":{text}}}'), T.StructType([T.StructField("b", k)]))["b"]
    heads = constant(f"[{','.join(cuts[::SIDE])}]", T.ArrayType(kind))
    inner = constant("[" + ",".join(f"[{','.join(cuts[i : i + SIDE])}]" for i in range(0, len(cuts), SIDE)) + "]", T.ArrayType(T.ArrayType(kind)))
    # The key is bound first: the optimiser misses columns that only a lambda's body names, and a union behind then fails.
    under = lambda bounds, k: F.size(F.filter(bounds, lambda c: c <= k))
    return let(key, lambda k: let(under(heads, k), lambda i: F.when(i == 0, F.lit(0)).otherwise((i - 1) * SIDE + under(F.get(inner, i - 1), k))))


def numbered(rows: DataFrame, groups: list[str], key: str, order: list[str], name: str, size: int = ROWS, keys: DataFrame | None = None) -> DataFrame:
    """rows with the place of each, from 1, in its group by key and order, nulls first.

    Rows are dealt by ranges of (key, order), whose bounds come from a sample and whose sizes are even whatever the keys look like; a frequent key
    is in several ranges, parted by what stands behind it in the order, and so is a frequent group. A row's place is the rows of its group
    in the ranges before, and its place within its range. So no task has more than a range, and none sees more than a count of each
    range and group. keys: a table whose column key is spread as that of rows is; then the sample costs no second look at rows.
    """
    place = F.struct(key, *order)
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select(key, *order).schema.fields])
    if keys is None:
        keyed = rows.select(place.alias("k"))
    else:
        keyed = keys.select(F.struct(F.col(key).cast(kind[0].dataType), *(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:])).alias("k"))
    cuts = ranges(keyed, size)
    r, at, c, a, n, *names = _free([*rows.columns, name], 5 + len(groups))
    own = rows.withColumn(r, range_of(place, cuts, kind))
    inside = F.row_number().over(Window.partitionBy(r, *groups).orderBy(key, *order))
    if not cuts:
        return own.withColumn(name, inside.cast("long")).drop(r)
    sizes = own.groupBy(*(F.col(g).alias(own_g) for g, own_g in zip(groups, names, strict=True)), F.col(r).alias(at)).agg(F.count("*").alias(c))
    # At most MOST rows a group.
    ahead = Window.partitionBy(*(names or [F.lit(0)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*names, at, F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(a))
    met = F.col(r) == F.col(at)
    for g, own_g in zip(groups, names, strict=True):
        met &= F.col(g).eqNullSafe(F.col(own_g))
    joined = own.withColumn(n, inside).join(bases if groups else F.broadcast(bases), met)
    return joined.withColumn(name, F.col(a) + F.col(n)).drop(r, at, a, n, *names)


def _free(taken: list[str], n: int) -> list[str]:
    """n column names that are none of those taken, in any case."""
    low = {c.lower() for c in taken}
    return list(itertools.islice((c for c in (f"_c{i}" for i in itertools.count()) if c not in low), n))


def parted(name: Column) -> tuple[Column, Column]:
    """Stem and extension, with its dot, of a file name; that of `.profile` is all extension."""
    return F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]+)?$", 1), F.regexp_extract(name, r"(\.[^.]+)$", 1)


def zip_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """Names as a zip file takes them: the second of a name gets ' (1)' before its extension, and so on. A zip may hold a name twice."""
    placed = numbered(files, [name], order, [], "_z").withColumn("_z", F.col("_z") - 1)
    stem, ext = parted(F.col(name))
    return placed.withColumn("zip_name", F.when(F.col("_z") > 0, F.concat(stem, F.lit(" ("), F.col("_z").cast("string"), F.lit(")"), ext)).otherwise(F.col(name))).drop("_z")


def folder_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """files with folder_name: names of which no two are equal. The first of a name has it, the others get the least numbers that no given name has.

    order: distinct values that say which is first. A numbered name belongs to one name only, so only given names can be in its way. Of a
    name's free numbers the j-th is j and as many more as there are taken ones below it: the place of j among the copies, and the taken
    numbers, each less its own place among them.
    """
    copies = numbered(files.select(F.col(name).alias("_name"), F.col(order).alias("_o")), ["_name"], "_o", [], "_j").withColumn("_j", F.col("_j") - 1)
    given = files.select(F.col(name).alias("_name")).distinct()
    pattern = r"(?s)^(.*) \(([1-9][0-9]{0,17})\)(\.[^.]+)?$"
    part = lambda i: F.regexp_extract("_name", pattern, i)
    ext = F.coalesce(part(3), F.lit(""))
    # A number is in the way only if the name without it, parted again, gives the same name with it.
    bare = given.where(part(2) != "").select(F.concat(part(1), ext).alias("_name"), part(1).alias("_s"), ext.alias("_e"), part(2).cast("long").alias("_t"))
    stem, own_ext = parted(F.col("_name"))
    bare = bare.where((stem == F.col("_s")) & (own_ext == F.col("_e"))).select("_name", "_t")
    taken = numbered(bare, ["_name"], "_t", [], "_p").select("_name", (F.col("_t") - F.col("_p")).alias("_v"), F.lit(1).alias("_kind"), F.col("_t").alias("_o2"), F.lit(None).cast(files.schema[order].dataType).alias("_o"))
    rest = copies.where("_j > 0").select("_name", F.col("_j").alias("_v"), F.lit(0).alias("_kind"), F.col("_j").alias("_o2"), "_o")
    placed = numbered(rest.unionByName(taken), ["_name"], "_v", ["_kind", "_o2"], "_n").where("_kind = 0").select(F.col("_o").alias("_of"), "_n")
    stem, ext = parted(F.col(name))
    joined = files.join(placed, F.col(order) == F.col("_of"), "left")
    return joined.withColumn("folder_name", F.when(F.col("_n").isNotNull(), F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext)).otherwise(F.col(name))).drop("_n", "_of")
