"""Numbers over ranges beside one window, on keys that are sparse, alike at their beginnings, frequent, tied or null; names for zips and folders."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.operators import numbering as N

N_ROWS = 60_000
KEYS = {
    "dense": "id",
    "hashed": "xxhash64(id)",
    "alike": "concat('https://example.org/files/', lpad(id, 12, '0'))",
    "hot": "if(id % 3 = 0, 'http', concat('http', xxhash64(id)))",
    "null": "if(id % 5 = 0, null, cast(id % 100 as string))",
    "double": "cast(xxhash64(id) as double) / 7",
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_same_as_one_window(spark, kind, groups):
    rows = spark.range(N_ROWS).selectExpr("id", f"{KEYS[kind]} as k", "if(id % 2 = 0, 'big', if(id % 7 = 0, null, cast(id % 1000 as string))) as g", "xxhash64(id, 3) as o").repartition(7)
    got = N.numbered(rows, groups, "k", ["o"], "n", size=1000)
    want = rows.withColumn("w", F.row_number().over(Window.partitionBy(*(groups or [F.lit(0)])).orderBy("k", "o")))
    assert got.columns == [*rows.columns, "n"] and got.count() == N_ROWS
    assert got.select("id", "n").exceptAll(want.select("id", F.col("w").cast("long"))).isEmpty()


@pytest.mark.parametrize("kind", ["hashed", "alike", "hot", "null"])
def test_no_task_has_more_than_its_range(spark, kind):
    rows = spark.range(N_ROWS).selectExpr(f"{KEYS[kind]} as k", "id as o")
    cuts = N.ranges(rows.select(F.struct("k", "o").alias("k")), 1000)
    sizes = rows.groupBy(N.range_of(F.struct("k", "o"), cuts, T.StructType(rows.schema.fields)).alias("b")).count().collect()
    assert len(sizes) == len(cuts) + 1 > 50 and max(r["count"] for r in sizes) < 3000  # 1,000 on average


def test_bounds_from_other_keys(spark):
    """Whatever the sample says, the numbers are the same."""
    rows = spark.range(5000).selectExpr("id % 700 as k", "xxhash64(id) as o", "id % 3 as g")
    want = sorted(map(tuple, N.numbered(rows, ["g"], "k", ["o"], "n").collect()))
    for keys in ("id as k", "id * 100 as k", "cast(null as long) as k"):
        got = N.numbered(rows, ["g"], "k", ["o"], "n", size=50, keys=spark.range(1000).selectExpr(keys))
        assert sorted(map(tuple, got.collect())) == want


def test_small_and_empty(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "b"), (1, "a")], "k long, o string")
    assert sorted(tuple(r) for r in N.numbered(rows, [], "k", ["o"], "n").collect()) == [(1, "a", 1), (1, "b", 2), (3, "a", 3)]
    assert N.numbered(rows.limit(0), ["o"], "k", [], "n").collect() == []


def plain_folder(names):
    given, seen, out = set(names), set(), []
    for n in names:
        if n in seen:
            i = n.rfind(".")
            stem, ext = (n[:i], n[i:]) if i >= 0 and i < len(n) - 1 else (n, "")
            k = 1
            while f"{stem} ({k}){ext}" in given or f"{stem} ({k}){ext}" in seen:
                k += 1
            n = f"{stem} ({k}){ext}"
        seen.add(n)
        out.append(n)
    return out


def test_folder_names(spark):
    r = random.Random(4)
    names = ["a.txt", "a.txt", "a (1).txt", "a (1).txt", "a (2).txt", "a", "a", "a (1)", "a (1) (1).txt", "b.tar.gz", "b.tar.gz", "b.tar (1).gz", "é x.PDF", "é x.PDF", ".x", ".x", "a (01).txt", "c.", "c."]
    names += [r.choice(["d.x", "d (1).x", "d (3).x", "d (4).x", "d (4) (1).x"]) for _ in range(60)]
    files = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, name string").repartition(4)
    got = [x.folder_name for x in N.folder_names(files, "name", "i").orderBy("i").collect()]
    assert got == plain_folder(names) and len(set(got)) == len(got)


def test_zip_names(spark):
    files = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "a (1).txt"), (4, "a.txt"), (5, "b")], "i long, name string")
    assert [x.zip_name for x in N.zip_names(files, "name", "i").orderBy("i").collect()] == ["a.txt", "a (1).txt", "a (1).txt", "a (2).txt", "b"]


def test_union_of_numbered_rows(spark):
    """What placeholders do: numbered rows beside others, over many ranges, with columns that may be null."""
    rows = spark.createDataFrame([(i % 90, i, "ab"[i % 2]) for i in range(4000)], "k long, o long, g string")
    both = N.numbered(rows.where("g = 'a'"), ["g"], "k", ["o"], "n", size=100).unionByName(rows.where("g = 'b'").withColumn("n", F.lit(0).cast("long")))
    got = both.join(rows.select("o", F.col("g").alias("h")), "o").where("n = 0 or g = 'a'")
    assert got.count() == 4000 and got.agg(F.max("n")).first()[0] == 2000


def test_columns_of_any_name(spark):
    """Over many ranges the columns of its own are none of the rows'."""
    rows = spark.createDataFrame([(i % 7, i, -i) for i in range(400)], "_b long, _c0 long, _r long")
    for name in ("_n", "_g0", "_C1"):
        got = N.numbered(rows, ["_b"], "_c0", ["_r"], name, size=50)
        assert got.columns == [*rows.columns, name] and sorted(map(tuple, got.collect())) == sorted((i % 7, i, -i, i // 7 + 1) for i in range(400))


def test_folder_names_over_many_ranges(spark):
    names = [f"f{i % 9000} (1).txt" if i % 5 == 0 else f"f{i % 9000}.txt" for i in range(110_000)]
    files = spark.range(len(names)).selectExpr("id as i", "concat('f', id % 9000, if(id % 5 = 0, ' (1)', ''), '.txt') as name")
    assert [x.folder_name for x in N.folder_names(files, "name", "i").orderBy("i").collect()] == plain_folder(names)
