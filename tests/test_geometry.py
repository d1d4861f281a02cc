"""Boxes beside plain versions: claims on a page, and pairs that share area by cells."""

import random
import time

import pytest
from pyspark.sql import functions as F

from umbra.operators import geometry as G

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(r, n, size, most):
    out = []
    for _ in range(n):
        x, y = r.choice([r.uniform(0, size), float(r.randint(0, 20))]), r.choice([r.uniform(0, size), float(r.randint(0, 20))])
        out.append((x, y, x + r.choice([0.0, 1.0, r.uniform(0, most)]), y + r.choice([0.0, 2.0, r.uniform(0, most)])))
    return out


def area(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def plain_unclaimed(rows):
    kept = []
    for b in rows:
        s = (b[0] + 0.75, b[1] + 0.75, b[2] - 0.75, b[3] - 0.75)
        s = s if s[2] > s[0] and s[3] > s[1] else b
        if all(area(s, k) == 0 for k in kept):
            kept.append(b)
    return kept


def test_unclaimed(spark):
    r = random.Random(1)
    pages = [boxes(r, n, s, m) for n, s, m in [(0, 9, 9), (1, 9, 9), (8, 20, 9), (9, 20, 9), (60, 50, 9), (150, 400, 20), (200, 30, 3), (120, 5, 50)]]
    df = spark.createDataFrame(list(enumerate(pages)), f"i int, b array<{BOX}>").select("i", G.unclaimed(F.col("b")).alias("k")).orderBy("i")
    for page, row in zip(pages, df.collect(), strict=True):
        assert [tuple(x) for x in row.k] == plain_unclaimed(page)


@pytest.mark.parametrize(("n", "size", "most"), [(40, 30, 9), (200, 100, 5), (150, 20, 200)])
def test_pairs(spark, n, size, most):
    r = random.Random(n)
    left = [(page, i, b) for page in (1, 2, None) for i, b in enumerate(boxes(r, n, size, most))] + [(1, n, None), (3, 0, (0.0, 0.0, 5.0, 5.0))]
    right = [(page, i, b) for page in (1, 2, None) for i, b in enumerate(boxes(r, n, size, most))] + [(1, n, None)]
    got = G.met(spark.createDataFrame(left, f"page int, i int, p {BOX}"), spark.createDataFrame(right, f"page int, j int, q {BOX}"))
    want = sorted((a[0], a[1], c[1]) for a in left for c in right if a[0] is not None and a[0] == c[0] and a[2] and c[2] and area(a[2], c[2]) > 0)
    assert sorted((x.page, x.i, x.j) for x in got.collect()) == want and want


def test_one_page_of_many_boxes(spark):
    """50,000 boxes a side would be 2.5 billion pairs."""
    n = 50_000
    at = lambda i: f"named_struct('x0', cast({i} % 250 * 10 as double), 'y0', cast({i} div 250 * 12 as double), 'x1', cast({i} % 250 * 10 + 11 as double), 'y1', cast({i} div 250 * 12 + 9 as double))"
    rows = spark.range(n).selectExpr("1 as page", "id", f"{at('id')} as b")
    began = time.time()
    best = G.best_spans(rows.select("page", F.col("id").alias("rect_id"), "b"), rows.select("page", (F.col("id") * 2).alias("span_id"), "b"))
    assert best.where("span_id = 2 * rect_id").count() == n
    assert time.time() - began < 60


def test_words_under_boxes(spark):
    rects = spark.createDataFrame([(1, 1, "Acme Ltd", (0.0, 0.0, 50.0, 10.0)), (1, 2, "Acme", (0.0, 0.0, 50.0, 10.0)), (1, 3, "Ac", (0.0, 0.0, 50.0, 10.0)), (2, 4, "Acme", (0.0, 0.0, 50.0, 10.0)), (None, 5, "x", None)], f"page int, rect_id int, original string, b {BOX}")
    words = spark.createDataFrame([(1, 0, 0, 0, "Acme", (0.0, 0.0, 20.0, 9.0)), (1, 0, 0, 1, "Ltd,", (22.0, 0.0, 40.0, 9.0)), (2, 0, 0, 0, "Acme", (60.0, 0.0, 70.0, 9.0))], f"page int, block int, line int, word int, text string, b {BOX}")
    assert {x.rect_id: x.whole for x in G.rect_words(rects, words).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
