"""Code compression and hard negatives beside plain versions, on tables with ties, copies, nulls and odd vectors."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import code_compression as cc
from umbra.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, part int, id long, cell int"


def table(seed, n, spread=1.0, copies=0):
    """Vectors of which many tie: components are few values, and some vectors are copies. With rows that take no part, and clashing columns."""
    r = random.Random(seed)
    rows = [(100 * i + 1 + i % 99, [r.choice([-1, 0, 1, 0.5]) * spread * r.choice([1, 1, 0.99]) for _ in range(16)], r.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(100 * (n + i) + 2, rows[0][1], 1) for i in range(copies)]
    rows += [(100 * i, [r.gauss(0, spread) for _ in range(16)], i % 3) for i in range(1, 8)]
    rows += [(-5, None, 1), (-4, [None] * 16, 1), (-3, [float("nan")] * 16, 2), (-2, [float("inf")] + [0.0] * 15, 0)]
    r.shuffle(rows)
    return [(*x, "v", "c", 0, 7, 1) for x in rows]


def kept(rows, scale):
    good = [x for x in rows if x[1] is not None and all(c is not None and np.isfinite(c) for c in x[1])]
    return [(x[0], np.floor(scale * np.array(x[1], np.float32).astype(float)).astype(np.int64), x[2]) for x in sorted(good, key=lambda x: x[0])]


def plain_codes(rows, n_parts=8, n_entries=16, rounds=6):
    own = kept(rows, 4096)
    x = np.stack([v for _, v, _ in own]).reshape(len(own), n_parts, -1)
    books = x[:n_entries].swapaxes(0, 1).copy()
    for turn in range(rounds + 1):
        d = ((x[:, :, None, :] - books) ** 2).sum(3)
        code, error = d.argmin(2), d.min(2).sum(1)
        for p in range(n_parts if turn < rounds else 0):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    total = {}
    for (_, _, label), e in zip(own, error.tolist(), strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((i, bytes(c.astype(np.uint8)), e, total[label]) for (i, _, label), c, e in zip(own, code, error.tolist(), strict=True)), digest


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 150, 1.0), (2, 400, 0.01), (3, 60, 40.0), (4, 3, 1.0)])
def test_codes(spark, seed, n, spread):
    rows = table(seed, n, spread, copies=n // 2)
    found = cc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, digest = plain_codes(rows)
    assert found.digest() == digest
    got = found.with_label_errors("label")
    assert sorted((r.vec_id, bytes(r.code), r.error, r.label_error) for r in got.collect()) == want


def test_codes_skip_distances(spark):
    """The bounds spare most distances, and what they spare changes nothing."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(16, 16))
    rows = [(i, (centres[i % 16] + r.normal(size=16) * 0.02).tolist(), 0, "", "", 0, 0, 0) for i in range(800)]
    found = cc.compress(spark.createDataFrame(rows, SCHEMA))
    want, digest = plain_codes(rows)
    assert found.digest() == digest and sorted((r.vec_id, bytes(r.code)) for r in found.rows.collect()) == [w[:2] for w in want]
    assert found.n_distances[0] > 800 * 8 * 10 and max(found.n_distances[2:]) < 800 * 8 * 2


def test_codes_of_odd_tables(spark):
    none = cc.compress(spark.createDataFrame([], SCHEMA))
    assert none.with_label_errors("label").collect() == [] and none.digest() == hashlib.sha256(b"").hexdigest()
    # Uneven lengths are filled up with 0, an empty vector too; shared keys and null keys are rows of their own; huge components are kept in bounds.
    rows = [(1, [0.5, 1.0, 2.0], 1), (1, [], 1), (None, [3e38, -3e38], None), (2, [0.5, 1.0, 2.0], None), (2, [0.5, 1.0, 2.0], None)]
    found = cc.compress(spark.createDataFrame([(*x, "", "", 0, 0, 0) for x in rows], SCHEMA), n_parts=2, n_entries=8)
    assert found.books.shape == (2, 5, 2)
    assert sorted((r.vec_id or 0, bytes(r.code).hex(), r.error, r.label_error) for r in found.with_label_errors("label").collect()) == [(0, "0400", 0, 0), (1, "0000", 0, 0), (1, "0101", 0, 0), (2, "0101", 0, 0), (2, "0101", 0, 0)]


def plain_negatives(rows, every=100, n_positives=5, n_negatives=10):
    own = [x for x in kept(rows, 256) if x[2] is not None]
    out = []
    for a, v, label in own:
        if a % every == 0:
            score = sorted((-int(v @ w), i, m) for i, w, m in own if i != a)
            for p, i, m in [s for s in score if s[2] == label][:n_positives]:
                near = [s for s in score if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:n_negatives]
                out += [(a, i, k + 1, j, -p, -q) for k, (q, j, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "spread", "copies", "group"), [(1, 300, 1.0, 0, 2048), (2, 300, 0.05, 300, 32), (3, 1500, 1.0, 700, 64), (4, 2, 1.0, 0, 2048), (5, 200, 40000.0, 5, 64)])
def test_negatives(spark, monkeypatch, seed, n, spread, copies, group):
    monkeypatch.setattr(hn, "LEAST", 16)  # many cells, so that rounds and bounds come into play
    rows = table(seed, n, spread, copies)
    found = hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), group=group)
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows)


def test_search_leaves_out_what_is_too_far(spark, monkeypatch):
    """Cells beyond the bound are not scanned: with rows in clusters far apart an anchor meets its own."""
    monkeypatch.setattr(hn, "LEAST", 8)
    r = np.random.default_rng(2)
    centres = r.normal(size=(16, 8)) * 100
    rows = [(i, np.floor(centres[i % 16] + r.normal(size=8)).astype(int).tolist(), 0) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>, label long")
    index = hn.Index(df)
    one = F.array(F.struct(F.lit(0).alias("j"), F.lit(hn.NEVER).alias("low"), F.lit(None).cast("long").alias("high")))
    sizes = []
    real = hn.stored_at
    monkeypatch.setattr(hn, "stored_at", lambda d, name: (lambda out: (sizes.append(out[0].count()) if name == "asks" else None, out)[1])(real(d, name)))
    found = hn.search(index, df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor"), "vec_id", "label", "v", one.alias("searches")), 5, True)
    assert found.count() == 16 * 5 and sum(sizes) < 16 * len(index.cells) / 2


def test_negatives_of_odd_tables(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.mine(spark.createDataFrame([(1, [1.0], 1, "", "", 0, 0, 0)], SCHEMA)).collect() == []  # no anchor
    # Rows that share the anchor's key are none of its others; lengths differ; a null key or label takes no part.
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.5, 9.0], 2), (2, [0.5, 9.0], 2), (None, [0.5], 2), (3, [0.5], None), (4, [], 2)]
    found = hn.mine(spark.createDataFrame([(*x, "", "", 0, 0, 0) for x in rows], SCHEMA))
    assert sorted(tuple(r) for r in found.collect()) == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 2, 65536, 32768)]
