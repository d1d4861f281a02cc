"""Fingerprints beside a plain version: trees, roots, sketches, likeness, edits, and the query's neighbours."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from umbra.llm import fingerprints as fp

MARKS = "7wWmM_/+=\\-。、，のはをアン\u0e00-\u0e0f\u4e00-\u4eff\u6500-\u65ff\u8000-\u80ff\uac00-\uadff\uc700-\uc7ff"
LEAF = re.compile(rf".{{16,256}}?[aeo,.;:!?][\x20\t\r\n]+|[^\x20\t\r\n]{{16,255}}?[{MARKS}]|.{{1,256}}", re.S)


def digest(x):
    return hashlib.md5(x.encode()).hexdigest()[:16]


def plain_tree(text):
    sections = [m[0] for m in re.finditer(r"(?s).+?(?:\n[\x20\t\r]*\n[\x20\t\r\n]*|\Z)", text)]
    return [[[digest(x[0]) for x in LEAF.finditer(p)] for p in re.findall(r"[^\n]+\n*|\n+", s)] for s in sections]


def plain_print(text):
    t = plain_tree(text)
    top = hashlib.md5("".join(digest("".join(digest("".join(p)) for p in s)) for s in t).encode()).hexdigest()
    leaves = [x[:8] for s in t for p in s for x in p]
    return top, len(leaves), len(set(leaves)), "".join(sorted(set(leaves))[: fp.SKETCH])


def plain_likeness(a, b):
    p, q = plain_print(a), plain_print(b)
    if p[0] == q[0]:
        return 1.0
    if not p[1] or not q[1]:
        return 0.0
    u, v = (set(re.findall(".{8}", x[3])) for x in (p, q))
    some = sorted(u | v) if max(p[2], q[2]) <= fp.SKETCH else sorted(u | v)[: fp.SKETCH]
    j = len(u & v & set(some)) / len(some)
    r = sorted((p[1] / p[2], q[1] / q[2]))
    return 2 * j / (1 + j) * r[0] / r[1]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(6)
    say = lambda n: "".join(r.choice(["word", "ab", "née", "漢字", "end.", "x"]) + str(r.randint(0, 99)) + r.choice([" ", " ", ". ", "\n", "\n\n", " \n \t\n"]) for _ in range(n))
    base = [say(n) for n in (1, 5, 40, 300, 2000)]
    return [None, "", "\n", " ", "\n\n\n", "x" * 3000, "漢" * 600, *base, base[2] * 3, base[3] + base[2], say(3) + base[3], base[4][:9000] + "!" + base[4][9000:], *base]


def test_trees_and_fingerprints(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, leaves string, range int")
    got = {x.doc_id: x for x in fp.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        want = plain_print(t or "")
        assert [[list(p) for p in s] for s in got[i].leaves] == plain_tree(t or "") and got[i].root == want[0]
        assert got[i].fingerprint == ":".join(map(str, want)) and len(got[i].fingerprint) < 1100
    assert "".join(x[0] for s in ["a b\n\nc"] for x in re.finditer(r"(?s).+?(?:\n[\x20\t\r]*\n[\x20\t\r\n]*|\Z)", s)) == "a b\n\nc"


def test_likeness(spark, texts):
    pairs = [(a or "", b or "") for a in texts for b in texts[:14]]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", fp.likeness(*(fp.fingerprint(fp.tree(F.col(c))) for c in "ab")).alias("l")).collect()
    for x in got:
        assert x.l == pytest.approx(plain_likeness(*pairs[x.i])) and 0 <= x.l <= 1
    by = {pairs[x.i]: x.l for x in got}
    base = texts[9]
    assert by[base, base] == 1 and by[texts[12], base] < 0.9  # three copies are not one
    assert by[texts[14], texts[10]] > 0.95  # something put in at the head


def test_edits_stay_where_they_are(spark):
    lines = [f"line {i} goes on for a while, and then it ends here" for i in range(6)]
    a = "\n".join(lines[:3]) + "\n\n" + "\n".join(lines[3:])
    cases = [(a, a), ("", a), (a, ""), (a, "new paragraph\n" + a), (a, a.replace("line 4 goes", "line 4 went")), (a, "a section of its own\n\n" + a)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, a string, b string").select("i", fp.tree(F.col("a")).alias("a"), fp.tree(F.col("b")).alias("b"))
    got = {x.i: ([tuple(y) for y in x.e], x.n) for x in df.select("i", fp.edits(F.col("a"), F.col("b")).alias("e"), fp.n_edited(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got[0] == ([], 0) and got[2] == ([], 0) and got[1][1] == 6
    assert {x[:2] for x in got[1][0]} == {(s, p) for s in (0, 1) for p in range(3)}
    assert got[3] == ([(0, 0, 0)], 1)  # only what was put in, not what stands behind it
    assert got[4] == ([(1, 1, 0)], 1)
    assert got[5] == ([(0, 0, 0), (0, 0, 1)], 1) or got[5] == ([(0, 0, 0)], 1)


@pytest.mark.parametrize("size", [fp.RANGE_BYTES, 200])
def test_query(spark, tmp_path, monkeypatch, texts, size):
    """Each row beside the next one, over many ranges and two levels of them, with a null and a repeated id."""
    monkeypatch.setattr(fp, "RANGE_BYTES", size)
    monkeypatch.setattr(fp, "RANGES", 5 if size == 200 else 512)
    rows = [(None, "no id")] + [(7 * i % 40 - 5, t) for i, t in enumerate(texts)] + [(3, "same id"), (3, "same id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        m = len(t) // 4
        e = t[: len(t) - m] + after[:m]
        marks = lambda x: {digest("".join(p)) for s in plain_tree(x) for p in s}
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), ":".join(map(str, plain_print(t))), ":".join(map(str, plain_print(e))), pytest.approx(plain_likeness(t, e)), pytest.approx(plain_likeness(t, after)), len(marks(e) - marks(t))))
    got = [tuple(x) for x in fp.op10_fingerprints(spark, str(tmp_path)).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[3], x[2])
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x9FA6))), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "0123456789abcdef"])
def test_leaves_of_text_without_blanks(spark, letters):
    """One more character in front leaves nearly all leaves as they were."""
    r = random.Random(7)
    text = "".join(r.choice(letters) for _ in range(20_000))
    rows = spark.createDataFrame([(text, "x" + text)], "a string, b string").select(F.col("a"), F.col("b"), *(fp.fingerprint(fp.tree(F.col(c))).alias(f"f{c}") for c in "ab"))
    assert rows.select(fp.likeness(F.col("fa"), F.col("fb"))).first()[0] > 0.9
