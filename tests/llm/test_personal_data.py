"""Personal data beside the contract's own patterns; the CRF by held-out lines; Viterbi beside all paths."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from umbra.llm import personal_data as pd

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    def good(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            return 12 <= len(d) <= 19 and s % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(kind, m[0]))


@pytest.fixture(scope="module")
def crf():
    return pd.train(pd.realised())


def test_rules_match_the_patterns():
    r = random.Random(1)
    some = ["1", "4", "25", "300", "0", ".", ".", "-", " ", "@", "@", "a", "b.c", "+", "+1", "(", ")", "é", "\n", "4111 1111 1111 1111", "_", "%", "x@y.z", "😀"]
    for _ in range(4000):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 30)))
        assert pd.by_rules(text) == plain(text), text


def test_rules_are_linear():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "+1" * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "a@b" + "-" * 300_000, "x@ " * 100_000):
        pd.by_rules(text)
    assert time.time() - began < 20


def test_held_out_lines(crf):
    lines = pd.realised(times=3, seed=5)
    finder = pd.Finder(crf)
    for text, _ in lines:
        finder.add(text)
    hit = wrong = missed = 0
    for (_, marks), (base, found) in zip(lines, finder.done(), strict=True):
        assert set(base) <= set(found)
        hit, wrong, missed = hit + len(set(marks) & set(found)), wrong + len(set(found) - set(marks)), missed + len(set(marks) - set(found))
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.9


def test_adds_to_the_rules(crf):
    finder = pd.Finder(crf)
    cases = {"please call (415) 555-0132 today": "(415) 555-0132", "write to jane at mail dot com soon": "jane at mail dot com", "host 10[.]20[.]30[.]40 is up": "10[.]20[.]30[.]40", "card 4111.1111.1111.1111 was charged": "4111.1111.1111.1111"}
    clean = ["version 4.0. came out", "1999-2026 and 12:30:45", "we met at the dot on the map", "id 4111111111111112 is none", "a@ b @c"]
    for text in [*cases, *clean]:
        finder.add(text)
    got = [[t[a:b] for a, _, b in found] for t, (_, found) in zip([*cases, *clean], finder.done(), strict=True)]
    assert got == [[x] for x in cases.values()] + [[]] * len(clean)


def test_viterbi_beside_all_paths():
    r = np.random.default_rng(3)
    crf = pd.Crf(r.normal(size=(pd.N_FEATURES, pd.LABELS)), r.normal(size=(pd.LABELS, pd.LABELS)))
    texts = ["1", "a 2", "x 3 y", "+4 b 1", "é", "9 9 9", ""]
    sequences = [pd.Tokens(t, 0, len(t)) for t in texts]
    for tokens, labels in zip(sequences, crf.viterbi(sequences), strict=True):
        n = len(tokens.shape)
        feats, _ = pd.features([tokens])
        score = crf.weights[feats].sum(1)
        paths = [p for p in itertools.product(range(pd.LABELS), repeat=n) if n == 0 or (pd.BEGINS[p[0]] and all(pd.FOLLOWS[a, b] for a, b in itertools.pairwise(p)))]
        total = lambda p: sum(score[i, x] for i, x in enumerate(p)) + sum(crf.steps[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(labels) == max(paths, key=total)


def test_parts_of_a_long_text(crf, monkeypatch):
    """A stretch longer than a part is found the same, and memory is bound by parts."""
    text = " ".join(f"{i} word" if i % 50 else f"call (415) 555-{i % 10000:04d} now" for i in range(3000))
    finder = pd.Finder(crf)
    finder.add(text)
    whole = finder.done()
    assert len(whole[0][1]) == 60
    monkeypatch.setattr(pd, "LONG", 1500)
    monkeypatch.setattr(pd, "GATHERED", 500)
    finder.add(text)
    assert finder.held <= 500 + 1500 and finder.done() == whole


def test_operator(spark):
    rows = [(1, "mail a.b@c.de or +49 30 1234567 from 1.2.3.4"), (None, "x@y.z"), (2, None), (2, None), (3, ""), (4, "call (415) 555-0132 now"), (5, "😀 a@b.c " * 20000)]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, base int, key string").repartition(3)
    got = {(r.doc_id, len(r.base), len(r.spans)): r for r in pd.personal_data(df).collect()}
    assert sorted(got, key=str) == sorted([(1, 3, 3), (None, 1, 1), (2, 0, 0), (3, 0, 0), (4, 0, 1), (5, 20000, 20000)], key=str)
    assert [tuple(s) for s in got[1, 3, 3].base] == [("email", 5, 13), ("phone", 17, 31), ("ip", 37, 44)]
    assert tuple(got[5, 20000, 20000].base[1]) == ("email", 10, 15)
    assert pd.personal_data(df.limit(0)).collect() == []
    named = pd.personal_data(df.withColumn("doc_id", df["doc_id"].cast("string")))
    assert {r.doc_id for r in named.collect()} == {"1", "2", "3", "4", "5", None}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    kinds, rows = list(PATTERNS), pd.op12_personal_data(spark, d).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        joined = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r.spans.split(",")) | {""}
