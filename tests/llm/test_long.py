"""Texts and conversations of some megabytes, null keys and clashing columns, for the operators whose other tests have short ones."""

import hashlib
import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from umbra.llm import line_dedup, packing, quality, simhash
from umbra.llm.chat import format_conversations, loss_text, read_back
from umbra.llm.fingerprints import fingerprints, likeness


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 8))) for _ in range(500)]
    long = "\n".join(" ".join(r.choice(words) for _ in range(12)) + f" line{i}" for i in range(30_000))  # over 2 MB
    return [long, long + "\nand one more line at the end", "a short text of ten words or so, which is kept", long]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words long, tokens string").repartition(2).cache()


def test_quality(docs, texts):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_words == len(re.findall(r"[^\x20\x09-\x0D]+", t)) and got[i].word_chars == sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", t)))


def test_lines(docs, texts):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert (got[0].n_kept, got[1].n_kept, got[3].n_kept) == (30_000, 1, 0) and got[0].text == texts[0] and got[1].text == "and one more line at the end"


def test_simhash(docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got[0] == got[3] and got[1][1] == 0 and got[2][1] == 2


def test_packing(docs, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).select("doc_id", "start", "length", "doc_tokens").collect()
    for i in (0, 2):
        own = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        n = len(t.encode(texts[i], add_special_tokens=False).ids) + 1
        assert own[0][0] == 0 and all(a + n_ == b for (a, n_), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == n == next(r.doc_tokens for r in rows if r.doc_id == i)


def test_fingerprints(docs):
    rows = {r.doc_id: r for r in fingerprints(docs).select("doc_id", "fingerprint", "root").collect()}
    assert rows[0].fingerprint == rows[3].fingerprint and rows[0].root != rows[1].root
    pair = docs.sparkSession.createDataFrame([(rows[0].fingerprint, rows[1].fingerprint, rows[2].fingerprint)], "a string, b string, c string")
    near, far = pair.select(likeness(F.col("a"), F.col("b")), likeness(F.col("a"), F.col("c"))).first()
    assert near > 0.95 and far < 0.05


def test_conversations(spark):
    """One of 20,000 turns, one text of two megabytes, two rows of no conversation; columns with the names of the result."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} [INST]") for i in range(20_000)] + [(2, 0, "user", "</s>" * 500_000), (2, 1, "assistant", "ok"), (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x", True, "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, valid boolean, turns string").repartition(3)
    got = {r.conv_id: r for r in format_conversations(df).select("conv_id", "valid", F.sha2(F.to_json(read_back(F.col("formatted"))), 256).alias("back"), F.length(loss_text(F.col("segments"))).alias("loss"), F.size(read_back(F.col("formatted"))).alias("n"), read_back(F.col("formatted"))[0]["text"].alias("first")).collect()}
    assert (got[1].n, got[2].n, got[None].n) == (20_000, 2, 2) and got[2].first == "</s>" * 500_000 and got[None].first == "q"
    assert all(r.valid for r in got.values()) and got[1].loss == sum(len(r[3]) for r in rows if r[0] == 1 and r[2] == "assistant")
    assert len({r.back for r in got.values()}) == 3 and hashlib.sha256(b"").hexdigest() not in {r.back for r in got.values()}
