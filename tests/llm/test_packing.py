"""Packing: target proportions, the arithmetic at any size, and the tokenizer's runs."""

import array
import random
import zlib
from collections import Counter as Count
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from umbra.llm import packing, wordids
from umbra.llm.wordids import WordIds

WORDS = P.path("word_bpe_49k.json")


def plain_starts(tokens, shares, quantum):
    """Every quantum by its due time, then by queue."""
    due = sorted((Fraction(2 * k + 1, 2 * w), s, k) for s, (n, w) in enumerate(zip(tokens, shares, strict=True)) for k in range(-(-n // quantum)))
    at, out = 0, {}
    for _, s, k in due:
        out[s, k] = at
        at += min(quantum, tokens[s] - k * quantum)
    return out


@pytest.mark.parametrize("shares", [None, [5, 1, 3, 1], [1, 1, 1, 1]])
def test_order(shares):
    tokens = [1000, 64, 317, 1]
    order = packing.Order(tokens, 16, shares)
    want = plain_starts(tokens, order.shares, 16)
    for s, n in enumerate(order.quanta.tolist()):
        assert order.start(s, 0, n).tolist() == [want[s, k] for k in range(n)]
        assert order.start(s, n // 2, n - n // 2).tolist() == [want[s, k] for k in range(n // 2, n)]


def test_order_of_any_size():
    """The quantum stays, and places are those of unbounded integers."""
    tokens = [5 * 10**12, 3 * 10**12 + 7, 11, 10**9]
    order = packing.Order(tokens)
    assert order.quantum == packing.QUANTUM
    for s, p in enumerate(order.shares):
        for k in {0, p // 2, p - 1}:
            at = k * 128 + sum(min(((2 * k + 1) * q - (t > s)) // p // 2 * 128 + 128 * (((2 * k + 1) * q - (t > s)) // p % 2), n) for t, (n, q) in enumerate(zip(tokens, order.shares, strict=True)) if t != s)
            assert order.start(s, k, 1).tolist() == [at]


@pytest.mark.parametrize("most", [256, 1])
def test_targets(spark, monkeypatch, most):
    """Windows hold the sources by target until one runs out; every id lies in one piece. most 1: by sorted due times."""
    monkeypatch.setattr(packing, "QUEUES", most)
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(50, 400))), s) for i, s in enumerate(["a"] * 30 + ["b"] * 30 + ["c"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    t = Tokenizer.from_file(WORDS)
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for d, x, _ in rows}
    got, docs, seqs = packing.pack(df, WORDS, targets={"a": 6, "b": 3, "c": 1}).collect(), {}, {}
    for x in got:
        assert zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes()) == x.ids_crc32
        docs.setdefault(x.doc_id, []).append((x.start, x.length))
        seqs.setdefault(x.sequence_id, Count())[x.source] += x.length
    assert {d: sum(n for _, n in x) for d, x in docs.items()} == {d: len(a) for d, a in ids.items()}
    total = Count()
    for d, _, s in rows:
        total[s] += len(ids[d])
    whole = int(total["a"] / (0.6 * 2048))  # windows before a runs out
    assert whole >= 5
    for i in range(whole):
        assert all(abs(seqs[i][s] - 2048 * w) <= 2 * packing.QUANTUM for s, w in (("a", 0.6), ("b", 0.3), ("c", 0.1)))


@pytest.mark.parametrize("step,most", [(wordids.STEP, 64 << 20), (50, 4000)])
def test_runs(monkeypatch, step, most):
    """The ids of the library, for texts of every kind, in batches, slices and parts, with a memo that overflows."""
    monkeypatch.setattr(wordids, "STEP", step)
    t, r = Tokenizer.from_file(WORDS), random.Random(1)
    letters = "abzAZ019.,;:'<|>#$%&*!?@[]`{}~_-^\\\"/éßÖñÿ×÷ªºµİΣσςĀ漢 \n\té́\x1c\x01\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>a b<|startoftext|>", "x<|endoftext|>.", "|> <|", "", " ", "a" * 500, "don't can't've"]
    want = [array.array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]
    ids, given = WordIds(WORDS, most), wordids._strings([x.encode() for x in texts])
    assert ids.by_word and list(ids.encode(given)) == want and list(ids.encode(given.slice(7, 900))) == want[7:907]
    assert [ids.ids(x.encode()) for x in texts[-7:]] == want[-7:]


def test_other_tokenizers_encode_whole_texts():
    t, ids = Tokenizer.from_file(P.path("byte_bpe_50k.json")), WordIds(P.path("byte_bpe_50k.json"))
    assert not ids.by_word
    for x in ["", "The cat's  2\n x", "  é漢"]:
        assert ids.ids(x.encode()) == array.array("I", t.encode(x, add_special_tokens=False).ids).tobytes()


def test_null_ids_repeated_rows_and_other_columns(spark):
    rows = [(None, "a b c", None, "x"), (4, "a b c", "s", "y"), (4, "a b c", "s", "y"), (4, None, "s", "z"), (5, "", "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block string")
    got = packing.pack(df, WORDS).collect()
    n = len(Tokenizer.from_file(WORDS).encode("a b c", add_special_tokens=False).ids) + 1
    assert sorted(((x.doc_id or 0), x.doc_tokens) for x in got if x.start == 0) == [(0, n), (4, 1), (4, n), (4, n), (5, 1)]
    assert sum(x.length for x in got) == 3 * n + 2
