"""SentencePiece beside the library, and shortest paths beside all paths."""

import array
import random
import struct
from itertools import pairwise, product

import public_tokenizers as P
import pytest
import sentencepiece

from umbra.llm.sentencepieces import Model, Normaliser, Transducer, encode

PIECES = P.path("piece_bpe_32k.model")


def texts():
    r = random.Random(1)
    return [
        "", " ", "x" * 3000 + " y", " " * 3000, "ab \u0085 \x1c\x1d c'll  d 's\r\n" * 100, "漢字 かな " * 300, "  a  b\n c\tü漢☃ ", "▁▁ x", "a ▁b", "<0x0A> </s> <unk> \x00", "     x    ",
        *("".join(r.choice(c) for _ in range(4000)) for c in ("ab 1.\n'sé漢 \t", "a \n", "the of and ", "aaaabbbb ▁")),
    ]


@pytest.mark.parametrize("most", [40 << 20, 3000])
def test_like_the_library(most):
    sp, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(Model(PIECES), most)
    for x in texts() * 2:
        ids = t.encode(x)
        assert list(array.array("I", ids)) == sp.encode(x)
        assert t.decode(ids) == sp.decode(sp.encode(x))


def made(pieces, prefix=False, squeeze=False, kind=1):
    m = Model.__new__(Model)
    m.pieces, m.kind, m.prefix, m.squeeze, m.bytes, m.unknown = pieces, kind, prefix, squeeze, {}, 0
    m.text = {p: i for i, (p, _, k) in enumerate(pieces) if k == 1}
    return m


def test_unigram_is_the_least_of_all_paths():
    """Random weights: the path's weight is the least of all ways to cut the text."""
    r = random.Random(4)
    for _ in range(60):
        pieces = [("<unk>", 0.0, 2), ("a", -r.random() * 9, 1), ("b", -r.random() * 9, 1)] + [("".join(x), -r.random() * 9, 1) for n in (2, 3, 4) for x in product("ab", repeat=n) if r.random() < 0.4]
        t, text = Transducer(made(pieces)), "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        score = {p: -w for p, w, k in pieces if k == 1}
        cuts = [[0, *(i for i, v in enumerate(bits, 1) if v), len(text)] for bits in product((0, 1), repeat=len(text) - 1)]
        ways = [[text[a:b] for a, b in pairwise(c)] for c in cuts]
        best = min(sum(map(score.get, w)) for w in ways if all(x in score for x in w))
        ids = t.shortest(text)
        assert "".join(pieces[i][0] for i in ids) == text and sum(score[pieces[i][0]] for i in ids) == pytest.approx(best)
    t = Transducer(made([("<unk>", 0.0, 2), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -5.0, 1), ("ba", -1.0, 1)]))
    assert t.shortest("aba") == [1, 4] and t.shortest("ab") == [3] and t.shortest("axb") == [1, 0, 2]


@pytest.mark.parametrize("prefix,squeeze", [(True, True), (True, False), (False, True), (False, False)])
def test_normaliser(prefix, squeeze):
    n = Normaliser(made([], prefix, squeeze))
    for x in ["", " ", "a", "  a", "a  b ", " a b  c  ", "   "]:
        want = " ".join(y for y in x.split(" ") if y) if squeeze else x
        assert n.compose(x) == ((" " if prefix and want else "") + want).replace(" ", "▁")


def test_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(None, "a b", 1), (4, None, 2), (4, "", 3), (4, "x y", 4), (4, "x y", 4), (5, "long " * 50_000, 5)]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PIECES).collect()
    want = [(d, len(ids := sp.encode(t or "")), bytearray(array.array("I", ids).tobytes()), sp.decode(ids)) for d, t, _ in rows]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def written(path, pieces, kind, fallback=False, prefix=True):
    """A model file with the given pieces, as the library reads it."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    part = lambda n, b: number(n << 3 | 2) + number(len(b)) + b
    flag = lambda n, v: number(n << 3) + number(v)
    data = b"".join(part(1, part(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", w) + flag(3, k)) for p, w, k in pieces)
    data += part(2, flag(3, kind) + flag(35, int(fallback))) + part(3, part(1, b"identity") + flag(3, int(prefix)) + flag(4, 1) + flag(5, 1))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_like_the_library(tmp_path, fallback):
    """Made-up weights, characters that no piece is, alone and in rows; ids and texts are the library's."""
    r = random.Random(6)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if fallback else [])
    pieces += [("".join(x), -round(r.random() * 9, 3), 1) for n in (1, 2, 3) for x in product("ab\u2581", repeat=n) if (n == 1 or r.random() < 0.5) and "\u2581" not in x[1:]]
    path = written(tmp_path / "m.model", pieces, 1, fallback)
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), Transducer(Model(path))
    for _ in range(500):
        x = "".join(r.choice("aaabbb  xy\u00e9\u6f22\U0001f600") for _ in range(r.randint(0, 30)))
        ids = t.encode(x)
        assert list(array.array("I", ids)) == sp.encode(x), x
        assert t.decode(ids) == sp.decode(sp.encode(x))


def test_models_that_are_refused(tmp_path):
    path = written(tmp_path / "m.model", [("<unk>", 0.0, 2), ("a", -1.0, 1), ("<x>", 0.0, 4)], 1)
    with pytest.raises(ValueError, match="user-defined"):
        Model(path)
