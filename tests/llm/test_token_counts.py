"""Token counts beside the libraries, through the table too, and in time that grows with the text."""

import random
import time

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from umbra.llm import token_counts
from umbra.llm.queries import op4_sentencepiece, op9_token_counts

BYTES = P.path("byte_bpe_50k.json")
FAST = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
SF = "/root/testdata/sf0.001"


def odd():
    r = random.Random(1)
    return [
        "", " ", "x" * 3000 + " y", " " * 3000, "ab \u0085 \x1c\x1d c'll  d 's\r\n" * 100, "a<|endoftext|>b " * 200, "漢字 かな " * 300, "漢" * 900, "<|endoftext|>" * 200, "'s" * 900, "!'s" * 700, "don't've" * 300, "😀👍🏽" * 300, "é" * 2000,
        *("".join(r.choice(c) for _ in range(4000)) for c in ("ab 1.\n'sé漢 \t", "ab 1.\n'sé \t\x1c", "a \n", "漢字仮名交文", "a1é漢!'", "'sta!<|endofx>", "ACGT", "0123456789abcdef")),
    ]


@pytest.mark.parametrize("fast", [None, FAST])
@pytest.mark.parametrize("chunk,overlap", [(150, 4), (64, 1), (1000, 16)])
def test_counts(fast, chunk, overlap):
    t, c = Tokenizer.from_file(BYTES), token_counts.Counter(BYTES, fast, chunk=chunk, overlap=overlap)
    for x in odd():
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), x[:40]
    assert c.widened


def test_time_grows_with_the_text():
    """Text without blanks: a few times what the library takes."""
    r = random.Random(2)
    text = "".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(400_000))
    t, c = Tokenizer.from_file(BYTES), token_counts.Counter(BYTES)
    began = time.process_time()
    want = len(t.encode(text, add_special_tokens=False).ids)
    library = time.process_time() - began
    began = time.process_time()
    assert c.count(text) == want
    assert time.process_time() - began < 6 * library + 1


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(P.path("word_bpe_49k.json"))


def test_table(spark):
    """Null texts, null and repeated ids, long texts, other columns."""
    texts = [None, *odd(), "one  two" * 30_000]
    rows = [(None if i == 3 else i // 2, t, "x", 5) for i, t in enumerate(texts)]
    t = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, b int").repartition(3), BYTES, FAST).collect()
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x, *_ in rows]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_queries_beside_the_libraries(spark):
    import zlib

    import numpy as np
    import sentencepiece

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    t = Tokenizer.from_file(BYTES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op9_token_counts(spark, SF).collect()}
    assert got == {d: (len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for d, x in docs.items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.round_trip) for r in op4_sentencepiece(spark, SF).collect()}
    assert got == {d: (len(ids := sp.encode(x)), zlib.crc32(np.array(ids, "<u4").tobytes()), sp.decode(ids) == x) for d, x in docs.items()}
