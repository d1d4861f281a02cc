"""Token counts of texts of any length by overlap resynchronisation."""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, remember
from .wordids import byte_letters

#: Characters of a chunk, and the overlap to begin with.
CHUNK, OVERLAP = 32_768, 256
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_COUNTERS: dict[tuple, Counter] = {}


class Counter:
    """count(text) as the tokenizers file gives it, special strings handled as its default.

    fast: the same vocabulary as ranks for tiktoken, with its pattern. It serves texts below U+0250 without special strings, where
    both libraries read the pattern's character classes alike; all else goes to tokenizers.
    """

    def __init__(self, path: str, fast: tuple[str, str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        level = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is not None or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE without a normaliser or a blank put in front is supported")
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.chunk, self.overlap, self.fast, self.widened = chunk, overlap, None, 0
        byte = {chr(letter): b for b, letter in byte_letters().items()}
        #: Whether some token holds two bytes side by side, by the first times 256 and the second.
        self.inside = np.zeros(1 << 16, bool)
        for token in spec["model"]["vocab"]:
            data = np.array([byte[c] if c in byte else ord(c) for c in token], np.int64)
            self.inside[data[:-1] * 256 + data[1:]] = True
        if fast:
            import tiktoken

            with open(fast[0], "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("counts", pat_str=fast[1], mergeable_ranks=ranks, special_tokens={})
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for k, v in ranks.items():
                self.sizes[v] = len(k)

    def count(self, text: str) -> int:
        plain = self.fast is not None and max(text, default="") < "ɐ" and not any(s in text for s in self.special)
        if len(text) <= 2 * self.chunk:
            return len(self.fast.encode_ordinary(text)) if plain else len(self.slow.encode(text, add_special_tokens=False).ids)
        return self._spliced(text, plain)

    def _starts(self, text: str, plain: bool) -> np.ndarray:
        """The first character (slow) or byte (fast) of each token."""
        if plain:
            ends = np.cumsum(self.sizes[self.fast.encode_ordinary(text)])
            return np.r_[0, ends[:-1]]
        return np.array([a for a, _ in self.slow.encode(text, add_special_tokens=False).offsets], np.int64)

    def _spliced(self, text: str, plain: bool) -> int:
        """Chunks overlap; two meet at a place where both begin a token and the vocabulary proves that no token crosses.

        Proof: no token holds the two bytes beside that place next to each other, so neither side's merges ever reach over it; and the runs
        that the pattern cuts end alike in both chunks. No such place is taken inside of a special
        string, of which a chunk may hold a part. Where no such place is in the overlap it is widened, then the chunk doubled, so a text without
        any is encoded about six times over.
        """
        total, begin, end = 0, 0, self.chunk
        starts = self._starts(text[:end], plain)
        while end < len(text):
            overlap = self.overlap
            while True:
                lo = max(begin, end - overlap)
                to = min(len(text), lo + self.chunk + overlap)
                following = self._starts(text[lo:to], plain)
                if (at := self._stable(text, begin, lo, end, starts, following, plain)) is not None:
                    break
                self.widened += 1
                if lo == begin:  # nowhere in this chunk: take it twice as long
                    end = min(len(text), 2 * end - begin)
                    starts = self._starts(text[begin:end], plain)
                    if end == len(text):
                        return total + len(starts)
                    overlap = self.overlap
                else:
                    overlap *= 4
            total += int(np.searchsorted(starts, self._unit(text, begin, at, plain)))
            following = following[np.searchsorted(following, self._unit(text, lo, at, plain)) :] - self._unit(text, lo, at, plain)
            starts, begin, end = following, at, to
        return total + len(starts)

    @staticmethod
    def _unit(text: str, begin: int, at: int, plain: bool) -> int:
        return len(text[begin:at].encode()) if plain else at - begin

    def _stable(self, text, begin, lo, end, left, right, plain) -> int | None:
        """The last proven common boundary of two chunks before the last character of their overlap."""
        from_, to = max(lo, begin) + 1, end - 1
        if to <= from_:
            return None
        shared = text[from_ - 1 : to].encode()
        data = np.frombuffer(shared, np.uint8)
        # Places between characters: behind the first one, in bytes from the overlap's beginning.
        heads = np.flatnonzero((data & 0xC0) != 0x80)[1:]
        apart = heads[~self.inside[data[heads - 1].astype(np.int64) * 256 + data[heads]]]
        if not len(apart):
            return None
        if plain:
            a, b = self._unit(text, begin, from_ - 1, True) + apart, self._unit(text, lo, from_ - 1, True) + apart
        else:
            behind = np.searchsorted(heads, apart) + from_  # as characters of the text
            a, b = behind - begin, behind - lo
        good = np.flatnonzero(np.isin(a, left, kind="sort") & np.isin(b, right, kind="sort"))
        for i in good[::-1]:
            p = int(np.searchsorted(heads, apart[i])) + from_
            if not any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in self.special):
                return p
        return None

def _shared(path: str, fast: tuple[str, str] | None) -> Counter:
    """One counter for all tasks of a Python worker."""
    alone("token_counts")
    if (path, fast) not in _COUNTERS:
        _COUNTERS[path, fast] = Counter(path, fast)
        remember("token_counts", _COUNTERS.clear)
    return _COUNTERS[path, fast]


def _counted(path: str, fast, limit: int):
    def run(batches):
        c = _shared(path, fast)
        for b in batches:
            sizes, n = [], []
            for t in b.column("text"):
                text = t.as_py()
                sizes.append(len(t.as_buffer()))
                n.append(c.count(text))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, fast: tuple[str, str] | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) for each row of docs.

    tokenizer: a tokenizers file of the byte-level kind without normaliser; others raise. fast: see Counter. Null text: empty, no tokens.
    A null doc_id stays null; repeated rows are counted each; an empty table gives none. Other columns are not read. Memory is bound by
    the tokens of a chunk, not a text's, but where a text has no place for a long stretch that no token can cross.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInArrow(_counted(tokenizer, fast, limit), RESULT)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), p.path("byte_bpe_50k.json"), (p.path("byte_bpe_50k.tiktoken"), p.PATTERN))
