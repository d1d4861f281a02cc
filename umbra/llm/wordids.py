"""Ids of a tokenizers file, run by run of letters or marks through a bounded memo where the file allows it."""

from __future__ import annotations

import array
import json
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import alone, remember

#: Bytes of text that are cut and looked up at a time, and of runs that the library encodes at a time.
STEP, GROUP = 2 << 20, 1 << 18
#: Bytes that an entry of the memo takes beside its run and ids; longer runs are encoded each time they come.
ENTRY, LONG = 120, 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# The normaliser and the pattern under which a word's runs of letters, single digits and runs of marks are encoded apart.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


_SHARED: dict[str, WordIds] = {}


def shared(path: str) -> WordIds:
    """One memo for all tasks of a Python worker."""
    alone("wordids")
    if path not in _SHARED:
        _SHARED[path] = WordIds(path)
        remember("wordids", _SHARED.clear)
    return _SHARED[path]


def _classes() -> np.ndarray:
    """The class of each byte. OTHER: no ASCII, control characters, ' (contractions) and < (special strings)."""
    out = np.full(256, OTHER, np.uint8)
    for b in range(33, 127):
        out[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER if chr(b) in "'<" else MARK
    out[[32, *range(9, 14)]] = SPACE
    return out


_CLASS = _classes()
_TABLE = bytes(_CLASS)
#: Lower-cased letters up to U+00FF.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from U+0100 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + hidden.index(b) if b in hidden else b for b in range(256)}


class WordIds:
    """ids(text) as the tokenizers library gives them without added special tokens, as unsigned 32-bit integers.

    A file that drops white space and parts words as NORMALISER and PATTERN say, such as word_bpe_49k.json, gives a word of ASCII and
    the letters of U+00C0 to U+00FF the ids of its lower-cased runs. The distinct runs of a few megabytes of text, and other
    words whole, are looked up in a memo of two generations of `most` bytes each: what is used again outlives the older one. Any
    other file has the library encode each whole text.
    """

    def __init__(self, path: str, most: int = 24 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.memo, self.older, self.size = most, {}, {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
        split, level = steps[0], steps[-1]
        self.by_word = (
            (spec["normalizer"] or {}).get("normalizers") == NORMALISER and len(steps) == 2
            and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
            and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")
            and all(t["content"].startswith("<") and not t["normalized"] and not (t["lstrip"] or t["rstrip"]) and not _SPACE.search(t["content"].encode()) for t in spec["added_tokens"])
        )

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs and other words that the memo lacks; those that are not long are remembered."""
        found, plain, rest, size = {}, [], [], 0
        for r in runs:
            got = self.older.get(r)
            if got is not None:
                found[r] = got
            elif OTHER in r.translate(_TABLE) if r.isascii() else not _LETTERS.fullmatch(r):
                rest.append(r)
            else:
                plain.append(r)
                size += len(r)
                if size > GROUP:
                    found.update(self._joined(plain))
                    plain, size = [], 0
        found.update(self._joined(plain))
        found.update(zip(rest, self._other(rest), strict=True))
        keep = found if max(map(len, runs)) <= LONG else {r: x for r, x in found.items() if len(r) <= LONG}
        self.memo.update(keep)
        self.size += sum(map(len, keep)) + sum(map(len, keep.values())) + ENTRY * len(keep)
        if self.size > self.most:
            self.older, self.memo, self.size = self.memo, {}, 0
        return found

    def _joined(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Runs encoded as one text: an id whose token ends a word ends a run."""
        if not runs:
            return {}
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(runs).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(runs):
            return dict(zip(runs, self._other(runs), strict=True))
        data = ids.tobytes()
        return {r: data[a:b] for r, (a, b) in zip(runs, pairwise([0, *(4 * cuts).tolist()]), strict=True)}

    def _other(self, words: list[bytes]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def ids(self, text: bytes) -> bytes:
        return next(self.encode(_strings([text])))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text in turn."""
        if not self.by_word:
            yield from (self._other([t.as_buffer().to_pybytes()])[0] for t in texts)
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(texts):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + STEP, side="right")))
            if ends[lo] - before > STEP:
                yield b"".join(self._batch(_strings([p]))[0].tobytes() for p in _parts(texts[lo].as_buffer().to_pybytes()))
            else:
                flat, cuts = self._batch(texts.slice(lo, hi - lo))
                yield from (flat[a:b].tobytes() for a, b in pairwise(cuts.tolist()))
            lo = hi

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where those of each begin and the last ones end."""
        runs, firsts = _cut(texts)
        coded = runs.dictionary_encode()
        keys = _bytes(coded.dictionary)
        got = list(map(self.memo.get, keys))
        if None in got:
            new = self._learn([r for r, g in zip(keys, got, strict=True) if g is None])
            got = [new[r] if g is None else g for r, g in zip(keys, got, strict=True)]
        flat = np.frombuffer(b"".join(got), "<u4")
        size = np.fromiter(map(len, got), np.int32, len(got)) >> 2
        begin = np.cumsum(size, dtype=np.int32) - size
        at = coded.indices.to_numpy()
        sizes = size[at]
        ends = np.cumsum(sizes, dtype=np.int32)
        place = np.repeat(begin[at] - (ends - sizes), sizes)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], np.r_[0, ends][firsts]


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of texts, lower-cased, with words that hold any OTHER byte whole and as they are; and the first run of each text, and their number."""
    ends = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset).astype(np.int64)
    if ends[0] == ends[-1]:
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy()
    ends -= ends[0]
    kind = _CLASS[data]
    at = np.flatnonzero(data == 0xC3)
    if len(at):
        second = data[at + 1]
        fine = (second != 0x97) & (second != 0xB7)  # the signs of multiplication and division
        at, second = at[fine], second[fine]
        kind[at] = kind[at + 1] = LETTER
    space = kind == SPACE
    fresh = np.empty(len(data), bool)  # whether a byte does not go on what the one before it began
    fresh[0] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh[ends[:-1][ends[:-1] < len(data)]] = True
    begins = fresh | (kind == DIGIT)
    begins &= ~space
    capital = (data >= 65) & (data <= 90)
    if (kind == OTHER).any():
        word = fresh.copy()
        word[1:] &= space[:-1] | space[1:]
        word[ends[:-1][ends[:-1] < len(data)]] = True
        number = np.cumsum(word)
        odd = np.zeros(int(number[-1]) + 1, bool)
        odd[number[kind == OTHER]] = True
        odd = odd[number]
        begins &= word | ~odd
        capital &= ~odd
        if len(at):
            second = np.where(odd[at], 0, second)
    data[capital] += 32
    if len(at):
        data[at[(second >= 0x80) & (second <= 0x9E)] + 1] += 32
    solid = ~space
    offsets = np.flatnonzero(begins[solid])
    n = int(np.count_nonzero(solid))
    runs = pa.Array.from_buffers(pa.binary(), len(offsets), [None, pa.py_buffer(np.r_[offsets, n].astype("<i4")), pa.py_buffer(data[solid])])
    return runs, np.searchsorted(np.flatnonzero(begins), ends)


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def _bytes(strings: pa.Array) -> list[bytes]:
    data = strings.buffers()[2]
    data = data.to_pybytes() if data else b""
    ends = np.frombuffer(strings.buffers()[1], "<i4", len(strings) + 1, 4 * strings.offset).tolist()
    return [data[a:b] for a, b in pairwise(ends)]


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + STEP)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
