"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is normaliser o pieces o byte fallback, composed with one input at a time; its states are (place in the input, last
piece) and its arcs are pieces (by a trie) or, for a character that no piece is, its bytes. For unigram models an arc weighs the
piece's negated score and the tropical shortest path is the encoding. For BPE models scores are merge ranks, so a path's sum means
nothing; there an arc is allowed only if the pieces before and after it are what BPE itself makes of the two alone. A sequence
of pieces is the BPE encoding of its text exactly if that holds for each adjacent pair, so one path is left and it is the shortest.
"""

from __future__ import annotations

import array
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, remember

NORMAL, USER, BYTE = 1, 4, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
_RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Bytes that an entry of the memo takes beside its text and ids; longer texts are encoded each time. Pairs of pieces that are remembered.
ENTRY, LONG, PAIRS = 140, 64, 1 << 20
_NOTHING = [(0.0, "", "")]
RESULT = "doc_id long, n_tokens long, ids binary, decoded string"


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: bytes, integers, or floats as their four bytes."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, prefix, squeeze, charsmap, fallback = UNIGRAM, 1, 1, b"", 0
        for n, v in _fields(data):
            if n == 1:
                p = dict(_fields(v))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
            elif n == 2:
                t = dict(_fields(v))
                self.kind, fallback = t.get(3, UNIGRAM), t.get(35, 0)
            elif n == 3:
                t = dict(_fields(v))
                charsmap, prefix, squeeze = t.get(2, b""), t.get(3, 1), t.get(4, 1)
        if charsmap or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without a character map are supported")
        if any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("models with user-defined pieces are not supported: the library cuts texts at them before it encodes")
        self.prefix, self.squeeze = bool(prefix), bool(squeeze)
        self.text = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE} if fallback else {}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == 2), 0)


START, WORD, GAP = range(3)
_SYMBOL = re.compile(" +|[^ ]+")


class Normaliser:
    """The model's normaliser as a finite-state transducer. Its symbols are runs: of blanks, or of anything else.

    arcs: (state, whether the run is of blanks) to (next state, marks for each blank of the run, marks in front of what is copied). WORD and
    GAP accept; a gap at the end writes nothing where gaps are squeezed, since there a gap's mark is written with the word behind it.
    """

    def __init__(self, model: Model):
        first = int(model.prefix)
        if model.squeeze:
            self.arcs = {(START, True): (START, 0, 0), (START, False): (WORD, 0, first), (WORD, True): (GAP, 0, 0), (GAP, False): (WORD, 0, 1)}
        else:
            self.arcs = {(START, True): (GAP, 1, first), (START, False): (WORD, 0, first), (WORD, True): (GAP, 1, 0), (GAP, False): (WORD, 0, 0)}
        # Where each blank is a mark in every state but the first, the composition with a text needs no walk.
        self.plain = not model.squeeze

    def compose(self, text: str) -> str:
        if self.plain:
            return MARK * self.arcs[START, False][2] + text.replace(" ", MARK) if text else ""
        state, out = START, []
        for m in _SYMBOL.finditer(text):
            run = m[0]
            state, each, front = self.arcs[state, run[0] == " "]
            out.append(MARK * (front + each * len(run)) + ("" if run[0] == " " else run))
        return "".join(out)


class Transducer:
    """Encodes units of normalised text; between units no piece can lie, so each is composed alone and remembered.

    The memo has two generations of `most` bytes each: what is used again outlives the older one.
    """

    def __init__(self, model: Model, most: int = 40 << 20):
        self.model, self.most, self.size, self.older = model, most, 0, {}
        self.normaliser = Normaliser(model)
        self.trie: dict = {}
        self.longest = max(map(len, model.text), default=0)
        # What a character weighs that no piece is: ten more than the heaviest piece.
        self.strange = float(np.float32(-min((w for _, w, k in model.pieces if k == NORMAL), default=0.0)) + np.float32(10))
        self.joined: set[str] = set()  # pairs of characters side by side in some piece
        for p, i in model.text.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (i, (i,), -model.pieces[i][1])
            self.joined.update(map("".join, zip(p, p[1:], strict=False)))
        self.inner = any(MARK in p.lstrip(MARK) for p in model.text)
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, list | None] = {}
        self.out = [(p.replace(MARK, " ").encode() if k in (NORMAL, USER) else bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == 3 else b" \xe2\x81\x87 ") for p, _, k in model.pieces]

    def _history(self, piece: int) -> list[tuple[float, str, str]] | None:
        """BPE of a piece's own text: after each merge its score, the first part and the last part; None if another result is left.

        The best-scored neighbours merge first, the leftmost of equals.
        """
        if piece not in self.histories:
            text, pieces = self.model.text, self.model.pieces
            parts = list(pieces[piece][0])
            steps = [(0.0, parts[0], parts[-1])]
            while len(parts) > 1:
                found = [(-pieces[p][1], i) for i in range(len(parts) - 1) if (p := text.get(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                cost, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                steps.append((-cost, parts[0], parts[-1]))
            self.histories[piece] = steps if len(parts) == 1 else None
        return self.histories[piece]

    def _allowed(self, last: int, piece: int) -> bool:
        """Whether BPE leaves `last` and `piece` apart: replays the merges of both in order until one across would come first."""
        key = (last + 1) * len(self.model.pieces) + piece
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._apart(self._history(last) if last >= 0 else _NOTHING, self._history(piece))
        return got

    def _apart(self, left, right) -> bool:
        if left is None or right is None:
            return False
        text, pieces, i, j = self.model.text, self.model.pieces, 0, 0
        while True:
            across = text.get(left[i][2] + right[j][1]) if left is not _NOTHING else None
            a = left[i + 1][0] if i + 1 < len(left) else None
            b = right[j + 1][0] if j + 1 < len(right) else None
            if across is not None:
                score = pieces[across][1]
                if (a is None or score > a) and (b is None or score >= b):
                    return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1

    def _arcs(self, unit: str, at: int) -> list[tuple[int, tuple[int, tuple[int, ...], float]]]:
        """Arcs that leave a place: next place, and piece (-1 for bytes), ids and weight; short ones first."""
        node, end, arcs = self.trie, at, []
        for c in unit[at : at + self.longest]:
            node = node.get(c)
            if node is None:
                break
            end += 1
            arc = node.get("")
            if arc is not None:
                arcs.append((end, arc))
        if not arcs or arcs[0][0] != at + 1:
            ids = tuple(self.model.bytes[b] for b in unit[at].encode()) if self.model.bytes else (self.model.unknown,)
            arcs.insert(0, (at + 1, (-1, ids, self.strange)))
        return arcs

    def shortest(self, unit: str) -> list[int]:
        """The ids on the tropical shortest path through the composition with `unit`."""
        return self._only(unit) if self.model.kind == BPE else self._relaxed(unit)

    def _relaxed(self, unit: str) -> list[int]:
        """Relaxation in the order of places; pieces do not constrain each other, so a place is a state. Sums are 32-bit floats, as the library's."""
        best: list = [(np.float32(0), 0, ())] + [None] * len(unit)
        for at in range(len(unit)):
            if best[at] is not None:
                for end, (_, ids, weight) in self._arcs(unit, at):
                    cost = best[at][0] + np.float32(weight)
                    if best[end] is None or cost < best[end][0]:
                        best[end] = (cost, at, ids)
        at, path = len(unit), []
        while at:
            _, at, ids = best[at]
            path.append(ids)
        return [i for ids in reversed(path) for i in ids]

    def _only(self, unit: str) -> list[int]:
        """BPE: one path is left, so it is searched depth first, long arcs first, states that fail being remembered."""
        n, arcs, failed, allowed = len(unit), {0: self._arcs(unit, 0)}, set(), self._allowed
        stack, path = [(0, -1, len(arcs[0]))], []
        while True:
            at, last, k = stack.pop()
            if at == n:
                return [i for ids in path for i in ids]
            out = arcs[at]
            while k:
                k -= 1
                end, (piece, ids, _) = out[k]
                if (not failed or (end, piece) not in failed) and (piece < 0 or allowed(last, piece)):
                    stack.append((at, last, k))
                    if end == n:
                        stack.append((n, piece, 0))
                    else:
                        further = arcs.get(end)
                        if further is None:
                            further = arcs[end] = self._arcs(unit, end)
                        stack.append((end, piece, len(further)))
                    path.append(ids)
                    break
            else:
                failed.add((at, last))
                path.pop()

    def encode(self, text: str) -> bytes:
        if self.model.kind == UNIGRAM:
            # The library adds weights up over the whole text, as 32-bit floats: what ties in one place may not in another, so units are not parted.
            whole = self.normaliser.compose(text)
            ids = array.array("I", self._relaxed(whole)).tobytes() if whole else b""
            return ids if self.model.bytes else self._merged(ids)
        memo, out = self.memo, []
        for run in self._runs(self.normaliser.compose(text)):
            got = memo.get(run)
            if got is None:
                got = self._unit(run, self._encoded)
                memo = self.memo  # a full one has been set aside
            out.append(got)
        ids = b"".join(out)
        return ids if self.model.bytes else self._merged(ids)

    def _merged(self, ids: bytes) -> bytes:
        """Neighbouring characters that no piece is are one unknown piece."""
        own = np.frombuffer(ids, np.uint32)
        strange = own == self.model.unknown
        return own[~(strange & np.r_[False, strange[:-1]])].tobytes() if len(own) else ids

    def _encoded(self, run: str) -> bytes:
        units = self._split(run)
        return self._shortest(run) if len(units) == 1 else b"".join(self._unit(u, self._shortest) for u in units)

    def _shortest(self, unit: str) -> bytes:
        return array.array("I", self.shortest(unit)).tobytes()

    def _unit(self, key: str, make) -> bytes:
        got = self.memo.get(key)
        if got is None:
            got = self.older.get(key)
            if got is None:
                got = make(key)
            if len(key) <= LONG:
                self.memo[key] = got
                self.size += len(got) + len(key) + ENTRY
                if self.size > self.most:
                    self.older, self.memo, self.size = self.memo, {}, 0
        return got

    def _runs(self, text: str) -> list[str]:
        """Cut before each mark that follows another character, where no piece has one there."""
        if self.inner:
            return [text] if text else []
        return _RUN.findall(text)

    def _split(self, run: str) -> list[str]:
        cuts = [0, *(i for i in range(1, len(run)) if run[i - 1 : i + 1] not in self.joined), len(run)]
        return [run[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.out.__getitem__, memoryview(ids).cast("I")))
        if self.model.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode(errors="replace")


_LOADED: dict[str, Transducer] = {}


def _loaded(path: str) -> Transducer:
    """One transducer for all tasks of a Python worker."""
    alone("sentencepieces")
    if path not in _LOADED:
        _LOADED[path] = Transducer(Model(path))
        remember("sentencepieces", _LOADED.clear)
    return _LOADED[path]


def _coded(path: str):
    def run(batches):
        t = _loaded(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [t.encode(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([t.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (the text that the ids stand for) for each row of docs.

    model: a SentencePiece model file, unigram or BPE, without a character map. Null text: empty, no ids. A null doc_id stays null;
    repeated rows are encoded each; an empty table gives none. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInArrow(_coded(model), RESULT)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and whether decoding gives the text back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def digests(batches):
        t = _loaded(path)
        for b in batches:
            n, crc, same = [], [], []
            for text in b.column("text").to_pylist():
                ids = t.encode(text)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(t.decode(ids) == text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return own.mapInArrow(digests, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
