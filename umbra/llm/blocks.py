"""Blocks of documents that exchange compact messages with hash or range buckets.

Both exact repeat removers need to know which pieces of text occur elsewhere. One shuffled row per position of the corpus would
be many times the corpus, so three things keep the traffic small:

* Exact copies of a whole text are set aside first, by a digest per row and a partly aggregated group by.
* Windows are represented by their *anchor*: the k-gram with the least hash in the window (the leftmost of equals). Which
  k-gram that is depends on the window's content only, so equal windows have equal anchors at equal offsets, and about
  2 / (windows per anchor) of all positions are anchors. A window can only repeat if its anchor does.
* A block tells a bucket the sorted distinct hashes of its anchors, 32 bits each; the bucket answers with one bit each, in the
  same order. So nothing has to be joined row by row, and a hot anchor costs one entry per block.

Blocks are a function of doc_id, sorted by doc_id inside, so any lost task gives the same messages when it runs again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, alone, trim

MESSAGE = "block int, kind int, bucket int, doc_id long, payload binary"
OUT = "bucket int, block int, payload binary"
REP = 0
U64 = np.uint64
MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
POS_BITS = 24
#: Texts of more bytes are handled in parts; positions in a part fit POS_BITS.
HUGE = 4 << 20


class Plan:
    """Documents by block, and how many blocks and buckets suit their size.

    Both grow with the square root of the corpus, so that a block has about eight anchors for each bucket it writes to at any size: at 100 TB
    both hold 160 MB of text, and the messages of a pass stay under the text itself.
    """

    def __init__(self, docs: DataFrame, small: int = 2 << 20, large: int = 256 << 20):
        own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        self.n_docs, n_bytes = own.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        n_bytes = n_bytes or 0
        side = min(large, math.isqrt(256 * n_bytes))
        self.n_blocks = max(1, -(-n_bytes // max(small, side)))
        self.n_buckets = max(1, -(-n_bytes // max(4 * small, side)))
        self.docs = own.select(self._block(F.col("doc_id")).alias("block"), "doc_id", "text")
        # One row per distinct text: the smallest doc_id that has it.
        by_text = own.groupBy(F.unhex(F.md5("text")).alias("digest")).agg(F.min("doc_id").alias("doc_id"))
        self.reps = by_text.select(self._block(F.col("doc_id")).alias("block"), F.lit(REP).alias("kind"), F.lit(-1).alias("bucket"), "doc_id", F.col("digest").alias("payload"))

    def _block(self, doc_id):
        return F.pmod(F.xxhash64(doc_id), F.lit(self.n_blocks)).cast("int")

    def visit(self, messages: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f(documents of a block, its messages) for each block."""

        def one(docs: pa.Table, messages: pa.Table) -> pa.Table:
            out = f(docs, messages)
            alone()
            return out

        return self.docs.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(one, schema)


class Block:
    """The documents of a block in order, as bytes, and which of them are the first with their text."""

    def __init__(self, docs: pa.Table, messages: pa.Table):
        import pyarrow.compute as pc

        ids = docs.column("doc_id").to_numpy()
        unique = len(np.unique(ids)) == len(ids)
        order = np.argsort(ids, kind="stable") if unique else pc.sort_indices(docs, [("doc_id", "ascending"), ("text", "ascending")]).to_numpy()
        self.ids = ids[order]
        self.block = int(docs.column("block")[0].as_py()) if len(ids) else -1
        self.texts = [x.as_buffer() for x in docs.column("text").take(pa.array(order))]
        kinds = messages.column("kind").to_numpy()
        rep = messages.filter(pa.array(kinds == REP))
        self.messages = messages.filter(pa.array(kinds != REP))
        if unique:
            self.first = np.isin(self.ids, rep.column("doc_id").to_numpy())
        else:
            import hashlib

            left = set(zip(rep.column("doc_id").to_pylist(), rep.column("payload").to_pylist(), strict=True))
            self.first = np.zeros(len(ids), bool)
            for i, t in enumerate(self.texts):
                key = (int(self.ids[i]), hashlib.md5(t).digest())
                if key in left:
                    left.discard(key)
                    self.first[i] = True

    def pieces(self, cut: Callable[[bytes], list[tuple[int, bytes]]], most: int = 1 << 18):
        """Runs of first documents of about `most` bytes in all: (their ordinals, the units before each, their texts).

        cut(text) gives a text of more than HUGE bytes in parts that overlap by a window less one unit: (units before it, part).
        """
        some, size = [], 0
        for i in np.flatnonzero(self.first):
            t = self.texts[i]
            for base, part in cut(t) if len(t) > HUGE else [(0, t)]:
                if some and size + len(part) > most:
                    yield tuple(zip(*some, strict=True))
                    some, size = [], 0
                some.append((int(i), base, part))
                size += len(part)
        if some:
            yield tuple(zip(*some, strict=True))

    def bits(self, kind: int, hashes: np.ndarray, n_buckets: int) -> np.ndarray:
        """For each of the sorted distinct hashes that were asked about as `kind`, whether another block has it."""
        mine = self.messages.filter(pa.array(self.messages.column("kind").to_numpy() == kind))
        got = dict(zip(mine.column("bucket").to_pylist(), mine.column("payload").to_pylist(), strict=True))
        out = np.zeros(len(hashes), bool)
        for b, lo, hi in spans(hashes, n_buckets):
            out[lo:hi] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=hi - lo).astype(bool)
        return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= MIX2
    h ^= h >> U64(29)
    h *= MIX1
    h ^= h >> U64(32)
    return h


def spans(hashes: np.ndarray, n_buckets: int):
    """(bucket, from, to) over sorted hashes."""
    if len(hashes):
        bucket = ((hashes >> U64(32)) * U64(n_buckets)) >> U64(32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        yield from zip(bucket[np.r_[0, cuts]].astype(int).tolist(), np.r_[0, cuts].tolist(), np.r_[cuts, len(hashes)].tolist(), strict=True)


def ask(block: int, hashes: np.ndarray, n_buckets: int) -> pa.Table:
    rows = [(b, block, (hashes[lo:hi] & U64(0xFFFFFFFF)).astype("<u4").tobytes()) for b, lo, hi in spans(hashes, n_buckets)]
    return out_table(rows)


def out_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "block": pa.array(k, pa.int32()), "payload": pa.array(p, pa.binary())})


def message_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    k, kind, b, p = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(k, pa.int32()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(b, pa.int32()), "doc_id": pa.nulls(len(k), pa.int64()), "payload": pa.array(p, pa.binary())})


def answers(asked: DataFrame, kind: int) -> DataFrame:
    """The buckets' side of ask(): a bit for each hash that two or more blocks have."""

    def answer(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, "<u4") for p in rows.column("payload").to_pylist()]
        _, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        flags = n[at] > 1
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        bucket = rows.column("bucket")[0].as_py()
        trim()
        return message_table([(k, kind, bucket, np.packbits(x).tobytes()) for k, x in zip(rows.column("block").to_pylist(), np.split(flags, cuts), strict=True)])

    return asked.groupBy("bucket").applyInArrow(answer, MESSAGE)


def least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    p = 1
    while 2 * p <= w:
        values = np.minimum(values[:-p], values[p:])
        p *= 2
    return values if p == w else np.minimum(values[: len(values) - (w - p)], values[w - p :])


def anchors(grams: np.ndarray, w: int, doc_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of `width` units, inside one document each, that share their anchor: (anchor, first window, windows).

    grams[i]: the hash of the k-gram at i; w = width - k + 1 of them lie in a window. doc_of: the document of each unit.
    """
    none = np.zeros(0, np.int64)
    if len(grams) < w:
        return none, none, none
    keyed = (grams >> U64(POS_BITS) << U64(POS_BITS)) | np.arange(len(grams), dtype=U64)
    at = (least(keyed, w) & U64((1 << POS_BITS) - 1)).astype(np.int64)
    start = np.flatnonzero(doc_of[: len(at)] == doc_of[width - 1 : width - 1 + len(at)])
    if not len(start):
        return none, none, none
    at = at[start]
    cut = np.flatnonzero(np.diff(at)) + 1
    lo, hi = np.r_[0, cut], np.r_[cut, len(at)]
    return at[lo], start[lo], hi - lo


def merge(intervals: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """A mask over n units of those that an interval [from, to) covers, and the number of maximal covered runs."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, intervals[:, 0], 1)
    np.add.at(edge, intervals[:, 1], -1)
    mask = np.cumsum(edge[:n]) > 0
    return mask, int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (n > 0 and mask[0]))


def runs(flags: np.ndarray, group: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged windows of segments as (segment, from, to). group: each window's segment; first: each window's place in its text."""
    at = np.flatnonzero(flags)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(group[at]) != 0)) + 1
    lo, hi = at[np.r_[0, cut]], at[np.r_[cut, len(at)] - 1]
    return group[lo], first[lo], first[hi] + width


def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each (a, b), in order, whether an equal one comes before."""
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    out = np.zeros(len(a), bool)
    out[order[1:][same]] = True
    return out


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)])


def unpack(data: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(types)), 8 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def intervals(block: Block, kind: int) -> dict[int, np.ndarray]:
    """The messages of `kind` as [from, to) intervals by ordinal."""
    found = [unpack(p, ("<i4",) * 3) for p, k in zip(block.messages.column("payload").to_pylist(), block.messages.column("kind").to_pylist(), strict=True) if k == kind]
    if not found:
        return {}
    o, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(o, kind="stable")
    cut = np.flatnonzero(np.diff(o[order])) + 1
    return {int(o[i[0]]): np.stack([a[i], b[i]], 1) for i in np.split(order, cut)}
