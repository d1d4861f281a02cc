"""Suffix-array dedup: bytes that a repeated string of 100 bytes covers.

Suffixes are kept sparse. Only windows whose anchor (see blocks.py) also occurs elsewhere become suffixes. Splitters that Spark samples
range-partition them by the leading bytes of their anchors, and each partition is sorted by anchor. Equal strings have equal anchors,
so they lie side by side in one partition and none straddles a boundary. A task goes through its partition a few megabytes at a time,
what is left of the last anchor being carried into the next ones; there it sorts the suffixes by multikey quicksort, eight bytes a
key, and marks every later one of equals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import NO_ID, parts, stored

GRAM, WIDTH = 32, 100
ASKED, FOUND = 1, 2
#: Bytes of suffixes that are sorted at a time, and of the partitions in which they lie.
STEP, PART = 2 << 20, 256 << 20
U64 = np.uint64
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
_TABLE = np.random.default_rng(100).integers(1, 2**63, 256, dtype=U64) | U64(1)
#: Rows of one anchor up to which they are gone through in one task; about 40 MB.
HOT = 200_000
#: A stretch of text whose windows share an anchor; without anchor the intervals that a block has settled itself.
STRETCH = "anchor binary, block int, doc_id long, ordinal int, place int, stretch binary"


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM consecutive bytes, by doubling."""
    h, k = _TABLE[data], 1
    while k < GRAM:
        h = h[:-k] * (B.MIX1 ^ U64(k)) + h[k:] if len(h) > k else h[:0]
        h ^= h >> U64(32)
        k *= 2
    return B.mix(h)


def _cut(text) -> list[tuple[int, bytes]]:
    step = B.HUGE // 2
    return [(i, text[i : i + step + WIDTH - 1]) for i in range(0, max(1, len(text) - WIDTH + 1), step)]


class Anchors:
    def __init__(self, block: B.Block):
        self.block, self.pieces = block, []
        for some, bases, texts in block.pieces(_cut):
            data = np.frombuffer(b"".join(texts), np.uint8)
            sizes = [len(t) for t in texts]
            doc = np.repeat(np.arange(len(texts)), sizes)
            g = _grams(data)
            at, start, n = B.anchors(g, WIDTH - GRAM + 1, doc, WIDTH)
            begin = np.cumsum([0, *sizes])[:-1]
            own = doc[start] if len(start) else start
            self.pieces.append((np.array(some)[own], np.array(bases)[own] - begin[own], data, at, start, n, g[at] if len(at) else np.zeros(0, U64)))
        keys = [p[-1] for p in self.pieces] or [np.zeros(0, U64)]
        self.keys, self.inverse, self.count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)


def _stretches(a: Anchors, n_buckets: int) -> pa.Table:
    """STRETCH: where anchors are repeated; those that the block itself has earlier are settled here."""
    alive = ((a.count > 1) | a.block.bits(ASKED, a.keys, n_buckets))[a.inverse]
    seen, settled, lo = set(), [], 0
    cols: tuple[list, ...] = ([], [], [], [], [])
    for ordinal, shift, data, at, start, n, _ in a.pieces:
        keep = np.flatnonzero(alive[lo : lo + len(at)])
        lo += len(at)
        raw = data.tobytes()
        for o, x, g, s, m in zip(ordinal[keep].tolist(), shift[keep].tolist(), at[keep].tolist(), start[keep].tolist(), n[keep].tolist(), strict=True):
            stretch = raw[s : s + m + WIDTH - 1]
            if stretch in seen:
                settled.append((o, s + x, s + x + m + WIDTH - 1))
            else:
                seen.add(stretch)
                for c, v in zip(cols, (raw[g : g + GRAM], int(a.block.ids[o]), o, s + x, stretch), strict=True):
                    c.append(v)
    if settled:
        for c, v in zip(cols, (None, 0, 0, 0, B.pack(*np.array(settled, "<i4").T)), strict=True):
            c.append(v)
    anchor, doc, o, place, stretch = cols
    return pa.table({"anchor": pa.array(anchor, pa.binary()), "block": pa.array([a.block.block] * len(anchor), pa.int32()), "doc_id": pa.array(doc, pa.int64()), "ordinal": pa.array(o, pa.int32()), "place": pa.array(place, pa.int32()), "stretch": pa.array(stretch, pa.binary())})


def multikey(data: np.ndarray, starts: np.ndarray, width: int = WIDTH, group: np.ndarray | None = None) -> np.ndarray:
    """For each string of `width` bytes at starts, in order, whether an equal one of its group comes before.

    Multikey quicksort, eight bytes a key: strings that are alone at a depth drop out, those that tie go on to the next.
    """
    key = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,)) if len(data) >= 8 else np.zeros(0, ">u8")
    mine, group = np.arange(len(starts)), np.zeros(len(starts), np.int64) if group is None else group
    for depth in [*range(0, width - 8, 8), width - 8]:
        k = key[starts[mine] + depth].astype(U64)
        order = np.lexsort((k, group))
        mine, group, k = mine[order], group[order], k[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (group[1:] != group[:-1])] if len(k) else np.zeros(0, bool)
        group = np.cumsum(new)
        tied = ~(new & np.r_[new[1:], True]) if len(k) else new
        mine, group = mine[tied], group[tied]
        if not len(mine):
            break
    out = np.zeros(len(starts), bool)
    out[mine[1:][group[1:] == group[:-1]]] = True
    return out


def _judged(anchor: np.ndarray, block: np.ndarray, doc: np.ndarray, ordinal: np.ndarray, place: np.ndarray, texts: pa.Array) -> list[tuple[int, int, int, bytes]]:
    """Windows of stretches by anchor (a number for each), text and place; each later one of equals is marked. Answers as byte intervals by block."""
    ends = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    begin, length = ends[:-1], np.diff(ends)
    raw = texts.to_pylist()
    seen, whole = set(), np.zeros(len(doc), bool)
    order = np.lexsort((place, ordinal, doc, anchor))
    for i in order.tolist():  # equal stretches have equal anchors
        whole[i] = raw[i] in seen
        seen.add(raw[i])
    del seen, raw
    seg = order[~whole[order]]
    n = length[seg] - WIDTH + 1
    group = np.repeat(np.arange(len(seg)), n)
    within = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    flags = multikey(data, begin[seg][group] + within, group=anchor[seg][group])
    at, lo, hi = B.runs(flags, group, place[seg][group] + within, WIDTH)
    copies = np.flatnonzero(whole)
    who = np.r_[seg[at] if len(at) else at, copies].astype(np.int64)
    lo, hi = np.r_[lo, place[copies]], np.r_[hi, place[copies] + length[copies]]
    out, by = [], np.argsort(block[who], kind="stable")
    cuts = np.flatnonzero(np.diff(block[who][by])) + 1
    for x in np.split(by, cuts) if len(by) else ():
        out.append((int(block[who[x[0]]]), FOUND, 0, B.pack(ordinal[who[x]].astype("<i4"), lo[x].astype("<i4"), hi[x].astype("<i4"))))
    return out


def _judge(step: int):
    """Goes through a partition in the order of anchors. What the last anchor of a batch has is carried into the next, for more of it may follow."""

    def run(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.combine_chunks()
        codes = t.column("anchor").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cols = [t.column(c).to_numpy() for c in ("block", "doc_id", "ordinal", "place")]
        return B.message_table(_judged(codes, *cols, t.column("stretch").combine_chunks())).combine_chunks().to_batches()

    def judge(batches):
        left, size, least = [], 0, step
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                left.append(part)
                size += part.nbytes
                if size >= least:
                    t = pa.Table.from_batches(left)
                    n = pc.sum(pc.equal(t.column("anchor"), t.column("anchor")[-1])).as_py()
                    if n < t.num_rows:
                        yield from run(t.slice(0, t.num_rows - n))
                        t = t.slice(t.num_rows - n)
                    left = t.combine_chunks().to_batches()
                    size = sum(x.nbytes for x in left)
                    least = max(step, 2 * size)  # what one anchor has is copied no more than twice over
        if left:
            yield from run(pa.Table.from_batches(left))

    return judge


def _by_windows(rows: DataFrame) -> DataFrame:
    """The answers for anchors that have more rows than a task should hold: every window is a row, met by its bytes, so no anchor is in one place."""

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500).to_pydict()
                n = [len(x) - WIDTH + 1 for x in part["stretch"]]
                windows = [x[i : i + WIDTH] for x in part["stretch"] for i in range(len(x) - WIDTH + 1)]
                spread = lambda c, t, n=n, part=part: pa.array(np.repeat(np.array(part[c], t), n))
                place = np.repeat(np.array(part["place"], np.int32), n) + np.concatenate([np.arange(x, dtype=np.int32) for x in n])
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), spread("block", np.int32), spread("doc_id", np.int64), spread("ordinal", np.int32), pa.array(place.astype(np.int32))], ["w", "block", "doc_id", "ordinal", "place"])

    windows = rows.mapInArrow(cut, "w binary, block int, doc_id long, ordinal int, place int")
    at = F.struct("doc_id", "block", "ordinal", "place")
    firsts = windows.groupBy("w").agg(F.min(at).alias("first"))
    later = windows.join(firsts, "w").where(at > F.col("first")).select("block", "ordinal", "place")

    def told(batches):
        for b in batches:
            block, o, p = (b.column(c).to_numpy() for c in ("block", "ordinal", "place"))
            out = [(int(k), FOUND, 0, B.pack(o[block == k].astype("<i4"), p[block == k].astype("<i4"), (p[block == k] + WIDTH).astype("<i4"))) for k in np.unique(block)]
            yield from B.message_table(out).combine_chunks().to_batches()

    return later.mapInArrow(told, B.MESSAGE)


def _finish(docs: pa.Table, messages: pa.Table) -> pa.Table:
    block = B.Block(docs, messages)
    found = B.intervals(block, FOUND)
    n_bytes, n_removed, n_spans, kept, shas = [], [], [], [], []
    for i, t in enumerate(block.texts):
        n, removed, spans, left = len(t), 0, 0, bytes(t)
        if not block.first[i] and n >= WIDTH:
            removed, spans, left = n, 1, b""
        elif i in found:
            mask, spans = B.merge(found[i], n)
            removed = int(mask.sum())
            left = np.frombuffer(t, np.uint8)[~mask].tobytes()
        for out, x in zip((n_bytes, n_removed, n_spans, kept, shas), (n, removed, spans, left, hashlib.sha256(left).hexdigest()), strict=True):
            out.append(x)
    long = pa.int64()
    return pa.table({"doc_id": pa.array(block.ids, long, mask=block.ids == NO_ID), "n_bytes": pa.array(n_bytes, long), "n_removed": pa.array(n_removed, long), "n_spans": pa.array(n_spans, long), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array(shas, pa.string())})


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Remove every byte that a 100-byte string covers which also starts earlier in the corpus.

    Each `text` is its UTF-8 bytes; matches never cross documents. Earlier: a smaller doc_id, or the same document and an earlier
    start. Strings are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes
    left, which may cut a character), kept_sha256, a row for each input row. Comparison is exact, byte by byte.

    Null text: empty; under 100 bytes: kept whole. A null doc_id counts as the smallest. Rows that share a doc_id come in the
    order of their texts. Other columns, whatever their names, are not read.
    """
    plan = B.Plan(docs)
    n = plan.n_buckets

    def first(d: pa.Table, m: pa.Table) -> pa.Table:
        a = Anchors(B.Block(d, m))
        return B.ask(a.block.block, a.keys, n)

    def second(d: pa.Table, m: pa.Table) -> pa.Table:
        return _stretches(Anchors(B.Block(d, m)), n)

    asked = plan.reps.unionByName(B.answers(plan.visit(plan.reps, first, B.OUT), ASKED))
    made = stored(plan.visit(asked, second, STRETCH), "stretches")
    # What blocks have settled goes back to them as it is.
    settled = made.where("anchor is null").select("block", F.lit(FOUND).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("long").alias("doc_id"), F.col("stretch").alias("payload"))
    open_ = made.where("anchor is not null")
    n_bytes = open_.agg(F.sum(F.octet_length("stretch"))).first()[0] or 0
    parts_ = max(parts(docs.sparkSession), -(-n_bytes // PART))
    hot = open_.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor")
    found = settled
    if not hot.isEmpty():
        found = found.unionByName(_by_windows(open_.join(hot, "anchor", "left_semi")))
        open_ = open_.join(hot, "anchor", "left_anti")
    dealt = open_.repartitionByRange(parts_, "anchor").sortWithinPartitions("anchor")
    found = found.unionByName(dealt.mapInArrow(_judge(STEP), B.MESSAGE))
    return plan.visit(plan.reps.unionByName(found), _finish, RESULT)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
