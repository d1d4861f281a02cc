"""Substring dedup by level-wise doubling over word windows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .common import NO_ID, trim

SHORT, MIDDLE, WIDTH = 5, 10, 20
LEVEL5, LEVEL10, FOUND = 1, 2, 3
U64 = np.uint64
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 2**63, 256, dtype=U64) | U64(1)
_BASE = U64(0xA0761D6478BD642F | 1)
_SPACE, _NEXT = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,%d}" % (WIDTH - 1))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0..n and their inverses modulo 2^64."""
    if len(_POWERS.get("up", ())) <= n:
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for key, b in (("up", _BASE), ("down", inverse)):
            p = np.full(n + 1, b, U64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of some texts: a 64-bit hash each, and the text that each is in."""

    def __init__(self, texts: list):
        data = np.frombuffer(b" ".join(texts), np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
        self.starts, ends = edge[0::2], edge[1::2]
        up, down = _powers(max(1 << 19, len(data) + 1))
        sums = np.r_[U64(0), np.cumsum(_TABLE[data] * up[: len(data)], dtype=U64)]
        self.hash = B.mix((sums[ends] - sums[self.starts]) * down[self.starts] + (ends - self.starts).astype(U64))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.doc = np.searchsorted(begins, self.starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))  # each text's first word


def _cut(text) -> list[tuple[int, bytes]]:
    """A huge text in parts that end at white space, each with the first WIDTH - 1 words of what follows."""
    data, at, base, out = bytes(text), 0, 0, []
    while at < len(data):
        m = _SPACE.search(data, at + B.HUGE // 2)
        end = m.start() if m else len(data)
        out.append((base, data[at:end] + _NEXT.match(data, end)[0]))
        base += len(data[at:end].split())
        at = end
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= B.MIX1
        out += h[i : i + n]
        out ^= out >> U64(31)
    return B.mix(out)


class Level:
    """What a block knows at a level: its anchors, and those that survive."""

    def __init__(self, block: B.Block, n_buckets: int):
        self.block, self.n_buckets = block, n_buckets
        parts, self.pieces = [], []
        for some, bases, texts in block.pieces(_cut):
            w = Words(texts)
            g = grams(w.hash, SHORT)
            at, start, n = B.anchors(g, WIDTH - SHORT + 1, w.doc, WIDTH)
            self.pieces.append(((np.array(some), np.array(bases)), w, at, start, n, g[at] if len(at) else np.zeros(0, U64)))
            parts.append(self.pieces[-1][-1])
        self.five, self.inverse, self.count = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_inverse=True, return_counts=True)

    def short(self) -> np.ndarray:
        """For each anchor, whether its five words repeat."""
        known = (self.count > 1) | self.block.bits(LEVEL5, self.five, self.n_buckets)
        return known[self.inverse]

    def sides(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each surviving anchor, the hashes of the ten words from it on, and of the ten that end with it (0: none inside the text)."""
        right, left, lo = [], [], 0
        for _, w, at, _, _, _ in self.pieces:
            a = at[alive[lo : lo + len(at)]]
            lo += len(at)
            g = grams(w.hash, MIDDLE)
            for out, p in ((right, a), (left, a + SHORT - MIDDLE)):
                ok = (p >= 0) & (p < len(g))
                q = np.where(ok, p, 0)
                if len(g):
                    ok &= w.doc[q] == w.doc[np.minimum(q + MIDDLE - 1, len(w.doc) - 1)]
                out.append(np.where(ok, g[q], U64(0)) if len(g) else np.zeros(len(a), U64))
        z = [np.zeros(0, U64)]
        return np.concatenate(right or z), np.concatenate(left or z)

    def ten(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        right, left = self.sides(alive)
        both, inverse, count = np.unique(np.concatenate([right, left]), return_inverse=True, return_counts=True)
        return both, inverse, count

    def middle(self, alive: np.ndarray) -> np.ndarray:
        """Of the survivors at five words, those with a repeated ten-word side."""
        both, inverse, count = self.ten(alive)
        known = ((count > 1) | self.block.bits(LEVEL10, both, self.n_buckets)) & (both != 0)
        n = len(inverse) // 2
        flags = known[inverse]
        return flags[:n] | flags[n:]


def _windows(level: Level) -> list[tuple[int, int, bytes]]:
    """The twenty-word windows of the surviving anchors, packed by bucket; windows that the block itself has earlier are settled here."""
    alive = level.short()
    alive[np.flatnonzero(alive)] = level.middle(alive)
    ordinal, word, count, five, hashes, lo = [], [], [], [], [], 0
    for (some, bases), w, at, start, n, g in level.pieces:
        keep = alive[lo : lo + len(at)]
        lo += len(at)
        s, m = start[keep], n[keep]
        doc = w.doc[s]
        ordinal.append(some[doc])
        word.append(s - w.first[doc] + bases[doc])
        count.append(m)
        five.append(g[keep])
        each = np.repeat(s - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum()) if len(s) else np.zeros(0, np.int64)
        wide = grams(w.hash, WIDTH)
        hashes.append(wide[each] if len(each) else np.zeros(0, U64))
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    ordinal, word, count, five, hashes = cat(ordinal, np.int64), cat(word, np.int64), cat(count, np.int64), cat(five, U64), cat(hashes, U64)
    if not len(ordinal):
        return []
    group = np.repeat(np.arange(len(count)), count)
    place = np.repeat(word - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(group))
    again = B.later(hashes, five[group])
    known = B.runs(again, group, place, WIDTH)
    # What is left is sent: each window with its own place, in runs.
    fresh = np.flatnonzero(~again)
    cut = np.r_[0, np.flatnonzero((np.diff(fresh) != 1) | (np.diff(group[fresh]) != 0)) + 1].astype(np.int64) if len(fresh) else np.zeros(0, np.int64)
    size = np.diff(np.r_[cut, len(fresh)])
    head = fresh[cut] if len(fresh) else fresh
    key = five[group[head]]
    order = np.argsort(key, kind="stable")
    rows, settled = [], (ordinal[known[0]], known[1], known[2])
    for b, i, j in B.spans(key[order], level.n_buckets):
        sel = order[i:j]
        h = head[sel]
        pick = np.concatenate([np.arange(x, x + y) for x, y in zip(h, size[sel], strict=True)])
        o = ordinal[group[h]]
        rows.append((b, level.block.block, B.pack((key[sel] & U64(0xFFFFFFFF)).astype("<u4"), level.block.ids[o].astype("<i8"), o.astype("<i4"), place[h].astype("<i4"), size[sel].astype("<i4"), hashes[pick].astype("<u8"), *(x.astype("<i4") for x in settled))))
        settled = (np.zeros(0, np.int64),) * 3
    if len(settled[0]):
        rows.append((0, level.block.block, B.pack(*(np.zeros(0, t) for t in ("<u4", "<i8", "<i4", "<i4", "<i4", "<u8")), *(x.astype("<i4") for x in settled))))
    return rows


#: 32 bits of a run's anchor, doc_id, ordinal, first word, windows, their hashes; then what the block has settled itself.
_TYPES = ("<u4", "<i8", "<i4", "<i4", "<i4", "<u8", "<i4", "<i4", "<i4")


def _judge(rows: pa.Table) -> pa.Table:
    """A bucket: windows by (text, place), each later one of equals marked; answers as word intervals by block."""
    parts = [B.unpack(p, _TYPES) for p in rows.column("payload").to_pylist()]
    owner = rows.column("block").to_pylist()
    cat = [np.concatenate(x) for x in zip(*parts, strict=True)]
    rem, doc, ordinal, place, size, hashes = cat[:6]
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    begin = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(size) else np.zeros(0, np.int64)
    order = np.lexsort((place, ordinal, doc))
    size_o = size[order].astype(np.int64)
    group = np.repeat(np.arange(len(order)), size_o)
    within = np.arange(len(group)) - np.repeat(np.r_[0, np.cumsum(size_o)[:-1]], size_o) if len(order) else np.zeros(0, np.int64)
    flags = B.later(hashes[begin[order][group] + within], rem[order][group]) if len(order) else np.zeros(0, bool)
    seg, lo, hi = B.runs(flags, group, place[order][group] + within if len(order) else within, WIDTH)
    seg = order[seg] if len(seg) else seg
    out, bucket = [], rows.column("bucket")[0].as_py()
    for i, block in enumerate(owner):
        mine = source[seg] == i
        known = parts[i][6:]
        o, a, b = (np.concatenate([x, y]).astype("<i4") for x, y in zip(known, (ordinal[seg[mine]], lo[mine], hi[mine]), strict=True))
        if len(o):
            out.append((block, FOUND, bucket, B.pack(o, a, b)))
    trim()
    return B.message_table(out)


def _finish(docs: pa.Table, messages: pa.Table, keep_texts: bool) -> pa.Table:
    block = B.Block(docs, messages)
    found = B.intervals(block, FOUND)
    n_words, n_removed, texts, shas = [], [], [], []
    for i, t in enumerate(block.texts):
        ws = bytes(t).split()
        n, removed = len(ws), 0
        if not block.first[i] and n >= WIDTH:
            ws, removed = [], n
        elif i in found:
            mask, _ = B.merge(found[i], n)
            removed = int(mask.sum())
            ws = [w for w, gone in zip(ws, mask.tolist(), strict=True) if not gone]
        kept = b" ".join(ws)
        n_words.append(n)
        n_removed.append(removed)
        shas.append(hashlib.sha256(kept).hexdigest())
        if keep_texts:
            texts.append(kept)
    ids = pa.array(block.ids, pa.int64(), mask=block.ids == NO_ID)
    out = {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
    if keep_texts:
        out["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.table(out | {"kept_sha256": pa.array(shas, pa.string())})


def substring_dedup(docs: DataFrame, keep_texts: bool = True) -> DataFrame:
    """Remove every word that a window of 20 words covers whose words also start earlier in the corpus.

    Words are [^\\x20\\x09-\\x0D]+ of `text`, unchanged. Earlier: a smaller doc_id, or the same document and an earlier start.
    Windows are judged on the input. Level by level: anchors whose 5 words repeat are extended to 10 words on either side, those
    with a repeated side to all their windows of 20 words. Returns doc_id, n_words, n_removed, kept_text (kept words joined by
    one blank; not with keep_texts=False, which sends no text back from Python), kept_sha256, a row for each input row.

    Null text: none; fewer than 20 words: kept whole. A null doc_id counts as the smallest. Rows that share a doc_id come in the
    order of their texts. Other columns, whatever their names, are not read. Windows are compared by their place in a bucket,
    32 bits of their anchor and 64 bits of their own, over 100 bits in all.
    """
    plan = B.Plan(docs)
    n = plan.n_buckets

    def first(d: pa.Table, m: pa.Table) -> pa.Table:
        level = Level(B.Block(d, m), n)
        return B.ask(level.block.block, level.five, n)

    def second(d: pa.Table, m: pa.Table) -> pa.Table:
        level = Level(B.Block(d, m), n)
        return B.ask(level.block.block, level.ten(level.short())[0], n)

    def third(d: pa.Table, m: pa.Table) -> pa.Table:
        return B.out_table(_windows(Level(B.Block(d, m), n)))

    five = plan.reps.unionByName(B.answers(plan.visit(plan.reps, first, B.OUT), LEVEL5))
    ten = five.unionByName(B.answers(plan.visit(five, second, B.OUT), LEVEL10))
    found = plan.visit(ten, third, B.OUT).groupBy("bucket").applyInArrow(_judge, B.MESSAGE)

    def last(d: pa.Table, m: pa.Table) -> pa.Table:
        return _finish(d, m, keep_texts)

    return plan.visit(plan.reps.unionByName(found), last, RESULT if keep_texts else RESULT.replace(" kept_text string,", ""))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, keep_texts=False)
