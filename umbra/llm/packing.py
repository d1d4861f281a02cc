"""Mixture-controlled packing of token ids into sequences of 2048.

Deficit round-robin in closed form. Each source is a queue of tokens, served in quanta of QUANTUM. Queue s of share W_s is owed
its k-th quantum at the virtual time (2k + 1) / 2W_s, so at any time its deficit (owed less served) stays under a quantum, and
a window gets each source's share of tokens to within a quantum, the rest being carried into the next window. Because the order
of quanta is a formula of the totals, a task can place its own tokens without seeing any other task's, and deficits carry across
partitions as they do across windows.

The formula asks each queue for each quantum. For many sources the quanta are instead sorted by their due times, range by range, and
their places are the sums of the sizes before them. There a source is owed a quantum when its share of
virtual time has come to the tokens before it and a part of its own, the source's phase between 0 and 1: deficits stay under a
quantum, and sources of a quantum or less are spread over the stream.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordids
from .common import NO_ID, parts, stored, trim

WINDOW, QUANTUM, END = 2048, 128, 1
#: Sources up to which places come from the formula. Those of more are sorted.
QUEUES = 256
#: Rows up to which the table of offsets, of under 100 bytes a row, is broadcast.
SMALL = 50_000
BLOCK = "block long, source string, n long, doc_ids binary, lengths binary, ids binary"
RESULT = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenise(path: str, most: int = 4 << 20):
    def run(batches):
        from pyspark import TaskContext

        memo = wordids.shared(path)
        block, size, found = TaskContext.get().partitionId() << 32, 0, {}
        end = np.array([END], "<u4").tobytes()

        def flush():
            rows = [(block, s, sum(map(len, t)) // 4, np.array(d, "<i8").tobytes(), (np.array([len(x) for x in t], "<i8") // 4).tobytes(), b"".join(t)) for s, (d, t) in sorted(found.items())]
            cols = zip(*rows, strict=True)
            types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for b in batches:
            texts = b.column("text")
            for d, s, n, ids in zip(b.column("doc_id").to_pylist(), b.column("source").to_pylist(), pc.binary_length(texts).to_pylist(), memo.encode(texts), strict=True):
                ds, ts = found.setdefault(s, ([], []))
                ds.append(d)
                ts.append(ids + end)
                size += n
                if size >= most:
                    yield flush()
                    block, size = block + 1, 0
                    found.clear()
                    trim()
        if found:
            yield flush()

    return run


class Order:
    """Where the quanta of all queues lie in the one stream that the windows cut.

    shares: what each queue is to have of every window, in any unit; by default its own tokens. A queue that has run out leaves its
    share to the others, in proportion to theirs.
    """

    def __init__(self, tokens: list[int], quantum: int = QUANTUM, shares: list[float] | None = None):
        self.tokens, self.quantum = np.array(tokens, np.int64), quantum
        self.quanta = -(-self.tokens // quantum)
        self.shares = self.quanta.tolist() if shares is None else [max(1, round(x / max(shares) * (1 << 30))) for x in shares]
        self.total = int(self.tokens.sum())
        self.full = self.total // WINDOW * WINDOW
        # The end is cut into powers of two, so nothing is padded.
        sizes = [1 << i for i in range(WINDOW.bit_length() - 2, -1, -1) if (self.total - self.full) >> i & 1]
        self.tail = self.full + np.cumsum([0, *sizes])

    def start(self, s: int, first: int, n: int) -> np.ndarray:
        """The places of the first tokens of n quanta of queue s from the first-th on.

        A queue t of share q has as many quanta due before the k-th of s as there are j with (2j + 1) / 2q before (2k + 1) / 2p, p being the
        share of s. The whole part for the first quantum is taken in unbounded integers, so what is left fits 64 bits at any size.
        """
        more, p = np.arange(n, dtype=np.int64), self.shares[s]
        at = (first + more) * self.quantum
        for t, (have, q) in enumerate(zip(self.tokens.tolist(), self.shares, strict=True)):
            if t != s and have:
                whole, rest = divmod((2 * first + 1) * q - (t > s), p)  # equal times: the lower queue goes first
                up, left = divmod(2 * q, p)
                before = (min(whole, 1 << 60) + up * more + (rest + left * more) // p + 1) // 2
                at = at + np.minimum(np.minimum(before, self.quanta[t]) * self.quantum, have)
        return at

    def sequence(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.tail, place, side="right") - 1
        late = place >= self.full
        return np.where(late, self.full // WINDOW + i, place // WINDOW), np.where(late, place - self.tail[np.maximum(i, 0)], place % WINDOW)

    def cuts(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places strictly inside [at, at + size) where a new sequence begins."""
        first = (at // WINDOW + 1) * WINDOW
        steps = np.arange(max(1, self.quantum // WINDOW + 1)) * WINDOW
        inside = (first[:, None] + steps).ravel()
        ends = np.repeat(at + size, len(steps))
        owner = np.repeat(np.arange(len(at)), len(steps))
        good = (inside < ends) & (inside <= self.full)
        rows, places = [owner[good]], [inside[good]]
        for b in self.tail[:-1].tolist():
            hit = np.flatnonzero((at < b) & (b < at + size))
            rows.append(hit)
            places.append(np.full(len(hit), b))
        return np.concatenate(rows), np.concatenate(places)


def _place(order: Order):
    def run(batches):
        for b in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            for row in b.to_pylist():
                s, before, n = row["queue"], row["before"], row["n"]
                docs, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                q = order.quantum
                k = np.arange(before // q, (before + n - 1) // q + 1)
                lo = np.maximum(k * q, before)
                hi = np.minimum((k + 1) * q, before + n)
                starts = order.start(s, int(k[0]), len(k)) if row["starts"] is None else np.array(row["starts"], np.int64)
                at = starts + lo - k * q
                owner, inside = order.cuts(at, hi - lo)
                begins = before + np.cumsum(np.r_[0, lengths])
                cut = np.unique(np.concatenate([lo, begins[:-1], lo[owner] + inside - at[owner]]))
                end = np.r_[cut[1:], before + n]
                d = np.searchsorted(begins, cut, side="right") - 1
                i = np.searchsorted(lo, cut, side="right") - 1
                seq, off = order.sequence(at[i] + cut - lo[i])
                ids = memoryview(row["ids"])
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip((cut - before).tolist(), (end - before).tolist(), strict=True)]
                doc = docs[d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array([row["source"]] * len(d), pa.string()), *(pa.array(x, pa.int64()) for x in (cut - begins[d], end - cut, crc, lengths[d], seq, off))],
                    [x.split()[0] for x in RESULT.split(", ")],
                )

    return run


def _sums(batches):
    """Rows in order of due times within their range: block, source, k, part (the range) and the place in it where the quantum begins."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        # Rows of one quantum lie together, and only the first has its size.
        ends = total + np.cumsum(b.column("size").to_numpy())
        total = int(ends[-1]) if len(ends) else total
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("source"), b.column("k"), pa.array([part] * n, pa.int32()), pa.array(ends - b.column("full").to_numpy(), pa.int64()), pa.array(ends, pa.int64())], ["block", "source", "k", "part", "at", "end"])


def _with_before(sizes: DataFrame, queue: str) -> DataFrame:
    """sizes with a column before: the tokens of a queue in the blocks before each. Blocks are added up by the 256 tasks that made them, then the sums."""
    own = sizes.withColumn("_g", F.shiftright("block", 40))
    ahead = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(queue, "_g").agg(F.sum("n").alias("_s"))
    bases = sums.select(queue, "_g", F.coalesce(F.sum("_s").over(ahead([queue], "_g")), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("n").over(ahead([queue, "_g"], "block")), F.lit(0))
    return own.withColumn("_i", inside).join(bases, [queue, "_g"]).withColumn("before", F.col("_b") + F.col("_i")).drop("_g", "_b", "_i")


def _starts(sizes: DataFrame, totals: DataFrame, q: int) -> DataFrame:
    """block, source, queue, before, starts: where the quanta begin of which a block has tokens, in order."""
    offsets = stored(_with_before(sizes, "source").select("block", "source", "n", "before"), "offsets")
    each = offsets.join(totals, "source").withColumn("k", F.explode(F.sequence(F.expr(f"before div {q}"), F.expr(f"(before + n - 1) div {q}"))))
    full = F.least(F.lit(q).cast("long"), F.col("tokens") - F.col("k") * q)
    each = each.select("block", "source", "k", "before", full.alias("full"), F.when(F.col("k") * q >= F.col("before"), full).otherwise(F.lit(0)).alias("size"), ((F.col("k") * q + F.col("phase") * full) / F.col("share")).alias("due"))
    dealt = each.repartitionByRange(parts(sizes.sparkSession), "due", "source", "k").sortWithinPartitions("due", "source", "k", "before")
    places = stored(dealt.mapInArrow(_sums, "block long, source string, k long, part int, at long, end long"), "places")
    # A number for each range, of which there are as many as shuffle partitions.
    ends, bases = dict(places.groupBy("part").agg(F.max("end")).collect()), {}
    for part in sorted(ends):
        bases[part] = sum(ends[x] for x in bases)
    rows = sizes.sparkSession.createDataFrame(list(bases.items()), "part int, base long")
    starts = places.join(F.broadcast(rows), "part").groupBy("block", "source").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("at") + F.col("base")).alias("at"))))["at"].alias("starts"))
    return stored(offsets.select("block", "source", F.lit(0).alias("queue"), "before").join(starts, ["block", "source"]), "starts")


def pack(docs: DataFrame, tokenizer: str, source: str = "source", targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of documents, and where in which sequence each lies.

    A document is the ids of its whole text by the tokenizers file, then the id 1. Sequences are filled to 2048 without padding
    and the end of the corpus to powers of two. Every window holds the sources in proportion to `targets` (a share above 0 by source,
    in any unit; a source that is not named has the least of them), for as long as each lasts; those left then share the windows
    in proportion to theirs. Without targets a source's share is that of its tokens in the corpus, so all last to the end.
    Columns: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text: empty, which is the id 1 alone. A null source is one source, written ''. Rows that share a doc_id are
    packed each. An empty table gives no row. Other columns are not read.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = stored(own.mapInArrow(_tokenise(tokenizer), BLOCK), "tokens")
    sizes = blocks.select("block", "source", "n")
    least = min(targets.values(), default=1) if targets else None
    top = sizes.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(QUEUES + 1).collect()
    if len(top) > QUEUES:
        # Phases by the golden ratio: sources alike in size are spread evenly.
        place = F.monotonically_increasing_id()
        phase = F.pmod(place.bitwiseAND((1 << 33) - 1) * F.lit(0.6180339887498949) + F.shiftright(place, 33) * F.lit(0.4142135623730951), F.lit(1.0))
        totals = sizes.groupBy("source").agg(F.sum("n").alias("tokens"))
        share = F.col("tokens").cast("double")
        if targets:
            named = blocks.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, target double")
            totals, share = totals.join(named, "source", "left"), F.coalesce("target", F.lit(float(least)))
        totals = totals.select("source", "tokens", share.alias("share"))
        totals = stored(totals.sortWithinPartitions("tokens", "source").withColumn("phase", phase), "totals")
        order = Order([totals.agg(F.sum("tokens")).first()[0]])
        return blocks.join(_starts(sizes, totals, order.quantum), ["block", "source"]).mapInArrow(_place(order), RESULT)
    names = {r["source"]: i for i, r in enumerate(top)}
    order = Order([r["n"] for r in top], shares=[targets.get(r["source"], least) for r in top] if targets and top else None)
    queue = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("source")] if names else F.lit(0)
    # A queue is a source, so a block has one row of it.
    offsets = _with_before(sizes.withColumn("queue", queue), "queue").select("block", "source", "queue", "before", F.lit(None).cast("array<long>").alias("starts"))
    offsets = stored(offsets, "offsets")
    if offsets.count() <= SMALL:
        offsets = F.broadcast(offsets)
    return blocks.join(offsets, ["block", "source"]).mapInArrow(_place(order), RESULT)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
