"""SimHash near-dedup by a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, stored

SEED, SHINGLE, MOST_BITS = 42, 3, 3
#: Two of eight bytes differ in a bit at least each, so a pair within MOST_BITS bits has the same byte at this many places.
LEAST_BYTES = 8 - MOST_BITS
#: A posting list of more fingerprints is split by two further places.
HOT = 2_000
ROWS = 20_000
U64 = np.uint64


def fingerprint(text: bytes) -> int:
    import xxhash

    ws = text.lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    if len(ws) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        starts = np.r_[0, ends[: -SHINGLE]].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    n, total = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        some = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        texts = b.column("text")
        got = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in texts], U64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def _mask(places) -> int:
    m = sum(0xFF << (8 * p) for p in places)
    return m - (1 << 64) if m >> 63 else m


#: Of five places of eight, three lie in one half; so each pair that shares five bytes shares one of these triples.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _components(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is within MOST_BITS bits in one posting list: at most one less than its members."""
    links, left = [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = left ^ front.pop()
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = (shared >= LEAST_BYTES) & (np.bitwise_count(x) <= MOST_BITS)
            if near.any():
                me = left[near]
                links += [(int(a), int(b)) for a, b in zip(me, me ^ x[near], strict=True)]
                front += list(me)
                left = left[~near]
    return links


def _postings(rows: pa.Table) -> pa.Table:
    """Links in a bucket of posting lists. A list holds fingerprints with the same bytes at some places."""
    slot, key, fp = (rows.column(c).to_numpy() for c in ("slot", "posting", "fp"))
    order = np.lexsort((fp, key, slot))
    slot, key, fp = slot[order], key[order], fp[order].view(U64)
    cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(slot) != 0)) + 1
    lo, hi = np.r_[0, cut], np.r_[cut, len(fp)]
    size = hi - lo
    two = lo[size == 2]
    x = fp[two] ^ fp[two + 1]
    near = ((x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST_BYTES) & (np.bitwise_count(x) <= MOST_BITS)
    pairs = [np.stack([fp[two[near]], fp[two[near] + 1]], 1)]
    for a, b in zip(lo[size > 2].tolist(), hi[size > 2].tolist(), strict=True):
        if links := _components(np.ascontiguousarray(fp[a:b])):
            pairs.append(np.array(links, U64))
    both = np.concatenate(pairs).view(np.int64)
    return pa.table({"u": both.max(1), "v": both.min(1)})


def links(fps: DataFrame) -> DataFrame:
    """(u, v), u > v: links that join all distinct fingerprints `fp` within MOST_BITS bits of one another, through others where they can."""
    n = fps.count()
    slots = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("posting")) for i, t in enumerate(TRIPLES))))
    index = fps.select("fp", slots.alias("s")).select("s.slot", "s.posting", "fp")
    hot = stored(index.groupBy("slot", "posting").count().where(F.col("count") > HOT).select("slot", "posting"), "hot-postings")
    if not hot.isEmpty():
        # The pair shares two or more of the other five places.
        more = []
        for i, t in enumerate(TRIPLES):
            rest = [p for p in range(8) if p not in t]
            more += [(i, 100 * (i + 1) + j, _mask((*t, *two))) for j, two in enumerate(combinations(rest, LEAST_BYTES - 3))]
        finer = F.array(*(F.struct(F.lit(a).alias("of"), F.lit(b).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("posting")) for a, b, m in more))
        split = index.join(hot, ["slot", "posting"], "left_semi").select("fp", F.explode(F.filter(finer, lambda x: x["of"] == F.col("slot"))).alias("s")).select("s.slot", "s.posting", "fp")
        index = index.join(hot, ["slot", "posting"], "left_anti").unionByName(split)
        n *= 10
    buckets = max(1, -(-n * len(TRIPLES) // ROWS))
    deal = F.pmod(F.xxhash64("slot", "posting"), F.lit(buckets)).cast("int").alias("bucket")
    return index.select(deal, "slot", "posting", "fp").groupBy("bucket").applyInArrow(_postings, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for each node of edges but the least of its component, that least node. Alternating large and small stars."""
    edges = stored(edges.select("u", "v"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        before = now


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach) for each row of docs.

    Text is lower-cased from A to Z and cut into words [^\\x20\\x09-\\x0D]+ and shingles of three, repeats included, joined by one
    blank (fewer words: the whole sequence). A bit is set if it is set in over half of the shingles' XXH64 with seed 42.
    Fingerprints link at three or fewer differing bits. Only distinct fingerprints are compared.

    Null or empty text: fingerprint zero, linked like any other. A null doc_id counts as the smallest and stays null. Rows that
    share a doc_id each get their own fingerprint. An empty table gives none. Other columns are not read.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    fps = stored(own.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("root")), "distinct")
    member = components(links(distinct.select("fp")))
    nodes = stored(distinct.join(member.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "root", F.coalesce("v", "fp").alias("top")), "members")
    tops = stored(nodes.groupBy("top").agg(F.min("root").alias("component_id")), "tops")
    named = stored(nodes.join(tops, "top").select("fp", "component_id"), "named")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return fps.join(named, "fp").select(null("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null("component_id"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
