"""Hard negatives by inner product, through one-dimensional distance keys.

Every vector gets one more component that makes all lengths equal; an anchor gets 0 there. Then a higher inner product is a smaller
Euclidean distance. The index is the table of all rows, sorted by (pivot, distance to it), the pivot being the nearest of a few rows.
A pivot's distances are parted at quantiles into cells. By the triangle inequality a cell whose distances are [lo, hi] can only hold
rows that lie between max(0, lo - d, d - hi) and hi + d from an anchor at distance d of the pivot.

A search wants an anchor's first rows within a range of scores, and so within an annulus around it. Round after round it scans the
next cells in the order of their least possible distance, more of them each time, until the least distance of all that remain lies
beyond the k-th row found, or beyond the annulus: then nothing can be missing. Anchors and cells meet by (cell, part of the cell, part
of the anchors), all of bounded size, so copies of one vector are in one cell but in many parts of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, stored, stored_at
from .vectors import dimension, from_bytes, matrix, sound, to_bytes, whole

#: What components are kept within: inner products of up to 512 of them fit a long.
MOST = 1 << 26
#: Below this sum of squares inner products are exact as doubles.
EXACT = 1 << 52
#: Pivots and the rows by hash that they are chosen from: a bound on what is learned from a sample. The index holds every row.
N_PIVOTS, SAMPLE = 16, 4096
#: Cells of a pivot at most; rows that a cell has at least, on average; rows and anchors that meet in one group at most, on average.
N_CELLS, LEAST, GROUP = 64, 512, 2048
#: Cells that a search scans in its first round, and how many times more in each next one.
FIRST, MORE = 8, 8
#: Scores of a group that are compared at a time.
STEP = 1 << 21
NEVER, NONE = -(1 << 62), 1 << 62
FOUND = "anchor long, j int, score long, vec_id long"


class Index:
    """All rows, by (cell, part) and sorted by (pivot, distance); pivots, and of each cell its pivot, least and greatest distance and its parts."""

    def __init__(self, rows: DataFrame, group: int = GROUP):
        """rows: vec_id, label, v (whole numbers)."""
        spark = rows.sparkSession
        self.width = dimension(rows, "v")
        square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        n, longest = rows.agg(F.count("*"), F.max(square)).first()
        n, self.longest, self.group = n or 0, longest or 0, group
        sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow()
        self.pivots = self._spread(self._lifted(matrix(sample.column("v"), self.width)))
        pivots, lifted = self.pivots, self._lifted
        width = self.width

        def near(batches):
            for b in batches:
                d = distances(lifted(matrix(b.column("v"), width)), pivots)
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array(p, pa.int32()), pa.array(d[np.arange(len(p)), p])], ["vec_id", "label", "v", "pivot", "key"])

        keyed = stored(rows.select("vec_id", "label", "v").mapInArrow(near, "vec_id long, label long, v array<int>, pivot int, key double"), "keys")
        n_cells = max(1, min(N_CELLS, n // (N_PIVOTS * LEAST)))
        shares = [i / n_cells for i in range(1, n_cells)]
        cuts = {r["pivot"]: r["c"] for r in keyed.groupBy("pivot").agg(F.percentile_approx("key", shares, 1000).alias("c")).collect()} if shares else {}
        # A cell is named by its pivot and the number of cuts that lie under its distances.
        bounds = F.array(*(F.array(*map(F.lit, [*cuts.get(p, []), float("inf")])) for p in range(max(1, len(pivots)))))
        placed = keyed.withColumn("cell", F.col("pivot") * N_CELLS + F.size(F.filter(F.get(bounds, F.col("pivot")), lambda c: c < F.col("key"))))
        table = placed.groupBy("cell", "pivot").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).orderBy("cell").collect()
        self.cells = [(r["cell"], r["pivot"], r["lo"], r["hi"], -(-r["n"] // group)) for r in table]  # as many as pivots and N_CELLS allow
        parts = [1] * (N_PIVOTS * N_CELLS)
        for c, *_, m in self.cells:
            parts[c] = m
        part = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.get(F.lit(parts), F.col("cell"))).cast("int")
        spread = max(1, min(1 << 15, n // (8 * group)))
        packed = placed.withColumn("part", part).repartitionByRange(spread, "pivot", "key", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "key", "vec_id")
        self.rows = stored(packed.select("cell", "part", "pivot", "key", "vec_id", "label", "v"), "index")

    def _lifted(self, v: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes them as long as the longest."""
        v = v.astype(np.float64)
        return np.concatenate([v, np.sqrt(np.maximum(0.0, self.longest - (v * v).sum(1)))[:, None]], 1)

    @staticmethod
    def _spread(points: np.ndarray) -> np.ndarray:
        """Some of the points, each the farthest from those before it."""
        if not len(points):
            return points
        chosen, d = [0], distances(points, points[:1])[:, 0]
        while len(chosen) < N_PIVOTS and d.max() > 0:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, distances(points, points[chosen[-1:]])[:, 0])
        return points[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k highest scores of each row, of equals the first; none where the score is NEVER."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    take = score > least
    same = score == least
    take |= same & (np.cumsum(same, 1) <= k - take.sum(1)[:, None])
    return np.nonzero(take & (score != NEVER))


def search(index: Index, wants: DataFrame, k: int, same_label: bool) -> DataFrame:
    """FOUND: for each search the first k rows of the anchor's label, or of other labels, with scores from low to high, by score and then vec_id.

    wants: anchor (a number of its own), vec_id, label, v, and searches: array of j, low, high; a null high is none. Rows that share the
    anchor's vec_id are not found.
    """
    spark = wants.sparkSession
    width, longest, exact = index.width, index.longest, index.longest < EXACT
    cells, pivots, group = index.cells, index.pivots, index.group
    ids, of, lo, hi, parts = (np.array([c[i] for c in cells]) for i in range(5)) if cells else (np.zeros(0, int),) * 5
    state, state_path = stored_at(wants.select("anchor", "vec_id", "label", "v", "searches"), "wants")
    n_anchors = state.count()
    some = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-n_anchors // group)))).cast("int").alias("some")

    def asked(done: int, limit: int):
        """The cells, of those that lie from `done` to `limit` in the order of an anchor's least distances, that its searches need."""

        def run(batches):
            for b in batches:
                v = matrix(b.column("v"), width)
                size = (v.astype(np.float64) ** 2).sum(1)
                d = distances(np.concatenate([v, np.zeros((len(v), 1))], 1), pivots)[:, of]
                slack = 1e-6 * (1 + np.sqrt(size + longest))[:, None]  # far more than rounding
                near, far = np.maximum(0, np.maximum(lo - d, d - hi)) - slack, d + hi + slack
                order = np.argsort(near, axis=1, kind="stable")
                out = []
                for i, searches in enumerate(b.column("searches").to_pylist()):
                    reach = lambda score, i=i: float(np.sqrt(max(0.0, size[i] + longest - 2.0 * score)))
                    due: dict[int, list] = {}
                    for s in searches:
                        outer = np.inf if s["low"] == NEVER else reach(s["low"])
                        inner = 0.0 if s["high"] is None else reach(s["high"])
                        for c in order[i, done:limit].tolist():
                            if near[i, c] > outer:
                                break  # all that remain are farther
                            if far[i, c] >= inner:
                                due.setdefault(c, []).append(s)
                    out += [(i, int(ids[c]), p, needed) for c, needed in due.items() for p in range(int(parts[c]))]
                at, cell, part, needed = zip(*out, strict=True) if out else ((),) * 4
                at = pa.array(at, pa.int64())
                columns = [b.column(n).take(at) for n in ("anchor", "vec_id", "label", "some")]
                kind = pa.list_(pa.struct([("j", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))
                columns += [to_bytes(v.astype("<i4")).take(at), pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(needed, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "vec_id", "label", "some", "v", "cell", "part", "searches"])

        return run

    def met(rows: pa.Table, asks: pa.Table) -> pa.Table:
        """The best rows of one part of a cell for each search of one part of the anchors."""
        order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        got, label = rows.column("vec_id").to_numpy()[order], rows.column("label").to_numpy()[order]
        kind = np.float64 if exact else np.int64
        x = matrix(rows.column("v"), width)[order].astype(kind).T
        v = from_bytes(asks.column("v"), "<i4", width).astype(kind)
        a_id, a_label, anchor = (asks.column(c).to_numpy() for c in ("vec_id", "label", "anchor"))
        searches = [(i, s["j"], s["low"], NONE if s["high"] is None else s["high"]) for i, own in enumerate(asks.column("searches").to_pylist()) for s in own]
        out, step = [], max(1, STEP // max(1, len(got)))
        for at in range(0, len(searches) if len(got) else 0, step):
            i, j, low, high = np.array(searches[at : at + step], np.int64).T
            own, back = np.unique(i, return_inverse=True)
            score = (v[own] @ x).astype(np.int64)[back]
            good = ((a_label[i][:, None] == label) == same_label) & (a_id[i][:, None] != got) & (score >= low[:, None]) & (score <= high[:, None])
            r, c = _best(np.where(good, score, NEVER), k)
            out.append((anchor[i[r]], j[r].astype(np.int32), score[r, c], got[c]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in ("i8", "i4", "i8", "i8")]
        return pa.table(dict(zip(("anchor", "j", "score", "vec_id"), columns, strict=True)))

    first = Window.partitionBy("anchor", "j").orderBy(F.desc("score"), "vec_id")
    schema = "anchor long, vec_id long, label long, some int, v binary, cell int, part int, searches array<struct<j:int,low:long,high:long>>"
    best, best_path, done, limit = spark.createDataFrame([], FOUND), None, 0, FIRST
    while n_anchors and done < len(cells):
        asks, asks_path = stored_at(state.select("*", some).mapInArrow(asked(done, limit), schema), "asks")
        due = asks.select(*(F.col(c).alias(c) for c in ("cell", "part", "some"))).distinct()  # columns of their own
        rows = index.rows.select("cell", "part", "vec_id", "label", "v").join(due, ["cell", "part"])
        hits = rows.groupBy("cell", "part", "some").cogroup(asks.groupBy("cell", "part", "some")).applyInArrow(met, FOUND)
        hits = hits.unionByName(best).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
        old = [asks_path, *([best_path] if best_path else [])]
        best, best_path = stored_at(hits, "found")
        drop_tables(spark, old)
        done, limit = limit, limit * MORE
        if done < len(cells):
            # What has k rows needs none under the least of them; those of the same score may still come before it.
            kth = best.groupBy("anchor", "j").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("j", "least"))).alias("kth"))
            low = lambda s: F.greatest(s["low"], F.coalesce(F.try_element_at("kth", s["j"]), F.lit(NEVER)))
            closer = F.transform("searches", lambda s: F.struct(s["j"].alias("j"), low(s).alias("low"), s["high"].alias("high")))
            old, (state, state_path) = state_path, stored_at(state.join(kth, "anchor", "left").select("anchor", "vec_id", "label", "v", closer.alias("searches")), "wants")
            drop_tables(spark, [old])
    return best


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is an inner product; higher ones come first, ties by smaller key. Anchors are the rows whose
    key `every` divides. An anchor's positives are its first n_positives other rows of its label; for each of them come the first
    n_negatives rows of other labels whose score is from least to most hundredths of the positive's.

    Rows without a key, a label or a vector, or with a null or non-finite component, take no part. Rows that share a key are rows of their
    own, but none is another's positive or negative; anchors among them are mined once, as the one with the least label and vector.
    Vectors shorter than the longest are filled up with 0; components beyond MOST count as MOST. Keys and labels are whole numbers. An
    empty table, or one without anchors, gives no row.
    """
    own = vectors.where(sound(F.col(vector)) & F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = stored(own.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole(F.col(vector), scale, MOST).alias("v")), "vectors")
    index = Index(rows, group)
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select(F.col("vec_id").alias("anchor"), "vec_id", "x.*")
    anchors = stored(anchors, "anchors")
    one = F.array(F.struct(F.lit(0).alias("j"), F.lit(NEVER).alias("low"), F.lit(None).cast("long").alias("high")))
    positives = search(index, anchors.withColumn("searches", one), n_positives, True)
    # Scores of an anchor's positives, each once; a negative one leaves no score between.
    scores = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    whole_part = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")  # noqa: E731  as decimals nothing is rounded
    share = lambda p, by: p.cast("decimal(20,0)") * by
    ranges = F.transform("scores", lambda p, i: F.struct(i.cast("int").alias("j"), whole_part(share(p, least) + 99).alias("low"), whole_part(share(p, most)).alias("high")))
    wants = anchors.join(scores, "anchor").withColumn("searches", F.filter(ranges, lambda s: s["low"] <= s["high"]))
    negatives = search(index, wants.drop("scores"), n_negatives, False)
    named = scores.select("anchor", F.posexplode("scores").alias("j", "score"))
    ranked = negatives.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "j").orderBy(F.desc("score"), "vec_id")))
    ranked = ranked.select("anchor", "j", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.select("anchor", F.col("vec_id").alias("positive_id"), "score").join(named, ["anchor", "score"])
    out = pairs.join(ranked, ["anchor", "j"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")))
