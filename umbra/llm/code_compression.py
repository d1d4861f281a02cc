"""Vector code compression: each part of a vector becomes the index of its nearest entry in the part's codebook.

Codebooks come by Lloyd's rounds in the form that Elkan gave them. What a row knows about its distances is kept with it from round to
round: for each part one upper bound of the distance to its own entry, and for each entry one lower bound. After a round the bounds
move by as much as the entries did. A distance is computed only where the bounds, or half the distance between two entries, do not
rule an entry out strictly; what is computed is a whole number, so nearest entries and ties are exact. Bounds are 32-bit floats, the
upper ones rounded up and the lower ones down.

A round is one pass over the rows, written to the shared folder, so a lost executor repeats its own rows of that round and no more.
Sums by entry are made a batch at a time and added up by Spark; the codebooks (parts * entries rows) are all that the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, stored, stored_at
from .vectors import dimension, from_bytes, matrix, sound, to_bytes, whole

#: What components are kept within, so that squared distances of up to 512 of them fit a long.
MOST = 1 << 26
#: Rows that a task works on at a time.
STEP = 2048
#: Labels up to which their sums are broadcast: 64 bytes each, so 4 MB.
FEW_LABELS = 1 << 16
UP, DOWN = np.float32(np.inf), np.float32(0)


def _raised(x: np.ndarray) -> np.ndarray:
    """As float32, not under x."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, UP), y)


def _lowered(x: np.ndarray) -> np.ndarray:
    """As float32, not over x nor under 0."""
    y = x.astype(np.float32)
    return np.maximum(np.where(y > x, np.nextafter(y, -UP), y), DOWN)


def between(books: np.ndarray) -> np.ndarray:
    """parts * entries * entries: half the distance between two entries of a codebook, lowered."""
    d = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(3)
    return _lowered(np.sqrt(d.astype(np.float64)) * (0.5 * (1 - 1e-12)))


def assign(x: np.ndarray, books: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> int:
    """Set code, upper and lower to those of the nearest entries; how many distances it took.

    x: rows * parts * width, int64; books: parts * entries * width; code, upper: rows * parts; lower: rows * parts * entries.
    """
    part = np.arange(x.shape[1])
    own = np.arange(books.shape[1]) == code[:, :, None]

    def open_() -> np.ndarray:
        return ~own & ((lower <= upper[:, :, None]) & (half[part, code] <= upper[:, :, None]))

    row, at = np.nonzero(open_().any(2))
    if not len(row):
        return 0
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    mine = code[row, at]
    exact[row, at, mine] = ((x[row, at] - books[at, mine]) ** 2).sum(1)
    root = np.sqrt(exact[row, at, mine].astype(np.float64))
    upper[row, at], lower[row, at, mine] = _raised(root * (1 + 1e-12)), _lowered(root * (1 - 1e-12))
    # With the tightened bound fewer entries stay open.
    i, p, e = np.nonzero(open_())
    exact[i, p, e] = ((x[i, p] - books[p, e]) ** 2).sum(1)
    lower[i, p, e] = _lowered(np.sqrt(exact[i, p, e].astype(np.float64)) * (1 - 1e-12))
    best = exact[row, at].argmin(1)  # the first of equals
    code[row, at] = best
    upper[row, at] = _raised(np.sqrt(exact[row, at, best].astype(np.float64)) * (1 + 1e-12))
    return len(row) + len(i)


def _sums(x: np.ndarray, code: np.ndarray, n_entries: int) -> np.ndarray:
    """parts * entries * (width + 1): sums of components, then counts."""
    n_parts, width = x.shape[1:]
    out = np.zeros((n_parts, n_entries, width + 1), np.int64)
    for p in range(n_parts):
        np.add.at(out[p, :, :width], code[:, p], x[:, p])
        out[p, :, width] = np.bincount(code[:, p], minlength=n_entries)
    return out


class Codes:
    """Codebooks (parts * entries * width, int64) and `rows`: the id, the label, code (a byte a part) and error of each vector kept."""

    def __init__(self, books: np.ndarray, rows: DataFrame, n_distances: list[int]):
        self.books, self.rows, self.n_distances = books, rows, n_distances

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def with_label_errors(self, label: str) -> DataFrame:
        """rows with label_error: the errors of its label, added up. Null labels are one."""
        sums = stored(self.rows.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
        return self.rows.join(F.broadcast(sums) if sums.count() <= FEW_LABELS else sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", n_parts: int = 8, n_entries: int = 16, n_rounds: int = 6, scale: int = 4096) -> Codes:
    """Codes of the vectors, whose components become floor(scale * x).

    Codebooks begin as the parts of the n_entries first vectors by key (a null key last, then by components); each of n_rounds rounds
    assigns every part to the nearest entry, ties to the lower index, and makes each entry the floor of the mean of its parts. An entry
    without parts stays. Then parts are assigned once more.

    Null vectors, and those with a null or non-finite component, are left out. Vectors shorter than the longest, and lengths that n_parts
    does not divide, are filled up with 0. Components beyond MOST count as MOST. With fewer rows than n_entries the codebooks have as
    many entries as there are rows; an empty table has none and gives no row. Repeated rows, and rows that share a key, are coded each.
    """
    given = vectors.where(sound(F.col(vector))).select(F.col(key).alias("id"), F.col(label).alias("label"), whole(F.col(vector), scale, MOST).alias("v"))
    rows, path = stored_at(given, "vectors")
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(n_entries).select("v").collect()
    width = -(-dimension(rows, "v") // n_parts)
    size = n_parts * width
    books = np.zeros((len(seeds), size), np.int64)
    for i, s in enumerate(seeds):
        books[i, : len(s["v"])] = s["v"]
    books = books.reshape(len(seeds), n_parts, width).swapaxes(0, 1).copy()
    k, taken = len(seeds), []
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"id {types['id']}, label {types['label']}, v binary, code binary, upper binary, lower binary, error long, sums array<long>, distances long"

    def visit(table: DataFrame, now: np.ndarray, moved: np.ndarray | None) -> tuple[DataFrame, str]:
        half = between(now)
        apart = np.where(np.eye(len(now[0]), dtype=bool), UP, half).min(2) if now.size else half

        def one(b: pa.RecordBatch):
            if moved is None:
                x = matrix(b.column("v"), size).reshape(-1, n_parts, width)
                code, lower = np.zeros((len(x), n_parts), np.uint8), np.zeros((len(x), n_parts, k), np.float32)
                upper = np.full(code.shape, UP, np.float32)
            else:
                x = from_bytes(b.column("v"), "<i4", size).astype(np.int64).reshape(-1, n_parts, width)
                code = from_bytes(b.column("code"), "u1", n_parts).copy()
                upper = from_bytes(b.column("upper"), "<f4", n_parts).astype(np.float64)
                lower = from_bytes(b.column("lower"), "<f4", n_parts * k).reshape(-1, n_parts, k).astype(np.float64)
                part = np.arange(n_parts)
                upper, lower = _raised(upper + moved[part, code]), _lowered(lower - moved)
            # A part that lies nearer to its entry than half the way to any other keeps it, and no bound of it is looked at.
            far = (upper >= apart[np.arange(n_parts), code]).any(1)
            state = [a[far] for a in (code, upper, lower)]
            n = assign(x[far], now, *state, half)
            for a, new in zip((code, upper, lower), state, strict=True):
                a[far] = new
            error = np.zeros(len(x), np.int64)
            for p in range(n_parts):
                error += ((x[:, p] - now[p, code[:, p]]) ** 2).sum(1)
            ids = [b.column("id"), b.column("label")]
            columns = [*ids, to_bytes(x.reshape(len(x), size).astype("<i4")), to_bytes(code), to_bytes(upper.astype("<f4")), to_bytes(lower.astype("<f4").reshape(len(x), n_parts * k)), pa.array(error), pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.int64())]
            return columns, _sums(x, code, k), n

        def run(batches):
            names = total = None
            n = 0
            for b in batches:
                for at in range(0, b.num_rows, STEP):
                    part = b.slice(at, STEP)
                    names, kinds = ["id", "label", "v", "code", "upper", "lower", "error", "sums", "distances"], [part.schema.field(c).type for c in ("id", "label")]
                    columns, sums, some = one(part)
                    n, total = n + some, sums if total is None else total + sums
                    yield pa.RecordBatch.from_arrays(columns, names)
            if total is not None:  # one more row a task: what its rows add up to
                kinds += [pa.binary()] * 4 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), pa.array([total.ravel().tolist()], pa.list_(pa.int64())), pa.array([n])], names)

        return stored_at(table.mapInArrow(run, schema), "codes")

    if not k:
        return Codes(books, rows.select(F.col("id").alias(key), F.col("label").alias(label), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), [])
    state, moved = rows, None
    for turn in range(n_rounds + 1):
        before, (state, path) = path, visit(state.where("v is not null"), books, moved)
        drop_tables(vectors.sparkSession, [before])  # it has been gone through
        totals = state.where("sums is not null")
        taken.append(totals.agg(F.sum("distances")).first()[0])
        if turn == n_rounds:
            break
        total = np.zeros(n_parts * k * (width + 1), np.int64)
        for r in totals.select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
            total[r["i"]] = r["n"]
        total = total.reshape(n_parts, k, width + 1)
        count = total[:, :, width:]
        new = np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)
        moved = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64)) * (1 + 1e-12)
        books = new
    coded = state.where("v is not null").select(F.col("id").alias(key), F.col("label").alias(label), "code", "error")
    return Codes(books, coded, taken)


def op11_code_compression(spark, sf_dir: str) -> DataFrame:
    codes = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = codes.with_label_errors("label")
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
