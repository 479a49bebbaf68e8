"""Vector code compression: product codes in whole numbers, nearest entries through memoised grid cells.

Vectors become whole numbers, floor(SCALE * x), and are cut into PARTS equal consecutive parts (padded with zeros where the length does not
divide). Each part position has a codebook of up to ENTRIES entries, which starts as that part of the smallest ids and is moved ROUNDS
times to the floored mean of the parts it is nearest to.

Nearest entries: a part lies in a coarse cell of a grid (its components divided by the cell's side, floors). For every cell met, the
entries that can be nearest to any point of its box are listed: an entry is dominated when its least distance from the box exceeds
another's greatest one. A task remembers the cells it has met (MEMO of them, then it starts afresh), and only listed entries are evaluated,
exactly, in whole numbers; ties go to the lower index. The side is the grid's only choice and cannot change a result.

A round reads the vectors in place and sends one row per part, entry and task (sums and counts), so what is shuffled and what
reaches the driver is bounded by PARTS * ENTRIES * length numbers, whatever the number of vectors.

Nulls and odd rows: vectors that are null or hold null or non-finite components are dropped; an empty vector has code 0 in every part and
error 0; vectors of different lengths cannot share a codebook, so every length has its own (one set of jobs per length); null ids come last
in the order of ids, equal ids go by their vectors; repeated rows count as often as they come; null labels are one group; components are
clipped to 2**24 / SCALE (16,384) on either side, so squared distances stay within 64 bits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Side of a grid cell, in whole numbers; cells a task remembers for each part; pairs evaluated at once.
SIDE, MEMO, CHUNK = 32, 50_000, 200_000
_LIMIT = 1 << 24


def whole_numbers(vectors: list, dims: int) -> np.ndarray:
    """(n, PARTS, width) floors of the scaled components, zeros where the length does not divide."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), dims)
    width = -(-dims // PARTS)
    out = np.zeros((len(x), PARTS * width), np.int64)
    out[:, :dims] = np.clip(np.floor(x * SCALE), -_LIMIT, _LIMIT)
    return out.reshape(len(x), PARTS, width)


def undominated(cells: np.ndarray, entries: np.ndarray, side: int) -> np.ndarray:
    """(cells, entries) booleans: entries that may be nearest to a whole-number point of the cell's box, by least and greatest distance.

    Room is left for rounding: an entry may be listed in vain, never missed.
    """
    corner = cells * side
    # numbers up to 2**22 and their halves are exact in single precision
    kind = np.float32 if max(np.abs(corner).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 21 else np.float64
    half = kind((side - 1) / 2)
    middle, seen = corner.astype(kind) + half, entries.astype(kind)
    least, most = np.zeros((2, len(cells), len(entries)), kind)
    for d in range(entries.shape[1]):
        away = np.abs(middle[:, d, None] - seen[None, :, d])
        gap = np.maximum(away - half, 0)
        gap *= gap
        least += gap
        away += half
        away *= away
        most += away
    return least <= most.min(1, keepdims=True) * kind(1.0001) + kind(1)


class Grid:
    """Memoised cells of one part position under one codebook."""

    def __init__(self, entries: np.ndarray, side: int = SIDE):
        self.entries, self.side, self.seen = entries, side, {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row, and its squared distance."""
        cells = np.ascontiguousarray(x // self.side)
        key = cells.view(f"V{8 * x.shape[1]}").ravel() if x.shape[1] else np.zeros(len(x), np.int64)
        _, at, of = np.unique(key, return_index=True, return_inverse=True)
        names = [key[i].tobytes() for i in at]
        if len(self.seen) + len(names) > MEMO:
            self.seen = {}
        fresh = [k for k, name in enumerate(names) if name not in self.seen]
        for lo in range(0, len(fresh), 512):
            part = fresh[lo:lo + 512]
            for k, row in zip(part, undominated(cells[at[part]], self.entries, self.side)):
                self.seen[names[k]] = np.flatnonzero(row).astype(np.int16)
        listed = [self.seen[name] for name in names]
        index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        sizes = np.array([len(c) for c in listed])[of]
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
            asked = np.concatenate([listed[c] for c in of[lo:hi]]).astype(np.int64)
            away = np.repeat(x[lo:hi], sizes[lo:hi], axis=0) - self.entries[asked]
            far = np.einsum("ij,ij->i", away, away)
            starts = np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]])
            best = np.minimum.reduceat(far, starts)
            # the first listed entry at the least distance: lists ascend, so ties go to the lower index
            hit = np.flatnonzero(far == np.repeat(best, sizes[lo:hi]))
            first = hit[np.searchsorted(hit, starts)]
            index[lo:hi], error[lo:hi] = asked[first], best
            lo = hi
        return index, error


def _arrays(batches: Iterator[pa.RecordBatch], dims: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, whole_numbers(batch.column(column).to_numpy(zero_copy_only=False), dims)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, dims: int, side: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, total): what a task found for every entry used."""
    grids = [Grid(b, side) for b in books]
    n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _, x in _arrays(batches, dims, 0):
        for p, grid in enumerate(grids):
            index, _ = grid.nearest(x[:, p])
            n[p] += np.bincount(index, minlength=books.shape[1])
            np.add.at(total[p], index, x[:, p])
    part, entry = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
                                      pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, dims: int, side: int) -> Iterator[pa.RecordBatch]:
    grids = [Grid(b, side) for b in books]
    for batch, x in _arrays(batches, dims, 2):
        found = [g.nearest(x[:, p]) for p, g in enumerate(grids)]
        code = np.stack([index for index, _ in found], 1).astype(np.uint8)
        error = np.sum([e for _, e in found], axis=0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error)],
                                         ["vec_id", "label", "code", "error"])


def _kept(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def learn(rows: DataFrame, dims: int, rounds: int = ROUNDS, side: int = SIDE) -> np.ndarray:
    """Codebooks (PARTS, entries, width) of rows (vec_id, x) of one length: ENTRIES smallest ids, then moved in rounds."""
    spark = rows.sparkSession
    start = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()]
    books = whole_numbers(start, dims).transpose(1, 0, 2)
    schema = "part int, entry int, n bigint, total array<bigint>"
    totals = [F.sum(F.get("total", F.lit(d))).alias(f"t{d}") for d in range(books.shape[2])]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        found = rows.select("x").mapInArrow(lambda it, b=shared: _sums(it, b.value, dims, side), schema)
        moved = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
            moved[r["part"], r["entry"]] = [t // r["n"] for t in r[3:]]  # floors, towards minus infinity
        books = moved
    return books


def compress(vectors: DataFrame, rounds: int = ROUNDS, side: int = SIDE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label), a row per row kept."""
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(_kept("x"))
    coded = []
    for r in rows.groupBy(F.size("x").alias("dims")).count().orderBy("dims").collect():
        dims = r["dims"]
        own = rows.where(F.size("x") == dims)
        books = learn(own.select("vec_id", "x"), dims, rounds, side)
        shared = spark.sparkContext.broadcast(books)
        schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
        got = own.mapInArrow(lambda it, b=shared, d=dims: _codes(it, b.value, d, side), schema)
        coded.append(got.withColumn("codebooks_sha256", F.lit(digest(books))))
    if not coded:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    every = coded[0]
    for more in coded[1:]:
        every = every.unionByName(more)
    every = cut_lineage(every)
    # one row per label; written, so that Spark sends it to the tasks only where its size allows
    sums = cut_lineage(every.groupBy("label").agg(F.sum("error").alias("label_error")))
    known = sums.where("label IS NOT NULL")
    none = sums.where("label IS NULL").select(F.col("label_error").alias("_none"))
    joined = every.join(known, "label", "left").withColumn("_none", none.scalar())
    return joined.select("vec_id", "label", "code", "error", F.coalesce("label_error", "_none").alias("label_error"), "codebooks_sha256")
