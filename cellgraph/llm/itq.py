"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the vectors.

A rotation is learnt on a bounded sample (SAMPLE_ROWS vectors, the smallest by hash) so that signs of the rotated, centred
vectors make balanced binary codes. Every vector is coded under ROTATIONS such rotations (different starts). From each code several
tables take a key of equally many bits; a vector is listed once per table and looked up under its key and all that differ from it in one bit. The width of
every key follows log2 of the number of vectors, so a list keeps a bounded expected length as the corpus grows (codes have no more bits than vectors have
dimensions, so shorter vectors than that have longer lists). Wide keys meet less often; tables are added until trial pairs at the threshold meet, and where
MAX_TABLES do not reach that, keys get narrower until they do (at one bit all vectors meet, so some width always does). Candidates whose whole codes are farther
apart than any trial pair's are dropped before they are moved; the rest are compared by cosine in double precision. Vectors that are hard to tell apart by
signs, say because they share a large mean, so cost more comparisons, not links. Recall against all pairs is measured in the tests (0.9 is asked; see README).

Vectors of different lengths have no cosine: every length that two vectors have is searched by itself, with its own rotations, one search after the other.

Equal vectors are collapsed first: copies cost one row, and count in the links of their class.

Nulls and odd rows: vectors that are null, empty, zero, or that hold null or non-finite components link with nothing and are their own component;
very large and very small components are scaled by a power of two first, so norms neither overflow nor vanish; a null vec_id takes part and is never the smallest of a component; repeated rows (same vec_id and vector) are
different rows that link with each other; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import hashed_sample, smallest_reachable

SIMILAR = 0.95
#: Vectors the rotations are learnt on, at most.
SAMPLE_ROWS = 20_000
ROTATIONS, ROUNDS, BITS = 3, 40, 64
#: Share of trial pairs at the threshold that must meet in a table, trial pairs of each kind, and tables a rotation before keys get narrower.
MEETING, TRIALS, MAX_TABLES = 0.99, 2000, 64
#: Joins with what a written table of codes, links or labels gives never broadcast: Spark sizes what is exploded from it like the file, and a broadcast passes through the driver.
JOIN = "merge"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: the same directions to the bit, with norms near one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, bits: int = BITS, rotations: int = ROTATIONS, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean and projections (dim x bits): principal axes of unit vectors turned by iterative quantisation."""
    unit = _units(sample)
    mean = unit.mean(0)
    x = unit - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    out = []
    for k in range(rotations):
        rng = np.random.default_rng(seed + k)
        dims = min(bits, axes.shape[1])
        v = x @ axes[:, :dims]
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        out.append(axes[:, :dims] @ turn)
    return mean, out


def key_bits(bits: int, width: int, seed: int) -> Iterator[list[int]]:
    """Places in the code of each table's key, always `width` of them; every bit is used once before one is used again."""
    rng, left = np.random.default_rng(seed), []
    while True:
        own, left = left[:width], left[width:]
        if len(own) < width:
            fresh = [b for b in rng.permutation(bits).tolist() if b not in own]
            own, left = own + fresh[:width - len(own)], fresh[width - len(own):]
        yield own


def trials(sample: np.ndarray, mean: np.ndarray, turns: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """Which bits differ (pairs x bits, per rotation) between vectors of the sample and others at the threshold from them.

    Half of the others lie in a random direction, half in the direction of another vector of the sample, as vectors of one cluster do.
    """
    rng, u = np.random.default_rng(3), _units(sample)
    u = u[rng.permutation(len(u))[:TRIALS]]
    away = np.concatenate([rng.normal(size=u.shape), np.roll(u, 1, 0) - u])
    u = np.concatenate([u, u])
    away -= (away * u).sum(1, keepdims=True) * u
    # vectors of one dimension, and parallel ones, have no other direction
    v = threshold * u + math.sqrt(max(0.0, 1 - threshold ** 2)) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return [((u - mean) @ turn >= 0) != ((v - mean) @ turn >= 0) for turn in turns]


def reach(apart: list[np.ndarray]) -> list[int]:
    """Per rotation, the largest distance of whole codes that a trial pair has: farther candidates are not compared."""
    return [int(a.sum(1).max()) for a in apart]


def tables(apart: list[np.ndarray], width: int) -> list[list[list[int]]]:
    """key_bits of the tables of every rotation: as many as use every bit, and more until MEETING of the trial pairs of each kind meet.

    Keys have `width` bits, or fewer where MAX_TABLES of them do not suffice.
    """
    pairs, bits = apart[0].shape
    for narrow in range(width, 0, -1):
        met, makers, out = np.zeros(pairs, bool), [key_bits(bits, narrow, 11 + r) for r in range(len(apart))], [[] for _ in apart]
        reached = False
        while len(out[0]) < MAX_TABLES and not (reached and len(out[0]) * narrow >= bits):
            for own, maker, a in zip(out, makers, apart):
                own.append(next(maker))
                met |= a[:, own[-1]].sum(1) <= 1
            reached = min(met[:pairs // 2].mean(), met[pairs // 2:].mean()) >= MEETING
        if reached:
            break
    return out


def _valid(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _codes(batches: Iterator[pa.RecordBatch], mean: np.ndarray, turns: list[np.ndarray], places: list[list[list[int]]]) -> Iterator[pa.RecordBatch]:
    """(v, codes, keys): the code of every rotation, and the keys of all tables of all rotations in turn."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _units(np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_numpy(zero_copy_only=False)])) - mean
        codes, keys = [], []
        for turn, own in zip(turns, places):
            bits = np.zeros((len(x), BITS), np.uint8)
            bits[:, :turn.shape[1]] = x @ turn >= 0
            codes.append(np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel())
            keys += [bits[:, at] @ (np.int64(1) << np.arange(len(at))) for at in own]
        lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(k), np.stack(k, 1).ravel()) for k in (codes, keys)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["v", "codes", "keys"])


def _lists(codes: DataFrame, width: int, probe: bool) -> DataFrame:
    """(table, key, v, codes): the key of every table, or with probe also all at distance one."""
    listed = codes.select("v", "codes", F.posexplode("keys").alias("table", "key"))
    if not probe:
        return listed
    flips = F.array(*[F.lit(f).cast("bigint") for f in (0, *(1 << b for b in range(width)))])
    return listed.select("v", "codes", "table", F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).alias("key"))


def _cosines(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (scaled(np.stack([np.asarray(v, np.float64) for v in batch.column(k).to_numpy(zero_copy_only=False)])) for k in (2, 3))
        cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
        keep = pa.array(cosine >= threshold)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(cosine).filter(keep)], ["a", "b", "cosine"])


def near_duplicates(vectors: DataFrame, threshold: float = SIMILAR, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, classes and links of vectors (vec_id, embedding).

    Rows: (vec_id, n_links, component_id, kept), one per row. Classes: (class_id, first_id, copies). Links: (a, b, cosine) between classes.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    seen = rows.withColumn("ok", _valid("x")).withColumn("x", F.when(F.col("ok"), F.transform("x", lambda v: v + F.lit(0.0))))
    keyed = cut_lineage(seen.withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))), 256))))
    classes = cut_lineage(keyed.where("ok").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
                          .withColumn("v", F.monotonically_increasing_id()))
    links = vectors.sparkSession.createDataFrame([], "a bigint, b bigint, cosine double")
    for size in classes.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("d").collect():
        alike = classes.where(F.size("x") == size["d"])
        sample = np.array([r["x"] for r in hashed_sample(alike, sample_rows, "key").select("x").collect()])
        links = links.unionByName(cut_lineage(_search(alike, sample, size["n"], threshold)))
    parts = smallest_reachable(links, "a", "b", JOIN).select(F.col("node").alias("v"), "component")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(classes.select(F.col("v").alias("b"), "copies").hint(JOIN), "b").groupBy(F.col("a").alias("v")).agg(F.sum("copies").alias("others"))
    placed = classes.drop("x").join(parts.hint(JOIN), "v", "left").join(degree.hint(JOIN), "v", "left").withColumn("component", F.coalesce("component", "v"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = placed.join(least, "component").select("key", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.select("vec_id", "ok", "key").join(told, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id")).cast(kind).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out, classes.select(F.col("v").alias("class_id"), "first_id", "copies"), links


def _search(classes: DataFrame, sample: np.ndarray, n: int, threshold: float) -> DataFrame:
    mean, turns = learn(sample)
    trial = trials(sample, mean, turns, threshold)
    places = tables(trial, max(1, min(turns[0].shape[1], 30, round(math.log2(max(n, 2))))))
    width = len(places[0][0])
    codes = cut_lineage(classes.select("v", "x").mapInArrow(lambda it: _codes(it, mean, turns, places), "v bigint, codes array<bigint>, keys array<bigint>"))
    listed = _lists(codes, width, probe=False)
    asked = _lists(codes, width, probe=True).select("table", "key", F.col("v").alias("w"), F.col("codes").alias("others"))
    apart = lambda r: F.bit_count(F.get("codes", F.lit(r)).bitwiseXOR(F.get("others", F.lit(r))))
    pairs = listed.join(asked.hint(JOIN), ["table", "key"]).where(F.col("v") < F.col("w"))
    for r, limit in enumerate(reach(trial)):
        pairs = pairs.where(apart(r) <= limit)
    pairs = pairs.select(F.col("v").alias("a"), F.col("w").alias("b")).distinct()
    left, right = classes.select(F.col("v").alias("a"), F.col("x").alias("xa")), classes.select(F.col("v").alias("b"), F.col("x").alias("xb"))
    both = pairs.join(left.hint(JOIN), "a").join(right.hint(JOIN), "b").select("a", "b", "xa", "xb")
    return both.mapInArrow(lambda it: _cosines(it, threshold), "a bigint, b bigint, cosine double")
