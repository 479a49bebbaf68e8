"""Distance joins inside a frame. Space is cut into square cells, so a crowded frame spreads
over many tasks and no operator pairs every point of a frame with every other."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import euclidean
from ..session import cut_lineage
from . import tiles

FRAME = ["sample_id", "t"]
TILE = 4  # sides of a tile, in radii or half boxes: each point is in about two tiles


def cell(coord, side) -> Column:
    c = F.col(coord) if isinstance(coord, str) else coord
    return F.floor(c / side).cast("bigint")


def around(reach: int = 1) -> Column:
    """Offsets of a (2*reach+1)^2 block, one row each when exploded."""
    steps = range(-reach, reach + 1)
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in steps for b in steps]))


def distinct_points(gt: DataFrame, gt_id: str = "gt_id") -> DataFrame:
    """Copies at one place collapse to the first id and a weight."""
    return gt.groupBy(*FRAME, F.col("y").alias("gt_y"), F.col("x").alias("gt_x")).agg(
        F.min(gt_id).alias("gt_id"), F.count(F.lit(1)).alias("w"))


def in_neighbour_cells(points: DataFrame, y: str, x: str, side: float) -> DataFrame:
    """Each point once for every cell of the 3x3 block around it (columns cy, cx)."""
    return (points.withColumn("_o", around(1))
            .withColumn("cy", cell(y, side) + F.col("_o.a")).withColumn("cx", cell(x, side) + F.col("_o.b")).drop("_o"))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, how: str = "inner") -> DataFrame:
    """Pairs of one frame at most ``radius`` apart; right columns y, x become gt_y, gt_x."""
    probe = left.withColumn("cy", cell("y", radius)).withColumn("cx", cell("x", radius)).alias("p")
    build = in_neighbour_cells(right, "gt_y", "gt_x", radius).alias("b")
    dist = euclidean("p.y", "p.x", "b.gt_y", "b.gt_x")
    on = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in [*FRAME, "cy", "cx"]]
    cond = on[0] & on[1] & on[2] & on[3] & (dist <= radius)
    keep = [F.col(f"p.{c}") for c in left.columns] + [F.col(f"b.{c}") for c in right.columns if c not in FRAME]
    return probe.join(build, cond, how).select(*keep, dist.alias("distance"))


def _extent(*frames: DataFrame) -> float:
    """Largest coordinate span over the inputs: one small aggregate."""
    both = frames[0].select("y", "x")
    for df in frames[1:]:
        both = both.union(df.select("y", "x"))
    r = both.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    return max(r[1], r[3]) - min(r[0], r[2]) if r[0] is not None else 0.0


def nearest_in_frame(cands: DataFrame, gt: DataFrame, key: str, radius: float = 8.0,
                     gt_id: str = "gt_id", extent: float | None = None) -> DataFrame:
    """Nearest ground-truth point of the same frame; ties go to the first id; NULLs in empty frames.

    ``key`` names the candidates. First pass: tiles of 16 times ``radius``, each searched by one task; a hit within
    four times ``radius`` is final. The cells of the rest probe a ladder of coarser grids, four times wider each. One
    stored point per cell gives an upper bound, and the last search covers the finest grid whose block
    holds that bound. ``extent`` (largest coordinate span) saves a scan when it is known.
    """
    columns, radius = cands.columns, 4.0 * radius
    points = distinct_points(gt, gt_id).drop("w")
    # candidates at one place have one answer: places are searched, candidates only take the answer back
    places = cands.select(*FRAME, "y", "x").distinct()
    gap = euclidean("y", "x", "gt_y", "gt_x")
    best = F.min(F.when(F.col("gt_id").isNotNull(), F.struct(gap.alias("distance"), "gt_id", "gt_y", "gt_x"))).alias("best")
    kind = dict(points.dtypes)["gt_id"]

    def solve(asked: pa.Table, stored: pa.Table) -> pa.Table:
        (qy, qx), (gy, gx), ids = tiles.coordinates(asked), tiles.coordinates(stored), stored.column("gt_id")
        d, at, _ = tiles.nearest(gy, gx, tiles.ranks(ids), qy, qx, radius)
        hit = d <= radius
        pick = pa.array(np.where(hit, at, 0), mask=~hit)
        return tiles.told(asked, gt_id=ids.take(pick), gt_y=stored.column("y").take(pick), gt_x=stored.column("x").take(pick), distance=np.where(hit, d, np.inf))

    close = tiles.solve_tiles(places, points.where("gt_id IS NOT NULL").withColumn("w", F.lit(1).cast("bigint")), TILE * radius, radius, solve,
                              f"gt_id {kind}, gt_y double, gt_x double, distance double")
    first = cut_lineage(close.select(*FRAME, "y", "x", cell("y", radius).alias("cy"), cell("x", radius).alias("cx"), F.when(
        F.col("distance").isNotNull(), F.struct("distance", "gt_id", "gt_y", "gt_x")).alias("best")))
    rest = first.where("best IS NULL").drop("best")

    span = max(_extent(cands, gt) if extent is None else extent, radius)
    steps = max(1, math.ceil(math.log(span / radius, 4))) + 1
    sides = [radius * 4.0 ** i for i in range(1, steps + 1)]
    ladder = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(sides)]))
    leveled = (points.withColumn("_l", ladder)
               .select(*FRAME, F.col("_l.i").alias("lv"), cell("gt_y", F.col("_l.s")).alias("cy"),
                       cell("gt_x", F.col("_l.s")).alias("cx"), "gt_id", "gt_y", "gt_x"))
    # numbers alone, no struct: such an aggregate needs no sort
    stored = leveled.groupBy(*FRAME, "lv", "cy", "cx").agg(F.min("gt_y").alias("gt_y"), F.min_by("gt_x", "gt_y").alias("gt_x")).select(
        *FRAME, "lv", "cy", "cx", F.struct("gt_y", "gt_x").alias("one"))
    # a cell of the first pass asks once for all places in it: any stored point is an upper bound for each of them
    small = rest.select(*FRAME, F.col("cy").alias("hy"), F.col("cx").alias("hx")).distinct()
    asked = (small.withColumn("_l", ladder).withColumn("_o", around(1))
             .select(*FRAME, "hy", "hx", F.col("_l.i").alias("lv"),
                     (cell((F.col("hy") + F.lit(0.5)) * F.lit(radius), F.col("_l.s")) + F.col("_o.a")).alias("cy"),
                     (cell((F.col("hx") + F.lit(0.5)) * F.lit(radius), F.col("_l.s")) + F.col("_o.b")).alias("cx")))
    mid = euclidean((F.col("hy") + F.lit(0.5)) * F.lit(radius), (F.col("hx") + F.lit(0.5)) * F.lit(radius), "one.gt_y", "one.gt_x")
    bounds = (asked.join(stored, [*FRAME, "lv", "cy", "cx"]).groupBy(*FRAME, "hy", "hx")
              .agg(F.min(F.struct(mid.alias("d"), "one")).alias("b")).select(*FRAME, F.col("hy").alias("cy"), F.col("hx").alias("cx"), F.col("b.one").alias("one")))
    bound = (rest.join(bounds, [*FRAME, "cy", "cx"], "left").select(*FRAME, "y", "x", euclidean(
        "y", "x", "one.gt_y", "one.gt_x").alias("ub")))
    level = F.lit(len(sides) - 1)
    for i in reversed(range(len(sides) - 1)):
        level = F.when(F.col("ub") <= sides[i], F.lit(i)).otherwise(level)
    side = F.element_at(F.array(*[F.lit(s) for s in sides]), F.col("lv") + 1)
    away = lambda v, c: F.greatest(F.lit(0.0), c * F.col("s") - F.col(v), F.col(v) - (c + 1) * F.col("s"))
    block = (bound.withColumn("lv", level).withColumn("s", side).withColumn("_o", around(1))
             .withColumn("cy", cell("y", F.col("s")) + F.col("_o.a"))
             .withColumn("cx", cell("x", F.col("s")) + F.col("_o.b")))
    gy, gx = away("y", F.col("cy")), away("x", F.col("cx"))
    # cells beyond the bound cannot hold the nearest point; the home cell stays for frames without any point
    home = (F.col("_o.a") == 0) & (F.col("_o.b") == 0)
    block = block.where(home | (F.sqrt(gy * gy + gx * gx) <= F.col("ub") * F.lit(1.0 + 1e-12))).drop("_o", "s")
    p, b = block.alias("p"), leveled.alias("b")
    on = (euclidean("p.y", "p.x", "b.gt_y", "b.gt_x") <= F.col("p.ub"))
    for k in [*FRAME, "lv", "cy", "cx"]:
        on = on & (F.col(f"p.{k}") == F.col(f"b.{k}"))
    far = (p.join(b, on, "left").select(*[F.col(f"p.{c}").alias(c) for c in (*FRAME, "y", "x")], "b.gt_id", "b.gt_y", "b.gt_x")
           .groupBy(*FRAME, "y", "x").agg(best))
    found = first.where("best IS NOT NULL").drop("cy", "cx").unionByName(far)
    return cands.join(found, [*FRAME, "y", "x"], "left").select(
        *columns, F.col("best.gt_id").alias("gt_id"), F.col("best.gt_y").alias("gt_y"),
        F.col("best.gt_x").alias("gt_x"), F.col("best.distance").alias("distance"))


def radius_counts(gt: DataFrame, cands: DataFrame, radii: Sequence[float] = (3, 5, 7, 10, 15)) -> DataFrame:
    """Candidates within each radius of each ground-truth point, zeros kept (columns n_<r>)."""
    limits = np.array(sorted({float(r) for r in radii}))
    names = [f"n_{r}" for r in radii]
    weights = cands.groupBy(*FRAME, F.col("y").alias("gt_y"), F.col("x").alias("gt_x")).agg(F.count(F.lit(1)).alias("w")).withColumn("gt_id", F.lit(0))

    def solve(asked: pa.Table, stored: pa.Table) -> pa.Table:
        (qy, qx), (cy, cx), n = tiles.coordinates(asked), tiles.coordinates(stored), np.zeros((asked.num_rows, len(limits)), np.int64)
        if len(cy):
            n = tiles.Grid(cy, cx).within(stored.column("w").to_numpy(), qy, qx, limits)
        return tiles.told(asked, **{name: n[:, np.searchsorted(limits, float(r))] for name, r in zip(names, radii)})

    # points at one place have the same counts: each place is asked once
    per_place = tiles.solve_tiles(gt.select(*FRAME, "y", "x").distinct(), weights, TILE * limits[-1], limits[-1], solve,
                                  ", ".join(f"`{n}` bigint" for n in names))
    return gt.select(*FRAME, "gt_id", "y", "x").join(per_place, [*FRAME, "y", "x"], "left").select(
        *FRAME, "gt_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def gt_in_patch(cands: DataFrame, gt: DataFrame, key: str, half: float = 16.0,
                carry: Sequence[str] = ()) -> DataFrame:
    """Per candidate: points inside its half-open box, the two nearest of them, and where the nearest lies."""
    carry = list(carry)
    place = [*FRAME, "y", "x"]

    def solve(asked: pa.Table, stored: pa.Table) -> pa.Table:
        (qy, qx), (gy, gx), w = tiles.coordinates(asked), tiles.coordinates(stored), stored.column("w").to_numpy()
        n, one, at, two = tiles.nearest_in_boxes(gy, gx, tiles.ranks(stored.column("gt_id")), w, qy, qx, half)
        some = at >= 0
        local = [np.where(some, g[at] - (q - half), np.inf) if len(g) else np.full(len(q), np.inf) for g, q in ((gy, qy), (gx, qx))]
        return tiles.told(asked, n_inside=n, nearest_inside=one, second_inside=two, local_y=local[0], local_x=local[1])

    inside = tiles.solve_tiles(cands.select(*place).distinct(), distinct_points(gt), TILE * half, half, solve,
                               "n_inside bigint, nearest_inside double, second_inside double, local_y double, local_x double")
    return cands.select(*place, key, *carry).join(inside, place, "left").select(
        *FRAME, key, *carry, F.coalesce("n_inside", F.lit(0)).cast("bigint").alias("n_inside"),
        "nearest_inside", "second_inside", "local_y", "local_x")


def temporal_context(cases: DataFrame, gt: DataFrame, key: str, reach: int = 3, half: float = 16.0,
                     clip: bool = False) -> DataFrame:
    """For every case and every frame within ``reach``: how many points, the nearest, those in the box.

    ``clip`` keeps only frames between the first and last annotated frame of the sample.
    """
    shifted = cases.select(
        "sample_id", F.col(key).alias("_case"), F.col("t").alias("case_t"), "y", "x",
        F.explode(F.sequence(F.col("t") - reach, F.col("t") + reach)).alias("t"))
    if clip:
        spans = gt.groupBy("sample_id").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
        shifted = shifted.join(spans, "sample_id").where("t BETWEEN _lo AND _hi").drop("_lo", "_hi")
    slot = shifted.withColumn("slot", F.concat_ws(":", F.col("_case").cast("string"), F.col("t").cast("string")))
    near = nearest_in_frame(slot, gt, key="slot")
    inside = gt_in_patch(slot, gt, key="slot", half=half).select("slot", "n_inside", "nearest_inside")
    per_frame = gt.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_gt"))
    out = near.join(inside, "slot").join(per_frame, FRAME, "left")
    return out.select(
        "sample_id", F.col("_case").alias(key), "case_t", "t", F.coalesce("n_gt", F.lit(0)).cast("bigint").alias("n_gt"),
        F.col("distance").alias("nearest"), F.when(F.col("n_gt").isNotNull(), F.col("n_inside")).alias("n_inside"),
        "nearest_inside")


def k_nearest_to_point(nodes: DataFrame, y: float, x: float, frames: Sequence[int] | None = None,
                       k: int = 3, id_col: str = "node_id") -> DataFrame:
    """The k nodes of each frame closest to a fixed point (the rank limit runs before the shuffle)."""
    picked = nodes.where(F.col("t").isin(list(frames))) if frames is not None else nodes
    dist = euclidean("y", "x", F.lit(float(y)), F.lit(float(x)))
    order = W.partitionBy(*FRAME).orderBy("distance", id_col)
    return (picked.withColumn("distance", dist).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def division_candidates(nodes: DataFrame, targets: DataFrame, window: float = 20.0, reach: int = 2) -> DataFrame:
    """Nodes inside a square window around a suspected division, from ``reach`` frames before to after."""
    asked = targets.select(
        "sample_id", "case_id", F.col("t").alias("case_t"), F.col("y").alias("case_y"), F.col("x").alias("case_x"),
        F.explode(F.sequence(F.col("t") - reach, F.col("t") + reach)).alias("t"))
    build = in_neighbour_cells(asked, "case_y", "case_x", window)
    probe = nodes.withColumn("cy", cell("y", window)).withColumn("cx", cell("x", window))
    return (probe.join(build, [*FRAME, "cy", "cx"])
            .where((F.abs(F.col("y") - F.col("case_y")) <= window) & (F.abs(F.col("x") - F.col("case_x")) <= window))
            .select("sample_id", "case_id", "case_t", "t", "node_id", "y", "x",
                    euclidean("y", "x", "case_y", "case_x").alias("distance")))


def hashed_number(*parts) -> Column:
    """Deterministic number below 2^48: the first 12 hex digits of the md5 of the parts, joined by `|`."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def hashed_unit(*parts) -> Column:
    """Deterministic number in [0, 1) from the given columns."""
    return hashed_number(*parts) / F.lit(float(1 << 48))


def sample_negatives(frames: DataFrame, centers: DataFrame, seed: int, apart: float = 20.0,
                     margin: int = 16, draws: int = 50) -> DataFrame:
    """A background point for each center whose crop fits the frame, each ``apart`` from every center.

    ``frames``: sample_id, t, height, width. Too few accepted draws is an error, not a short answer.
    """
    # every wanted point is a row of its own before its draws, so a crowded frame is split over tasks
    fits = ((F.col("y") >= margin) & (F.col("x") >= margin) & (F.col("y") + margin < F.col("height")) & (F.col("x") + margin < F.col("width")))
    copies = centers.join(frames.select(*FRAME, "height", "width"), FRAME).where(fits).groupBy(*FRAME, "y", "x").agg(F.count(F.lit(1)).cast("int").alias("_n")).withColumn(
        "_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    slots = copies.select(*FRAME, F.xxhash64(F.col("y"), F.col("x"), F.col("_k"), F.lit(seed)).alias("slot"))
    tries = slots.join(frames, FRAME).withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    low = F.lit(margin)
    span = lambda size: F.col(size) - 2 * margin
    points = tries.select(
        *FRAME, "slot", "try",
        (low + F.floor(hashed_unit(*FRAME, "slot", "try", F.lit(seed), F.lit("y")) * span("height"))).cast("double").alias("y"),
        (low + F.floor(hashed_unit(*FRAME, "slot", "try", F.lit(seed), F.lit("x")) * span("width"))).cast("double").alias("x"))
    # one place is drawn once: the least slot keeps it, so the answer does not depend on task order
    points = points.groupBy(*FRAME, "y", "x").agg(F.min(F.struct("slot", "try")).alias("_s")).select(
        *FRAME, "y", "x", "_s.slot", "_s.try")
    block = in_neighbour_cells(
        centers.select(*FRAME, F.col("y").alias("c_y"), F.col("x").alias("c_x")).distinct(), "c_y", "c_x", apart)
    keyed = points.withColumn("cy", cell("y", apart)).withColumn("cx", cell("x", apart))
    p, b = keyed.alias("p"), block.alias("b")
    same = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in [*FRAME, "cy", "cx"]]
    free = p.join(b, same[0] & same[1] & same[2] & same[3]
                  & (euclidean("p.y", "p.x", "b.c_y", "b.c_x") < apart), "left_anti")
    # one accepted draw per slot: bounded groups, no ranking over the whole frame
    chosen = free.groupBy(*FRAME, "slot").agg(F.min(F.struct("try", "y", "x")).alias("c"))
    checked = slots.join(chosen, [*FRAME, "slot"], "left")
    ok = F.when(F.col("c").isNotNull(), F.col("c.y")).otherwise(
        F.raise_error(F.lit("too few background points: raise draws or lower apart")).cast("double"))
    return checked.select(*FRAME, ok.alias("y"), F.col("c.x").alias("x"))
