"""Point searches inside square tiles of a frame: what one task does for the distance joins.

Joining every candidate with every point near it makes rows with the square of the density. Here a tile's candidates and
points meet in one task as arrays, each point also in the tiles it borders on, and a grid that follows the number of points keeps
the pairs per candidate few at any density. Counts in boxes come from a wavelet matrix, without pairs. Several tiles share a call.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

FRAME = ["sample_id", "t"]
PAIRS_AT_ONCE = 1 << 20  # pairs or ranges that exist at a time
PER_CELL = 2  # points in a cell of a grid, on average
SURE = 1.0 - 1e-9  # of a bound that rounding may touch


def finite(*names: str) -> Column:
    """Whether frame and coordinates are all there; others meet no point."""
    fine = F.lit(True)
    for c in FRAME:
        fine = fine & F.col(c).isNotNull()
    for c in names:
        fine = fine & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return fine


def solve_tiles(places: DataFrame, points: DataFrame, side: float, halo: float, solve: Callable, out: str) -> DataFrame:
    """``solve(places, points)`` on arrow tables of every tile that holds places; points (gt_y, gt_x, gt_id, w) within ``halo`` of a tile are in it.

    Places without a frame or a finite coordinate meet no point. ``out``: the columns after frame, y and x.
    """
    at = lambda c: F.floor(c / side).cast("bigint")
    kinds = dict(places.dtypes)
    probe = places.select(*FRAME, at(F.col("y")).alias("ty"), at(F.col("x")).alias("tx"), "y", "x", F.lit(None).cast(dict(points.dtypes)["gt_id"]).alias("gt_id"),
                          F.lit(None).cast("bigint").alias("w"), finite("y", "x").alias("ok"))
    # a little more than the halo: a distance that is rounded down to it counts as within
    reach = lambda c: F.lit(halo * (1 + 1e-9)) + F.abs(F.col(c)) * F.lit(1e-12)
    spread = lambda c: F.explode(F.sequence(at(F.col(c) - reach(c)), at(F.col(c) + reach(c))))
    build = points.where(finite("gt_y", "gt_x")).withColumn("ty", spread("gt_y")).withColumn("tx", spread("gt_x")).select(
        *[F.col(c).cast(kinds[c]).alias(c) for c in FRAME], "ty", "tx", F.col("gt_y").alias("y"), F.col("gt_x").alias("x"), "gt_id", "w", F.lit(True).alias("ok"))
    spark = places.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4 * spark.sparkContext.defaultParallelism)
    both = probe.unionByName(build).withColumn("_bundle", F.pmod(F.xxhash64(*FRAME, "ty", "tx"), F.lit(16 * tasks)))

    def run(table: pa.Table) -> pa.Table:
        ok, point = table.column("ok").to_numpy(), table.column("w").is_valid().to_numpy()
        parts = [solve(table.take(np.flatnonzero(~ok)), table.slice(0, 0))]
        code = [pc.dictionary_encode(table.column(c).combine_chunks()).indices.fill_null(-1).to_numpy() for c in (*FRAME, "ty", "tx")]
        order = np.lexsort(code)
        order = order[ok[order]]
        turns = np.zeros(len(order), dtype=bool)
        for c in code:
            turns |= np.diff(c[order], prepend=-1) != 0
        first = np.flatnonzero(turns)
        for lo, hi in zip(first, np.append(first[1:], len(order))):
            rows = order[lo:hi]
            mine, near = rows[~point[rows]], rows[point[rows]]
            if len(mine):
                parts.append(solve(table.take(mine), table.take(near)))
        return pa.concat_tables(parts)

    # a fixed number of partitions: the rows are few, the work per row is not, so they must not be merged
    return both.repartition(tasks, "_bundle").groupBy("_bundle").applyInArrow(
        run, f"sample_id {kinds['sample_id']}, t {kinds['t']}, y double, x double, {out}")


def coordinates(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("y").to_numpy(), table.column("x").to_numpy()


def told(places: pa.Table, **columns) -> pa.Table:
    """The answers beside frame, y and x of their places; numbers that are not finite are missing."""
    said = {k: pa.array(v, mask=~np.isfinite(v)) if isinstance(v, np.ndarray) else v for k, v in columns.items()}
    return pa.table({c: places.column(c) for c in (*FRAME, "y", "x")} | said)


def ranks(ids: pa.ChunkedArray) -> np.ndarray:
    """Place of every id in their order, missing ones first."""
    out = np.empty(len(ids), np.int64)
    out[pc.array_sort_indices(ids.combine_chunks(), order="ascending", null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return out


class Grid:
    """Points by cells of a size that holds about PER_CELL of them; a run of cells in a row is a run of points."""

    def __init__(self, y: np.ndarray, x: np.ndarray):
        self.y0, self.x0 = y.min(), x.min()
        high, wide = y.max() - self.y0, x.max() - self.x0
        self.side = max(np.sqrt(high * wide * PER_CELL / len(y)), max(high, wide) * PER_CELL / len(y), 1e-9)
        self.rows, self.cols = int(high / self.side) + 1, int(wide / self.side) + 1
        row, col = self.cell(y, x)
        cell = np.clip(row, 0, self.rows - 1) * self.cols + np.clip(col, 0, self.cols - 1)
        self.order = np.argsort(cell, kind="stable")
        self.y, self.x = y[self.order], x[self.order]
        self.start = np.searchsorted(cell[self.order], np.arange(self.rows * self.cols + 1))

    def cell(self, y, x):
        return np.floor((y - self.y0) / self.side).astype(np.int64), np.floor((x - self.x0) / self.side).astype(np.int64)

    def blocks(self, qy: np.ndarray, qx: np.ndarray, reach: int):
        """(queries, points, first pair of each query) for the points in the (2 * reach + 1)^2 cells around every query, some queries at a time.

        Queries without a point in their block do not come; points are places in ``self.y``.
        """
        step = max(1, PAIRS_AT_ONCE // min(2 * reach + 1, self.rows))
        for k in range(0, len(qy), step):
            row, col = self.cell(qy[k:k + step], qx[k:k + step])
            bottom, top = np.clip(row - reach, 0, self.rows), np.clip(row + reach + 1, 0, self.rows)
            left, right = np.clip(col - reach, 0, self.cols), np.clip(col + reach + 1, 0, self.cols)
            q, at = _runs(bottom, np.where(right > left, top, bottom))
            lo, hi = self.start[at * self.cols + left[q]], self.start[at * self.cols + right[q]]
            some = hi > lo
            q, lo, hi = q[some], lo[some], hi[some]
            new = np.flatnonzero(np.diff(q, prepend=-1))
            if not len(new):
                continue
            ends = np.cumsum(np.add.reduceat(hi - lo, new))
            cuts = np.searchsorted(ends, np.arange(PAIRS_AT_ONCE, ends[-1], PAIRS_AT_ONCE), "left")
            edges = np.unique(np.concatenate([[0], cuts, [len(new)]]))
            for a, b in zip(edges[:-1], edges[1:]):
                s = slice(new[a], new[b] if b < len(new) else len(q))
                run, p = _runs(lo[s], hi[s])
                owner = q[s][run]
                yield k + owner, p, np.flatnonzero(np.diff(owner, prepend=-1))


    def descend(self, qy: np.ndarray, qx: np.ndarray, reach: float, second: bool):
        """As ``blocks``, for the points that may be the nearest (with second: or the one after) of a query and at most ``reach`` away.

        From one cell that holds all, cells are halved both ways; those whose points are all farther than some cell's farthest corner are left out.
        So the cells per query stay few, however dense the points and however far the query.
        """
        levels = self._levels()
        todo = [np.arange(k, min(k + PAIRS_AT_ONCE // 64 + 1, len(qy))) for k in range(0, len(qy), PAIRS_AT_ONCE // 64 + 1)]
        while todo:
            own = todo.pop()
            q, row, col = own, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for k, (bottom, top, left, right, n) in enumerate(levels):
                if k:  # the four parts of every cell
                    q, row, col = np.repeat(q, 4), np.repeat(2 * row, 4) + np.tile([0, 0, 1, 1], len(row)), np.repeat(2 * col, 4) + np.tile([0, 1, 0, 1], len(col))
                    there = (row < n.shape[0]) & (col < n.shape[1])
                    q, row, col = q[there], row[there], col[there]
                some = n[row, col] > 0
                q, row, col = q[some], row[some], col[some]
                if not len(q):
                    break
                y, x, a, b, c, d = qy[q], qx[q], bottom[row, col], top[row, col], left[row, col], right[row, col]
                dy, dx = np.maximum(np.maximum(a - y, y - b), 0), np.maximum(np.maximum(c - x, x - d), 0)
                ey, ex = np.maximum(np.abs(y - a), np.abs(y - b)), np.maximum(np.abs(x - c), np.abs(x - d))
                near, far = np.sqrt(dy * dy + dx * dx), np.sqrt(ey * ey + ex * ex)
                first = np.flatnonzero(np.diff(q, prepend=-1))
                length = np.diff(np.append(first, len(q)))
                bound, pick = _best(far, np.arange(len(q)), first, length)
                if second:
                    lone = n[row, col][pick] < 2
                    far[pick] = np.inf
                    bound = np.where(lone, np.minimum.reduceat(far, first), bound)
                keep = near * SURE <= np.repeat(np.minimum(bound, reach), length)
                q, row, col = q[keep], row[keep], col[keep]
                if len(q) > PAIRS_AT_ONCE and len(own) > 1:
                    todo += np.array_split(own, 2)
                    break
            else:
                cell = row * self.cols + col
                run, p = _runs(self.start[cell], self.start[cell + 1])
                if len(run):
                    owner = q[run]
                    yield owner, p, np.flatnonzero(np.diff(owner, prepend=-1))

    def within(self, w: np.ndarray, qy: np.ndarray, qx: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Weights of the points at most each of the ascending radii away (queries x radii).

        Cells are halved as in ``descend`` as long as a radius cuts them: what lies whole between two radii is added whole. The nearest and farthest place of a cell are
        rounded as distances are, so no point of it is told wrongly.
        """
        weight = np.append(0, np.cumsum(w[self.order]))
        levels = self._levels(np.diff(weight[self.start]))
        out = np.zeros((len(qy), len(radii) + 1), np.int64)
        todo = [np.arange(k, min(k + PAIRS_AT_ONCE // 64 + 1, len(qy))) for k in range(0, len(qy), PAIRS_AT_ONCE // 64 + 1)]
        while todo:
            own = todo.pop()
            q, row, col = own - own[0], np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            add = np.zeros(len(own) * (len(radii) + 1))
            for k, (bottom, top, left, right, n) in enumerate(levels):
                if k:
                    q, row, col = np.repeat(q, 4), np.repeat(2 * row, 4) + np.tile([0, 0, 1, 1], len(row)), np.repeat(2 * col, 4) + np.tile([0, 1, 0, 1], len(col))
                    there = (row < n.shape[0]) & (col < n.shape[1])
                    q, row, col = q[there], row[there], col[there]
                y, x, a, b, c, d = qy[own[q]], qx[own[q]], bottom[row, col], top[row, col], left[row, col], right[row, col]
                some = a <= b
                q, row, col, y, x, a, b, c, d = (v[some] for v in (q, row, col, y, x, a, b, c, d))
                dy, dx = np.maximum(np.maximum(a - y, y - b), 0), np.maximum(np.maximum(c - x, x - d), 0)
                ey, ex = np.maximum(np.abs(y - a), np.abs(y - b)), np.maximum(np.abs(x - c), np.abs(x - d))
                near, far = (np.searchsorted(radii, np.sqrt(u * u + v * v), "left") for u, v in ((dy, dx), (ey, ex)))
                whole = near == far
                add += np.bincount(q[whole] * (len(radii) + 1) + far[whole], n[row[whole], col[whole]], len(add))
                q, row, col = q[~whole], row[~whole], col[~whole]
                if len(q) > PAIRS_AT_ONCE and len(own) > 1:
                    todo += np.array_split(own, 2)
                    break
            else:
                cell = row * self.cols + col
                run, p = _runs(self.start[cell], self.start[cell + 1])
                mine = q[run]
                dy, dx = qy[own[mine]] - self.y[p], qx[own[mine]] - self.x[p]
                at = np.searchsorted(radii, np.sqrt(dy * dy + dx * dx), "left")
                add += np.bincount(mine * (len(radii) + 1) + at, w[self.order[p]], len(add))
                out[own] = add.reshape(len(own), -1)
        return np.cumsum(out, axis=1)[:, :-1]

    def _levels(self, weight: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
        """Limits of the points and their number (or weight) in every cell, from one cell for all down to the grid's."""
        n = np.diff(self.start)
        held = np.flatnonzero(n)
        limits = []
        for v in (self.y, self.x):
            for take, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
                full = np.full(len(n), none)
                full[held] = take.reduceat(v, self.start[held])
                limits.append(full.reshape(self.rows, self.cols))
        out = [(*limits, (n if weight is None else weight).reshape(self.rows, self.cols))]
        takes = ((np.minimum, np.inf), (np.maximum, -np.inf), (np.minimum, np.inf), (np.maximum, -np.inf), (np.add, 0))
        while out[-1][0].size > 1:
            halved = []
            for full, (take, none) in zip(out[-1], takes):
                full = np.pad(full, [(0, k % 2) for k in full.shape], constant_values=none)
                halved.append(take(take(full[::2, ::2], full[1::2, ::2]), take(full[::2, 1::2], full[1::2, 1::2])))
            out.append(tuple(halved))
        return out[::-1]


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all ranges [lo, hi), each with the number of its range."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) + np.repeat(lo - (np.cumsum(n) - n), n)


def _best(d: np.ndarray, rank: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every query, the least distance and the pair that has it with the lowest rank."""
    low = np.minimum.reduceat(d, first)
    tied = np.where(d == np.repeat(low, n), rank, np.iinfo(np.int64).max)
    at = np.flatnonzero(tied == np.repeat(np.minimum.reduceat(tied, first), n))
    # a rank stands once among the pairs of a query; where all are infinitely far any pair will do
    return low, at[np.searchsorted(at, first)]


def nearest(y, x, ids: np.ndarray, qy, qx, reach: float, second: bool = False):
    """Nearest point of every query by (distance, id), and the distance of the second nearest if asked for.

    Answers are exact for points up to ``reach`` away; farther ones may be found or not. Returns distances, points (-1: none), second distances.
    """
    one, at, two = np.full(len(qy), np.inf), np.full(len(qy), -1), np.full(len(qy), np.inf)
    if not len(y):
        return one, at, two
    grid = Grid(y, x)
    rank = ids[grid.order]

    def look(who: np.ndarray, p: np.ndarray, first: np.ndarray) -> None:
        dy, dx = qy[who] - grid.y[p], qx[who] - grid.x[p]
        d = np.sqrt(dy * dy + dx * dx)
        low, pick = _best(d, rank[p], first, np.diff(np.append(first, len(d))))
        mine = who[first]
        one[mine], at[mine] = low, grid.order[p[pick]]
        if second:
            d[pick] = np.inf
            two[mine] = np.minimum.reduceat(d, first)

    for q, p, first in grid.blocks(qy, qx, 1):
        look(q, p, first)
    left = np.flatnonzero((two if second else one) > grid.side * SURE)
    for q, p, first in grid.descend(qy[left], qx[left], reach, second):
        look(left[q], p, first)
    return one, at, two


def box_sums(y, x, w, qy, qx, half: float) -> np.ndarray:
    """Weights of the points in the half-open box around every query: a wavelet matrix over x in the order of y."""
    order = np.argsort(y, kind="stable")
    ys, marks = y[order], np.unique(x)
    value, weight = np.searchsorted(marks, x[order]), w[order]
    lo, hi = np.searchsorted(ys, qy - half, "left"), np.searchsorted(ys, qy + half, "left")
    low, high = np.searchsorted(marks, qx - half, "left"), np.searchsorted(marks, qx + half, "left")
    total = np.zeros(len(qy), np.int64)
    ends = [[lo, hi, high, 1], [lo, hi, low, -1]]
    for bit in reversed(range(len(marks).bit_length())):
        zero = (value >> bit) & 1 == 0
        count, sums = np.append(0, np.cumsum(zero)), np.append(0, np.cumsum(np.where(zero, weight, 0)))
        for e in ends:
            a, b, limit, sign = e
            up = (limit >> bit) & 1 == 1
            total += sign * np.where(up, sums[b] - sums[a], 0)
            e[0], e[1] = (np.where(up, count[-1] + v - count[v], count[v]) for v in (a, b))
        turn = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        value, weight = value[turn], weight[turn]
    return total


def nearest_in_boxes(y, x, ids: np.ndarray, w, qy, qx, half: float):
    """Of the points in the half-open box of every query: weights, nearest distance and point (-1: none), second distance (copies count)."""
    total = box_sums(y, x, w, qy, qx, half)
    one, at, two = nearest(y, x, ids, qy, qx, half, second=True)
    # a point nearer than the box's sides is in it; with others found, the box itself is searched
    unsure = (total > 0) & ~(two < half * SURE - 1e-9 * (np.abs(qy) + np.abs(qx)))
    one[total == 0], at[total == 0], two[total == 0] = np.inf, -1, np.inf
    left = np.flatnonzero(unsure)
    if len(left):
        grid = Grid(y, x)
        for q, p, first in grid.blocks(qy[left], qx[left], int(half / grid.side) + 2):
            who = left[q]
            gy, gx, cy, cx = grid.y[p], grid.x[p], qy[who], qx[who]
            inside = (gy >= cy - half) & (gy < cy + half) & (gx >= cx - half) & (gx < cx + half)
            dy, dx = cy - gy, cx - gx
            d = np.where(inside, np.sqrt(dy * dy + dx * dx), np.inf)
            low, pick = _best(d, ids[grid.order][p], first, np.diff(np.append(first, len(d))))
            mine = who[first]
            one[mine], at[mine] = low, grid.order[p[pick]]
            d[pick] = np.inf
            two[mine] = np.minimum.reduceat(d, first)
    copies = (at >= 0) & (w[at] > 1) if len(w) else np.zeros(len(qy), bool)
    return total, one, at, np.where(copies, one, two)


def first_come(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` in turn take the nearest row of ``b`` that is still free and at most ``reach`` away (ties: the lower one).

    A grid holds the free ones and is laid anew whenever half of them are gone, so searches stay short and memory linear.
    """
    i, j = [], []
    free = np.flatnonzero(np.isfinite(b).all(axis=1))
    grid = open_ = None
    gone = 0
    for k in np.flatnonzero(np.isfinite(a).all(axis=1)).tolist():
        if grid is None or 2 * gone > len(free):
            free = free if grid is None else free[open_]
            if not len(free):
                break
            grid, gone = Grid(b[free, 0], b[free, 1]), 0
            taken, open_ = np.zeros(len(free)), np.ones(len(free), dtype=bool)
            start = grid.start.tolist()
        y, x = a[k, 0], a[k, 1]
        row, col, m = int((y - grid.y0) // grid.side), int((x - grid.x0) // grid.side), 1
        while True:
            left, right = max(col - m, 0), min(col + m + 1, grid.cols)
            spans = [(start[r * grid.cols + left], start[r * grid.cols + right]) for r in range(max(row - m, 0), min(row + m + 1, grid.rows))] if left < right else []
            spans = [s for s in spans if s[0] < s[1]]
            low = np.inf
            if spans:
                near = np.concatenate([np.arange(*s) for s in spans])
                dy, dx = y - grid.y[near], x - grid.x[near]
                d = np.sqrt(dy * dy + dx * dx) + taken[near]
                low = d.min()
            if low <= m * grid.side * SURE or m * grid.side * SURE >= reach:
                break
            m *= 2
        if low <= reach:
            same = near[d == low]
            at = int(same[grid.order[same].argmin()])
            taken[at], open_[grid.order[at]] = np.inf, False
            gone += 1
            i.append(k)
            j.append(int(free[grid.order[at]]))
    return np.array(i, dtype=int), np.array(j, dtype=int)
