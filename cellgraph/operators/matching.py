"""One-to-one matching of points inside a frame, and linking of consecutive frames.

Frames of ordinary size are solved one per group. A frame above ``max_pairs`` is never handed
to one task: it is cut into independent pieces first, by a rule that keeps the answer exact. Which way a frame
goes is only a matter of speed: among assignments of the same least total both take the one in which the lowest id
of the smaller side (for gated matching, of the first table) has the lowest partner it can have, then the next id, and so on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import euclidean
from ..session import Spool, cut_lineage
from .assignment import assign, nearest, pair_gated, pair_up
from .graph import components
from .spatial import FRAME, around, cell, in_neighbour_cells, near_pairs
from .tiles import first_come

MAX_PAIRS = 25_000_000  # largest frame (rows x columns) one task solves whole: seconds, linear memory
MAX_POINTS = 100_000  # largest frame by points, for frames with few on one side
BUNDLE = 20_000  # points per Python call
CROWD = 8  # points of one side in a cell, beyond which they are not told apart when a frame is cut for greedy matching
PAIR_COLUMNS = ["sample_id", "t", "a_id", "b_id", "distance"]
PAIR_SCHEMA = "sample_id string, t int, a_id bigint, b_id bigint, distance double"


def _tag(points: DataFrame, side: int, id_col: str) -> DataFrame:
    return points.select("sample_id", F.col("t").cast("int").alias("t"), F.lit(side).alias("side"),
                         F.col(id_col).cast("bigint").alias("id"), F.col("y").cast("double").alias("y"),
                         F.col("x").cast("double").alias("x"))


def _emit(key, left: pd.DataFrame, right: pd.DataFrame, i, j, limit: float | None) -> pd.DataFrame:
    p, q = left[["y", "x"]].to_numpy()[i], right[["y", "x"]].to_numpy()[j]
    d = np.sqrt(((p - q) ** 2).sum(axis=1)) if len(i) else np.empty(0)
    out = pd.DataFrame({"sample_id": key[0], "t": key[1], "a_id": left["id"].to_numpy()[i],
                        "b_id": right["id"].to_numpy()[j], "distance": d})
    return out if limit is None else out[out["distance"] <= limit]


def _split_sides(pdf: pd.DataFrame):
    pdf = pdf.sort_values(["side", "id"], kind="stable")
    return pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]


def _sizes(both: DataFrame) -> DataFrame:
    return both.groupBy(*FRAME).agg(
        F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))


def _each(keys: list[str], solve):
    """``solve(key, rows)`` for every key of a bundle."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [solve(k, g) for k, g in pdf.groupby(keys, sort=False)]
        kept = [x for x in parts if len(x)]
        return pd.concat(kept, ignore_index=True) if kept else parts[0]

    return run


def _in_bundles(points: DataFrame, keys: list[str], n_points: int, run, schema: str) -> DataFrame:
    """Run ``run(rows)`` on bundles of about BUNDLE points: small groups share a task call,
    which saves one Python round trip per group; a group never leaves its bundle."""
    spark = points.sparkSession
    cores = spark.sparkContext.defaultParallelism
    bundles = max(-(-n_points // BUNDLE), 8 * cores)
    tasks = min(bundles, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    keyed = points.withColumn("_bundle", F.pmod(F.xxhash64(*keys), F.lit(bundles)))
    # a fixed number of partitions: the rows are few, the work per row is not, so they must not be merged
    return keyed.repartition(tasks, "_bundle").groupBy("_bundle").applyInPandas(run, schema)


def _match_frames(both: DataFrame, solve, max_pairs: int, in_pieces) -> DataFrame:
    """Frames one task may hold go through ``solve``; crowded ones through ``in_pieces``.

    A frame without points on one side has no pairs and goes nowhere, however large its other side is.
    """
    sizes = cut_lineage(_sizes(both).where("na > 0 AND nb > 0"))
    points = F.col("na") + F.col("nb")
    # few points against very many make few pairs, but a frame as large as a crowded one
    crowded = (F.col("na") * F.col("nb") > F.lit(max_pairs)) | (points > F.lit(max(MAX_POINTS, 2 * math.isqrt(max_pairs))))
    n_light, n_crowded = sizes.agg(F.sum(F.when(~crowded, points)), F.count_if(crowded)).first()
    light = both.join(sizes.where(~crowded).select(*FRAME), FRAME, "left_semi")
    whole = _in_bundles(light, FRAME, n_light or 0, _each(FRAME, solve), PAIR_SCHEMA)
    if not n_crowded:
        return whole
    return whole.unionByName(
        in_pieces(both.join(sizes.where(crowded), FRAME)))


def _global_solver(limit: float):
    def solve(key, pdf):
        left, right = _split_sides(pdf)
        i, j = pair_up(left[["y", "x"]].to_numpy(), right[["y", "x"]].to_numpy())
        return _emit(key, left, right, i, j, limit)

    return solve


def _gated_solver(limit: float):
    def solve(key, pdf):
        left, right = _split_sides(pdf)
        i, j = pair_gated(left[["y", "x"]].to_numpy(), right[["y", "x"]].to_numpy(), limit)
        return _emit(key, left, right, i, j, limit)

    return solve


def match_global(a: DataFrame, b: DataFrame, max_distance: float, a_id: str = "a_id", b_id: str = "b_id",
                 max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Least total distance over the whole frame, then pairs beyond the limit are dropped."""
    both = _tag(a, 0, a_id).unionByName(_tag(b, 1, b_id))
    return _match_frames(both, _global_solver(max_distance), max_pairs, lambda big: _global_in_pieces(
        big, max(float(max_distance), 1e-9)).where(F.col("distance") <= max_distance))


def match_gated(gt: DataFrame, pred: DataFrame, d_max: float = 15.0, gt_id: str = "gt_id", pred_id: str = "pred_id",
                max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Cheapest assignment where a pair beyond ``d_max`` costs a fixed penalty and never counts.

    Cutting a frame into connected pieces of the within-``d_max`` graph leaves the answer unchanged.
    """
    both = _tag(gt, 0, gt_id).unionByName(_tag(pred, 1, pred_id))
    solve = _gated_solver(d_max)
    return _match_frames(both, solve, max_pairs, lambda big: _local_in_pieces(big, d_max, solve))


def _local_in_pieces(big: DataFrame, reach: float, solve) -> DataFrame:
    """Rules under which only points within reach interact: solve the connected pieces apart."""
    left = big.where("side = 0").select(*FRAME, F.col("id").alias("a_id"), "y", "x")
    right = big.where("side = 1").select(*FRAME, F.col("id").alias("b_id"), F.col("y").alias("gt_y"), F.col("x").alias("gt_x"))
    return _solve_apart(cut_lineage(_pieces(near_pairs(left, right, reach).select(*FRAME, "a_id", "b_id"), big)), solve)


def _loose_pieces(big: DataFrame, reach: float) -> DataFrame:
    """Points with the id of a piece; no two points within reach are in different pieces, but a piece may be several connected ones.

    Points of one side that crowd a cell are one node and meet all around them, so there are a bounded number of pairs per point at any density.
    """
    at = big.withColumn("cy", cell("y", reach)).withColumn("cx", cell("x", reach))
    crowds = at.groupBy(*FRAME, "side", "cy", "cx").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_one")).where(F.col("_n") > CROWD)
    named = cut_lineage(at.join(crowds, [*FRAME, "side", "cy", "cx"], "left").withColumn("stand", F.coalesce("_one", "id")))
    alone = F.col("_one").isNull()
    nodes = named.select(*FRAME, "side", F.col("stand").alias("node"), "cy", "cx", F.when(alone, F.col("y")).alias("y"), F.when(alone, F.col("x")).alias("x")).distinct()
    side = lambda k: nodes.where(F.col("side") == k).drop("side")
    there = side(1).withColumn("_o", around(1)).select(*FRAME, (F.col("cy") + F.col("_o.a")).alias("cy"), (F.col("cx") + F.col("_o.b")).alias("cx"),
                                                       F.col("node").alias("b_id"), F.col("y").alias("gt_y"), F.col("x").alias("gt_x"))
    # a crowd has no place, and a missing distance counts as near
    met = side(0).withColumnRenamed("node", "a_id").join(there, [*FRAME, "cy", "cx"]).where(
        F.coalesce(euclidean("y", "x", "gt_y", "gt_x") <= reach, F.lit(True)))
    return _pieces(met.select(*FRAME, "a_id", "b_id"), named.drop("cy", "cx", "_n", "_one"), "stand").drop("stand")


def _solve_apart(pieces: DataFrame, solve) -> DataFrame:
    """Pieces of one frame that share a bundle are solved in one call, since they do not interact."""
    single, rest = _lone_pairs(pieces)
    n = pieces.count()
    return single.select(*PAIR_COLUMNS).unionByName(
        _in_bundles(rest, [*FRAME, "piece"], n, _each(FRAME, solve), PAIR_SCHEMA))


def _lone_pairs(pieces: DataFrame):
    """Pieces of one point each side need no solver; the rest keep their points."""
    pick = lambda side: F.min(F.when(F.col("side") == side, F.struct("id", "y", "x")))
    per = pieces.groupBy(*FRAME, "piece").agg(
        F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"),
        pick(0).alias("p"), pick(1).alias("q"))
    lone = per.where("n0 = 1 AND n1 = 1").select(
        *FRAME, F.col("p.id").alias("a_id"), F.col("q.id").alias("b_id"),
        euclidean("p.y", "p.x", "q.y", "q.x").alias("distance"))
    rest = per.where("n0 > 0 AND n1 > 0 AND n0 + n1 > 2").select(*FRAME, "piece")
    return lone, pieces.join(rest, [*FRAME, "piece"], "left_semi")


def _name(side: str, id_col: str):
    # one bigint per point: even = side 0, odd = side 1
    return F.col(id_col) * 2 + F.lit(0 if side == "a" else 1)


def _pieces(pairs: DataFrame, points: DataFrame, name: str = "id") -> DataFrame:
    """Points with the id of their connected piece; points without any pair are their own piece."""
    frame = F.concat_ws("\u0001", "sample_id", F.col("t").cast("string"))
    edges = pairs.select(frame.alias("sample_id"), _name("a", "a_id").alias("src"), _name("b", "b_id").alias("dst"))
    labels = components(edges).withColumnRenamed("sample_id", "_f")
    named = points.withColumn("_f", frame).withColumn("node", F.col(name) * 2 + F.col("side"))
    return named.join(labels, ["_f", "node"], "left").withColumn(
        "piece", F.coalesce("component", "node")).drop("_f", "node", "component")


PIECE_SCHEMA = "sample_id string, t int, piece bigint, a_id bigint, b_id bigint, distance double, settled boolean"


def _solve_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Assign every row of every piece of a bundle; settled when each price of a piece stays within its row's radius.

    Pieces are slices of one sorted table. Those of a single row need no solver: it takes its nearest column.
    """
    code = pdf.groupby([*FRAME, "piece"], sort=False).ngroup().to_numpy()
    order = np.lexsort((pdf["id"].to_numpy(), pdf["side"].to_numpy(), code))
    pdf, code = pdf.iloc[order], code[order]
    yx, radius = pdf[["y", "x"]].to_numpy(), pdf["radius"].to_numpy()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    last = np.append(first[1:], len(code))
    middle = first + np.add.reduceat(pdf["side"].to_numpy() == 0, first)
    swap = (pdf["na"].to_numpy() > pdf["nb"].to_numpy())[first]
    left, right, settled = [], [], []
    for lo, mid, hi, turned in zip(first.tolist(), middle.tolist(), last.tolist(), swap.tolist()):
        (r0, r1), (c0, c1) = ((mid, hi), (lo, mid)) if turned else ((lo, mid), (mid, hi))
        if r1 - r0 == 1:
            col, price = nearest(yx[r0], yx[c0:c1])
            rows, cols, fine = [r0], [c0 + col], price <= radius[r0]
        else:
            col_of, price = assign(yx[r0:r1], yx[c0:c1])
            rows, cols, fine = range(r0, r1), (c0 + col_of).tolist(), bool((price <= radius[r0:r1]).all())
        left += cols if turned else rows
        right += rows if turned else cols
        settled += [fine] * len(rows)
    p, q = pdf.iloc[left], pdf.iloc[right]
    d = np.sqrt(((yx[left] - yx[right]) ** 2).sum(axis=1))
    return pd.DataFrame({"sample_id": p["sample_id"].to_numpy(), "t": p["t"].to_numpy(), "piece": p["piece"].to_numpy(), "a_id": p["id"].to_numpy(),
                         "b_id": q["id"].to_numpy(), "distance": d, "settled": np.array(settled, dtype=bool)})


def _global_in_pieces(points: DataFrame, radius: float, max_rounds: int = 40) -> DataFrame:
    """Exact global assignment of crowded frames without holding a frame in one task.

    Rows are the smaller side. Each row may reach the columns within its radius; connected
    pieces are solved apart. By linear-programming duality the union is globally optimal as soon
    as every row's price is at most its radius, because any pair outside the pieces costs more
    than the radius and column prices are never positive. Rows of a piece that fails double
    their radius, so only crowded or unbalanced neighbourhoods merge.
    """
    row_side = F.when(F.col("na") <= F.col("nb"), F.lit(0)).otherwise(F.lit(1))
    state = cut_lineage(points.withColumn("is_row", F.col("side") == row_side).withColumn(
        "lv", F.lit(0)).select(*FRAME, "side", "id", "y", "x", "na", "nb", "is_row", "lv"))
    done = Spool(points.sparkSession)
    for _ in range(max_rounds):
        levels = [r[0] for r in state.where("is_row").select("lv").distinct().collect()]  # at most one per round
        sides = F.explode(F.array(*[F.struct(F.lit(k).alias("lv"), F.lit(radius * 2.0 ** k).alias("r")) for k in levels]))
        rows = (state.where("is_row").withColumn("r", F.lit(radius) * F.pow(F.lit(2.0), F.col("lv")))
                .withColumn("cy", cell("y", F.col("r"))).withColumn("cx", cell("x", F.col("r"))).alias("p"))
        cols = (state.where("NOT is_row").select(*FRAME, "id", "y", "x").withColumn("_s", sides).withColumn("_o", around(1))
                .select(*FRAME, "id", "y", "x", F.col("_s.lv").alias("lv"),
                        (cell("y", F.col("_s.r")) + F.col("_o.a")).alias("cy"),
                        (cell("x", F.col("_s.r")) + F.col("_o.b")).alias("cx")).alias("q"))
        on = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in [*FRAME, "lv", "cy", "cx"]]
        near = on[0] & on[1] & on[2] & on[3] & on[4] & (euclidean("p.y", "p.x", "q.y", "q.x") <= F.col("p.r"))
        pairs = rows.join(cols, near).select(
            F.col("p.sample_id").alias("sample_id"), F.col("p.t").alias("t"),
            F.when(F.col("p.side") == 0, F.col("p.id")).otherwise(F.col("q.id")).alias("a_id"),
            F.when(F.col("p.side") == 0, F.col("q.id")).otherwise(F.col("p.id")).alias("b_id"))
        pieces = cut_lineage(_pieces(pairs, state))
        # a lone pair lies within the row's radius, so it is settled; rows without columns are not
        lone, _ = _lone_pairs(pieces)
        per = pieces.groupBy(*FRAME, "piece").agg(
            F.count_if("is_row").alias("nr"), F.count_if(~F.col("is_row")).alias("nc"))
        starved = per.where("nr > nc").select(*FRAME, "piece")
        open_ = per.where("nr > 0 AND nr <= nc AND nr + nc > 2").select(*FRAME, "piece")
        rest = pieces.join(open_, [*FRAME, "piece"], "left_semi")
        solved = cut_lineage(_in_bundles(
            rest.withColumn("radius", F.lit(radius) * F.pow(F.lit(2.0), F.col("lv")))
            .select(*FRAME, "piece", "side", "id", "y", "x", "na", "nb", "radius"),
            [*FRAME, "piece"], pieces.count(), _solve_pieces, PIECE_SCHEMA))
        failed = cut_lineage(solved.where("NOT settled").select(*FRAME, "piece").distinct().unionByName(starved))
        open_frames = failed.select(*FRAME).distinct()
        done.append(solved.select(*PAIR_COLUMNS).unionByName(lone.select(*PAIR_COLUMNS))
                    .join(open_frames, FRAME, "left_anti"))
        if failed.isEmpty():
            break
        grown = failed.withColumn("_grow", F.lit(1))
        state = cut_lineage(
            pieces.join(open_frames, FRAME, "left_semi").join(grown, [*FRAME, "piece"], "left")
            .withColumn("lv", F.when(F.col("is_row"), F.col("lv") + F.coalesce("_grow", F.lit(0))).otherwise(F.col("lv")))
            .select(*FRAME, "side", "id", "y", "x", "na", "nb", "is_row", "lv"))
    else:
        raise RuntimeError("global assignment did not settle: coordinates span more than 2^40 radii")
    return done.read()


def match_greedy(prev: DataFrame, curr: DataFrame, max_distance: float, a_id: str = "a_id", b_id: str = "b_id",
                 max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Earlier points, in list order, take the nearest free point within reach (ties: lower index).

    Only points within reach interact, so a crowded frame is cut into pieces that are farther apart;
    the order inside a piece is all that matters. A piece is solved in linear memory, however crowded it is.
    """
    def solve(key, pdf):
        left, right = _split_sides(pdf)
        i, j = first_come(left[["y", "x"]].to_numpy(), right[["y", "x"]].to_numpy(), max_distance)
        return _emit(key, left, right, i, j, None)

    def in_pieces(big):
        return _solve_apart(cut_lineage(_loose_pieces(big, max_distance)), solve)

    both = _tag(prev, 0, a_id).unionByName(_tag(curr, 1, b_id))
    return _match_frames(both, solve, max_pairs, in_pieces)


def match_with(prev: DataFrame, curr: DataFrame, match_fn: Callable, a_id: str = "a_id", b_id: str = "b_id") -> DataFrame:
    """User matcher: ``match_fn(prev_yx, curr_yx) -> [(i, j), ...]``, called once per frame.

    A foreign rule sees a frame whole, so one frame is one task, whatever its size.
    """
    def solve(key, pdf):
        left, right = _split_sides(pdf)
        if left.empty or right.empty:
            return _emit(key, left, right, np.empty(0, dtype=int), np.empty(0, dtype=int), None)
        got = [(m[0], m[1]) for m in match_fn(left[["y", "x"]].to_numpy(), right[["y", "x"]].to_numpy())]
        i = np.array([g[0] for g in got], dtype=int)
        j = np.array([g[1] for g in got], dtype=int)
        return _emit(key, left, right, i, j, None)

    both = _tag(prev, 0, a_id).unionByName(_tag(curr, 1, b_id))
    return _in_bundles(both, FRAME, both.count(), _each(FRAME, solve), PAIR_SCHEMA)


def attach_orphans(orphans: DataFrame, prev: DataFrame, used: DataFrame, max_distance: float = 30.0,
                   max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Unmatched points go to earlier points with room left (two children at most), least total distance.

    ``orphans``: b_id, ``prev``: a_id, ``used``: a_id rows of links already made; all keyed by frame. A point with room for two
    stands as two places with neighbouring numbers; by the rule for ties the lower one is filled first, so equal places never trade.
    """
    taken = used.groupBy(*FRAME, "a_id").agg(F.count(F.lit(1)).alias("_n"))
    room = (prev.join(taken, [*FRAME, "a_id"], "left").withColumn("_free", F.lit(2) - F.coalesce("_n", F.lit(0)))
            .where("_free > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), (F.col("_free") - 1).cast("int"))))
            .select(*FRAME, (F.col("a_id") * 2 + F.col("_k")).alias("slot"), "y", "x"))
    got = match_global(orphans, room, max_distance, a_id="b_id", b_id="slot", max_pairs=max_pairs)
    return got.select(*FRAME, F.floor(F.col("b_id") / 2).cast("bigint").alias("a_id"), F.col("a_id").alias("b_id"), "distance")


def frame_steps(det: DataFrame):
    """Both sides of every step t-1 -> t, keyed by the later frame."""
    prev = det.select("sample_id", (F.col("t") + 1).cast("int").alias("t"), F.col("idx").cast("bigint").alias("a_id"), "y", "x")
    curr = det.select("sample_id", F.col("t").cast("int").alias("t"), F.col("idx").cast("bigint").alias("b_id"), "y", "x")
    return prev, curr


def link_frames(det: DataFrame, max_distance: float = 25.0, matcher: str | Callable = "global",
                max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One-to-one links between adjacent frames: sample_id, t (later frame), prev_idx, curr_idx, distance.

    ``matcher`` is ``global``, ``greedy`` or a callable (see ``match_with``).
    """
    prev, curr = frame_steps(det)
    if matcher == "global":
        got = match_global(prev, curr, max_distance, max_pairs=max_pairs)
    elif matcher == "greedy":
        got = match_greedy(prev, curr, max_distance, max_pairs=max_pairs)
    elif callable(matcher):
        got = match_with(prev, curr, matcher)
    else:
        raise ValueError(f"unknown matcher {matcher!r}")
    return got.select("sample_id", "t", F.col("a_id").alias("prev_idx"), F.col("b_id").alias("curr_idx"), "distance")


def build_links(det: DataFrame, max_distance: float = 25.0, division_distance: float = 30.0,
                matcher: str | Callable = "global", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Links with divisions: column ``step`` is 0 for the first pass and 1 for attached orphans."""
    prev, curr = frame_steps(det)
    # both passes read the first one's result; writing it out keeps the Python work from running twice
    first = cut_lineage(link_frames(det, max_distance, matcher, max_pairs).withColumn("step", F.lit(0)))
    linked = first.select("sample_id", "t", F.col("curr_idx").alias("b_id"))
    orphans = curr.join(linked, [*FRAME, "b_id"], "left_anti")
    used = first.select("sample_id", "t", F.col("prev_idx").alias("a_id"))
    second = attach_orphans(orphans, prev, used, division_distance, max_pairs)
    return first.unionByName(second.select(
        "sample_id", "t", F.col("a_id").alias("prev_idx"), F.col("b_id").alias("curr_idx"), "distance",
        F.lit(1).alias("step")))
