"""Matching against brute force over all permutations, and against its own whole-frame answer."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgraph.operators import audits, lineage, matching
from cellgraph.operators.assignment import pair_gated, pair_up


def brute(a, b, cap=None):
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    cost = lambda p, q: (d if cap is None or (d := math.dist(p, q)) <= cap else 1e6) if cap is not None else math.dist(p, q)
    return min((sum(cost(p, large[j]) for p, j in zip(small, pick)) for pick in itertools.permutations(range(len(large)), len(small))), default=0.0)


def points(rng, n, size=40):
    return [(rng.uniform(0, size), rng.uniform(0, size)) for _ in range(n)]


def test_kernel_is_optimal():
    rng = random.Random(1)
    for _ in range(300):
        a, b = points(rng, rng.randint(1, 6)), points(rng, rng.randint(1, 6))
        small = min(len(a), len(b))
        for cap in (None, 12.0):
            i, j = pair_up(np.array(a), np.array(b)) if cap is None else pair_gated(np.array(a), np.array(b), cap)
            assert len(set(i)) == len(set(j)) == (small if cap is None else len(i))
            away = [math.dist(a[x], b[y]) for x, y in zip(i, j)]
            assert cap is None or all(d <= cap for d in away)
            assert sum(away) + 1e6 * (small - len(i)) == pytest.approx(brute(a, b, cap))


def least_in_order(a, b, cap=None):
    """All assignments tried: least total, then the first row's lowest column, then the second's, and so on."""
    swap = cap is None and len(a) > len(b)
    rows, cols = (b, a) if swap else (a, b)
    best = None

    def go(k, used, pick, cost):
        nonlocal best
        if k == len(rows):
            key = (round(cost, 7), tuple(pick))
            best = key if best is None or key < best else best
            return
        for j in range(len(cols)):
            d = math.dist(rows[k], cols[j])
            if j not in used and (cap is None or d <= cap):
                go(k + 1, used | {j}, [*pick, j], cost + d)
        if cap is not None:
            go(k + 1, used, [*pick, len(cols)], cost + 1e6)

    go(0, frozenset(), [], 0.0)
    return sorted((j, i) if swap else (i, j) for i, j in enumerate(best[1]) if j < len(cols))


def test_ties_go_to_the_lowest_column_of_the_first_row():
    rng = random.Random(2)
    for _ in range(250):
        size = rng.choice([2, 3, 4])
        a, b = ([(float(rng.randrange(size)), float(rng.randrange(size))) for _ in range(rng.randint(1, 5))] for _ in range(2))
        got = pair_up(np.array(a), np.array(b))
        assert sorted(zip(*map(list, got))) == least_in_order(a, b)
        for cap in (0.5, 1.0, 1.5, 2.5):
            got = pair_gated(np.array(a), np.array(b), cap)
            assert sorted(zip(*map(list, got))) == least_in_order(a, b, cap)


def tied_frames(spark):
    """Full, thinned and small grids: every assignment has many equals."""
    rng = random.Random(13)
    a, b = [], []
    for t, (side, keep) in enumerate([(12, 1.0), (12, 0.8), (9, 0.5), (3, 1.0), (7, 0.9)]):
        for rows in (a, b):
            places = [(float(y), float(x)) for y in range(side) for x in range(side) if rng.random() < keep]
            rng.shuffle(places)
            rows += [("s", t, k, *p) for k, p in enumerate(places)]
    make = lambda rows, name: spark.createDataFrame(rows, f"sample_id string, t int, {name} bigint, y double, x double")
    return make(a, "a_id"), make(b, "b_id")


def test_frames_of_any_size_take_the_same_pairs(spark):
    a, b = tied_frames(spark)
    rules = {"global": lambda n: matching.match_global(a, b, 30.0, max_pairs=n), "gated": lambda n: matching.match_gated(a, b, 1.5, "a_id", "b_id", max_pairs=n),
             "greedy": lambda n: matching.match_greedy(a, b, 1.5, max_pairs=n)}
    for name, rule in rules.items():
        whole, cut = ({(r.t, r.a_id, r.b_id) for r in rule(n).collect()} for n in (10 ** 12, 0))
        assert whole == cut and whole, name


def test_orphans_against_all_ways_to_fill_the_room(spark):
    rng = random.Random(21)
    orphans, prev, used = [], [], []
    for t in range(30):
        grid = t % 2 == 0  # ties on every other frame
        place = (lambda: (float(rng.randrange(3)), float(rng.randrange(3)))) if grid else (lambda: (rng.uniform(0, 9), rng.uniform(0, 9)))
        orphans += [("s", t, k, *place()) for k in range(rng.randint(0, 4))]
        for k in range(rng.randint(0, 3)):
            prev.append(("s", t, k, *place()))
            used += [("s", t, k)] * rng.randint(0, 3)
    frame = "sample_id string, t int, {} bigint, y double, x double"
    dfs = spark.createDataFrame(orphans, frame.format("b_id")), spark.createDataFrame(prev, frame.format("a_id")), spark.createDataFrame(used, "sample_id string, t int, a_id bigint")
    for n in (matching.MAX_PAIRS, 0):
        got = matching.attach_orphans(*dfs, 1e9, max_pairs=n).collect()
        for t in range(30):
            os, ps = [r[3:] for r in orphans if r[1] == t], [r[3:] for r in prev if r[1] == t]
            rooms = [k for k in range(len(ps)) for _ in range(max(0, 2 - sum(u[1] == t and u[2] == k for u in used)))]
            want = {(rooms[j], i) for i, j in least_in_order(os, [ps[k] for k in rooms])} if os and rooms else set()
            assert {(r.a_id, r.b_id) for r in got if r.t == t} == want, (t, n)


def test_sweep_counts_samples_in_which_a_setting_finds_nothing(spark):
    gt = spark.createDataFrame([("a", 0, 1, 0.0, 0.0), ("b", 0, 1, 0.0, 0.0), ("b\u0001x", 0, 1, 5.0, 0.0)], "sample_id string, t int, gt_id bigint, y double, x double")
    det = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, "p1"), ("b", 0, 1, 0.0, 1.0, "p1"), ("a", 0, 1, 0.0, 0.0, "p2"), ("b\u0001x", 0, 1, 5.0, 0.0, None)],
                                "sample_id string, t int, idx bigint, y double, x double, setting string")
    got = {r.setting: (r.n_gt, r.matches, r.recall, r.mean_detections) for r in audits.parameter_sweep(det, gt, ["setting"]).collect()}
    assert got == {"p1": (3, 2, pytest.approx(2 / 3), pytest.approx(2 / 3)), "p2": (3, 1, pytest.approx(1 / 3), pytest.approx(1 / 3)), None: (3, 1, pytest.approx(1 / 3), pytest.approx(1 / 3))}


def test_kernel_larger_frames_agree_with_row_by_row_costs(monkeypatch):
    from cellgraph.operators import assignment

    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 100, (120, 2)), rng.uniform(0, 100, (150, 2))
    total = lambda: np.sqrt(((a[(ij := pair_up(a, b))[0]] - b[ij[1]]) ** 2).sum(1)).sum()
    kept = total()
    monkeypatch.setattr(assignment, "HELD_CELLS", 0)
    assert total() == pytest.approx(kept)


def frames(spark, rng, n_frames, size=60, most=7):
    a, b = [], []
    for t in range(n_frames):
        for side, rows in ((a, rng.randint(0, most)), (b, rng.randint(0, most))):
            side += [("s", t, k, *p) for k, p in enumerate(points(rng, rows, size))]
    make = lambda rows, name: spark.createDataFrame(rows, f"sample_id string, t int, {name} bigint, y double, x double")
    return a, b, make(a, "a_id"), make(b, "b_id")


def by_frame(rows, t):
    return [(r[3], r[4]) for r in rows if r[1] == t]


@pytest.mark.parametrize("max_pairs", [matching.MAX_PAIRS, 0])
def test_global_then_cut(spark, max_pairs):
    a, b, da, db = frames(spark, random.Random(5), 25)
    got = matching.match_global(da, db, 1e9, max_pairs=max_pairs).toPandas()
    for t in range(25):
        pa, pb = by_frame(a, t), by_frame(b, t)
        mine = got[got.t == t]
        assert len(mine) == min(len(pa), len(pb))
        assert mine.distance.sum() == pytest.approx(brute(pa, pb) if pa and pb else 0.0)


def test_crowded_path_grows_until_certified(spark):
    """A tiny starting radius must still reach the global optimum, also with unequal sides."""
    a, b, da, db = frames(spark, random.Random(8), 12)
    whole = matching.match_global(da, db, 12.0).toPandas().sort_values(["t", "a_id"])
    cut = matching.match_global(da, db, 12.0, max_pairs=0).toPandas().sort_values(["t", "a_id"])
    assert whole[["t", "a_id", "b_id"]].values.tolist() == cut[["t", "a_id", "b_id"]].values.tolist()


@pytest.mark.parametrize("max_pairs", [matching.MAX_PAIRS, 0])
def test_gated_against_brute_force(spark, max_pairs):
    a, b, da, db = frames(spark, random.Random(6), 25)
    got = matching.match_gated(da, db, 15.0, "a_id", "b_id", max_pairs=max_pairs).toPandas()
    for t in range(25):
        pa, pb = by_frame(a, t), by_frame(b, t)
        mine = got[got.t == t]
        small = min(len(pa), len(pb))
        want = brute(pa, pb, 15.0) if pa and pb else 0.0
        assert mine.distance.sum() + 1e6 * (small - len(mine)) == pytest.approx(want)
        assert (mine.distance <= 15.0).all()


def test_gated_and_global_differ(spark):
    mk = lambda ys, name: spark.createDataFrame([("s", 0, k, float(y), 0.0) for k, y in enumerate(ys)], f"sample_id string, t int, {name} bigint, y double, x double")
    gt, pred = mk([0, 10], "a_id"), mk([9, 100], "b_id")
    for limit in (matching.MAX_PAIRS, 0):
        assert matching.match_global(gt, pred, 5.0, max_pairs=limit).count() == 0
        assert matching.match_gated(gt, pred, 5.0, "a_id", "b_id", max_pairs=limit).count() == 1


@pytest.mark.parametrize("max_pairs", [matching.MAX_PAIRS, 0])
def test_greedy_takes_points_in_order(spark, max_pairs):
    a, b, da, db = frames(spark, random.Random(7), 20)
    got = {(r.t, r.a_id): r.b_id for r in matching.match_greedy(da, db, 15.0, max_pairs=max_pairs).collect()}
    want = {}
    for t in range(20):
        pa, pb, used = by_frame(a, t), by_frame(b, t), set()
        for i, p in enumerate(pa):
            near = sorted((math.dist(p, q), j) for j, q in enumerate(pb) if j not in used and math.dist(p, q) <= 15.0)
            if near:
                want[(t, i)] = near[0][1]
                used.add(near[0][1])
    assert got == want


def detections(spark, frames_):
    rows = [("s", t, k, float(y), float(x)) for t, f in enumerate(frames_) for k, (y, x) in enumerate(f)]
    return spark.createDataFrame(rows, "sample_id string, t int, idx int, y double, x double")


def lineage_of(spark, frames_, link=5.0, division=20.0, **kw):
    det = detections(spark, frames_)
    nodes = lineage.build_lineage(det, matching.build_links(det, link, division, **kw))
    return nodes, nodes.toPandas().sort_values("node_id")


def test_one_cell_keeps_one_track(spark):
    _, n = lineage_of(spark, [[(0, 0)], [(1, 1)], [(2, 2)]])
    assert n.track_id.tolist() == [1, 1, 1] and n.node_id.tolist() == [0, 1, 2]


@pytest.mark.parametrize("max_pairs", [matching.MAX_PAIRS, 0])
def test_division_starts_two_tracks(spark, max_pairs):
    nodes, n = lineage_of(spark, [[(0, 0)], [(1, 1)], [(2, 2), (12, 12)]], max_pairs=max_pairs)
    assert n.track_id.tolist() == [1, 1, 2, 3]
    d = lineage.divisions(nodes).collect()
    assert len(d) == 1 and d[0].t == 2 and d[0].children_track_ids == [2, 3] and d[0].parent_track_id == 1
    ends = {r.track_id: (r.start_t, r.end_t, r.parent_track_id) for r in lineage.tracks_of(nodes).collect()}
    assert ends == {1: (0, 1, None), 2: (2, 2, 1), 3: (2, 2, 1)}


def test_both_children_beyond_the_link_limit(spark):
    nodes, _ = lineage_of(spark, [[(0, 0)], [(10, 0), (0, 10)]])
    assert lineage.divisions(nodes).count() == 1


def test_empty_frame_breaks_tracks_and_never_three_children(spark):
    nodes, n = lineage_of(spark, [[(0, 0)], [], [(0, 0)], [(1, 0), (0, 1), (1, 1)]], link=5, division=20)
    assert n[n.t == 2].parent_node_id.isna().all()
    kids = n[n.t == 3].parent_node_id.dropna().value_counts()
    assert (kids <= 2).all() and n.track_id.min() == 1


def reference_numbers(frames_, links):
    """Numbering rule stated directly: walk the frames, number linked points by parent position, then new ones."""
    node, track = {}, {}
    next_node, next_track = 0, 1
    for t, f in enumerate(frames_):
        kids = {}
        for (lt, prev, curr, step) in sorted(links, key=lambda r: (r[0], r[1], r[3], r[2])):
            if lt == t:
                kids.setdefault(prev, []).append(curr)
        seen = set()
        for prev in sorted(kids):
            for c in kids[prev]:
                node[(t, c)] = next_node
                next_node += 1
                if len(kids[prev]) == 1:
                    track[(t, c)] = track[(t - 1, prev)]
                else:
                    track[(t, c)] = next_track
                    next_track += 1
                seen.add(c)
        for c in range(len(f)):
            if c not in seen:
                node[(t, c)], track[(t, c)] = next_node, next_track
                next_node, next_track = next_node + 1, next_track + 1
    return node, track


def test_numbers_match_a_frame_walk(spark):
    rng = random.Random(11)
    frames_ = [points(rng, rng.randint(0, 9), 30) for _ in range(9)]
    det = detections(spark, frames_)
    links = matching.build_links(det, 8.0, 12.0)
    rows = [(r.t, r.prev_idx, r.curr_idx, r.step) for r in links.collect()]
    node, track = reference_numbers(frames_, rows)
    ids = {(r.t, r.idx): r.node_id for r in lineage.canonical_ids(det, links).collect()}
    assert ids == node
    place = {v: k for k, v in node.items()}
    assert {place[r.node_id]: r.track_id for r in lineage.build_lineage(det, links).collect()} == track


def test_same_answer_for_any_partition_count(spark):
    rng = random.Random(12)
    frames_ = [points(rng, 6, 30) for _ in range(5)]
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(lineage_of(spark, frames_)[1].values.tolist())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert str(seen[0]) == str(seen[1]) == str(seen[2])


def test_user_matcher_sees_frames_of_any_size(spark):
    det = detections(spark, [[(0, 0), (1, 1)], [(0, 0), (1, 1)]])
    got = matching.link_frames(det, matcher=lambda p, c: [(0, 1)], max_pairs=1).collect()
    assert [(r.prev_idx, r.curr_idx) for r in got] == [(0, 1)]


def test_greedy_pieces_of_crowded_and_sparse_points_equal_the_whole_frame(spark, monkeypatch):
    r = random.Random(8)
    # a crowd, a thin cloud, points far apart, and copies at one place
    spots = [(r.uniform(0, 12), r.uniform(0, 12)) for _ in range(150)] + [(r.uniform(50, 90), r.uniform(0, 90)) for _ in range(60)] + [(200.0 + 40 * k, 0.0) for k in range(20)]
    spots += [(300.0, 300.0)] * 12
    rows = lambda name, move: spark.createDataFrame([("s", t, i, y + move * r.uniform(-3, 3), x) for t in (0, 1) for i, (y, x) in enumerate(
        r.sample(spots, len(spots)))], f"sample_id string, t int, {name} bigint, y double, x double")
    a, b = rows("a_id", 0).cache(), rows("b_id", 1).cache()
    told = lambda df: sorted(tuple(x)[:4] for x in df.collect())
    # pairs are no longer made as rows
    monkeypatch.setattr(matching, "near_pairs", None)
    whole = told(matching.match_greedy(a, b, 4.0))
    assert told(matching.match_greedy(a, b, 4.0, max_pairs=0)) == whole and len(whole) > 300
    for t in (0, 1):
        points = lambda df, name: sorted((x[name], x["y"], x["x"]) for x in df.where(F.col("t") == t).collect())
        free, expected = points(b, "b_id"), []
        for i, y, x in points(a, "a_id"):
            near = min(((math.sqrt((y - p[1]) ** 2 + (x - p[2]) ** 2), p) for p in free), default=(9, None))
            if near[0] <= 4.0:
                expected.append(("s", t, i, near[1][0]))
                free.remove(near[1])
        assert [w for w in whole if w[1] == t] == expected


def test_greedy_pieces_make_few_pairs_in_a_crowd(spark, monkeypatch):
    n = 3000
    points = spark.range(n).select(F.lit("s").alias("sample_id"), F.lit(0).alias("t"), "id", (F.rand(1) * 20).alias("y"), (F.rand(2) * 20).alias("x"))
    both = matching._tag(points, 0, "id").unionByName(matching._tag(points, 1, "id"))
    made = []
    keep = matching._pieces
    monkeypatch.setattr(matching, "_pieces", lambda pairs, *rest: made.append(pairs.count()) or keep(pairs, *rest))
    assert matching._loose_pieces(both, 7.0).select("piece").distinct().count() == 1
    assert made[0] < n  # of millions within reach
