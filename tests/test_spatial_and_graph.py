import math
import random

import pytest

from cellgraph.operators import graph, ranking, spatial


def cloud(spark, rows, name):
    return spark.createDataFrame(rows, f"sample_id string, t int, {name} bigint, y double, x double")


def test_nearest_with_far_and_clustered_points(spark):
    rng = random.Random(2)
    gt, cand = [], []
    for t in range(6):
        centre = (rng.uniform(-5000, 5000), rng.uniform(-5000, 5000))
        gt += [("s", t, len(gt) + k, centre[0] + rng.gauss(0, 3), centre[1] + rng.gauss(0, 3)) for k in range(40 if t else 0)]
        cand += [("s", t, len(cand) + k, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for k in range(30)]
        cand += [("s", t, len(cand) + k, centre[0] + rng.gauss(0, 9), centre[1] + rng.gauss(0, 9)) for k in range(30)]
    gt += [(s, t, i + 10_000, y, x) for s, t, i, y, x in gt]  # copies: the first id must win
    got = {r.det_id: (r.gt_id, r.distance) for r in spatial.nearest_in_frame(cloud(spark, cand, "det_id"), cloud(spark, gt, "gt_id"), "det_id").collect()}
    assert len(got) == len(cand)
    for s, t, i, y, x in cand:
        best = min(((math.sqrt((y - g[3]) ** 2 + (x - g[4]) ** 2), g[2]) for g in gt if g[1] == t), default=None)
        if best is None:
            assert got[i] == (None, None)
        else:
            assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0])


def test_sampled_background_keeps_its_distance(spark):
    rng = random.Random(3)
    centers = [("s", t, k, rng.uniform(30, 220), rng.uniform(30, 220)) for t in range(3) for k in range(6)]
    frames = spark.createDataFrame([("s", t, 256, 256) for t in range(3)], "sample_id string, t int, height int, width int")
    got = spatial.sample_negatives(frames, cloud(spark, centers, "k"), seed=1).collect()
    assert len(got) == len(centers)
    for r in got:
        assert all(math.dist((r.y, r.x), c[3:]) >= 20 for c in centers if c[1] == r.t)
        assert 16 <= r.y < 240 and 16 <= r.x < 240
    assert sorted(got) == sorted(spatial.sample_negatives(frames, cloud(spark, centers, "k"), seed=1).collect())
    with pytest.raises(Exception, match="too few"):
        spatial.sample_negatives(frames, cloud(spark, centers, "k"), seed=1, apart=400.0).collect()


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(f"s{k % 3}", rng.randint(0, 60), rng.randint(0, 60)) for k in range(90)]
    edges += [("hub", 0, k) for k in range(1, 50)] + [("chain", k + 1, k) for k in range(70)] + [("self", 5, 5)]
    got = {(r.sample_id, r.node): r.component for r in graph.components(spark.createDataFrame(edges, "sample_id string, src bigint, dst bigint")).collect()}
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for s, a, b in edges:
        lo, hi = sorted((find((s, a)), find((s, b))))
        parent[hi] = lo
    assert got == {a: find(a)[1] for a in list(parent)}


def test_layout_by_hand(spark):
    rows = [("s", 1, None), ("s", 2, None), ("s", 3, 1), ("s", 4, 1), ("s", 5, 3), ("s", 6, 3)]
    t = spark.createDataFrame(rows, "sample_id string, track_id bigint, parent_track_id bigint")
    got = {r.track_id: r.slot for r in graph.lineage_layout(t).collect()}
    want = {5: 0, 6: 1, 4: 2, 2: 3, 3: 0.5, 1: 1.25}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_descendants(spark):
    rows = [("s", 1, None), ("s", 2, 1), ("s", 3, 1), ("s", 4, 3), ("s", 9, None)]
    t = spark.createDataFrame(rows, "sample_id string, track_id bigint, parent_track_id bigint")
    below = lambda **k: sorted(r.track_id for r in graph.descendants(t, t.where("track_id = 1"), **k).collect())
    assert below() == [1, 2, 3, 4] and below(include_self=False) == [2, 3, 4]
    assert graph.descendants(t, t.where("track_id = 9"), include_self=False).count() == 0


def test_ranks_and_percentiles_with_heavy_values(spark):
    import numpy as np

    rng = random.Random(6)
    rows = [(k % 2, k, rng.choice([5.0, 5.0, 5.0, rng.uniform(0, 10)])) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, id bigint, v double")
    for down in (False, True):
        got = {r.id: r["rank"] for r in ranking.rank_rows(df, "v", "id", ["g"], tie_descending=down).collect()}
        for g in (0, 1):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], -r[1] if down else r[1]))
            assert [got[r[1]] for r in mine] == list(range(len(mine)))
    p = {r.g: r for r in ranking.exact_percentiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.99}, ["g"]).collect()}
    for g in (0, 1):
        want = np.percentile([r[2] for r in rows if r[0] == g], [10, 50, 99])
        assert [p[g].a, p[g].b, p[g].c] == pytest.approx(list(want))


def test_descendants_end_on_a_cycle_below_the_root(spark):
    rows = [("s", 1, None), ("s", 2, 1), ("s", 3, 2), ("s", 2, 3), ("s", 4, 3)]
    tracks = spark.createDataFrame(rows, "sample_id string, track_id bigint, parent_track_id bigint")
    roots = spark.createDataFrame([("s", 1)], "sample_id string, track_id bigint")
    for own, want in ((True, [1, 2, 3, 4]), (False, [2, 3, 4])):
        assert sorted(r.track_id for r in graph.descendants(tracks, roots, own).collect()) == want


def random_forest(rng, sample, n, chain=0):
    """Rows of a forest with ids in no order, the first `chain` of them one below the other."""
    ids = rng.sample(range(10 * n), n)
    return [(sample, v, ids[k - 1] if 0 < k <= chain else rng.choice([None, *ids[:k]]) if k else None) for k, v in enumerate(ids)]


def plain_layout(rows):
    """Slots by recursion over one sample's (track, parent) rows."""
    kids = {}
    for v, p in rows:
        kids.setdefault(p, []).append(v)
    slot, todo, count = {}, [(v, False) for v in sorted(kids.get(None, []), reverse=True)], 0
    while todo:
        v, seen = todo.pop()
        if v not in kids:
            slot[v], count = count, count + 1
        elif seen:
            slot[v] = sum(slot[c] for c in kids[v]) / len(kids[v])
        else:
            todo += [(v, True), *((c, False) for c in sorted(kids[v], reverse=True))]
    return slot


def test_forests_equal_plain_walks(spark):
    rng = random.Random(12)
    rows = random_forest(rng, "a", 60) + random_forest(rng, "b", 90, chain=40) + [("c", 5, None)]
    t = spark.createDataFrame(rows + rows[:7], "sample_id string, track_id bigint, parent_track_id bigint")
    got = {(r.sample_id, r.track_id): r.slot for r in graph.lineage_layout(t).collect()}
    want = {(s, v): x for s in "abc" for v, x in plain_layout([r[1:] for r in rows if r[0] == s]).items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    parent = {r[:2]: r[2] for r in rows}
    pairs = {(s, v, v) for s, v in parent}
    for s, v in parent:
        up = parent[s, v]
        while up is not None:
            pairs.add((s, up, v))
            up = parent[s, up]
    found = [tuple(r) for r in graph.descendants(t, t.select("sample_id", "track_id")).select("sample_id", "root", "track_id").collect()]
    assert len(found) == len(pairs) and set(found) == pairs
    empty = t.limit(0)
    assert graph.descendants(empty, empty).count() == 0 and graph.lineage_layout(empty).count() == 0


def test_odd_forests(spark):
    make = lambda rows: spark.createDataFrame(rows, "sample_id string, track_id bigint, parent_track_id bigint")
    # a cycle without a root, a parent that is not in the table, a track that is its own parent, a sample beside them
    t = make([("a", 1, 2), ("a", 2, 1), ("a", 3, 2), ("b", 7, 99), ("b", 8, 8), ("b", 9, 7)])
    roots = spark.createDataFrame([("a", 1), ("b", 99), ("b", 8), ("z", 4)], "sample_id string, track_id bigint")
    got = sorted(tuple(r) for r in graph.descendants(t, roots).select("sample_id", "root", "track_id").collect())
    assert got == [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 8, 8), ("b", 99, 7), ("b", 99, 9), ("b", 99, 99), ("z", 4, 4)]
    assert {r.track_id: r.slot for r in graph.lineage_layout(t.where("sample_id = 'b'")).collect()} == {7: 1, 8: 0, 9: 1}
    for bad in ([("a", 1, 2), ("a", 2, 1)], [("a", 1, None), ("a", 2, 1), ("a", 3, 1), ("a", 3, 2)]):
        with pytest.raises(RuntimeError):
            graph.lineage_layout(make(bad)).collect()
