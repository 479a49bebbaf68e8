"""What must hold on tables far larger than the test data: no broadcast by guess, no one-sided frames in Python."""

import pytest
from pyspark.sql import functions as F

from cellgraph.operators import matching
from cellgraph.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cell_details", "consecutive_only", "division_candidates", "edge_confusion", "box_disagreement"])
def test_no_side_is_broadcast_by_its_file_size(spark, name):
    # part.parquet stays below any threshold while the nodes made from it do not
    df = catalog.spark_callable(catalog.load_all()[name])(spark, FOLDER)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan


def _points(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, t int, id bigint, y double, x double")


def test_frames_without_a_partner_side_are_not_solved(spark):
    left = _points(spark, [("s", 0, i, float(i), 0.0) for i in range(5)] + [("s", 1, 9, 0.0, 0.0)])
    right = _points(spark, [("s", 1, 9, 0.0, 1.0)] + [("s", 2, i, float(i), 0.0) for i in range(5)])

    def solve(key, pdf):
        if pdf["side"].nunique() < 2:
            raise AssertionError("one-sided frame")
        return matching._gated_solver(5.0)(key, pdf)

    both = matching._tag(left, 0, "id").unionByName(matching._tag(right, 1, "id"))
    got = matching._match_frames(both, solve, 1000, lambda big: big)
    assert [tuple(r) for r in got.collect()] == [("s", 1, 9, 9, 1.0)]


def test_lopsided_frames_are_cut(spark, monkeypatch):
    monkeypatch.setattr(matching, "MAX_POINTS", 10)
    left = _points(spark, [("s", 0, 0, 0.0, 0.0)])
    right = _points(spark, [("s", 0, i, float(3 * i + 1), 0.0) for i in range(50)])
    largest = []
    both = matching._tag(left, 0, "id").unionByName(matching._tag(right, 1, "id"))
    matching._match_frames(both, matching._gated_solver(5.0), 100, lambda big: largest.append(big.count()) or big.select(
        "sample_id", "t", F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.col("y").alias("distance")))
    assert largest == [51]
    got = matching.match_gated(left, right, 5.0, "id", "id", max_pairs=100)
    assert [tuple(r)[2:] for r in got.collect()] == [(0, 0, 1.0)]


def test_places_are_searched_once_and_copies_get_the_same_answer(spark):
    import random

    from cellgraph.operators import spatial

    r = random.Random(3)
    spots = [(r.uniform(0, 900), r.uniform(0, 40)) for _ in range(60)]
    gt = [("s", 0, i, y, x) for i, (y, x) in enumerate(spots[:8])] + [("s", 0, 8, *spots[0])]
    many = [(y, x, k) for y, x in spots for k in range(40)]  # every place 40 times
    cands = [("s", 0, i, y, x) for i, (y, x, _) in enumerate(many)]
    c, g = _points(spark, cands), _points(spark, gt).withColumnRenamed("id", "gt_id")
    near = spatial.nearest_in_frame(c, g, key="id")
    want = {i: min((((y - b) ** 2 + (x - a) ** 2) ** 0.5, j) for _, _, j, b, a in gt) for _, _, i, y, x in cands}
    got = {row["id"]: (row["distance"], row["gt_id"]) for row in near.collect()}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-9 for i in want)
    counts = spatial.radius_counts(g, c, (5, 40))
    for row in counts.collect():
        _, _, _, b, a = gt[row["gt_id"]]
        assert row["n_40"] == sum(((y - b) ** 2 + (x - a) ** 2) ** 0.5 <= 40 for _, _, _, y, x in cands)
    boxes = spatial.gt_in_patch(c, g, key="id", half=16.0)
    assert {row["id"]: row["n_inside"] for row in boxes.collect()} == {
        i: sum(y - 16 <= b < y + 16 and x - 16 <= a < x + 16 for _, _, _, b, a in gt) for _, _, i, y, x in cands}
    # work goes by places: a row given twice comes back twice, with the answer of its place
    twice = spatial.gt_in_patch(c.union(c), g, key="id", half=16.0)
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted(2 * list(map(tuple, boxes.collect())), key=repr)
    assert spatial.nearest_in_frame(c.union(c), g, key="id").count() == 2 * len(cands)
    assert sorted(map(tuple, spatial.radius_counts(g.union(g), c, (5, 40)).collect())) == sorted(2 * list(map(tuple, counts.collect())))


def test_means_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    from cellgraph.plans import classifier
    from cellgraph.plans.views import Views

    # 20 values of mean 0.0345: a half at the third digit, summed in four orders
    tax = [0.01, 0.02, 0.07, 0.03, 0.08, 0.01, 0.04, 0.06, 0.0, 0.05, 0.02, 0.03, 0.08, 0.01, 0.07, 0.02, 0.01, 0.04, 0.03, 0.01]
    assert round(sum(tax) * 100) == 69 and len(tax) == 20
    rows = [(k, t, 0.01, "2024-01-05") for k, values in enumerate((sorted(tax), sorted(tax)[::-1], tax, tax[::-1])) for t in values]
    table = spark.createDataFrame(rows, "l_suppkey bigint, l_tax double, l_discount double, d string").selectExpr(
        "l_suppkey", "l_tax", "l_discount", "'A' AS l_returnflag", "timestamp(d) AS l_shipdate")
    table.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    v = Views(spark, str(tmp_path))
    assert {r["val_pr_auc"] for r in classifier._epochs(v).collect()} == {0.035}
    assert {r["recall"] for r in classifier._run(v, "A", 0).collect()} == {0.0345}


def test_tracks_are_spread_by_their_number(spark, monkeypatch):
    from cellgraph.plans import views

    whole = views.Views(spark, FOLDER)
    assert whole.lineage.rdd.getNumPartitions() == 1  # a small table is not shuffled
    monkeypatch.setattr(views, "TRACKS_PER_TASK", 20)
    spread = views.Views(spark, FOLDER)
    assert spread.lineage.rdd.getNumPartitions() == spread.cells.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, spread.lineage.collect()), key=repr) == sorted(map(tuple, whole.lineage.collect()), key=repr)


def test_exports_are_written_in_bounded_files(spark, monkeypatch):
    from cellgraph.plans import io, views

    monkeypatch.setattr(io, "RECORDS_PER_FILE", 500, raising=False)
    v = views.Views(spark, FOLDER)
    nodes, edges = io._xml(v)
    assert len(nodes.inputFiles()) >= 7  # 2,000 spots and nearly as many edges
    assert nodes.count() == 2000 and edges.count() == v.lineage_edges.count()


def test_pieces_of_a_bundle_are_solved_together(spark, monkeypatch):
    import random

    import numpy as np
    import pandas as pd

    from cellgraph.operators.assignment import nearest, pair_up

    r = random.Random(8)
    rows, want, several = [], set(), 0
    for piece in range(300):
        n0, n1 = r.randint(1, 3), r.randint(1, 3)
        turned = n0 > n1
        spot = lambda: (float(r.randint(0, 3)), float(r.randint(0, 3)))  # noqa: E731  (a few places: many ties)
        sides = [[spot() for _ in range(n)] for n in (n0, n1)]
        na, nb = (9, 5) if turned else (5, 9)
        rows += [("s", 1, piece, side, 10 * piece + k, y, x, na, nb, 9.0) for side in (0, 1) for k, (y, x) in enumerate(sides[side])]
        several += min(n0, n1) > 1
        want |= {(piece, 10 * piece + i, 10 * piece + j) for i, j in zip(*map(np.ndarray.tolist, pair_up(*map(np.array, sides))))}
    r.shuffle(rows)
    calls = []
    whole = matching.assign
    monkeypatch.setattr(matching, "assign", lambda *a: calls.append(1) or whole(*a))
    got = matching._solve_pieces(pd.DataFrame(rows, columns="sample_id t piece side id y x na nb radius".split()))
    assert set(zip(got["piece"], got["a_id"], got["b_id"])) == want and got["settled"].all()
    assert len(calls) == several  # a piece with one row needs no solver
    assert nearest(np.zeros(2), np.array([[0, 2.0], [1, 0], [0, 1]])) == (1, 1.0)

    # gated and greedy pieces of one frame that share a bundle make one call
    frames = []

    def counted(key, pdf):
        frames.append(key)
        return matching._gated_solver(5.0)(key, pdf)

    pdf = pd.DataFrame([("s", 1, side, 10 * k + j, 40.0 * k, float(j)) for k in range(50) for side in (0, 1) for j in range(2)],
                       columns="sample_id t side id y x".split())
    assert len(matching._each(matching.FRAME, counted)(pdf)) == 100 and frames == [("s", 1)]


def test_runs_of_near_ids_are_contracted_where_they_lie(spark, monkeypatch):
    from cellgraph.operators import graph

    joined = []
    whole = graph._flatten
    monkeypatch.setattr(graph, "_flatten", lambda hooks: joined.append(hooks.count()) or whole(hooks))
    chain = [("s", k, k + 1) for k in range(9000)] + [("t", 7, 7), ("t", 3, None), (None, 1, 2), ("s", 20000, 20001), ("u", 5, 9000000), ("u", 9000000, 70000)]
    edges = spark.createDataFrame(chain, "sample_id string, src bigint, dst bigint").repartition(8)
    got = {(r[0], r[1]): r[2] for r in graph.components(edges).collect()}
    assert got == {**{("s", k): 0 for k in range(9001)}, ("t", 7): 7, ("t", 3): 3, ("t", None): None, (None, 1): 1, (None, 2): 2,
                   ("s", 20000): 20000, ("s", 20001): 20000, ("u", 5): 5, ("u", 70000): 5, ("u", 9000000): 5}
    assert sum(joined) < 100  # joins see links between contracted runs, not their nodes


def test_chunks_of_edges_become_stars(monkeypatch):
    import pyarrow as pa

    from cellgraph.operators import graph

    monkeypatch.setattr(graph, "CHUNK_EDGES", 3)
    rows = [("a", 2, 1), ("b", 2, 1), ("a", 3, 2), ("a", 4, 4), ("a", 9, 3), ("b", 9, 2), ("a", 8, 5)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("sample_id", "u", "v"), r))]) for r in rows]
    got = [[tuple(r.values()) for r in b.to_pylist()] for b in graph._stars(iter(batches))]
    assert [sorted(x) for x in got] == [[("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 1, 1), ("b", 2, 1)],
                                        [("a", 3, 3), ("a", 4, 4), ("a", 9, 3), ("b", 2, 2), ("b", 9, 2)], [("a", 5, 5), ("a", 8, 5)]]


def test_only_equally_bright_peaks_are_thinned_in_python(spark, monkeypatch):
    from cellgraph.operators import frames

    # frame 0: two peaks of different brightness; frame 1: a plateau of two pixels and a lone peak
    spots = {(0, 3, 3): 5.0, (0, 3, 9): 4.0, (1, 3, 3): 5.0, (1, 3, 4): 5.0, (1, 9, 9): 4.0}
    rows = [("s", t, y, x, spots.get((t, y, x), 0.0)) for t in (0, 1) for y in range(13) for x in range(13)]
    px = spark.createDataFrame(rows, "sample_id string, t int, y int, x int, v double")
    assert sorted(tuple(r)[1:4] for r in frames.local_maxima(px, 2, 1.0).collect()) == [(0, 3, 3), (0, 3, 9), (1, 3, 3), (1, 9, 9)]
    monkeypatch.setattr(frames, "_thin", lambda *a: 1 / 0)
    assert sorted(tuple(r)[1:4] for r in frames.local_maxima(px.where("t = 0"), 2, 1.0).collect()) == [(0, 3, 3), (0, 3, 9)]


def test_a_grid_reads_each_frame_once(spark):
    import random

    import numpy as np

    from cellgraph.operators import frames

    r = random.Random(5)
    sizes = [(r.choice([6, 9]), r.choice([7, 9])) for _ in range(40)]
    images = [[float(r.randint(0, 3)) for _ in range(h * w)] for h, w in sizes]  # many plateaus
    table = spark.createDataFrame([("s", t, h, w, pix, 0.5 + t % 3) for t, ((h, w), pix) in enumerate(zip(sizes, images))],
                                  "sample_id string, t int, height int, width int, pix array<double>, own double")
    grid = [(0.0, 0.5, 2), (0.5, 1.0, 1), (0.5, "own", 3)]
    found = frames.detect(table, grid=grid)
    assert "Generate" not in found._jdf.queryExecution().sparkPlan().toString()  # no copy of a frame per setting
    want = [(t, s, level, d, k, *map(float, yx)) for t, ((h, w), pix) in enumerate(zip(sizes, images)) for s, level, d in grid
            for level in [0.5 + t % 3 if level == "own" else level]
            for k, yx in enumerate(frames.find_peaks(np.array(pix).reshape(h, w), s, level, d))]
    assert sorted(tuple(x)[1:] for x in found.collect()) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("name", ["cumulative_divisions", "dataset_stats", "divisions_per_frame", "edge_confusion_adjacent", "division_confusion"])
def test_no_side_of_divisions_is_broadcast_by_its_file_size(spark, name):
    df = catalog.spark_callable(catalog.load_all()[name])(spark, FOLDER)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_divisions_are_scored_from_few_passes_over_the_edges(spark):
    from cellgraph.operators import scoring

    # a fork 1 -> 2 -> (3, 4) found, one that the prediction lacks (11), and one that the truth lacks (21)
    gt = [(1, 2), (2, 3), (2, 4), (3, 5), (10, 11), (11, 12), (11, 13), (20, 21), (21, 22)]
    got = [e for e in gt if e != (11, 13)] + [(21, 23)]
    table = lambda rows: spark.createDataFrame([("s", *e) for e in rows], "sample_id string, src bigint, dst bigint")
    match = spark.createDataFrame([("s", k, k) for k in range(24)], "sample_id string, pred_id bigint, gt_id bigint")
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(df, total):
        def rows(batches):
            for b in batches:
                total.add(b.num_rows)
                yield b
        return df.mapInArrow(rows, df.schema)

    out = scoring.division_confusion(counted(table(got), seen[0]), counted(table(gt), seen[1]), match)
    assert [tuple(r) for r in out.collect()] == [("s", 1, 1, 1)]
    assert seen[0].value <= 3 * len(got) and seen[1].value <= 5 * len(gt)
    copies = scoring.division_confusion(table(got + got), table(gt + gt + gt), match)
    assert [tuple(r) for r in copies.collect()] == [("s", 1, 1, 1)]


def test_large_files_are_hashed_in_stretches(spark, tmp_path, monkeypatch):
    import hashlib
    import random

    from cellgraph.operators import digests

    r = random.Random(4)
    noise = r.randbytes(400_000)
    files = {
        "a.parquet": noise, "b.parquet": noise + b"\n", "c.parquet": b"\xef\xbb\xbf" + noise, "d.parquet": b"\xef\xbb\xbf" + noise + b"\n\n",
        "e.parquet": b"x" * 300_000 + b"\n" + noise,  # a line longer than several stretches
        "f.parquet": b"\r\n" * 100_000, "g.parquet": b"\n" * 70_000, "h.parquet": b"", "i.parquet": b"\n", "j.parquet": b"\xef\xbb\xbf",
        "k.parquet": noise[:65536], "l.parquet": noise[:65537], "with space%41+.parquet": noise[::-1], "m.gz": noise, "n.parquet": b"y" * 200_000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(digests, "STRETCH", 1 << 16)
    taken = []
    append = digests.Spool.append
    monkeypatch.setattr(digests.Spool, "append", lambda self, df: taken.append(1) or append(self, df))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 15)
    try:
        got = digests.hash_files(spark, str(tmp_path))
        rows = sorted(tuple(x) for x in got.collect())
        whole = spark.read.format("binaryFile").load(str(tmp_path))
        want = sorted((x["path"], x["length"], hashlib.sha256(x["content"]).hexdigest()) for x in whole.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == want and len(rows) == len(files) - 1  # Spark's readers list no empty file
    assert len(taken) == 11  # rounds follow the largest file


def _some_points(rng, kind, n):
    if kind == "grid":
        return rng.integers(0, 60, n) / 2.0
    if kind == "clump":
        return rng.normal(0, 0.01, n) + rng.choice([0.0, 50.0], n)
    return rng.normal(0, 30, n)


@pytest.mark.parametrize("kind", ["grid", "clump", "wide"])
@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_tile_searches_equal_all_pairs(monkeypatch, kind, at_once):
    import numpy as np

    from cellgraph.operators import tiles

    monkeypatch.setattr(tiles, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 30, 60):
        spots = np.unique(np.stack([_some_points(rng, kind, n), _some_points(rng, kind, n)], 1), axis=0)
        (y, x), ids, w = spots.T, rng.permutation(len(spots)), rng.integers(1, 4, len(spots))
        qy, qx = _some_points(rng, kind, 40), _some_points(rng, kind, 40)
        d = np.sqrt((qy[:, None] - y) ** 2 + (qx[:, None] - x) ** 2)
        low, at, _ = tiles.nearest(y, x, ids, qy, qx, 8.0)
        total, one, pick, two = tiles.nearest_in_boxes(y, x, ids, w, qy, qx, 8.0)
        for i in range(40):
            order = np.lexsort((ids, d[i]))
            if len(order) and d[i, order[0]] <= 8:
                assert (low[i], at[i]) == (d[i, order[0]], order[0])
            else:
                assert not low[i] <= 8
            inside = [k for k in order if qy[i] - 8 <= y[k] < qy[i] + 8 and qx[i] - 8 <= x[k] < qx[i] + 8]
            twice = [k for k in inside for _ in range(w[k])]
            assert total[i] == len(twice) and pick[i] == (inside[0] if inside else -1)
            assert [one[i], two[i]] == [d[i, k] for k in twice[:2]] + [np.inf] * (2 - len(twice[:2]))


def test_a_tile_search_does_not_grow_with_the_density(monkeypatch):
    import numpy as np

    from cellgraph.operators import tiles

    made = []
    seen = tiles._best
    monkeypatch.setattr(tiles, "_best", lambda d, *rest: made.append(len(d)) or seen(d, *rest))
    rng = np.random.default_rng(2)
    per_query = []
    for n in (2_000, 32_000):  # the same square, sixteen times as dense; a tenth of the queries lie off it
        made.clear()
        y, x, qy, qx = rng.uniform(0, 30, n), rng.uniform(0, 30, n), rng.uniform(0, 30, n), rng.uniform(0, 33, n)
        tiles.nearest_in_boxes(y, x, np.arange(n), np.ones(n, np.int64), qy, qx, 16.0)
        per_query.append(sum(made) / n)
    assert per_query[1] < 2 * per_query[0]


def test_crowded_frames_are_searched_in_tiles(spark, monkeypatch):
    import numpy as np

    from cellgraph.operators import spatial, tiles

    asked = []
    whole = tiles.solve_tiles
    monkeypatch.setattr(tiles, "solve_tiles", lambda places, points, side, halo, solve, out: asked.append((side, halo)) or whole(places, points, side, halo, solve, out))
    rng = np.random.default_rng(4)
    spots = [("s", int(k % 2), k, float(y), float(x)) for k, (y, x) in enumerate(rng.integers(0, 200, (300, 2)) / 2)]
    odd = [("s", 0, 900, float("nan"), 1.0), ("s", 0, 901, None, 1.0), (None, 0, 902, 1.0, 1.0), ("s", 5, 903, 1.0, 1.0)]
    cands = spark.createDataFrame(spots[::2] + odd, "sample_id string, t int, det_id bigint, y double, x double")
    gt = spark.createDataFrame(spots[1::2], "sample_id string, t int, gt_id bigint, y double, x double").withColumn("t", 1 - F.col("t"))
    got = {r["det_id"]: r for r in spatial.gt_in_patch(cands, gt, "det_id").collect()}
    near = {r["det_id"]: r for r in spatial.nearest_in_frame(cands, gt, "det_id", extent=200.0).collect()}
    assert asked == [(64.0, 16.0), (128.0, 32.0)] and len(got) == len(near) == 154
    truth = [(k, y, x) for _, _, k, y, x in spots[1::2]]  # frames 0 and 1 are exchanged, so both sides meet
    for _, _, k, y, x in spots[::2]:
        inside = [g for g in truth if y - 16 <= g[1] < y + 16 and x - 16 <= g[2] < x + 16]
        assert got[k]["n_inside"] == len(inside)
        least = min((np.sqrt((y - b) ** 2 + (x - a) ** 2), i) for i, b, a in truth)
        assert (near[k]["distance"], near[k]["gt_id"]) == least
    for k in (900, 901, 902, 903):
        assert got[k]["n_inside"] == 0 and got[k]["nearest_inside"] is None and (k in (900, 901) or near[k]["gt_id"] is None)


@pytest.mark.parametrize("kind", ["grid", "clump", "wide"])
@pytest.mark.parametrize("at_once", [100, 1 << 20])
def test_counts_within_radii_equal_all_pairs(monkeypatch, kind, at_once):
    import numpy as np

    from cellgraph.operators import tiles

    monkeypatch.setattr(tiles, "PAIRS_AT_ONCE", at_once)
    rng, radii = np.random.default_rng(6), np.array([3.0, 5.0, 7.0, 10.0, 15.0])
    for n in (1, 2, 30, 400):
        y, x, w = _some_points(rng, kind, n), _some_points(rng, kind, n), rng.integers(1, 4, n)
        qy, qx = _some_points(rng, kind, 150), _some_points(rng, kind, 150)
        d = np.sqrt((qy[:, None] - y) ** 2 + (qx[:, None] - x) ** 2)
        expected = np.stack([((d <= r) * w).sum(axis=1) for r in radii], 1)
        assert (tiles.Grid(y, x).within(w, qy, qx, radii) == expected).all()
