import math
import random

import numpy as np
import pytest

from cellgraph.functions import scalar
from cellgraph.operators import classifier, frames, lineage, patches, scoring
from cellgraph.schemas import SPLIT, TRACK_FILE
from cellgraph.sources import files


def node_table(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "sample_id string, node_id bigint, t int, y double, x double")


def edge_table(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "sample_id string, src bigint, dst bigint")


NODES = [(1, 0, 0.0, 0.0), (2, 1, 0.0, 0.0), (3, 2, 0.0, 0.0), (4, 2, 30.0, 0.0), (5, 3, 0.0, 0.0), (6, 3, 30.0, 0.0)]
EDGES = [(1, 2), (2, 3), (2, 4), (3, 5), (4, 6)]


def test_truth_against_itself(spark):
    n, e = node_table(spark, NODES), edge_table(spark, EDGES)
    est = spark.createDataFrame([("s", 6)], "sample_id string, n_estimate int")
    r = scoring.score_tracking(n, e, n, e, est).first()
    assert r.edge_precision == r.edge_recall == r.division_jaccard == r.raw_edge_jaccard == 1.0
    assert r.final_score == pytest.approx(1.1)
    assert scoring.score_tracking(n, e, n, e).first().final_score is None


def test_copies_unmatched_and_skipping_edges(spark):
    n = node_table(spark, NODES)
    pred = edge_table(spark, [(1, 2), (1, 2), (2, 5), (90, 91)])
    extra = node_table(spark, NODES + [(90, 0, 500.0, 500.0), (91, 1, 500.0, 500.0)])
    m = scoring.match_nodes(extra, n)
    c = scoring.edge_confusion(pred, edge_table(spark, EDGES), m, extra, n).first()
    assert (c.tp, c.fp, c.fn) == (1, 0, 4)  # copy counted once, two-frame edge and far edge ignored


def test_a_linker_without_divisions_finds_none(spark):
    det = spark.createDataFrame([("s", t, i, float(y), float(x)) for t, i, y, x in
                                 [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (2, 1, 8, 0)]], "sample_id string, t int, idx int, y double, x double")
    gt_n = node_table(spark, [(1, 0, 0.0, 0.0), (2, 1, 0.0, 0.0), (3, 2, 0.0, 0.0), (4, 2, 8.0, 0.0)])
    gt_e = edge_table(spark, [(1, 2), (2, 3), (2, 4)])
    rows = {r.method: r for r in scoring.benchmark_methods(det, gt_n, gt_e, {
        "greedy": {"matcher": "greedy", "divisions": False}, "full": {"matcher": "global"}}).collect()}
    assert rows["greedy"].division_tp == 0 and rows["full"].division_tp == 1
    assert rows["full"].raw_edge_jaccard == 1.0 and rows["greedy"].edge_fn == 1


def test_recorded_confusion_arithmetic(spark):
    rows = [(1, 0.9)] * 72 + [(0, 0.9)] * 754 + [(1, 0.1)] * 39 + [(0, 0.1)] * 893
    r = classifier.confusion_at(spark.createDataFrame(rows, "label int, probability double")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (72, 754, 39, 893)
    assert r.recall == pytest.approx(0.648649, abs=1e-6) and r.accuracy == pytest.approx((72 + 893) / len(rows))


def test_gated_hand_case(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in scalar.prf1(*[scalar.F.lit(k) for k in (1, 2, 1)]).items()]).first()
    assert r.precision == pytest.approx(1 / 3) and r.recall == 0.5


def test_calibration_needs_both(spark):
    df = spark.createDataFrame([(0.4, 2.5), (0.4, None), (None, 2.5)], "px double, mins double")
    rows = df.select(*[c.alias(n) for n, c in scalar.calibration("px", "mins").items()]).collect()
    assert [tuple(r) for r in rows] == [(0.4, 2.5, "um/min"), (1.0, 1.0, "px/frame"), (1.0, 1.0, "px/frame")]
    with pytest.raises(ValueError):
        scalar.label_by_distance("d", 10, 5)


def test_relative_time_words(spark):
    now = "2026-01-10 12:00:00"
    cases = {"2026-01-10 12:00:30": "just now", "2026-01-10 11:59:01": "just now", "2026-01-10 11:59:00": "1 minute ago",
             "2026-01-10 09:00:00": "3 hours ago", "2026-01-08 12:00:00": "2 days ago", "2026-01-01 12:00:00": "1 week ago", "2025-01-01 00:00:00": "2025-01-01"}
    df = spark.createDataFrame([(k,) for k in cases], "ts string").withColumn("ts", scalar.F.col("ts").cast("timestamp"))
    got = [r.a for r in df.select(scalar.relative_time("ts", scalar.F.lit(now).cast("timestamp")).alias("a")).collect()]
    assert got == list(cases.values())


def test_malformed_patch_name_is_an_error(spark):
    df = spark.createDataFrame([("a_b_3_40_50.npy",)], "f string")
    r = df.select(*[c.alias(n) for n, c in scalar.parse_patch_name("f").items()]).first()
    assert tuple(r) == ("a_b", 3, 40, 50)
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([("bad.npy",)], "f string").select(scalar.parse_patch_name("f")["frame_idx"]).collect()


def test_track_file_round_trip_and_empty_header(spark, tmp_path):
    empty = spark.createDataFrame([], TRACK_FILE)
    files.write_tracks(empty, str(tmp_path / "empty"))
    text = "".join(p.read_text() for p in (tmp_path / "empty").glob("part-*"))
    assert text.strip() == ",".join(TRACK_FILE.fieldNames())
    assert files.read_tracks(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "other.csv").write_text(",".join(TRACK_FILE.fieldNames()) + "\n7,1,2.5,3.5,1,3.0,,False\n")
    r = files.read_tracks(spark, str(tmp_path / "other.csv")).first()
    assert (r.parent_node_id, r.parent_track_id, r.is_division_parent) == (3, None, False)
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_tracks(empty, str(tmp_path / "empty"))


def test_checked_reading(spark, tmp_path):
    (tmp_path / "split.csv").write_text("sample_id,extra,split\na,1,train\n")
    assert files.read_checked(spark, str(tmp_path / "split.csv"), SPLIT).columns == ["sample_id", "split"]
    (tmp_path / "bad.csv").write_text("sample_id\na\n")
    with pytest.raises(ValueError, match="split"):
        files.read_checked(spark, str(tmp_path / "bad.csv"), SPLIT)
    (tmp_path / "man_track.txt").write_text("1 0 3 0\n\n  2\t4 5 1 \n")
    assert sorted(tuple(r) for r in files.read_ctc_tracks(spark, str(tmp_path / "man_track.txt")).collect()) == [(1, 0, 3, 0), (2, 4, 5, 1)]
    (tmp_path / "short.txt").write_text("1 0 3\n")
    with pytest.raises(Exception, match="expected 4"):
        files.read_ctc_tracks(spark, str(tmp_path / "short.txt")).collect()


def test_tracking_export_and_mask(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<M><AllSpots><SpotsInFrame frame="0"><Spot ID="1" POSITION_Y="1.5" POSITION_X="2"/></SpotsInFrame>'
                                    '<SpotsInFrame frame="1"><Spot ID="2" POSITION_Y="1" POSITION_X="2"/><Spot ID="3" POSITION_Y="4" POSITION_X="2"/></SpotsInFrame></AllSpots>'
                                    '<AllTracks><Track><Edge SPOT_SOURCE_ID="1" SPOT_TARGET_ID="2"/><Edge SPOT_SOURCE_ID="1" SPOT_TARGET_ID="3"/></Track></AllTracks></M>')
    nodes, edges = files.read_trackmate_xml(spark, str(tmp_path / "m.xml"))
    assert sorted((r.node_id, r.t, r.y) for r in nodes.collect()) == [(1, 0, 1.5), (2, 1, 1.0), (3, 1, 4.0)]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(1, 2), (1, 3)]
    px = spark.createDataFrame([("s", 0, y, x, 3) for y in (0, 1) for x in (0, 1)] + [("s", 0, 5, 5, 0)], "sample_id string, t int, y int, x int, label int")
    r = files.mask_centroids(px).collect()
    assert len(r) == 1 and (r[0].y, r[0].x, r[0].node_id) == (0.5, 0.5, "3_0")


def test_unequal_arrays_are_an_error(spark):
    df = spark.createDataFrame([("s", [1, 2], [0], [0.0, 1.0], [0.0, 1.0], [])], "sample_id string, ids array<bigint>, t array<int>, y array<double>, x array<double>, edges array<struct<src:bigint,dst:bigint>>")
    with pytest.raises(Exception, match="array lengths"):
        files.explode_geff(df)[0].collect()


def test_pixel_and_array_detectors_agree(spark):
    rng = np.random.default_rng(0)
    image = rng.uniform(0, 1, (24, 20))
    for y, x in ((8, 8), (15, 12)):
        image[y, x] += 40
    df = spark.createDataFrame([("s", 0, 24, 20, [float(v) for v in image.ravel()])], "sample_id string, t int, height int, width int, pix array<float>")
    fast = sorted((int(r.y), int(r.x)) for r in frames.detect(df, 1.0, 2.0, 3).collect())
    px = spark.createDataFrame([("s", 0, y, x, float(image[y, x])) for y in range(24) for x in range(20)], "sample_id string, t int, y int, x int, v double")
    slow = sorted((r.y, r.x) for r in frames.local_maxima(frames.gaussian_smooth(px, 1.0), 3, 2.0).collect())
    assert fast == slow == [(8, 8), (15, 12)]


def test_plateau_keeps_one_peak(spark):
    px = spark.createDataFrame([("s", 0, y, x, 9.0 if (y, x) in ((5, 5), (5, 6)) else 0.0) for y in range(12) for x in range(12)], "sample_id string, t int, y int, x int, v double")
    assert [(r.y, r.x) for r in frames.local_maxima(px, 2, 1.0).collect()] == [(5, 5)]


@pytest.fixture(scope="module")
def patch_table(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k % 4}", k, int(k % 5 == 0), "train" if k % 4 else "test", [float(v) for v in rng.normal(0, 1, 16)]) for k in range(200)]
    return spark.createDataFrame(rows, "sample_id string, id bigint, label int, split string, pix array<float>")


def test_draws_and_splits(spark, patch_table):
    b = patches.balanced_sample(patch_table, "id", seed=1, n=2000).toPandas()
    assert len(b) == 2000 and abs(b.label.mean() - 0.5) < 0.06 and b[b.label == 1].id.nunique() > 30
    again = [sorted(patches.balanced_sample(patch_table, "id", seed=1, n=50).select("draw", "id").collect()) for _ in range(2)]
    assert again[0] == again[1]
    with pytest.raises(ValueError):
        patches.balanced_sample(patch_table.where("label = 0"), "id", seed=1)
    h = patches.holdout(patch_table, "id", 0.2, 3).toPandas()
    assert h[h.part == "val"].groupby("label").size().to_dict() == {0: 32, 1: 8}
    ids = spark.createDataFrame([(f"x{k}",) for k in range(20)], "sample_id string")
    counts = patches.split_samples(ids, seed=4).groupBy("split").count().toPandas().set_index("split")["count"].to_dict()
    assert counts == {"train": 14, "val": 3, "test": 3}


def test_augment_leaves_other_splits_alone(patch_table):
    out = patches.augment(patch_table, "id", 4, copies=2, seed=5).toPandas()
    assert (out[out.split == "test"]["copy"] == 0).all()
    assert len(out[out.split == "train"]) == 3 * 150
    base = {r.id: np.array(r.pix) for r in patch_table.collect()}
    for r in out[out["copy"] > 0].head(20).itertuples():
        new, old = np.array(r.pix), base[r.id]
        assert new.shape == old.shape and np.isfinite(new).all() and abs(new.mean() - old.mean()) < 0.35


def test_statistics_never_read_labels(patch_table):
    a = patches.robust_stats(patch_table).toPandas().sort_values("sample_id")
    b = patches.robust_stats(patch_table.withColumn("label", 1 - scalar.F.col("label"))).toPandas().sort_values("sample_id")
    assert a.values.tolist() == b.values.tolist()
    with pytest.raises(ValueError):
        patches.robust_stats(patch_table.where("id < 0"))


def test_non_finite_pixels_are_an_error(spark):
    df = spark.createDataFrame([("s", 1, [1.0, math.nan])], "sample_id string, label int, pix array<float>")
    with pytest.raises(Exception, match="non-finite"):
        patches.pixel_distribution(df).collect()


def test_auc_of_one_class_is_null(spark):
    r = classifier.discrimination(spark.createDataFrame([(1, 0.3), (1, 0.4)], "label int, probability double")).first()
    assert r.roc_auc is None and r.pr_auc == pytest.approx(1.0)


def test_limit_frames_drops_cut_edges(spark):
    kept, inside = lineage.limit_frames(node_table(spark, NODES), edge_table(spark, EDGES), 2)
    assert kept.count() == 2 and [(r.src, r.dst) for r in inside.collect()] == [(1, 2)]


def test_string_keys_rank_and_balance(spark):
    from cellgraph.operators import patches, ranking

    rng = random.Random(8)
    rows = [("s", f"patch_{rng.randint(0, 10 ** 6):07d}", rng.choice([1.0, 1.0, 1.0, 2.0, 7.5])) for _ in range(400)] + [("s", "é", 1.0), ("s", "", 1.0)]
    df = spark.createDataFrame(rows, "sample_id string, key string, v double").dropDuplicates(["key"])
    data = [tuple(r) for r in df.collect()]
    got = {r.key: r["rank"] for r in ranking.rank_rows(df, "v", "key").collect()}
    assert got == {k: i for i, (_, k, _) in enumerate(sorted(data, key=lambda r: (r[2], r[1].encode())))}
    got = {r.key: r["rank"] for r in ranking.rank_rows(df, "key", "key").collect()}
    assert got == {k: i for i, k in enumerate(sorted((r[1] for r in data), key=str.encode))}


def test_reproduce_check_needs_values_or_a_missing_row(spark):
    from cellgraph.operators import classifier

    mine = spark.createDataFrame([("a", "m", 1.0), ("a", "n", None), ("b", "m", 2.0), ("c", "m", 1.0)], "sample_id string, metric string, value double")
    theirs = spark.createDataFrame([("a", "m", 1.5), ("a", "n", None), ("c", "m", 1.0), ("d", "m", None)], "sample_id string, metric string, value double")
    assert sorted(r.sample_id for r in classifier.reproduce_check(mine, theirs).collect()) == ["a", "b", "d"]


def test_regions_join_along_edges(spark):
    from cellgraph.operators import frames

    px = spark.createDataFrame([("s", 0, y, x, 1.0) for y, x in ((0, 0), (0, 1), (1, 2), (2, 2), (-1, 70000))], "sample_id string, t int, y int, x int, v double")
    assert sorted(r.area for r in frames.region_candidates(px, 0.5, 1, 9).collect()) == [1, 2, 2]
    assert sorted(r.area for r in frames.region_candidates(px, 0.5, 1, 9, diagonal=True).collect()) == [1, 4]


def test_settings_names(spark):
    from cellgraph.operators import registry

    log = spark.createDataFrame([(1, {n: "1" for n in (*registry.FIELDS, "max_link_distance")})], "change_id int, fields map<string,string>")
    assert [r.field for r in registry.unknown_fields(log).collect()] == ["max_link_distance"]


def test_detection_paths_agree_on_float_and_integer_images(spark):
    from cellgraph.operators import frames as J

    rng = np.random.default_rng(5)
    rows = []
    for t in range(6):
        image = rng.integers(0, 60, (17, 23))
        rows += [("s", t, y, x, float(image[y, x])) for y in range(17) for x in range(23) if t or image[y, x] > 3]
    px = spark.createDataFrame(rows, "sample_id string, t int, y int, x int, v double")
    whole = J.frames_of_pixels(px)
    full = px.where("t > 0")
    for truncate in (False, True):
        a = J.local_maxima(J.gaussian_smooth(full, 1.0, truncate), 2, 20.0).select("t", "y", "x").collect()
        b = J.detect(whole.where("t > 0"), 1.0, 20.0, 2, truncate=truncate).select("t", "y", "x").collect()
        assert len(a) > 20 and sorted(map(tuple, a)) == sorted((r.t, int(r.y), int(r.x)) for r in b)
    first = whole.where("t = 0").first()
    given = {(r[2], r[3]): r[4] for r in rows if r[1] == 0}
    assert first.pix == [given.get((k // first.width, k % first.width), 0.0) for k in range(first.height * first.width)]
