"""Detection scores, distance and label audits, split and file audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalar import prf1
from ..session import cut_lineage
from .ranking import exact_percentiles, percentiles_of_counts, value_counts
from .spatial import FRAME

# Report radii, limits and buckets.
RADII = (3, 5, 7, 10, 15)
ERROR_LIMITS = (5, 10, 15)
CENTRING_LIMITS = (1, 2, 3, 4, 5)
NEGATIVE_BUCKETS = ((10, 12), (12, 16), (16, 20), (20, 32), (32, None))
SPLITS = ("train", "val", "test")
PERCENTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
LEVELS = {"frame": ["sample_id", "t"], "sample": ["sample_id"], "all": []}


def detection_scores(matches: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Counts, rates and errors per frame, per sample and overall (column ``level``).

    Counts are summed before any rate is taken; errors cover matched pairs only.
    """
    ones = lambda df, name: df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(name))
    d = F.col("distance")
    hits = matches.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("tp"), F.sum(d).alias("err"),
        *[F.count_if(d <= float(k)).alias(f"le_{k}") for k in ERROR_LIMITS])
    frames = (ones(gt, "n_gt").join(ones(pred, "n_pred"), FRAME, "full_outer").join(hits, FRAME, "left")
              .fillna(0, ["n_gt", "n_pred", "tp", *[f"le_{k}" for k in ERROR_LIMITS]]))
    sums = ["n_gt", "n_pred", "tp", *[f"le_{k}" for k in ERROR_LIMITS]]
    grouped = frames.groupingSets(
        [[F.col(c) for c in keys] for keys in LEVELS.values()], "sample_id", "t").agg(
        F.grouping_id().alias("_g"), *[F.sum(c).alias(c) for c in sums], F.sum("err").alias("err"))
    level = F.when(F.col("_g") == 0, "frame").when(F.col("_g") == 1, "sample").otherwise("all")
    out = grouped.withColumn("level", level).withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn(
        "fn", F.col("n_gt") - F.col("tp"))
    rates = prf1("tp", "fp", "fn")
    out = out.select("level", "sample_id", "t", "n_gt", "n_pred", "tp", "fp", "fn", *[c.alias(n) for n, c in rates.items()],
                     F.try_divide("err", "tp").alias("mean_error"),
                     *[F.try_divide(F.col(f"le_{k}").cast("double"), F.col("tp")).alias(f"share_le_{k}") for k in ERROR_LIMITS])
    medians = None
    for name, keys in LEVELS.items():
        m = exact_percentiles(matches, "distance", {"median_error": 0.5}, keys).withColumn("level", F.lit(name))
        for c, kind in (("sample_id", "string"), ("t", "int")):
            if c not in keys:
                m = m.withColumn(c, F.lit(None).cast(kind))
        m = m.select("level", "sample_id", "t", "median_error")
        medians = m if medians is None else medians.unionByName(m)
    o, m = out.alias("o"), medians.alias("m")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("level", "sample_id", "t")]
    return o.join(m, same[0] & same[1] & same[2], "left").select("o.*", "m.median_error")


def gate_sweep(matches: DataFrame, gt: DataFrame, pred: DataFrame, gates: Sequence[float]) -> DataFrame:
    """Matches within each gate with precision and recall, per frame and overall (t NULL)."""
    ones = lambda df, name: df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(name))
    d = F.col("distance")
    hits = matches.groupBy(*FRAME).agg(*[F.count_if(d <= float(g)).alias(f"g{i}") for i, g in enumerate(gates)])
    frames = ones(gt, "n_gt").join(ones(pred, "n_pred"), FRAME, "full_outer").join(hits, FRAME, "left").fillna(0)
    sums = ["n_gt", "n_pred", *[f"g{i}" for i in range(len(gates))]]
    both = frames.groupingSets([[F.col("sample_id"), F.col("t")], []], "sample_id", "t").agg(
        *[F.sum(c).alias(c) for c in sums])
    pairs = ", ".join(f"{float(g)}D, g{i}" for i, g in enumerate(gates))
    long = both.selectExpr("sample_id", "t", "n_gt", "n_pred", f"stack({len(gates)}, {pairs}) AS (gate, n_matched)")
    return long.withColumn("precision", F.try_divide("n_matched", "n_pred")).withColumn("recall", F.try_divide("n_matched", "n_gt"))


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, min, mean, max and interpolated percentiles of a column, NULLs left out; one pass over the rows."""
    by = list(by)
    counts = cut_lineage(value_counts(df, value, by))
    v, n = F.col("_v"), F.col("n")
    head = counts.groupBy(*by).agg(F.sum(n).alias("n"), F.min(v).alias("min"), (F.sum(v * n) / F.sum(n)).alias("mean"),
                                   F.max(v).alias("max"))
    points = percentiles_of_counts(counts, PERCENTILES, by)
    return head.join(points, by) if by else head.join(F.broadcast(points))  # one row each


def radius_bins(df: DataFrame, value: str = "distance", radii: Sequence[float] = RADII) -> DataFrame:
    """Rows in (previous radius, radius], running count and share; the tail beyond the last radius too."""
    radii = sorted(radii)
    sums = df.where(F.col(value).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(value) <= float(r)).alias(f"c{i}") for i, r in enumerate(radii)])
    rows = [F.struct(F.lit(float(r)).alias("radius"),
                     (F.col(f"c{i}") - (F.col(f"c{i - 1}") if i else F.lit(0))).cast("bigint").alias("n_bin"),
                     F.col(f"c{i}").alias("n_cumulative")) for i, r in enumerate(radii)]
    rows.append(F.struct(F.lit(None).cast("double").alias("radius"),
                         (F.col("n") - F.col(f"c{len(radii) - 1}")).alias("n_bin"), F.col("n").alias("n_cumulative")))
    one = sums.withColumn("r", F.explode(F.array(*rows)))
    bin_or_cum = F.when(F.col("r.radius").isNull(), F.col("r.n_bin")).otherwise(F.col("r.n_cumulative"))
    return one.select("r.radius", "r.n_bin", "r.n_cumulative", F.try_divide(bin_or_cum * 100.0, F.col("n")).alias("share_pct"))


def label_matrix(df: DataFrame, positives: Sequence[float], negatives: Sequence[float], value: str = "distance") -> DataFrame:
    """Label counts for every pair of limits with negative > positive, from one pass over the rows."""
    limits = sorted({float(x) for x in (*positives, *negatives)})
    at_most = [F.count_if(F.col(value) <= lim).alias(f"c{i}") for i, lim in enumerate(limits)]
    sums = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"), *at_most)
    place = {lim: i for i, lim in enumerate(limits)}
    pairs = [F.struct(F.lit(float(p)).alias("positive"), F.lit(float(q)).alias("negative"),
                      F.col(f"c{place[float(p)]}").alias("n_pos"), (F.col("n") - F.col(f"c{place[float(q)]}")).alias("n_neg"))
             for p in positives for q in negatives if q > p]
    rows = sums.withColumn("r", F.explode(F.array(*pairs))).select("n", "r.*")
    rows = rows.withColumn("n_ambiguous", F.col("n") - F.col("n_pos") - F.col("n_neg"))
    pct = lambda c: F.try_divide(F.col(c) * 100.0, F.col("n"))
    return rows.select("positive", "negative", "n_pos", "n_neg", "n_ambiguous", pct("n_pos").alias("pos_pct"),
                       pct("n_neg").alias("neg_pct"), pct("n_ambiguous").alias("ambiguous_pct"),
                       F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")).alias("imbalance"))


def gt_cluster_shares(counts: DataFrame, radii: Sequence[float] = RADII) -> DataFrame:
    """Share of ground-truth points with none, one, or more candidates in reach, per radius."""
    pairs = ", ".join(f"{r}, n_{r}" for r in radii)
    long = counts.selectExpr(f"stack({len(radii)}, {pairs}) AS (radius, c)")
    g = long.groupBy("radius").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == 0).alias("n_none"),
                                   F.count_if(F.col("c") == 1).alias("n_one"), F.count_if(F.col("c") >= 2).alias("n_more"))
    return g.select("radius", "n_none", "n_one", "n_more", *[
        (F.col(c) * 100.0 / F.col("n")).alias(f"{c[2:]}_pct") for c in ("n_none", "n_one", "n_more")])


def gt_in_patch_histogram(boxes: DataFrame) -> DataFrame:
    """By split and label: candidates with 0, 1, 2, 3+ points inside, and shares."""
    n = F.col("n_inside")
    cases = {"n0": n == 0, "n1": n == 1, "n2": n == 2, "n3": n >= 3}
    g = boxes.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in cases.items()])
    return g.select("*", *[(F.col(k) * 100.0 / F.col("n")).alias(f"{k}_pct") for k in cases])


def distance_buckets(df: DataFrame, value: str = "distance", buckets=NEGATIVE_BUCKETS) -> DataFrame:
    """Share of rows in each half-open distance bucket, per sample and overall (sample NULL)."""
    v = F.col(value)
    inside = lambda lo, hi: (v >= lo) if hi is None else (v >= lo) & (v < hi)
    pct = lambda c: (F.avg(F.coalesce(c.cast("double"), F.lit(0.0))) * 100).alias
    return df.groupingSets([[F.col("sample_id")], []], "sample_id").agg(
        F.count(F.lit(1)).alias("n"), *[pct(inside(lo, hi))(f"from_{lo}") for lo, hi in buckets])


def centering_stats(boxes: DataFrame, half: float = 16.0) -> DataFrame:
    """Per label: distance spread, share within 1..5 px, and where the nearest in-box point lies."""
    b = cut_lineage(boxes)
    d = F.col("distance")
    dy, dx = F.col("local_y") - half, F.col("local_x") - half
    radial = b.withColumn("radial", F.sqrt(dy * dy + dx * dx))
    head = radial.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.max(d).alias("max"),
        *[(F.avg((d <= k).cast("double")) * 100).alias(f"le_{k}_pct") for k in CENTRING_LIMITS],
        F.count("radial").alias("n_with_gt"), F.avg("local_y").alias("mean_local_y"), F.avg("local_x").alias("mean_local_x"),
        F.avg("radial").alias("mean_radial"))
    spread = exact_percentiles(b, "distance", {"p25": .25, "median": .5, "p75": .75, "p90": .9, "p95": .95}, ["label"])
    off = exact_percentiles(radial, "radial", {"median_radial": 0.5}, ["label"])
    return head.join(spread, "label").join(off, "label", "left")


def conflict_shares(boxes: DataFrame) -> DataFrame:
    n, pos, neg = F.col("n_inside"), F.col("label") == "positive", F.col("label") == "negative"
    pct = lambda who, c: (F.avg(F.when(who, c.cast("double"))) * 100)
    return boxes.agg(pct(pos, n > 1).alias("positive_many_pct"), pct(neg, n >= 1).alias("negative_any_pct"),
                     pct(neg, n >= 2).alias("negative_many_pct"))


def sample_overview(boxes: DataFrame) -> DataFrame:
    pos, neg = F.col("label") == "positive", F.col("label") == "negative"
    return boxes.groupBy("sample_id").agg(
        F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"),
        F.avg(F.when(pos, F.col("distance"))).alias("pos_mean_distance"), F.avg(F.when(neg, F.col("distance"))).alias("neg_mean_distance"),
        (F.avg(F.when(neg, (F.col("n_inside") > 0).cast("double"))) * 100).alias("neg_with_gt_pct"))


def box_disagreement(boxes: DataFrame, half: float = 16.0) -> DataFrame:
    return boxes.agg(F.count_if((F.col("distance") < half) & (F.col("n_inside") == 0)).alias("n_flagged"))


def build_counts(cands: DataFrame, gt: DataFrame) -> DataFrame:
    """Counters of a training-set build; ``cands`` has label (NULL without ground truth) and patch_status."""
    is_ = lambda label: F.col("label") == label
    status = lambda s: F.col("patch_status") == s
    left = cands.agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("label").isNull()).alias("zero_gt_excluded"),
        *[F.count_if(is_(k)).alias(f"n_{k}") for k in ("positive", "ambiguous", "negative")],
        *[F.count_if(is_(k) & status("edge_excluded")).alias(f"{k}_edge") for k in ("positive", "ambiguous", "negative")],
        *[F.count_if(is_(k) & status("train_saved")).alias(f"{k}_saved") for k in ("positive", "negative")])
    frames = gt.select(*FRAME).union(cands.select(*FRAME)).distinct().agg(F.count(F.lit(1)).alias("n_frames"))
    points = gt.agg(F.count(F.lit(1)).alias("n_gt"))
    out = left.join(F.broadcast(frames)).join(F.broadcast(points))  # one row each
    return out.withColumn("neg_pos_ratio", F.try_divide(F.col("negative_saved").cast("double"), F.col("positive_saved")))


def duplicate_audit(points: DataFrame, columns: Sequence[str] = ("sample_id", "frame_idx", "gt_y", "gt_x")) -> DataFrame:
    """Rows with a missing coordinate; extra copies and groups of exact duplicates. One row."""
    numbers = columns[1:]
    missing = None
    for c in numbers:
        m = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        missing = m if missing is None else missing | m
    g = points.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("n_missing"),
                 F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("n_extra_rows"),
                 F.count_if(F.col("n") > 1).alias("n_duplicate_groups"))


def per_sample_counts(points: DataFrame, expected: int | None = None, frame: str = "frame_idx") -> DataFrame:
    """Rows and frame span per sample; with ``expected``, how far the grand total is off."""
    per = points.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))
    if expected is None:
        return per
    total = per.agg((F.sum("n") - F.lit(expected)).alias("off_total"))
    return per.join(F.broadcast(total))  # one row


def threshold_stats(frames: DataFrame, value: str = "threshold") -> DataFrame:
    """Mean and population deviation of the thresholds used, per sample and overall (sample NULL)."""
    return frames.groupingSets([[F.col("sample_id")], []], "sample_id").agg(
        F.avg(value).alias("mean_threshold"), F.stddev_pop(value).alias("std_threshold"))


def tag_parameters(det: DataFrame, params: Sequence[str]) -> DataFrame:
    """Fold parameter columns into the sample key, so that a whole grid is matched and scored in one job."""
    parts = [F.col(p).cast("string") for p in params]
    return det.withColumn("sample_id", F.concat_ws("\u0001", F.col("sample_id"), *parts))


def parameter_sweep(det: DataFrame, gt: DataFrame, params: Sequence[str], max_distance: float = 7.0, gated: bool = False) -> DataFrame:
    """For each parameter setting: mean detections per frame, matches, precision, recall.

    Frames of any sample count, with 0 detections where the setting found nothing there but ground truth exists.
    """
    from .matching import match_gated, match_global

    # every setting meets every sample, also one in which it finds nothing; one written row per setting carries a number as key
    settings = cut_lineage(det.select(*params).distinct().withColumn("_setting", F.monotonically_increasing_id()))
    same = [F.col(f"d.{p}").eqNullSafe(F.col(f"s.{p}")) for p in params]
    numbered = det.alias("d").join(settings.alias("s"), same).select("d.*", "s._setting")
    key = lambda df: df.withColumn("sample_id", F.concat(F.col("_setting").cast("string"), F.lit(":"), "sample_id"))
    numbers = settings.agg(F.collect_list("_setting").alias("_all"))  # settings are chosen by a caller: a handful
    truth = key(gt.withColumn("_setting", F.explode(numbers.scalar())))
    pred = key(numbered)
    pairs = (match_gated(truth, pred, max_distance, "gt_id", "idx") if gated
             else match_global(pred, truth, max_distance, "idx", "gt_id"))
    per = lambda df, name: df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(name))
    frames = (per(truth, "n_gt").join(per(pred, "n_pred"), FRAME, "full_outer").join(per(pairs, "tp"), FRAME, "left").fillna(0))
    keyed = frames.select(F.substring_index("sample_id", ":", 1).cast("bigint").alias("_setting"), "n_gt", "n_pred", "tp")
    g = keyed.groupBy("_setting").agg(F.avg("n_pred").alias("mean_detections"), F.sum("tp").alias("matches"),
                                      F.sum("n_pred").alias("n_pred"), F.sum("n_gt").alias("n_gt"))
    told = settings.select("_setting", *[F.col(p).cast("string").alias(p) for p in params]).join(g, "_setting").drop("_setting")
    return told.withColumn("precision", F.try_divide("matches", "n_pred")).withColumn("recall", F.try_divide("matches", "n_gt"))


def leakage(split: DataFrame, known: Sequence[str] = SPLITS) -> DataFrame:
    """Samples assigned to two splits or to an unknown one: (sample_id, problem)."""
    g = split.groupBy("sample_id").agg(F.min("split").alias("a"), F.max("split").alias("b"),
                                       F.max((~F.col("split").isin(*known)).cast("int")).alias("u"))
    problems = F.array_compact(F.array(F.when(F.col("a") != F.col("b"), F.lit("two_splits")), F.when(F.col("u") == 1, F.lit("unknown_split"))))
    return g.select("sample_id", F.explode(problems).alias("problem"))


def coverage_gap(manifest: DataFrame, gt: DataFrame) -> DataFrame:
    """Samples of the manifest without any ground truth."""
    return manifest.select("sample_id").distinct().join(gt.select("sample_id"), "sample_id", "left_anti")


def frozen_set_equal(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: are the two key sets the same?"""
    tagged = a.select(key).distinct().withColumn("_s", F.lit(1)).union(b.select(key).distinct().withColumn("_s", F.lit(2)))
    g = tagged.groupBy(key).agg(F.sum("_s").alias("s"))
    return g.agg((F.count_if(F.col("s") != 3) == 0).alias("equal"))


def file_manifest_audit(files: DataFrame, manifest: DataFrame, split: DataFrame) -> DataFrame:
    """Problems of stored patches. ``files``: filename, dir_label, dir_split."""
    rows = manifest.select("filename", "sample_id", F.col("label").alias("m_label"), F.col("split").alias("m_split"), F.lit(True).alias("known"))
    table = split.select("sample_id", F.col("split").alias("t_split"))
    j = files.join(rows, "filename", "left").join(table, "sample_id", "left")
    known = F.coalesce("known", F.lit(False))
    bad = lambda cond, name: F.when(known & F.coalesce(cond, F.lit(True)), F.lit(name))
    checks = F.array(F.when(~known, F.lit("no_row")), bad(F.col("m_label") != F.col("dir_label"), "label"),
                     bad(F.col("m_label") == "ambiguous", "ambiguous"), bad(F.col("m_split") != F.col("dir_split"), "split"),
                     bad(F.col("t_split") != F.col("dir_split"), "sample_split"))
    return j.select("filename", F.explode(F.array_compact(checks)).alias("problem"))


def inspection_set(manifest: DataFrame, caps: dict[str, int], order: Sequence[str] = ("sample_id", "frame_idx", "candidate_y", "candidate_x")) -> DataFrame:
    """First n rows per label in a fixed order; the rank limit is applied before the shuffle."""
    cap = F.lit(None).cast("int")
    for label, n in caps.items():
        cap = F.when(F.col("label") == label, F.lit(n)).otherwise(cap)
    most = max(caps.values())
    ranked = manifest.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= cap)
