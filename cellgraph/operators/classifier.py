"""Classifier evaluation over prediction tables (sample_id, label 0/1, probability, contrast)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .ranking import average_ranks, cumulate, cut_points, exact_percentiles, rank_rows

# The sweep grid and the size of the matched groups.
THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
              0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
K_MATCHED = 20



def _positive() -> Column:
    return F.col("label") == 1


def _negative() -> Column:
    return F.col("label") == 0


def keep_confident(df: DataFrame, p: float = 0.5) -> DataFrame:
    return df.where(F.col("probability") >= p)


def _rates(tp, fp, tn, fn) -> dict[str, Column]:
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.try_divide(F.lit(2.0) * p * r, p + r),
            "specificity": F.try_divide(tn, tn + fp)}


def confusion_at(preds: DataFrame, p: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at ``probability >= p``; undefined precision, recall and F1 are 0 here."""
    sure = F.col("probability") >= p
    c = preds.groupBy(*by).agg(F.count_if(_positive() & sure).alias("tp"), F.count_if(_negative() & sure).alias("fp"),
                               F.count_if(_negative() & ~sure).alias("tn"), F.count_if(_positive() & ~sure).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    r = _rates(tp, fp, tn, fn)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    # balanced accuracy averages over the classes that occur
    classes = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return c.select("*", zero(r["precision"]).alias("precision"), zero(r["recall"]).alias("recall"),
                    zero(r["f1"]).alias("f1"), F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    F.try_divide(zero(r["recall"]) + zero(r["specificity"]), classes).alias("balanced_accuracy"))


def threshold_sweep(preds: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Confusion counts at every threshold from one pass: a row only remembers how many it passes."""
    limits = sorted(thresholds)
    passed = sum((F.when(F.col("probability") >= t, 1).otherwise(0) for t in limits), F.lit(0))
    counts = preds.groupBy(passed.alias("k")).agg(F.count_if(_positive()).alias("pos"), F.count_if(_negative()).alias("neg"))
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(limits)]))
    # at most len(thresholds)+1 rows from here on
    rows = counts.withColumn("g", grid).select("k", "pos", "neg", "g.i", "g.threshold")
    over = F.col("k") >= F.col("i")
    table = rows.groupBy("threshold").agg(
        F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~over, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(~over, F.col("pos")).otherwise(0)).alias("fn"))
    r = _rates(*(F.col(x) for x in ("tp", "fp", "tn", "fn")))
    full = table.select("*", *[c.alias(n) for n, c in r.items()])
    best = W.orderBy(F.col("f1").desc_nulls_last(), "threshold")
    return full.withColumn("is_best", (F.row_number().over(best) == 1) & F.col("f1").isNotNull())


def discrimination(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (tie-aware rank form) and average precision per group; NULL without both classes."""
    by = list(by)
    scores = cut_lineage(preds.groupBy(*by, "probability").agg(
        F.count_if(_positive()).alias("pos"), F.count_if(_negative()).alias("neg")))
    c = cumulate(scores, "probability", ["pos", "neg"], by)
    above_pos, above_neg = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    ap = F.try_divide(F.col("pos") * above_pos, (above_pos + above_neg).cast("double"))
    out = c.groupBy(*by).agg(F.sum(wins).alias("_w"), F.sum(ap).alias("_ap"), F.max("pos_total").alias("n_positive"),
                             F.max("neg_total").alias("n_negative"))
    return out.select(*by, "n_positive", "n_negative",
                      F.try_divide(F.col("_w"), (F.col("n_positive") * F.col("n_negative")).cast("double")).alias("roc_auc"),
                      F.try_divide(F.col("_ap"), F.col("n_positive").cast("double")).alias("pr_auc"))


def per_sample_discrimination(preds: DataFrame) -> DataFrame:
    means = preds.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(_positive(), F.col("probability"))).alias("mean_positive"),
        F.avg(F.when(_negative(), F.col("probability"))).alias("mean_negative"))
    return means.join(discrimination(preds, ["sample_id"]), "sample_id")


def probability_profile(preds: DataFrame) -> DataFrame:
    """Prevalence, means and medians by class, and percentiles of all probabilities; one row."""
    head = preds.agg((F.count_if(_positive()) * F.lit(100.0) / F.count(F.lit(1))).alias("prevalence_pct"),
                     F.avg(F.when(_positive(), F.col("probability"))).alias("positive_mean"),
                     F.avg(F.when(_negative(), F.col("probability"))).alias("negative_mean"))
    by_class = exact_percentiles(preds, "probability", {"median": 0.5}, ["label"])
    medians = by_class.agg(F.max(F.when(_positive(), F.col("median"))).alias("positive_median"),
                           F.max(F.when(_negative(), F.col("median"))).alias("negative_median"))
    points = exact_percentiles(preds, "probability", {f"p{q}": q / 100 for q in (5, 25, 50, 75, 90, 95)})
    return head.join(F.broadcast(medians)).join(F.broadcast(points))  # one row each


def matched_contrast(preds: DataFrame, key: str, k: int = K_MATCHED, by_sample: bool = False) -> DataFrame:
    """Each positive against the k negatives closest in contrast: mean, median and number used.

    Negatives are ranked once per side; a positive is joined only to a band of k ranks on either
    side of its insertion point, so the work is 2k rows per distinct positive contrast. Equal
    distances: left side first when pooled, list order (``key``) when per sample.
    """
    by = ["sample_id"] if by_sample else []
    neg = preds.where(_negative()).select("sample_id", key, "contrast", "probability")
    limits = cut_points(neg, "contrast")
    ranked = rank_rows(rank_rows(neg, "contrast", key, by, "rank_up", cuts=limits),
                       "contrast", key, by, "rank_down", tie_descending=True, cuts=limits)
    # insertion point of a positive = negatives strictly below it, from one merged pass over values
    pos = preds.where(_positive())
    values = (preds.select(*by, F.col("contrast").alias("q"), _negative().cast("int").alias("n"), _positive().cast("int").alias("p"))
              .groupBy(*by, "q").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))
    spots = cumulate(values, "q", ["n"], by, limits).where("p > 0").select(*by, "q", F.col("n_before").alias("at"))
    band = spots.withColumn("step", F.explode(F.sequence(F.lit(-k), F.lit(k - 1)))).withColumn("slot", F.col("at") + F.col("step"))
    side = lambda s, rank: (
        band.where("step < 0" if s == 0 else "step >= 0").drop("step", "at").join(
            ranked.select(*by, F.col(rank).alias("slot"), F.col(key).alias("neg_key"), F.col("contrast").alias("c"),
                          F.col("probability").alias("np")), [*by, "slot"]).withColumn("side", F.lit(s)))
    near = side(0, "rank_down").unionByName(side(1, "rank_up")).withColumn("gap", F.abs(F.col("c") - F.col("q")))
    order = ["gap", "neg_key"] if by_sample else ["gap", "side", "neg_key"]
    chosen = near.withColumn("rn", F.row_number().over(W.partitionBy(*by, "q").orderBy(*order))).where(F.col("rn") <= k)
    # at most k rows per group from here on
    stats = chosen.groupBy(*by, "q").agg(
        F.avg("np").alias("matched_mean"), F.percentile("np", 0.5).alias("matched_median"),
        F.count(F.lit(1)).alias("k_used"), F.min("c").alias("matched_low"), F.max("c").alias("matched_high"))
    return pos.withColumn("q", F.col("contrast")).join(stats, [*by, "q"]).select(
        "sample_id", key, "probability", "matched_mean", "matched_median", "k_used", "matched_low", "matched_high",
        (F.col("probability") - F.col("matched_mean")).alias("diff_mean"),
        (F.col("probability") - F.col("matched_median")).alias("diff_median"),
        (F.col("probability") > F.col("matched_mean")).alias("beats_mean"),
        (F.col("probability") > F.col("matched_median")).alias("beats_median"))


def contrast_summary(matched: DataFrame) -> DataFrame:
    """Win rates and the spread of the differences; one row."""
    matched = cut_lineage(matched)  # four aggregates read it; the match is the costly part
    head = matched.agg(
        F.count(F.lit(1)).alias("n_positives"), (F.avg(F.col("beats_mean").cast("double")) * 100).alias("win_mean_pct"),
        (F.avg(F.col("beats_median").cast("double")) * 100).alias("win_median_pct"),
        F.avg("probability").alias("mean_positive"), F.avg("matched_mean").alias("mean_matched"),
        F.avg("diff_mean").alias("diff_avg"), F.stddev_pop("diff_mean").alias("diff_std"),
        F.min("diff_mean").alias("diff_min"), F.max("diff_mean").alias("diff_max"))
    quart = exact_percentiles(matched, "diff_mean", {"diff_p25": 0.25, "diff_median": 0.5, "diff_p75": 0.75})
    med = exact_percentiles(matched, "probability", {"median_positive": 0.5})
    med2 = exact_percentiles(matched, "matched_median", {"median_matched": 0.5})
    return head.join(F.broadcast(quart)).join(F.broadcast(med)).join(F.broadcast(med2))  # one row each


def rank_by_delta(matched: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n worst and n best positives by difference; both limits are taken before any full sort."""
    worst = matched.orderBy("diff_mean", key).limit(n).withColumn("which", F.lit("worst"))
    best = matched.orderBy(F.col("diff_mean").desc(), F.col(key).desc()).limit(n).withColumn("which", F.lit("best"))
    return worst.unionByName(best)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman of two columns; NULL for constant input."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    ranked = full.join(average_ranks(full, x, "_rx"), x).join(average_ranks(full, y, "_ry"), y)

    def safe(a: str, b: str) -> Column:
        return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))

    return full.agg(safe(x, y).alias("pearson")).join(F.broadcast(ranked.agg(safe("_rx", "_ry").alias("spearman"))))


def eps_amplification(preds: DataFrame, eps: float, pct: float = 5.0) -> DataFrame:
    """How much the stabiliser weighs in the flattest patches, per sample and label.

    ``preds`` carries raw_mean and raw_std of each patch.
    """
    by = ["sample_id", "label"]
    cut = exact_percentiles(preds, "raw_std", {"cut": pct / 100})
    flat = preds.join(F.broadcast(cut)).withColumn("low", (F.col("raw_std") <= F.col("cut")).cast("double"))

    def safe(a: str) -> Column:
        ok = (F.count(F.lit(1)) > 1) & (F.stddev_pop(a) > 0) & (F.stddev_pop("probability") > 0)
        return F.when(ok, F.corr(a, "probability"))

    head = flat.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.lit(eps) / (F.col("raw_std") + eps)).alias("mean_eps_share"),
        F.avg("low").alias("low_share"), F.max("cut").alias("cut"), F.avg("probability").alias("prob_mean"),
        safe("raw_std").alias("corr_std"), safe("raw_mean").alias("corr_mean"))
    stds = exact_percentiles(preds, "raw_std", {"std_p25": 0.25, "std_p50": 0.5, "std_p75": 0.75}, by)
    probs = exact_percentiles(preds, "probability", {"prob_median": 0.5}, by)
    return head.join(stds, by).join(probs, by)


def losses(preds: DataFrame, logit: str = "logit", gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """Mean cross-entropy and mean focal loss, from logits in the form that cannot overflow."""
    z, y = F.col(logit), F.col("label").cast("double")
    bce = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    pt = F.exp(-bce)
    return preds.agg(F.avg(bce).alias("bce"), F.avg(F.lit(alpha) * F.pow(1 - pt, F.lit(gamma)) * bce).alias("focal"))


def top_false_positives(preds: DataFrame, key: str, n: int = 25, p: float = 0.5) -> DataFrame:
    """Top-n negatives by probability, each with the overall and own-sample count of false positives."""
    per = preds.where(_negative()).groupBy("sample_id").agg(
        F.count_if(F.col("probability") >= p).alias("sample_fp"), F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("sample_fp").alias("n_fp"), (F.sum("sample_fp") * 100.0 / F.sum("_n")).alias("fp_rate_pct"))
    top = preds.where(_negative()).orderBy(F.col("probability").desc(), key).limit(n)
    return top.select("sample_id", key, "probability").join(F.broadcast(total)).join(per.drop("_n"), "sample_id")


def stratified_cases(preds: DataFrame, key: str, exclude: DataFrame | None = None, top: int = 30, each: int = 4) -> DataFrame:
    """Inspection cases among the most confident negatives: near, intermediate and far from the truth."""
    pool = preds.where(_negative()).orderBy(F.col("probability").desc(), key).limit(top)
    if exclude is not None:
        pool = pool.join(exclude.select(key), key, "left_anti")
    d = F.col("distance")
    pool = pool.withColumn("stratum", F.when(d < 60, "near").when(d < 100, "intermediate").when(d >= 100, "far")).where(
        "stratum IS NOT NULL")
    rank = F.when(F.col("stratum") == "far", -F.col("probability")).otherwise(d)
    order = W.partitionBy("stratum").orderBy("_by", key)
    return pool.withColumn("_by", rank).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).drop("_by")


def reproduce_check(metrics: DataFrame, reported: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Metrics (sample_id, metric, value) that differ from the recorded ones, or miss a partner row.

    A metric without a value on either side has nothing to differ by.
    """
    mine, theirs = metrics.withColumn("_a", F.lit(1)), reported.withColumnRenamed("value", "recorded").withColumn("_b", F.lit(1))
    both = mine.join(theirs, ["sample_id", "metric"], "full_outer")
    off = F.abs(F.col("value") - F.col("recorded")) > tol
    return both.where(off | F.col("_a").isNull() | F.col("_b").isNull()).drop("_a", "_b")


def cross_validate(preds: DataFrame, manifest: DataFrame, split: DataFrame, key: str = "filename", wanted: str = "test") -> DataFrame:
    """One row per (prediction, failed check)."""
    rows = manifest.select(F.col(key), F.col("label").alias("m_label"), F.col("split").alias("m_split"), F.col("sample_id").alias("m_sample"),
                           F.lit(True).alias("known"))
    table = split.select(F.col("sample_id").alias("m_sample"), F.col("split").alias("t_split"))
    j = preds.join(rows, key, "left").join(table, "m_sample", "left")
    value = F.when(F.col("m_label") == "positive", 1).when(F.col("m_label") == "negative", 0)
    known = F.coalesce("known", F.lit(False))
    bad = lambda ok, name: F.when(known & ~F.coalesce(ok, F.lit(False)), F.lit(name))
    checks = F.array(
        F.when(~known, F.lit("not_in_manifest")), bad(value == F.col("label"), "label"),
        bad(F.col("m_split") == wanted, "split"), bad(F.col("m_sample") == F.col("sample_id"), "sample"),
        bad(F.col("t_split") == wanted, "split_table"))
    return j.withColumn("problem", F.explode(F.array_compact(checks))).select(key, "problem")


def matched_set_checks(preds: DataFrame, manifest: DataFrame, samples: DataFrame, key: str = "filename", wanted: str = "test") -> DataFrame:
    """Integrity checks between predictions and the manifest rows they name: (check, n), only those that fail."""
    ids = preds.select(key)
    matched = manifest.join(ids.distinct(), key, "left_semi")
    n_pred, n_match = ids.agg(F.count(F.lit(1)).alias("n")), matched.agg(F.count(F.lit(1)).alias("n"))
    extra = lambda df: df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("n"))
    known = samples.select("sample_id").distinct()
    seen = matched.select("sample_id").distinct()
    rows = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    gap = n_pred.withColumnRenamed("n", "a").join(F.broadcast(n_match.withColumnRenamed("n", "b"))).select(
        F.abs(F.col("a") - F.col("b")).alias("n"))
    parts = {
        "duplicate_predictions": extra(ids), "duplicate_manifest": extra(matched.select(key)),
        "missing_in_manifest": rows(ids.distinct().join(matched.select(key), key, "left_anti")), "count_gap": gap,
        "wrong_split": rows(matched.where(~F.col("split").eqNullSafe(wanted))),
        "foreign_sample": rows(matched.join(known, "sample_id", "left_anti")),
        "sample_set_gap": rows(seen.exceptAll(known).union(known.exceptAll(seen)))}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("check"), F.col("n").cast("bigint").alias("n"))
        out = one if out is None else out.union(one)
    return out.where("n > 0")


def gt_contamination(preds: DataFrame, boxes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions with a box record, and those with ground truth inside; one row."""
    j = preds.join(boxes.select(*key, "n_inside"), list(key), "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("n_inside").alias("n_joined"),
                 F.count_if(F.col("n_inside") > 0).alias("n_contaminated"))


def join_distance(preds: DataFrame, distances: DataFrame) -> DataFrame:
    """Distances joined on the key held in the file name; a missing partner is an error."""
    from ..functions.scalar import parse_patch_name

    parts = parse_patch_name("filename")
    keyed = preds.drop("sample_id").select("*", *[c.alias(n) for n, c in parts.items()])
    j = keyed.join(distances.withColumn("_found", F.lit(True)), list(parts), "left")
    checked = F.when(F.col("_found"), F.col("distance")).otherwise(
        F.raise_error(F.concat(F.lit("no distance row for "), F.col("filename"))).cast("double"))
    return j.withColumn("distance", checked).drop("_found")


def compare_runs(base: DataFrame, cand: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Keys in both runs: both values and the difference of every metric."""
    a = base.select(key, *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    b = cand.select(key, *[F.col(m).alias(f"candidate_{m}") for m in metrics])
    return a.join(b, key).select("*", *[(F.col(f"candidate_{m}") - F.col(f"baseline_{m}")).alias(f"delta_{m}") for m in metrics])


def delta_summary(compared: DataFrame, metrics: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{m}', delta_{m}" for m in metrics)
    long = compared.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, delta)").where("delta IS NOT NULL")
    return long.groupBy("metric").agg(
        F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("worsened"),
        F.count_if(F.col("delta") == 0).alias("unchanged"), F.avg("delta").alias("mean_delta"))


def weighted_mean_error(samples: DataFrame, mean: str = "mean_error", weight: str = "tp") -> DataFrame:
    ok = samples.where(F.col(mean).isNotNull())
    return ok.agg(F.try_divide(F.sum(F.col(mean) * F.col(weight)), F.sum(weight)).alias("weighted_mean_error"))


def run_comparison(values: DataFrame, a: str, b: str, criteria: dict[str, tuple[str, float]], spread_of: str | None = None) -> DataFrame:
    """Long table of two runs: (metric, sample_id NULL for whole-run) -> a, b, delta, criterion met.

    ``criteria``: metric -> ("up" | "down", least change). ``spread_of`` adds max-min of a per-sample metric.
    """
    one = lambda r: F.max(F.when(F.col("run") == r, F.col("value")))
    wide = values.where(F.col("run").isin(a, b)).groupBy("metric", "sample_id").agg(one(a).alias("a"), one(b).alias("b"))
    if spread_of:
        per = values.where((F.col("metric") == spread_of) & F.col("sample_id").isNotNull() & F.col("value").isNotNull())
        gap = per.groupBy("run").agg(F.when(F.count(F.lit(1)) >= 2, F.max("value") - F.min("value")).alias("value"))
        wide = wide.unionByName(gap.where(F.col("run").isin(a, b)).groupBy(
            F.lit(f"{spread_of}_spread").alias("metric"), F.lit(None).cast("string").alias("sample_id")).agg(
            one(a).alias("a"), one(b).alias("b")))
    met = F.lit(None).cast("boolean")
    for metric, (way, least) in criteria.items():
        change = F.col("b") - F.col("a") if way == "up" else F.col("a") - F.col("b")
        met = F.when(F.col("metric") == metric, change > least).otherwise(met)
    return wide.withColumn("delta", F.col("b") - F.col("a")).withColumn("met", met)


def best_epoch(epochs: DataFrame, metric: str = "val_pr_auc") -> DataFrame:
    best = F.max_by(F.struct("epoch", metric), F.struct(metric, -F.col("epoch")))
    return epochs.where(F.col(metric).isNotNull()).groupBy("run").agg(best.alias("b")).select("run", "b.epoch", f"b.{metric}")


def early_stop(epochs: DataFrame, patience: int, metric: str = "val_loss", larger: bool = False) -> DataFrame:
    """First epoch with ``patience`` epochs behind it since the last strict improvement; NULL if none."""
    order = W.partitionBy("run").orderBy("epoch")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    best = F.max(metric).over(past) if larger else F.min(metric).over(past)
    now = F.col(metric)
    better = best.isNull() | (now > best if larger else now < best)
    rows = epochs.withColumn("_i", F.row_number().over(order)).withColumn("_up", better)
    last = F.max(F.when(F.col("_up"), F.col("_i"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_gap", F.col("_i") - last).groupBy("run").agg(
        F.min(F.when(F.col("_gap") >= patience, F.col("epoch"))).alias("stop_epoch"))
