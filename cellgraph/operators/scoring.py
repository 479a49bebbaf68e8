"""Scores of a predicted track graph against sparse ground truth. All results are per sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import adjusted_jaccard, final_score, jaccard
from ..session import cut_lineage
from .graph import components, find_divisions
from .lineage import build_lineage, consecutive_only, lineage_edges, link_plain
from .matching import build_links, link_frames, match_global

S = "sample_id"


def match_nodes(pred_nodes: DataFrame, gt_nodes: DataFrame, max_distance: float = 7.0) -> DataFrame:
    """(sample_id, pred_id, gt_id) by least total distance per frame. Node ids must be integers."""
    got = match_global(pred_nodes, gt_nodes, max_distance, a_id="node_id", b_id="node_id")
    return got.select(S, F.col("a_id").alias("pred_id"), F.col("b_id").alias("gt_id"))


def edge_confusion(pred_edges: DataFrame, gt_edges: DataFrame, match: DataFrame,
                   pred_nodes: DataFrame | None = None, gt_nodes: DataFrame | None = None) -> DataFrame:
    """TP, FP, FN of edges. With node tables given, only edges between adjacent frames count."""
    pred = consecutive_only(pred_edges, pred_nodes) if pred_nodes is not None else pred_edges
    truth = (consecutive_only(gt_edges, gt_nodes) if gt_nodes is not None else gt_edges).select(S, "src", "dst").distinct()
    side = lambda end, out: match.select(S, F.col("pred_id").alias(end), F.col("gt_id").alias(out))
    seen = (pred.select(S, "src", "dst").distinct()
            .join(side("src", "gs"), [S, "src"], "left").join(side("dst", "gd"), [S, "dst"], "left")
            .where("gs IS NOT NULL OR gd IS NOT NULL"))  # edges outside the annotation are ignored
    real = truth.select(S, F.col("src").alias("gs"), F.col("dst").alias("gd"), F.lit(True).alias("hit"))
    outward = truth.select(S, F.col("src").alias("gs"), F.lit(True).alias("has_out")).distinct()
    inward = truth.select(S, F.col("dst").alias("gd"), F.lit(True).alias("has_in")).distinct()
    judged = (seen.join(real, [S, "gs", "gd"], "left").join(outward, [S, "gs"], "left").join(inward, [S, "gd"], "left"))
    # copies of one ground-truth edge collapse before they are counted
    hits = judged.where("hit").select(S, "gs", "gd").distinct().groupBy(S).agg(F.count(F.lit(1)).alias("tp"))
    wrong = judged.where("hit IS NULL AND (has_out OR has_in)").groupBy(S).agg(F.count(F.lit(1)).alias("fp"))
    total = truth.groupBy(S).agg(F.count(F.lit(1)).alias("n_gt"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return (total.join(hits, S, "full_outer").join(wrong, S, "full_outer")
            .select(S, zero("tp").alias("tp"), zero("fp").alias("fp"), (zero("n_gt") - zero("tp")).alias("fn")))


def division_confusion(pred_edges: DataFrame, gt_edges: DataFrame, match: DataFrame) -> DataFrame:
    """TP, FP, FN of divisions per sample.

    A division counts when its earlier side (divider or the divider's parent) and both daughter
    lines (child or grandchild) are matched, all inside one predicted component that holds a fork.
    """
    # copies of an edge change neither divisions, components nor who is near: nothing is made distinct first
    pred, truth = pred_edges.select(S, "src", "dst"), gt_edges.select(S, "src", "dst")
    pairs = match.select(S, "pred_id", "gt_id")
    forks = find_divisions(pred).select(S, F.col("parent_node_id").alias("pred_id"))
    label = components(pred).select(S, F.col("node").alias("pred_id"), F.col("component").alias("comp"))

    real = cut_lineage(find_divisions(truth).withColumnRenamed("parent_node_id", "divider"))
    member = lambda part, node: F.struct(F.lit(part).alias("part"), F.col(node).alias("gt_id"))
    own = real.select(S, "divider", F.inline(F.array(member("before", "divider"), member("a", "child_a"), member("b", "child_b"))))
    above = truth.select(S, F.col("dst").alias("divider"), F.lit("before").alias("part"), F.col("src").alias("gt_id"))
    below = truth.select(S, F.col("src").alias("gt_id"), F.col("dst").alias("_next"))
    family = (own.unionByName(real.select(S, "divider").join(above, [S, "divider"]))
              .unionByName(own.where("part <> 'before'").join(below, [S, "gt_id"]).select(S, "divider", "part", F.col("_next").alias("gt_id"))))
    # only forks and the matched family look up their component, both in one join
    asked = family.join(pairs, [S, "gt_id"]).select(S, "pred_id", "divider", "part").unionByName(
        forks.withColumn("part", F.lit("fork")), allowMissingColumns=True)
    placed = cut_lineage(asked.join(label, [S, "pred_id"], "left"))
    fork_comps = placed.where("part = 'fork' AND comp IS NOT NULL").select(S, "pred_id", "comp")
    seen = placed.where("part <> 'fork'").withColumn("comp", F.coalesce("comp", "pred_id"))
    verdict = seen.groupBy(S, "divider").agg(
        F.max((F.col("part") == "before").cast("int")).alias("p"), F.max((F.col("part") == "a").cast("int")).alias("a"),
        F.max((F.col("part") == "b").cast("int")).alias("b"),
        F.min("comp").alias("comp"), F.max("comp").alias("_top"))
    found = verdict.where("p = 1 AND a = 1 AND b = 1 AND comp = _top").join(fork_comps, [S, "comp"], "left_semi")

    annotated = truth.select(S, F.col("src").alias("gt_id")).union(truth.select(S, "dst"))
    claimed = fork_comps.join(pairs, [S, "pred_id"]).join(annotated, [S, "gt_id"], "left_semi")
    spare = claimed.join(found.select(S, "comp").distinct(), [S, "comp"], "left_anti")
    n = lambda df, name: df.groupBy(S).agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return (n(real, "n_real").join(n(found, "tp"), S, "full_outer").join(n(spare, "fp"), S, "full_outer")
            .select(S, zero("tp").alias("tp"), zero("fp").alias("fp"), (zero("n_real") - zero("tp")).alias("fn")))


def score_tracking(pred_nodes: DataFrame, pred_edges: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame,
                   estimates: DataFrame | None = None, max_distance: float = 7.0, match: DataFrame | None = None) -> DataFrame:
    """All scores, one row per annotated sample.

    ``estimates`` (sample_id, n_estimate) is the outside guess of the true node count; without
    it the adjusted and final scores are NULL.
    """
    pairs = match if match is not None else cut_lineage(match_nodes(pred_nodes, gt_nodes, max_distance))
    edges = edge_confusion(pred_edges, gt_edges, pairs, pred_nodes, gt_nodes).select(
        S, F.col("tp").alias("edge_tp"), F.col("fp").alias("edge_fp"), F.col("fn").alias("edge_fn"))
    divs = division_confusion(pred_edges, gt_edges, pairs).select(
        S, F.col("tp").alias("division_tp"), F.col("fp").alias("division_fp"), F.col("fn").alias("division_fn"))
    n_gt = gt_nodes.groupBy(S).agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = pred_nodes.groupBy(S).agg(F.count(F.lit(1)).alias("n_pred"))
    hit = pairs.groupBy(S).agg(F.count_distinct("gt_id").alias("n_hit"))
    out = n_gt.join(n_pred, S, "left").join(hit, S, "left").join(edges, S, "left").join(divs, S, "left")
    if estimates is not None:
        out = out.join(estimates.select(S, F.col("n_estimate").cast("double").alias("n_estimate")), S, "left")
    else:
        out = out.withColumn("n_estimate", F.lit(None).cast("double"))
    counts = ["n_pred", "n_hit", "edge_tp", "edge_fp", "edge_fn", "division_tp", "division_fp", "division_fn"]
    out = out.fillna(0, counts)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    out = (out.withColumn("raw_edge_jaccard", jaccard("edge_tp", "edge_fp", "edge_fn"))
           .withColumn("division_jaccard", jaccard("division_tp", "division_fp", "division_fn"))
           .withColumn("adjusted_edge_jaccard", F.when(F.col("n_estimate") > 0, adjusted_jaccard(
               "raw_edge_jaccard", "n_pred", "n_estimate")))
           .withColumn("final_score", final_score("adjusted_edge_jaccard", "division_jaccard"))
           .withColumn("edge_precision", ratio("edge_tp", "edge_fp")).withColumn("edge_recall", ratio("edge_tp", "edge_fn"))
           .withColumn("node_detection_rate", F.col("n_hit") / F.col("n_gt")))
    return out.select(S, "raw_edge_jaccard", "adjusted_edge_jaccard", "division_jaccard", "final_score", "edge_precision",
                      "edge_recall", "node_detection_rate", "edge_tp", "edge_fp", "edge_fn", "division_tp", "division_fp",
                      "division_fn")


def adjusted_mean(scores: DataFrame) -> DataFrame:
    """Weighted mean of the adjusted edge score, weights tp + fp + fn; 0 without weight."""
    w = F.col("tp") + F.col("fp") + F.col("fn")
    value = adjusted_jaccard(jaccard("tp", "fp", "fn"), "n_pred", "n_estimate")
    return scores.agg(F.coalesce(F.try_divide(F.sum(w * value), F.sum(w)), F.lit(0.0)).alias("adjusted_mean"))


def benchmark_methods(det: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, methods: dict[str, dict],
                      estimates: DataFrame | None = None, external: dict[str, tuple[DataFrame, DataFrame]] | None = None,
                      dataset: str = "dataset", max_distance: float = 7.0,
                      costs: DataFrame | None = None) -> DataFrame:
    """One row per (dataset, method, sample); all methods are scored in one job, the method being part of the key.

    A method is ``{"matcher": name or callable, "max_distance": d, "divisions": True, "division_distance": d}``.
    ``external`` maps a name to ready (nodes, edges). ``costs`` (method, runtime_seconds,
    memory_delta_mb) is optional outside knowledge; without it both columns are NULL.
    """
    built: dict[str, tuple[DataFrame, DataFrame]] = {}
    for name, m in methods.items():
        matcher: str | Callable = m.get("matcher", "global")
        if m.get("divisions", True):
            links = build_links(det, m.get("max_distance", 25.0), m.get("division_distance", 30.0), matcher)
            nodes = cut_lineage(build_lineage(det, links))  # read five times below
            built[name] = (nodes.select(S, "node_id", "t", "y", "x"), lineage_edges(nodes))
        else:
            nodes, edges = link_plain(det, cut_lineage(link_frames(det, m.get("max_distance", 25.0), matcher)))
            built[name] = (cut_lineage(nodes), cut_lineage(edges))
    built.update(external or {})

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(S, F.concat(F.lit(name + "\u0001"), F.col(S)))

    def stack(pick: Callable[[str], DataFrame]) -> DataFrame:
        parts = [tag(pick(name), name) for name in built]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    nodes = stack(lambda n: built[n][0])
    match = cut_lineage(match_nodes(nodes, stack(lambda n: gt_nodes), max_distance))
    scores = score_tracking(
        nodes, stack(lambda n: built[n][1]), stack(lambda n: gt_nodes), stack(lambda n: gt_edges),
        stack(lambda n: estimates) if estimates is not None else None, max_distance, match)
    part = F.split(F.col(S), "\u0001")
    rows = scores.withColumn("method", part[0]).withColumn(S, part[1]).withColumn("dataset", F.lit(dataset))
    if costs is not None:
        return rows.join(costs, "method", "left")
    none = F.lit(None).cast("double")
    return rows.withColumn("runtime_seconds", none).withColumn("memory_delta_mb", none)
