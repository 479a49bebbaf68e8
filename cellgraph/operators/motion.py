"""Speeds, track summaries and per-frame counts of a lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import UNITS_REAL, col, euclidean


def node_speeds(nodes: DataFrame, scale=1.0, dt=1.0) -> DataFrame:
    """Speed of each node that has an earlier point: the previous one of its track, or the dividing parent.

    ``nodes`` needs sample_id, node_id, t, y, x, track_id, parent_node_id. A track's first node
    counts only when its parent divided into exactly two.
    """
    from .graph import find_divisions
    from .lineage import lineage_edges

    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else col(scale)
    dt = F.lit(float(dt)) if isinstance(dt, (int, float)) else col(dt)
    order = W.partitionBy("sample_id", "track_id").orderBy("t", "node_id")
    stepped = nodes.withColumn("_prev", F.lag(F.struct("t", "y", "x")).over(order))
    forks = find_divisions(lineage_edges(nodes)).select("sample_id", "parent_node_id")
    born = nodes.select("sample_id", F.col("node_id").alias("parent_node_id"),
                        F.struct("t", "y", "x").alias("_born")).join(forks, ["sample_id", "parent_node_id"], "left_semi")
    # only first nodes of tracks look at their parent: the join carries tracks, not nodes
    heads = stepped.where("_prev IS NULL").join(born, ["sample_id", "parent_node_id"], "left")
    rest = stepped.where("_prev IS NOT NULL").withColumn("_born", F.col("_prev"))
    both = heads.withColumn("_prev", F.col("_born")).unionByName(rest).drop("_born")
    gap = (F.col("t") - F.col("_prev.t")) * dt
    return both.where("_prev IS NOT NULL AND t <> _prev.t").withColumn(
        "speed", euclidean("y", "x", "_prev.y", "_prev.x") * scale / gap).drop("_prev")


def track_summary(nodes: DataFrame, tracks: DataFrame, divs: DataFrame, speeds: DataFrame) -> DataFrame:
    mean = speeds.groupBy("sample_id", "track_id").agg(F.avg("speed").alias("avg_speed"))
    kids = divs.select("sample_id", F.col("parent_track_id").alias("track_id"),
                       F.col("children_track_ids").alias("children"))
    none = F.array().cast("array<bigint>")
    return tracks.join(mean, ["sample_id", "track_id"], "left").join(kids, ["sample_id", "track_id"], "left").select(
        "sample_id", "track_id", "parent_track_id", F.coalesce("children", none).alias("children_track_ids"),
        F.col("start_t").alias("birth_frame"), F.col("end_t").alias("death_frame"),
        (F.col("end_t") - F.col("start_t") + 1).alias("track_length"), "avg_speed")


def dataset_stats(nodes: DataFrame, tracks: DataFrame, divs: DataFrame, speeds: DataFrame, dt=1.0,
                  units: str = "px/frame") -> DataFrame:
    """One row of headline numbers; zeros when empty. Each part is a partial aggregate of its own table."""
    length = (F.col("end_t") - F.col("start_t") + 1) * F.lit(float(dt) if units == UNITS_REAL else 1.0)
    parts = [nodes.agg(F.count(F.lit(1)).alias("n_cells")),
             tracks.agg(F.count(F.lit(1)).alias("n_tracks"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_lifetime")),
             divs.agg(F.count(F.lit(1)).alias("n_divisions")),
             speeds.agg(F.coalesce(F.avg("speed"), F.lit(0.0)).alias("avg_velocity"))]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p))
    return out.withColumn("units", F.lit(units))


def cells_per_frame(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("sample_id", "t").agg(F.count(F.lit(1)).alias("n_cells"))


def divisions_per_frame(divs: DataFrame) -> DataFrame:
    """Counts per frame between the first and last division of a sample, empty frames kept."""
    counts = divs.groupBy("sample_id", "t").agg(F.count(F.lit(1)).alias("n"))
    spine = counts.groupBy("sample_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select(
        "sample_id", F.explode(F.sequence("lo", "hi")).alias("t"))
    return spine.join(counts, ["sample_id", "t"], "left").select(
        "sample_id", "t", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_divisions"))


def cumulative_divisions(divs: DataFrame) -> DataFrame:
    """Running number of divisions, one step each, ordered by (t, parent node)."""
    from .spatial import FRAME

    per = divs.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("sample_id").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(*FRAME, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*FRAME).orderBy("parent_node_id")
    return divs.join(offsets, FRAME).select(
        "sample_id", "parent_node_id", "t", (F.col("_off") + F.row_number().over(inside)).alias("n_so_far"))


def histogram_bins(n) -> Column:
    return F.least(F.lit(20), F.greatest(F.lit(5), F.floor(col(n) / 2))).cast("int")


def speed_histogram(speeds: DataFrame) -> DataFrame:
    """Equal-width bins per sample, empty ones kept, the last closed on both sides; equal speeds span one unit."""
    box = speeds.groupBy("sample_id").agg(
        F.min("speed").alias("lo"), F.max("speed").alias("hi"), histogram_bins(F.count(F.lit(1))).alias("bins"))
    flat = F.col("lo") == F.col("hi")
    box = box.select("sample_id", "bins", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                     F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.floor((F.col("speed") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))).cast("int")
    counts = speeds.select("sample_id", "speed").join(box, "sample_id").withColumn(
        "bin", F.least(at, F.col("bins") - 1)).groupBy("sample_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = box.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return spine.join(counts, ["sample_id", "bin"], "left").select(
        "sample_id", "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def cell_details(nodes: DataFrame, tracks: DataFrame, divs: DataFrame, speeds: DataFrame, t: int) -> DataFrame:
    """Everything shown about the cells of one frame; the frame filter comes before every join."""
    here = nodes.where(F.col("t") == t).select("sample_id", "node_id", "track_id", "y", "x", "parent_node_id")
    span = tracks.select("sample_id", "track_id", "parent_track_id", F.col("start_t").alias("birth_frame"),
                         F.col("end_t").alias("death_frame"), (F.col("end_t") - F.col("start_t") + 1).alias("track_length"))
    kids = divs.select("sample_id", F.col("parent_track_id").alias("track_id"), "children_track_ids")
    split = divs.select("sample_id", F.col("parent_node_id").alias("node_id"), F.lit(True).alias("_d"))
    pace = speeds.where(F.col("t") == t).select("sample_id", "node_id", "speed")
    return (here.join(span, ["sample_id", "track_id"]).join(kids, ["sample_id", "track_id"], "left")
            .join(split, ["sample_id", "node_id"], "left").join(pace, ["sample_id", "node_id"], "left")
            .withColumn("is_division", F.coalesce("_d", F.lit(False)))
            .withColumn("children_track_ids", F.coalesce("children_track_ids", F.array().cast("array<bigint>"))).drop("_d"))
