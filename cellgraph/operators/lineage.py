"""Track graphs: numbering, tracks, divisions, and what can be read off them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .graph import find_divisions
from .spatial import FRAME

BLOCK = 1 << 18  # list positions per numbering block: bounds what one task sorts


def _numbered(det: DataFrame, links: DataFrame) -> DataFrame:
    """Every detection with its parent position and the dense node and track-start numbers.

    Order inside a frame: linked points by (prev_idx, step, curr_idx), then new points by position.
    Frames are cut into blocks of list positions, so a crowded frame is numbered by many tasks.
    """
    siblings = links.groupBy("sample_id", "t", "prev_idx").agg(F.count(F.lit(1)).alias("n_children"))
    inward = links.join(siblings, ["sample_id", "t", "prev_idx"]).select(
        "sample_id", "t", F.col("curr_idx").alias("idx"), "prev_idx", "step", "n_children")
    rows = (det.select("sample_id", "t", F.col("idx").cast("bigint").alias("idx"), "y", "x")
            .join(inward, ["sample_id", "t", "idx"], "left")
            .withColumn("fresh", F.col("prev_idx").isNull())
            .withColumn("major", F.coalesce("prev_idx", "idx"))
            .withColumn("starts", F.col("fresh") | (F.col("n_children") == 2))
            .withColumn("block", F.floor(F.col("major") / BLOCK)))
    per_block = rows.groupBy("sample_id", "t", "fresh", "block").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("starts").alias("s"))
    before = W.partitionBy("sample_id").orderBy("t", "fresh", "block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        "sample_id", "t", "fresh", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_off"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_off"))
    inside = W.partitionBy("sample_id", "t", "fresh", "block").orderBy("major", "step", "idx")
    return (rows.join(offsets, ["sample_id", "t", "fresh", "block"])
            .withColumn("node_id", F.col("n_off") + F.row_number().over(inside) - 1)
            .withColumn("own_track", F.when(F.col("starts"), F.col("s_off") + F.sum(
                F.col("starts").cast("bigint")).over(inside.rowsBetween(W.unboundedPreceding, 0)))))


def canonical_ids(det: DataFrame, links: DataFrame) -> DataFrame:
    """Node ids from 0 in canonical order, with the parent's node id."""
    rows = _numbered(det, links)
    ids = rows.select("sample_id", (F.col("t") + 1).cast("int").alias("t"), F.col("idx").alias("prev_idx"),
                      F.col("node_id").alias("parent_node_id"))
    return rows.join(ids, ["sample_id", "t", "prev_idx"], "left").select(
        "sample_id", "node_id", "t", "idx", "y", "x", "parent_node_id", "starts", "own_track")


def build_lineage(det: DataFrame, links: DataFrame) -> DataFrame:
    """Lineage nodes. A lone child continues its parent's track; two children start tracks of their own.

    A track's head is found by pointer doubling over the frames: log2(frames) joins, no frame loop.
    """
    nodes = cut_lineage(canonical_ids(det, links))
    span = nodes.agg((F.max("t") - F.min("t")).alias("d")).first()["d"] or 0
    hops = nodes.select("sample_id", "node_id", F.when(F.col("starts"), F.col("node_id")).otherwise(
        F.col("parent_node_id")).alias("head"))
    for _ in range(max(0, math.ceil(math.log2(span + 1))) if span else 0):
        nxt = hops.select("sample_id", F.col("node_id").alias("head"), F.col("head").alias("_far"))
        hops = cut_lineage(hops.join(nxt, ["sample_id", "head"]).select("sample_id", "node_id", F.col("_far").alias("head")))
    own = nodes.where("starts").select("sample_id", F.col("node_id").alias("head"), F.col("own_track").alias("track_id"))
    tracked = hops.join(own, ["sample_id", "head"]).select("sample_id", "node_id", "track_id")
    return nodes.join(tracked, ["sample_id", "node_id"]).select(
        "sample_id", "node_id", "t", "y", "x", "track_id", "parent_node_id")


def link_plain(det: DataFrame, links: DataFrame):
    """Node and edge tables for one-to-one links without divisions."""
    nodes = canonical_ids(det, links.withColumn("step", F.lit(0)) if "step" not in links.columns else links)
    edges = nodes.where("parent_node_id IS NOT NULL").select(
        "sample_id", F.col("parent_node_id").alias("src"), F.col("node_id").alias("dst"))
    return nodes.select("sample_id", "node_id", "t", "y", "x"), edges


def lineage_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_node_id IS NOT NULL").select(
        "sample_id", F.col("parent_node_id").alias("src"), F.col("node_id").alias("dst"))


def divisions(nodes: DataFrame) -> DataFrame:
    """Division rows of a lineage: parent and children, nodes and tracks, frame of the children."""
    forks = find_divisions(lineage_edges(nodes))
    place = nodes.select("sample_id", "node_id", "track_id", "t")

    def at(df, column, track):
        look = place.select("sample_id", F.col("node_id").alias(column), F.col("track_id").alias(track),
                            F.col("t").alias(f"_{track}"))
        return df.join(look, ["sample_id", column])

    full = at(at(at(forks, "parent_node_id", "parent_track_id"), "child_a", "track_a"), "child_b", "track_b")
    return full.select("sample_id", "parent_node_id", "parent_track_id",
                       F.array("child_a", "child_b").alias("children_node_ids"),
                       F.array("track_a", "track_b").alias("children_track_ids"), F.col("_track_a").alias("t"))


def tracks_of(nodes: DataFrame) -> DataFrame:
    """Span and parent of every track; the parent is the track of the first node's parent."""
    spans = nodes.groupBy("sample_id", "track_id").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"),
        F.min(F.struct("t", F.col("parent_node_id").alias("p"))).alias("_first"))
    owner = nodes.select("sample_id", F.col("node_id").alias("_p"), F.col("track_id").alias("parent_track_id"))
    return spans.withColumn("_p", F.col("_first.p")).join(owner, ["sample_id", "_p"], "left").select(
        "sample_id", "track_id", "start_t", "end_t", "parent_track_id")


def rebuild_from_nodes(table: DataFrame):
    """Tracks, edges and divisions from a stored node table with its division flag."""
    tracks = table.groupBy("sample_id", "track_id").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"),
        F.min(F.struct("node_id", F.col("parent_track_id").alias("p")))["p"].alias("parent_track_id"))
    edges = lineage_edges(table)
    parents = table.where("is_division_parent").select(
        "sample_id", F.col("node_id").alias("parent_node_id"), F.col("track_id").alias("parent_track_id"))
    kids = table.where("parent_node_id IS NOT NULL").select(
        "sample_id", "parent_node_id", F.struct("node_id", "track_id", "t").alias("c"))
    # only flagged parents keep a list, and a parent has at most two children
    divs = kids.join(parents, ["sample_id", "parent_node_id"]).groupBy(
        "sample_id", "parent_node_id", "parent_track_id").agg(F.array_sort(F.collect_list("c")).alias("c")).select(
        "sample_id", "parent_node_id", "parent_track_id", F.col("c.node_id").alias("children_node_ids"),
        F.col("c.track_id").alias("children_track_ids"), F.col("c")[0]["t"].alias("t"))
    return tracks, edges, divs


def flag_division_parents(nodes: DataFrame, divs: DataFrame, tracks: DataFrame) -> DataFrame:
    """The stored track-file layout: parent track and the dividing flag added to each node."""
    marked = divs.select("sample_id", F.col("parent_node_id").alias("node_id")).distinct().withColumn("_d", F.lit(True))
    parent = tracks.select("sample_id", "track_id", "parent_track_id")
    return nodes.join(marked, ["sample_id", "node_id"], "left").join(parent, ["sample_id", "track_id"], "left").select(
        "sample_id", "node_id", "t", "y", "x", "track_id", "parent_node_id", "parent_track_id",
        F.coalesce("_d", F.lit(False)).alias("is_division_parent"))


def division_report(divs: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per division and child: frame, the parent's span, the child's span and length."""
    span = lambda who: tracks.select(
        "sample_id", F.col("track_id").alias(f"{who}_track_id"), F.col("start_t").alias(f"{who}_start"),
        F.col("end_t").alias(f"{who}_end"))
    kids = divs.select("sample_id", "parent_node_id", "parent_track_id", "t",
                       F.explode("children_track_ids").alias("child_track_id"))
    return (kids.join(span("parent"), ["sample_id", "parent_track_id"])
            .join(span("child"), ["sample_id", "child_track_id"])
            .withColumn("child_length", F.col("child_end") - F.col("child_start") + 1))


def to_ctc_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.select("sample_id", "track_id", "start_t", "end_t",
                         F.coalesce("parent_track_id", F.lit(0)).cast("bigint").alias("parent_track_id")
                         ).orderBy("sample_id", "track_id")


def trail(nodes: DataFrame, t: int, k: int = 5) -> DataFrame:
    """Recent path of every track at frame t; a path holds at most k+1 points."""
    recent = nodes.where((F.col("t") >= t - k) & (F.col("t") <= t))
    return recent.groupBy("sample_id", "track_id").agg(
        F.array_sort(F.collect_list(F.struct("t", "y", "x"))).alias("path"))


def limit_frames(nodes: DataFrame, edges: DataFrame, n: int):
    kept = nodes.where(F.col("t") < n)
    ids = kept.select("sample_id", "node_id")
    inside = (edges.join(ids.withColumnRenamed("node_id", "src"), ["sample_id", "src"], "left_semi")
              .join(ids.withColumnRenamed("node_id", "dst"), ["sample_id", "dst"], "left_semi"))
    return kept, inside.select(*edges.columns)


def consecutive_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both known and exactly one frame apart."""
    at = lambda side: nodes.select("sample_id", F.col("node_id").alias(side), F.col("t").alias(f"_{side}"))
    return (edges.join(at("src"), ["sample_id", "src"]).join(at("dst"), ["sample_id", "dst"])
            .where("_dst = _src + 1").select(*edges.columns))
