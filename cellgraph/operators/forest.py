"""Forests of tracks: interval labels by an Euler tour, and means over children by contraction.

Both take a number of rounds that grows with the logarithm of the largest tree, whatever its depth,
and hold a few rows per track in each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ranking import rank_rows

KEY = "sample_id"


def links_of(tracks: DataFrame) -> DataFrame:
    """(sample_id, parent, child), each once; a track that names itself as parent has none."""
    return tracks.where("parent_track_id IS NOT NULL AND parent_track_id <> track_id").select(
        KEY, F.col("parent_track_id").alias("parent"), F.col("track_id").alias("child")).distinct()


def intervals(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interval labels of every node (sample_id, node) that a root leads to, and the samples where some node has no root.

    ``links`` gives a node one parent at most. The tour steps into a node, through its children by
    id, and out again; it is ranked from its end by pointer doubling. ``hi`` counts the nodes from
    this one to the end of its tree's tour, ``lo`` those after its whole subtree: u lies under v
    (or is v) if lo(v) < hi(u) <= hi(v) in one ``tree`` (named by its root). ``leaf_hi`` counts the
    leaves from this one to the end. Nodes of a cycle never reach an end: a round in which no
    pointer arrives leaves only those.
    """
    ranked = cut_lineage(rank_rows(links, "child", "child", [KEY, "parent"], "place"))
    first = ranked.where("place = 0").select(KEY, F.col("parent").alias("node"), F.col("child").alias("_to"))
    enter = nodes.join(first, [KEY, "node"], "left").select(
        KEY, "node", F.lit(False).alias("out"), F.coalesce("_to", "node").alias("to"), F.col("_to").isNull().alias("to_out"),
        F.lit(1).cast("bigint").alias("n"), F.col("_to").isNull().cast("bigint").alias("leaves"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("tree"))
    after = ranked.select(KEY, "parent", (F.col("place") - 1).alias("place"), F.col("child").alias("_next"))
    leave = (nodes.join(ranked.withColumnRenamed("child", "node"), [KEY, "node"], "left").join(after, [KEY, "parent", "place"], "left").select(
        KEY, "node", F.lit(True).alias("out"), F.coalesce("_next", "parent").alias("to"), F.col("_next").isNull().alias("to_out"),
        F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("leaves"), F.when(F.col("parent").isNull(), F.col("node")).alias("tree")))
    state = cut_lineage(enter.unionByName(leave))
    before = -1
    while (left := state.where("tree IS NULL").count()) not in (0, before):
        before = left
        onward = state.select(KEY, F.col("node").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("_to"), F.col("to_out").alias("_to_out"),
                              F.col("n").alias("_n"), F.col("leaves").alias("_leaves"), F.col("tree").alias("_tree"))
        jumped = state.where("tree IS NULL").join(onward, [KEY, "to", "to_out"]).select(
            KEY, "node", "out", F.col("_to").alias("to"), F.col("_to_out").alias("to_out"),
            (F.col("n") + F.col("_n")).alias("n"), (F.col("leaves") + F.col("_leaves")).alias("leaves"), F.col("_tree").alias("tree"))
        state = cut_lineage(jumped.unionByName(state.where("tree IS NOT NULL")))
    done = state.where("tree IS NOT NULL").groupBy(KEY, "node", "tree").agg(
        F.max("n").alias("hi"), F.min("n").alias("lo"), F.max("leaves").alias("leaf_hi"))
    return cut_lineage(done), state.where("tree IS NULL").select(KEY).distinct()


def child_means(leaves: DataFrame, links: DataFrame) -> DataFrame:
    """(sample_id, node, slot): leaves as given, every other node at the mean of its children.

    Rake and compress. A node whose children are known is computed and handed to its parent; a run
    of nodes that each wait for one child is replaced by one linear step from the run's end and is
    computed last, backwards. After that every waiting node waits for two or more, so the nodes at
    least halve in a round. ``links`` must be a forest.
    """
    parent = links.select(KEY, F.col("child").alias("node"), "parent")
    sizes = links.groupBy(KEY, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    one, zero = F.lit(1.0), F.lit(0.0)
    # a node gives scale * slot + shift to its parent
    new = cut_lineage(leaves.join(parent, [KEY, "node"], "left").select(KEY, "node", "parent", "slot", one.alias("scale"), zero.alias("shift")))
    live = sizes.join(parent, [KEY, "node"], "left").select(KEY, "node", "parent", one.alias("scale"), zero.alias("shift"), "kids",
                                                            F.col("kids").alias("need"), zero.alias("got"))
    known, put_off = new.select(KEY, "node", "slot"), []
    while True:
        given = new.where("parent IS NOT NULL").groupBy(KEY, F.col("parent").alias("node")).agg(
            F.sum(F.col("scale") * F.col("slot") + F.col("shift")).alias("_got"), F.count(F.lit(1)).alias("_n"))
        live = cut_lineage(live.join(given, [KEY, "node"], "left").select(
            KEY, "node", "parent", "scale", "shift", "kids", (F.col("need") - F.coalesce("_n", F.lit(0))).alias("need"),
            (F.col("got") + F.coalesce("_got", zero)).alias("got")))
        if live.isEmpty():
            break
        single = live.where("need = 1")
        below = live.select(KEY, F.col("parent").alias("node"), F.col("node").alias("to"), F.col("scale").alias("_a"), F.col("shift").alias("_b"),
                            (F.col("need") == 1).alias("moving"))
        runs = _run_ends(single.join(below, [KEY, "node"]).select(
            KEY, "node", "to", (F.col("_a") / F.col("kids")).alias("a"), ((F.col("got") + F.col("_b")) / F.col("kids")).alias("b"), "moving"))
        put_off.append(runs)
        inside = single.select(KEY, F.col("node").alias("parent"))
        tops = single.join(inside, [KEY, "parent"], "left_anti").join(runs, [KEY, "node"]).select(
            KEY, F.col("to").alias("node"), F.col("parent").alias("_parent"), (F.col("scale") * F.col("a")).alias("_scale"),
            (F.col("scale") * F.col("b") + F.col("shift")).alias("_shift"))
        moved = F.col("_scale").isNotNull()
        live = cut_lineage(live.where("need <> 1").join(tops, [KEY, "node"], "left").select(
            KEY, "node", F.when(moved, F.col("_parent")).otherwise(F.col("parent")).alias("parent"), F.coalesce("_scale", "scale").alias("scale"),
            F.coalesce("_shift", "shift").alias("shift"), "kids", "need", "got"))
        new = live.where("need = 0").select(KEY, "node", "parent", (F.col("got") / F.col("kids")).alias("slot"), "scale", "shift")
        known = known.unionByName(new.select(KEY, "node", "slot"))
        live = live.where("need > 1")
    for runs in reversed(put_off):
        known = cut_lineage(known)
        ends = known.select(KEY, F.col("node").alias("to"), F.col("slot").alias("_slot"))
        known = known.unionByName(runs.join(ends, [KEY, "to"]).select(KEY, "node", (F.col("a") * F.col("_slot") + F.col("b")).alias("slot")))
    return known


def _run_ends(steps: DataFrame) -> DataFrame:
    """Linear steps (node -> to: slot = a * slot(to) + b) doubled until ``to`` is no step itself."""
    steps = cut_lineage(steps)
    while not steps.where("moving").isEmpty():
        onward = steps.select(KEY, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("moving").alias("_moving"))
        jumped = steps.where("moving").join(onward, [KEY, "to"]).select(
            KEY, "node", F.col("_to").alias("to"), (F.col("a") * F.col("_a")).alias("a"), (F.col("a") * F.col("_b") + F.col("b")).alias("b"), F.col("_moving").alias("moving"))
        steps = cut_lineage(jumped.unionByName(steps.where("NOT moving")))
    return steps
