"""Graph operators over edge tables: divisions, components, descendants, tree layout."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import Spool, cut_lineage
from . import forest


def find_divisions(edges: DataFrame) -> DataFrame:
    """Sources with exactly two distinct targets: parent_node_id, child_a < child_b."""
    return (edges.select("sample_id", "src", "dst").groupBy("sample_id", "src")
            .agg(F.min("dst").alias("child_a"), F.max("dst").alias("child_b"), F.count_distinct("dst").alias("_n"))
            .where("_n = 2").select("sample_id", F.col("src").alias("parent_node_id"), "child_a", "child_b"))


def gt_division_count(edges: DataFrame) -> DataFrame:
    """Per sample: sources with two or more targets (rows counted, copies included)."""
    forks = edges.groupBy("sample_id", "src").agg(F.count(F.lit(1)).alias("n"))
    return forks.groupBy("sample_id").agg(F.count_if(F.col("n") >= 2).alias("n_divisions"))


#: Edges whose ends lie in the same two blocks of 2^12 ids meet in a task, which contracts so many edges at once.
ID_BLOCK_BITS, CHUNK_EDGES = 12, 1 << 19


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Undirected components: (sample_id, node, component = smallest node id). Node ids must be integers.

    Tasks contract the edges they hold, so that a run of near ids costs one step; a node that several
    chunks saw takes the least root, and the other roots are linked to it. Only these links, between
    roots, go through ``_linked``. A hub is a row per chunk, never a neighbour list.
    """
    key = "sample_id"
    ends = edges.select(key, "src", "dst")
    kind = ends.schema["src"].dataType
    # greatest and least skip nulls: a lone end counts as linked with itself
    pairs = ends.select(key, F.greatest("src", "dst").cast("bigint").alias("u"), F.least("src", "dst").cast("bigint").alias("v")).where(
        f"{key} IS NOT NULL AND u IS NOT NULL")
    blocks = [key, F.shiftright("u", ID_BLOCK_BITS), F.shiftright("v", ID_BLOCK_BITS)]
    schema = StructType([ends.schema[key], StructField("node", LongType()), StructField("root", LongType())])
    by_root = W.partitionBy(key, "node").orderBy("root")
    stars = cut_lineage(pairs.repartition(*blocks).sortWithinPartitions(*blocks).mapInArrow(_stars, schema).select(
        "*", F.first("root").over(by_root).alias("least"), F.row_number().over(by_root).alias("nth")))
    label = stars.where("nth = 1").select(key, "node", F.col("least").alias("root"))
    links = cut_lineage(stars.where("root <> least").select(key, F.col("root").alias("u"), F.col("least").alias("v")).distinct())
    if not links.isEmpty():
        top = _linked(links, max_rounds).select(key, F.col("node").alias("root"), F.col("root").alias("_r"))
        label = label.join(top, [key, "root"], "left").select(key, "node", F.coalesce("_r", "root").alias("root"))
    unnamed = ends.where(f"{key} IS NULL OR src IS NULL OR dst IS NULL").select(key, F.explode(F.array("src", "dst")).alias("node")).where(
        f"{key} IS NULL OR node IS NULL").distinct()
    return label.select(key, F.col("node").cast(kind).alias("node"), F.col("root").cast(kind).alias("component")).unionByName(
        unnamed.withColumn("component", F.col("node")))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sample_id, node, root): every node of a chunk of edges with the least node that the chunk links it to."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_EDGES:
            yield _star(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _star(pa.Table.from_batches(held))


def _star(edges: pa.Table) -> pa.RecordBatch:
    names = edges["sample_id"].combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    code = np.tile(names.indices.to_numpy(), 2)
    ids = np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()])
    order = np.lexsort((ids, code))
    code, ids = code[order], ids[order]
    new = np.append(True, (code[1:] != code[:-1]) | (ids[1:] != ids[:-1]))
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    code, ids = code[new], ids[new]
    a, b = np.split(place, 2)
    root = np.arange(len(ids))
    while len(a):  # roots hook onto lesser roots, pointers are doubled until flat
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code)), pa.array(ids), pa.array(ids[root])], names=["sample_id", "node", "root"])


def _linked(pairs: DataFrame, max_rounds: int) -> DataFrame:
    """(sample_id, node, root) of edges u > v without copies.

    Every node hooks onto its least neighbour, pointers are doubled until flat, and the edges
    are contracted to the roots; repeat while edges remain. Ids that grow along a track need one
    round of log2(length) joins. A hub only contributes its minimum, never a neighbour list.
    """
    key, label = "sample_id", None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy(key, F.col("u").alias("node")).agg(F.min("v").alias("m"))
        flat = _flatten(cut_lineage(hooks.select(key, "node", F.least("node", "m").alias("root"))))
        if label is None:
            label = flat
        else:
            nxt = flat.select(key, F.col("node").alias("root"), F.col("root").alias("_r"))
            label = cut_lineage(label.join(nxt, [key, "root"], "left").select(key, "node", F.coalesce("_r", "root").alias("root")))
        side = lambda end, out: flat.select(key, F.col("node").alias(end), F.col("root").alias(out))
        roots = pairs.join(side("u", "_u"), [key, "u"]).join(side("v", "_v"), [key, "v"]).where("_u <> _v")
        pairs = cut_lineage(roots.select(key, F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
        if pairs.isEmpty():
            return label
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _flatten(hooks: DataFrame) -> DataFrame:
    """Pointers (node -> root) doubled until each points at a root; only unfinished rows are joined again."""
    key = "sample_id"
    state = hooks.withColumn("moved", F.col("node") != F.col("root"))
    while True:
        onward = state.select(key, F.col("node").alias("root"), F.col("root").alias("_far"))
        jumped = state.where("moved").join(onward, [key, "root"]).select(
            key, "node", F.col("_far").alias("root"), (F.col("_far") != F.col("root")).alias("moved"))
        state = cut_lineage(jumped.unionByName(state.where("NOT moved")))
        if state.where("moved").isEmpty():
            return state.drop("moved")


#: Positions of a tour in one block: a range of descendants is read block by block.
TOUR_BLOCK = 4096


def descendants(tracks: DataFrame, roots: DataFrame, include_self: bool = True) -> DataFrame:
    """(sample_id, root, track_id): every track below each root, by interval labels.

    Rounds grow with the logarithm of a tree's size, rows with tracks and answers. Samples that are
    no forest (a track with two parents, a cycle) are followed a generation at a time instead, each
    track once.
    """
    links = cut_lineage(forest.links_of(tracks))
    asked = cut_lineage(roots.select("sample_id", F.col("track_id").alias("root")).distinct())
    double = links.groupBy("sample_id", "child").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample_id").distinct()
    single = links.join(double, "sample_id", "left_anti")
    nodes = single.select("sample_id", F.col("parent").alias("node")).union(single.select("sample_id", "child")).distinct()
    labels, looped = forest.intervals(nodes, single)
    tangled = cut_lineage(double.union(looped).distinct())
    spans = asked.join(tangled, "sample_id", "left_anti").join(labels.withColumnRenamed("node", "root"), ["sample_id", "root"]).select(
        "sample_id", "root", "tree", "lo", "hi", F.explode(F.expr(f"sequence(lo div {TOUR_BLOCK}, (hi - 1) div {TOUR_BLOCK})")).alias("block"))
    places = labels.select("sample_id", "tree", F.expr(f"(hi - 1) div {TOUR_BLOCK}").alias("block"), F.col("node").alias("track_id"), F.col("hi").alias("at"))
    below = spans.join(places, ["sample_id", "tree", "block"]).where("at > lo AND at < hi").select("sample_id", "root", "track_id")
    if not tangled.isEmpty():
        below = below.unionByName(_by_generation(links.join(tangled, "sample_id", "left_semi"), asked.join(tangled, "sample_id", "left_semi")))
    return below.unionByName(asked.withColumn("track_id", F.col("root"))) if include_self else below


def _by_generation(links: DataFrame, asked: DataFrame) -> DataFrame:
    """As ``descendants`` without the roots themselves, one join per generation; a track reached before is not followed again."""
    seen = Spool(links.sparkSession)
    level = asked.withColumn("track_id", F.col("root"))
    children = links.withColumnRenamed("parent", "track_id")
    while True:
        step = level.join(children, ["sample_id", "track_id"]).where("child <> root").select("sample_id", "root", F.col("child").alias("track_id")).distinct()
        if seen.rounds:
            step = step.join(seen.read(), ["sample_id", "root", "track_id"], "left_anti")
        level = seen.append(step)
        if level.isEmpty():
            return seen.read()


def descendant_nodes(nodes: DataFrame, tracks: DataFrame, roots: DataFrame, include_self: bool = True) -> DataFrame:
    below = descendants(tracks, roots, include_self)
    return nodes.select("sample_id", "track_id", "node_id").join(below, ["sample_id", "track_id"]).select(
        "sample_id", "root", "node_id")


def lineage_layout(tracks: DataFrame) -> DataFrame:
    """Vertical slot of each track: leaves 0, 1, 2... depth first, an inner track at its children's mean.

    Leaf numbers come from the interval labels, means from contracting the forest, so a chain of any
    length costs rows in its length. Parents that the table lacks order their children and get no
    row. A track with two parents or a cycle is an error.
    """
    from .ranking import cumulate

    links = cut_lineage(forest.links_of(tracks))
    own = tracks.select("sample_id", F.col("track_id").alias("node")).distinct()
    nodes = cut_lineage(own.union(links.select("sample_id", "parent")).distinct())
    if not links.groupBy("sample_id", "child").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise RuntimeError("a track has two parents")
    labels, looped = forest.intervals(nodes, links)
    if not looped.isEmpty():
        raise RuntimeError("the parent column loops")
    trees = cumulate(labels.where("node = tree").select("sample_id", "tree", F.col("leaf_hi").alias("n")), "tree", ["n"], ["sample_id"])
    inner = links.select("sample_id", F.col("parent").alias("node")).distinct()
    leaves = labels.join(inner, ["sample_id", "node"], "left_anti").join(trees.select("sample_id", "tree", "n", "n_before"), ["sample_id", "tree"]).select(
        "sample_id", "node", (F.col("n_before") + F.col("n") - F.col("leaf_hi")).cast("double").alias("slot"))
    return forest.child_means(leaves, links).join(own, ["sample_id", "node"]).select("sample_id", F.col("node").alias("track_id"), "slot")


def neighbours(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parents and children of the wanted nodes; ``resolved`` is false when the node table lacks the other end."""
    asked = wanted.select("sample_id", "node_id").distinct()
    up = edges.join(asked.withColumnRenamed("node_id", "dst"), ["sample_id", "dst"]).select(
        "sample_id", F.col("dst").alias("node_id"), F.lit("parent").alias("role"), F.col("src").alias("other_id"))
    down = edges.join(asked.withColumnRenamed("node_id", "src"), ["sample_id", "src"]).select(
        "sample_id", F.col("src").alias("node_id"), F.lit("child").alias("role"), F.col("dst").alias("other_id"))
    places = nodes.select("sample_id", F.col("node_id").alias("other_id"), F.col("t").alias("other_t"),
                          F.col("y").alias("other_y"), F.col("x").alias("other_x"))
    return up.unionByName(down).join(places, ["sample_id", "other_id"], "left").select(
        "sample_id", "node_id", "role", "other_id", "other_t", "other_y", "other_x",
        F.col("other_t").isNotNull().alias("resolved"))


def union_tables(*tables: DataFrame) -> DataFrame:
    """Rows of several tables with the same columns (edges, strata)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def common_keys(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Sizes of two key sets and of their intersection, one row."""
    keys = [key] if isinstance(key, str) else list(key)
    tagged = (a.select(*keys).distinct().withColumn("_s", F.lit(1))
              .union(b.select(*keys).distinct().withColumn("_s", F.lit(2))))
    both = tagged.groupBy(*keys).agg(F.sum("_s").alias("s"))
    return both.agg(F.count_if(F.col("s") != 2).alias("n_a"), F.count_if(F.col("s") >= 2).alias("n_b"),
                    F.count_if(F.col("s") == 3).alias("n_common"))
