"""Merkle dataset manifest: lag and lead windows over the leaves of each source.

A leaf is the sha256 of a document's fields. Leaves of a source stand in the order of doc_id; every FAN consecutive nodes (the last
run may be shorter, even one) become one by the sha256 of their hex digests, until one node is left, the subroot; subroots in the
order of their sources fold to the root in the same way.

Levels need no table of their own: leaves stand in blocks of FAN**LEVELS, each one window partition. At level k the node of a row stands
in the first row it covers, its siblings FAN**k and 2 * FAN**k rows before or after it, so lag and lead columns at fixed offsets,
masked by the node's slot in its run and by the run's length, supply them; first-child rows hash the parent, and a running `last` hands it
and the siblings to the rows below. Blocks are nodes of the next table, FAN**LEVELS times smaller; all tables together are hardly larger than
the first. A hot source is many blocks; only hashes and keys are shuffled, never texts.

Every row gets its proof: the siblings left and right of its path, level by level. `verify` folds a leaf that was computed from another
copy of the row with them.

Nulls and odd rows: a null field is `-`, a value its byte count, a colon and the value; a null source is a source of its own and comes first,
null ids come first in their source; rows with equal ids stand in the order of their leaves, and equal rows next to each other (which of
them comes first cannot be told from their digests, but each gets a place of its own); an empty table gives an empty
manifest; other columns are carried by no row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ranking import rank_rows
from ..session import cut_lineage

FAN, LEVELS = 3, 6
#: Fixed order of a leaf's fields.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """Hash of a row's FIELDS, with another text in place of its own if one is given."""
    parts = [_field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _block_levels(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes (keys, pos, n, hash) plus `steps` (siblings by level, within the block) and `top` (the block's node).

    n is the number of nodes of the row's tree at this table's level; trees that are down to one node rise no further.
    """
    block = W.partitionBy(*keys, "_block").orderBy("pos")
    so_far = block.rowsBetween(W.unboundedPreceding, 0)
    df = nodes.withColumn("_block", F.expr(f"pos DIV {FAN ** LEVELS}")).withColumn("top", F.col("hash"))
    kept = []
    for k in range(LEVELS):
        span = FAN ** k
        slot = F.expr(f"(pos DIV {span}) % {FAN}")
        open_ = F.col("n") > span  # more than one node at this level
        first = (F.col("pos") % span == 0) & open_
        reach = {f"_{way}{j}": (F.lag if way == "lag" else F.lead)("top", j * span).over(block) for way in ("lag", "lead") for j in range(1, FAN)}
        df = df.withColumns(reach)
        # a run ends after FAN slots, or where the tree ends: there lead finds no row
        left = F.concat(*[F.when(slot >= j, F.col(f"_lag{j}")).otherwise(F.lit("")) for j in reversed(range(1, FAN))])
        right = F.concat(*[F.when(slot + j < FAN, F.coalesce(F.col(f"_lead{j}"), F.lit(""))).otherwise(F.lit("")) for j in range(1, FAN)])
        df = df.withColumn("_own", F.when(first, F.struct(left.alias("left"), right.alias("right"))))
        df = df.withColumn("_up", F.when(first & (slot == 0), F.sha2(F.concat(F.col("top"), F.col("_own.right")).cast("binary"), 256)))
        df = df.withColumns({f"_step{k}": F.when(open_, F.last("_own", ignorenulls=True).over(so_far)),
                             "top": F.when(open_, F.last("_up", ignorenulls=True).over(so_far)).otherwise(F.col("top"))})
        df = df.drop(*reach, "_own", "_up")
        kept.append(f"_step{k}")
    steps = F.filter(F.array(*kept), lambda s: s.isNotNull()).cast(_STEP)
    return df.withColumn("steps", steps).drop(*kept)


def fold(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes (keys, pos, n, hash, ...) plus `steps` up to their tree's last node, and `top`, that node.

    A tree is the rows of equal keys (which hold no null), pos their places from 0 and n their number.
    """
    size = FAN ** LEVELS
    done = cut_lineage(_block_levels(nodes, keys))
    if (done.agg(F.max("n")).first()[0] or 0) <= size:
        return done.drop("_block")
    heads = done.where(F.col("pos") % size == 0).select(
        *keys, F.col("_block").alias("pos"), F.expr(f"(n + {size - 1}) DIV {size}").alias("n"), F.col("top").alias("hash"))
    above = fold(heads, keys).select(*keys, F.col("pos").alias("_block"), F.col("steps").alias("_more"), F.col("top").alias("_top"))
    return done.join(above, [*keys, "_block"]).withColumn("steps", F.concat("steps", "_more")).withColumn("top", F.col("_top")).drop("_block", "_more", "_top")


def _trees(leaves: DataFrame) -> DataFrame:
    """leaves with `pos` and `n`, the place of a row in its source and the source's rows."""
    placed = rank_rows(leaves.withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2 ** 63))), "_id", "leaf", by=["_source"], name="pos")
    sizes = cut_lineage(leaves.groupBy("_source").agg(F.count(F.lit(1)).alias("n")))
    return placed.join(sizes, "_source").drop("_id")


def manifest(docs: DataFrame, others: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, steps) of docs (FIELDS), plus the columns of `others`, computed with the leaf.

    steps: siblings left and right of the row's path, from its leaf to the root.
    """
    more = others or {}
    # a key without nulls that keeps the order of sources: the null one first
    source = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaves = cut_lineage(docs.select("doc_id", "source", source.alias("_source"), leaf_hash().alias("leaf"), *[c.alias(n) for n, c in more.items()]))
    own = fold(_trees(leaves).withColumn("hash", F.col("leaf")), ["_source"])
    own = cut_lineage(own.select("doc_id", "source", "_source", "leaf", *more, "pos", F.col("steps").alias("_own"), F.col("top").alias("subroot")))
    subroots = own.where("pos = 0").select("_source", F.col("subroot").alias("hash"), F.lit(0).alias("_all"))
    # sources are counted first: one row each, ranked like leaves
    placed = rank_rows(cut_lineage(subroots), "_source", "_source", by=["_all"], name="pos")
    n = subroots.count()
    tops = fold(placed.withColumn("n", F.lit(n).cast("long")), ["_all"]).select("_source", F.col("steps").alias("_more"), F.col("top").alias("root"))
    return own.join(cut_lineage(tops), "_source").select("doc_id", "source", "leaf", *more, "subroot", "root", F.concat("_own", "_more").alias("steps"))


def verify(rows: DataFrame, leaf: str) -> DataFrame:
    """rows of a manifest plus proof_sha256 (of all siblings), folded_root (from the named leaf) and verified."""
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    folded = F.aggregate("steps", F.col(leaf), lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]).cast("binary"), 256))
    out = rows.select("*", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
