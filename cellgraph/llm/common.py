"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: Words are maximal runs of anything but these six characters.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Splits on any of them; kept beside NOT_SPACE so that both stay alike.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text; an empty array for an empty or blank one."""
    return F.array_remove(F.split(text, SPACE), "")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key written as text, modulo parts; null keys fall into part 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(0))


def hashed_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """The `rows` rows whose keys have the smallest hashes (a few less if hashes fall badly).

    A hash limit lets about twice as many rows through before they are ordered, so that what meets in one task does not grow with the input.
    """
    place = F.shiftrightunsigned(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), 11) / float(2 ** 53)
    n = df.count()
    drawn = df.where(place < 2.0 * rows / n) if n > 2 * rows else df
    return drawn.orderBy(place, *key).limit(rows)


def set_aside(docs: DataFrame, *own: Column) -> tuple[DataFrame, list[Column]]:
    """The caller's columns under names that no operator uses, with the operator's own; and the columns that give the old names back."""
    names = [(f"_in{k}", c) for k, c in enumerate(docs.columns)]
    quoted = {c: "`" + c.replace("`", "``") + "`" for _, c in names}
    return docs.select(*[F.col(quoted[c]).alias(n) for n, c in names], *own), [F.col(n).alias(c) for n, c in names]


#: A bitmap of keys has 2**BITMAP bits, whatever the number of keys.
BITMAP = 22


def _bit(*key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - BITMAP)


def bitmap(keys: DataFrame, *key: str) -> DataFrame:
    """One row, one array of fixed size: the bits of all keys."""
    words = keys.select(_bit(*key).alias("b")).select(F.floor(F.col("b") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, CAST(b % 64 AS INT))").alias("bits"))
    held = words.groupBy("at").agg(F.bit_or("bits").alias("bits"))
    every = keys.sparkSession.range(2 ** BITMAP // 64).select(F.col("id").cast("int").alias("at")).join(held, "at", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bitmap"))


def may_hold(table: DataFrame, *key: str) -> Column:
    """Whether a row's key may be among the bitmap's keys: never false for one of them.

    What passes is to be joined exactly; the bitmap only spares the other rows the way through a shuffle. With very many keys all rows pass.
    """
    bit = _bit(*key)
    word = F.get(table.scalar(), F.floor(bit / 64).cast("int"))
    return F.call_function("getbit", word, (bit % 64).cast("int")) == 1


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns computed once: a later filter on them is not rewritten into their formulas.

    Filters move below projections and repeat whole lambdas there; they stop at a generator's own output.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names)))).select(*df.columns)


def smallest_reachable(edges: DataFrame, src: str, dst: str, join: str | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node of its part.

    Every round a node takes the smallest label of its neighbours and then the label of its label, and the labels are
    written once; it ends when no label has changed. Hubs only ever contribute a minimum. ``join`` is a hint for the joins
    of a round; without one Spark chooses, by the size of the written files.
    """
    hinted = lambda df: df.hint(join) if join else df
    ends = edges.select(F.col(src).alias("node"), F.col(dst).alias("other"))
    both = cut_lineage(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("component")))
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("component").alias("_c"))
        near = both.join(hinted(seen), "other").groupBy("node").agg(F.min("_c").alias("_c"))
        lower = labels.join(hinted(near), "node").select("node", F.col("component").alias("_before"), F.least("component", "_c").alias("_to"))
        onward = lower.select(F.col("node").alias("_to"), F.col("_to").alias("component"))
        moved = cut_lineage(lower.join(hinted(onward), "_to").select("node", "component", (F.col("component") != F.col("_before")).alias("_moved")))
        labels = moved.select("node", "component")
        if moved.where("_moved").isEmpty():
            return labels
