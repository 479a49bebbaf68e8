"""Running sums, ranks and exact percentiles over groups of any size.

A plain window or ``percentile`` puts a whole group into one task. Here a group is first cut
into ordered value buckets (limits come from a quantile sketch of the column). Each bucket is
handled by its own task, and the small table of bucket totals supplies the offset. The answer
stays exact: the limits only decide where the work is split.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

#: Rows of one bucket, about; the number of buckets follows from it.
BUCKET_ROWS = 250_000


def bucket_count(df: DataFrame, rows: int) -> int:
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), rows // BUCKET_ROWS)


def sortable(df: DataFrame, name: str) -> Column:
    """The column as a number that never decreases along its order; strings by six bytes after their common beginning."""
    if dict(df.dtypes)[name] != "string":
        return F.col(name).cast("double")
    low, high = df.agg(F.min(name), F.max(name)).first()
    low, high = (low or "").encode(), (high or "").encode()
    shared = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    head = F.hex(F.substring(F.col(name).cast("binary"), shared + 1, 6))
    return F.when(F.col(name).isNotNull(), F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double"))


def cut_points(df: DataFrame, value: str | Column, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of a numeric column, repeats kept (a repeat marks a heavy value)."""
    v = F.col(value).cast("double") if isinstance(value, str) else value
    column = df.select(v.alias("v")).where("v IS NOT NULL")
    n = buckets or bucket_count(df, column.count())
    return sorted(column.approxQuantile("v", [i / n for i in range(1, n)], 1.0 / (2 * n)))


def bucket_of(value, cuts: Sequence[float]) -> Column:
    """How many limits are <= value: a binary search over them, for any number of limits."""
    v = F.col(value) if isinstance(value, str) else value
    limits = sorted(set(cuts))
    if not limits:
        return F.lit(0)
    # one literal, however many limits; missing ends compare as false
    table = F.from_json(F.lit(json.dumps(limits)), "array<double>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(limits).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= v, at + s).otherwise(at))


def cumulate(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (),
             cuts: Sequence[float] | None = None) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller values of the group) and ``<s>_total`` for each s.

    ``df`` must hold one row per (by, value).
    """
    by = list(by)
    limits = cut_points(df, value) if cuts is None else cuts
    rows = df.withColumn("_b", bucket_of(value, limits))
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(f"_{s}").over(group).alias(f"{s}_total") for s in sums])
    inside = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = rows.join(offsets, [*by, "_b"])
    for s in sums:
        joined = joined.withColumn(
            f"{s}_before", F.col(f"_{s}_off") + F.coalesce(F.sum(s).over(inside), F.lit(0))).drop(f"_{s}_off")
    return joined.drop("_b")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their counts: copies collapse before any shuffle of rows."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("n")))


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated percentiles, one column per name in ``probs``; NULLs ignored.

    The input is read once: its distinct values are written out, then sketched and ranked.
    """
    return percentiles_of_counts(cut_lineage(value_counts(df, value, by)), probs, by)


def percentiles_of_counts(counts: DataFrame, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """As ``exact_percentiles``, from a table of distinct values (_v) with their counts (n)."""
    by = list(by)
    ranked = cumulate(counts, "_v", ["n"], by)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n_total") - 1)
        for tag, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= rank) & (rank <= last), F.col("_v"))).alias(f"_{name}_{tag}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
    out = ranked.groupBy(*by).agg(*picks)
    return out.select(*by, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n) for n in probs])


def rank_rows(df: DataFrame, value: str, tie: str, by: Sequence[str] = (), name: str = "rank",
              tie_descending: bool = False, cuts: Sequence[float] | None = None) -> DataFrame:
    """0-based position of every row of the group in the order (value, tie).

    A heavy value gets buckets of its own, split again along the tie-breaker.
    """
    by = list(by)
    v = sortable(df, value)
    limits = cut_points(df, v) if cuts is None else list(cuts)
    heavy = sorted(c for c, n in Counter(limits).items() if n > 1)
    bucket = bucket_of(v, limits)
    minor = F.lit(0)
    # unequal strings may share a number: their ties cannot be split, unless the tie is the value itself
    if heavy and (value == tie or dict(df.dtypes)[value] != "string"):
        # a heavy value starts its own bucket; what follows it moves one bucket up
        bucket = bucket + F.coalesce(bucket_of(v, heavy) - v.isin(heavy).cast("int"), F.lit(0))
        same = df.where(v.isin(heavy))
        place = sortable(same, tie)
        minor = F.when(v.isin(heavy), bucket_of(place, cut_points(same, place))).otherwise(F.lit(0))
        if tie_descending:
            minor = -minor
    rows = df.withColumn("_b", bucket).withColumn("_m", minor)
    sizes = rows.groupBy(*by, "_b", "_m").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    offsets = sizes.select(*by, "_b", "_m", F.coalesce(
        F.sum("_n").over(group.orderBy("_b", "_m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    order = F.col(tie).desc() if tie_descending else F.col(tie).asc()
    inside = W.partitionBy(*by, "_b", "_m").orderBy(F.col(value), order)
    return (rows.join(offsets, [*by, "_b", "_m"])
            .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1).drop("_b", "_m", "_off"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values with their 1-based average rank over the whole table."""
    ranked = cumulate(cut_lineage(value_counts(df, value)), "_v", ["n"])
    return ranked.select(F.col("_v").alias(value), (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
