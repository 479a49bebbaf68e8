"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A text's set is its distinct shingles of 4 words (A-Z lower-cased; a shorter text is one shingle). Texts with
equal sets form a class, so copies cost one row. Two classes link when 100*|A&B| >= 85*|A|B|. Words and percentage
are parameters (see Rule); the figures below are for these.

1. *Coarse pass.* Under any fixed order of shingles, two linked sets share at least l of their first
   n - ceil(0.85 n) + l. With the hash as order this needs no corpus counts: one shuffle of such prefixes (about a fifth of all
   shingles) drops every class that shares fewer than l of them with any other class. It loses no link.
2. *Heavy-light split.* Sets of up to x shingles enumerate all subsets of the size a linked partner must
   share; equal subsets meet in a bucket. Larger sets look through inverted lists of the rarest-first prefix
   (which also list the small sets that a large one can link with). x minimises the counted cost of both in bytes moved: a row for
   every subset, against a row and a comparison of two whole sets for every list entry. How long lists are does not enter: a list of any length is
   compared with one member, so a set costs the same wherever it stands.
3. *Buckets to links.* Members of a bucket are compared with its most central member first; then only
   members that are still in different components are compared with each other, and only where the places of the common
   shingle leave room for the overlap wanted. A group of near copies
   costs its size, not its square, and no link between components is missed.

Nulls and odd rows: null, empty and blank texts have the empty set, n_shingles 0, no link, and component_id =
doc_id; a null doc_id takes part, and is never the smallest of its component (component_id is null if no other is there);
repeated rows are returned as often as they came, and belong to the same class; other columns are ignored, unless asked for by name.
Shingles are compared by 64-bit hashes, classes by 128-bit digests of the sorted hashes.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .common import bitmap, may_hold, smallest_reachable

WORDS, SIMILAR = 4, 85
#: Sets above this size are never enumerated; the boundary found by cost lies at or below it.
MAX_SMALL = 40
#: Bytes that a bucket row costs, and a shingle of a set that is compared (both sets are moved).
ROW_BYTES, SHINGLE_BYTES = 24, 16
#: Subset rows made at once.
PIECE = 20_000
_MEMO = 400_000


class _Hashes(dict):
    """word -> its 64-bit hash; remembers what it was asked."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII blanks only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(total)])
    return np.unique(total)


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words; sets link when 100*|A&B| >= similar*|A|B|."""

    words: int = WORDS
    similar: int = SIMILAR

    def prefix_size(self, n: int) -> int:
        return n - (self.similar * n + 99) // 100 + 1

    def prefix_column(self, n: str) -> Column:
        c = F.col(n)
        return (c - F.ceil(c * self.similar / 100) + 1).cast("int")

    def coarse_size(self, n: int) -> tuple[int, int]:
        """(l, length) of the coarse pass: of `length` first shingles at least l are shared with a linked set."""
        least = (self.prefix_size(n) + 1) // 2
        return least, self.prefix_size(n) - 1 + least

    def needed(self, a: int, b: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.similar * (a + b) // (100 + self.similar))

    def partner_sizes(self, n: int) -> range:
        return range((self.similar * n + 99) // 100, 100 * n // self.similar + 1)


def _document_sets(batches: Iterator[pa.RecordBatch], rule: Rule, whole: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, carried columns, n, key, toks): toks is the whole set, or just what the coarse pass and small sets need."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        sets = [shingle_hashes(t, rule.words) for t in batch.column(at).to_pylist()]
        keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
        sizes = pa.array([len(s) for s in sets], pa.int32())
        if not whole:
            sets = [s if len(s) <= MAX_SMALL else s[:rule.coarse_size(len(s))[1]] for s in sets]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        toks = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, sizes, keys, toks], [*rest.schema.names, "n", "key", "toks"])


def _sets(docs: DataFrame, rule: Rule, whole: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)) + ", n int, key binary, toks array<bigint>"
    return docs.select("doc_id", *carry, "text").mapInArrow(lambda it: _document_sets(it, rule, whole), schema)


def boundary(sizes: dict[int, int], listed: float, rule: Rule) -> int:
    """Largest set size to enumerate: the least total of bytes that subsets and list entries move.

    sizes: classes of every size; listed: share of the prefixes' shingles that stand in a list.
    """
    best, x = math.inf, 0
    for limit in range(MAX_SMALL + 1):
        subsets = sum(n * ROW_BYTES * sum(math.comb(s, rule.needed(s, o)) for o in rule.partner_sizes(s) if o <= limit) for s, n in sizes.items() if s <= limit)
        scans = sum(n * listed * rule.prefix_size(s) * (ROW_BYTES + SHINGLE_BYTES * s) for s, n in sizes.items() if s > limit)
        if subsets + scans <= best:
            best, x = subsets + scans, limit
    return x


def _subsets(frames: Iterator[pd.DataFrame], limit: int, rule: Rule) -> Iterator[pd.DataFrame]:
    """Hashes of the subsets a small set may share with a small partner, by the two sizes; at most PIECE rows at a time."""
    rows = []
    for frame in frames:
        for v, n, toks in zip(frame["v"], frame["n"], frame["toks"]):
            ints = np.asarray(toks, np.int64).view(np.uint64).tolist()
            whole = sum(ints)
            for other in rule.partner_sizes(n):
                if other > limit:
                    continue
                size = rule.needed(n, other)
                salt = _mix(np.array([min(n, other) * 1000 + max(n, other)], np.uint64))[0].item()
                for drop in itertools.combinations(range(n), n - size):
                    left = (whole - sum(ints[i] for i in drop)) % 2 ** 64 ^ salt
                    rows.append((left - 2 ** 64 if left >= 2 ** 63 else left, v, n))
                    if len(rows) == PIECE:
                        yield pd.DataFrame(rows, columns=["bucket", "v", "n"])
                        rows = []
    yield pd.DataFrame(rows, columns=["bucket", "v", "n"])


def _may_link(similar: int, n: str, place: str, m: str, other: str) -> Column:
    """Whether sets of n and m shingles that share the one at these places (from 1, in rarest-first order) can overlap enough.

    If it is their first common one, no more than n - place + 1 and m - other + 1 are shared.
    """
    wanted = F.ceil(similar * (F.col(n) + F.col(m)) / (100 + similar))
    sizes = 100 * F.least(n, m) >= similar * F.greatest(n, m)
    return sizes & (F.col(n) - F.col(place) + 1 >= wanted) & (F.col(m) - F.col(other) + 1 >= wanted)


def _linked(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets overlap enough; equal in both directions."""
    left = sets.select(F.col("v").alias("a"), F.col("n").alias("_na"), F.col("toks").alias("_ta"))
    right = sets.select(F.col("v").alias("b"), F.col("n").alias("_nb"), F.col("toks").alias("_tb"))
    both = F.size(F.array_intersect("_ta", "_tb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "_na", "_nb", both.alias("_o"))
            .where(100 * F.col("_o") >= similar * (F.col("_na") + F.col("_nb") - F.col("_o"))).select("a", "b"))


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link_buckets(buckets: DataFrame, sets: DataFrame, similar: int) -> tuple[DataFrame, DataFrame]:
    """Links that span the components of all classes which meet in a bucket, and those components (v, component).

    buckets: (bucket, v, n, place, rank), rank higher for central members; sets: (v, n, toks).
    """
    top = buckets.groupBy("bucket").agg(F.max(F.struct("rank", F.negative("v").alias("m"), "n", "place")).alias("top"), F.count(F.lit(1)).alias("_c"))
    top = top.where("_c > 1").select("bucket", F.negative(F.col("top.m")).alias("lead"), F.col("top.n").alias("lead_n"), F.col("top.place").alias("lead_place"))
    stars = buckets.join(top, "bucket").where(F.col("v") != F.col("lead")).where(_may_link(similar, "n", "place", "lead_n", "lead_place")).select(*_pair("v", "lead")).distinct()
    tried = cut_lineage(stars)
    links = cut_lineage(_linked(tried, sets, similar))
    parts = smallest_reachable(links, "a", "b").withColumnRenamed("node", "v")
    known = cut_lineage(buckets.join(parts, "v", "left").select("bucket", "v", "n", "place", F.coalesce("component", "v").alias("c")))
    mixed = known.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    open_ = known.join(mixed, "bucket")
    # of two sets the smaller one holds the shingle early enough for a partner of its own size
    early = open_.where(F.col("n") - F.col("place") + 1 >= F.ceil(2 * similar * F.col("n") / (100 + similar)))
    other = open_.select("bucket", F.col("v").alias("w"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("c").alias("d"))
    rest = early.join(other, "bucket").where("v <> w AND n <= m AND c <> d").where(_may_link(similar, "n", "place", "m", "at")).select(*_pair("v", "w")).distinct()
    more = cut_lineage(_linked(rest.join(tried, ["a", "b"], "left_anti"), sets, similar))
    if not more.isEmpty():
        links = links.unionByName(more)
        parts = smallest_reachable(links, "a", "b").withColumnRenamed("node", "v")
    return links, parts


def _shared(entries: DataFrame) -> DataFrame:
    """entries (v, tok, ...) whose shingle more than one class holds, with df, the number of those: counted before it is shuffled, then joined back."""
    counts = entries.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return entries.join(counts, "tok")


def jaccard_join(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, classes and spanning links of the join.

    Rows: (doc_id, columns named in carry, n_shingles, class_id, group_id, component_id), one per row of docs; group_id is one class id of
    the component, class_id and group_id are null for empty sets.
    Classes: (class_id, first_doc, n_shingles, component_id). Spanning links: (a, b) between class ids, enough of
    them to connect every component; within a class every two members are linked.
    """
    rule = Rule(words, similar)
    kind = dict(docs.dtypes)["doc_id"]
    inside = tuple(f"_carry{k}" for k in range(len(carry)))
    told = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(i) for c, i in zip(carry, inside)])
    seen = cut_lineage(_sets(told, rule, False, inside))
    grouped = seen.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("toks").alias("toks"))
    classes = cut_lineage(grouped.withColumn("v", F.monotonically_increasing_id()))

    # 1. classes that share enough of their first shingles
    prefix = rule.prefix_column("n")
    least = F.floor((prefix + 1) / 2).cast("int")
    entries = classes.select("v", F.explode(F.slice("toks", F.lit(1), prefix - 1 + least)).alias("tok"))
    shared = _shared(entries).groupBy("v").agg(F.count(F.lit(1)).alias("shared"))
    close = cut_lineage(classes.select("v", "key", "first_doc", "n").join(shared, "v").where(F.col("shared") >= least).drop("shared"))
    # 2. whole sets of those only; the first document of a class stands for it
    wanted = docs.select("doc_id", "text").where(may_hold(bitmap(close, "first_doc"), "doc_id"))
    wanted = wanted.join(close.select("first_doc").distinct(), F.col("doc_id").eqNullSafe(F.col("first_doc")), "left_semi")
    sets = _sets(wanted, rule, True).join(close.select("key", "v"), "key").groupBy("v").agg(F.first("n").alias("n"), F.first("toks").alias("toks"))
    sets = cut_lineage(sets)
    shared = cut_lineage(_shared(sets.select("v", "n", F.explode("toks").alias("tok"))))
    sizes = {r["n"]: r["c"] for r in sets.where(F.col("n") <= MAX_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    # rarest first: shingles of one class alone lead the order and need no list
    held = shared.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    first = cut_lineage(shared.join(held, "v").withColumn("at", F.row_number().over(W.partitionBy("v").orderBy("df", "tok")))
                        .where(F.col("at") <= prefix - (F.col("n") - F.col("k"))))
    prefixes = sets.agg(F.sum(prefix)).first()[0] or 1
    limit = boundary(sizes, first.count() / prefixes, rule)
    listed = (first.where(F.ceil(F.lit(100) * F.col("n") / similar) > limit)
              .select(F.col("tok").alias("bucket"), "v", "n", (F.col("at") + F.col("n") - F.col("k")).cast("int").alias("place"), (F.col("k") / F.col("n")).alias("rank")))
    small = sets.where(F.col("n") <= limit).mapInPandas(lambda it: _subsets(it, limit, rule), "bucket bigint, v bigint, n int")
    small = small.join(held, "v", "left").select("bucket", "v", "n", F.lit(1).alias("place"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("rank"))
    links, parts = link_buckets(cut_lineage(listed.unionByName(small)), sets.select("v", "n", "toks"), similar)

    # components take the smallest document id of their classes
    placed = close.join(parts, "v", "left").withColumn("component", F.coalesce("component", "v"))
    least = placed.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    known = placed.join(least, "component").select("v", F.col("component").alias("_g"), F.col("component_id").alias("_c"))
    final = classes.select("v", "key", "first_doc", "n").join(known, "v", "left").select(
        F.col("v").alias("class_id"), F.coalesce("_g", "v").alias("group_id"), "key", "first_doc", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("_c", "first_doc").cast(kind).alias("component_id"))
    rows = seen.select("doc_id", *inside, "n", "key").join(final.select("key", "class_id", "group_id", "component_id"), "key", "left").select(
        "doc_id", *[F.col(i).alias(c) for c, i in zip(carry, inside)], F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).alias("class_id"), F.when(F.col("n") > 0, F.col("group_id")).alias("group_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return rows, final.select("class_id", "first_doc", "n_shingles", "component_id"), links
