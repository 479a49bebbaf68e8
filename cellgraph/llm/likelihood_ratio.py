"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over the same hashed buckets are counted: one over the trusted documents, one over
the whole corpus. A document's score is the mean log ratio of its own words and word pairs; it is
kept when the score reaches a fixed threshold and the base rules hold. Everything is built-in Spark
functions. Rows never leave their partition for scoring: the bucket table (2**BITS doubles, a fixed
size) reaches the tasks as a scalar subquery, so scoring shuffles no text at any input size. The raw count is taken in place; for
the trusted one, rows that a bitmap of trusted ids (fixed size) lets through are joined with all trusted ids, as arrays of buckets, never as text.

Nulls and odd rows: a null text counts as empty; an empty text has no words, score 0.0 and fails the
base rules; a null doc_id is scored like any other and is never trusted; repeated rows are scored one
by one; other columns are kept, whatever their names (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bitmap, may_hold, set_aside, settled, text_of, words

#: Number of hashed buckets is 2**BITS, whatever the corpus.
BITS = 14
#: Added to every bucket of both multinomials.
SMOOTHING = 1.0
#: Mean log ratio below which a document is refused.
THRESHOLD = -0.3
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def _bucket(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - BITS)


def _grams(tokens: Column) -> Column:
    """Buckets of every token, then of every token with its successor ('' after the last)."""
    pairs = F.transform(tokens, lambda t, i: _bucket(t, F.coalesce(F.get(tokens, i + 1), F.lit(""))))
    return F.concat(F.transform(tokens, lambda t: _bucket(t)), pairs)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def ratio_table(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, one array: the log ratio of every bucket, counted over all rows of docs."""
    # tokens are a column of their own: as an expression they would be found again for every pair
    found, grams = F.regexp_extract_all(text_of(), F.lit(TOKEN), 0).alias("_t"), _grams(F.col("_t"))
    # explode_outer: plain explode would add a filter that repeats the hashing inside its own lambda
    raw = docs.select(found).select(F.explode_outer(grams).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.lit(0).cast("long").alias("good"))
    likely = docs.where(may_hold(bitmap(trusted, "doc_id"), "doc_id"))
    listed = likely.select("doc_id", found).select("doc_id", grams.cast("array<smallint>").alias("_g")).join(trusted.hint("merge"), "doc_id")  # one plan at every size: ids are never sent to all tasks
    good = listed.select(F.explode_outer("_g").alias("bucket")).groupBy("bucket").agg(F.lit(0).cast("long").alias("raw"), F.count(F.lit(1)).alias("good"))
    counts = raw.unionByName(good.withColumn("bucket", F.col("bucket").cast("long"))).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    spark = docs.sparkSession
    every = spark.range(2 ** BITS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    whole = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("c"),
                      F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    share = lambda n, total: (n + SMOOTHING) / (F.col(total) + SMOOTHING * 2 ** BITS)
    return whole.select(F.transform("c", lambda x: F.log(share(x["good"], "goods")) - F.log(share(x["raw"], "raws"))).alias("ratios"))


def _repeated_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash; only texts that hold a repeated one are sorted.
    """
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda a, i: F.xxhash64(
        a, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return windows


#: Columns of the result.
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs (whose columns clash with no name used here) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    first = docs.withColumns({"_w": words(text), "_lines": lines})
    second = first.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": _repeated_words(F.col("_w")),
    })
    # positions of repeated windows in text order: equal hashes stand together once sorted
    marked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = second.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), marked))
    at = F.filter("_s", lambda x, k: (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]))
    fourth = third.withColumn("_p", F.sort_array(F.transform(at, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    fifth = fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return fifth.withColumn("base_failed", failed).drop("_w", "_lines", "_h", "_s", "_p")


def score_quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus the base rules' columns, `llr` (mean log ratio) and `kept`.

    trusted: doc_id of the target documents, each once (see trusted_ids).
    """
    table = ratio_table(docs, trusted)
    own, back = set_aside(docs, F.col("text"))
    back = [c for c, name in zip(back, docs.columns) if name.lower() not in RESULT]
    tokens = base_rules(own).withColumn("_t", F.regexp_extract_all(text_of(), F.lit(TOKEN), 0))
    ready = tokens.withColumns({"_grams": _grams(F.col("_t")), "_ratios": table.scalar()})
    total = F.aggregate("_grams", F.lit(0.0), lambda s, g: s + F.get("_ratios", g.cast("int")))
    llr = F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0))
    scored = ready.withColumn("llr", llr).drop("_t", "_grams", "_ratios")
    return settled(scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)), "llr", "kept").select(*back, *RESULT)
