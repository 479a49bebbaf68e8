"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Source i with token share p_i gets weight p_i**a / sum(p**a). The exponent is bisected, from 1 (natural
shares) towards 0 (equal ones), until the weights' entropy reaches a target share of its maximum or until the most
repeated source meets its repetition limit, whichever comes first. The budget is the least at which every document is used.

Each source then fills its token budget with whole permutations of its documents and the beginning of one more.
A permutation orders documents by md5(seed, pass, doc_id). For the last one, blocks are ranges of that order (equal
leading hex digits, about BLOCK_ROWS documents each): whole blocks are counted first, and only the block in which a source's budget ends is put
in order, on keys and counts alone. What comes of it is one row per source, the place where its last pass ends, and every document is
compared with that where it lies: no text is shuffled. Everything is built-in Spark functions.

Nulls and odd rows: a null source is a source of its own; a null or empty text has no tokens, costs nothing and is used in every
whole pass of its source, and in the last one while budget is left before it; a source without any token is used once; repeated rows are drawn like
any other rows, and of those that are alike where a pass ends as many are drawn as the budget holds; a null doc_id is ordered as 'null';
other columns are kept, whatever their names (an input column `epoch` is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .common import set_aside, text_of, words

SEED = "mix-1"
BLOCK_ROWS = 4096
#: Steps of the bisection, and digits its result is rounded to.
STEPS, DIGITS = 30, 6
_KEY = "_source_key"


def _key() -> Column:
    """The source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null")).alias(_KEY)


def word_tokens() -> Column:
    """Tokens of a document, counted in words."""
    return F.size(words(text_of())).cast("long")


def _draw(epoch: Column) -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(SEED), epoch.cast("string"), key).cast("binary"))


def source_shares(docs: DataFrame, tokens: Column) -> DataFrame:
    """(source, n_docs, n_tokens) with null as a source of its own."""
    return docs.select("source", tokens.alias("_n")).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_n").alias("n_tokens"))


def find_exponent(shares: DataFrame, target_entropy: float | None, max_repetition: float | None) -> float:
    """Largest exponent in [0, 1] that meets the entropy target, or the least one the repetition limit allows if that is larger.

    target_entropy: share of the largest possible entropy (1.0: equal weights); max_repetition: times that the most
    repeated source is used for each time the least repeated one is. Rounded to DIGITS digits.
    """
    used = shares.where("n_tokens > 0")
    total, kinds, most, least = used.agg(F.sum("n_tokens"), F.count(F.lit(1)), F.max("n_tokens"), F.min("n_tokens")).first()
    if not kinds or kinds == 1 or most == least:
        return 1.0
    share = F.col("n_tokens") / F.lit(float(total))

    def entropy(a: float) -> float:
        power = F.pow(share, F.lit(a))
        s, weighted = used.agg(F.sum(power), F.sum(power * F.ln(share))).first()
        return math.log(s) - a * weighted / s

    low = 0.0
    if max_repetition is not None:  # the repetition of source i is (p_i / p_max) ** (a - 1)
        low = max(0.0, 1.0 - math.log(max_repetition) / math.log(most / least))
    if target_entropy is None:
        return round(low, DIGITS)
    goal, high = target_entropy * math.log(kinds), 1.0
    if entropy(high) >= goal:
        return 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) >= goal else (low, middle)
    return round(low, DIGITS)


def source_budgets(shares: DataFrame, exponent: float) -> DataFrame:
    """shares plus weight, budget (tokens), whole (passes over all documents), rest (tokens of the last pass)."""
    used = shares.where("n_tokens > 0")
    totals = used.agg(F.sum("n_tokens").cast("double").alias("t"), F.count(F.lit(1)).alias("c")).first()
    if not totals["c"]:
        return shares.select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("whole"), F.lit(0).cast("long").alias("rest"))
    power = F.pow(F.col("n_tokens") / F.lit(totals["t"]), F.lit(exponent))
    norm, scale = used.select(power.alias("w"), "n_tokens").agg(F.sum("w"), F.max(F.col("n_tokens") / F.col("w"))).first()
    budget = F.when(F.col("n_tokens") > 0, F.round(power * F.lit(scale)).cast("long")).otherwise(F.lit(0).cast("long"))
    weight = F.when(F.col("n_tokens") > 0, power / F.lit(norm)).otherwise(F.lit(0.0))
    whole = F.when(F.col("n_tokens") > 0, F.expr("budget DIV n_tokens")).otherwise(F.lit(1).cast("long"))
    rest = F.when(F.col("n_tokens") > 0, F.expr("budget % n_tokens")).otherwise(F.lit(0).cast("long"))
    return shares.withColumn("weight", weight).withColumn("budget", budget).withColumn("whole", whole).withColumn("rest", rest)


def mix(docs: DataFrame, target_entropy: float | None = 0.97, max_repetition: float | None = 2.0, tokens: Column | None = None) -> DataFrame:
    """docs, each as often as drawn, plus `epoch` (1, 2, ... the pass of its source that draws it).

    The order of a pass is md5(SEED|epoch|doc_id). docs is read three times: for the shares, for the blocks' sizes, and for the rows.
    """
    tokens = word_tokens() if tokens is None else tokens
    shares = cut_lineage(source_shares(docs, tokens))
    plan = source_budgets(shares, find_exponent(shares, target_entropy, max_repetition))
    # hex digits that cut a source's order into ranges of about BLOCK_ROWS documents
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n_docs") / BLOCK_ROWS))).cast("int")
    plan = cut_lineage(plan.select(_key(), "whole", "rest", digits.alias("_digits")))
    own, back = set_aside(docs, F.col("doc_id"), tokens.alias("_n"), _key())
    told = own.select(_KEY, "doc_id", "_n").join(plan, _KEY).withColumn("_draw", _draw(F.col("whole") + 1))
    ends = plan.join(cut_lineage(_last_drawn(told)), _KEY, "left").select(_KEY, "whole", "_end", "_took")
    ends = cut_lineage(ends)
    placed = own.join(ends, _KEY).withColumn("_place", F.struct(_draw(F.col("whole") + 1).alias("_draw"), "doc_id", "_n"))
    sure = placed.where(~F.coalesce((F.col("_took") > 0) & (F.col("_place") == F.col("_end")), F.lit(False)))
    out = sure.withColumn("_more", F.coalesce((F.col("_place") < F.col("_end")).cast("int"), F.lit(0)))
    if not ends.where("_took > 0").isEmpty():  # rows alike, of which a pass draws some
        alike = placed.where((F.col("_took") > 0) & (F.col("_place") == F.col("_end")))
        nth = F.row_number().over(W.partitionBy(_KEY).orderBy("_place"))
        out = out.unionByName(alike.withColumn("_more", (nth <= F.col("_took")).cast("int")))
    times = F.col("whole") + F.col("_more")
    kept = [c for c, name in zip(back, docs.columns) if name.lower() != "epoch"]
    return out.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*kept, F.col("_epoch").alias("epoch"))


def _last_drawn(told: DataFrame) -> DataFrame:
    """(source key, _end, _took): where a source's last pass ends, its first place that is not (wholly) drawn, and how many rows of that place are.

    told: source key, doc_id, _n, _draw, rest and _digits of every row. Sources without a rest have no row here.
    """
    drawn = told.where("rest > 0").withColumn("_block", F.substring("_draw", F.lit(1), F.col("_digits")))
    sums = drawn.groupBy(_KEY, "_block", "rest").agg(F.sum("_n").alias("_size"))
    before = W.partitionBy(_KEY).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    edge = starts.where("_start <= rest AND rest < _start + _size").select(_KEY, "_block", "_start")
    inside = W.partitionBy(_KEY).orderBy("_draw", "doc_id", "_n").rowsBetween(W.unboundedPreceding, 0)
    rows = drawn.join(edge, [_KEY, "_block"]).withColumn("_in", F.col("_start") + F.sum("_n").over(inside) <= F.col("rest"))
    places = rows.groupBy(_KEY, F.struct("_draw", "doc_id", "_n").alias("_end")).agg(F.count_if("_in").alias("_took"), F.count(F.lit(1)).alias("_rows"))
    first = places.where("_took < _rows").groupBy(_KEY).agg(F.min(F.struct("_end", "_took")).alias("_first"))
    return first.select(_KEY, "_first._end", "_first._took")
