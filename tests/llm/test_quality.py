"""Quality rules against a plain version, with odd rows."""

import functools
import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cellgraph.llm import likelihood_ratio as L


def grams(text):
    t = re.findall(r"\w+|[^\w\s]+", text)
    h = lambda *p: functools.reduce(lambda seed, w: xxhash.xxh64_intdigest(w.encode(), seed), p, 42) >> (64 - L.BITS)
    return [h(a) for a in t] + [h(a, b) for a, b in zip(t, t[1:] + [""])]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_against_plain_version(spark):
    good = " ".join(f"word{i % 37} then{i % 11}" for i in range(60))
    junk = " ".join(f"w{i}***" for i in range(80))
    texts = [good, junk, None, "", " \n\t ", "a b c " * 40, good + "\nsame line\nsame line\n\n\nsame line", "é ü $|<>", "x" * 5000,
             "a b c d a b c " + good, good]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, None, 1]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], "doc_id bigint, text string, _note string")
    labels = spark.createDataFrame([(1, 1), (7, 1), (None, 1), (2, 0), (1, 1)], "doc_id bigint, quality int")
    got = L.score_quality(docs, L.trusted_ids(labels)).collect()
    assert len(got) == len(texts)
    raw, good_n = {}, {}
    for i, t in zip(ids, texts):
        for g in grams(t or ""):
            raw[g] = raw.get(g, 0) + 1
            good_n[g] = good_n.get(g, 0) + (i in (1, 7))
    r, t = sum(raw.values()), sum(good_n.values())
    n = 2 ** L.BITS
    value = lambda g: math.log((good_n.get(g, 0) + 1) / (t + n)) - math.log((raw.get(g, 0) + 1) / (r + n))
    want = {}
    for i, text in zip(ids, texts):
        gs = grams(text or "")
        llr = sum(map(value, gs)) / len(gs) if gs else 0.0
        want.setdefault((i, text), (*base(text or ""), llr))
    for row in got:
        w = want[row.doc_id, row.text]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == w[:6]
        assert row.llr == pytest.approx(w[6])
        assert row.kept == (not w[5] and w[6] >= L.THRESHOLD) and row._note == "clash"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert L.score_quality(docs, L.trusted_ids(labels)).count() == 0


def test_all_trusted_texts_count(spark):
    """However many documents are labelled good, every one is in the trusted count."""
    labels = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    trusted = L.trusted_ids(labels.unionByName(labels))
    assert trusted.count() == 25_000
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 25_000, "fine").otherwise("poor").alias("text"))
    ratios = L.ratio_table(docs, trusted).first()["ratios"]
    buckets = 2 ** L.BITS
    want = math.log((25_000 + 1) / (50_000 + buckets)) - math.log((25_000 + 1) / (60_000 + buckets))
    assert abs(ratios[grams("fine")[0]] - want) < 1e-9
