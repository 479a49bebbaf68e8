"""The stages one by one on the smallest table, each against a plain version on its own input; and the queries' contracts."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellgraph.llm import likelihood_ratio as L, pii_lstm as P, queries, set_join, temperature_mix as M

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_chat_mix_pack import plain_mix  # noqa: E402
from test_quality import base  # noqa: E402
from test_set_join import plain  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.limit(3)  # repeated rows
    odd = spark.createDataFrame([(9001, None, None, None, None), (None, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(again).unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        after = [r.asDict() for r in out.collect()]
        if k < 4:
            assert out.columns == docs.columns
        if name == "quality_rules":
            good = [r for r in before if not base(r["text"] or "")[5]]
            assert len(after) <= len(good) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in good}
            assert len(after) > 0.8 * len(good)
        elif name == "near_copies":
            want = {d for d, _, c in plain([(r["doc_id"], r["text"]) for r in before], 5, 80) if d == c}
            assert sorted(r["doc_id"] for r in after) == sorted(want)
        elif name == "private_data":
            assert len(after) == len(before)
            texts = {r["doc_id"]: r["text"] for r in after}
            for r in before:
                if not re.search("[0-9@]", r["text"]):
                    assert texts[r["doc_id"]] == r["text"]
                assert not P.base_spans(texts[r["doc_id"]])
                for kind, a, b in P.base_spans(r["text"]):
                    assert f"[{kind.upper()}]" in texts[r["doc_id"]]
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "mixing":
            rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in before]
            exponent = M.find_exponent(M.source_shares(docs, M.word_tokens()), 0.97, 2.0)
            assert sorted(r["doc_id"] for r in after) == sorted(d for d, _, _ in plain_mix(rows, exponent))
        else:
            ids = {r["doc_id"] for r in before}
            assert {r["doc_id"] for r in after} == ids and len({(r["sequence_id"], r["offset"]) for r in after}) == len(after)
            fill = {}
            for r in after:
                fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
            assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) // 4096 + 2
        docs = out


def test_near_copies_keep_one_of_repeated_and_unnamed_rows(spark):
    from cellgraph.llm import stages

    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text, "a"), (3, text + " more", "b"), (3, text + " more", "b"), (None, text, "c"), (None, "one two three four five six", "d"), (None, "one two three four five six", "d"), (7, "", "e"), (7, "", "e"), (8, None, "f")]
    got = stages.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), SF)
    assert sorted([(r.doc_id, r.source) for r in got.collect()], key=repr) == [(3, "b"), (7, "e"), (7, "e"), (8, "f"), (None, "d")]


def test_near_copies_tell_rows_with_one_id_apart(spark):
    from cellgraph.llm import stages

    t1, t2, t3 = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    for rows, want in (([(7, t1), (7, t2), (9, t3)], [(7, t1), (7, t2), (9, t3)]), ([(1, t1), (7, t1), (7, t2)], [(1, t1), (7, t2)]),
                       ([(None, t1), (None, t2), (4, t1), (4, t1)], [(4, t1), (None, t2)]), ([(5, t1 + " x"), (5, t1)], None)):
        got = [(r.doc_id, r.text) for r in stages.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr) if want else len(got) == 1 and got[0] in rows


CLASHING = ["rest", "whole", "_n", "_digits", "_start", "_good", "_t", "_w", "_ratios", "_words", "n_words", "llr", "kept", "epoch", "_h", "_d", "_k", "_wins", "_grams", "row", "n", "key",
            "toks", "v", "_in0", "_draw", "_block", "_end", "_took", "_place", "_more", "_epoch", "_source_key", "bucket", "group_id", "first", "spans", "base_spans", "piece", "start", "length"]


def test_columns_named_like_helpers_pass_untouched(spark):
    from cellgraph.llm import stages

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in CLASHING])
    for stage in (stages.quality_rules, stages.near_copies, stages.mixing, stages.private_data):
        plainly = stage(spark, docs, SF).select("doc_id").collect()
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns
        bad = got.where(" OR ".join(f"`{c}` <> concat_ws('-', '{c}', doc_id)" for c in CLASHING)).count()
        assert bad == 0 and sorted(got.select("doc_id").collect()) == sorted(plainly), stage.__name__


def test_empty_documents_go_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    from oracle import compare, connect

    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None
