"""Archives written and read back: exact round trips, payloads that hold records, splits inside everything."""

import hashlib

import pytest

from cellgraph.llm import warc


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def rows():
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    long_ = "é" * 600
    return [(1, "http://a/1", "<p>x</p>"), (2, None, None), (3, "u\r\nWARC-Type: evil", ""), (4, "http://a/é", fake), (5, "x", fake * 3 + "tail"),
            (6, "x", "WARC/1.0\r\n"), (7, "x", "\r\n\r\n" * 5), (8, "y", long_), (9, "y", long_), (10, "y", long_), (11, "z", "x" * 999), (12, "z", "x" * 999),
            (13, "z", "WARC/1.0\r\n" * 200), (14, "z", "WARC/1.0\r\n" * 200), (None, "n", "null id"), (-3, "n", "negative"), (15, "big", "ab\n" * 40000),
            (10, "y", long_), (16, "w", "WARC/1.0")]


def want(data):
    out = []
    for id_, _, html in data:
        body = (html or "").encode()
        best = max((i for i, _, h in data if (h or "") == (html or "") and i is not None), default=None)
        again = len(body) >= 1000 and best != id_
        out.append((id_, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", ["64", "300", "4096", "128m"])
def test_round_trip(spark, tmp_path, small_splits, split):
    pages = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id bigint, url string, html string, payload_digest string")
    path = str(tmp_path / "w")
    warc.write_archives(pages.repartition(3), path)
    small_splits(split)
    got = warc.read_archives(spark, path).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == want(rows())
    assert all(r.payload_digest == r.declared_digest for r in got)
    assert {r.target_uri for r in got if r.page_id == 4} == {"http://a/é"}


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
