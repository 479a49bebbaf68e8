"""License scans, grid codes and the manifest against plain versions, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgraph.llm import grid_codes as G, license_scan as S, merkle as M, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(label, i) for phrase, label in S.BASE.items() for i in range(len(words)) if words[i:i + phrase.count(" ") + 1] == phrase.split(" ")]
    return len(words), sorted(places, key=lambda p: p[::-1])


TEXTS = [None, "", " \n\t ", "CC-BY", "cc by by cc cc-BY.", "xcc by", "cc byx", "ccby", "All Rights\nReserved. all rights reserved all rights RESERVED", "general public license",
         "İGeneral Public LicenseX general_public_license", "é general public licensé", "cc\x00by", "CC BY-NC 4.0", "GNU General Public License, version 3.", " cc by", "word " * 60_000 + "cc by",
         "SPDX-License-Identifier: MIT OR Apache-2.0", "spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND MIT\nall rights reserved"]


def test_license_base_places_equal_a_plain_scan(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(3, "CC-BY", 2), (None, "cc by", 3)]
    rng = random.Random(4)
    bits = ["cc", "by", "CC", "General", "public", "license", "all", "rights", "reserved", "x", "é"]
    rows += [(100 + k, rng.choice(["", "-", " "]).join(rng.choice(bits) + rng.choice([" ", "-", "\n", "", "_"]) for _ in range(30)), 0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = S.scan_licenses(df).collect()
    assert len(got) == len(rows)
    for r, (d, t, _) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.n_words)), sorted(rows, key=lambda r: (repr(r[0]), plain_base(r[1])[0]))):
        n, places = plain_base(t)
        assert r.doc_id == d and r.n_words == n and sorted([(s.label, s.first_word) for s in r.base_spans], key=lambda p: p[::-1]) == places
        assert 0 <= r.score <= 1
    assert S.scan_licenses(df.limit(0)).count() == 0


def test_license_notices_and_expressions():
    told = {t: S.scan(t) for t in TEXTS}
    assert [s[:2] for s in told["CC BY-NC 4.0"]["found"]] == [("cc-by-nc", 0)] and told["CC BY-NC 4.0"]["score"] == 0.8
    assert {s[0] for s in told["GNU General Public License, version 3."]["found"]} == {"gpl-3.0"}
    assert told[TEXTS[-2]]["expressions"] == [(0, "mit or apache-2.0", ["mit", "apache-2.0"], 0.1)]
    start, text, names, strict = told[TEXTS[-1]]["expressions"][0]  # never closed: licences count, joined by and
    assert (start, names, strict) == (0, ["gpl-2.0-only", "mit"], 0.6) and told[TEXTS[-1]]["score"] == 1.0
    assert S.evaluate("MIT. See the file") == (["mit"], 0.1) and S.evaluate("  ") is None and S.evaluate("and or") is None
    assert S.evaluate("gpl-2.0+ with x-exception and mit")[1] == pytest.approx(0.45)
    assert S.scan("SPDX-License-Identifier: ISC\nSPDX-License-Identifier: GPL-3.0-or-later")["score"] == 0.6
    deep = "(" * 20_000 + "mit" + ")" * 20_000
    assert S.evaluate(deep) == (["mit"], 0.1)


def tree(rng, depth):
    """A random expression as text, with its value."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(["MIT", "gpl-3.0", "cc-by-nc-4.0", "CC0-1.0", "NoSuch-1"])
        value = S.restriction(name.lower())
        return (f"{name} WITH some-exception", value * S.EXCEPTION, 3) if rng.random() < 0.2 else (name, value, 4)
    (a, x, p), (b, y, q) = tree(rng, depth - 1), tree(rng, depth - 1)
    op, rank, fn = rng.choice([("and", 2, max), ("OR", 1, min)])
    wrap = lambda t, own: f"({t})" if own < rank or rng.random() < 0.2 else t
    return f"{wrap(a, p)} {op} {wrap(b, q)}", fn(x, y), rank


def test_license_expressions_equal_their_trees():
    rng = random.Random(9)
    for _ in range(500):
        text, value, _ = tree(rng, 5)
        assert S.evaluate(text)[1] == pytest.approx(value)


def plain_codes(rows):
    """rows (id, vector, label) of one length -> [(id, code, error)], digest."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [[int(np.floor(1024 * float(x))) for x in v] for _, v, _ in rows]
    width = -(-len(q[0]) // 4)
    parts = [[(v + [0] * (4 * width - len(v)))[p * width:(p + 1) * width] for v in q] for p in range(4)]
    books = [own[:256] for own in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(4):
        for p in range(4):
            held = defaultdict(list)
            for x in parts[p]:
                held[near(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else books[p][e] for e in range(len(books[p]))]
    out = []
    for i, (vec, _, label) in enumerate(rows):
        best = [near(parts[p][i], books[p]) for p in range(4)]
        out.append((vec, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    return out, sha(",".join(str(x) for b in books for c in b for x in c))


def test_codes_equal_a_plain_version_on_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=10) * 0.2], i % 3 or None) for i in range(300)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (400, rows[3][1], None), (None, [0.1] * 10, 2), (401, [0.0] * 10, 9), (402, [-0.0001] * 10, 9)]
    other = [(500, [1.0, -2.0, 3.0], 1), (501, [1.0, -2.0, 3.5], None)]
    odd = [(600, None, 1), (601, [float("nan")] * 10, 1), (602, [float("inf")] + [0.0] * 9, 1), (603, [None] + [0.0] * 9, 1), (604, [], 5)]
    made = [(*r, "x", 1) for r in rows + other + odd]
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>, label int, code string, total int").repartition(5)
    want, digest = plain_codes(rows)
    more, second = plain_codes(other)
    by_label = defaultdict(int)
    for r in want + more:
        by_label[r[3]] += r[2]
    expected = [(*r[:3], by_label[r[3]], h) for part, h in ((want, digest), (more, second)) for r in part] + [(604, "00000000", 0, 0, sha(""))]
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in G.compress(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert G.compress(df.where("vec_id = 600")).count() == 0 and G.compress(df.limit(0)).count() == 0


@pytest.mark.parametrize("side", [1, 8, 1000, 1 << 23])
def test_cells_never_lose_the_nearest_entry(side):
    rng = np.random.default_rng(side)
    for scale in (20, 3000, 1 << 23):
        entries = rng.integers(-scale, scale, (200, 5))
        entries[50] = entries[10]  # a tie
        x = rng.integers(-scale, scale, (500, 5))
        x[:10], x[20:30] = entries[50], x[40:50]
        grid = G.Grid(entries, side)
        for _ in range(2):  # the second time from memory
            index, error = grid.nearest(x)
            far = ((x[:, None] - entries[None]) ** 2).sum(2)
            assert (index == far.argmin(1)).all() and (error == far.min(1)).all()


def plain_manifest(rows):
    def h(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tampered(r):
        off = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return h((*r[:4], r[4].replace("\n", ""))) if off else h(r)

    def rise(nodes):
        """Root, and the (left, right) siblings of every place."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                run = place // 3 * 3
                paths[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1:run + 3])))
            nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
            at = [p // 3 for p in at]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[b"0" if r[1] is None else b"1" + r[1].encode()].append((r[0] is not None, r[0] or 0, h(r), tampered(r), r[0]))
    order = sorted(groups)
    made = {g: rise([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = rise([made[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (_, _, leaf, seen, doc), path in zip(sorted(groups[g]), made[g][1]):
            steps = path + above[k]
            at = seen
            for left, right in steps:
                at = sha(left + at + right)
            out.append((doc, leaf, made[g][0], root, sha("".join(x + y for x, y in steps)), at, at == root))
    return out


def test_manifest_equals_a_plain_version(spark, tmp_path):
    rows = [(i, f"s{i % 2 * (i % 7)}", "en", 5, f"text {i}\nmore") for i in range(300)]
    rows += [(i, None, None, None, None if i % 2 else "é\n\n") for i in range(2500, 3300)]  # more than one block
    rows += [(9000, "", "en", 0, ""), (9001, "ü", "", 1, "a"), (None, "s1", "en", 3, "abc"), (None, "s1", "en", 3, "a\nc"), (5, "s9", "x", 1, "same"), (5, "s9", "x", 1, "same"), (4, "lone", "x", 1, "one")]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    df = spark.createDataFrame(rows, schema)
    df.withColumn("leaf", F.lit("z")).withColumn("pos", F.lit(1)).withColumn("_block", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_manifest(spark, str(tmp_path)).collect()
    want = plain_manifest(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.verified for r in got} == {True, False}
    for part in (df.limit(0), df.where("source = 'lone'")):
        out = M.verify(M.manifest(part), "leaf").collect()
        assert len(out) == part.count() and all(r.verified and r.leaf == r.subroot == r.root for r in out)


def test_new_queries_on_odd_documents(spark, tmp_path):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, labels string, n_base int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_licenses(spark, str(tmp_path)).collect()}
    assert got[0].labels == got[1].labels == "" and got[0].first_word is None and got[0].n_words == 0
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (2, 0, 4, "cc-by")
    assert got[13].labels == "cc-by,cc-by-nc" and got[14].labels == "gpl,gpl-3.0" and got[17].labels == "apache-2.0,mit"
    assert got[18].labels == "gpl-2.0-only,mit,reserved" and got[18].base_labels == "reserved" and got[16].first_word == 60_000
