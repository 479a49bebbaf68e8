"""Set join against all pairs, with odd rows."""

import math
import random
import re

import pandas as pd
import pytest

from cellgraph.llm import set_join as S


def plain(rows, words=4, similar=85):
    """rows of (doc_id, text) -> multiset of (doc_id, n, component)."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append(frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def made(seed, n_groups):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 12, 16, 17, 25, 40, 70, 150, 400]))]
        if rng.random() < 0.3:
            base += common
        for _ in range(rng.choice([1, 1, 2, 6])):
            edit = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                edit[rng.randrange(len(edit))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                edit = edit[:max(1, len(edit) - rng.choice([1, 2, 3]))]
            texts.append(" ".join(edit))
    texts += ["", None, "  \n", "one", "One", "a b", "A B c", texts[0], texts[0].upper(), "x " * 3000, "x " * 2900, "É é É é É", "é é é é é"]
    return texts


@pytest.mark.parametrize("seed, words, similar", [(1, 4, 85), (2, 5, 80)])
def test_against_all_pairs(spark, seed, words, similar):
    texts = made(seed, 60)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "only here in this text"), (5000, texts[5]), (5000, texts[5])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n int")
    got, classes, links = S.jaccard_join(docs, words, similar, carry=("n",))
    assert got.columns == ["doc_id", "n", "n_shingles", "class_id", "group_id", "component_id"]
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=repr) == plain(rows, words, similar)
    pairs = {tuple(r) for r in links.collect()}
    assert len(pairs) == links.count() and all(a < b for a, b in pairs)


def test_boundary_forced_small_and_large(spark, monkeypatch):
    texts = made(3, 50)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limit in (22,):
        monkeypatch.setattr(S, "boundary", lambda *_: limit)
        got = S.jaccard_join(docs)[0]
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=repr) == plain(rows)


def test_subsets_of_a_set_are_few_and_come_in_pieces():
    for rule in (S.Rule(), S.Rule(5, 80)):
        sizes = {n: 1000 for n in range(1, 41)}
        limit = S.boundary(sizes, 1.0, rule)  # lists at their longest
        made = [sum(math.comb(n, rule.needed(n, o)) for o in rule.partner_sizes(n) if o <= limit) for n in range(1, limit + 1)]
        assert 0 < limit < 20 and max(made) < 100
    frame = pd.DataFrame({"v": [1], "n": [30], "toks": [list(range(30))]})
    sizes = [len(f) for f in S._subsets(iter([frame]), 30, S.Rule())]
    assert max(sizes) <= S.PIECE and sum(sizes) == sum(math.comb(30, S.Rule().needed(30, o)) for o in S.Rule().partner_sizes(30) if o <= 30)


def test_empty(spark):
    assert S.jaccard_join(spark.createDataFrame([], "doc_id bigint, text string"))[0].count() == 0
