"""Components against union-find, and verdicts that filters do not rewrite."""

import random

from cellgraph.llm.common import smallest_reachable


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(500, k) for k in range(501, 560)] + [(1000 + k, 1000 + (k * 7 + 1) % 90) for k in range(60)] + [(7000, 7000)]
    edges += [(2000 + k, 2001 + k) for k in range(70)]
    up = {n: n for e in edges for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.component for r in smallest_reachable(df, "a", "b").collect()} == {n: root(n) for n in up}
    assert smallest_reachable(df.limit(0), "a", "b").count() == 0
