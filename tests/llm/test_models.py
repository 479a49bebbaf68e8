"""Learnt operators: held-out accuracy on the given tables, exact rules against plain patterns, odd rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgraph.llm import itq, language_codes as L, pii_lstm as P, toxicity as T
from cellgraph.llm.common import fold

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "123 !!"), (5, "the " * 30000), (5, "the " * 30000), (None, "und der die das")]


def odd(spark, extra="clash"):
    return spark.createDataFrame([(d, t, extra) for d, t in ODD], f"doc_id bigint, text string, {extra} string")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(L.training_rows(docs, fold("doc_id", 4) != 2))
    rows = L.identify(docs.where(fold("doc_id", 4) == 2), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    got = {(r.doc_id, r.lang_pred) for r in L.identify(odd(spark, "score"), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= got and {r[1] for r in got if r[0] == 5} != {"und"}
    assert {r.lang_pred for r in L.identify(odd(spark), None).collect()} == {"und"}
    assert L.training_rows(docs.limit(0), fold("doc_id", 4) != 2) == []


def test_only_letters_count():
    from cellgraph.llm import language_codes as C

    for text in ("²", "½ ①", "Ⅷ", "12_3", "", None, "!?\u0661", "🙂"):
        assert C.features(text) is None
    for text in ("é", "x²y", "一", "ß1"):
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        assert C.letters(text).tolist() == [ord(c) for c in f" {' '.join(plain.split())} "] and C.features(text) is not None


def test_features_and_decoding_equal_a_plain_version():
    def plain(text):
        c = [0x20, *map(ord, " ".join("".join(ch if ch.isalpha() else " " for ch in text.lower()).split())), 0x20]
        counts = [0] * L.BUCKETS
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 % 2 ** 32) ^ ((c[i + k] * 0x9E3779B1 + k) % 2 ** 32)
                counts[((h ^ (h >> 15)) * 0x85EBCA6B) % 2 ** 32 >> 20] += 1
        return np.sqrt(np.array(counts) / sum(counts))

    for text in ("a", "Das ist 3 mal so viel, oder?", "\u00c9t\u00e9 \u00bd \u65e5\u672c x" * 40):
        assert np.allclose(L.features(text), plain(text))
    rng = np.random.default_rng(3)
    codes = L.codewords(9)
    model = L.Model(list("abcdefghi"), codes, rng.normal(size=(L.BUCKETS, codes.shape[1])), rng.normal(size=codes.shape[1]), rng.uniform(0.1, 2, codes.shape[1]))
    x = np.stack([L.features(t) for t in ("one text", "ein Text", "un texte encore")])
    for row, best, score in zip(x, *model.decode(x)):
        margin = np.clip(row @ model.weights + model.bias, -8, 8)
        losses = [sum(t * np.exp(-m * c) for m, c, t in zip(margin, code, model.trust)) / model.trust.sum() for code in codes]
        first, second = sorted(losses)[:2]
        assert losses[best] == pytest.approx(first) and score == pytest.approx(1 - first / (first + second))


def test_all_languages_are_learnt_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(L, "TOTAL_ROWS", 600)
    rows = [(k * 300 + i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" * 3, f"l{i:03}") for k in range(4) for i in range(300)]
    rows += [(5000 + k, "long " * 5000, "only-long") for k in range(12)] + [(6000 + k, f"short {k}", "common") for k in range(900)]
    rows += [(7000 + k, "very " * 5000, "common") for k in range(9)] + [(8000, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("cap", F.lit(1))
    got = L.training_rows(df, F.lit(True))
    per = {lang: sum(x == lang for _, x in got) for lang in {x for _, x in got}}
    assert len(per) == 302 and per["only-long"] == 5 and per["common"] == 5 and {per[f"l{i:03}"] for i in range(300)} == {4}
    assert not any(lang == "common" and len(text) > L.FIT_CHARS for text, lang in got) and got == L.training_rows(df.repartition(5), F.lit(True))
    assert L.training_rows(df.limit(0), F.lit(True)) == []


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 25):
        c = L.codewords(n)
        assert c.shape[0] == n and set(np.unique(c)) <= {-1.0, 1.0}
        assert (np.abs(c.sum(0)) < n).all()
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= max(1, c.shape[1] // 4)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.fit(T.training_rows(docs, labels, fold("doc_id", 3) != 1, 2500))
    held = docs.where(fold("doc_id", 3) == 1).join(labels, "doc_id").select("doc_id", "text", "toxic")
    rows = T.score(held, model).collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85
    assert sum(r.predicted for r in clean) / len(clean) < 0.01
    got = T.score(odd(spark, "score").drop("score"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in T.score(odd(spark), T.fit([])).collect()} == {0.0}
    weights = T.Weights(model.lexicon)
    assert weights["idiot,"] > 0 and weights["1d10t!"] < 0 and weights["id.iot"] != 0 and weights["river"] == 0


def test_toxicity_without_a_lexicon_hit():
    """Shouted second-person texts of words that are in no lexicon differ from calm ones, and are learnt."""
    at = [T.NAMES.index(k) for k in ("second", "capitals", "shouted")]
    loud, calm = (T.measure(t, T.Weights({})) for t in ("Well, YOU are a ZORBLAX today.", "well, we are a zorblax today."))
    assert [loud[k] for k in at] == [1 / 6, 11 / 30, 2 / 6] and [calm[k] for k in at] == [0, 0, 0]
    assert T.measure(" \n ", T.Weights({}))[:-1] == [0] * 11 and len(T.measure("", T.Weights({}))) == len(T.NAMES)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfgklmnprstvz") for _ in range(9))
    text = lambda toxic: " ".join(word().upper() if toxic and k < 6 else word() for k in range(20))
    rows = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(600)]
    model = T.fit(rows)
    assert not model.lexicon
    score = model.score(np.array([T.measure(text(toxic), T.Weights({})) for toxic in (1, 0) for _ in range(50)]))
    assert (score[:50] >= 0.7).mean() > 0.9 and (score[50:] >= 0.7).mean() < 0.1


def test_isotonic_is_monotone_and_pools():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * raw))).astype(float)
    xs, ys = T.isotonic(raw, y)
    assert (np.diff(ys) >= -1e-12).all() and (np.diff(xs) >= 0).all()
    assert np.interp(raw, xs, ys).mean() == pytest.approx(y.mean(), abs=0.02)


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and P.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_rules_equal_the_patterns(spark):
    rng = random.Random(4)
    pieces = ["a.b", "@", "x-y", ".", "..", "c@d", ".com", " ", "é", "1", "25", "255", "256", "001", "+", "+1 ", "(414) ", "555-7134", "-", "4111111111111111", "4111 1111 1111 1111", "\n", "_", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert P.base_spans(text) == plain_spans(text), text
    for text in ("a" * 200000 + " @", "1" * 200000, "1." * 100000, "+1" * 50000):  # linear, or this never ends
        P.base_spans(text)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert P.base_spans(r.text) == plain_spans(r.text)


def test_network_gradients():
    net = P.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = P._examples(["nothing here at all, really"], 4)
    x, y = x[:, :12].astype(np.int64), y[:, :12]
    y[y > 0] = 0
    y[0, 3], y[0, 4:6] = 1, 2
    _, g = net.gradients(x, y)
    rng = np.random.default_rng(0)
    for name in net.p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape) if name[0] != "e" else (int(x[0, rng.integers(12)]), int(rng.integers(net.p[name].shape[1])))
            kept = net.p[name][at]
            net.p[name][at] = kept + 1e-3
            up = net.gradients(x, y)[0]
            net.p[name][at] = kept - 1e-3
            down = net.gradients(x, y)[0]
            net.p[name][at] = kept
            assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)


def test_decoding_is_the_best_of_all_paths():
    """Every tag path is tried, between two outside positions; rows filled up with outside positions decode as without."""
    rng = np.random.default_rng(8)
    net = P.Network.fresh()
    for _ in range(5):
        net.p["t"] = rng.normal(0, 1, (P.TAGS, P.TAGS)).astype(np.float32)
        a = rng.normal(0, 2, (3, 4, P.TAGS)).astype(np.float32)
        steps = net.p["t"] + P._allowed()
        got = net.decode(a)
        for row in range(3):
            worth = lambda path: sum(a[row, k, c] for k, c in enumerate(path)) + sum(steps[b, c] for b, c in zip((0, *path), (*path, 0)))
            assert tuple(got[row]) == max(itertools.product(range(P.TAGS), repeat=4), key=worth)
        filled = np.full((3, 7, P.TAGS), P._BANNED, np.float32)
        filled[:, :, 0] = 0
        filled[:, :4] = a
        assert (net.decode(filled)[:, :4] == got).all()


def test_windows_are_averaged_over_the_whole_text():
    """Emissions are the weighted mean of all windows over a position; stretches keep their place whatever runs beside them."""
    net = P.Network.fresh()
    text = "abc 12 " + "x" * 120 + " 99 tail"
    (one,) = P._stretches(0, text)
    mass, total = np.zeros(len(text)), np.zeros((len(text), P.TAGS))
    codes = P.symbols(text)
    for at in range(-3 * P.STEP - P.STEP // 2, len(text), P.STEP):
        if at + P.WINDOW <= 0:
            continue
        x = np.array([[codes[p] if 0 <= p < len(text) else 95 for p in range(at, at + P.WINDOW)]], np.int64)
        scores = net.scores(x)[0]
        for k in range(P.WINDOW):
            if 0 <= at + k < len(text):
                w = min(k + 1, P.WINDOW - k)
                total[at + k] += w * scores[k]
                mass[at + k] += w
    assert one.start == 0 and len(one.codes) == len(text)
    assert np.allclose(P._emissions([one], net)[0], total / mass[:, None], atol=1e-4)
    far = ["y" * 1000 + text, text, "", "no hint", "1" + "z" * 700 + "2"]
    runs = [r for k, t in enumerate(far) for r in P._stretches(k, t)]
    assert [r.text for r in runs] == [0, 1, 4, 4] and 1000 - 3 * P.WINDOW <= runs[0].start < 1000 - P.WINDOW
    together = P._tagged(runs, net)
    assert all((P._tagged([r], net)[0] == tags).all() for r, tags in zip(runs, together))


def test_network_adds_spans_and_leaves_clean_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = P.train(P.training_texts(docs))
    hits = 0
    filler = "Erst wenn die letzten Worte gesagt sind, beginnt das Lesen von vorn und alles geht weiter. " * 3
    for value, kind in (("(414) 555-7134", "phone"), ("414-555-7134", "phone"), ("4111.1111.1111.1111", "card"), ("joe.b @ site.example.com", "email")):
        for gap in (0, 37, 90, 131):
            text = filler[:gap].rstrip() + " " * bool(gap) + value + " " + filler
            base, more = P.find_spans([text], net)[0]
            a = text.index(value)
            assert not base
            hits += (kind, a, a + len(value)) in more
    assert hits == 16
    clean = [filler, "on 2021-03-04 at 12:30 for $12.50, v1.2.3, id 123456789", "", "x" * 5000, "1" * 300]
    assert all(not b and not m for b, m in P.find_spans(clean, net))
    found = P.find_private(odd(spark, "spans"), net).collect()
    assert len(found) == len(ODD) and all(r.spans == "" for r in found)
    rows = [(1, "mail a.b@c.example.com now", 9), (2, None, 4), (3, "", None), (4, "call +1 (414) 555-7134 or 10.0.0.1", 0)]
    out = {r.doc_id: (r.text, r.n_chars) for r in P.redact(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint"), net).collect()}
    assert out == {1: ("mail [EMAIL] now", 16), 2: (None, 4), 3: ("", 0), 4: ("call [PHONE] or [IP]", 20)}


def test_embeddings_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24))
    x = [*base, *(base[:120] + rng.normal(size=(120, 24)) * 0.22), *(base[0] + rng.normal(size=(60, 24)) * 0.05)]
    rows = [(i * 7 % 997, [float(np.float32(v)) for v in vec]) for i, vec in enumerate(x)]
    nan = float("nan")
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [nan] * 24), (2004, [1.0, None] + [0.0] * 22), (2005, [1.0, 2.0]), (2006, rows[5][1]), (2007, rows[5][1]),
             (None, rows[5][1]), (2008, [float("inf")] * 24)]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id bigint, embedding array<float>, key string")
    got = itq.near_duplicates(df)[0].collect()
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert sum(r.n_links for r in got) >= 0.9 * link.sum() and len(got) == len(rows)
    true = {}
    for k, (i, _) in enumerate(good):
        true[i] = int(link[k].sum())
    for r in got:
        assert r.n_links <= true.get(r.vec_id, 0)
        if r.vec_id is not None and r.vec_id not in true:
            assert r.component_id == r.vec_id and r.kept
    assert {r.n_links for r in got if r.vec_id in (2006, 2007, None)} == {true[2006]}
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert itq.near_duplicates(empty)[0].count() == 0


@pytest.mark.parametrize("width", [12, 15, 20, 21, 27])
def test_embedding_lists_stay_short_and_pairs_meet(width):
    """Of 2**width vectors each meets about (1 + width) others in a table, whatever is left of the code; pairs at the threshold still meet."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    mean, turns = itq.learn(x)
    places = itq.tables(itq.trials(x, mean, turns, 0.95), width)
    assert all(len(set(at)) == width for own in places for at in own)
    assert all(set().union(*own) == set(range(64)) for own in places)
    u = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True)
    y = rng.normal(size=u.shape)
    y -= (y * u).sum(1, keepdims=True) * u
    y = 0.95 * u + (1 - 0.95 ** 2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = np.zeros(len(u), bool)
    for own, turn in zip(places, turns):
        apart = ((u - mean) @ turn >= 0) != ((y - mean) @ turn >= 0)
        for at in own:
            met |= apart[:, at].sum(1) <= 1
    assert met.mean() > 0.97


def test_embedding_candidates_per_vector(spark, monkeypatch):
    """4,096 vectors (keys of 12 bits, and 64 is no multiple): pairs that meet are counted before their distance is looked at."""
    x = np.random.default_rng(4).normal(size=(4096, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v bigint, x array<double>")
    made = itq.trials
    monkeypatch.setattr(itq, "trials", lambda sample, mean, turns, _: made(sample, mean, turns, 0.95))  # -1.0: every pair is returned
    monkeypatch.setattr(itq, "reach", lambda apart: [64] * len(apart))
    pairs = itq._search(df, x, len(x), -1.0).count()
    assert pairs < 200 * len(x)


def _alike(x):
    """For each vector, how many others have a cosine of at least 0.95 with it, by all pairs."""
    u = itq.scaled(x)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    return ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def test_embeddings_that_share_a_mean_or_a_plane(spark):
    """Vectors that signs tell apart badly: random pairs at cosine 0.92 and 0.93, and clusters inside a plane of few dimensions."""
    rng = np.random.default_rng(5)
    for share in (0.92, 0.93):
        x = share ** 0.5 * np.eye(1, 64) + (1 - share) ** 0.5 * rng.normal(size=(700, 64)) / 8
        got = itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"))[0].collect()
        true = _alike(x)
        assert sum(true) > 300 and all(r.n_links <= true[r.vec_id] for r in got)
        assert sum(r.n_links for r in got) >= 0.9 * sum(true), share
    x = rng.normal(size=(60, 6))[rng.integers(0, 60, 700)] @ rng.normal(size=(6, 64)) + 0.4 * rng.normal(size=(700, 64))
    got = itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"))[0].collect()
    assert sum(r.n_links for r in got) >= 0.9 * sum(_alike(x)) > 0


def test_embeddings_of_all_lengths_and_sizes_of_components(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 5))
    rows = [(i, (v * f).tolist()) for i, (v, f) in enumerate((v, f) for v in base for f in (1.0, 1e200, 1e-200))]
    rows += [(1000, [1.0, 1.0]), (1001, [1.0, 1.0]), (1002, [1.0, -1.0]), (1003, [3.0]), (1004, [2.0]), (1005, [-1.0]), (1006, [1.0] * 9)]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))[0].collect()}
    true = _alike(np.array([v for _, v in rows[:120]]))
    assert [got[i].n_links for i in range(120)] == true and min(true) >= 2
    assert [(got[i].n_links, got[i].component_id) for i in range(1000, 1007)] == [(1, 1000), (1, 1000), (0, 1002), (1, 1003), (1, 1003), (0, 1005), (0, 1006)]


def test_letters_are_found_at_the_same_cost_in_any_text():
    import time

    from cellgraph.llm import language_codes

    def plain(text):
        out = ""
        for c in f" {text.lower()} ":
            out += c if c.isalpha() else "" if out.endswith(" ") else " "
        return out if out.strip() else ""

    for text in ("", "7 ²Ⅷ_", "a", "Ab²c  d\n7e_", "İx 一二 3", "\ud800q", "\U00010107z\U00020000"):
        got = language_codes.letters(text)
        assert got.tobytes().decode("utf-32-le", "surrogatepass") == plain(text), text
    started = time.process_time()
    assert len(language_codes.letters("word and number 12, " * 50_000)) > 800_000
    assert time.process_time() - started < 0.5  # a pattern that names every numeral took about 2 s


def test_embedding_joins_are_never_broadcast(spark):
    # what is exploded from a small written table is sized like that table
    x = np.random.default_rng(5).normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        pairs = itq._search(df.select(F.col("vec_id").alias("v"), F.col("embedding").alias("x")), x, len(x), 0.5)
        for out in (pairs, itq.near_duplicates(df)[0]):
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
