"""Chat examples, mixing and packing against plain versions, with odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from cellgraph.llm import chat_format as C, packing as K, temperature_mix as M


def test_chat_round_trip(spark):
    trap = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo\\n <\\| \\\\ <|"), (1, 2, "user", trap), (1, 3, "assistant", trap), (1, 4, "user", None), (2, 0, "user", "only"),
            (3, 0, "assistant", ""), (3, 1, None, "x"), (3, 1, None, "x"), (3, None, "a\nb\\n<|", "é\n\n"), (None, 0, "assistant", "null id"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"),
            (5, 0, "assistant", "\\" * 7 + "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    examples = C.expand(df)
    got = {r.conv_id: r for r in C.digest(examples).collect()}
    assert len(got) == 6
    parts = examples.collect()
    for conv, r in got.items():
        turns = sorted([x[1:] for x in rows if x[0] == conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        turns = [(t[1] or "", t[2] or "") for t in turns]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        mine = [x for x in parts if x.conv_id == conv]
        assert r.formatted_chars == sum(len(x.text) for x in mine) and len(mine) == r.n_examples
        assert r.n_examples == sum(a == "assistant" for a, _ in turns) + (turns[-1][0] != "assistant")
        assert all(x.text.count(C.START) == x.n_turns for x in mine)
    assert C.digest(C.expand(df.limit(0))).count() == 0


def plain_mix(rows, exponent):
    """rows of (doc_id, source, tokens) -> multiset of (doc_id, source, epoch)."""
    by = {}
    for d, s, n in rows:
        by.setdefault(s, []).append((d, n))
    total = {s: sum(n for _, n in v) for s, v in by.items()}
    all_ = sum(total.values())
    power = {s: (t / all_) ** exponent for s, t in total.items() if t}
    scale = max((total[s] / w for s, w in power.items()), default=0)
    out = []
    for s, docs in by.items():
        whole, rest = divmod(round(power[s] * scale), total[s]) if total[s] else (1, 0)
        order = sorted(docs, key=lambda x: (hashlib.md5(f"mix-1|{whole + 1}|{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or 0, x[1]))
        upto = 0
        for d, n in order:
            upto += n
            out += [(d, s, e) for e in range(1, whole + 1 + (rest > 0 and upto <= rest))]
    return sorted(out, key=repr)


def test_mix_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    rng = random.Random(3)
    rows = [(i, "big", rng.randint(0, 50)) for i in range(900)] + [(1000 + i, f"s{i % 5}", rng.randint(1, 40)) for i in range(200)]
    rows += [(5000, None, 7), (None, "s1", 9), (None, None, 0), (6000, "empty", 0), (6001, "empty", 0), (3, "big", 11), (3, "big", 11)]
    docs = spark.createDataFrame([(d, s, " ".join(["w"] * n) if n or d != 6000 else None, "x") for d, s, n in rows], "doc_id bigint, source string, text string, _block string")
    docs = docs.drop("_block")
    for entropy, limit in ((0.9, None), (0.97, 2.0), (0.1, 2.0), (None, 3.0)):
        exponent = M.find_exponent(M.source_shares(docs, M.word_tokens()), entropy, limit)
        shares = np.array([t for t in {s: sum(n for _, x, n in rows if x == s) for _, s, _ in rows}.values() if t], float)
        p = shares / shares.sum()
        w = p ** exponent / (p ** exponent).sum()
        if entropy == 0.9:
            assert -(w * np.log(w)).sum() == pytest.approx(0.9 * np.log(len(p)), abs=1e-3)
        if entropy is None:
            assert (p.min() / p.max()) ** (exponent - 1) == pytest.approx(3.0, rel=1e-3)
        got = M.mix(docs, entropy, limit).collect()
        assert sorted([(r.doc_id, r.source, r.epoch) for r in got], key=repr) == plain_mix(rows, exponent)
        assert {(r.doc_id, r.source) for r in got} == {(d, s) for d, s, _ in rows}
    assert M.mix(docs.limit(0)).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = K.default_tokenizer()
    tok, enc = Tokenizer.from_file(path), K.Encoder(path)
    rng = random.Random(1)
    bits = ["Hello", "WORLD", "l'été", "don't", "we'll", "é", "ß", "ẞ", "İ", "Σας", "中文", "<|endoftext|>", "<|", "a_b", "x²", "½", "1234", "...", "!!", "'s", "''s", "\t", "\n\n", " ", " ", "\x1c", "\x85",
            "é", "ﬁ", "ǅ", "-", "foo-bar,baz", "🙂", ""]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for text, raw in zip(texts, enc.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def fewest(lengths, capacity):
    """Least number of sequences, by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        tried = set()
        for i, r in enumerate(rooms):
            if r >= lengths[k] and r not in tried:
                tried.add(r)
                go(k + 1, [*rooms[:i], r - lengths[k], *rooms[i + 1:]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(9)
    fixed_some = 0
    for _ in range(400):
        capacity = rng.choice([10, 16, 23])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        count = {x: lengths.count(x) for x in lengths}
        fixed = K.dominant_patterns(count, capacity)
        rest = [x for x, n in count.items() for _ in range(n)]
        assert sum(p.bins for p in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(lengths, capacity)
        assert all(sum(a * b for a, b in p.items) <= capacity for p in fixed)
        fixed_some += bool(fixed)
    assert fixed_some > 300


def test_best_fit_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 50])
        lengths = sorted([rng.randint(1, capacity) for _ in range(rng.randint(1, 60))], reverse=True)
        rooms = []
        for x in lengths:
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - x)
        got = K.best_fit({x: lengths.count(x) for x in lengths}, capacity)
        assert sorted(capacity - sum(a * b for a, b in p.items) for p in got for _ in range(p.bins)) == sorted(rooms)


def test_pack_documents(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(K, "PART_ROWS", 20)
    tok = Tokenizer.from_file(K.default_tokenizer())
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "c,", "42"]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "no id"), (202, "word " * 700), (203, "copy of it"), (203, "copy of it")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, length int")
    got = K.pack_documents(docs, capacity=64, keep_ids=True).collect()
    want = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k // 64, k, ids[k:k + 64]) for k in range(0, len(ids), 64)]
    assert sorted([(r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(n for _, n in parts) <= 64
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 64) + 2
    assert K.pack_documents(docs.limit(0)).count() == 0


def test_points_after_digits_are_set_apart_and_ids_stay():
    from cellgraph.llm import packing

    e = packing.Encoder(packing.default_tokenizer())
    texts = ["in 12. or 7, end.", "x². y", "no?. ... 3.5 a.b", "é. Ünd, _. 's.", "<|im_end|> 1.", "a\x1db 2,", "\u0251. 4."]
    assert list(e.encode(texts)) == [e._whole(t) for t in texts]
    assert "12" in e.words and "12." not in e.words  # one entry for a number, whatever follows it
    assert [e.odd(t) for t in texts] == [False, False, False, False, True, True, True]
