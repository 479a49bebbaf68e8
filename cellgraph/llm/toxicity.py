"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed insult list and of a lexicon learnt from labelled rows (words and word beginnings), the densest
passage, closeness of hits to second-person words, capitals, punctuation, and words that are hits only once
obfuscation (digits or signs for letters, stretched or spaced letters) is undone. Histogram trees of depth 3 are boosted in numpy; raw scores of held-out folds give
the isotonic map to probabilities.

Fitting uses at most FIT_ROWS labelled rows (the smallest by hash; texts above FIT_CHARS characters are not drawn); scoring reads every text
whole, in tasks, without a shuffle.

Nulls and odd rows: a null text is empty, and an empty text gets the score of a text without any hit; rows with a null label or id are never learnt
from; several labels of one document count as its largest; with no labelled row, or one class only, the score is that class's share (0.0 without rows); repeated rows are
scored one by one; other columns are kept (score and predicted are replaced).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import hashed_sample, text_of

FIT_ROWS, FIT_CHARS = 6000, 20_000
TOXIC_AT = 0.7
WINDOW, NEAR = 80, 5
#: Plain insults every model starts with.
INSULTS = frozenset("idiot idiots stupid moron morons trash scum loser losers pathetic worthless disgusting clown clowns dumb fool ugly jerk".split())
#: Second-person words of the corpus' languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
#: Signs written for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
NAMES = ("insults", "lexicon", "hits", "densest", "near_second", "second", "capitals", "shouted", "marks", "signs", "obfuscated", "log_words")
_WORD = re.compile(r"[^\W\d_]+")
_STRETCH = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[*._\-~+^]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
_EDGE = ".,;:!?\"'()[]{}<>…«»“”„"
_MEMO = 300_000


class Weights(dict):
    """token -> lexicon weight of its word, through the word itself or its beginnings; negative where only the plain form of an
    obfuscated token is a hit; remembers what it was asked."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {t[:4].rstrip("~") for t in lexicon} | {w[:4] for w in INSULTS}

    def word(self, word: str) -> float:
        if word[:4] not in self.heads:
            return 0.0
        get = self.lexicon.get
        return max(get(word, 0.0), *(get(word[:k] + "~", 0.0) for k in (4, 5, 6)), 2.0 if word in INSULTS else 0.0)

    def __missing__(self, token: str) -> float:
        word = token.strip(_EDGE)
        found = 0.0
        if word.isalpha():
            found = self.word(word)
        elif any(c.isalpha() for c in word):
            parts = _WORD.findall(word)
            found = max(map(self.word, parts)) or -self.word(_STRETCH.sub(r"\1", _INNER.sub("", word.translate(LEET))))
        if len(self) > _MEMO:
            self.clear()
        self[token] = found
        return found


class _Second(dict):
    """token -> whether it is a second-person word; remembers what it was asked."""

    def __missing__(self, token: str) -> bool:
        if len(self) > _MEMO:
            self.clear()
        found = self[token] = token.strip(_EDGE) in SECOND
        return found


_second = _Second()


def terms(text: str) -> set[str]:
    """Words and marked word beginnings of a text, as the lexicon holds them."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:k] + "~" for w in found for k in (4, 5, 6) if len(w) >= k}


def one_of_each(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows without near copies, which would make chance words look frequent: one for each three smallest word hashes and label."""
    seen, out = set(), []
    for text, y in rows:
        key = (y, *sorted(zlib.crc32(w.encode()) for w in set(_WORD.findall(text.lower())))[:3])
        if key not in seen:
            seen.add(key)
            out.append((text, y))
    return out


def learn_lexicon(rows: list[tuple[str, int]], least: float = 24.0) -> dict[str, float]:
    """Terms far more frequent (by documents) in toxic rows: term -> log ratio. least: smallest log-likelihood ratio."""
    toxic, clean = Counter(), Counter()
    rows = one_of_each(rows)
    n = [sum(1 for _, y in rows if not y), sum(1 for _, y in rows if y)]
    for text, y in rows:
        if y:
            toxic.update(terms(text))
    often = {t for t, a in toxic.items() if a >= 5}
    for text, y in rows:
        if not y:
            clean.update(terms(text) & often)
    out = {}
    for term in often:
        a, b = toxic[term], clean[term]
        pa_, pb, p = a / n[1], b / max(1, n[0]), (a + b) / sum(n)
        if pa_ <= 4 * pb:
            continue
        g = 2 * (a * math.log(pa_ / p) + (b * math.log(pb / p) if b else 0.0))
        if g >= least:
            out[term] = min(4.0, math.log((a + 0.5) / n[1] / ((b + 0.5) / max(1, n[0]))))
    return out


def measure(text: str | None, weights: Weights) -> list[float]:
    """The features of one text, in the order of NAMES; all but those of hits are measured in every text."""
    text = text or ""
    low = text.lower()
    tokens = low.split()
    n = len(tokens)
    w = np.fromiter(map(weights.__getitem__, tokens), np.float64, n)
    at = np.flatnonzero(w)
    spaced = sum(weights.word(_INNER.sub("", m.replace(" ", ""))) > 0 for m in _SPACED.findall(low))
    hidden = int((w < 0).sum()) + spaced
    w = np.abs(w)
    insults = near = 0
    densest = 0.0
    second = sum(map(_second.__getitem__, tokens)) / max(1, n)
    capitals = sum(text.count(c) for c in set(text) if c.isupper()) / max(1, len(text))
    shouted = sum(len(t) > 1 and t.isupper() for t in text.split()) / max(1, n)
    if len(at):
        insults = sum(tokens[i].strip(_EDGE) in INSULTS for i in at)
        near = sum(any(map(_second.__getitem__, tokens[max(0, i - NEAR):i + NEAR + 1])) for i in at)
        total = np.concatenate([[0.0], np.cumsum(w[at])])
        densest = float((total[np.searchsorted(at, at + WINDOW)] - total[:-1]).max())
    per, size = 100.0 / max(20, n), max(1, len(text))
    return [insults * per, float(w.sum()) * per, float(len(at)), densest, near * per, second, capitals, shouted, (text.count("!") + text.count("?")) / size,
            sum(map(text.count, "*#$%&@")) / size, float(hidden), math.log1p(n)]


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features; node k has children 2k+1 and 2k+2."""

    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2 ** self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Logistic gradient boosting with histogram splits."""
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for v in x.T]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(edges, math.log(share / (1 - share)), [], depth)
    b, raw = model.binned(x), np.full(len(x), model.start)
    wide = bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        inner = 2 ** depth - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, wide), np.zeros(len(x), int)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            if len(rows) >= 20:
                best = 1e-6
                for f in range(x.shape[1]):
                    gs, hs = (np.bincount(b[rows, f], v[rows], wide).cumsum()[:-1] for v in (g, h))
                    gt, ht = g[rows].sum(), h[rows].sum()
                    gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], f, at
            node[rows] = 2 * k + 1 + (b[rows, feature[k]] > cut[k])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += value[leaf]
        model.trees.append((feature, cut, value))
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on raw (pool adjacent violators), for linear interpolation."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, low, high
    for r, v in zip(raw[order], y[order]):
        blocks.append([float(v), 1.0, float(r), float(r)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, c, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = high
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return xs, ys


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    xs: np.ndarray
    ys: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.ys[0])
        return np.clip(np.interp(self.trees.raw(x), self.xs, self.ys), 0, 1)


def _matrix(texts: list[str], lexicon: dict[str, float]) -> np.ndarray:
    weights = Weights(lexicon)
    return np.array([measure(t, weights) for t in texts]).reshape(-1, len(NAMES))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Model of (text, toxic) rows.

    A lexicon fits its own rows too well, so each half of the rows is measured by the other half's; and each half's trees
    score the other half for the calibration. The final lexicon is of all rows.
    """
    y = np.array([t for _, t in rows], float)
    halves = [np.arange(len(y)) % 2 == k for k in (0, 1)]
    if any(len(set(y[h])) < 2 for h in halves):
        return Model({}, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    x, held = np.zeros((len(y), len(NAMES))), np.zeros(len(y))
    for mine, other in (halves, halves[::-1]):
        x[mine] = _matrix([r[0] for r, m in zip(rows, mine) if m], learn_lexicon([r for r, o in zip(rows, other) if o]))
    for mine, other in (halves, halves[::-1]):
        held[mine] = boost(x[other], y[other]).raw(x[mine])
    return Model(learn_lexicon(rows), boost(x, y), *isotonic(held, y))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = FIT_ROWS) -> list[tuple[str, int]]:
    """At most `rows` (text, toxic) rows whose doc_id satisfies learn, the smallest by hash of those labelled."""
    marked = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = hashed_sample(marked, 2 * rows, "doc_id")
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where(F.char_length(text_of()) <= FIT_CHARS)
    return [(r["text"] or "", int(r["toxic"])) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()]


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    weights = Weights(model.lexicon)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        x = np.array([measure(t.as_py(), weights) for t in texts]).reshape(-1, len(NAMES))
        score = model.score(x)
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score), pa.array((score >= TOXIC_AT).astype(np.int32))], [*kept.schema.names, "score", "predicted"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, plus score (0 to 1) and predicted (1 from TOXIC_AT on)."""
    df = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    rest = [(n, t) for n, t in df.dtypes if n != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*rest, ("score", "double"), ("predicted", "int")])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(lambda it: _score(it, shared.value), schema)
