"""Language ID with error-correcting output codes.

Every language gets a codeword; for each bit a linear classifier over hashed character n-grams (1 to 3, lower-cased, anything but
letters one blank) is trained to predict it. A text's bits are decoded to the codeword of least weighted loss: exp(-margin) per bit,
weighted by how well that bit did on held-back training texts. The score compares the two best codewords, and texts whose score
is below AMBIGUOUS are flagged.

Every language is learnt. Fitting uses a bounded sample: ROWS_PER_LANGUAGE texts a language, the smallest by hash, or as many fewer as keep all languages
together at TOTAL_ROWS (but LEAST_ROWS each). Texts above FIT_CHARS characters are drawn only where a language has no others, LEAST_ROWS of them. Features are held
as 32-bit floats and read in blocks, so TOTAL_ROWS bounds the driver's memory. Prediction reads every text whole, in tasks, without a shuffle.

Nulls and odd rows: a null text, or one without a letter, is `und` with score 0.0 and ambiguous; rows with null lang are never learnt from; a corpus
without a learnable row gives `und` throughout; repeated rows are predicted one by one; other columns are kept (lang_pred, score and ambiguous are replaced).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

UNKNOWN = "und"
BUCKETS = 4096
ROWS_PER_LANGUAGE, TOTAL_ROWS, LEAST_ROWS, FIT_CHARS = 800, 16_000, 5, 20_000
AMBIGUOUS = 0.6
_STEPS, _RATE, _DECAY, _BLOCK = 250, 0.5, 1e-4, 4000
# by code point; numerals like a raised two or a Roman eight are no letters
_IS_LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
_BLANK = 32


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1/-1. All distinct splits for up to 6 languages, else random ones far apart; never a constant or repeated column."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([[1 if (k >> i) & 1 or i == n - 1 else -1 for k in range(2 ** (n - 1) - 1)] for i in range(n)], float)
    rng = np.random.default_rng(seed)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    best, apart = None, -1
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (n, bits))
        m[0, np.abs(m.sum(0)) == n] *= -1
        alike = m @ m.T
        np.fill_diagonal(alike, -bits)
        far = int(bits - alike.max()) // 2
        if far > apart:
            best, apart = m, far
    return best


def letters(text: str | None) -> np.ndarray:
    """Code points of a text, lower-cased, with one blank for whatever is not a letter, and around it."""
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _IS_LETTER[c]
    if not letter.any():
        return np.empty(0, np.uint32)
    first_blank = ~letter
    first_blank[1:] &= letter[:-1]  # of a run of others only the first stays, as a blank
    kept = letter | first_blank
    return np.where(letter, c, np.uint32(_BLANK))[kept]


def features(text: str | None) -> np.ndarray | None:
    """Relative counts of hashed n-grams, square roots taken; None without a letter."""
    c = letters(text)
    if not len(c):
        return None
    total = np.zeros(BUCKETS)
    h = np.zeros(len(c), np.uint32)
    for n in range(3):
        h = (h[:len(c) - n] * np.uint32(0x01000193)) ^ (c[n:] * np.uint32(0x9E3779B1) + np.uint32(n))
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        total += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(total / total.sum())


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language number and score (share of the best codeword against the runner-up) of each row of features."""
        margins = np.clip(x @ self.weights + self.bias, -8, 8)
        loss = (np.exp(-margins[:, None, :] * self.codes[None]) * self.trust).sum(2) / self.trust.sum()
        order = np.argsort(loss, 1, kind="stable")
        rows = np.arange(len(x))
        best = loss[rows, order[:, 0]]
        second = loss[rows, order[:, 1]] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return order[:, 0], np.clip(1 - best / np.where(np.isinf(second), 1e300, best + second), 0, 1)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Model from (text, lang) rows; texts without a letter are passed over."""
    x, named = np.empty((len(rows), BUCKETS), np.float32), []
    for text, lang in rows:
        if (f := features(text)) is not None:
            x[len(named)] = f
            named.append(lang)
    if not named:
        return None
    languages = sorted(set(named))
    codes = codewords(len(languages))
    number = {lang: k for k, lang in enumerate(languages)}
    x, y = x[:len(named)], np.array([number[lang] for lang in named])
    held = np.arange(len(x)) % 5 == 4
    target = codes[y]
    # class sizes differ: every language weighs the same
    share = 1.0 / np.bincount(y[~held], minlength=len(languages))[y[~held]].clip(1)
    share /= share.sum()
    w, b = np.zeros((BUCKETS, codes.shape[1])), np.zeros(codes.shape[1])
    grow, grow_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    a, t = x[~held], target[~held]
    for _ in range(_STEPS):  # logistic loss, one adaptive full-batch step each; rows are widened a block at a time
        g, gb = _DECAY * w / len(languages), np.zeros_like(b)
        for at in range(0, len(a), _BLOCK):
            own, wanted = a[at:at + _BLOCK].astype(float), t[at:at + _BLOCK]
            slope = -wanted / (1 + np.exp(np.clip(wanted * (own @ w + b), -30, 30))) * share[at:at + _BLOCK, None]
            g, gb = g + own.T @ slope, gb + slope.sum(0)
        grow += g * g
        grow_b += gb * gb
        w -= _RATE * g / np.sqrt(grow)
        b -= _RATE * gb / np.sqrt(grow_b)
    margin = np.clip(x[held] @ w + b, -8, 8) * target[held] if held.any() else np.ones((1, codes.shape[1]))
    error = ((margin <= 0).mean(0)).clip(0.01, 0.49)
    return Model(languages, codes, w, b, np.log((1 - error) / error))


def training_rows(docs: DataFrame, learn: Column, per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) rows to fit on, of every language, the smallest by hash; see the module for how many.

    One pass counts rows of each language; a second one reads texts, of rows below a hash limit that lets about twice the wanted number through.
    What goes to the tasks is one row per language.
    """
    short = F.char_length(text_of()) <= FIT_CHARS
    fine = docs.where(learn & F.col("lang").isNotNull())
    counts = fine.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("n_short")).collect()
    if not counts:
        return []
    most = max(LEAST_ROWS, min(per_language, TOTAL_ROWS // len(counts)))
    wanted = {r["lang"]: most if r["n_short"] else LEAST_ROWS for r in counts}
    draws = [(r["lang"], min(1.0, (2.0 * wanted[r["lang"]] + 20) / (r["n_short"] or r["n"])), not r["n_short"]) for r in counts]
    limits = docs.sparkSession.createDataFrame(draws, "lang string, cap double, any_length boolean")
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 33) / float(2 ** 31)
    drawn = fine.select("text", "lang", place.alias("place"), short.alias("short")).join(F.broadcast(limits), "lang").where("place < cap AND (short OR any_length)")
    out, taken = [], dict.fromkeys(wanted, 0)
    at_most = 2 * sum(2 * k + 20 for k in wanted.values())  # twice what is expected
    for r in drawn.orderBy("place", "lang", F.md5(text_of().cast("binary"))).select("text", "lang").limit(at_most).toLocalIterator():
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= wanted[r["lang"]]:
            out.append((r["text"], r["lang"]))
    return out


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        lang, score = [UNKNOWN] * n, np.zeros(n)
        texts = batch.column(batch.schema.get_field_index("text"))
        for at in range(0, n if model else 0, 256):
            made = [(i, f) for i, t in enumerate(texts[at:at + 256].to_pylist(), at) if (f := features(t)) is not None]
            if made:
                best, value = model.decode(np.stack([f for _, f in made]))
                for (i, _), b, v in zip(made, best, value):
                    lang[i], score[i] = model.languages[b], v
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], [*kept.schema.names, "lang_pred", "score", "ambiguous"])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without text, plus lang_pred, score (0 to 1) and ambiguous."""
    out = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    df = docs.select(*out)
    rest = [(n, t) for n, t in df.dtypes if n != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*rest, ("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(lambda it: _predict(it, shared.value), schema)
