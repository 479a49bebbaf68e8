"""PII: rules for four kinds of personal data, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Kinds: email, ip, card, phone. The rules (BASE) are leftmost and non-overlapping per kind, in linear time. The network is trained
in numpy on labelled spans: what the rules find in at most FIT_ROWS documents that hold a digit or an @, and
written variants of it (no plus sign, dots for blanks, blanks around the @), with look-alikes such as dates and keys as counter-examples. Whole texts are covered by overlapping
windows. Windows only give emissions: each position takes the mean of all windows over it, weighted by its distance from their ends, and one CRF
decoding runs over the whole text, so no seam can break a span.
Every span must hold a digit or an @, so text farther than a window from either counts as outside and is not run; the rest are stretches,
each decoded between two positions that are outside.
Added spans must pass the kind's own test (or else the sure test of an email, ip or card, whose kind they then take), touch no letter or digit and overlap no span of the rules; the rules' spans always stay.

Nulls and odd rows: a null text is empty and has no spans; repeated rows are read one by one; offsets are code points of the whole text;
other columns are kept (the result's own names replace equal ones); a corpus without any labelled span trains on the written examples alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hashed_sample

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS, FIT_CHARS = 400, 20_000
WINDOW, STEP = 96, 48
_SURE = ("email", "ip", "card")  # kinds whose test tells them from the others
_TOGETHER = 1 << 18  # positions scored and decoded at once
_HIDDEN, _ROUNDS, _BATCH, _LENGTH, _RATE = 24, 240, 48, 64, 0.02
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that does not begin with its digits' first one would begin earlier, so only first digits are tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """What the rules find, by start and then kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    if _HINT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m.group().split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the network: tags are O, then B and I of each kind -------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)
_SYMBOLS = 99
_BANNED = -1e4


def symbols(text: str) -> np.ndarray:
    """Characters as numbers: printable ASCII each, then blanks, digits, letters and all others beyond it."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((c >= 32) & (c < 127), c - 32, 97).astype(np.uint8)
    high = np.flatnonzero(c >= 127)
    kinds, which = np.unique(c[high], return_inverse=True)
    out[high] = np.array([96 if chr(k).isalpha() else 98 if chr(k).isdigit() else 97 for k in kinds], np.uint8)[which]
    out[(c < 32) | (c == 127)] = 95
    return out


def _allowed() -> np.ndarray:
    """Scores of forbidden steps: an inside tag follows only its own kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = _BANNED
        out[[inside - 1, inside], inside] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Gate inputs per symbol (the embedding) and recurrent weights of both directions, output weights, CRF transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 3) -> "Network":
        rng, h = np.random.default_rng(seed), _HIDDEN
        p = {}
        for d in "lr":
            p[f"e{d}"] = rng.normal(0, 0.3, (_SYMBOLS, 4 * h))
            p[f"e{d}"][:, h:2 * h] += 1.0  # remember at first
            p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        p["w"], p["b"] = rng.normal(0, 0.2, (2 * h, TAGS)), np.zeros(TAGS)
        p["b"][0] = 1.0
        p["t"], p["s"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        h, (n, length) = _HIDDEN, x.shape
        order = range(length) if d == "l" else range(length - 1, -1, -1)
        e, u = self.p[f"e{d}"], self.p[f"u{d}"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, seen = np.empty((n, length, h), np.float32), []
        for t in order:
            z = e[x[:, t]] + state @ u
            gates, g = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            before, old = state, cell
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[:, t] = state
            if keep:
                seen.append((t, i, f, o, g, tc, before, old))
        return out, seen

    def scores(self, x: np.ndarray) -> np.ndarray:
        left, right = self._run(x, "l", False)[0], self._run(x, "r", False)[0]
        return np.concatenate([left, right], 2) @ self.p["w"] + self.p["b"]

    def decode(self, a: np.ndarray) -> np.ndarray:
        """Best tags for each row of emissions (rows, length, tags), every row standing between two positions that are outside."""
        steps = (self.p["t"] + _allowed()).astype(np.float32)
        n, length, _ = a.shape
        best = a[:, 0] + steps[0]
        back = np.empty((n, length, TAGS), np.int8)
        for t in range(1, length):
            path = best[:, :, None] + steps
            back[:, t] = path.argmax(1)
            best = path.max(1) + a[:, t]
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = (best + steps[:, 0]).argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y and its gradients."""
        n, length = x.shape
        h = _HIDDEN
        runs = {d: self._run(x, d, True) for d in "lr"}
        both = np.concatenate([runs["l"][0], runs["r"][0]], 2)
        a = (both @ self.p["w"] + self.p["b"]).astype(np.float64)
        steps, first = self.p["t"] + _allowed(), self.p["s"] + _allowed()[0]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        fwd, bwd = np.empty_like(a), np.zeros_like(a)
        fwd[:, 0] = a[:, 0] + first
        for t in range(1, length):
            fwd[:, t] = lse(fwd[:, t - 1, :, None] + steps, 1) + a[:, t]
        for t in range(length - 2, -1, -1):
            bwd[:, t] = lse(steps + (a[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        z = lse(fwd[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = a[rows, np.arange(length), y].sum(1) + first[y[:, 0]] + steps[y[:, :-1], y[:, 1:]].sum(1)
        da = np.exp(fwd + bwd - z[:, None, None])
        ds = da[:, 0].sum(0)
        pair = np.exp(fwd[:, :-1, :, None] + steps + (a[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        dt = pair.sum((0, 1))
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
        np.add.at(ds, y[:, 0], -1)
        da[rows, np.arange(length), y] -= 1
        da = (da / n).astype(np.float32)
        g = {"w": both.reshape(-1, 2 * h).T @ da.reshape(-1, TAGS), "b": da.sum((0, 1)), "t": (dt / n).astype(np.float32), "s": (ds / n).astype(np.float32)}
        dboth = da @ self.p["w"].T
        for d, part in (("l", dboth[:, :, :h]), ("r", dboth[:, :, h:])):
            u, du = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            dz_all = np.empty((n, length, 4 * h), np.float32)
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, i, f, o, gg, tc, before, old in reversed(runs[d][1]):
                dh = dh + part[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                du += before.T @ dz
                dz_all[:, t] = dz
                dh, dc = dz @ u.T, dc * f
            one = np.zeros((n * length, _SYMBOLS), np.float32)
            one[np.arange(n * length), x.ravel()] = 1
            g[f"e{d}"], g[f"u{d}"] = one.T @ dz_all.reshape(n * length, -1), du
        return float((z - gold).mean()), g


# --- training ---------------------------------------------------------------------------------------------------------

def _variant(kind: str, value: str, rng: np.random.Generator) -> str:
    """Another way to write a value."""
    if kind == "email":
        return value.replace("@", (" @ ", "@", "@", " @")[rng.integers(4)])
    if kind == "ip":
        return value
    if kind == "card":
        d = _digits(value)
        return (d, " ".join(d[k:k + 4] for k in range(0, len(d), 4)), "-".join(d[k:k + 4] for k in range(0, len(d), 4)),
                ".".join(d[k:k + 4] for k in range(0, len(d), 4)))[rng.integers(4)]
    d = _digits(value)[-10:]
    return (value, f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"+1 {d[:3]} {d[3:6]} {d[6:]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}")[rng.integers(6)]


def _invented(kind: str, rng: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))
    if kind == "email":
        return f"{word(rng.integers(2, 9))}{('.', '_', '')[rng.integers(3)]}{digits(rng.integers(0, 3))}@{word(rng.integers(3, 9))}.{('com', 'org', 'example.com', 'de')[rng.integers(4)]}"
    if kind == "ip":
        return ".".join(str(rng.integers(1, 255)) for _ in range(4))
    if kind == "card":
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))
    return f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"


def _alike(rng: np.random.Generator) -> str:
    """Text that looks like personal data and is none."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    return (f"20{digits(2)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}", f"{rng.integers(1, 23)}:{rng.integers(10, 59)}", f"${digits(2)}.{digits(2)}", f"v{rng.integers(9)}.{rng.integers(9)}.{rng.integers(9)}",
            digits(rng.integers(1, 9)), "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 32)), f"AKIA{digits(3)}QX{digits(4)}ZK", f"{digits(5)}-{digits(4)}", f"§ {digits(2)}.{digits(1)}",
            f"@{'abcdefgh'[:rng.integers(2, 8)]}", f"{digits(3)},{digits(3)}.{digits(2)}", f"20{digits(2)}-20{digits(2)}")[rng.integers(12)]


def _examples(texts: list[str], count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags, drawn around spans, variants, invented ones and look-alikes in the given texts."""
    rng = np.random.default_rng(seed)
    spans = [(t, s) for t in texts for s in base_spans(t)]
    plain = [t for t in texts if len(t) > 10] or ["the quick brown fox jumps over it and then, at last, rests a while. " * 3]
    xs, ys = [], []
    for k in range(count):
        marks: list[Span] = []
        if spans and k % 4 == 0:  # as it stands
            text, (_, a, b) = spans[rng.integers(len(spans))]
            start = max(0, int(a) - int(rng.integers(0, _LENGTH - 8)))
            text = text[start:start + _LENGTH]
            marks = base_spans(text)
        else:
            source = plain[rng.integers(len(plain))]
            at = int(rng.integers(0, len(source)))
            text = _HINT.sub("a", source[at:at + _LENGTH]).replace("+", "a")
            cut = int(rng.integers(0, len(text) + 1))
            left, right = text[:cut].rstrip() + " ", " " + text[cut:].lstrip()
            if k % 4 < 3:
                kind = KINDS[rng.integers(4)]
                same = [t[a:b] for t, (c, a, b) in spans if c == kind] if k % 8 < 4 else []
                value = _variant(kind, same[rng.integers(len(same))] if same else _invented(kind, rng), rng)
                left = left[-(_LENGTH - 1 - min(len(value), _LENGTH // 2)):]
                marks = [(kind, len(left), len(left) + len(value))]
            else:
                value = _alike(rng)
                left = left[-(_LENGTH - 30):]
            text = left + value + (("." if rng.integers(4) == 0 else "") + right)
        text = text[:_LENGTH].ljust(_LENGTH)
        y = np.zeros(_LENGTH, np.int64)
        for kind, a, b in marks:
            j = 1 + 2 * KINDS.index(kind)
            y[a:b] = j + 1
            y[a:a + 1] = j
        xs.append(symbols(text))
        ys.append(y)
    return np.stack(xs), np.stack(ys)


def train(texts: list[str], rounds: int = _ROUNDS) -> Network:
    """Network fitted (Adam) to windows made from the given texts."""
    net = Network.fresh()
    x, y = _examples(texts, _BATCH * 60)
    rng = np.random.default_rng(1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    for r in range(1, rounds + 1):
        rows = rng.integers(0, len(x), _BATCH)
        _, g = net.gradients(x[rows], y[rows])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = _RATE * min(1.0, 2 * (1 - r / (rounds + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            m[k] += 0.1 * (v - m[k])
            s[k] += 0.01 * (v * v - s[k])
            net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9 ** r)) / (np.sqrt(s[k] / (1 - 0.99 ** r)) + 1e-6)).astype(np.float32)
    return net


def training_texts(docs: DataFrame, rows: int = FIT_ROWS) -> list[str]:
    """At most `rows` texts that hold a digit or an @, the smallest by hash."""
    held = docs.where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= FIT_CHARS)).select("doc_id", "text")
    return [r["text"] for r in hashed_sample(held, rows, "doc_id", "text").collect()]


# --- finding --------------------------------------------------------------------------------------------------------

def _plausible(kind: str, value: str) -> bool:
    digits = _digits(value)
    if kind == "email":
        local, _, domain = value.partition("@")
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?", local) and re.fullmatch(r" ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain))
    if re.search(r"[^0-9 ().+\-]", value):
        return False
    if kind == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.search(r"[0-9][ ().\-]+[0-9]", value)) and value.count(".") != 3


@dataclass
class _Stretch:
    """A run of overlapping windows: its text's number, its place there, and where its windows begin."""

    text: int
    start: int
    codes: np.ndarray
    windows: np.ndarray


def _stretches(k: int, text: str) -> list[_Stretch]:
    hints = np.array([m.start() for m in _HINT.finditer(text)], np.int64)
    if not len(hints):
        return []
    # windows begin at multiples of STEP (from -STEP/2); a hint keeps those within a window of it
    at = np.unique((hints // STEP)[:, None] - np.arange(-1, WINDOW // STEP + 2)[None]) * STEP - STEP // 2
    at = at[(at < len(text)) & (at + WINDOW > 0)]
    codes, out = symbols(text), []
    for run in np.split(at, np.flatnonzero(np.diff(at) > STEP) + 1):
        start = max(0, int(run[0]))
        out.append(_Stretch(k, start, codes[start:int(run[-1]) + WINDOW], run - start))
    return out


def _emissions(group: list[_Stretch], net: Network) -> list[np.ndarray]:
    """Per stretch and position: the mean of the windows over it, weighted by the distance from their ends."""
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    total = [np.zeros((len(g.codes), TAGS), np.float32) for g in group]
    mass = [np.zeros((len(g.codes), 1), np.float32) for g in group]
    todo = [(g, int(at)) for g, stretch in enumerate(group) for at in stretch.windows]
    for b in range(0, len(todo), 256):
        block = todo[b:b + 256]
        x = np.full((len(block), WINDOW), 95, np.int64)
        for row, (g, at) in enumerate(block):
            part = group[g].codes[max(0, at):at + WINDOW]
            x[row, max(0, -at):max(0, -at) + len(part)] = part
        scores = net.scores(x) * weight
        for row, (g, at) in enumerate(block):
            a, e = max(0, at), min(len(group[g].codes), at + WINDOW)
            total[g][a:e] += scores[row, a - at:e - at]
            mass[g][a:e] += weight[a - at:e - at]
    return [t / m for t, m in zip(total, mass)]


def _tagged(group: list[_Stretch], net: Network) -> list[np.ndarray]:
    """Tags of every stretch; stretches of about one length are decoded together, shorter ones filled with outside positions."""
    found, out = _emissions(group, net), [np.empty(0, np.int8)] * len(group)
    order = sorted(range(len(group)), key=lambda g: len(found[g]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(found[order[end]]) * (end + 1 - at) <= _TOGETHER and len(found[order[end]]) <= 2 * len(found[order[at]]):
            end += 1
        rows = order[at:end]
        a = np.full((len(rows), len(found[rows[-1]]), TAGS), _BANNED, np.float32)
        a[:, :, 0] = 0
        for row, g in enumerate(rows):
            a[row, :len(found[g])] = found[g]
        for row, g in zip(net.decode(a), rows):
            out[g] = row[:len(found[g])]
        at = end
    return out


def find_spans(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """Per text: the rules' spans, and those the network adds."""
    base = [base_spans(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]

    def add(group: list[_Stretch]) -> None:
        for stretch, tags in zip(group, _tagged(group, net)):
            end = stretch.start + len(tags)
            more[stretch.text] += _added(texts[stretch.text], stretch.start, tags, [s for s in base[stretch.text] if s[1] < end and s[2] > stretch.start])

    group: list[_Stretch] = []
    size = 0
    for k, text in enumerate(texts):
        for stretch in _stretches(k, text):
            group.append(stretch)
            size += len(stretch.codes)
            if size >= _TOGETHER:  # what is held at once is bounded by this and the longest text
                add(group)
                group, size = [], 0
    add(group)
    return list(zip(base, more))


def _added(text: str, start: int, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of the tags of text[start:] that pass the tests of their kind; `base` holds the rules' spans there."""
    kinds = (tags + 1) // 2
    begin = (tags % 2 == 1) | (np.concatenate([[0], kinds[:-1]]) != kinds)
    taken = np.zeros(len(tags), bool)
    for _, a, b in base:
        taken[max(0, a - start):b - start] = True
    out = []
    for at in np.flatnonzero(begin & (kinds > 0)).tolist():
        end = at + 1
        while end < len(tags) and kinds[end] == kinds[at] and not begin[end]:
            end += 1
        kind, a, b = KINDS[kinds[at] - 1], start + at, start + end
        while a < b and not (text[a].isalnum() or text[a] in "(+"):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        whole = not (a and (text[a - 1].isalnum() or text[a - 1] in "@+$#")) and not (b < len(text) and text[b].isalnum())
        if not (a < b and whole) or taken[a - start:b - start].any():
            continue
        # where the value fails its own kind's test but is surely another (phones have no sure test), it is that
        kind = next((k for k in (kind, *_SURE) if _plausible(k, text[a:b])), None)
        if kind:
            taken[a - start:b - start] = True
            out.append((kind, a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redacted(text: str, spans: list[Span]) -> str:
    """Text with every stretch of overlapping spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _blocks(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _find(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch):
            found = find_spans(_texts(block), net)
            out = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            out += [pa.array([joined(base) for base, _ in found], pa.string()), pa.array([joined(base + more) for base, more in found], pa.string())]
            kept = block.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *out], [*kept.schema.names, *(f"n_{k}" for k in KINDS), "base_spans", "spans"])


def find_private(docs: DataFrame, net: Network) -> DataFrame:
    """docs without text, plus n_email, n_ip, n_card, n_phone (of the rules), base_spans and spans (kind:start:end, comma-joined)."""
    made = [*(f"n_{k}" for k in KINDS), "base_spans", "spans"]
    df = docs.select(*[c for c in docs.columns if c not in made])
    rest = [f"`{n}` {t}" for n, t in df.dtypes if n != "text"]
    schema = ", ".join([*rest, *(f"n_{k} bigint" for k in KINDS), "base_spans string", "spans string"])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return df.mapInArrow(lambda it: _find(it, shared.value), schema)


def _redact(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch):
            texts = _texts(block)
            clean = pa.array([redacted(t, base + more) for t, (base, more) in zip(texts, find_spans(texts, net))], pa.string())
            at = block.schema.get_field_index("text")
            yield block.set_column(at, block.schema.field(at), clean)


def redact(docs: DataFrame, net: Network) -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; null texts stay null; n_chars follows where docs has it."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    clean = docs.where("text IS NOT NULL").mapInArrow(lambda it: _redact(it, shared.value), docs.schema).unionByName(docs.where("text IS NULL"))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars"))) if "n_chars" in docs.columns else clean
