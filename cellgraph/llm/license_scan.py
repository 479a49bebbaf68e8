"""License scans: one Aho-Corasick pass for identifier tags and notice phrases, a shunting-yard parser for expressions.

A text becomes its words (A-Z lower-cased, words as runs of letters, digits and anything beyond ASCII) with one blank between them; the automaton
holds the base phrases, the notice phrases and the tags, each with a blank around it, so one pass finds all places where their words
stand consecutively, overlaps included. What follows an identifier tag in the text itself, up to the end of its line, is
read as a licence expression (and / or / with, parentheses, tightest first: with, and, or) and evaluated: both sides of `and`
bind, `or` leaves the choice of the freer side, `with` adds an exception that frees a little.

The score is how far the found terms restrict reuse: 0.0 where nothing was found or for a dedication to the public, 1.0 for all rights
reserved; of several statements the strictest counts, each statement being a notice phrase or a whole expression.

Every text is read whole, in tasks, without a shuffle; a task holds one automaton, whose size is that of the phrases.

Nulls and odd rows: a null or empty text has no words, no labels ('') and score 0.0; a null id stays null; repeated rows are scanned one
by one; ties cannot occur; other columns are ignored, whatever their names; a malformed expression adds the licences named before the
fault and scores as if they were joined by `and`; unknown names count as `other`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases every scan looks for, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method: words, label, how far reuse is restricted (0 to 1).
NOTICES = [
    ("mit license", "mit", 0.1),
    ("isc license", "isc", 0.1),
    ("apache license", "apache", 0.15),
    ("apache license version 2 0", "apache-2.0", 0.15),
    ("bsd license", "bsd", 0.1),
    ("2 clause bsd", "bsd-2-clause", 0.1),
    ("bsd 2 clause", "bsd-2-clause", 0.1),
    ("3 clause bsd", "bsd-3-clause", 0.1),
    ("bsd 3 clause", "bsd-3-clause", 0.1),
    ("mozilla public license", "mpl", 0.35),
    ("eclipse public license", "epl", 0.35),
    ("general public license version 2", "gpl-2.0", 0.6),
    ("general public license version 3", "gpl-3.0", 0.6),
    ("lesser general public license", "lgpl", 0.4),
    ("affero general public license", "agpl", 0.7),
    ("creative commons attribution", "cc-by", 0.2),
    ("creative commons zero", "cc0", 0.0),
    ("cc0", "cc0", 0.0),
    ("cc by sa", "cc-by-sa", 0.4),
    ("cc by nd", "cc-by-nd", 0.7),
    ("cc by nc", "cc-by-nc", 0.8),
    ("cc by nc sa", "cc-by-nc-sa", 0.8),
    ("cc by nc nd", "cc-by-nc-nd", 0.9),
    ("attribution sharealike", "cc-by-sa", 0.4),
    ("attribution noderivatives", "cc-by-nd", 0.7),
    ("attribution noncommercial", "cc-by-nc", 0.8),
    ("dedicated to the public domain", "public-domain", 0.0),
    ("released into the public domain", "public-domain", 0.0),
    ("unlicense", "unlicense", 0.0),
    ("open database license", "odbl", 0.4),
]
BASE_TERMS = {"cc-by": 0.2, "gpl": 0.6, "reserved": 1.0}
#: Tags whose line holds an expression: their words, and their characters in the text.
TAGS = {"spdx license identifier": "spdx-license-identifier:", "license expression": "license-expression:"}
#: Restriction of the licences that expressions name; versions after these names are allowed.
IDENTIFIERS = {
    "0bsd": 0.0, "afl": 0.15, "agpl": 0.7, "apache": 0.15, "artistic": 0.2, "bsd-2-clause": 0.1, "bsd-3-clause": 0.1, "bsd": 0.1, "bsl": 0.1, "cc-by": 0.2,
    "cc-by-nc": 0.8, "cc-by-nc-nd": 0.9, "cc-by-nc-sa": 0.8, "cc-by-nd": 0.7, "cc-by-sa": 0.4, "cc0": 0.0, "cddl": 0.35, "epl": 0.35, "eupl": 0.5,
    "gfdl": 0.5, "gpl": 0.6, "isc": 0.1, "lgpl": 0.4, "mit": 0.1, "mpl": 0.35, "odbl": 0.4, "ofl": 0.2, "unlicense": 0.0, "wtfpl": 0.0, "zlib": 0.1,
}
OTHER, EXCEPTION = 0.5, 0.75
_RANK = {"or": 1, "and": 2, "with": 3}
_VERSION = re.compile(r"-?v?[0-9]+(?:\.[0-9]+)*(?:-only|-or-later)?\+?\Z")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
_ASCII = {k: k + 32 for k in range(65, 91)}
# bytes beyond ASCII stay, whatever their character; capitals become small, other ASCII that is no letter or digit a blank
_WORDS = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in evaluation order, None when the expression is malformed."""
    out, held, operand = [], [], True  # operand: one is expected next
    for t in tokens:
        if t == "(" and operand:
            held.append(t)
        elif t == ")" and not operand:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in _RANK and not operand:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        elif operand and t not in "()" and t not in _RANK:
            out.append(t)
            operand = False
        else:
            return None
    if operand or "(" in held:
        return None
    return out + held[::-1]


def restriction(name: str) -> float:
    known = IDENTIFIERS.get(name)
    return IDENTIFIERS.get(_VERSION.sub("", name), OTHER) if known is None else known


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """Licences that an expression names, and its restriction; None where there is no licence at all.

    Words after the expression's end (`MIT. See the file ...`) are not part of it: reading stops where neither an operator nor a
    parenthesis follows an operand.
    """
    tokens, before = [], None
    for m in _TOKEN.finditer(expression.translate(_ASCII)):
        t = m.group(0).rstrip(".:") or m.group(0)
        if before not in (None, "(", *_RANK) and t not in (")", *_RANK):
            break
        tokens.append(t)
        before = t
    order = postfix(tokens)
    names = [t for k, t in enumerate(tokens) if t not in ("(", ")", *_RANK) and (k == 0 or tokens[k - 1] != "with")]
    if not names:
        return None
    if order is None:
        return names, max(map(restriction, names))
    stack: list[float] = []
    for t in order:
        if t == "with":
            stack.pop()
            stack[-1] *= EXCEPTION
        elif t in _RANK:
            right = stack.pop()
            stack[-1] = (max if t == "and" else min)(stack[-1], right)
        else:
            stack.append(restriction(t))
    return names, stack[0]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Phrases with blanks around them -> (number of words, base label, method label, restriction, tag)."""
    held: dict[str, list] = {}
    for phrase, label in BASE.items():
        held[phrase] = [label, None, BASE_TERMS[label], None]
    for phrase, label, strict in NOTICES:
        held.setdefault(phrase, [None, None, 0.0, None])[1:3] = [label, strict]
    for phrase, tag in TAGS.items():
        held.setdefault(phrase, [None, None, 0.0, None])[3] = tag
    made = ahocorasick.Automaton()
    for phrase, what in held.items():
        made.add_word(f" {phrase} ", (len(phrase), phrase.count(" ") + 1, *what))
    made.make_automaton()
    return made


def scan(text: str | None) -> dict:
    """What one text holds: n_words, base (label, first word), found (label, first word, words), expressions (text, licences, restriction), score."""
    found = words_of(text or "")
    line = f" {b' '.join(found).decode('utf-8', 'surrogatepass')} "
    base, notices, expressions, score, tags = [], [], [], 0.0, set()
    at, word = 0, 0
    for end, (length, n, base_label, label, strict, tag) in _automaton().iter(line):
        start = end - length  # of the phrase's first character; ends rise, starts may fall back within the longest phrase
        if start - 1 >= at:
            word += line.count(" ", at, start - 1)
            at = start - 1
            first = word
        else:
            first = word - line.count(" ", start - 1, at)
        if base_label:
            base.append((base_label, first))
        if label:
            notices.append((label, first, n))
        if base_label or label:
            score = max(score, strict)
        if tag:
            tags.add(tag)
    if tags:
        plain = text.translate(_ASCII)
        for tag in sorted(tags):
            place = plain.find(tag)
            while place >= 0:
                begin = place + len(tag)
                stop = plain.find("\n", begin)
                told = plain[begin:len(plain) if stop < 0 else stop].strip()
                if not plain[max(place - 1, 0):place].isalnum() and (got := evaluate(told)):
                    expressions.append((place, told, *got))
                    score = max(score, got[1])
                place = plain.find(tag, begin)
    expressions.sort()
    return {"n_words": len(found), "base": base, "found": notices, "expressions": expressions, "score": score}


SPANS = "array<struct<label:string,first_word:bigint,n_words:int>>"
EXPRESSIONS = "array<struct<start:bigint,expression:string,licenses:array<string>,restriction:double>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int32())]))
    told = pa.list_(pa.struct([("start", pa.int64()), ("expression", pa.string()), ("licenses", pa.list_(pa.string())), ("restriction", pa.float64())]))
    size = {label: phrase.count(" ") + 1 for phrase, label in BASE.items()}
    for batch in batches:
        got = [scan(t.as_py()) for t in batch.column(1)]
        base = [[{"label": b, "first_word": f, "n_words": size[b]} for b, f in g["base"]] for g in got]
        more = [[{"label": b, "first_word": f, "n_words": n} for b, f, n in g["found"]] for g in got]
        exps = [[dict(zip(("start", "expression", "licenses", "restriction"), e)) for e in g["expressions"]] for g in got]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([g["n_words"] for g in got], pa.int64()), pa.array(base, span), pa.array(more, span), pa.array(exps, told),
             pa.array([float(g["score"]) for g in got], pa.float64())], ["doc_id", "n_words", "base_spans", "notice_spans", "expressions", "score"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base_spans, notice_spans, expressions, score) of docs (doc_id, text), one row per row.

    Spans count words from 0; an expression's start is the code point at which its tag stands, and its text is lower-cased.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, base_spans {SPANS}, notice_spans {SPANS}, expressions {EXPRESSIONS}, score double"
    return docs.select("doc_id", "text").mapInArrow(_rows, schema)
