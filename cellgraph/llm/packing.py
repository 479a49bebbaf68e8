"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are turned into token ids, cut only where longer than a sequence, and the pieces packed into as few sequences as
possible. Packing depends on lengths alone, and there are at most `capacity` of them, so the instance is the
count of pieces of each length, whatever the corpus. On it, sets of up to three lengths that provably dominate every
alternative are fixed first (as many times as they occur), and what is left is packed best-fit, longest first. The
resulting runs (a length, a rank range, its sequences and offsets) are of bounded number too; every piece finds its
place from its rank among the pieces of its length. Ranks come from one window per (length, part): a length that
many pieces share is spread over parts.

Nulls and odd rows: null and empty texts are the end id alone; repeated rows and null doc_ids are packed like any other;
other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage

CAPACITY, END_ID = 4096, 1
#: Pieces of one part of a length's ranking.
PART_ROWS = 50_000
#: Words remembered by a worker, twice over (recent and older ones).
_MEMO = 250_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes; equal to the tokenizer's own, words being remembered.

    The tokenizer lower-cases, splits at blanks and then by PIECE, and never joins across them. Texts for which
    that needs more than Python's lower() and split() (letters beyond U+024F, control strings, odd separators) go to it whole.
    """

    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    ODD = r"[İɐ-\U0010FFFF\x1C-\x1F]|<\|"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self._odd = regex.compile(self.PIECE).findall, re.compile(self.ODD).search
        # a point or comma between a letter or digit and a blank is a piece of its own: set apart, words recur more often
        self.mark = re.compile(r"[.,](?=\s|\Z)(?<=[^\W_].)").sub
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def odd(self, text: str) -> bool:
        if text.isascii():
            return "<|" in text or any(c in text for c in "\x1C\x1D\x1E\x1F")
        return self._odd(text) is not None

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > _MEMO:  # words still in use come back from the older half
            self.words, self.older = {}, self.words
        pieces: set[str] = set()
        split: dict[str, list[str]] = {}
        for w in words.difference(self.words):
            known = self.older.get(w)
            if known is not None:
                self.words[w] = known
            elif w.isalpha():
                pieces.add(w)
            else:
                split[w] = self.split(w)
        new = list(pieces.union(*split.values()).difference(self.words))
        blocks = [new[k:k + 500] for k in range(0, len(new), 500)]
        for block, found in zip(blocks, self.tokenizer.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(block):
                raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                self.words.update((p, raw[a:b]) for p, a, b in zip(block, at, at[1:]))
            else:
                self.words.update((p, self._whole(p)) for p in block)
        get = self.words.__getitem__
        for w, ps in split.items():
            if len(ps) != 1:
                self.words[w] = b"".join(map(get, ps))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), 64):
            plain = [None if self.odd(t) else self.mark(r" \g<0>", t.lower()).split() for t in texts[k:k + 64]]
            self._learn(set().union(*(w for w in plain if w)))
            get = self.words.__getitem__
            for text, w in zip(texts[k:k + 64], plain):
                yield self._whole(text) if w is None else b"".join(map(get, w))


_encoders: dict[str, Encoder] = {}


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for row, raw in enumerate(_encoders[path].encode(texts)):
            raw += end
            for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                ids = raw[at:at + 4 * capacity]
                rows.append((row, piece, at // 4, len(ids) // 4, zlib.crc32(ids), ids if keep_ids else None))
        columns = list(zip(*rows)) or [[]] * 6
        out = [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:5])]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            out, names = [*out, pa.array(columns[5], pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(out, names)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document; ids as little-endian uint32 bytes."""
    path = tokenizer or default_tokenizer()
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, path, capacity, end_id, keep_ids), schema)


class Pattern(NamedTuple):
    """`bins` sequences that each hold the same pieces: (length, how many), in order."""

    bins: int
    items: list[tuple[int, int]]


def dominant_patterns(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Fixes dominating sets and takes them out of count.

    For a piece of length L with room R = capacity - L beside it, longest first: nothing fits beside it; a piece of length R fills the room
    (any other content fits in that piece's place); only one piece fits, then the longest that fits; at most two fit, and the
    longest one with the longest that fits beside it cover every other choice. Repeated until nothing more is fixed.
    """
    fixed: list[Pattern] = []

    def fix(bins: int, *lengths: int) -> None:
        for length in lengths:
            count[length] -= bins
            if not count[length]:
                del count[length]
        fixed.append(Pattern(bins, [(x, 1) for x in lengths]))

    changed = True
    while changed:
        changed, before = False, len(fixed)
        for length in sorted(count, reverse=True):
            while count.get(length):
                room, n = capacity - length, count[length]
                if room and room != length and count.get(room):
                    fix(min(n, count[room]), length, room)
                    continue
                if room == length and n > 1:
                    fix(n // 2, length, length)
                    continue
                others = sorted(x for x in count if x <= room and (x != length or n > 1))
                if not others:
                    fix(n, length)
                    continue
                least = [x for x in others[:3] for _ in range(min(3, count[x] - (x == length)))][:3]
                top = others[-1]
                free = lambda x: count[x] - (x == length)
                if len(least) == 1 or least[0] + least[1] > room:
                    if top == length:
                        fix(n // 2, length, length)
                    else:
                        fix(min(n, count[top]), length, top)
                    continue
                if (len(least) == 2 or sum(least) > room) and top != length:
                    beside = [x for x in others[:bisect_right(others, room - top)] if free(x) > (x == top)]
                    second = beside[-1] if beside else 0
                    if second and second != top and second != length and not any(
                            (k := bisect_left(others, max(y, top - y + 1))) < len(others) and others[k] <= room - y and (others[k] != y or free(y) > 1)
                            for y in others if second < y <= room - y):
                        fix(min(n, count[top], count[second]), length, top, second)
                        continue
                break
        changed = len(fixed) > before
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing; equal pieces and equally filled sequences are handled together."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    full: list[Pattern] = []

    def put(bins: int, items: list[tuple[int, int]], room: int) -> None:
        if bins and not room:
            full.append(Pattern(bins, items))
        elif bins:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append(Pattern(bins, items))

    for length in sorted(count, reverse=True):
        n = count[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                bins, items, room = n, [], capacity  # as many empty sequences as may be needed
                each = room // length
                bins = -(-n // each)
            else:
                room = rooms[at]
                bins, items = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                each = room // length
            whole, part = min(bins, n // each), 0
            if whole < bins:
                part = n - whole * each
            put(whole, [*items, (length, each)], room - each * length)
            if part:
                put(1, [*items, (length, part)], room - part * length)
            put(bins - whole - bool(part), items, room)
            n -= whole * each + part
    return full + [p for group in open_.values() for p in group if p.items]


def plan_runs(count: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length its runs as rows (first rank, pieces per sequence, first sequence, offset), by first rank."""
    left = {k: v for k, v in count.items() if v}
    patterns = dominant_patterns(left, capacity) + best_fit(left, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for bins, items in patterns:
        offset = 0
        for length, each in items:
            rank = ranks.get(length, 0)
            runs.setdefault(length, []).append((rank, each, sequence, offset))
            ranks[length] = rank + bins * each
            offset += each * length
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def _place(batches: Iterator[pa.RecordBatch], runs: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for value in np.unique(length):
            at, table = np.flatnonzero(length == value), runs[int(value)]
            first, each, bin_, off = table[np.searchsorted(table[:, 0], rank[at], "right") - 1].T
            sequence[at] = bin_ + (rank[at] - first) // each
            offset[at] = off + (rank[at] - first) % each * value
        kept = batch.drop_columns(["_rank"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...; length 1 to capacity) plus sequence_id and offset.

    pieces is read three times: pass a written table.
    """
    spark = pieces.sparkSession
    count = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan_runs(count, capacity)
    parts = max(1, sum(count.values()) // PART_ROWS)
    split = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = split.groupBy("length", "_part").count().select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    order = W.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = split.join(base, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.row_number().over(order) - 1)
    ready = ranked.select(*pieces.columns, "_rank")
    schema = ", ".join(f"`{n}` {t}" for n, t in [*pieces.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])
    shared = spark.sparkContext.broadcast(runs)  # bounded: lengths of at most `capacity` kinds
    return ready.mapInArrow(lambda it: _place(it, shared.value), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each is placed at."""
    return pack(cut_lineage(token_pieces(docs, tokenizer, capacity, end_id, keep_ids)), capacity)
