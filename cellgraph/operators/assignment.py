"""Small per-group helper: cheapest one-to-one assignment between two point sets, with a fixed rule for ties.

Shortest augmenting paths with dual prices (Jonker and Volgenant 1987, Crouse 2016). Distances
are computed row by row from the coordinates, so memory stays linear in the points.

Several assignments may share the least total. All of them use only pairs whose cost equals the sum
of the two prices, whatever prices were found; among these pairs the one assignment is
taken in which the first row has the lowest column it can have, then the second row, and so on. So the
answer depends on the points alone, not on how they were cut into pieces or in which order they were solved.
"""

from __future__ import annotations

from collections import deque

import numpy as np

HELD_CELLS = 4_000_000  # up to this many distances are kept (32 MB); beyond, rows are computed when needed
PENALTY = 1e6  # of a row that finds no column within the gate
SAME = 1e-8  # totals closer than this, relative to the largest cost, count as equal


def assign(rows: np.ndarray, cols: np.ndarray, cap: float | None = None):
    """Column of every row and the row prices; needs len(rows) <= len(cols) without a cap.

    With a cap a row may also stay alone at PENALTY (column -1); pairs beyond the cap are never made.
    """
    n, m = len(rows), len(cols)

    def fresh(i) -> np.ndarray:
        dy, dx = cols[:, 0] - rows[i, 0], cols[:, 1] - rows[i, 1]
        d = np.sqrt(dy * dy + dx * dx)
        if cap is None:
            return d
        alone = np.full(n, np.inf)  # one further column for every row, its own way out
        alone[i] = PENALTY
        return np.concatenate([np.where(d <= cap, d, np.inf), alone])

    m_all = m if cap is None else m + n
    held = np.stack([fresh(i) for i in range(n)]) if 0 < n * m_all <= HELD_CELLS else None

    def cost(i) -> np.ndarray:
        return fresh(i) if held is None else held[i]

    price_row, price_col = np.zeros(n), np.zeros(m_all)
    col_of, row_of = np.full(n, -1), np.full(m_all, -1)
    for i in range(n):  # cheap start: a row takes its nearest column when that is free
        c = cost(i)
        j = int(c.argmin())
        price_row[i] = c[j]
        if row_of[j] < 0:
            col_of[i], row_of[j] = j, i
    if m_all > 1:
        _bid(cost, price_row, price_col, col_of, row_of)
    for start in np.flatnonzero(col_of < 0):
        base = cost(start) - price_col
        price_row[start] = base.min()
        reach = base - price_row[start]
        via = np.full(m_all, start)
        closed = np.zeros(m_all, dtype=bool)
        ahead = reach.copy()  # reach of the open columns, infinite once closed
        while True:
            j = int(ahead.argmin())
            level = ahead[j]
            closed[j], ahead[j] = True, np.inf
            k = row_of[j]
            if k < 0:
                break
            step = cost(k) - price_col
            step += level - price_row[k]
            better = step < ahead
            better &= ~closed
            reach[better] = ahead[better] = step[better]
            via[better] = k
        slack = level - reach[closed]
        owners = row_of[closed]
        owned = owners >= 0
        price_row[owners[owned]] += slack[owned]
        price_col[closed] -= slack
        price_row[start] += level
        while True:  # flip the path
            i = via[j]
            row_of[j], j, col_of[i] = i, col_of[i], j
            if i == start:
                break
    if n == m_all and n:  # all columns taken: the lowest admissible row prices
        shift = price_col.max()
        price_row += shift
        price_col -= shift
    _settle_ties(cost, price_row, price_col, col_of, row_of, SAME * max(1.0, cap or float(np.abs(price_row).max(initial=0))))
    return np.where(col_of < m, col_of, -1), price_row


def _bid(cost, price_row, price_col, col_of, row_of, passes: int = 2) -> None:
    """Free rows bid for their best column by the gap to the second best, outbidding its holder.

    Prices stay dual feasible and free columns keep price 0, so the exact search can go on from here.
    """
    free = list(np.flatnonzero(col_of < 0))
    for _ in range(passes):
        todo, free, left = free, [], 4 * len(col_of)
        while todo:
            i = todo.pop()
            left -= 1
            c = cost(i) - price_col
            j = int(c.argmin())
            low = c[j]
            c[j] = np.inf
            other = int(c.argmin())
            second = c[other] if np.isfinite(c[other]) else low
            if low < second:
                price_col[j] -= second - low
            elif row_of[j] >= 0 and np.isfinite(c[other]):
                j = other
            k = row_of[j]
            price_row[i], row_of[j], col_of[i] = second, i, j
            if k >= 0:
                col_of[k] = -1
                (todo if low < second and left > 0 else free).append(k)
        if not free:
            return


def _settle_ties(cost, price_row, price_col, col_of, row_of, near: float) -> None:
    """Exchange columns along pairs of no slack until every row, in turn, has the lowest column it can have.

    Rows before the current one keep what they have. Only columns of price 0 may be left free; an unnamed row (-1) holds
    those that are, and may exchange them for any other of price 0.
    """
    tight = {i: np.flatnonzero(cost(i) - price_col <= price_row[i] + near) for i in range(len(col_of))}
    if all(len(t) <= 1 for t in tight.values()):
        return
    tight[-1] = np.flatnonzero(price_col >= -near)
    for i in range(len(col_of)):
        for j in tight[i].tolist():
            if j >= col_of[i] or _exchange(i, j, tight, col_of, row_of):
                break


def _exchange(i: int, j: int, tight: dict, col_of: np.ndarray, row_of: np.ndarray) -> bool:
    """Give column j to row i if rows after i can make room for it: a path from j's holder to the column that i gives up."""
    old, holder = col_of[i], int(row_of[j])
    if 0 <= holder < i:
        return False
    came, seen, met, queue = {}, {j}, {holder: j}, deque([holder])  # met: the column that each row on the way gives up
    while queue and old not in came:
        k = queue.popleft()
        for c in tight[k].tolist():
            held = int(row_of[c])
            if c in seen or (c != old and 0 <= held < i):
                continue
            seen.add(c)
            came[c] = k
            if c == old:
                break
            if held not in met:
                met[held] = c
                queue.append(held)
    if old not in came:
        return False
    at = old
    while at != j:
        k = came[at]
        row_of[at] = k
        if k >= 0:
            col_of[k] = at
        at = met[k]
    col_of[i], row_of[j] = j, i
    return True


def nearest(point: np.ndarray, cols: np.ndarray) -> tuple[int, float]:
    """What ``assign`` gives for a single row: the lowest of its nearest columns, and their distance."""
    dy, dx = cols[:, 0] - point[0], cols[:, 1] - point[1]
    d = np.sqrt(dy * dy + dx * dx)
    low = float(d.min())
    return int((d <= low + SAME * max(1.0, low)).argmax()), low


def pair_up(a: np.ndarray, b: np.ndarray):
    """Index pairs (into a, into b) of the cheapest assignment of the smaller side."""
    if len(a) == 0 or len(b) == 0:
        none = np.empty(0, dtype=int)
        return none, none
    if len(a) <= len(b):
        col_of, _ = assign(a, b)
        return np.arange(len(a)), col_of
    col_of, _ = assign(b, a)
    order = np.argsort(col_of)
    return col_of[order], order


def pairs_within(a: np.ndarray, b: np.ndarray, reach: float):
    """(into a, into b, distance) of all pairs at most `reach` apart, by a band of y at a time."""
    order = np.argsort(b[:, 0], kind="stable") if len(b) else np.empty(0, int)
    ys = b[order, 0]
    lo, hi = np.searchsorted(ys, a[:, 0] - reach * (1 + 1e-12), "left"), np.searchsorted(ys, a[:, 0] + reach * (1 + 1e-12), "right")
    i, j, d = [], [], []
    for k in range(len(a)):
        near = order[lo[k]:hi[k]]
        dy, dx = b[near, 0] - a[k, 0], b[near, 1] - a[k, 1]
        away = np.sqrt(dy * dy + dx * dx)
        fine = away <= reach
        i.append(np.full(int(fine.sum()), k))
        j.append(near[fine])
        d.append(away[fine])
    empty = [np.empty(0, int)]
    return np.concatenate(i or empty).astype(int), np.concatenate(j or empty).astype(int), np.concatenate(d or [np.empty(0)])


def pair_gated(a: np.ndarray, b: np.ndarray, cap: float):
    """Index pairs within the cap: as many as there can be, then the least total; rows of a in turn take the lowest of b.

    Only points within reach interact, so every connected piece is solved alone.
    """
    i, j, _ = pairs_within(a, b, cap)
    label = np.arange(len(a) + len(b))
    while True:  # least label of the piece, by hooking and pointer jumping
        least = np.minimum(label[i], label[len(a) + j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, len(a) + j, least)
        label = label[label]
        if (before == label).all():
            break
    order = np.argsort(label[i], kind="stable")
    out_i, out_j = [np.empty(0, int)], [np.empty(0, int)]
    for piece in np.split(order, np.flatnonzero(np.diff(label[i][order])) + 1) if len(order) else []:
        rows, cols = np.unique(i[piece]), np.unique(j[piece])
        if len(rows) == len(cols) == 1:
            out_i.append(rows)
            out_j.append(cols)
            continue
        col_of, _ = assign(a[rows], b[cols], cap)
        got = col_of >= 0
        out_i.append(rows[got])
        out_j.append(cols[col_of[got]])
    return np.concatenate(out_i), np.concatenate(out_j)
