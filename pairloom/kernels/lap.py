"""Linear assignment by shortest augmenting paths."""

from __future__ import annotations

import numpy as np

ROUNDS = 3


def assign(gain: np.ndarray) -> np.ndarray:
    """The column of each row in a permutation of the largest total gain. Square input."""
    return priced(gain)[0]


def bid(cost: np.ndarray, col_price: np.ndarray, row_of: np.ndarray, free: list[int]) -> list[int]:
    """Each free row takes its best column, whose price falls by its lead over the second best. Returns who is free then."""
    left, turns = [], 0
    while free and turns < 4 * len(cost):
        turns += 1
        i = free.pop()
        reduced = cost[i] - col_price
        j = int(reduced.argmin())
        least, reduced[j] = reduced[j], np.inf
        k = int(reduced.argmin())
        lead = reduced[k] - least
        if lead > 0:
            col_price[j] -= lead
        elif row_of[j] >= 0:
            j = k
        out, row_of[j] = int(row_of[j]), i
        if out >= 0:
            (free if lead > 0 else left).append(out)
    return left + free


def priced(gain: np.ndarray, col_price: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The columns of assign(), and the columns' prices, which make a good start for similar gains.

    Rows first bid for columns. Then, row by row, a shortest path in reduced costs leads from what is free
    to a free column; all columns' labels are updated at once, and the prices follow along the path.
    """
    cost = gain.max(initial=0.0) - gain
    n = len(cost)
    col_of, row_of = np.full(n, -1), np.full(n, -1)
    col_price = (cost.min(0) if n else np.zeros(0)) if col_price is None else col_price.copy()
    if n > 1:
        reduced = cost - col_price
        least = reduced.min(1)
        for i, j in enumerate(reduced.argmin(1)):  # a cheap start: free columns at their rows' least reduced cost
            if row_of[j] < 0:
                row_of[j] = i
        col_of[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
        free = np.flatnonzero(col_of < 0).tolist()
        for _ in range(ROUNDS):
            free = bid(cost, col_price, row_of, free)
        col_of[:] = -1
        col_of[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    row_price = (cost - col_price).min(1) if n else np.zeros(0)
    for start in np.flatnonzero(col_of < 0):
        label = cost[start] - row_price[start] - col_price
        via = np.full(n, start)
        open_ = label.copy()  # labels, those done at infinity
        order: list[int] = []
        while True:
            j = int(open_.argmin())
            least = label[j]
            if row_of[j] < 0:
                break
            open_[j] = np.inf
            order.append(j)
            i = row_of[j]
            new = cost[i] - col_price
            new += least - row_price[i]
            better = np.flatnonzero((new < label) & (open_ < np.inf))
            label[better] = open_[better] = new[better]
            via[better] = i
        seen = np.array(order, int)
        row_price[start] += least
        row_price[row_of[seen]] += least - label[seen]
        col_price[seen] -= least - label[seen]
        while True:
            i = via[j]
            row_of[j] = i
            col_of[i], j = j, col_of[i]
            if i == start:
                break
    return col_of, col_price
