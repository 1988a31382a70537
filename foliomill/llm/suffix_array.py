"""Suffix arrays by linear grouping.

Phase 1 keeps the suffixes in groups that are in order, at first by their first symbol.  Groups are processed from
the highest to the lowest.  Each suffix of the group points to the previous suffix that is in a lower group; a
suffix that is pointed at is greater than the others of its own group, the more pointers the greater, and moves to a
new group just above.  In the end suffixes are grouped by their longest Lyndon prefix, and the groups are in order.
Phase 2 takes the suffixes in order, from the end of the text on: the suffix before the one just placed, and
those its pointers lead to, are the least left of their groups.  No names are given and nothing is sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: bytes | Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in order; a suffix that is a prefix of another comes first.

    ``symbols`` are non-negative integers.
    """
    n = len(symbols)
    if n == 0:
        return []
    # An end mark, less than any symbol, is suffix n.
    keys = np.empty(n + 1, np.int64)
    keys[:n] = np.frombuffer(symbols, np.uint8) if isinstance(symbols, bytes) else symbols
    keys[:n] += 1
    keys[n] = 0
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    is_start = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(is_start)
    start_of_place = np.repeat(starts, np.diff(np.append(starts, n + 1)))
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n + 1)
    at = order.tolist()
    group = start_of_place[place].tolist()
    place = place.tolist()
    size = [0] * (n + 1)
    for s, m in zip(starts.tolist(), np.diff(np.append(starts, n + 1)).tolist(), strict=True):
        size[s] = m
    prev = list(range(-1, n))

    end = n
    while end >= 0:
        g = group[at[end]]
        if g == end:
            i = at[end]
            p = prev[i]
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                q = group[p]
                left = size[q] - 1
                if left:
                    size[q] = left
                    low = q + left
                    old, other = place[p], at[low]
                    at[old], at[low] = other, p
                    place[other], place[p] = old, low
                    group[p] = low
                    size[low] = 1
            end = g - 1
            continue
        pointers: dict[int, int] = {}
        for i in sorted(at[g : end + 1]):
            p = prev[i]
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        levels: dict[int, dict[int, list[int]]] = {}
        for p, count in pointers.items():
            levels.setdefault(count, {}).setdefault(group[p], []).append(p)
        for count in sorted(levels, reverse=True):
            for q, moved in levels[count].items():
                left = size[q] - len(moved)
                if left == 0:
                    continue
                size[q] = left
                low = q + left
                size[low] = len(moved)
                to = low
                for p in moved:
                    old, other = place[p], at[to]
                    at[old], at[to] = other, p
                    place[other], place[p] = old, to
                    group[p] = low
                    to += 1
        end = g - 1

    result = [-1] * (n + 1)
    free = list(range(n + 1))
    placed = bytearray(n + 1)
    result[0], placed[n] = n, 1
    for k in range(n + 1):
        j = result[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return result[1:]
