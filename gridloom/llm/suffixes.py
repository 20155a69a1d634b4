"""Suffix array of an integer string by linear grouping construction.

Suffixes are grouped by their Lyndon prefixes.  Groups are processed from the highest down: each suffix
of a group finds its previous smaller neighbour (the nearest position before it in a lower group), and the
positions found leave their own group for a new one just above it, higher the more suffixes of the
processed group point at them.  What results is the groups' final order.  Then the array is written from
its smallest suffix on: each suffix in order places the positions before it, along the previous-smaller
pointers, at the next free place of their groups.  No part of the string is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of ``symbols``, a shorter suffix before those it begins."""
    size = len(symbols)
    low = min(symbols, default=0) - 1
    text = [*(s - low for s in symbols), 0]  # a smallest symbol of its own at the end
    n = size + 1
    members: list[list[int]] = []
    group = [0] * n
    seen: dict[int, int] = {}
    for s in sorted(set(text)):
        seen[s] = len(members)
        members.append([])
    for i, s in enumerate(text):
        group[i] = seen[s]
        members[seen[s]].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    previous = [-1] * n
    done = bytearray(n)
    order: list[int] = []
    current = len(members) - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        if own:
            own.sort()
            order.append(current)
            pointed: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and (done[j] or group[j] == current):
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            for i in own:
                done[i] = 1
            members[current] = own
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, k in pointed.items():
                by_count.setdefault(k, {}).setdefault(group[j], []).append(j)
            for k in sorted(by_count, reverse=True):
                for old, moved in by_count[k].items():
                    new = len(members)
                    members.append(moved)
                    for j in moved:
                        group[j] = new
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
        current = below[current]
    free = [0] * len(members)
    at = 0
    for g in reversed(order):
        free[g] = at
        at += len(members[g])
    array = [-1] * n
    placed = bytearray(n)
    array[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = array[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            array[free[g]] = j
            free[g] += 1
            j = previous[j]
    return array[1:]


def common_prefixes(symbols: list[int], array: list[int]) -> list[int]:
    """How many symbols each suffix of the array shares with the one before it."""
    n = len(symbols)
    rank = [0] * n
    for k, i in enumerate(array):
        rank[i] = k
    out = [0] * n
    h = 0
    for i in range(n):
        if rank[i]:
            j = array[rank[i] - 1]
            while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


def classes(symbols: list[int], depth: int) -> np.ndarray:
    """A number for each position: equal where the next ``depth`` symbols are; -1 where no other position has them."""
    out = np.full(len(symbols), -1, np.int64)
    if not symbols:
        return out
    array = suffix_array(symbols)
    shared = np.array(common_prefixes(symbols, array)) >= depth
    number = np.cumsum(~shared)
    twin = shared.copy()
    twin[:-1] |= shared[1:]
    where = np.array(array)
    out[where[twin]] = number[twin]
    return out
