"""Suffix arrays by linear grouping, for many strings at once.

Suffixes are first grouped by their longest Lyndon prefix: groups start from
the first symbol and are processed in descending order. When a group with
prefix u is processed, each member looks at the nearest unprocessed position
before it (its previous-smaller pointer); that suffix's prefix grows by u, and
by as many u as follow in a row, so it moves to a new group right above its
old one. Afterwards, in ascending order, each group's order is emitted from
what follows its members' runs of u, which lies in a lower group and is placed
already. Nothing is renamed and no prefix is compared twice.

All strings go through their own t-th group in step t, so that a step is a few
array operations over all of them.
"""

from __future__ import annotations

import numpy as np


def _order(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The order by a, then b, then c (-1 or more), as one key of 63 bits where they fit."""
    top = max(int(a.max()), int(b.max()), int(c.max()) + 1) if len(a) else 0
    if top >= 1 << 21:
        return np.lexsort((c, b, a))
    return np.argsort((a.astype(np.int64) << 42) | (b.astype(np.int64) << 21) | (c.astype(np.int64) + 1))


def suffix_arrays(symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The suffix array of each string symbols[off[s]:off[s+1]], one after the other, as positions in ``symbols``.

    Each string's last symbol must be smaller than all its others and occur once.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    kind = np.int32 if n < 1 << 30 else np.int64
    off = off.astype(kind)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    # Groups are ranges of slots: group g is slots g .. g + size[g] - 1.
    at = _order(owner, symbols, np.arange(n)).astype(kind)
    slot = np.empty(n, kind)
    slot[at] = np.arange(n)
    head = np.append(True, (symbols[at][1:] != symbols[at][:-1]) | (owner[at][1:] != owner[at][:-1]))
    starts = np.flatnonzero(head).astype(kind)
    group = np.empty(n, kind)
    group[at] = starts[np.cumsum(head) - 1]
    size = np.zeros(n, kind)
    size[starts] = np.diff(np.append(starts, n))
    left, right = np.arange(-1, n - 1, dtype=kind), np.arange(1, n + 1, dtype=kind)
    left[off[:-1]] = -1
    right[off[1:] - 1] = -1
    bound, floor = off[1:].copy(), off[:-1]
    steps = []
    live = np.flatnonzero(bound > floor)
    while len(live):
        end = bound[live]
        g = group[at[end - 1]]
        bound[live] = g
        live = live[g > floor[live]]
        count = end - g
        if len(count) == int(count.sum()):
            members = at[g]
        else:
            members = np.sort(at[np.repeat(g - np.cumsum(count) + count, count) + np.arange(int(count.sum()))])
        before = left[members]
        fresh = np.ones(len(members), bool)
        if len(members) > 1:
            fresh[1:] = before[1:] != members[:-1]
        first = np.flatnonzero(fresh)
        length = np.diff(np.append(first, len(members)))
        last = first + length - 1
        above, after = before[first], right[members[last]]
        togo = np.repeat(last, length) - np.arange(len(members)) + 1
        steps.append((members, togo, np.repeat(after, length)))
        has = above >= 0
        right[above[has]] = after[has]
        has2 = after >= 0
        left[after[has2]] = above[has2]
        moved, times = above[has], length[has]
        if not len(moved):
            continue
        old = group[moved]
        alone = size[old] == 1
        if alone.any():  # a group of one stays where it is
            moved, times, old = moved[~alone], times[~alone], old[~alone]
            if not len(moved):
                continue
        order = _order(old, times, moved)
        moved, times, old = moved[order], times[order], old[order]
        cut = np.append(True, old[1:] != old[:-1])
        block = np.flatnonzero(cut)
        many = np.diff(np.append(block, len(old)))
        rank = np.arange(len(old)) - np.repeat(block, many)
        to = old + size[old] - np.repeat(many, many) + rank
        low = old + size[old] - np.repeat(many, many)
        here = slot[moved]
        inside = here >= low
        # Those that leave a slot below make room for those that are in the way above.
        taken = at[to]
        mark = group[moved]  # remembered: -1 marks what moves
        group[moved] = -1
        way = group[taken] >= 0
        group[moved] = mark
        evicted, holes = taken[way], here[~inside]
        # Both lists go by old group, with as many entries for each.
        holes = holes[np.argsort(old[~inside], kind="stable")]
        at[holes] = evicted
        slot[evicted] = holes
        at[to] = moved
        slot[moved] = to
        new = cut.copy()
        new[1:] |= times[1:] != times[:-1]
        lead = np.flatnonzero(new)
        size[old[block]] -= many
        size[to[lead]] = np.diff(np.append(lead, len(old)))
        group[moved] = np.repeat(to[lead], np.diff(np.append(lead, len(old))))
    rank = np.full(n + 1, -1, kind)  # the last entry stands for "nothing follows"
    out = np.empty(n, np.int64)
    for members, togo, after in reversed(steps):
        g = group[members]
        if len(members) > 1:
            order = _order(g, togo, rank[after])
            members, g = members[order], g[order]
            cut = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            to = g + np.arange(len(g)) - np.repeat(cut, np.diff(np.append(cut, len(g))))
        else:
            to = g
        out[to] = members
        rank[members] = to
    return out
