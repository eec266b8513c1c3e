"""The merge of renamed series of one sign, cadence and chain of amounts, in scan order.

A plain search starts anew after each merge. Here it goes on where it is: of the
pairs that were turned down before, only those with the series just changed can
have become possible, so the series before it are asked about that one alone.
The result is the same. A union takes the place of its first series, so first days
stay in order: what begins after a series is a tail of the others, which is looked
at piece by piece until a match is found.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import pyarrow as pa

from ..plans import vocabulary as V

R = V.RECURRENCE
#: Series that are looked at at once.
PIECE = 1024
_MERGE, _PAIR = Fraction(R["merge_ratio"]), Fraction(R["pair_ratio"])


@dataclass(frozen=True)
class Series:
    """Days by their gaps, and each day's total in cents."""

    key: str
    first: date
    gaps: tuple[int, ...]
    totals: tuple[int, ...]
    description: str
    category: str | None
    accounts: frozenset[str]

    @property
    def last(self) -> date:
        return self.first + timedelta(days=sum(self.gaps))


def middle(values) -> Fraction:
    s, n = sorted(values), len(values)
    return Fraction(s[(n - 1) // 2] + s[n // 2], 2)


def alike(totals) -> int:
    """Neighbours that are within the pair ratio of each other."""
    sizes = [sorted((abs(a), abs(b))) for a, b in zip(totals, totals[1:], strict=False)]
    p, q = _PAIR.numerator, _PAIR.denominator
    return sum(lo > 0 and hi * q <= lo * p for lo, hi in sizes)


def rhythm(s: Series) -> tuple[str, int] | None:
    """(cadence, amount in cents) of a series that has a rhythm."""
    if len(s.totals) < R["min_days"]:
        return None
    gap = middle(s.gaps)
    found = next((c for c in V.CADENCES if c[1] <= gap <= c[2]), None)
    if found is None:
        return None
    regular = sum(found[1] <= g <= found[2] for g in s.gaps) / len(s.gaps)
    amount = round(middle(s.totals))
    if regular < R["regularity"] or amount == 0 or alike(s.totals) / (len(s.totals) - 1) < R["consistency"] and regular < R["strict_regularity"]:
        return None
    return found[0], amount


def union(a: Series, b: Series) -> Series:
    """Two series whose days are apart as one, in the place of the first."""
    old, new = (a, b) if a.last < b.first else (b, a)
    rich = b if len(b.description) > len(a.description) else a
    gaps = (*old.gaps, (new.first - old.last).days, *new.gaps)
    return replace(rich, first=old.first, gaps=gaps, totals=old.totals + new.totals, category=new.category, accounts=a.accounts | b.accounts)


def fixpoint(series: list[Series], cadence: str) -> list[Series]:
    """The series that are left when no pair can be merged, in order."""
    n = len(series)
    first, last = (np.array([getattr(s, at).toordinal() for s in series], np.int64) for at in ("first", "last"))
    size = np.array([abs(rhythm(s)[1]) for s in series], np.int64)
    there = np.ones(n, bool)
    p, q = _MERGE.numerator, _MERGE.denominator
    # First days never change and are in order; last days only grow, so this bounds them from below.
    earliest, live, gone = np.minimum.accumulate(last), np.arange(n), 0

    def match(i: int, among: slice, i_first: bool) -> int | None:
        """The first of some series that can be one with the i-th."""
        nonlocal live, gone
        if i_first:  # those behind begin no earlier, so they are apart only if they begin when it has ended
            start, stop = max(among.start, int(np.searchsorted(first, last[i], "right"))), n
        else:  # and those before it only if they have ended when it begins
            start, stop = 0, among.stop if among.stop and earliest[among.stop - 1] < first[i] else 0
        if start >= stop:
            return None
        if gone > max(PIECE, len(live) // 4):
            live, gone = live[there[live]], 0
        a, b = np.searchsorted(live, [start, stop])
        for piece in range(a, b, PIECE):
            some = live[piece : min(piece + PIECE, b)]
            least, most = np.minimum(size[some], size[i]), np.maximum(size[some], size[i])
            twins = there[some] & ((last[some] < first[i]) | (first[some] > last[i])) & (most * q <= least * p)
            for k in some[twins]:
                both = rhythm(union(series[i], series[k]) if i_first else union(series[k], series[i]))
                if both and both[0] == cadence:
                    return int(k)
        return None

    def merge(i: int, j: int) -> None:
        nonlocal gone
        gone += 1
        series[i] = union(series[i], series[j])
        first[i], last[i], size[i], there[j] = series[i].first.toordinal(), series[i].last.toordinal(), abs(rhythm(series[i])[1]), False

    for start in range(n):
        at = start
        while there[at] and (j := match(at, slice(at + 1, n), True)) is not None:
            merge(at, j)
            while (h := match(at, slice(0, at), False)) is not None:
                merge(h, at)
                at = h
    return [s for s, t in zip(series, there, strict=True) if t]


def scan_order(table: pa.Table, ddl: str) -> pa.Table:
    """:func:`fixpoint` over the rows of one group, in order of first day and key."""
    names = [c.split("`")[1] for c in ddl.split(", ") if "`" in c]
    rows = sorted(table.to_pylist(), key=lambda r: (r["first_date"], r["key"]))
    left = fixpoint([Series(r["key"], r["first_date"], tuple(r["gaps"]), tuple(r["totals"]), r["description"], r["category"], frozenset(r["accounts"])) for r in rows], rows[0]["cadence"])
    out = [
        {**{c: rows[0].get(c) for c in names}, "key": s.key, "n_occurrences": len(s.totals), "first_date": s.first, "last_date": s.last, "gaps": list(s.gaps), "totals": list(s.totals), "description": s.description, "category": s.category, "accounts": sorted(s.accounts), "alike": alike(s.totals)}
        for s in left
    ]
    fields = [table.schema.field(c) for c in names]
    return pa.Table.from_pylist(out, pa.schema([*fields, pa.field("alike", pa.int64())]))
