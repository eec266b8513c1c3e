"""The merge in scan order, piece by piece, against a plain search that starts anew after each merge."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tallywood.operators import scan_order as S


def made(seed: int) -> list[S.Series]:
    r, out = random.Random(seed), []
    for k in range(40):
        gaps = tuple(r.choice((28, 30, 30, 31, 60)) for _ in range(r.randrange(2, 8)))
        base = r.randrange(1000, 1900)
        s = S.Series(f"k{k:02}", date(2022, 1, 1) + timedelta(days=30 * r.randrange(25)), gaps, tuple(-base - r.randrange(100) for _ in range(len(gaps) + 1)), "d" * r.randrange(1, 9), None, frozenset("a"))
        if (S.rhythm(s) or [""])[0] == "monthly":
            out.append(s)
    return sorted(out, key=lambda s: (s.first, s.key))


def plain(series: list[S.Series]) -> list[S.Series]:
    def pair():
        for i, a in enumerate(series):
            for j in range(i + 1, len(series)):
                b = series[j]
                sizes = sorted((abs(S.rhythm(a)[1]), abs(S.rhythm(b)[1])))
                if (a.last < b.first or b.last < a.first) and sizes[1] <= sizes[0] * S._MERGE and (S.rhythm(S.union(a, b)) or [""])[0] == "monthly":
                    return i, j
        return None

    while found := pair():
        i, j = found
        series = [S.union(series[i], series[j]) if k == i else s for k, s in enumerate(series) if k != j]
    return series


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_pieces_find_the_same_merges(monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    merges = 0
    for seed in range(12):
        want = plain(made(seed))
        assert S.fixpoint(made(seed), "monthly") == want
        merges += len(made(seed)) - len(want)
    assert merges > 50
