"""Internal transfers: pairing outgoing and incoming legs."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import pair_id
from ..functions.text import has_hint
from ..plans import vocabulary as V


def candidates(legs: DataFrame, window_days: int = V.TRANSFER_WINDOW, require_hint: bool = True) -> DataFrame:
    """(amount, out_key, in_key, gap): opposite amounts on different accounts, at most so many days apart; a hint on either side unless they are of one day.

    The equality on the amount makes it a hash join. Popular amounts are salted
    by day bucket: legs within the window are in the same or the next bucket.
    """
    width = max(1, window_days)
    rows = legs.withColumn("hint", has_hint(F.col("description"))).withColumn("bucket", F.floor(F.unix_date("value_date") / width))
    outs = rows.where("amount < 0").select((-F.col("amount")).alias("size"), F.col("natural_key").alias("out_key"), F.col("account").alias("out_account"), F.col("value_date").alias("out_day"), F.col("hint").alias("out_hint"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    ins = rows.where("amount > 0").select(F.col("amount").alias("size"), F.col("natural_key").alias("in_key"), F.col("account").alias("in_account"), F.col("value_date").alias("in_day"), F.col("hint").alias("in_hint"), "bucket")
    gap = F.abs(F.datediff("in_day", "out_day"))
    pairs = outs.join(ins, ["size", "bucket"]).withColumn("gap", gap).where((F.col("out_account") != F.col("in_account")) & (F.col("gap") <= window_days))
    if require_hint:
        pairs = pairs.where((F.col("gap") == 0) | F.col("out_hint") | F.col("in_hint"))
    return pairs.select("size", "out_key", "in_key", "gap")


def sides(legs: DataFrame, window_days: int, owner: tuple[str, ...] = ()) -> DataFrame:
    """(owner, size, run, key, account, day, hint, out): legs that could have a partner.

    Legs of one size are cut into runs where more than the window lies between one
    day and the next; no pair spans two runs. Runs with one sign only are left out.
    Runs are found among the days of a size, not among its legs.
    """
    rows = legs.where("amount <> 0").select(
        *owner, F.abs("amount").alias("size"), F.col("natural_key").alias("key"), "account", F.unix_date("value_date").alias("day"), has_hint(F.col("description")).alias("hint"), (F.col("amount") < 0).alias("out")
    )
    line = [*owner, "size"]
    days = rows.groupBy(*line, "day").agg(F.max("out").alias("outs"), F.min("out").alias("all_out"))
    w = W.partitionBy(*line).orderBy("day")
    new = F.coalesce(F.col("day") - F.lag("day").over(w) > window_days, F.lit(True))
    runs = days.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    both = W.partitionBy(*line, "run")
    runs = runs.withColumn("two", F.max("outs").over(both) & ~F.min("all_out").over(both)).where("two").select(*line, "day", "run")
    return rows.join(runs, [*line, "day"])


def find_pairs(legs: DataFrame, window_days: int = V.TRANSFER_WINDOW, require_hint: bool = True, owner: tuple[str, ...] = ()) -> DataFrame:
    """(out_key, in_key, gap, size, transfer_group): the greedy one-to-one pairing by (gap, larger amount, keys).

    Legs of different sizes never meet, so the order by amount has no part in it: each run
    of a size (see :func:`sides`) is paired by one sweep, see :class:`Sweep`. No table
    of candidates is made: work and memory grow with the legs of a run. A run is
    one task's, as the greedy order is one sequence; ``owner`` names columns that
    tell apart whose legs may be paired, and with many owners keeps runs small.
    """
    rows = sides(legs, window_days, owner)
    group = [*owner, "size", "run"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group, "key").select(*group, "key", "account", "day", "hint", "out")
    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in [*owner, "size"]) + ", out_key string, in_key string, gap int"
    return dealt.mapInArrow(_swept(group, window_days, require_hint), ddl).withColumn("transfer_group", pair_id(F.col("out_key"), F.col("in_key")))


class _Cell:
    """Free incoming legs of one day that all have a hint, or all have none: by account, the least key first."""

    def __init__(self) -> None:
        self.queues: dict[str, deque[str]] = {}
        self.heads: list[tuple[str, str]] = []

    def add(self, key: str, account: str) -> None:
        """Keys come in order."""
        queue = self.queues.setdefault(account, deque())
        if not queue:
            heapq.heappush(self.heads, (key, account))
        queue.append(key)

    def first(self, account: str) -> tuple[str, str] | None:
        """The leg with the least key of another account."""
        if not self.heads or self.heads[0][1] != account:
            return self.heads[0] if self.heads else None
        # A heap's second is one of the root's children.
        return min(self.heads[1:3], default=None)

    def take(self, leg: tuple[str, str]) -> None:
        key, account = leg
        if self.heads[0] == leg:
            heapq.heappop(self.heads)
        else:
            self.heads.remove(leg)
            heapq.heapify(self.heads)
        queue = self.queues[account]
        queue.popleft()
        if queue:
            heapq.heappush(self.heads, (queue[0], account))


def sweep(rows: list[tuple[str, str, int, bool, bool]], window_days: int, require_hint: bool) -> list[tuple[str, str, int]]:
    """(out_key, in_key, gap) of legs (key, account, day, hint, out) of one size, in order of keys.

    For each gap, the nearest first, outgoing legs in order of their keys take the
    least incoming key that many days away, on another account, with a hint on
    either side unless it is the same day. The order of candidates by (gap, out_key,
    in_key) comes to the same.
    """
    cells: dict[tuple[int, bool], _Cell] = {}
    outs = []
    for key, account, day, hint, out in rows:
        if out:
            outs.append((key, account, day, hint))
        else:
            cells.setdefault((day, hint), _Cell()).add(key, account)
    pairs, days = [], {day for day, _ in cells}
    for gap in range(window_days + 1):
        rest = []
        for leg in outs:
            key, account, day, hint = leg
            best = at_best = None
            for at in (day - gap, day + gap) if gap else (day,):
                if at not in days:
                    continue
                for h in (True, False) if hint or gap == 0 or not require_hint else (True,):
                    cell = cells.get((at, h))
                    first = cell.first(account) if cell else None
                    if first and (best is None or first < best):
                        best, at_best = first, (at, h)
            if best is None:
                rest.append(leg)
                continue
            cells[at_best].take(best)
            pairs.append((key, best[0], gap))
            if not cells[at_best].heads:
                del cells[at_best]
                if (at_best[0], not at_best[1]) not in cells:
                    days.discard(at_best[0])
        outs = rest
        if not cells:
            break
    return pairs


def _swept(group: list[str], window_days: int, require_hint: bool):
    """Sweeps the runs of a task one after the other; rows come sorted by run and key."""

    names = [c for c in group if c != "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, have, now, pairs = [], [], None, []

        def flushed() -> pa.RecordBatch:
            types = [*kinds, pa.string(), pa.string(), pa.int32()]
            out = pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], t) for i, t in enumerate(types)], names=[*names, "out_key", "in_key", "gap"])
            pairs.clear()
            return out

        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in names]
            runs = zip(*(batch.column(c).to_pylist() for c in group), strict=True)
            legs = zip(*(batch.column(c).to_pylist() for c in ("key", "account", "day", "hint", "out")), strict=True)
            for at, leg in zip(runs, legs, strict=True):
                if at != now:
                    if have:
                        pairs.extend((*now[:-1], *p) for p in sweep(have, window_days, require_hint))
                    have, now = [], at
                    if len(pairs) >= 10_000:
                        yield flushed()
                have.append(leg)
        if have:
            pairs.extend((*now[:-1], *p) for p in sweep(have, window_days, require_hint))
        if pairs:
            yield flushed()

    return run


def relink(ledger: DataFrame, window_days: int = V.TRANSFER_WINDOW, owner: tuple[str, ...] = ()) -> DataFrame:
    """The ledger with transfer groups found anew."""
    pairs = find_pairs(ledger, window_days, owner=owner)
    groups = pairs.select("transfer_group", F.explode(F.array("out_key", "in_key")).alias("natural_key"))
    return ledger.drop("transfer_group").join(groups, "natural_key", "left").select(*ledger.columns)


def volume(pairs: DataFrame) -> DataFrame:
    """Number of pairs and money moved; the net of equal and opposite legs is zero by construction."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("size"), F.lit(0)).cast("decimal(38,2)").alias("volume"))
