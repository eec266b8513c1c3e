"""Fill-in-the-middle by a parallel automaton scan.

A text is cut at two of its units (code points) into prefix, middle and suffix
and put together anew, so that a model learns to infill. Where the k-th unit
ends in UTF-8, and whether a marker occurs, is said by a small automaton over
bytes. Texts are scanned in stretches at once, none waiting for the one before:
a stretch emits, for every state it may be entered in, the state it is left in
and the units and markers that end in it. Composition of these functions is
associative, so the entry state of every stretch follows by doubling, and a cut
is looked for in the one stretch that holds it.

Texts of more than a piece (64 KiB) are dealt out in pieces: tasks scan pieces,
the functions of a document's pieces (a few numbers each) meet, and the pieces
with the cuts are searched where the document lies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import flat, partitions, slices

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Bytes that one row of a scan has at most; a document of more is a giant.
PIECE = 1 << 16
#: Bytes of a stretch.
STRETCH = 1024
#: Copies of a giant's cuts, so that rows which repeat one giant meet them in several tasks.
SALTS = 8


@dataclass(frozen=True)
class Automaton:
    """States and bytes: the next state, and the units and markers that end with the byte. It starts in state 0."""

    step: np.ndarray
    units: np.ndarray
    marks: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step)

    @property
    def packed(self) -> np.ndarray:
        """One number for each (state, byte): next state, units, markers."""
        return (self.step.astype(np.int32) | self.units.astype(np.int32) << 8 | self.marks.astype(np.int32) << 20).ravel()


@cache
def code_points(markers: tuple[str, ...] = MARKERS) -> Automaton:
    """Units are code points of UTF-8; markers are ASCII.

    States are the beginnings of markers just read, and one to three bytes still
    due of a code point.
    """
    whole = [m.encode("ascii") for m in markers]
    begun = sorted({m[:i] for m in whole for i in range(len(m))} | {b""}, key=lambda s: (len(s), s))
    number = {s: i for i, s in enumerate(begun)}
    due = [None, *range(len(begun), len(begun) + 3)]
    shape = (len(begun) + 3, 256)
    step, units, marks = np.zeros(shape, np.uint8), np.zeros(shape, np.uint8), np.zeros(shape, np.uint8)
    for s, i in [*number.items(), *((b"", d) for d in due[1:])]:
        for b in range(0x80):
            seen = s + bytes([b])
            step[i, b] = next(number[seen[k:]] for k in range(len(seen) + 1) if seen[k:] in number)
            units[i, b], marks[i, b] = 1, any(seen.endswith(m) for m in whole)
        for more, first, last in ((1, 0xC0, 0xDF), (2, 0xE0, 0xEF), (3, 0xF0, 0xFF)):
            step[i, first : last + 1] = due[more]
    for more in (1, 2, 3):
        step[due[more], 0x80:0xC0] = due[more - 1] if more > 1 else 0
        units[due[more], 0x80:0xC0] = more == 1
    return Automaton(step, units, marks)


# ---------------------------------------------------------------- scanning
def functions(auto: Automaton, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch and each state it may be entered in: the state it is left in, and the units and markers that end in it."""
    order = np.argsort(-size, kind="stable")
    at, long = start[order], size[order]
    state = np.tile(np.arange(auto.states, dtype=np.int32), (len(order), 1))
    seen, table = np.zeros_like(state), auto.packed
    for j in range(int(long[0]) if len(long) else 0):
        n = int(np.searchsorted(-long, -j))  # stretches of more than j bytes
        got = table[(state[:n] << 8) + raw[at[:n] + j][:, None]]
        state[:n] = got & 0xFF
        seen[:n] += got >> 8
    back = np.argsort(order)
    return state[back], (seen & 0xFFF)[back].astype(np.int64), (seen >> 12)[back].astype(np.int64)


def composed(to: np.ndarray, units: np.ndarray, marks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each function after all before it, back to where ``first`` is set, by doubling."""
    n = len(to)
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(first, at, 0))
    d = 1
    while n and d <= int((at - head).max()):
        i = np.flatnonzero(at - d >= head)
        before = to[i - d]
        to_i = np.take_along_axis(to[i], before, 1)
        units_i, marks_i = units[i - d] + np.take_along_axis(units[i], before, 1), marks[i - d] + np.take_along_axis(marks[i], before, 1)
        to, units, marks = to.copy(), units.copy(), marks.copy()
        to[i], units[i], marks[i] = to_i, units_i, marks_i
        d *= 2
    return to, units, marks


def places(auto: Automaton, raw: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Bytes of each stretch up to the end of its ``want``-th unit, entered in ``state``; ``want`` is one at least."""
    state, table = state.astype(np.int32), auto.packed
    left, out = want.astype(np.int64), np.zeros(len(start), np.int64)
    todo = np.arange(len(start))
    for j in range(int(size.max()) if len(size) else 0):
        todo = todo[size[todo] > j]
        got = table[(state[todo] << 8) + raw[start[todo] + j]]
        state[todo] = got & 0xFF
        left[todo] -= (got >> 8) & 0xFFF
        done = left[todo] <= 0
        out[todo[done]] = j + 1
        todo = todo[~done]
        if not len(todo):
            break
    return out


def _selected(total: np.ndarray, base: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The stretch with the want-th unit (one at least) of its document; ``total`` counts units up to a stretch's end over all documents, ``base`` those of documents before."""
    return np.searchsorted(total, base + want, "left")


def cuts(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units before the middle and before the suffix."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def scanned(auto: Automaton, raw: np.ndarray, off: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """Of each row of bytes: n units, markers, the cuts in units (first, second) and in bytes (first_byte, second_byte)."""
    size = off[1:] - off[:-1]
    many = -(-size // STRETCH)
    row = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = off[:-1][row] + nth * STRETCH
    long = np.minimum(size[row] - nth * STRETCH, STRETCH)
    to, units, marks = composed(*functions(auto, raw, start, long), nth == 0)
    last, some = np.cumsum(many) - 1, many > 0
    n, found = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    n[some], found[some] = units[last[some], 0], marks[last[some], 0]
    base = np.cumsum(n) - n
    total = units[:, 0] + base[row]
    first, second = cuts(n, h1, h2)
    out = {"n": n, "marks": found, "first": first, "second": second}
    for name in ("first", "second"):
        want, at = out[name], np.zeros(len(size), np.int64)
        rows = np.flatnonzero(want > 0)
        s = _selected(total, base[rows], want[rows])
        inside = nth[s] > 0
        entry = np.where(inside, to[np.maximum(s - 1, 0), 0] if len(to) else 0, 0)
        before = np.where(inside, units[np.maximum(s - 1, 0), 0] if len(units) else 0, 0)
        at[rows] = nth[s] * STRETCH + places(auto, raw, start[s], long[s], entry, want[rows] - before)
        out[f"{name}_byte"] = at
    return out


# ------------------------------------------------------------ column functions
_CUT = "struct<n:bigint,marks:bigint,first:bigint,second:bigint,first_byte:bigint,second_byte:bigint>"
_FUNCTION = "struct<leads:array<int>,units:array<bigint>,marks:array<bigint>>"
_FOUND = "name string, sha string, n long, marks long, first long, second long, first_piece long, first_entry long, first_want long, second_piece long, second_entry long, second_want long"


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _cut_udf(markers: tuple[str, ...]):
    @F.arrow_udf(_CUT)
    def cut(body: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        raw, off = flat(body)
        a, b, auto, parts = _numbers(h1), _numbers(h2), code_points(markers), []
        for i, j in slices(off):
            parts.append(scanned(auto, raw[off[i] : off[j]], off[i : j + 1] - off[i], a[i:j], b[i:j]))
        names = ["n", "marks", "first", "second", "first_byte", "second_byte"]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64)) for x in names], names)

    return cut


def _function_udf(markers: tuple[str, ...]):
    @F.arrow_udf(_FUNCTION)
    def function(body: pa.Array) -> pa.Array:
        raw, off = flat(body)
        auto, got = code_points(markers), []
        for i in range(len(off) - 1):
            start = np.arange(off[i], off[i + 1], STRETCH)
            size = np.minimum(off[i + 1] - start, STRETCH)
            all_of = composed(*functions(auto, raw, start, size), np.arange(len(start)) == 0)
            got.append([x[-1] for x in all_of])
        lists = lambda k, kind: pa.array([g[k].tolist() for g in got], pa.list_(kind))
        return pa.StructArray.from_arrays([lists(0, pa.int32()), lists(1, pa.int64()), lists(2, pa.int64())], ["leads", "units", "marks"])

    return function


def _place_udf(markers: tuple[str, ...]):
    @F.arrow_udf("bigint")
    def place(body: pa.Array, entry: pa.Array, want: pa.Array) -> pa.Array:
        raw, off = flat(body)
        asked, out = _numbers(want), np.zeros(len(off) - 1, np.int64)
        i = np.flatnonzero(asked > 0)
        out[i] = places(code_points(markers), raw, off[:-1][i], (off[1:] - off[:-1])[i], _numbers(entry)[i], asked[i])
        return pa.array(out)

    return place


def _resolved(pieces: pa.Table) -> pa.Table:
    """The pieces of one giant, put together: its counts, and of each cut the piece, the state that is entered in and the units wanted from there."""
    pieces = pieces.sort_by("piece")
    matrix = lambda c: np.array(pieces.column(c).to_pylist(), np.int64)
    to, units, marks = composed(matrix("leads"), matrix("units"), matrix("marks"), np.arange(pieces.num_rows) == 0)
    name, sha, h1, h2 = (pieces.column(c)[0].as_py() for c in ("name", "sha", "h1", "h2"))
    n = units[-1:, 0]
    out = {"name": name, "sha": sha, "n": int(n[0]), "marks": int(marks[-1, 0])}
    for cut, want in zip(("first", "second"), cuts(n, np.array([h1]), np.array([h2])), strict=True):
        w = int(want[0])
        p = int(np.searchsorted(units[:, 0], w, "left")) if w else 0
        entry, before = (int(to[p - 1, 0]), int(units[p - 1, 0])) if p else (0, 0)
        out |= {cut: w, f"{cut}_piece": p, f"{cut}_entry": entry, f"{cut}_want": w - before}
    return pa.Table.from_pylist([out]).select([c.split()[0] for c in _FOUND.split(", ")])


# ------------------------------------------------------------------- operator
def draws(name: Column, seed: str = "1:") -> list[Column]:
    """Four numbers below 2**32: the first 32 digits of the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed), name).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1:", piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    ``plain_percent`` of the documents stay as they are, as do empty texts and those
    that contain a marker; ``spm_percent`` of the others have the suffix first. The cuts
    depend on the id, the seed and n only. A null text is an empty one; a null id
    draws as the text "null"; rows that repeat an id are cut by the same draws, each
    by its own length. An empty table gives an empty one; other columns are ignored.
    """
    name, body = F.coalesce(F.col(key).cast("long").cast("string"), F.lit("null")), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(key).alias("doc_id"), name.alias("name"), body.alias("body"))
    giant = F.octet_length("body") > piece
    small = _drawn(rows.where(~giant), seed).withColumn("cut", _cut_udf(MARKERS)("body", "h1", "h2")).select("doc_id", "body", "h3", "h4", "cut.*")
    found = small.unionByName(_giants(_drawn(rows.where(giant), seed), piece))

    plain = (F.col("n") == 0) | (F.col("marks") > 0) | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    part = lambda a, b: F.substring(F.col("body"), a + 1, b - a)
    a, b = F.col("first_byte").cast("int"), F.col("second_byte").cast("int")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, F.octet_length("body"))
    mark = {m: F.lit(m).cast("binary") for m in MARKERS}
    psm = F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    spm = F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    out = found.withColumn("form", form)
    cut = F.col("form") != "plain"
    return out.select(
        "doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("body")).cast("string").alias("output"),
    )


def _drawn(rows: DataFrame, seed: str) -> DataFrame:
    return rows.select("*", *[h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col("name"), seed))])


def _giants(rows: DataFrame, piece: int) -> DataFrame:
    """Giants with their cuts. A document is known by its id and its text, so rows that repeat both are scanned once more but resolved once."""
    rows = rows.withColumn("sha", F.sha2("body", 256))
    numbers = F.sequence(F.lit(0), ((F.octet_length("body") - 1) / piece).cast("int"))
    pieces = rows.select("name", "sha", "h1", "h2", F.posexplode(F.transform(numbers, lambda i: F.substring(F.col("body"), i * piece + 1, F.lit(piece)))).alias("piece", "part"))
    scanned_pieces = pieces.repartition(partitions(rows), "sha", "name", "piece").withColumn("f", _function_udf(MARKERS)("part")).select("name", "sha", "h1", "h2", "piece", "f.*")
    found = scanned_pieces.dropDuplicates(["name", "sha", "piece"]).groupBy("name", "sha").applyInArrow(_resolved, _FOUND)
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("salt", F.spark_partition_id() % SALTS).join(found, ["name", "sha", "salt"])
    place = _place_udf(MARKERS)
    for cut in ("first", "second"):
        at = F.col(f"{cut}_piece").cast("int") * piece
        met = met.withColumn(f"{cut}_byte", at + place(F.substring(F.col("body"), at + 1, F.lit(piece)), F.col(f"{cut}_entry"), F.col(f"{cut}_want")))
    return met.select("doc_id", "body", "h3", "h4", "n", "marks", "first", "second", "first_byte", "second_byte")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from; markers are found, not counted, as the text has none."""
    before, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    head = lambda mark: F.substring_index(before, mark, 1)
    tail = lambda mark: F.substring_index(before, mark, -1)
    psm = F.concat(F.substring_index(head(SUFFIX), PREFIX, -1), middle, tail(SUFFIX))
    spm = F.concat(tail(PREFIX), middle, F.substring_index(head(PREFIX), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
