"""Shared plumbing: scratch tables, partition counts, text kernels in numpy."""

from __future__ import annotations

import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20
_SIZE = struct.Struct("<Q")
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle partitions that one exchange has at most.
CEILING = 200_000


# ----------------------------------------------------------------- storage
def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where none is set, local mode (tests) gets a temporary one and a cluster an error: its executors share no local disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tallywood.scratch", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallywood-")
        spark.conf.set("spark.tallywood.scratch", at)
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`saved` wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan; for a file scan the bytes of the files, without reading them. 0 where it can't tell (it then says 2**50 or more)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def buckets_of(df: DataFrame, per: int = 64 * MB) -> int:
    """Groups to deal a table's rows or tokens into, each looked at in memory: the configured number of partitions, more where a group would exceed ``per``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // per))


def partitions(df: DataFrame, per: int = 64 * MB) -> int:
    """Shuffle partitions for a table. Beyond the ceiling a partition has several groups (see :func:`buckets_of`), one after the other."""
    return min(buckets_of(df, per), CEILING)


def chunk_of(docs: DataFrame, key: Column) -> Column:
    """The chunk of a document of a table: a few MB of text by a hash of the id."""
    chunks = max(buckets_of(docs), -(-input_bytes(docs) // MB))
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(chunks)).cast("long")


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, doc_id, text), dealt out by a hash of the id so that a chunk is found again at every pass.

    Only the id counts, so a hot source or many copies spread over all chunks.
    The exchange is the same at every use, so Spark runs it once; ``text`` is
    packed for it (see :func:`texts`).
    """
    rows = docs.select(chunk_of(docs, F.col(key)).alias("chunk"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_packed, "chunk long, doc_id long, text binary").repartition(partitions(docs), "chunk")


def _packed(batches):
    for batch in batches:
        raw, off = flat(batch.column("text"))
        data = memoryview(raw)
        small = [_SIZE.pack(z - a) + (pa.compress(data[a:z], codec="zstd", asbytes=True) if z > a else b"") for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("doc_id"), pa.array(small, pa.binary())], names=["chunk", "doc_id", "text"])


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with packed texts, where the documents lie."""
    rows = docs.select(F.lit(0).cast("long").alias("chunk"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_packed, "chunk long, doc_id long, text binary").drop("chunk")


def unpacked(column) -> pa.Array:
    """Texts as they were before packing, in UTF-8."""
    values = [v.as_py() for v in column]
    return pa.array([pa.decompress(memoryview(v)[8:], decompressed_size=n, codec="zstd", asbytes=True) if (n := _SIZE.unpack_from(v)[0]) else b"" for v in values], pa.large_binary())


def texts(table: pa.Table) -> pa.Table:
    """A chunk with its texts unpacked, in an order that doesn't depend on how a shuffle brought its rows."""
    if not table.num_rows:
        return table
    table = table.set_column(table.schema.get_field_index("text"), "text", unpacked(table.column("text")))
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


# ------------------------------------------------------------------ arrays
def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        array, kind = array.cast(pa.binary()), np.int32
    _, ends, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(ends, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, most: int = 2 * MB):
    """Ranges of rows of at most ``most`` bytes (or one row)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}
_ODD = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0xD6E8FEB86659FD93, 4: 0xA0761D6478BD642F}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """1, b, b**2 ... modulo 2**64, or of b's inverse."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = _ODD[which] if not inverse else pow(_ODD[which], -1, 1 << 64)
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[which, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, which: int) -> np.ndarray:
    """What :func:`span_hash` takes its hashes from, for callers that hash the same bytes again."""
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    base = powers(which, max(1, len(values)))
    for a in range(0, len(values), 1 << 14):  # in the processor's cache
        terms = values[a : a + (1 << 14)].astype(np.uint64)
        terms += np.uint64(1)
        terms *= base[a : a + len(terms)]
        terms[:1] += total[a : a + 1]
        np.cumsum(terms, out=total[a + 1 : a + 1 + len(terms)])
    return total


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span of at most SPAN bytes, from prefix sums of a polynomial modulo 2**64.

    Longer spans need :func:`word_hash`: from 1,024 bytes on, patterns exist that collide for every base.
    """
    if total is None:
        total = prefix_sums(values, which)
    got = total[end]
    got -= total[start]
    got *= powers(which, len(values) + 1, True)[start]
    got ^= (end - start).astype(np.uint64) << np.uint64(48)
    return mix(got)


#: The longest span that the polynomial hash is used for.
SPAN = 512
_REST = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span, of any length: each block of 8 bytes is mixed with its place in the span before the blocks are summed."""
    size = end - start
    many = np.maximum((size + 7) >> 3, 1)
    ends = np.cumsum(many)
    n = int(ends[-1]) if len(ends) else 0
    if n == len(size):
        at, place, left = start, np.zeros(1, np.uint64), size
    else:
        place = np.arange(n) - np.repeat(ends - many, many)
        at, left = np.repeat(start, many) + 8 * place, np.minimum(np.repeat(size, many) - 8 * place, 8)
        place = place.astype(np.uint64)
    data = np.append(raw, np.zeros(8, np.uint8))
    block = np.ndarray((len(raw) + 1,), "<u8", data, strides=(1,))[at].astype(np.uint64)
    block &= _REST[left]
    block ^= mix(place * np.uint64(_ODD[3]) + np.uint64(_ODD[which]))
    block = mix(block)
    total = block if n == len(size) else np.add.reduceat(block, ends - many)
    return mix(total ^ mix(size.astype(np.uint64) + np.uint64(_ODD[which])))


def gram_hash(h: np.ndarray, length: int, which: int = 1) -> np.ndarray:
    """The hash of h[i:i+length] for each i, put together from runs of 1, 2, 4 ... entries, mixed at each step."""
    one, two = np.uint64(_ODD[which]), np.uint64(_ODD[which + 2])
    n, size, out, done, have = len(h), 1, None, 0, h
    while n >= length:
        if length & size:
            out, done = have[: n - size + 1] if out is None else mix(out[: n - done - size + 1] * one + have[done : n - size + 1] * two), done + size
        if size * 2 > length:
            return out[: n - length + 1]
        have = mix(have[:-size] * one + have[size:] * two)
        size *= 2
    return np.zeros(0, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each word's row. Rows may touch: a word ends with its row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.searchsorted(off, start, "right") - 1
    return start, end, row


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each entry, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def spaced(raw: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, with one space between those of a row: bytes, and where each word starts in them."""
    size = end - start
    gap = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    to = np.cumsum(size + gap) - size
    out = np.full(int(size.sum() + gap.sum()), 0x20, np.uint8)
    out[ranges(to, size)] = raw[ranges(start, size)]
    return out, to


def word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only; words are compared byte by byte."""
    size = end - start
    data = raw[ranges(start, size)]
    off = np.append(0, np.cumsum(size)).astype(np.int64)
    words_of = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
    return words_of.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def gram_codes(code: np.ndarray, length: int) -> np.ndarray:
    """A number for code[i:i+length] for each i, the same for equal runs only."""

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].reshape(-1).astype(np.int64)

    n, size, out, done, have = len(code), 1, None, 0, code
    while n >= length:
        if length & size:
            out, done = have[: n - size + 1] if out is None else both(out[: n - done - size + 1], have[done : n - size + 1]), done + size
        if size * 2 > length:
            return out[: n - length + 1]
        have = both(have[:-size], have[size:])
        size *= 2
    return np.zeros(0, np.int64)


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array ``of``."""
    if not len(of) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return of[at] == x


def group_minmax(order_keys: list[np.ndarray], value: np.ndarray):
    """For rows that agree in all keys: (index of one row, least value, largest value)."""
    order = np.lexsort((value, *order_keys[::-1]))
    head = np.ones(len(order), bool)
    if len(order):
        head[1:] = False
        for k in order_keys:
            s = k[order]
            head[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(order)) - 1 if len(at) else at
    return order[at], value[order[at]], value[order[last]]


def by_bucket(bucket: np.ndarray):
    """(bucket, rows) for each bucket present."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    s = bucket[order]
    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    for a, b in zip(cut, np.append(cut[1:], len(s)), strict=True):
        yield int(s[a]), order[a:b]

