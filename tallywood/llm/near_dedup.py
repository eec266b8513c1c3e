"""MinHash near-dedup by an inverted join over signature coordinates.

A signature has K coordinates: the hashes of a document's shingles fall into K
bins and each bin keeps its least. Documents with the same words are one class.
Each (coordinate, value) pair is a posting list of classes. Two classes above
the similarity threshold agree in at least MATCH percent of their coordinates,
so they meet among the rarest coordinates of either that this share can't do
without. Only these prefixes are posted and merged, which counts the collisions
of each pair; the long lists of common coordinates are skipped, and looked at
only for pairs that have met. Pairs whose collisions over all coordinates reach
the match threshold are retained, and compared shingle by shingle, word by word.

Lists are merged in two passes. In the first, the classes of a list are paired
with the most central one, its hub, so that a family of near copies costs as many
pairs as it has members. In the second, classes whose lists have one hub meet in
blocks, where collisions are counted between those that are still in different
components, and the likeliest are compared first. Only links that join two
components leave a block, and none of these is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MB, buckets_of, by_bucket, discard, flat, gram_codes, gram_hash, input_bytes, member, mix, packed, partitions, ranges, saved, slices, spaced, unpacked, word_codes, word_hash, words
from ._exchange import answer, ask, finish, gathered, pack

K = 64
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Least percentage of the coordinates of either class in which a retained pair agrees.
MATCH = 45
#: Classes that are compared with a hub in one task, and the shingles they have at most together (or one class).
BLOCK, BLOCK_SHINGLES = 192, 1 << 18
#: Classes of a side in a block of the second pass, and the shingles they have at most together (or one class).
SIDE, SIDE_SHINGLES = 512, 1 << 18
#: Shingles that are looked up at a time, and bytes of text that are described at a time (or one).
CODES, TEXT = 1 << 17, MB // 2
_SETS = "doc_id long, n_shingles long, digest binary, sig binary"


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def needed(count: np.ndarray | int):
    """How many of ``count`` coordinates a retained pair agrees in."""
    return (count * MATCH + 99) // 100


def shingles(raw: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, by row and hash. Fewer than k words are one shingle."""
    h = word_hash(raw, start, end, 1)
    first = np.searchsorted(row, np.arange(rows + 1))
    size = np.diff(first)
    grams = gram_hash(h, k)
    at = np.flatnonzero(row[: len(grams)] == row[k - 1 :])
    hashes, owner = [grams[at]], [row[at]]
    for n in range(1, k):
        few = np.flatnonzero(size == n)
        if len(few):
            hashes.append(mix(gram_hash(h, n)[first[few]] + np.uint64(n)))
            owner.append(few)
    h, r = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], r[new]


def signatures(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """K coordinates for each row; EMPTY where no shingle fell into the bin."""
    x = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    out = np.full(rows * K, EMPTY, np.uint64)
    np.minimum.at(out, row * K + (x % np.uint64(K)).astype(np.int64), x // np.uint64(K))
    return out.reshape(rows, K)


def _describe(batches):
    for batch in batches:
        raw, off = flat(batch.column("text"))
        raw = lowered(raw)
        for a, z in slices(off, TEXT):
            part, n = raw[off[a] : off[z]], z - a
            start, end, row = words(part, off[a : z + 1] - off[a])
            h, owner = shingles(part, start, end, row, n)
            data, to = spaced(part, start, end, row)
            cut = np.append(to, len(data))[np.searchsorted(row, np.arange(n + 1))]
            data = data.tobytes()
            digest = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, n), pa.array(np.bincount(owner, minlength=n)), pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in signatures(h, owner, n)], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )


class _Classes:
    """The classes of a chunk and their coordinates. A token is a hash of coordinate and value."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("rep").to_numpy().astype(np.int64)
        self.sizes = table.column("n_shingles").to_numpy().astype(np.int64)
        sig = np.frombuffer(flat(table.column("sig"))[0].tobytes(), np.uint64).reshape(-1, K)
        self.row, coordinate = np.nonzero(sig != EMPTY)
        self.token = mix(sig[self.row, coordinate] * np.uint64(K) + coordinate.astype(np.uint64))
        self.count = np.bincount(self.row, minlength=len(self.ids))

    def prefixes(self, token: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which tokens are posted, how common each class's tokens are), given the tokens that several classes have."""
        order = np.argsort(token)
        token, df = token[order], df[order]
        often = np.ones(len(self.token), np.int64)
        if len(token):
            at = np.minimum(np.searchsorted(token, self.token), len(token) - 1)
            often = np.where(token[at] == self.token, df[at], 1)
        score = np.bincount(self.row, np.log(often), len(self.ids)) / np.maximum(1, self.count)
        order = np.lexsort((self.token, often, self.row))
        first = np.searchsorted(self.row[order], np.arange(len(self.ids)))
        place = np.arange(len(order)) - first[self.row[order]]
        posted = (place <= (self.count - needed(self.count))[self.row[order]]) & (often[order] > 1)
        return order[posted], score


def _tokens(c: _Classes, buckets: int) -> list[tuple[int, bytes]]:
    token, n = np.unique(c.token, return_counts=True)
    return [(b, pack(token[i], n[i].astype(np.uint32))) for b, i in by_bucket((token >> np.uint64(40)) % np.uint64(buckets))]


def _frequent(table: pa.Table) -> list[tuple[int, bytes]]:
    row, (token, n) = gathered(table, (np.uint64, np.uint32))
    value, group = np.unique(token, return_inverse=True)
    df = np.bincount(group, n, len(value)).astype(np.uint32)
    keep = np.flatnonzero(df[group] > 1)
    chunks = table.column("chunk").to_numpy()
    return [(int(chunks[r]), pack(token[keep[i]], df[group[keep[i]]])) for r, i in by_bucket(row[keep])]


_POSTED = "token long, rep long, n_shingles long, score double"


def _posted(table: pa.Table, got: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(("token", "rep", "n_shingles", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})
    c = _Classes(table)
    which, score = c.prefixes(*gathered(got, (np.uint64, np.uint32))[1])
    row = c.row[which]
    return pa.table({"token": c.token[which].view(np.int64), "rep": c.ids[row], "n_shingles": c.sizes[row], "score": score[row]})


def _alike(a: str, b: str):
    """Sets of these sizes can have 75 % of their union in common."""
    return (4 * F.col(a) >= 3 * F.col(b)) & (4 * F.col(b) >= 3 * F.col(a))


def hubs_of(posted: DataFrame) -> DataFrame:
    """(token, b, nb): the most central class of each posting list of several, and its size."""
    hubs = posted.groupBy("token").agg(F.max(F.struct("score", -F.col("rep"), "n_shingles")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return hubs.select("token", (-F.col("hub.col2")).alias("b"), F.col("hub.n_shingles").alias("nb"))


def with_hubs(posted: DataFrame, hubs: DataFrame) -> DataFrame:
    """(a, b, met): each class of a posting list with the list's hub, and in how many lists they met."""
    return posted.join(hubs, "token").where(F.col("rep") != F.col("b")).where(_alike("n_shingles", "nb")).groupBy(F.col("rep").alias("a"), "b").agg(F.count(F.lit(1)).alias("met"))


def across(posted: DataFrame, hubs: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, i, j, rest, rep, label): who meets in which block of the second pass.

    The largest component of a hub's classes needs no pairs of its own, so what is
    left of them (``rest``, dealt over j) meets all (dealt over i).
    """
    named = posted.join(hubs, "token").join(labels, F.col("rep") == F.col("node"), "left")
    named = named.groupBy(F.col("b").alias("hub"), "rep").agg(F.first(F.coalesce("label", "rep")).alias("label"), F.first("n_shingles").alias("n"))
    parts = named.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    met = parts.groupBy("hub").agg(F.max(F.struct("k", "n", "label")).alias("top"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    blocks = lambda k, n: F.greatest(F.ceil(k / SIDE), F.ceil(n / SIDE_SHINGLES)).cast("int")
    met = met.select("hub", F.col("top.label").alias("big"), blocks(F.col("k"), F.col("n")).alias("wide"), blocks(F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n")).alias("deep"))
    every = named.drop("n").join(met, "hub")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = every.where("label <> big").select("hub", each("wide").alias("i"), own("deep").alias("j"), F.lit(True).alias("rest"), "rep", "label")
    return some.union(every.select("hub", own("wide").alias("i"), each("deep").alias("j"), F.lit(False), "rep", "label"))


def _agree(batches):
    """The pairs that agree in enough of all coordinates of either."""
    for batch in batches:
        x, y = (np.frombuffer(flat(batch.column(c))[0].tobytes(), np.uint64).reshape(-1, K) for c in ("sa", "sb"))
        full = x != EMPTY
        collisions = ((x == y) & full).sum(1)
        keep = collisions >= needed(np.maximum(full.sum(1), (y != EMPTY).sum(1)))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b", "na")], names=["a", "b", "na"])


def retained(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, na: shingles of a) above the match threshold."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("sig").alias(f"s{s}"), F.col("n_shingles").alias(f"n{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "sb").mapInArrow(_agree, "a long, b long, na long").distinct()


class _Sets:
    """The exact shingle sets of a table's texts. Texts of fewer words have none that another class could share."""

    def __init__(self, column, k: int = 5):
        raw, off = flat(unpacked(column))
        raw = lowered(raw)
        start, end, row = words(raw, off)
        gram = gram_codes(word_codes(raw, start, end), k)
        at = np.flatnonzero(row[: len(gram)] == row[k - 1 :])
        self.top = int(gram.max()) + 1 if len(gram) else 1
        self.key = np.unique(row[at] * self.top + gram[at])
        self.cut = np.searchsorted(self.key, np.arange(len(off)) * self.top)
        self.size = np.diff(self.cut)

    def linked(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of rows have ``percent`` of their union in common."""
        out = np.zeros(len(x), bool)
        total = np.append(0, np.cumsum(self.size[x]))
        a = 0
        while a < len(x):
            z = max(a + 1, int(np.searchsorted(total, total[a] + CODES, "right")) - 1)
            p, n = x[a:z], self.size[x[a:z]]
            code = self.key[ranges(self.cut[p], n)] % self.top
            hit = member(np.repeat(y[a:z], n) * self.top + code, self.key)
            common = np.bincount(np.repeat(np.arange(len(p)), n), hit, len(p)).astype(np.int64)
            out[a:z] = (common > 0) & (100 * common >= percent * (n + self.size[y[a:z]] - common))
            a = z
        return out


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """The links between a hub and the classes that came to one of its tiles."""
    rep, hub = table.column("rep").to_numpy(), table.column("hub")[0].as_py()
    sets = _Sets(table.column("text"))
    other, own = np.flatnonzero(rep != hub), np.flatnonzero(rep == hub)
    x, y = np.repeat(other, len(own)), np.tile(own, len(other))
    found = np.unique(rep[x[sets.linked(x, y, percent)]])
    pa.default_memory_pool().release_unused()
    return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array(np.full(len(found), hub), pa.int64())})


def joining(est: np.ndarray, x: np.ndarray, y: np.ndarray, label: np.ndarray, linked) -> list[tuple[int, int]]:
    """Links among the candidate pairs (x, y) that join components, given by label: for each x its likeliest candidates by ``est``, one, then two, four ..., until no pair of two components is left to look at."""
    _, part = np.unique(label, return_inverse=True)
    above = np.arange(int(part.max()) + 1)

    def root(v: int) -> int:
        while above[v] != v:
            above[v] = above[above[v]]
            v = above[v]
        return v

    order = np.lexsort((y, -est, x))
    x, y, links, many = x[order], y[order], [], 1
    while len(x):
        first = np.searchsorted(x, x, "left")
        now = np.arange(len(x)) - first < many
        p, q = x[now], y[now]
        for k in np.flatnonzero(linked(p, q)).tolist():
            a, b = root(part[p[k]]), root(part[q[k]])
            if a != b:
                above[max(a, b)] = min(a, b)
                links.append((int(p[k]), int(q[k])))
        roots = np.array([root(v) for v in range(len(above))])[part]
        left = ~now & (roots[x] != roots[y])
        x, y, many = x[left], y[left], 2 * many
    return links


def _meet(table: pa.Table, percent: int) -> pa.Table:
    """A block of the second pass: pairs above the match threshold of its rest with all, until each pair is of one component or compared."""
    rep, label, rest = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "label", "rest"))
    sig = np.frombuffer(flat(table.column("sig"))[0].tobytes(), np.uint64).reshape(-1, K)
    x, y = np.flatnonzero(rest), np.flatnonzero(~rest)
    collisions = np.zeros((len(x), len(y)), np.uint8)
    for k in range(K):
        a, b = sig[x, k], sig[y, k]
        collisions += (a[:, None] == b) & (a != EMPTY)[:, None]
    count = (sig != EMPTY).sum(1)
    keep = (collisions >= needed(np.maximum(count[x][:, None], count[y]))) & (label[x][:, None] != label[y])
    i, j = np.nonzero(keep)
    links: list[tuple[int, int]] = []
    if len(i):
        sets = _Sets(table.column("text"))
        n, x, y = sets.size, x[i], y[j]
        alike = (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x])
        links = joining(collisions[i, j][alike].astype(np.int64), x[alike], y[alike], label, lambda p, q: sets.linked(p, q, percent))
    found = pa.table({"a": pa.array([int(rep[p]) for p, _ in links], pa.int64()), "b": pa.array([int(rep[q]) for _, q in links], pa.int64())})
    pa.default_memory_pool().release_unused()  # idle workers would keep it
    return found


def confirmed(pairs: DataFrame, bodies: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have ``percent`` of their union in common, compared on their words.

    The partners of b are dealt into tiles of bounded size, and b goes to each.
    """
    hubs = pairs.groupBy("b").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("na") / BLOCK_SHINGLES)).cast("int").alias("tiles"))
    dealt = pairs.join(hubs, "b").select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int").alias("tile"), F.col("a").alias("rep"))
    own = hubs.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("b").alias("rep"))
    tiles = dealt.union(own).join(bodies.select("rep", "text"), "rep")
    return tiles.groupBy("hub", "tile").applyInArrow(lambda t: _compare(t, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over links (a, b), null ends and self-links left out.

    Labels spread over links and jump to their own labels until nothing changes.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = saved(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "step")
        own = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = saved(step.join(own, "label").select("node", F.least("label", "next").alias("label"), "was"), "labels")
        discard(labels)
        discard(step)
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            discard(both)
            return labels


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept and n_links (links found at its class, 0 if none).

    Sets hold the distinct shingles of five words, A-Z in lower case; fewer words
    are one shingle. Documents are linked if their sets have 75 % of their union
    in common, confirmed on full sets. A null, empty or blank text has no
    shingles and is linked with nothing. Rows that repeat an id are one document
    with one component, linked by each of their texts, and all are kept if the id
    is. A row with a null doc_id is a component of its own with component_id null
    and is kept. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    described = saved(rows.mapInArrow(_describe, _SETS), "signatures")
    full = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = saved(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    said = full.select("doc_id", "digest").distinct()
    again = said.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("doc_id")
    # The texts of a repeated id are of one document.
    same = saved(said.join(again, "doc_id").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "repeated")
    parts, buckets = partitions(docs), buckets_of(docs)
    chunks = max(buckets, -(-input_bytes(described) // (2 * MB)))
    base = classes.select(F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("long").alias("chunk"), "rep", "n_shingles", "sig").repartition(parts, "chunk")
    common = answer(ask(base, lambda t: _tokens(_Classes(t), buckets)), _frequent)
    posted = saved(finish(base, common, _posted, _POSTED), "posted")
    hubs = saved(hubs_of(posted), "hubs")
    met = posted.join(hubs.select("token"), "token", "left_semi").select("rep").distinct()
    bodies = packed(docs, key, text).join(met, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text")
    bodies = saved(bodies.join(classes.select("rep", "sig"), "rep"), "bodies")
    links = saved(confirmed(retained(with_hubs(posted, hubs), classes), bodies), "links")
    blocks = across(posted, hubs, components(links.union(same))).join(bodies, "rep")
    links = links.union(saved(blocks.groupBy("hub", "i", "j").applyInArrow(lambda t: _meet(t, 75), "a long, b long"), "links"))
    per = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    labels = components(links.union(same))
    named = classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left").join(per, "rep", "left")
    named = saved(named.select("digest", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    out = described.drop("sig").join(named, "digest", "left")
    own = F.col("n_shingles") == 0
    label = F.when(F.col("doc_id").isNull() | own, F.col("doc_id")).otherwise(F.col("label"))
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.expr("doc_id").eqNullSafe(label).alias("kept"), F.when(own, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
