"""Near-duplicate removal: an exact join of texts by the sets of their runs of words, one document of each group.

Texts are compared by the sets of their runs of five words. Groups are connected components of the pairs whose exact Jaccard
similarity is at least ``similarity``: nothing else connects two texts, and only equal sets are not compared.

All such pairs share one of the first n - ceil(similarity * n) + 1 shingles of each set, in any order of shingles that is the
same for all sets (prefix filtering). The order puts shingles that many texts share last, so passages that are common in the
corpus lead to no pairs; ``COMMON`` of them at most are counted and broadcast, and only speed depends on which.

Pairs are verified in three rounds, and a round takes no pair of a component that is known or that was tried. The first two only
connect most of a group by few pairs: a forest of SimHash candidates by covering masks (halves of the 64 bits with radius 6),
then neighbours among the texts of a shingle. The last takes all pairs that share a shingle, have sizes and positions that allow
the similarity, and are still apart; after it no pair is left. Where over FEW texts share a shingle, their sets come along as
bitmaps: sets differ in as many shingles as their bitmaps in bits at least, so pairs that differ in more than the similarity
allows end in the task that meets them. What is left of families of just less similar texts are comparisons of bitmaps, and the
few pairs that bitmaps don't tell apart. Buckets of over BUCKET texts are cut into blocks, and blocks are compared with each
other in tasks of their own, so no task holds more than two blocks.

Texts are not shuffled as a whole: which of them take part in a join is tested against a bitmap of fixed size, and only
those that may (and the few that fall on a set bit by chance) are joined by their key.

Null and empty texts have no words and are one group. Of a group, the row with the smallest id stays, a null id last; of
rows with the same id, one. Other columns are carried as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import LOWER, collect_garbage, give_back, shrink_executors, text_bytes, written
from tidegraph.llm.graph import components
from tidegraph.llm.simhash import SEED, covering_masks, fingerprint_of

RADII = ((range(32), 6), (range(32, 64), 6))
SLACK, WIDE = 16, 30
SCOUTS = 10  # tables of the first round
ALIKE = 0.8  # of the sizes of two sets, the smaller over the larger
BUCKET = 16_384
BITMAP = 1 << 26  # bits
COMMON = 200_000  # shingles that are put last
COUNTED = 1 << 21  # shingles that a task counts at a time
FEW_ROWS = 16_384, 2  # documents a file, and files a core, of tables with a few rows for each document
MANY = 2_048, 8  # and of those with many
FEW = 32  # texts of a shingle whose pairs are made without a look at their bitmaps
SKETCH = 2048  # bits of the bitmap of a set
SET_BYTES = 5  # of a shingle's hash where two sets are compared; different shingles of two texts share them once in 1e12 pairs


#: Of the bytes, for polynomial hashes of runs of words.
BYTES = np.random.default_rng(SEED).integers(1 << 63, size=256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the power of 0 to n - 1, modulo 2 ** 64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b % (1 << 64), np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))


def shingles_of(text: str | None, words: int) -> np.ndarray:
    """A 64-bit hash of each run of so many words, lower-cased and joined by a space; of the whole text if it has fewer; none without words."""
    parts = text_bytes(text).translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size)[: max(1, len(parts) - words + 1)], ends[min(words, len(parts)) - 1 :]
    up, down = _powers(1 << max(12, len(joined).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[np.frombuffer(joined, np.uint8)] * up[: len(joined)])])
    h = (total[last] - total[first]) * down[first]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def _halves() -> list[int]:
    return [m for positions, radius in RADII for m in covering_masks(radius, positions)]


def _pairs_within(groups: np.ndarray, prints: np.ndarray, seconds: np.ndarray, known: np.ndarray, sizes: np.ndarray, slack: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one group that are candidates and not known to be connected; if ``apart``, only of different values of it. Groups are contiguous."""
    left = np.searchsorted(groups, groups, side="right") - np.arange(len(groups))
    rows, step = np.flatnonzero(left > 1), 1
    first, second = [], []
    while len(rows):
        differ = np.bitwise_count((prints[rows] ^ prints[rows + step]).view(np.uint64))
        i = rows[differ <= slack]
        if len(i):
            j = i + step
            near = differ[differ <= slack] + np.bitwise_count((seconds[i] ^ seconds[j]).view(np.uint64)) <= WIDE
            near &= (known[i] == 0) | (known[i] != known[j])
            near &= np.minimum(sizes[i], sizes[j]) >= ALIKE * np.maximum(sizes[i], sizes[j])
            if apart is not None:
                near &= apart[i] != apart[j]
            first.append(i[near])
            second.append(j[near])
        step += 1
        rows = rows[left[rows] > step]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _first_meeting(t: np.ndarray, a: np.ndarray, b: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether t is the first table in which each pair meets."""
    differ = a ^ b
    first = np.full(len(a), -1)
    for i in range(len(masks) - 1, -1, -1):
        first[differ & masks[i] == 0] = i
    return first == t


_FOUND = "a long, b long, large short, second long, known int, size int"


def _found_batch(a: np.ndarray, b: np.ndarray, large: np.ndarray, second: np.ndarray, known: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(large, pa.int16()), pa.array(second, pa.int64()), pa.array(known, pa.int32()), pa.array(size, pa.int32())]
    return pa.record_batch(columns, names=["a", "b", "large", "second", "known", "size"])


class Forest:
    """Which fingerprints, or known components, a task has connected by candidates so far."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links, one after the other, join what was apart."""
        new = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.above[x] = y
                new[k] = True
        return new


def _candidate_batches(t: np.ndarray, groups: np.ndarray, prints: np.ndarray, seconds: np.ndarray, known: np.ndarray, sizes: np.ndarray, masks: np.ndarray, slack: int, forest: Forest, apart: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    i, j = _pairs_within(groups, prints, seconds, known, sizes, slack, apart)
    keep = _first_meeting(t[i], prints[i], prints[j], masks)
    i, j = i[keep], j[keep]
    distance = np.bitwise_count((prints[i] ^ prints[j]).view(np.uint64)).astype(int) + np.bitwise_count((seconds[i] ^ seconds[j]).view(np.uint64))
    order = np.argsort(distance, kind="stable")
    i, j = i[order], j[order]
    node = np.where(known, known, prints)
    new = forest.join(node[i], node[j])
    a, b = prints[i][new], prints[j][new]
    zero = np.zeros(len(a), np.int64)
    yield _found_batch(np.minimum(a, b), np.maximum(a, b), zero - 1, zero, zero, zero)


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _emit(masks: np.ndarray, slack: int):
    """Of rows t, key, print, second, known, size sorted by the first two: candidate pairs (a, b), and the members of buckets that are too large, with their table."""

    def beyond_bucket(c: list[np.ndarray]) -> pa.RecordBatch:
        return _found_batch(c[2], c[2], c[0], c[3], c[4], c[5])

    forest = Forest()

    def whole(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(c[0]):
            groups = np.cumsum(_starts(c[:2]))
            large = np.bincount(groups)[groups] > BUCKET
            if large.any():
                yield beyond_bucket([x[large] for x in c])
            yield from _candidate_batches(c[0][~large], groups[~large], *(x[~large] for x in c[2:]), masks, slack, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, k) for k in (np.int16, np.int64, np.int64, np.int64, np.int32, np.int32)]
        beyond = None  # the bucket whose first members have been passed on as too large
        for part in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, part.columns, strict=True)]
            if beyond is not None:
                n = int(((held[0] == beyond[0]) & (held[1] == beyond[1])).sum())
                yield beyond_bucket([c[:n] for c in held])
                held = [c[n:] for c in held]
                beyond = None if len(held[0]) else beyond
            if len(held[0]):
                last = len(held[0]) - int(((held[0] == held[0][-1]) & (held[1] == held[1][-1])).sum())
                yield from whole([c[:last] for c in held])
                held = [c[last:] for c in held]
                if len(held[0]) > BUCKET:
                    beyond = (held[0][0], held[1][0])
                    yield beyond_bucket(held)
                    held = [c[:0] for c in held]
        yield from whole(held)

    return run


def _emit_blocks(masks: np.ndarray, slack: int):
    """Of rows t, key, i, j, print, second, known, size, block sorted by the first four: candidate pairs of two blocks; those within one block where i = j."""

    forest = Forest()

    def whole(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(c[0]):
            groups = np.cumsum(_starts(c[:4]))
            for own in (True, False):
                rows = np.flatnonzero((c[2] == c[3]) == own)
                if len(rows):
                    yield from _candidate_batches(c[0][rows], groups[rows], *(x[rows] for x in c[4:8]), masks, slack, forest, None if own else c[8][rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, part.columns, strict=True)] if held else [c.to_numpy() for c in part.columns]
            last = len(held[0]) - int(np.logical_and.reduce([c == c[-1] for c in held[:4]]).sum())
            yield from whole([c[:last] for c in held])
            held = [c[last:] for c in held]
        if held:
            yield from whole(held)

    return run


def files_for(df: DataFrame, a_file: int, a_core: int) -> int:
    """In how many files at most tables of a few rows for each of df are written: one for so many rows of df, and so many for each core."""
    return max(math.ceil(df.count() / a_file), a_core * df.sparkSession.sparkContext.defaultParallelism)


def candidates(prints: DataFrame, every: int = 1, slack: int = SLACK) -> DataFrame:
    """a < b: candidate pairs of distinct fingerprints, in every ``every``-th table: of each task's candidates a forest that connects them, close pairs first. prints: print, second, known (0, or the number of the component that is known), size of the set."""
    masks = _halves()[::every]
    tables = np.array(masks, np.int64)
    keyed = F.explode(F.array(*(F.struct(F.lit(i).cast("short").alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks))))
    rows = prints.select("print", "second", "known", "size", keyed.alias("x")).select("x.t", "x.key", "print", "second", "known", "size")
    found = written(rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_emit(tables, slack), _FOUND), files=files_for(prints, *MANY))
    pairs = found.where("large < 0").select("a", "b")
    large = found.where("large >= 0").select(F.col("a").alias("print"), F.col("large").alias("t"), "second", "known", "size")
    if large.isEmpty():
        return pairs
    large = large.withColumn("key", F.col("print").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("t") + 1)))
    blocks = large.groupBy("t", "key").agg(F.ceil(F.count("*") / (BUCKET // 2)).cast("int").alias("n"))
    placed = large.join(blocks, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("print"), F.col("n")).cast("int"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "print", "second", "known", "size", "block")
    more = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(_emit_blocks(tables, slack), _FOUND)
    return pairs.unionAll(more.select("a", "b").distinct())


def scouted(first: DataFrame, files: int | None = None) -> DataFrame:
    """a < b: nodes whose fingerprints are equal or candidates of the first round."""
    of = written(first.groupBy("print").agg(F.min("node").alias("node"), F.min_by(F.struct("second", "size"), "node").alias("x")).select("print", "node", F.lit(0).alias("known"), "x.*"), files=files)
    end = lambda name: of.select(F.col("print").alias(name), F.col("node").alias(f"node_{name}"))
    near = candidates(of, len(_halves()) // SCOUTS).join(end("a"), "a").join(end("b"), "b").select("node_a", "node_b")
    equal = first.select("print", "node").join(of.select("print", F.col("node").alias("least")), "print").where("node <> least").select("least", "node")
    pairs = near.unionAll(equal).toDF("a", "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprints(text: Column, words: int) -> Column:
    """struct(print, second, size, node): two fingerprints of the distinct runs of words, the second of hashes that are mixed once more, how many there are, and a hash of their set."""

    @F.arrow_udf("print long, second long, size int, node long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            prints, seconds, sizes, nodes = [], [], [], []
            for t in texts:
                distinct = np.unique(shingles_of(t.as_py(), words))
                prints.append(fingerprint_of(distinct))
                mixed = distinct * np.uint64(0x9E3779B97F4A7C15)
                seconds.append(fingerprint_of((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)))
                sizes.append(len(distinct))
                nodes.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
            yield pa.StructArray.from_arrays([pa.array(prints, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(nodes, np.uint64).view(np.int64))], names=["print", "second", "size", "node"])
        give_back()

    return run(text)


def bitmap_of(keys: DataFrame, name: str, bits: int = BITMAP) -> list:
    """Segments of a bitmap of so many bits with the hashes of the keys set: at most bits / 8 bytes, whatever the number of keys."""
    at = F.pmod(F.xxhash64(name), F.lit(bits))
    # Spark counts bit positions from 1.
    rows = keys.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("segment")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return [(r["segment"], bytes(r["bits"])) for r in rows.toLocalIterator()]


def maybe_in(df: DataFrame, name: str, segments: list, bits: int = BITMAP) -> Column:
    """Whether the bitmap has the hash of the column: true for every key, and for few others."""
    held = np.zeros(((bits + (1 << 15) - 1) >> 15, 1 << 12), np.uint8)
    for s, b in segments:
        held[s - 1] = np.frombuffer(b, np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def test(at: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flat = sent.value.reshape(-1)  # looked up as it is: a byte for each bit would be 64 MB in every worker
        for places in at:
            p = places.to_numpy(zero_copy_only=False)
            yield pa.array((flat[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))

    return test(F.pmod(F.xxhash64(name), F.lit(bits)))


def packed(hashes: np.ndarray) -> bytes:
    """The sorted distinct upper SET_BYTES bytes of the hashes, dealt by significance, which compresses better."""
    kept = np.unique(hashes >> np.uint64(64 - 8 * SET_BYTES))
    return np.ascontiguousarray(kept.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(SET_BYTES, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :SET_BYTES] = parts.T
    return out.view(np.uint64).ravel()


def shingle_set(text: Column, words: int) -> Column:
    """The packed hashes of the runs of words."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([packed(shingles_of(t.as_py(), words)) for t in texts], pa.binary())
        give_back()

    return run(text)


def sketch_of(hashes: np.ndarray) -> bytes:
    """A bitmap of SKETCH bits with those of the hashes set that the exact comparison sees: two sets differ in as many shingles as their bitmaps in bits at least."""
    bits = np.zeros(SKETCH, bool)
    bits[(hashes >> np.uint64(64 - 8 * SET_BYTES)) % np.uint64(SKETCH)] = True
    return np.packbits(bits).tobytes()


def sketch(text: Column, words: int) -> Column:
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([sketch_of(shingles_of(t.as_py(), words)) for t in texts], pa.binary())
        give_back()

    return run(text)


def jaccard(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in pairs:
            out = []
            for p, q in zip(x, y, strict=True):
                p, q = unpacked(p.as_py()), unpacked(q.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / (len(p) + len(q) - both) if len(p) + len(q) else 1.0)
            yield pa.array(out, pa.float64())
        give_back()

    return run(a, b)


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (sorted) that most texts share, and in about how many texts they are: ``COMMON`` at most."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(held)
        held.clear()  # the task's most memory is here
        values.sort()
        again = np.concatenate([[False], values[1:] == values[:-1], [False]])
        first, last = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(again[:-1] & ~again[1:])
        return pa.record_batch([pa.array(values[first].view(np.int64)), pa.array(last - first + 1, pa.int64())], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in batches:
            for t in part["text"]:
                held.append(np.unique(shingles_of(t.as_py(), words)))
                size += len(held[-1])
                if size > COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)
        give_back()

    found = texts.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 3")
    rows = found.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingles, n = rows["shingle"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def _prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of a sorted set, the first shingles in the order of all sets: another set with the similarity has one of them among its own first."""
    n = len(shingles)
    k = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        often = np.where(common[at] == shingles, counts[at], 0)
        shingles = shingles[np.argsort(often, kind="stable")]
    return shingles[:k]


def prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """token, size, node, at: of each text (node, text) the shingles it can be found by, the size of its set, and their positions."""
    sent = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, words))
    shrink_executors(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = sent.value
        for part in batches:
            sets = [np.unique(shingles_of(t.as_py(), words)) for t in part["text"]]
            first = [_prefix(s, common, counts, similarity) for s in sets]
            n = np.array([len(x) for x in first], np.int64)
            tokens = np.concatenate([np.empty(0, np.uint64), *first]).view(np.int64)
            sizes = np.repeat(np.array([len(x) for x in sets], np.int32), n)
            nodes = np.repeat(part["node"].to_numpy(), n)
            at = np.concatenate([np.empty(0, np.int32), *(np.arange(k, dtype=np.int32) for k in n)])
            yield pa.record_batch([pa.array(x) for x in (tokens, sizes, nodes, at)], names=["token", "size", "node", "at"])
        give_back()

    return texts.select("node", "text").mapInArrow(run, "token long, size int, node long, at int")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows token, size, node, at sorted by the first three: those whose token has another node, each once."""
    held, carried = None, False
    for part in batches:
        c = [x.to_numpy() for x in part.columns]
        c = [np.concatenate(x) for x in zip(held, c, strict=True)] if held else c
        if len(c[0]):
            once = _starts([c[0], c[2]])
            c = [x[once] for x in c]
            met = np.zeros(len(c[0]), bool)
            met[0] = carried
            same = c[0][1:] == c[0][:-1]
            met[1:] |= same
            met[:-1] |= same
            yield pa.record_batch([pa.array(x[:-1][met[:-1]]) for x in c], names=["token", "size", "node", "at"])
            held, carried = [x[-1:] for x in c], bool(met[-1])
    if held and carried:
        yield pa.record_batch([pa.array(x) for x in held], names=["token", "size", "node", "at"])


def _possible(size: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets that share the shingle at these positions, and none before, can have the similarity."""
    least = similarity / (1 + similarity) * (size[i].astype(float) + size[j])
    return np.minimum(size[i] - at[i], size[j] - at[j]) >= least - 1e-6


def _alike(size: np.ndarray, sketches: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these bitmaps can have the similarity: (1 - s) / (1 + s) of the sum of their sizes is the most in which they may differ."""
    most = (1 - similarity) / (1 + similarity) * (size[i].astype(float) + size[j]) + 1e-6
    out = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 13):
        part = slice(k, k + (1 << 13))
        out[part] = np.bitwise_count(sketches[i[part]] ^ sketches[j[part]]).sum(1, dtype=np.int64) <= most[part]
    return out


def _pair_batch(first: list[np.ndarray], second: list[np.ndarray]) -> pa.RecordBatch:
    none = np.empty(0, np.int64)
    a, b = np.concatenate([none, *first]), np.concatenate([none, *second])
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _neighbours(similarity: float):
    """Of rows token, size, node, at, root sorted by the first three: pairs of neighbours of one token that are apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in batches:
            c = [x.to_numpy() for x in part.columns]
            c = [np.concatenate(x) for x in zip(held, c, strict=True)] if held else c
            if len(c[0]):
                token, size, node, at, root = c
                i = np.flatnonzero((token[1:] == token[:-1]) & (root[1:] != root[:-1]))
                i = i[_possible(size, at, i, i + 1, similarity)]
                yield _pair_batch([node[i]], [node[i + 1]])
                held = [x[-1:] for x in c]

    return run


def _all_pairs(similarity: float):
    """Of rows token, i, j, size, node, at, root, block (and bitmap) sorted by the first four: all pairs of a group that are apart and can have the similarity; of two blocks where i < j, else of one."""

    def whole(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(c[0]):
            return
        i, j, size, node, at, root, block = c[1:8]
        groups = np.cumsum(_starts(c[:3]))
        left = np.searchsorted(groups, groups, side="right") - np.arange(len(groups))
        rows, step, first, second, held = np.flatnonzero(left > 1), 1, [], [], 0
        while len(rows):
            rows = rows[size[rows] >= similarity * size[rows + step] - 1e-6]  # sizes ascend: none further on either
            x = rows[(root[rows] != root[rows + step]) & ((i[rows] == j[rows]) | (block[rows] != block[rows + step]))]
            x = x[_possible(size, at, x, x + step, similarity)]
            if len(c) > 8:
                x = x[_alike(size, c[8], x, x + step, similarity)]
            if len(x):
                first.append(node[x])
                second.append(node[x + step])
                held += len(x)
            if held > 100_000:
                yield _pair_batch(first, second)
                first, second, held = [], [], 0
            step += 1
            rows = rows[left[rows] > step]
        yield _pair_batch(first, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in batches:
            c = [x.to_numpy() for x in part.columns[:8]]
            for x in part.columns[8:]:
                c.append(np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(x), -1) if len(x) else np.empty((0, SKETCH // 64), np.uint64))
            held = [np.concatenate(x) for x in zip(held, c, strict=True)] if held else c
            if len(held[0]):
                last = len(held[0]) - int(np.logical_and.reduce([c == c[-1] for c in held[:3]]).sum())
                yield from whole([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held:
            yield from whole(held)

    return run


def meeting(shared: DataFrame, groups: DataFrame, similarity: float, sketches: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None) -> DataFrame:
    """a < b: pairs of nodes that share a token, are not of one group, and can have the similarity: only neighbours, or all of them. sketches: node, sketch of the given nodes."""
    rows = shared.join(groups, "node", "left").select("token", "size", "node", "at", F.coalesce("root", "node").alias("root"))
    if sketches is None:
        return rows.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(_neighbours(similarity), "a long, b long").distinct()
    apart = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    apart = written(apart.select("token", "n"), files=files)
    few = rows.join(apart.where(F.col("n") <= FEW).select("token"), "token").select("token", F.lit(0).alias("i"), F.lit(0).alias("j"), "size", "node", "at", "root", F.lit(0).alias("block"))
    pairs = few.repartition("token").sortWithinPartitions("token", "size").mapInArrow(_all_pairs(similarity), "a long, b long")
    many = apart.where(F.col("n") > FEW).select("token", F.ceil(F.col("n") / F.when(F.col("n") > BUCKET, BUCKET // 2).otherwise(BUCKET)).cast("int").alias("n"))
    if many.isEmpty():
        return pairs.distinct()
    placed = written(rows.join(many, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")))
    dealt = placed.join(sketches(placed.select("node").distinct()), "node").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "size", "node", "at", "root", "block", "sketch")
    return pairs.unionAll(dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "size").mapInArrow(_all_pairs(similarity), "a long, b long")).distinct()


def _selected(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """held joined with the rows of wanted that have its __rid."""
    return held.where(maybe_in(held, "__rid", bitmap_of(wanted, "__rid"))).join(wanted, "__rid")


def _texts(held: DataFrame, first: DataFrame, nodes: DataFrame, text: str, files: int | None = None) -> DataFrame:
    """node, text of the given nodes."""
    wanted = written(first.join(nodes, "node").select("node", F.col("first.rid").alias("__rid")), files=files)
    return _selected(held.select("__rid", F.col(text).alias("text")), wanted)


def _verified(held: DataFrame, first: DataFrame, near: DataFrame, words: int, similarity: float, text: str, files: int | None = None) -> DataFrame:
    """The pairs of near whose sets have the similarity. Sets are made of the texts that are asked for only."""
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_texts(held, first, ends, text, files).select("node", shingle_set(F.col("text"), words).alias("set")))
    of = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"))
    return near.join(of("a"), "a").join(of("b"), "b").where(jaccard(F.col("set_a"), F.col("set_b")) >= similarity).select("a", "b")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of texts that are connected by a similarity of at least ``similarity``."""
    columns = docs.columns
    doc_id, text = (f"c{columns.index(c)}" for c in (doc_id, text))
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))  # no name of the input meets one in use here
    marked = docs.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__prints", fingerprints(F.col(text), words))
    held = written(marked)
    files = files_for(held, *FEW_ROWS)
    ids = held.select("__rid", "__prints.*", F.struct(F.col(doc_id).isNull().alias("no"), F.col(doc_id).alias("id"), F.col("__rid").alias("rid")).alias("order"))
    first = written(ids.groupBy("node").agg(F.min("order").alias("first"), F.min_by(F.struct("print", "second", "size"), "order").alias("x")).select("node", "first", "x.*"), files=files)
    known, tried = None, None

    def connect(near: DataFrame) -> DataFrame:
        """Lets pairs that have the similarity connect their groups: node, root."""
        nonlocal known, tried
        near = written(near.join(tried, ["a", "b"], "left_anti") if tried else near, files=files)
        shrink_executors(docs.sparkSession)
        verified = written(_verified(held, first, near, words, similarity, text, files), files=files)
        tried = tried.unionAll(near) if tried else near
        known = known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(verified) if known else verified
        known = components(known, files=files)
        collect_garbage(docs.sparkSession)
        shrink_executors(docs.sparkSession)
        return known

    groups = connect(scouted(first, files))
    firsts = bitmap_of(first.select(F.col("first.rid").alias("__rid")), "__rid")
    texts = held.where(maybe_in(held, "__rid", firsts)).select(F.col("__prints.node").alias("node"), F.col(text).alias("text"))
    shared = written(prefixes(texts, words, similarity).repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(_met, "token long, size int, node long, at int"), files=files_for(held, *MANY))
    collect_garbage(docs.sparkSession)
    shrink_executors(docs.sparkSession)
    sketches = lambda nodes: written(_texts(held, first, nodes, text, files).select("node", sketch(F.col("text"), words).alias("sketch")))
    for made in (None, sketches):
        groups = connect(meeting(shared, groups, similarity, made, files))
    grouped = first.join(groups, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    stays = grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("__rid"))
    goes = written(ids.select("__rid").join(stays, "__rid", "left_anti"), files=files)
    tested = held.withColumn("__suspect", maybe_in(held, "__rid", bitmap_of(goes, "__rid")))
    kept = tested.where("NOT __suspect").unionByName(tested.where("__suspect").join(goes, "__rid", "left_anti").select(*tested.columns))
    return kept.select(*docs.columns).toDF(*columns)
