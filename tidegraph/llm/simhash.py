"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit in the XXH64 hashes of a text's shingles. For a radius r, bit positions are
given vectors of r + 1 bits; for every non-zero vector v, a mask keeps the positions whose vector has an odd product with
v. The vectors of r differing positions span at most r dimensions, so some v is orthogonal to all of them, and its mask
hides every difference: each pair within the radius meets in some of the 2**(r+1) - 1 tables.

Only distinct fingerprints go into the tables. The rows of a table are sorted by masked fingerprint and compared within
their bucket as they stream by, up to ``BUCKET`` of them; a task passes on no pairs but a forest that connects what it has
linked. A larger bucket is resolved without pairs: with r = 3, two fingerprints are within the radius exactly if some
point is within 2 bits of the one and 1 of the other, so each member is dealt to the points near it and linked to the
smallest member there, if any member is within 1 bit. That is linear in the bucket, and exact.

Null and empty texts have no words: their fingerprint is zero, linked like any other. Texts of fewer words than a shingle
are one shingle. Texts of any length are taken whole, in bounded memory. Rows that repeat share a fingerprint and a
component; a null id is left out of the smallest ids. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import LOWER, text_bytes, written
from tidegraph.llm.graph import components

SEED = 42
BITS = 64
BUCKET = 4096


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of so many words, lower-cased and joined by a space, in order and with repeats."""
    parts = text_bytes(text).translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    first = ends[words - 1 :].tolist() or [len(joined)]
    starts = [0, *(ends[: len(first) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, first, strict=True)), np.uint64, len(first))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit integer whose bits are set in over half the hashes; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint_of(shingle_hashes(t.as_py(), words)) for t in texts], pa.int64())

    return run(text)


@lru_cache
def position_vectors(n: int, radius: int) -> list[int]:
    """Non-zero vectors of radius + 1 bits for n positions, such that no mask keeps few positions: all of them in turn where there are enough
    positions, else the best of a fixed number of seeded choices."""
    some = (1 << radius + 1) - 1
    if n >= some:
        return [i % some + 1 for i in range(n)]
    rng = np.random.default_rng(radius)
    parity = np.bitwise_count(np.arange(1, some + 1)[:, None] & np.arange(1, some + 1)[None, :]) & 1
    tried = [rng.choice(some, n, replace=False) for _ in range(3000)]
    if n <= 1 << radius:
        tried.append(2 * np.arange(n))  # the odd vectors: a first-order Reed-Muller code
    return (max(tried, key=lambda v: parity[:, v].sum(1).min()) + 1).tolist()


def covering_masks(radius: int, positions: range = range(BITS)) -> list[int]:
    """Masks (signed 64-bit) such that any two fingerprints that differ at no more than ``radius`` of the positions agree under one."""
    n = (1 << radius + 1) - 1
    vectors = dict(zip(positions, position_vectors(len(positions), radius), strict=True))
    masks = [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def contracted(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels, in which a node's label is the smallest node of its component, after the links a-b."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def linked_within(group: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Label of each row: the first row it is connected to by steps of at most radius bits between rows of a group. Groups are contiguous."""
    n = len(group)
    labels = np.arange(n)
    size_left = np.searchsorted(group, group, side="right") - np.arange(n)
    rows, step = np.flatnonzero(size_left > 1), 1
    while len(rows):
        near = rows[np.bitwise_count((prints[rows] ^ prints[rows + step]).view(np.uint64)) <= radius]  # of signed numbers it would take the absolute value
        if len(near):
            labels = contracted(labels, near, near + step)
        step += 1
        rows = rows[size_left[rows] > step]
    return labels


def _bucket_links(radius: int):
    """Of rows table, key, print sorted by table and key: links (a, b), and the members (a) of buckets beyond BUCKET with their table."""

    def links(t: np.ndarray, key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[False], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]) if len(t) else np.zeros(0, bool)
        labels = linked_within(np.cumsum(new), prints, radius)
        moved = np.flatnonzero(labels != np.arange(len(t)))
        return _batch(prints[moved], prints[labels[moved]], np.full(len(moved), -1, np.int32))

    def _batch(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32())], names=["a", "b", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        large = None  # the bucket that has gone beyond BUCKET
        for batch in batches:
            t, key, prints = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            if large is not None:
                k = int(((t == large[0]) & (key == large[1])).sum())
                yield _batch(prints[:k], prints[:k], t[:k])
                t, key, prints = t[k:], key[k:], prints[k:]
                large = large if not len(t) else None
            if len(t):
                last = len(t) - int(((t == t[-1]) & (key == key[-1])).sum())
                yield from _whole(t[:last], key[:last], prints[:last])
                t, key, prints = t[last:], key[last:], prints[last:]
                if len(t) > BUCKET:
                    large = (t[0], key[0])
                    yield _batch(prints, prints, t)
                    t, key, prints = t[:0], key[:0], prints[:0]
            held = [t, key, prints]
        yield from _whole(*held)

    def _whole(t: np.ndarray, key: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(t):
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(t)]]))
            beyond = np.repeat(sizes > BUCKET, sizes)
            if beyond.any():
                yield _batch(prints[beyond], prints[beyond], t[beyond])
            yield links(t[~beyond], key[~beyond], prints[~beyond])

    return run


def _near_points(masks: list[int]):
    """Of rows print, table of large buckets: the points within 2 bits that the mask hides, and whether they are within 1."""
    free = [[np.int64(x) for p in range(BITS) if not (x := (1 << p) - (1 << 64) * (p == 63)) & m] for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                prints, tables = (c.to_numpy() for c in batch.slice(i, 512).columns)
                for t in np.unique(tables).tolist():
                    p = prints[tables == t]
                    flips = np.array([np.int64(0), *free[t], *(x ^ y for x, y in combinations(free[t], 2))], np.int64)
                    near = np.arange(len(flips)) <= len(free[t])
                    n = len(p) * len(flips)
                    yield pa.record_batch([pa.array(np.full(n, t, np.int32)), pa.array((p[:, None] ^ flips[None, :]).ravel()), pa.array(np.repeat(p, len(flips))), pa.array(np.tile(near, len(p)))], names=["t", "point", "print", "near"])

    return run


def link_prints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links a, b that connect whatever distinct fingerprints (column print) are connected by steps within the radius (3 at most)."""
    if radius > 3:
        raise ValueError("large buckets are resolved for a radius of 3 at most")
    masks = covering_masks(radius)
    rows = prints.select("print", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))).alias("x"))
    sorted_rows = rows.select("x.t", "x.key", "print").repartition("t", "key").sortWithinPartitions("t", "key")
    found = written(sorted_rows.mapInArrow(_bucket_links(radius), "a long, b long, large int"))
    links = found.where("large < 0").select("a", "b")
    large = found.where("large >= 0").select(F.col("a").alias("print"), F.col("large").alias("t"))
    if large.isEmpty():
        return links
    points = large.repartition("print", "t").mapInArrow(_near_points(masks), "t int, point long, print long, near boolean")
    centre = points.groupBy("t", "point").agg(F.min("print").alias("b"), F.max("near").alias("near"), F.count("*").alias("n")).where("near AND n > 1").drop("near", "n")
    star = points.join(centre, ["t", "point"]).select(F.col("print").alias("a"), "b").where("a <> b").distinct()
    return links.unionAll(star)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print (long), component_id of each row of docs: the smallest id reachable by links within the radius."""
    marked = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("print")))
    prints = marked.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = components(link_prints(prints.select("print"), radius)).withColumnRenamed("node", "print")
    rooted = prints.join(roots, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    rooted = written(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")
