"""Benchmark decontamination by a generalised suffix automaton.

Words of the benchmark items are numbered, and the items go into one suffix automaton over these numbers. A text is
streamed through it: after each word the automaton holds the longest suffix of the text that occurs in some item. Where
that is a window long, the last ``window`` words are hit; the state of that window's class knows the items it occurs in.
Items shorter than a window are windows of their own, marked at their states.

The benchmark is taken in blocks of at most ``block_words`` words, each an automaton that is broadcast by itself; spans and
items of the blocks are united. Workers hold the automata of all blocks: memory grows with the benchmark, never with the documents.

Null and empty texts have no words and no hits; null or wordless items have no windows, and an item whose id is null
hits words but is not listed; ids of any type are listed as text. Items that occur twice in the benchmark count once. Texts of any length are taken whole,
in memory O(words). Columns of the input keep their names and values: results are single columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import LOWER_ALNUM, text_bytes

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"
_HITS = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


class ItemAutomaton:
    """items: (id, text) of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        read = [(i, [self.number.setdefault(w, len(self.number) + 1) for w in text_bytes(t).translate(LOWER_ALNUM).split()]) for i, t in items]
        read = [(i, ws) for i, ws in read if ws]
        for _, ws in read:
            last = 0
            for w in ws:
                last = self._add(last, w)
        self.occurs: dict[int, list[str]] = {}  # items of the states of whole windows, which are the only ones asked for
        self.short: dict[int, list[tuple[int, str | None]]] = {}  # state: (words, item) of the short items that end it
        seen = [-1] * len(self.next)
        for k, (item, ws) in enumerate(read):
            state = 0
            for w in ws:
                state = at = self.next[state][w]
                while at > 0 and self.length[at] >= window and seen[at] != k:
                    seen[at] = k
                    if item is not None and self.length[self.link[at]] < window:
                        self.occurs.setdefault(at, []).append(item)
                    at = self.link[at]
            if len(ws) < window:
                self.short.setdefault(state, []).append((len(ws), item))
        self.least = min((min(len(ws), window) for _, ws in read), default=window)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):  # links are shorter: they come first
            if state and (above := self.short.get(self.link[state])):
                self.short.setdefault(state, []).extend(above)

    def _add(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], list[str]]:
        """Starts and ends of the united spans of words that windows hit, and the items of these windows."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
        starts: list[int] = []
        ends: list[int] = []
        items: set[str | None] = set()
        long_enough = np.flatnonzero(edges[1::2] - edges[::2] >= self.least)
        for k in long_enough.tolist():  # runs of words that some item has
            a, b = int(edges[2 * k]), int(edges[2 * k + 1])
            state = matched = 0
            for p, w in enumerate(ids[a:b].tolist(), a + 1):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                state = self.next[state].get(w, 0)
                matched = matched + 1 if state else 0
                start = p
                if matched >= self.window:
                    start, u = p - self.window, state
                    while self.length[self.link[u]] >= self.window:
                        u = self.link[u]
                    items.update(self.occurs.get(u, ()))
                if self.short:
                    for n, item in self.short.get(state, ()):
                        if matched >= n:
                            start = min(start, p - n)
                            items.add(item)
                if start < p:
                    while starts and starts[-1] >= start:
                        starts.pop()
                        ends.pop()
                    if starts and ends[-1] >= start:
                        ends[-1] = p
                    else:
                        starts.append(start)
                        ends.append(p)
        return starts, ends, sorted(x for x in items if x is not None)


def item_blocks(benchmark: DataFrame, window: int, block_words: int = 200_000, item_id: str = "item_id", text: str = "text") -> Iterator[ItemAutomaton]:
    """Automata of blocks of items, each of block_words words at most unless a single item has more."""
    rows = benchmark.select(F.col(item_id).cast("string"), text).distinct().toLocalIterator()
    block: list[tuple[str | None, str | None]] = []
    n = 0
    for item, t in rows:
        size = len(text_bytes(t).translate(LOWER_ALNUM).split())
        if block and n + size > block_words:
            yield ItemAutomaton(block, window)
            block, n = [], 0
        block.append((item, t))
        n += size
    if block:
        yield ItemAutomaton(block, window)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, name: str = "hits", text: str = "text", block_words: int = 200_000) -> DataFrame:
    """docs and a column ``name``: struct HITS of each text, with the spans of words (start, end) that occur in items."""
    spark = docs.sparkSession
    parts = []
    for i, block in enumerate(item_blocks(benchmark, window, block_words)):
        docs = docs.withColumn(f"{name}__{i}", _hit_column(F.col(text), spark.sparkContext.broadcast(block)))
        parts.append(f"{name}__{i}")
    if not parts:
        docs, parts = docs.withColumn(f"{name}__0", _hit_column(F.col(text), spark.sparkContext.broadcast(ItemAutomaton([], window)))), [f"{name}__0"]
    if len(parts) == 1:
        return docs.withColumnRenamed(parts[0], name)
    return docs.withColumn(name, _united(F.array(*parts))).drop(*parts)


def _hit_column(text: Column, block) -> Column:
    @F.arrow_udf(HITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = block.value
        for texts in batches:
            rows = []
            for t in texts:
                words = text_bytes(t.as_py()).translate(LOWER_ALNUM).split()
                rows.append((len(words), *automaton.hits(words)))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_HITS)], fields=list(_HITS))

    return run(text)


def _united(blocks: Column) -> Column:
    @F.arrow_udf(HITS)
    def run(found: pa.Array) -> pa.Array:
        rows = []
        for blocks_of in found.to_pylist():
            starts: list[int] = []
            ends: list[int] = []
            for a, b in sorted(s for x in blocks_of for s in zip(x["starts"], x["ends"], strict=True)):
                if ends and ends[-1] >= a:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a)
                    ends.append(b)
            rows.append((blocks_of[0]["n_words"], starts, ends, sorted({i for x in blocks_of for i in x["items"]})))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_HITS)], fields=list(_HITS))

    return run(blocks)


def hit_words(hits: Column) -> Column:
    """Number of words in the spans of a struct HITS."""
    return F.aggregate(F.zip_with(hits["starts"], hits["ends"], lambda a, b: b - a), F.lit(0).cast("long"), lambda s, n: s + n)


def cut_spans(text: str, starts: list[int], ends: list[int], min_span: int) -> str:
    """The text without the spans of min_span words or more; a line break stands where one was."""
    data = text_bytes(text)
    spans = [(a, b) for a, b in zip(starts, ends, strict=True) if b - a >= min_span]
    if not spans:
        return text
    out, at = [], 0
    places = enumerate(m.span() for m in WORD.finditer(data))
    k, (s, e) = -1, (0, 0)
    for a, b in spans:
        while k < a:
            k, (s, e) = next(places)
        out.append(data[at:s])
        for k, (s, e) in islice(places, b - 1 - a):  # noqa: B007
            pass
        at = e
    return b"\n".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_span: int = 1, max_coverage: float = 0.5, text: str = "text", block_words: int = 200_000) -> DataFrame:
    """docs without those whose hit words are over max_coverage of all, and without the spans of min_span hit words or
    more in the others' texts. What meets where a span was cut is looked at again, until nothing is left to cut."""
    spark = docs.sparkSession
    columns = docs.columns
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark, window, block_words)]

    @F.arrow_udf("text string, kept boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [_clean(t.as_py(), [b.value for b in blocks], min_span, max_coverage) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["text", "kept"])

    mark = "__clean"
    while mark in columns:
        mark += "_"
    return docs.withColumn(mark, clean(F.col(text))).where(F.col(f"{mark}.kept")).withColumn(text, F.col(f"{mark}.text")).select(*columns)


def _clean(text: str | None, blocks: list[ItemAutomaton], min_span: int, max_coverage: float) -> tuple[str | None, bool]:
    total = hit = 0
    while True:
        changed = False
        for automaton in blocks:
            words = text_bytes(text).translate(LOWER_ALNUM).split()
            total = total or len(words)
            starts, ends, _ = automaton.hits(words)
            hit += sum(b - a for a, b in zip(starts, ends, strict=True) if b - a >= min_span)
            if hit > max_coverage * total:
                return text, False
            after = cut_spans(text, starts, ends, min_span) if starts else text
            changed |= after is not text and after != text
            text = after
        if not changed:
            return text, True
