"""Language-model scoring with a hierarchical Pitman-Yor model.

Each word is a customer of the restaurant of its context, the word before; a text's first word has a context of its own. A
word that makes up ``SHARE`` of the training tokens at least has a restaurant, whose parent is the restaurant of its last two
bytes; after other words customers come to the restaurant of the ending directly. Endings share one root. A table of a
restaurant is a customer of its parent. The root's base is a letter model, itself hierarchical Pitman-Yor: contexts of four
bytes share parents of three, of two, of one and of none, over a uniform distribution of the 256 bytes and an end; a text's
end is the word without letters. So the model is a proper distribution over texts, and unseen words are spelled.

Seating is sampled by Gibbs sweeps, block by block: the tables of all customers of a dish in a restaurant are drawn anew from
their conditional distribution, given the parent's probability of the dish and the restaurant's other tables: t tables in
proportion to S(c, t) * pull ** t, with generalised Stirling numbers S and pull = (strength + discount * tables) * parent's
probability. That is exact up to EXACT customers; those beyond sit down in order by the sequential rule, a sixteenth of the
seated at a time. A dish's restaurants are in one task; the totals of restaurants over all dishes are those of the sweep
before, as is usual for samplers that are spread out. Predictive probabilities are averaged over the last ``samples`` sweeps.

How it is spread: a task reads its texts into blocks (a dictionary, and the words as numbers of it) and asks for the
dictionary's words, dealt by their hash; a group has all that is asked about its words, whatever their number of rows in
the corpus, so it seats them by itself. What goes over the network are packed arrays, a few bytes for each word or
pair of context and word that a block has. Only the totals of restaurants (CONTEXTS at most) and the letter
table reach the driver: contexts and letters that make up LETTER_SHARE of all letters of the vocabulary at least, so 1 / LETTER_SHARE an
order at most; the rest are customers of the shorter context. Both shares mean the same at every size. Which words reach the share is
exact: blocks tell the words that reach an eighth of it there, and those whose sum leaves room for doubt (8 / 7 / SHARE at most) are counted
in all blocks. Answers go back to the blocks, which score their texts.

Null text is empty and has one token, the end. Texts of any length are taken whole. An empty table gives an empty result;
without training texts every word is spelled by the uniform distribution. Rows that repeat are scored alike, and count as
often as they occur. Ids may have any type that can be cast to a string and back. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import LOWER, drop_written, text_bytes, written

BLOCK = 2_000_000  # tokens
GROUP = 250_000  # words of blocks' dictionaries in a group, about
SHARE = 1e-4  # of the training tokens, for a word to have a restaurant
ENDINGS = 65_537  # 0: before the first word
CONTEXTS = ENDINGS + int(1 / SHARE) + 1
LETTER_SHARE = 5e-7
ORDER = 4
END = 256
EXACT = 64
AFTER = (0.8, 20.0)  # discount and strength of the restaurants of words
ENDING = (0.8, 50.0)
ROOT = (0.6, 50.0)
SPELL = (0.5, 1.0)
FOLDS, HELD_OUT = 7, 2

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.string())), ("sizes", pa.binary()), ("held_out", pa.binary()), ("ids", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64()), ("n_train", pa.int64())])
_ASKED = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("word", pa.binary()), ("context", pa.binary()), ("count", pa.binary())])
#: tables: of each kept sample those of words, endings and the root. used: of each context its customers and tables in this group.
_STATE = pa.schema([("r", pa.int32()), ("words", pa.binary()), ("count", pa.binary()), ("after", pa.list_(pa.binary())), ("ending", pa.list_(pa.binary())), ("spelled", pa.binary()), ("tables", pa.list_(pa.binary())), ("used", pa.list_(pa.struct([("context", pa.int32()), ("customers", pa.int64()), ("tables", pa.int64())]))), ("root_customers", pa.int64()), ("root_tables", pa.int64())])
_MERGED = pa.schema([*_STATE, ("block", pa.int64()), ("ids", pa.binary()), ("word", pa.binary()), ("context", pa.binary()), ("n_tokens", pa.int64()), ("n_types", pa.int64())])
_REPLY = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("count", pa.binary()), ("log10", pa.binary())])
_SCORE = pa.schema([("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    names = {"list<item: string>": "array<string>", "list<item: binary>": "array<binary>", "list<item: struct<context: int32, customers: int64, tables: int64>>": "array<struct<context:int,customers:long,tables:long>>", "int64": "long", "int32": "int", "bool": "boolean"}
    return ", ".join(f"{f.name} {names.get(str(f.type), str(f.type))}" for f in schema)


def _pack(array: np.ndarray) -> bytes:
    """A compressed array; its bytes are dealt by significance, which compresses better."""
    return zstandard.compress(array.dtype.char.encode() + np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    kind = np.dtype(raw[:1].decode())
    return np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(words), 1)  # a word has no line break


def _unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b"\n")


def _row(schema: pa.Schema, **values: object) -> pa.RecordBatch:
    return pa.record_batch([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def held_out(doc_id: str | None) -> bool:
    return crc32(("null" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number: dict[bytes, int] = {b"": 0}
    docs: list[str | None] = []
    parts: list[np.ndarray] = []
    made, tokens = 0, 0

    def block() -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts], np.uint32)
        held = np.array([held_out(d) for d in docs], np.uint8)
        return _row(
            _BLOCK, block=(TaskContext.get().partitionId() << 24) + made, doc_ids=docs, sizes=_pack(sizes), held_out=_pack(held), ids=_pack(np.concatenate(parts)),
            words=_pack_words(list(number)), n_words=len(number), n_train=int(sizes[held == 0].sum()),
        )

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            words = text_bytes(text.as_py()).translate(LOWER).split()
            ids = np.zeros(len(words) + 1, np.uint32)  # the end is word 0
            ids[:-1] = [number.setdefault(w, len(number)) for w in words]
            docs.append(doc_id)
            parts.append(ids)
            tokens += len(ids)
            if tokens >= BLOCK:
                yield block()
                number, docs, parts, made, tokens = {b"": 0}, [], [], made + 1, 0
    if docs:
        yield block()


def _train_counts(row: dict) -> tuple[list[bytes], np.ndarray]:
    """The words of a block, and how often they occur in its training texts."""
    words, held, sizes = _unpack_words(row["words"]), _unpack(row["held_out"]).astype(bool), _unpack(row["sizes"])
    n = np.bincount(_unpack(row["ids"]).astype(np.int64), weights=np.repeat(~held, sizes), minlength=len(words)).astype(np.int64)
    n[0] = 0  # nothing follows the end
    return words, n


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that reach an eighth of SHARE in the training texts of a block, how often they occur, and how many training tokens the block has."""
    for batch in batches:
        for row in batch.to_pylist():
            words, n = _train_counts(row)
            some = np.flatnonzero((n > 0) & (n >= SHARE / 8 * row["n_train"])).tolist()
            yield pa.record_batch([pa.array([words[i] for i in some], pa.binary()), pa.array(n[some], pa.int64()), pa.array([row["n_train"]] * len(some), pa.int64())], names=["word", "n", "seen"])


def _counter(asked):
    """asked: broadcast, words that are counted in all blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, n = _train_counts(row)
                some = [i for i, w in enumerate(words) if w in asked.value and n[i]]
                yield pa.record_batch([pa.array([words[i] for i in some], pa.binary()), pa.array(n[some], pa.int64())], names=["word", "n"])

    return count


def frequent_words(blocks: DataFrame, n_train: int) -> list[bytes]:
    """The words that make up SHARE of the n_train training tokens at least, in order: 1 / SHARE of them at most."""
    rows = blocks.select("ids", "words", "sizes", "held_out", "n_train")
    told = rows.mapInArrow(_often, "word binary, n long, seen long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    least, unseen = SHARE * n_train, F.lit(n_train) - F.col("seen")
    # In a block that doesn't tell a word, it makes up less than an eighth of SHARE. So where the sum may reach SHARE, 7 / 8 of it have been told.
    found = told.where(F.col("n") + SHARE / 8 * unseen >= least).select("word", "n", "seen").collect()
    names = [bytes(r["word"]) for r in found if r["n"] >= least]
    doubtful = {bytes(r["word"]) for r in found if r["n"] < least}
    if doubtful:
        exact = rows.mapInArrow(_counter(blocks.sparkSession.sparkContext.broadcast(doubtful)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        names += [bytes(r["word"]) for r in exact.where(F.col("n") >= least).collect()]
    return sorted(names)


def ending(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big") + 1


def _pairs(row: dict, often: dict[bytes, int]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: words, sizes of texts, held-out flags, words as numbers, distinct pairs (context * words + word), pair of each token."""
    words, sizes, held, ids = _unpack_words(row["words"]), _unpack(row["sizes"]).astype(np.int64), _unpack(row["held_out"]).astype(bool), _unpack(row["ids"]).astype(np.int64)
    contexts = np.fromiter((ENDINGS + often[w] if w in often else ending(w) for w in words), np.int64, len(words))
    context = np.empty(len(ids), np.int64)
    context[1:] = contexts[ids[:-1]]
    context[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = 0
    pairs, inverse = np.unique(context * len(words) + ids, return_inverse=True)
    return words, sizes, held, ids, pairs, inverse


@dataclass
class Deal:
    """How a block's words and pairs are dealt to groups: the groups, and for each the words and pairs (in the order of words and contexts) that are its own."""

    groups: list[int]
    words: list[np.ndarray]
    pairs: list[np.ndarray]


def _deal(words: list[bytes], pairs: np.ndarray, groups: int) -> Deal:
    group = np.fromiter((crc32(w) % groups for w in words), np.int64, len(words))
    word, context = pairs % len(words), pairs // len(words)
    present = np.unique(group)
    split = lambda order, of: np.split(order, np.searchsorted(of[order], present[1:]))
    return Deal(present.tolist(), split(np.argsort(group, kind="stable"), group), split(np.lexsort((context, word, group[word])), group[word]))


def _steps(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words and, within each, sorted contexts, as differences."""
    first = np.concatenate([[True], word[1:] != word[:-1]])
    return np.diff(word, prepend=0).astype(np.uint32), np.where(first, context, np.diff(context, prepend=0)).astype(np.uint32)


def _unstepped(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.cumsum(word.astype(np.int64))
    first = np.concatenate([[True], words[1:] != words[:-1]])
    total = np.cumsum(context.astype(np.int64))
    before = (total - context)[first]
    return words, total - before[np.cumsum(first) - 1]


def _asker(groups: int, often):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, sizes, held, _, pairs, inverse = _pairs(row, often.value)
                count = np.bincount(inverse, weights=np.repeat(~held, sizes), minlength=len(pairs)).astype(np.uint32)
                deal = _deal(words, pairs, groups)
                place = np.empty(len(words), np.int64)  # of a word among those of its group
                for r, own, p in zip(deal.groups, deal.words, deal.pairs, strict=True):
                    place[own] = np.arange(len(own))
                    word, context = _steps(place[pairs[p] % len(words)], pairs[p] // len(words))
                    yield _row(_ASKED, r=r, block=row["block"], words=_pack_words([words[i] for i in own.tolist()]), word=_pack(word), context=_pack(context), count=_pack(count[p]))

    return ask


def _used(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[dict]:
    """Customers and tables by context, of (contexts, customers, tables)."""
    out = []
    for context, customers, tables in parts:
        c, t = (np.bincount(context, weights=x, minlength=1).astype(np.int64) for x in (customers, tables))
        out += [{"context": int(i), "customers": int(c[i]), "tables": int(t[i])} for i in np.flatnonzero(t)]
    return out


def _merger(parents):
    """parents: broadcast, the ending of each frequent word."""

    def merge(table: pa.Table) -> pa.Table:
        """What all blocks ask of a group's words: a state (block null) with a table a dish, and, for each block, numbers of its words and its pairs."""
        rows = sorted(table.to_pylist(), key=lambda x: x["block"])
        lists = [_unpack_words(row["words"]) for row in rows]
        number = {w: i for i, w in enumerate(sorted(set().union(*lists)))}
        all_ids, codes, count = [], [], []
        for row, words in zip(rows, lists, strict=True):
            ids = np.array([number[w] for w in words], np.int64)
            word, context = _unstepped(_unpack(row["word"]), _unpack(row["context"]))
            all_ids.append(ids)
            n = _unpack(row["count"]).astype(np.int64)
            codes.append((ids[word] * CONTEXTS + context)[n > 0])
            count.append(n[n > 0])
        code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        customers = np.bincount(inverse, weights=np.concatenate(count), minlength=len(code)).astype(np.int64)
        word, context = code // CONTEXTS, code % CONTEXTS
        total = np.bincount(word, weights=customers, minlength=len(number)).astype(np.int64)
        after = context >= ENDINGS
        # Endings have customers of their own and the tables of the words that end so.
        above = np.concatenate([code[~after], word[after] * CONTEXTS + parents.value[context[after] - ENDINGS]])
        mid, at = np.unique(above, return_inverse=True)
        direct = np.bincount(at[: (~after).sum()], weights=customers[~after], minlength=len(mid)).astype(np.int64)
        pack = lambda w, c, n: [_pack(x.astype(np.uint32)) for x in (*_steps(w, c), n)] if len(w) else [_pack(np.empty(0, np.uint32))] * 3
        state = {"after": pack(word[after], context[after], customers[after]), "ending": pack(mid // CONTEXTS, mid % CONTEXTS, direct)}
        ones = [np.ones(after.sum(), np.uint32), np.ones(len(mid), np.uint32), (total > 0).astype(np.uint32)]
        group = Group(state | {"count": _pack(total), "tables": [_pack(x) for x in ones]}, parents.value)
        out = [_row(_MERGED, r=rows[0]["r"], words=_pack_words(list(number)), count=_pack(total), **state, tables=[_pack(x) for x in ones], used=group.used(ones), root_customers=len(mid), root_tables=int(ones[2].sum()), n_tokens=int(total.sum()), n_types=int(ones[2].sum()))]
        for row, ids in zip(rows, all_ids, strict=True):
            out.append(_row(_MERGED, r=row["r"], block=row["block"], ids=_pack(ids.astype(np.uint32)), word=row["word"], context=row["context"], n_tokens=0, n_types=0))
        return pa.Table.from_batches(out)

    return merge


class Group:
    """The dishes of a group in all restaurants: entries (word, context, customers) of words' and of endings' restaurants."""

    def __init__(self, row: dict, parents: np.ndarray) -> None:
        entries = []
        for name in ("after", "ending"):
            word, context, customers = map(_unpack, row[name])
            entries.append((*_unstepped(word, context), customers.astype(np.int64)) if len(word) else (np.empty(0, np.int64),) * 3)
        (self.a_word, self.a_context, self.a_customers), (self.e_word, self.e_context, self.direct) = entries
        self.a_code, self.e_code = self.a_word * CONTEXTS + self.a_context, self.e_word * CONTEXTS + self.e_context
        self.up = np.searchsorted(self.e_code, self.a_word * CONTEXTS + parents[self.a_context - ENDINGS])
        self.total = _unpack(row["count"]).astype(np.int64)
        self.samples = [[_unpack(t).astype(np.int64) for t in row["tables"][i : i + 3]] for i in range(0, len(row["tables"]), 3)]

    def e_customers(self, a_tables: np.ndarray) -> np.ndarray:
        return self.direct + np.bincount(self.up, weights=a_tables, minlength=len(self.direct)).astype(np.int64)

    def root_customers(self, e_tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.e_word, weights=e_tables, minlength=len(self.total)).astype(np.int64)

    def used(self, tables: list[np.ndarray]) -> list[dict]:
        return _used([(self.a_context, self.a_customers, tables[0]), (self.e_context, self.e_customers(tables[0]), tables[1])])

    def root(self, tables: list[np.ndarray], totals: tuple, spelled: np.ndarray) -> np.ndarray:
        """Of each word, the root's probability."""
        d, s = ROOT
        return (self.root_customers(tables[1]) - d * tables[2] + (s + d * totals[3]) * spelled) / (s + totals[2])


@lru_cache
def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t), up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * t, 1e-300)))
    return out


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with so many customers. pull: (strength + discount * all tables) * probability of the dish in the parent."""
    tables = np.minimum(customers, 1).astype(np.int64)
    table = log_stirling(discount)
    first = np.minimum(customers, EXACT)
    by = np.argsort(first, kind="stable")
    edges = np.searchsorted(first[by], np.arange(2, EXACT + 2))
    log_pull = np.log(np.maximum(pull, 1e-300))
    for c in range(2, EXACT + 1):
        for i in range(edges[c - 2], edges[c - 1], (1 << 20) // c):
            rows = by[i : min(i + (1 << 20) // c, edges[c - 1])]
            log_p = table[c, 1 : c + 1] + log_pull[rows, None] * np.arange(1, c + 1)
            p = np.cumsum(np.exp(log_p - log_p.max(1, keepdims=True)), axis=1)
            tables[rows] = 1 + (p < rng.random(len(rows))[:, None] * p[:, -1:]).sum(1)
    rows, seated = np.flatnonzero(customers > EXACT), EXACT
    while len(rows):
        more = np.minimum(customers[rows] - seated, seated // 16)
        tables[rows] += rng.binomial(more, pull[rows] / (pull[rows] + seated - discount * tables[rows]))
        seated += seated // 16
        rows = rows[customers[rows] > seated]
    return tables


class Letters:
    """The letter model: of each order, sorted codes of (context, letter), what customers less discounts give each, and what goes to the shorter context."""

    def __init__(self, direct: list[tuple[np.ndarray, np.ndarray]], order: int, sweeps: int = 6, seed: int = 42) -> None:
        """direct: codes and counts of the customers that come to each order themselves, the longest first."""
        discount, strength = SPELL
        rng = np.random.default_rng(seed)
        self.order = order
        n = order + 1
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        direct = [*direct, *[none] * (n - len(direct))]
        codes, up, own = [np.unique(direct[0][0])], [], []
        for i in range(1, n):  # the code of a shorter context is the same without its highest letter
            above = codes[-1] % 512 ** (n - i)
            codes.append(np.unique(np.concatenate([above, direct[i][0]])))
            up.append(np.searchsorted(codes[-1], above))
        for i in range(n):
            own.append(np.bincount(np.searchsorted(codes[i], direct[i][0]), weights=direct[i][1], minlength=len(codes[i])).astype(np.int64))
        level = [(c, u) for c, u in zip(codes, [*up, None], strict=True)]
        contexts = [np.unique(c // 512, return_inverse=True) for c, _ in level]
        tables = [np.ones(len(c), np.int64) for c, _ in level]
        mean = [np.zeros(len(c)) for c, _ in level]

        def customers(i: int) -> np.ndarray:
            return own[i] if i == 0 else own[i] + np.bincount(level[i - 1][1], weights=tables[i - 1], minlength=len(level[i][0])).astype(np.int64)

        def parts(i: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c, own = customers(i), contexts[i][1]
            total, all_tables = np.bincount(own, weights=c), np.bincount(own, weights=t)
            return (c - discount * t) / (strength + total)[own], (strength + discount * all_tables) / (strength + total)

        for sweep in range(sweeps):
            p = np.full(1, 1 / 257)
            for i in range(n - 1, -1, -1):
                above = np.full(len(level[i][0]), 1 / 257) if i == n - 1 else p[level[i][1]]
                pull = np.bincount(contexts[i][1], weights=tables[i])[contexts[i][1]]
                tables[i] = seat(customers(i), (strength + discount * pull) * above, discount, rng)
                gain, rest = parts(i, tables[i])
                p = gain + rest[contexts[i][1]] * above
            for i in range(n):
                mean[i] += tables[i] * (sweep >= sweeps // 2) / (sweeps - sweeps // 2)
        self.levels = []
        for i in range(n):  # the average number of tables gives the average discount
            tables[i] = mean[i]
        for i in range(n):
            gain, rest = parts(i, tables[i])
            self.levels.append((level[i][0], gain, contexts[i][0], rest))

    def probability(self, words: list[bytes]) -> np.ndarray:
        """Of spelling each word to its end."""
        codes, starts = letter_codes(words, self.order)
        p = np.full(len(codes), 1 / 257)
        for k, (known, gain, contexts, rest) in enumerate(reversed(self.levels)):
            code = codes % (512 ** (k + 1))
            p = p * _found(contexts, rest, code // 512, 1.0) + _found(known, gain, code, 0.0)
        return np.add.reduceat(np.log(p), starts) if len(words) else np.empty(0)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), otherwise)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], otherwise)


def letter_codes(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every letter and end of the words: base-512 digits, the letter last, before it up to ``order`` letters before (257: before the word). And where words start."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    # Each word stands behind so many marks of a beginning.
    total = int(lengths.sum()) + order * len(words)
    text = np.full(total, 257, np.int64)
    places = np.arange(int(lengths.sum())) + np.repeat((np.arange(len(words)) + 1) * order, lengths)
    letters = np.full(int(lengths.sum()), END, np.int64)
    inner = np.ones(len(letters), bool)
    inner[starts + lengths - 1] = False
    letters[inner] = np.frombuffer(b"".join(words), np.uint8)
    text[places] = letters
    code = text[places].copy()
    for k in range(1, order + 1):
        code += text[places - k] * 512**k
    return code, starts


def _letter_counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for words, total in zip(batch["words"].to_pylist(), batch["count"].to_pylist(), strict=True):
                seen = _unpack(total) > 0
                codes, _ = letter_codes([w for w, s in zip(_unpack_words(words), seen.tolist(), strict=True) if s], order)
                more, n = np.unique(codes, return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, more]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        for i in range(0, len(keys), 1 << 16):
            yield pa.record_batch([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["code", "n"])

    return count


def _letters(states: DataFrame) -> Letters:
    """Every distinct training word is spelled once."""
    level = written(states.mapInArrow(_letter_counter(ORDER), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    least = LETTER_SHARE * (level.agg(F.sum("n")).first()[0] or 0)
    direct = []
    for k in range(ORDER, -1, -1):
        found = (level.where(F.col("n") >= least) if k else level).toArrow()  # 1 / LETTER_SHARE rows at most; 257 without context
        order = np.argsort(found["code"].to_numpy())
        direct.append((found["code"].to_numpy()[order], found["n"].to_numpy()[order]))
        level = level.where(F.col("n") < least).groupBy((F.col("code") % 512**k).alias("code")).agg(F.sum("n").alias("n")) if k else level
    return Letters(direct, ORDER)


def _sweeper(letters, parents, totals, sweep: int, keep: bool, seed: int):
    """letters: broadcast, for the first sweep. totals: broadcast (customers and tables of each context, customers and tables of the root). keep: the samples so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_customers, c_tables, _, root_tables = totals.value
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.default_rng([seed, sweep, row["r"]])
                group = Group(row, parents.value)
                spelled = _unpack(row["spelled"]) if letters is None else np.exp(letters.value.probability(_unpack_words(row["words"])))
                tables = group.samples[-1]
                (d2, s2), (d1, s1), (d0, s0) = AFTER, ENDING, ROOT
                root = group.root(tables, totals.value, spelled)[group.e_word]
                pull = s1 + d1 * c_tables[group.e_context]
                p = (group.e_customers(tables[0]) - d1 * tables[1] + pull * root) / (s1 + c_customers[group.e_context])
                a = seat(group.a_customers, (s2 + d2 * c_tables[group.a_context]) * p[group.up], d2, rng)
                e = seat(group.e_customers(a), pull * root, d1, rng)
                at_root = group.root_customers(e)
                now = [a, e, seat(at_root, (s0 + d0 * root_tables) * spelled, d0, rng)]
                yield _row(
                    _STATE, r=row["r"], words=row["words"], count=row["count"], after=row["after"], ending=row["ending"], spelled=_pack(spelled),
                    tables=[*(row["tables"] if keep else []), *(_pack(x.astype(np.uint32)) for x in now)], used=group.used(now), root_customers=int(at_root.sum()), root_tables=int(now[2].sum()),
                )

    return run


def _totals(state: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    used = state.select(F.explode("used").alias("u")).groupBy("u.context").agg(F.sum("u.customers").alias("customers"), F.sum("u.tables").alias("tables")).toArrow()  # CONTEXTS rows at most
    customers, tables = np.zeros(CONTEXTS), np.zeros(CONTEXTS)
    customers[used["context"].to_numpy()], tables[used["context"].to_numpy()] = used["customers"].to_numpy(), used["tables"].to_numpy()
    root = state.agg(F.sum("root_customers"), F.sum("root_tables")).first()
    return customers, tables, root[0] or 0, root[1] or 0


def _replier(parents, history):
    """history: broadcast, of each averaged sweep the totals after it."""

    def reply(asked: pa.Table, states: pa.Table) -> pa.Table:
        out = []
        for state in states.to_pylist():
            group, spelled = Group(state, parents.value), _unpack(state["spelled"])
            (d2, s2), (d1, s1) = AFTER, ENDING
            for row in asked.to_pylist():
                ids = _unpack(row["ids"]).astype(np.int64)
                word, context = _unstepped(_unpack(row["word"]), _unpack(row["context"]))
                word = ids[word]
                after = context >= ENDINGS
                above = context.copy()
                above[after] = parents.value[context[after] - ENDINGS]
                p = np.zeros(len(word))
                for tables, totals in zip(group.samples, history.value, strict=True):
                    c_customers, c_tables, _, _ = totals
                    own = _found(group.e_code, group.e_customers(tables[0]) - d1 * tables[1], word * CONTEXTS + above, 0.0)
                    q = (own + (s1 + d1 * c_tables[above]) * group.root(tables, totals, spelled)[word]) / (s1 + c_customers[above])
                    own = _found(group.a_code, group.a_customers - d2 * tables[0], word * CONTEXTS + context, 0.0)
                    p += np.where(after, (own + (s2 + d2 * c_tables[context]) * q) / (s2 + c_customers[context]), q)
                out.append(_row(_REPLY, r=row["r"], block=row["block"], count=_pack(group.total[ids].astype(np.uint32)), log10=_pack(np.log10(p / max(1, len(history.value))).astype(np.float32))))
        return pa.Table.from_batches(out, _REPLY)

    return reply


def _scorer(groups: int, often, n_tokens: int, n_types: int):
    def score(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            words, sizes, held, ids, pairs, inverse = _pairs(row, often.value)
            deal = _deal(words, pairs, groups)
            known, log10 = np.zeros(len(words), np.int64), np.zeros(len(pairs))
            at = {r: i for i, r in enumerate(deal.groups)}
            for reply in replies.to_pylist():  # in the order in which the block asked
                i = at[reply["r"]]
                known[deal.words[i]], log10[deal.pairs[i]] = _unpack(reply["count"]), _unpack(reply["log10"])
            start = np.cumsum(sizes) - sizes
            base = np.log10((known + 1) / (n_tokens + n_types + 1))
            columns = [row["doc_ids"], held, sizes, np.add.reduceat((known > 0)[ids].astype(np.int64), start), np.add.reduceat(base[ids], start), np.add.reduceat(log10[inverse], start)]
            out.append(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCORE, strict=True)], schema=_SCORE))
        return pa.Table.from_batches(out, _SCORE)

    return score


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sweeps: int = 4, samples: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast
    blocks = written(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_blocks, _ddl(_BLOCK)), "uncompressed")
    size = blocks.agg(F.sum("n_words"), F.sum("n_train")).first()
    groups = max(1, math.ceil((size[0] or 0) / GROUP))
    names = frequent_words(blocks, size[1] or 0)
    often, parents = sent({w: i for i, w in enumerate(names)}), sent(np.array([ending(w) for w in names], np.int64))
    asked = blocks.mapInArrow(_asker(groups, often), _ddl(_ASKED)).repartition(groups, "r")
    merged = written(asked.groupBy("r").applyInArrow(_merger(parents), _ddl(_MERGED)), "uncompressed")
    states, numbers = merged.where("block IS NULL"), merged.where("block IS NOT NULL").select("r", "block", "ids", "word", "context")
    total = states.agg(F.sum("n_tokens"), F.sum("n_types")).first()
    n_tokens, n_types = total[0] or 0, total[1] or 0
    letters = sent(_letters(states.select("words", "count")))
    state, totals, history = states.select(*_STATE.names), _totals(states), []
    for sweep in range(sweeps):
        keep = sweep > sweeps - samples  # the sample of the sweep before is averaged too
        after = written(state.mapInArrow(_sweeper(letters if sweep == 0 else None, parents, sent(totals), sweep, keep, seed), _ddl(_STATE)), "uncompressed")
        if sweep:
            drop_written(state)
        state, totals = after, _totals(after)
        history = [*(history if keep else []), totals]
    replies = numbers.groupBy("r").cogroup(state.drop("words", "used").groupBy("r")).applyInArrow(_replier(parents, sent(history)), _ddl(_REPLY))
    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scorer(groups, often, n_tokens, n_types), _ddl(_SCORE))
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType)).withColumn("train_tokens", F.lit(n_tokens).cast("long"))
