"""Token counts by a compiled finite-state tokenizer.

A byte-pair encoding is compiled into a deterministic transducer. A state is what the coming characters can still depend
on: for every suffix of the text so far that begins some token, the last token before that suffix, and how many tokens
the suffix has added. A transition finds the one token that ends with the new character and may follow the token before
it, and is annotated with the number of tokens by which the count changes. States and transitions are made as texts need
them, and start afresh beyond ``max_states``, so memory is bounded and counts stay exact.

Where no token holds a space mark behind another character, nor letters beside other characters, counts of the segments
between are independent. The map of a chunk of text (state before it to state after it and tokens emitted) is then constant but for the part before its
first boundary, and is kept as (head, count, tail). Such maps compose associatively; a prefix scan over the chunks of a
text gives its count.

Null is taken as empty and has 0 tokens. Texts of any length are taken whole. Equal texts get equal counts. Columns of
the input are not touched: the result is one column, which the caller names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space in the pieces
CHUNK = 1 << 16
MAX_VOCABULARY = 1 << 20  # pieces; a larger model is refused, so that what is broadcast is bounded
_START = ""
_LETTER = r"[^\W\d_]"
_OTHER = rf"(?:[^\w{MARK}]|[\d_])"


def load_pieces(path: str) -> tuple[str, ...]:
    """The ordinary pieces of a sentencepiece BPE model with byte fallback, in order of merging. Read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MAX_VOCABULARY:
        raise ValueError(f"{n} pieces; at most {MAX_VOCABULARY} are broadcast")
    ids = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if sum(model.is_byte(i) for i in range(n)) != 256:
        raise ValueError("a model with byte fallback is needed")
    return tuple(model.id_to_piece(i) for i in sorted(ids, key=lambda i: -model.get_score(i)))


@dataclass(frozen=True, slots=True)
class ChunkMap:
    """head: text before the first sure boundary; count: tokens of the whole segments; tail: text after the last boundary, None if there is none."""

    head: str
    count: int = 0
    tail: str | None = None


class Transducer:
    def __init__(self, pieces: tuple[str, ...], max_states: int = 300_000, max_words: int = 500_000) -> None:
        self.rank = {p: i for i, p in enumerate(pieces)}
        self.alphabet = {c for p in pieces for c in p}
        self.begins = {p[:i] for p in pieces for i in range(1, len(p))}
        self.max_states, self.max_words = max_states, max_words
        # Where no piece joins two kinds of characters in this order, the text parts there, and counts add up.
        parts = not any(MARK in p.lstrip(MARK) for p in pieces)
        mixed = re.compile(f"{_LETTER}(?!{MARK}){_OTHER}|(?!{MARK}){_OTHER}{_LETTER}").search
        runs = f"{MARK}*(?:{_LETTER}+|{_OTHER}+)|{MARK}+" if not any(map(mixed, pieces)) else f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        self.segment = re.compile(runs if parts else "(?s:.+)").findall
        self.stays = lru_cache(1 << 16)(lambda t: len(self.merged(t)) == 1)
        self.follows = lru_cache(1 << 17)(self._follows)
        self.words: dict[str, int] = {}
        self._fresh()

    def _fresh(self) -> None:
        self.parts: dict[tuple, tuple] = {}  # what states are made of, each once
        # A state is a dict of char: (state, tokens), with what it stands for under "": (length, suffix, last token before it, tokens since), ...
        self.root: dict = {"": ((0, "", _START, 0),)}
        self.states = {self.root[""]: self.root}

    def merged(self, text: str) -> list[str]:
        """Tokens by merging the best pair, the leftmost of equal ones, until no pair merges."""
        parts = list(text)
        while True:
            best = min(((self.rank.get(a + b, MAX_VOCABULARY), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(MAX_VOCABULARY, 0))
            if best[0] == MAX_VOCABULARY:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _follows(self, first: str, second: str) -> bool:
        return first == _START or self.merged(first + second) == [first, second]

    def cost(self, token: str) -> int:
        return 1 if token in self.rank else len(token.encode("utf-8", "surrogatepass"))

    def _move(self, state: dict, char: str) -> tuple[dict, int]:
        """Compiles a transition."""
        if char not in self.alphabet:  # bytes; nothing merges with it
            return state.setdefault(char, (self.root, len(char.encode("utf-8", "surrogatepass"))))
        for _, suffix, last, since in state[""]:
            token = suffix + char
            if (token in self.rank or not suffix) and self.stays(token) and self.follows(last, token):
                more = self.cost(token) - since
                break
        once = self.parts.setdefault
        parts = [(0, "", token, 0), *((n + 1, s + char, last, since + more) for n, s, last, since in state[""] if s + char in self.begins)]
        live = tuple(once(p, p) for p in parts)
        if live not in self.states:
            if len(self.states) >= self.max_states:
                self._fresh()
            self.states[live] = {"": live}
        return state.setdefault(char, (self.states[live], more))

    def run(self, segment: str) -> int:
        state, count = self.root, 0
        for char in segment:
            move = state.get(char) or self._move(state, char)
            state = move[0]
            count += move[1]
        return count

    def segments(self, found: list[str]) -> int:
        words = self.words
        counts = list(map(words.get, found))
        total = sum(filter(None, counts))
        if None in counts:
            if len(words) >= self.max_words:
                words.clear()
            for s in [s for s, n in zip(found, counts, strict=True) if n is None]:
                n = words.get(s)
                if n is None:
                    n = self.run(s)
                    if len(s) <= 48:
                        words[s] = n
                total += n
        return total

    def chunk(self, text: str) -> ChunkMap:
        found = self.segment(text)
        return ChunkMap(text) if len(found) < 2 else ChunkMap(found[0], self.segments(found[1:-1]), found[-1])

    def then(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            joined = self.chunk(a.head + b.head)
            if b.tail is None:
                return joined
            return ChunkMap(joined.head, joined.count + b.count + (0 if joined.tail is None else self.segments([joined.tail])), b.tail)
        if b.tail is None:
            joined = self.chunk(a.tail + b.head)
            return ChunkMap(a.head, a.count, joined.head) if joined.tail is None else ChunkMap(a.head, a.count + self.segments([joined.head]) + joined.count, joined.tail)
        return ChunkMap(a.head, a.count + self.segments(self.segment(a.tail + b.head)) + b.count, b.tail)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if len(text) <= CHUNK:
            return self.segments(self.segment(text))
        whole = reduce(self.then, [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])
        return self.segments([x for x in (whole.head, whole.tail) if x]) + whole.count


_made: dict[int, Transducer] = {}


def compiled(key: int, pieces: tuple[str, ...]) -> Transducer:
    """The transducer of a worker, which keeps what it has compiled for its next tasks. A function of the module, as the module's variables are copied into what a task is sent."""
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(pieces)
    return _made[key]


def token_counter(spark: SparkSession, model_path: str):
    """A function of a text column to its number of tokens (long)."""
    pieces = spark.sparkContext.broadcast(load_pieces(model_path))
    key = hash(pieces.value)

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = compiled(key, pieces.value)
        for texts in batches:
            yield pa.array([run.count(t.as_py()) for t in texts], pa.int64())

    def of(text: Column) -> Column:
        return count(text)

    return of
