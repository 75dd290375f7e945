"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed side by side into 64-bit words of Shift-And masks: bit j of a rule says that its first j symbols
have been read. A character moves every bit whose next symbol it is, and holds every bit that stands on a wildcard which
takes it; one step per character position runs all rules over all URLs of a batch at once. A canonical URL is ``.host/path``.

In a rule, ``*`` takes any characters but ``/`` and ``**`` any characters at all, ``?`` takes one character.

A null URL, or one without ``://``, has an empty host and path and fits no rule that names a host. Of several rules that
fit, the longest wins, the first of equally long ones. URLs of any length are taken whole; equal URLs get equal
verdicts. The result is one struct column, so columns of the input keep their names and values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.llm.common import LOWER

SCHEMA = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    """A verdict for what fits a glob. name: what the result calls it; size: how specific it is, its length if 0."""

    verdict: str
    glob: str
    name: str = ""
    size: int = 0

    @classmethod
    def site(cls, verdict: str, host: str, path: str) -> Rule:
        """Fits the host and all its subdomains where the URL's path starts with the given one."""
        return cls(verdict, f"*.{host}{path}**", host + path, len(host + path))


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return host.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"), path


class WildcardAutomaton:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = sorted(rules, key=lambda r: -(r.size or len(r.glob)))  # stable: the first of equally long ones wins
        parsed = [self._parse(r.glob) for r in self.rules]
        self.words = max(1, -(-sum(len(s) + 1 for s, _ in parsed) // 64))
        self.moves = np.zeros((256, self.words), np.uint64)  # [byte]: bits that go on to the next
        self.holds = np.zeros((256, self.words), np.uint64)  # [byte]: bits that stay
        self.first = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for symbols, loops in parsed:
            word, bit = self._bit(at)
            self.first[word] |= bit
            for j in range(len(symbols) + 1):
                word, bit = self._bit(at + j)
                if j < len(symbols):
                    self.moves[symbols[j] if symbols[j] >= 0 else slice(None), word] |= bit
                if j in loops:
                    self.holds[:, word] |= bit
                    if not loops[j]:
                        self.holds[47, word] &= ~bit
            self.last.append(self._bit(at + len(symbols)))
            at += len(symbols) + 1

    @staticmethod
    def _bit(at: int) -> tuple[int, np.uint64]:
        return at // 64, np.uint64(1 << at % 64)

    @staticmethod
    def _parse(glob: str) -> tuple[list[int], dict[int, bool]]:
        """Symbols (bytes, -1 for any), and for each place with a wildcard whether it takes a slash."""
        symbols: list[int] = []
        loops: dict[int, bool] = {}
        data = glob.encode()
        i = 0
        while i < len(data):
            if data[i] == 42:
                double = data[i : i + 2] == b"**"
                loops[len(symbols)] = loops.get(len(symbols), False) or double
                i += 1 + double
            else:
                symbols.append(-1 if data[i] == 63 else data[i])
                i += 1
        return symbols, loops

    def first_fit(self, texts: list[bytes]) -> np.ndarray:
        """For each text, the number of the first rule (in self.rules) that fits, or -1."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        data = np.frombuffer(b"".join(texts[i] for i in order) + b"\0", np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(texts) else lengths
        state = np.repeat(self.first[None, :], len(texts), axis=0)
        active = len(texts)
        for p in range(int(lengths[0]) if len(texts) else 0):
            while active and lengths[active - 1] <= p:
                active -= 1
            now, chars = state[:active], data[starts[:active] + p]
            moved = now & self.moves[chars]
            held = now & self.holds[chars]
            held |= moved << np.uint64(1)
            held[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            state[:active] = held
        found = np.full(len(texts), -1, np.int64)
        for k in range(len(self.last) - 1, -1, -1):
            word, bit = self.last[k]
            found[(state[:, word] & bit) != 0] = k
        out = np.empty(len(texts), np.int64)
        out[order] = found
        return out


def judge_urls(url: Column, rules: list[Rule], otherwise: str = "allow") -> Column:
    """A struct (SCHEMA) for each URL; verdict is that of the longest rule that fits, else ``otherwise``."""
    kind = pa.struct([(x.split()[0], pa.string()) for x in SCHEMA.split(", ")])

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = WildcardAutomaton(rules)
        names = [r.name or r.glob for r in automaton.rules]
        for urls in batches:
            parts = [split_url(u) for u in urls.to_pylist()]
            fits = automaton.first_fit([f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in parts])
            columns = [[h for h, _ in parts], [p for _, p in parts], [names[k] if k >= 0 else None for k in fits], [automaton.rules[k].verdict if k >= 0 else otherwise for k in fits]]
            yield pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(kind))

    return run(url)
