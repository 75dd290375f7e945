"""Quality rules from repetition inside a text, by a suffix array over its words.

The suffix array comes from prefix doubling; the ranks of every round are kept, so that the longest common prefix of two
neighbouring suffixes is found by halving. The largest common prefix that a suffix has with a neighbour gives the
repeated substring that starts there; the spans of all maximal ones of ``min_repeat`` words or more are united.

Nulls and empty texts have no words and fail the base rule. Texts of any length are taken whole: memory is
O(words * log2(longest repeat)). Rows that are alike get like verdicts; columns of the input keep their names and
values, as the result is one struct column that the caller names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.llm.common import text_bytes

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeat_lengths(ids: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest sequence from there that also starts at another position."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while levels[-1].max() < n - 1:
        pair = levels[-1] * (n + 1)
        pair[: n - step] += levels[-1][step:] + 1
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 2, -1, -1):  # equal ranks of round k: the first 2**k words are equal
        i, j = left + common, right + common
        inside = np.flatnonzero((i < n) & (j < n))
        common[inside[levels[k][i[inside]] == levels[k][j[inside]]]] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[left] = common
    longest[right] = np.maximum(longest[right], common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """Size of the union of the spans [start, start + length)."""
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str | None, min_repeat: int, max_covered: float, max_longest: int) -> tuple:
    words = text_bytes(text).split()  # bytes.split() parts at exactly U+0020 and U+0009 to U+000D
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    seen: dict[bytes, int] = {}
    longest = repeat_lengths(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n))
    three = np.flatnonzero(longest >= 3)
    n_repeat = covered(three, np.full(len(three), 3), n)
    long = np.flatnonzero(longest >= min_repeat)
    n_covered, top = covered(long, longest[long], n), int(longest.max(initial=0))
    n_dup = 0
    if n:
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        n_dup = len(lines) - len(set(lines))
    failed = n < 50 or 100 * n_repeat > 50 * n
    kept = not failed and n_covered <= max_covered * n and top <= max_longest
    return n, chars, len(_SYMBOLS.findall(text or "")), n_dup, n_repeat, n_covered, top, failed, kept


def repetition(text: Column, min_repeat: int = 10, max_covered: float = 0.3, max_longest: int = 100) -> Column:
    """A struct (SCHEMA) for each text; kept is false where the base rule fails, repeats of min_repeat words or more
    cover over max_covered of the words, or a repeat is longer than max_longest words."""
    kind = pa.struct([(n, pa.bool_() if t == "boolean" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [judge(t.as_py(), min_repeat, max_covered, max_longest) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    return run(text)
