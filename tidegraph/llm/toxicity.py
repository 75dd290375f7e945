"""Toxicity by maximum-scoring segments of token log-odds.

A token's score is the log-odds that a document with it is labelled toxic, relative to all documents, with Dirichlet
priors in a chain: the first 4 bytes of a word, the first 6, the first 8 and the word each have a two-class Dirichlet
prior of ``strength`` pseudo-documents, centred on the estimate before it. A constant drift makes the expected score of
clean text negative. One linear scan then finds every maximal scoring segment (Ruzzo and Tompa).

Segments are aggregated by extreme-value calibration (Karlin and Altschul). In a clean text of n tokens, segments of score
S or more are rare and independent: Poisson with mean E = K * n * exp(-lambda * S). lambda and K are maximum-likelihood
estimates from the best segments of clean training texts that exceed all but a share ``TAIL`` of them, whose scores were
learnt without the text they are applied to (``FOLDS`` parts). Tokens of real text aren't independent: the k-th occurrence
of a word in a text has a k-th of its score, if that is above 0. Weaker segments than those are no evidence. Of the r best segments the r-th has
mean E_r, and P(r segments or more) is a Poisson tail; a text's evidence is the best -log10 of it over all r, corrected for
the choice of r, up to ``MOST``. It can only rise as a segment's score rises. The probability is a logistic function of the evidence with
a slope above 0, fitted on the training rows' out-of-fold evidence; evidence of ``SURE`` scores ``SURE_SCORE`` at least.

The classifier is fitted on at most ``max_labelled`` labelled rows, those with the smallest hashes of their ids; copies of
a text among them count once. All rows are scored, whatever their size; equal texts get equal scores.

A null text, or one without letters, scores 0. Without labelled rows of both classes every score is 0. A null label is
no label; a document labelled more than once is toxic if any label says so; of rows that share an id, the text with the
smallest hash is learnt from. An empty table gives an empty result. Only the named columns are read; results are new columns, or
rows filtered, with other columns as they were.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import give_back, text_bytes, written

#: Lower case; all ASCII but letters becomes a space.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PREFIXES = (4, 6, 8)
NOTABLE = 0.1
FOLDS = 4
TAIL = 0.1
MOST = 30.0
SURE, SURE_SCORE = 4.0, 0.75  # -log10 of a chance of one in 10,000
PASSAGE_E = 0.01
SCHEMA = "score double, passages array<struct<first_word:int,last_word:int,e_value:double>>"
_PASSAGE = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("e_value", pa.float64())])
_RESULT = pa.struct([("score", pa.float64()), ("passages", pa.list_(_PASSAGE))])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text (null: the word null), modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


def chain(word: bytes) -> list[bytes]:
    """The features of a word, each a refinement of the one before."""
    return [*(word[:k] for k in PREFIXES), b"=" + word]


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(LETTERS).split()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in linear time; only positive scores can begin or end one."""
    totals = np.cumsum(scores)
    held: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    for k in np.flatnonzero(scores > 0).tolist():
        right = float(totals[k])
        left, first = right - float(scores[k]), k
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j -= 1
            if j < 0 or held[j][1] >= right:
                held.append((left, right, first, k))
                break
            left, first = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, r - x) for x, r, a, b in held]


def log_factorial(n: int) -> np.ndarray:
    """Of 0 to n."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def evidence(n: int, scores: np.ndarray, rate: float, k: float, least: float) -> float:
    """-log10 of the least chance, over all r, of r segments that score like the r best; n: tokens of the text. Scores up to least are left out."""
    scores = scores[scores > least]
    if not len(scores):
        return 0.0
    r = np.arange(1, len(scores) + 1)
    mean = k * n * np.exp(-rate * np.sort(scores)[::-1])
    # The Poisson tail is at most its first term over 1 - mean / (r + 1); both rise with the mean where it is below r.
    rare = np.flatnonzero(mean < r)
    mean, r = mean[rare], r[rare]
    tail = r * np.log(np.maximum(mean, 1e-300)) - mean - log_factorial(len(scores))[r] - np.log1p(-mean / (r + 1))
    return min(MOST, max(0.0, float((-tail - np.log(r * (r + 1.0))).max(initial=0.0)) / math.log(10)))


@dataclass
class Model:
    """scores: of features, drift not yet taken off; rate, k: Karlin and Altschul's lambda and K, for segments that score over least; base, slope: of the logistic link, slope 0: not fitted."""

    scores: dict[bytes, float]
    drift: float
    rate: float = 1.0
    k: float = 1.0
    least: float = 0.0
    base: float = 0.0
    slope: float = 0.0

    def __post_init__(self) -> None:
        self.known: dict[bytes, float] = {}

    def of_words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 400_000:
            known.clear()
        scores = np.fromiter((known[w] if w in known else self._score(w) for w in words), np.float64, len(words))
        seen: Counter = Counter()
        for i in np.flatnonzero(scores > 0).tolist():
            seen[words[i]] += 1
            scores[i] /= seen[words[i]]
        return scores

    def _score(self, word: bytes) -> float:
        found = next((s for f in reversed(chain(word)) if (s := self.scores.get(f)) is not None), 0.0) - self.drift
        if len(word) <= 48:
            self.known[word] = found
        return found

    def probability(self, found: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.base + self.slope * found))))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        words = words_of(text)
        if not words or not self.slope:
            return 0.0, []
        segments = maximal_segments(self.of_words(words))
        found = evidence(len(words), np.array([s for _, _, s in segments]), self.rate, self.k, self.least)
        passages = [(a, b, self.k * len(words) * math.exp(-self.rate * s)) for a, b, s in segments]
        return self.probability(found), [p for p, x in zip(passages, segments, strict=True) if x[2] > self.least and p[2] <= PASSAGE_E]


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text, toxic, part (of FOLDS) of at most max_labelled labelled documents outside the held-out fold, each text once."""
    ids = labels.where("toxic IS NOT NULL").where(fold(F.col("doc_id"), 3) != 1).groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("of"), "of").limit(max_labelled)  # so many rows of two numbers are broadcast
    rows = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(chosen), "of")
    rows = written(rows.select("*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("copy"), F.monotonically_increasing_id().alias("row")))
    # Whole texts aren't shuffled: one row of each id, then one of each text, is chosen by hash and number.
    of_id = rows.groupBy("of").agg(F.min(F.struct("copy", "row")).alias("least"), F.max("toxic").alias("toxic"))
    of_text = of_id.groupBy("least.copy").agg(F.min("least.row").alias("row"), F.max("toxic").alias("toxic"))
    return rows.select("text", "row").join(F.broadcast(of_text), "row").select("text", "toxic", F.pmod(F.xxhash64("copy"), F.lit(FOLDS)).cast("int").alias("part"))


_COUNTS = [f"{name}{part}" for name in ("clean", "toxic") for part in range(FOLDS)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: list[Counter] = [Counter() for _ in _COUNTS]
    for batch in batches:
        for text, toxic, part in zip(*(batch[c].to_pylist() for c in ("text", "toxic", "part")), strict=True):
            counts[FOLDS * bool(toxic) + part].update({f for w in set(words_of(text)) for f in chain(w)})
    names = list(set().union(*counts))
    yield pa.record_batch([pa.array(names, pa.binary()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)], names=["feature", *_COUNTS])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, strength: float = 30.0, drift: float = 0.6) -> Model:
    rows = written(training_rows(docs, labels, max_labelled))
    counted = rows.mapInArrow(_count, ", ".join(["feature binary", *(f"{c} long" for c in _COUNTS)])).groupBy("feature").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    size = {(r["part"], bool(r["toxic"])): r["count"] for r in rows.groupBy("part", "toxic").count().collect()}
    n = np.array([[size.get((part, kind), 0) for part in range(FOLDS)] for kind in (False, True)], np.float64)
    if not n.sum(1).all():
        return Model({}, drift)
    # Bounded by the sample: features of one or two documents alone would hardly move their prior.
    table = counted.where(f"{' + '.join(_COUNTS)} > 2").toArrow()
    names = table["feature"].to_pylist()
    counts = np.array([table[c].to_numpy() for c in _COUNTS], np.float64).reshape(2, FOLDS, len(names))
    whole = _log_odds(names, counts.sum(1), n.sum(1), strength)
    others = [_log_odds(names, counts.sum(1) - counts[:, part], n.sum(1) - n[:, part], strength) for part in range(FOLDS)]
    return _calibrated(rows, Model(whole, drift), [Model(scores, drift) for scores in others])


def _log_odds(names: list[bytes], counts: np.ndarray, n: np.ndarray, strength: float) -> dict[bytes, float]:
    """Scores of the features that differ from the one before them in their chain by NOTABLE at least; others have its score. counts, n: documents with a feature and of all, by class."""
    share = (n[1] + 0.5) / (n.sum() + 1)
    logit = lambda p: np.log(p / (1 - p))
    at = {f: i for i, f in enumerate(names)}
    # A feature's chain is in the table if it is. Level 0 has prefixes of 4 bytes at most, the last level whole words.
    level = np.array([len(PREFIXES) if f[:1] == b"=" else sum(len(f) > k for k in PREFIXES) for f in names], np.int64)
    above = np.array([at.get(f[1 : 1 + PREFIXES[-1]] if v == len(PREFIXES) else f[: PREFIXES[v - 1]], -1) if v else -1 for f, v in zip(names, level.tolist(), strict=True)], np.int64)
    rate = np.append(np.full(len(names), share), share)  # the last is that of -1
    notable = np.zeros(len(names), bool)
    for v in range(len(PREFIXES) + 1):
        i = np.flatnonzero(level == v)
        before = rate[above[i]]
        own = (counts[1, i] + strength * before) / (counts[:, i].sum(0) + strength)
        notable[i] = np.abs(logit(own) - logit(before)) >= NOTABLE
        rate[i] = np.where(notable[i], own, before)
    scores = logit(rate[:-1]) - logit(share)
    return {names[i]: float(scores[i]) for i in np.flatnonzero(notable).tolist()}


def _calibrated(rows: DataFrame, model: Model, others: list[Model]) -> Model:
    """model with lambda, K and the link, from rows that are scored by the model of the other parts."""
    sent = rows.sparkSession.sparkContext.broadcast(others)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value[part].of_words(words_of(text)) for text, part in zip(batch["text"].to_pylist(), batch["part"].to_pylist(), strict=True)]
            top = [max((x for _, _, x in maximal_segments(s)), default=0.0) for s in scores]
            yield pa.record_batch([pa.array([len(s) for s in scores], pa.float64()), pa.array(top, pa.float64())], names=["n", "top"])

    clean = rows.where("toxic = 0").mapInArrow(best, "n double, top double").toArrow()  # max_labelled rows at most
    model.rate, model.k, model.least = _tail(np.array(clean["n"]), np.array(clean["top"]))
    rate, k, least = model.rate, model.k, model.least

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, part in zip(batch["text"].to_pylist(), batch["part"].to_pylist(), strict=True):
                scores = sent.value[part].of_words(words_of(text))
                found.append(evidence(len(scores), np.array([s for _, _, s in maximal_segments(scores)]), rate, k, least))
            yield pa.record_batch([pa.array(found, pa.float64()), batch["toxic"].cast(pa.float64())], names=["x", "y"])

    rows_of = rows.mapInArrow(weigh, "x double, y double").toArrow()  # max_labelled rows at most
    model.base, model.slope = _link(np.array(rows_of["x"]), np.array(rows_of["y"]))
    return model


def _tail(n: np.ndarray, top: np.ndarray) -> tuple[float, float, float]:
    """lambda and K of the best segments beyond all but TAIL of them, and where these begin; 1, 1, 0 if none is above 0."""
    beyond = float(np.quantile(top, 1 - TAIL)) if len(top) else 0.0
    excess = top[top > beyond] - beyond
    if not len(excess):
        return 1.0, 1.0, 0.0
    rate = 1 / max(float(excess.mean()), 0.05)
    return rate, float(len(excess) / n.sum() * math.exp(rate * beyond)), beyond


def _link(x: np.ndarray, y: np.ndarray, least: float = 0.05) -> tuple[float, float]:
    """Base and slope (least at least) of the logistic regression of y on x, with a base that lets SURE score SURE_SCORE."""
    order = np.lexsort((x, y))  # the sums below are then the same whatever order the rows came in
    x, y = x[order], y[order]
    base, slope = 0.0, 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(base + slope * x, -700, 700)))
        v = p * (1 - p) + 1e-9
        grad = np.array([(y - p).sum() - 0.01 * base, ((y - p) * x).sum() - 0.01 * slope])
        bend = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.linalg.solve(bend, grad)
        base, slope = base + float(np.clip(step[0], -2, 2)), max(least, slope + float(np.clip(step[1], -1, 1)))
    return max(base, math.log(SURE_SCORE / (1 - SURE_SCORE)) - slope * SURE), slope


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000):
    """A function of a text column to a struct (SCHEMA): the probability, and the passages with an E-value of at most PASSAGE_E."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in batches:
            rows = [model.judge(t.as_py()) for t in texts]
            passages = [[{"first_word": a, "last_word": b, "e_value": e} for a, b, e in r[1]] for r in rows]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array(passages, pa.list_(_PASSAGE))], fields=list(_RESULT))
        give_back()

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = 12_000, text: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more."""
    score = toxicity(docs, labels, max_labelled)
    mark = "__toxic"
    while mark in docs.columns:
        mark += "_"
    return docs.withColumn(mark, score(F.col(text))).where(F.col(mark)["score"] < threshold).drop(mark)
