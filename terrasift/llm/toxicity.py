"""Toxic passages as maximum-scoring segments.

Words score by their log-odds between toxic and other documents under a Dirichlet prior. They are counted by windows of
WINDOW words that hold them, so neither the length of documents nor a repeated word tilts the score; how sure it is
goes by documents. Only words that are surely EXCESS times as frequent in toxic text, however many words were tried,
have a score of their own. Beginnings that several such words share (inflected forms of a stem) are scored alike, and
stand for words that training has not met. All other words share a negative score, by which ordinary text loses MARGIN
a word on average: without that no segment could be told from chance.

A linear-time scan finds every maximal segment of a document. A segment is significant if its score is unlikely to be
met by chance in a text of that length, by the extreme-value distribution of such scores; how unlikely a text's segments
are is added up and calibrated against the labels.

The model is fitted on a bounded sample of labelled documents (``SAMPLE``) and has ``LEXICON`` words at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import doc_texts, map_batches, written
from terrasift.llm.decontamination import words_of

#: Most labelled documents that the model is fitted on, and most words with scores of their own.
SAMPLE, LEXICON = 20_000, 50_000
#: Words of a window.
WINDOW = 64
#: Prior: for each word, and shared out by frequency.
PRIOR, SHARED = 0.5, 10.0
#: A scored word is so many times as frequent in toxic text, but for this chance over all words tried, and in so many
#: toxic documents at least.
EXCESS, ERROR, LEAST = 2.0, 0.01, 5
#: What ordinary text loses a word on average at least.
MARGIN = 0.1
#: Letters of a beginning, and different words of toxic documents that have it at least.
STEMS, STEM_WORDS = (4, 5, 6), 5
#: Probability by chance below which a segment is significant.
CHANCE = 0.05
#: From this score on a document is predicted to be toxic.
TOXIC = 0.3
_BINS, _BIN = 160, 0.25
REMEMBERED = 200_000


def stems(word: bytes) -> list[bytes]:
    """The beginnings of a longer word, the longest first, marked so that no word is like one."""
    letters = word.decode("utf-8", "surrogatepass")
    return [b"^" + letters[:n].encode("utf-8", "surrogatepass") for n in reversed(STEMS) if n < len(letters)]


@dataclass
class Model:
    scores: dict[bytes, float]  # by word, and by beginning
    other: float  # of all other words
    rate: float  # of the extreme-value distribution
    intercept: float = 0.0
    slope: float = 0.0
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def name(self, word: bytes) -> bytes | None:
        """What a word is scored as: itself or its longest beginning that has a score."""
        return next((name for name in (word, *stems(word)) if name in self.scores), None)

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = self.scores.get(self.name(word), self.other)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log-odds of words between toxic and other windows under the prior."""
    prior = PRIOR + SHARED * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    odds = lambda x, n: np.log(x / (n + SHARED + 1 - np.minimum(x, n)))
    return odds(a, n_toxic) - odds(b, n_clean)


def surely(value: np.ndarray, toxic_docs: np.ndarray, clean_docs: np.ndarray, tried: int) -> np.ndarray:
    """Which log-odds exceed log EXCESS by so many standard errors that none of ``tried`` words does by chance."""
    sure = NormalDist().inv_cdf(1 - ERROR / max(tried, 1))
    return value - sure * np.sqrt(1 / (toxic_docs + PRIOR) + 1 / (clean_docs + SHARED)) > math.log(EXCESS)


def background(scores: np.ndarray, shares: np.ndarray) -> float:
    """The score of all other words with which the mean over ordinary text is -MARGIN.

    ``shares`` are those of the scored words in ordinary text.
    """
    return -(MARGIN + float(np.maximum(scores, 0) @ shares)) / max(1 - float(shares.sum()), 1e-9)


def rate_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive rate at which the mean of exp(rate * score) is 1 in ordinary text, whose mean score is negative."""
    low, high = 0.0, 1.0
    mean = lambda rate: float((shares * np.exp(np.minimum(rate * scores, 700))).sum())
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return low


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) by one scan.

    Each positive score opens a candidate. A candidate is joined with the nearest earlier one that starts from a lower
    total, if the total has risen since that one's end; candidates between them have no lower start.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total at the end, nearest lower
    for at in np.flatnonzero(scores > 0).tolist():
        start, before, after = at, total[at], total[at + 1]
        lower = len(found) - 1
        while True:
            while lower >= 0 and found[lower][2] >= before:
                lower = found[lower][4]
            if lower < 0 or found[lower][3] >= after:
                break
            start, before = found[lower][0], found[lower][2]
            del found[lower:]
            lower = len(found) - 1
        found.append((start, at + 1, before, after, lower))
    return [(start, end, float(after - before)) for start, end, before, after, _ in found]


def evidence(model: Model, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """How unlikely the segments of a text are by chance, added up as -log p, and the significant ones by word."""
    words = words_of(text)
    scores = model.of(words)
    if not (scores > 0).any():
        return 0.0, []
    out, total = [], 0.0
    for start, end, score in segments(scores):
        expected = len(words) * math.exp(-model.rate * score)  # segments as good in such a text by chance
        p = max(-math.expm1(-expected), 1e-300)
        total -= math.log(p)
        if p < CHANCE:
            out.append((start, end, score))
    return total, out


def calibrate(counts: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through (bin of evidence, label) counts, held back a little."""
    x = np.array([_BIN * bin_ for bin_, _ in counts])
    y = np.array([label for _, label in counts], float)
    n = np.array(list(counts.values()), float)
    design, w = np.stack([np.ones_like(x), np.log1p(x)], 1), np.zeros(2)
    hold = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (n * (y - p)) - hold @ w
        curve = design.T @ (design * (n * p * (1 - p))[:, None]) + hold
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


COUNTS = ["toxic_docs", "clean_docs", "toxic_windows", "clean_windows"]


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> Model | None:
    """The model of the labelled rows of ``docs`` for which ``training`` holds; None without both kinds of label."""
    spark = docs.sparkSession
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(labels["doc_id"].alias("labelled")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(training(F.col("labelled")))
    share = SAMPLE / max(1, known.count())
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "labelled"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * SAMPLE)
    # at most 2 * SAMPLE ids are broadcast; copies of a text count once
    sampled = doc_texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("text", "toxic")
    sampled = written(sampled.groupBy("text").agg(F.max("toxic").alias("toxic")))
    sizes = dict(sampled.groupBy((F.col("toxic") > 0).alias("kind")).count().collect())
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {(kind, toxic): Counter() for kind in ("docs", "windows") for toxic in (False, True)}
        total = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                toxic, words = toxic > 0, words_of(text.as_py())
                begins = {word: (word, *stems(word)) for word in set(words)}
                seen["docs", toxic].update({name for names in begins.values() for name in names})
                for at in range(0, len(words), WINDOW):
                    seen["windows", toxic].update({name for word in words[at : at + WINDOW] for name in begins[word]})
                    total[toxic] += 1
        names = list({*seen["docs", True], *seen["docs", False]})
        counts = [[n[w] for w in names] for n in (seen["docs", True], seen["docs", False], seen["windows", True], seen["windows", False])]
        counts = [[*n, 0] for n in counts]
        counts[2][-1], counts[3][-1] = total[True], total[False]  # under the empty word
        arrays = [pa.array([*names, b""], pa.binary()), *(pa.array(n, pa.int64()) for n in counts)]
        yield pa.RecordBatch.from_arrays(arrays, ["word", *COUNTS])

    counts = map_batches(sampled, counted, "word binary, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word")
    counts = written(counts.agg(*(F.sum(c).alias(c) for c in COUNTS)))
    sizes = counts.filter("word = X''").first()
    tried = counts.filter((F.col("toxic_docs") >= LEAST) & (F.col("word") != F.lit(b"")))
    # far fewer pass than are tried: all that can be in excess, with how many words of toxic text share a beginning
    more = tried.filter(F.col("toxic_windows") * sizes.clean_windows > F.col("clean_windows") * (EXCESS * sizes.toxic_windows))
    is_stem = F.substring("word", 1, 1) == F.lit(b"^")
    letters = F.col("word").cast("string")
    begins = F.array(*(F.when(F.length(letters) > n, F.concat(F.lit("^"), F.substring(letters, 1, n)).cast("binary")) for n in STEMS))
    shared_by = counts.filter((F.col("toxic_docs") > 0) & ~is_stem).select(F.explode(begins).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("words"))
    own = more.join(shared_by, "word", "left").filter(~is_stem | (F.col("words") >= STEM_WORDS))
    own = own.orderBy(F.desc("toxic_docs"), "word").limit(4 * LEXICON).toPandas()
    value = log_odds(own["toxic_windows"].to_numpy(float), own["clean_windows"].to_numpy(float), sizes.toxic_windows, sizes.clean_windows)
    own, value = (x[surely(value, own["toxic_docs"].to_numpy(float), own["clean_docs"].to_numpy(float), tried.count())][:LEXICON] for x in (own, value))
    names = [bytes(w) for w in own["word"]]
    model = Model(dict(zip(names, value.tolist(), strict=True)), -MARGIN, 1.0, math.log(n_toxic / n_clean))
    if not names:
        return model
    unscaled = spark.sparkContext.broadcast(model)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                n.update(words_of(text.as_py()))
        found: Counter = Counter()
        for word, times in n.items():
            found[unscaled.value.name(word) or b""] += times
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["name", "n"])

    uses = map_batches(sampled.filter("toxic <= 0").select("text"), used, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n"))
    uses = {bytes(row.name): row.n for row in uses.collect()}  # at most one for each scored name
    shares = np.array([uses.get(name, 0) + PRIOR for name in names]) / (sum(uses.values()) + PRIOR * (len(names) + 1))
    model.other = background(value, shares)
    model.rate = rate_of(np.append(value, model.other), np.append(shares, 1 - shares.sum()))
    shared = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                n[min(_BINS, int(evidence(shared.value, text.as_py())[0] / _BIN)), int(toxic > 0)] += 1
        keys = list(n)
        arrays = [pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([n[k] for k in keys], pa.int64())], ["bin", "label", "n"])

    found = map_batches(sampled, binned, "bin int, label int, n long").groupBy("bin", "label").agg(F.sum("n").alias("n")).collect()
    model.intercept, model.slope = calibrate({(row.bin, row.label): row.n for row in found})
    return model


SCHEMA = "doc_id {0}, score double, predicted int, passages array<struct<start: int, end: int, score: double>>"


def toxicity(docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """doc_id, score, predicted, passages for each row of ``docs``; ``passages`` are significant segments by word.

    ``training`` maps a doc_id column to whether its label may be learned from. Of several labels of an id the largest
    counts; null labels don't. Null and empty texts have the score of texts without evidence. Without labels of both
    kinds all scores are 0. Ids may be null or repeat; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, training))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            rows = [evidence(model, text.as_py()) if model else (0.0, []) for text in batch.column("text")]
            x = np.log1p(np.minimum([total for total, _ in rows], _BINS * _BIN))
            score = 1 / (1 + np.exp(-(model.intercept + model.slope * x))) if model else np.zeros(len(rows))
            found = [[dict(zip(("start", "end", "score"), s, strict=True)) for s in spans] for _, spans in rows]
            arrays = [pa.array(score, pa.float64()), pa.array((score >= TOXIC).astype(np.int32)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "score", "predicted", "passages"])

    rows = doc_texts(docs)
    return map_batches(rows, scored, SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))
