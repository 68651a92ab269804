"""Language identification by a linear-chain conditional random field over words.

Each word has affix, n-gram and lexicon features with learned weights; learned transitions join neighbours, so that
code-switched texts come out as runs. Forward-backward gives each word's probabilities, vectorised over documents that
advance by one word together. A document's language is the one with the largest sum of them.

The model is fitted by the driver on a bounded sample (``PER_LANGUAGE`` documents a language, ``LEARNED`` characters of each), with segments of
different languages joined so that transitions can be learned; it is broadcast (``BUCKETS`` x languages weights).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import BATCH_BYTES, broadcast_key, doc_texts, map_batches, once

#: Most labelled documents of a language that the model is fitted on, and characters of each.
PER_LANGUAGE, LEARNED = 300, 20_000
#: Hashed features, and words of the lexicon with a feature of their own.
BUCKETS, LEXICON = 1 << 16, 20_000
#: Fitting: steps, step width, decay; words of a joined segment, segments of a sequence, chance of another language.
STEPS, WIDTH, DECAY, SEGMENT, SEGMENTS, SWITCH = 30, 0.3, 1e-6, 24, 8, 0.15
REMEMBERED = 200_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; none if the text has no letter."""
    words = _LETTERS.findall(text.lower())
    return words if any(c.isalpha() for word in words for c in word) else []  # "²" is no letter


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Columns of the weights: prefixes, suffixes and n-grams by hash, the word itself if the lexicon has it."""
    marked = f"<{word}>"
    names = [*("p" + word[:k] for k in (1, 2, 3)), *("s" + word[-k:] for k in (1, 2, 3))]
    names += [marked[i : i + 3] for i in range(len(marked) - 2)]
    out = [zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names]
    if (own := lexicon.get(word)) is not None:
        out.append(BUCKETS + own)
    return out


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # log transition scores
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission score of each word and language."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        rows = [features(word, self.lexicon) for word in words]
        at = np.cumsum([0, *(len(row) for row in rows[:-1])])
        return np.add.reduceat(self.weights[np.concatenate([np.array(row) for row in rows])], at, axis=0)


def forward_backward(emission: list[np.ndarray], moves: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Probabilities of each word's labels, for all sequences at once.

    ``emission`` has positive factors, words x labels, one array a sequence. Sequences advance together from the
    longest to the shortest; the ones that have ended drop out.
    """
    order = sorted(range(len(emission)), key=lambda i: -len(emission[i]))
    order = [i for i in order if len(emission[i])]
    out = [np.zeros_like(e) for e in emission]
    if not order:
        return out
    lengths = np.array([len(emission[i]) for i in order])
    longest, labels = lengths[0], len(start)
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
    first = np.concatenate([[0], np.cumsum(active)])
    where = [first[:n] + row for row, n in enumerate(lengths)]  # places of a sequence's words, word by word
    flat = np.empty((first[-1], labels), np.float32)
    for row, i in enumerate(order):
        flat[where[row]] = emission[i]
    ahead = np.empty_like(flat)
    a = flat[: first[1]] * start
    for t in range(longest):
        if t:
            a = (a[: active[t]] @ moves) * flat[first[t] : first[t + 1]]
        a = a / a.sum(1, keepdims=True)
        ahead[first[t] : first[t + 1]] = a
    back = moves.T.copy()
    b = np.ones((0, labels), np.float32)
    for t in range(longest - 1, -1, -1):
        grown = np.ones((active[t], labels), np.float32)
        if len(b):
            step = (b * flat[first[t + 1] : first[t + 2]]) @ back
            grown[: len(b)] = step / step.sum(1, keepdims=True)
        b = grown
        both = ahead[first[t] : first[t + 1]] * b
        ahead[first[t] : first[t + 1]] = both / both.sum(1, keepdims=True)
    for row, i in enumerate(order):
        out[i] = ahead[where[row]]
    return out


def factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30)).astype(np.float32) if len(scores) else scores


def joined(texts: list[tuple[str, list[str]]], rng: np.random.Generator) -> tuple[list[list[str]], list[list[str]]]:
    """Sequences of words and their languages: the segments of all texts, with changes of language between some."""
    pools: dict[str, list[list[str]]] = {}
    for language, words in texts:
        pools.setdefault(language, []).extend(words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT))
    for pool in pools.values():
        rng.shuffle(pool)
    sequences, labels = [], []
    while pools:
        names, words, marks = sorted(pools), [], []
        language = names[rng.integers(len(names))]
        for _ in range(SEGMENTS):
            if rng.random() < SWITCH or language not in pools:
                if not pools:
                    break
                names = sorted(pools)
                language = names[rng.integers(len(names))]
            segment = pools[language].pop()
            words += segment
            marks += [language] * len(segment)
            if not pools[language]:
                del pools[language]
        sequences.append(words)
        labels.append(marks)
    return sequences, labels


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model of (language, text) pairs by gradient ascent on the conditional likelihood; None without words."""
    read = [(language, words) for language, text in texts if (words := words_of(text))]
    languages = sorted({language for language, _ in read})
    if not languages:
        return None
    counts = Counter(word for _, words in read for word in words)
    common = sorted((word for word, n in counts.items() if n >= 3), key=lambda w: (-counts[w], w))[:LEXICON]
    lexicon = {word: i for i, word in enumerate(common)}
    sequences, labels = joined(read, np.random.default_rng(seed))
    vocabulary = {word: i for i, word in enumerate(sorted(counts))}
    rows = [features(word, lexicon) for word in vocabulary]
    columns = np.concatenate([np.array(row) for row in rows])
    sizes = np.array([len(row) for row in rows])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n, k = BUCKETS + len(lexicon), len(languages)
    code = {language: i for i, language in enumerate(languages)}
    ids = [np.array([vocabulary[w] for w in words]) for words in sequences]
    truth = [np.array([code[x] for x in marks]) for marks in labels]
    every, right = np.concatenate(ids), np.concatenate(truth)
    model = Model(languages, lexicon, np.zeros((n, k)), np.zeros((k, k)), np.ones(k, np.float32) / k)
    changes = np.zeros((k, k))
    for marks in truth:
        np.add.at(changes, (marks[:-1], marks[1:]), 1)
    speed = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    for _ in range(STEPS):
        scores = np.add.reduceat(model.weights[columns], at, axis=0)
        moves = np.exp(model.moves).astype(np.float32)
        likely = forward_backward([factors(scores[x]) for x in ids], moves, model.start)
        wrong = -np.concatenate(likely)
        wrong[np.arange(len(right)), right] += 1
        by_word = np.stack([np.bincount(every, wrong[:, j], len(vocabulary)) for j in range(k)], 1)
        spread = np.repeat(by_word, sizes, axis=0)
        steep = np.stack([np.bincount(columns, spread[:, j], n) for j in range(k)], 1) - DECAY * len(every) * model.weights
        expected = np.zeros((k, k))
        for x, p in zip(ids, likely, strict=True):
            pair = p[:-1, :, None] * moves * (factors(scores[x])[1:] * 1.0)[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0) if len(pair) else 0
        for j, (value, slope) in enumerate(((model.weights, steep), (model.moves, changes - expected))):
            speed[j] += slope**2
            value += WIDTH * slope / (np.sqrt(speed[j]) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


def sample(docs: DataFrame, training: Column) -> list[tuple[str, str]]:
    """(language, text) of at most about PER_LANGUAGE training rows a language, chosen by a hash of the id.

    Of a longer text LEARNED characters are learned from; predictions are of whole texts.
    """
    labelled = docs.select("doc_id", F.substring("text", 1, LEARNED).alias("text"), "lang").filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(labelled.groupBy("lang").count().collect())
    if not counts:
        return []
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, F.lit(PER_LANGUAGE / n)).otherwise(share)
    chosen = labelled.filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = chosen.select("lang", "text", "doc_id").limit(2 * PER_LANGUAGE * len(counts)).collect()
    return [(row.lang, row.text) for row in sorted(rows, key=lambda r: (str(r.doc_id), r.text))]


class Labeller:
    """The model of one worker, with the emissions of recent words."""

    def __init__(self, model: Model):
        self.model = model
        self.moves = np.exp(model.moves).astype(np.float32)
        self.known: dict[str, int] = {}
        self.factors = np.zeros((0, len(model.languages)), np.float32)

    def label(self, texts: list[str]) -> list[np.ndarray]:
        """Each word's probabilities."""
        read = [words_of(text) for text in texts]
        new = list(set().union(*read).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(set().union(*read))
            self.factors = self.factors[:0]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        if new:
            self.factors = np.concatenate([self.factors, factors(self.model.scores(new)).astype(np.float32)])
        rows = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in read]
        return forward_backward([self.factors[row] for row in rows], self.moves, self.model.start)


RUN = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def runs(likely: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words with the same most likely label."""
    best = likely.argmax(1)
    ends = [*(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)] if len(best) else []
    return [{"lang": languages[best[end - 1]], "start": start, "end": end} for start, end in zip([0, *ends], ends, strict=False)]


def language_id(docs: DataFrame, training: Column, learn: DataFrame | None = None) -> DataFrame:
    """doc_id, lang_pred, score, runs array<struct<lang, start, end>> (by word) for each row of ``docs``.

    Only text and non-null lang of rows of ``learn`` (or else ``docs``) for which ``training`` holds are learned from. ``lang_pred`` is ``und`` with
    score 0 if the text is null or has no letter, or if there is nothing to learn from; ``score`` is the predicted
    language's mean probability over words. Ids may be null or repeat; other columns are not looked at.
    """
    model = fit(sample(docs if learn is None else learn, training))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = broadcast_key("language", shared)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labeller = once(key, lambda: Labeller(model)) if model else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column("text").to_pylist()
                likely = labeller.label(texts) if model else [np.zeros((0, 1))] * len(texts)
                sums = [p.sum(0) for p in likely]
                names = [model.languages[int(s.argmax())] if len(p) else UNKNOWN for s, p in zip(sums, likely, strict=True)]
                score = [min(1.0, float(s.max()) / len(p)) if len(p) else 0.0 for s, p in zip(sums, likely, strict=True)]
                found = [runs(p, model.languages) if len(p) else [] for p in likely]
                arrays = [pa.array(names), pa.array(score, pa.float64()), pa.array(found, pa.list_(RUN))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "lang_pred", "score", "runs"])

    rows = doc_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, labelled, f"doc_id {kind}, lang_pred string, score double, runs array<struct<lang: string, start: int, end: int>>", BATCH_BYTES)
