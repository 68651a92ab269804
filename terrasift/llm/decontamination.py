"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size; a block's words, seeds and items are broadcast. Every run of SEED words
of an item is a seed, however many documents hold it, so that whether an item is found doesn't depend on other rows.
Seeds join passages to items; the passage around them is aligned with the item, word by word, which also scores
paraphrased or edited copies, unless its words alone show that it can't score enough. The documents are read where
they are: nothing but the hits leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import doc_texts, map_batches

#: Words of a seed.
SEED = 3
#: Words of items in a block.
BLOCK_WORDS = 1_000_000
#: Scores of the alignment, and the share of the best possible score from which on a passage is a leak.
MATCH, OTHER, GAP, LEAK = 2, -1, -1, 0.5
#: So many words of an item in a row are a leak, however long the item is.
RUN = 13

_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, in lower case."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


def codes_of(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each n-gram; -1 if a word isn't in any item."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    total, known = np.zeros(len(ids) - n + 1, np.uint64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        known &= part >= 0
        total = total * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)
    return np.where(known, (total >> np.uint64(1)).astype(np.int64), -1)


@dataclass
class Block:
    """Items of a block as word numbers, and their seeds: sorted codes, and for each the places where it stands."""

    vocabulary: dict[bytes, int]
    item_ids: list
    items: list[np.ndarray]
    code: np.ndarray
    first: np.ndarray  # of a code in the places
    item: np.ndarray
    place: np.ndarray
    width: int = SEED

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a document that hold a seed, and which."""
        codes = codes_of(ids, self.width)
        at = np.flatnonzero(codes >= 0)
        if not len(at) or not len(self.code):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.code, codes[at]), len(self.code) - 1)
        hit = self.code[found] == codes[at]
        return at[hit], found[hit]


def make_block(vocabulary: dict, item_ids: list, items: list[np.ndarray], item: np.ndarray, place: np.ndarray, width: int) -> Block:
    every = [codes_of(ids, width) for ids in items]
    own = np.array([every[i][p] for i, p in zip(item, place, strict=True)], np.int64)
    order = np.lexsort((place, item, own))
    code, first = np.unique(own[order], return_index=True)
    return Block(vocabulary, item_ids, items, code, np.append(first, len(order)), item[order], place[order], width)


def block_of(rows: list[tuple]) -> Block:
    """All n-grams of the items; items shorter than SEED words can't be told from chance and have none."""
    vocabulary: dict[bytes, int] = {}
    items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in rows]
    counts = [max(0, len(ids) - SEED + 1) for ids in items]
    item = np.repeat(np.arange(len(items)), counts)
    place = np.concatenate([np.arange(n) for n in counts]) if counts else np.zeros(0, np.int64)
    return make_block(vocabulary, [item_id for item_id, _ in rows], items, item, place.astype(np.int64), SEED)


def most(item: np.ndarray, passage: np.ndarray) -> int:
    """What no alignment's score exceeds: that of the best stretch of the passage if all words of the item match."""
    total = np.cumsum(np.where(np.isin(passage, item), MATCH, OTHER))
    return int((total - np.minimum(np.minimum.accumulate(total), 0)).max(initial=0)) + MATCH


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment's score, and the first and last place of the passage in it."""
    n = len(passage)
    ramp = -GAP * np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        across = score[:-1] + np.where(passage == word, MATCH, OTHER)
        down = score[1:] + GAP
        new, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        new[1:] = np.maximum(np.maximum(across, down), 0)
        origin[1:] = np.where(new[1:] == 0, origin[1:], np.where(across >= down, start[:-1], start[1:]))
        lifted = np.maximum.accumulate(new + ramp)  # gaps along the passage
        source = np.maximum.accumulate(np.where(new + ramp == lifted, np.arange(n + 1), 0))
        score, start = lifted - ramp, origin[source]
        end = int(score.argmax())
        if score[end] > best[0]:
            best = (int(score[end]), int(start[end]), end - 1)
    return best


def leaks_of(block: Block, text: str) -> list[tuple]:
    """(item_id, score, first word, last word) of the items that leak into a text, the best passage of each."""
    ids = block.numbers(text)
    at, seed = block.seeds(ids)
    if not len(at):
        return []
    sizes = block.first[seed + 1] - block.first[seed]
    row = np.repeat(np.arange(len(at)), sizes)
    entry = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + block.first[seed][row]
    item, begin = block.item[entry], at[row] - block.place[entry]
    order = np.lexsort((at[row], begin, item))
    item, begin, place = item[order], begin[order], at[row][order]
    new = (np.diff(item, prepend=-1) != 0) | (np.diff(begin, prepend=0) != 0) | (np.diff(place, prepend=0) != 1)
    new[0] = True
    heads = np.flatnonzero(new)
    lengths = np.diff(np.append(heads, len(new))) + block.width - 1
    runs = {int(item[h]): (int(n), int(place[h])) for n, h in sorted(zip(lengths, heads, strict=True)) if n >= RUN}  # the longest of each item
    out = []
    for begins, i in zip(np.split(begin, (first := np.flatnonzero(np.diff(item, prepend=-1)))[1:]), item[first], strict=True):
        words = block.items[i]
        slack = max(8, len(words) // 2)
        best = (0, 0, 0)
        groups = np.split(begins, np.flatnonzero(np.diff(begins) > len(words) + 2 * slack) + 1)
        for group in groups:
            low, high = max(0, group[0] - slack), min(len(ids), group[-1] + len(words) + slack)
            if most(words, ids[low:high]) < LEAK * MATCH * len(words):
                continue
            score, start, end = align(words, ids[low:high])
            if score > best[0]:
                best = (score, low + start, low + end)
        share = best[0] / (MATCH * len(words))
        if share >= LEAK:
            out.append((block.item_ids[i], share, int(best[1]), int(best[2])))
        elif i in runs:
            n, start = runs[i]
            out.append((block.item_ids[i], max(share, n / len(words)), start, start + n - 1))
    return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id").toLocalIterator(prefetchPartitions=False):
        words = words_of(row.text)
        if held and size + len(words) > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append((row.item_id, words))
        size += len(words)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: one row for each row of ``docs`` and item that leaks into it.

    ``score`` is the alignment's share of the best possible one, 1 for a verbatim copy; under LEAK only where RUN words of
    the item or more stand in a row, whose places are given. Null and empty texts have no
    leaks, null items and those under SEED words leak nowhere; repeated rows are reported as often as they stand;
    without documents or items the result is empty. Columns other than ids and texts are not looked at.
    """
    spark = docs.sparkSession
    texts = doc_texts(docs)
    kinds = texts.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word int, last_word int"
    out = spark.createDataFrame([], schema)
    item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
    for rows in blocks(benchmark):
        block = block_of(rows)
        chosen = spark.sparkContext.broadcast(block)

        def aligned(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            block = chosen.value
            for batch in batches:
                rows = [(i, *hit) for i, text in enumerate(batch.column("text")) for hit in leaks_of(block, text.as_py())]
                row, item, score, first, last = zip(*rows, strict=True) if rows else ((),) * 5
                ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
                arrays = [ids, pa.array(item, item_type), pa.array(score, pa.float64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "score", "first_word", "last_word"])

        out = out.unionByName(map_batches(texts, aligned, schema))
    return out
