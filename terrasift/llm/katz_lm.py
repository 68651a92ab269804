"""Katz backoff model of whole texts.

Tokens are words and an end. A text's probability is the product over tokens of P(word | word before): the discounted
share of the pair if training has it, else the backoff weight of the word before times P(word). Counts of pairs are
discounted by Good-Turing; backoff weights make each context's probabilities sum to 1 exactly. P(word) is the add-one
share (count + 1) / (N + V + 1).

Every word and every pair of words counts; nothing that grows with the vocabulary is broadcast or collected. If
VOCABULARY is set, only so many of the most frequent words count as themselves, and all others as one shared word,
whose add-one mass they divide by their exact counts.

Words are known by 64-bit hashes. A pass over the texts sends each slice's distinct pairs, packed by bucket, to tables
of pair types; the places of a slice's pairs stay packed. Pairs are dealt over a square of buckets, by the second word
one way and by the first the other, so that a frequent word is in many buckets, yet none in all. Buckets ask the
partitioned tables of words for counts, then those of contexts for backoff weights, and send each slice of documents its
sums. A pair that more than PLACES documents of a slice hold sends its bucket one place for the slice; which documents
these are stays with the slice. So no bucket gets a place for each document, however frequent a pair is.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrasift.llm.common import lean_table, lower_words, map_batches, written

#: Words that count as themselves at most; None: all.
VOCABULARY: int | None = None
#: Hashes of the word that stands for all others, of the end, and of what shared words are counted behind.
UNKNOWN, END, SHARED = np.uint64(0), np.uint64(1), np.uint64(2)
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Buckets of a table at least, and bytes of text for each.
BUCKETS, BUCKET_BYTES = 64, 20_000_000
#: Documents of a slice; words that a task counts before it sends them on; words whose hashes it remembers from slice to slice.
SLICE, COUNTED, REMEMBERED = 2048, 400_000, 100_000
#: Bytes of text of a slice at most, but for a text that is longer by itself.
SLICE_BYTES = 8_000_000
#: Places of a pair that a slice sends at most.
PLACES = 16
PACKED = "kind string, bucket int, part int, slice long, a binary, b binary, ids array<{0}>"
NAMES = ["kind", "bucket", "part", "slice", "a", "b", "ids"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by planes of their bytes, integers as narrow as they can be."""
    out = []
    for x in arrays:
        if x.dtype.kind in "iu":
            x = x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
        kind = x.dtype.newbyteorder("<").str.encode()
        planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T)
        out += [kind, len(x).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        kind = np.dtype(data[at : at + 3].decode())
        n = int.from_bytes(data[at + 3 : at + 11], "little")
        size = n * kind.itemsize
        planes = np.frombuffer(data, np.uint8, size, at + 11).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 11 + size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers."""
    return np.diff(x, prepend=x.dtype.type(0))


def parts(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges each hash lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's factors for counts 0..DISCOUNTED + 1 from the numbers of pairs with each count (the last stands for 1).

    Where Good-Turing gives nothing usable, as for few pairs, the factor is (r - 0.5) / r.
    """
    out = np.ones(DISCOUNTED + 2)
    k, once = DISCOUNTED, n.get(1, 0)
    rest = (k + 1) * n.get(k + 1, 0) / once if once else 1.0
    for r in range(1, k + 1):
        value = math.nan
        if n.get(r) and n.get(r + 1) and rest < 1:
            value = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest)
        out[r] = value if 0 < value < 1 else (r - 0.5) / r
    return out


@dataclass
class Backoff:
    """Per context: what seen pairs are multiplied by (with their discounted counts), and the weight of the rest."""

    scale: np.ndarray
    weight: np.ndarray


@dataclass
class Model:
    """What all tasks know."""

    tokens: int  # N
    words: int  # V
    shared_mass: int  # add-one mass of the shared word
    discount: np.ndarray

    def kept(self, n: np.ndarray) -> np.ndarray:
        return n * self.discount[np.minimum(n, DISCOUNTED + 1)]

    def unigram(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(word == UNKNOWN, self.shared_mass, n + 1.0) / (self.tokens + self.words + 1)


def backoff(kept: np.ndarray, seen: np.ndarray, total: np.ndarray) -> Backoff:
    """Weights that normalise each context exactly.

    ``kept``: sum of discounted counts; ``seen``: P of the words seen behind it; ``total``: its count. A context all of
    whose counts stay undiscounted gives up one more token; one that has seen every word gives its whole mass to them.
    """
    known = total > 0
    base = np.where(known & (total - kept < 1e-9), total + 1, np.maximum(total, 1))
    rest = 1 - seen
    full = known & (rest < 1e-12)
    scale = np.where(full, 1 / np.maximum(kept, 1e-300), 1 / base)
    weight = np.where(known, (1 - kept / base) / np.where(full, 1, rest), 1.0)
    return Backoff(scale, np.where(full, 0, weight))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over the texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
            n.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                n.update(lower_words(text.as_py()))
                if len(n) >= COUNTED:
                    yield rows()
        yield rows()

    return map_batches(docs.select("text"), counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_vocabulary(words: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of the most frequent words, all above the least count that leaves VOCABULARY at most, and how many others there are."""
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    running = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = by_count.withColumn("so_far", running).filter(F.col("so_far") <= VOCABULARY).agg(F.min("n")).first()[0]
    own = words.filter(F.col("n") >= least).select("word").toPandas()["word"] if least else []
    return np.array(sorted(map(xxhash.xxh3_64_intdigest, own)), np.uint64), words.count() - len(own)


def pack_types(w: np.ndarray, a: np.ndarray, n: np.ndarray) -> bytes:
    """Words, contexts and counts of pairs in the order of words."""
    runs, (contexts, which) = starts(w), np.unique(a, return_inverse=True)
    return pack(steps(w[runs]), np.diff(np.append(runs, len(w))), steps(contexts), which, n)


def types_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, runs, contexts, which, n = unpack(data)
    words, contexts = (np.cumsum(x, dtype=np.uint64) for x in (words, contexts))
    return np.repeat(words, runs), contexts[which], n.astype(np.int64)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of at most SLICE rows and SLICE_BYTES of text."""
    begin = size = 0
    for at, more in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if at > begin and (at - begin == SLICE or size + more > SLICE_BYTES):
            yield batch.slice(begin, at - begin)
            begin, size = at, 0
        size += more
    if begin < batch.num_rows:
        yield batch.slice(begin)


class Slicer:
    """Counts of a slice of documents, packed for the tables."""

    def __init__(self, own: np.ndarray | None, buckets: int):
        self.own, self.buckets, self.hashes = own, buckets, Hashes()

    def slice(self, texts: list[str], training: list[bool]) -> Iterator[tuple]:
        """(kind, bucket, a, b): pairs of each bucket with their places, and the documents with those of frequent pairs."""
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        found, sizes = [], []
        for text in texts:
            words = lower_words(text)
            found += [np.array([END]), np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))]
            sizes.append(len(words) + 1)
        flat = np.concatenate([*found, np.array([END])])  # an end is the context of the first token
        del found
        rows, shared, more = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.zeros(len(flat), bool), []
        if self.own is not None:
            shared = ~np.isin(flat, self.own) & (flat != END)
            more = [flat[1:][shared[1:]], np.array([SHARED])]
            flat = np.where(shared, UNKNOWN, flat)
        names, number = np.unique(np.concatenate([flat, *more]) if more else flat, return_inverse=True)
        number, behind = number.astype(np.uint32), len(flat)
        del flat
        context, word, at = number[: behind - 1], number[1:behind], rows
        if more:  # shared words are counted by themselves, too
            exact = number[behind:-1]
            context, word, at = np.concatenate([context, np.repeat(number[-1:], len(exact))]), np.concatenate([word, exact]), np.concatenate([rows, rows[shared[1:]]])
        frequent = yield from self.packed(names, context, word, at, np.array(training, bool))
        yield "text", 0, pack(np.array(sizes, np.int64), np.bincount(rows, shared[1:], len(sizes)).astype(np.int64)), frequent

    def packed(self, names: np.ndarray, a: np.ndarray, w: np.ndarray, rows: np.ndarray, training: np.ndarray) -> Iterator[tuple]:
        """Rows of buckets of contexts and words, places in ``names``; returns the places of frequent pairs, each of which is one more document to its bucket."""
        n_names, n_rows = np.uint64(len(names)), np.uint64(SLICE)
        posts = w.astype(np.uint64)  # in place, as this is what a task's memory goes to
        posts *= n_names
        posts += a
        posts *= n_rows
        posts += rows.astype(np.uint64)
        posts.sort()
        first = starts(posts)
        n = np.diff(first, append=len(posts)).astype(np.int32)
        posts = posts[first]
        row, pair = (posts % n_rows).astype(np.int32), posts // n_rows
        del posts, a, w
        first = starts(pair)
        trained = np.add.reduceat(n * training[row], first, dtype=np.int64)
        sizes = np.diff(np.append(first, len(pair)))
        often = sizes > PLACES
        frequent, which = np.repeat(often, sizes), pair[first]
        kept = pack(sizes[often], row[frequent], n[frequent])
        row[first[often]], n[first[often]] = len(training) + np.arange(often.sum()), 1
        sent = ~frequent
        sent[first[often]] = True
        row, n, sizes = row[sent], n[sent], np.where(often, 1, sizes)
        first = np.cumsum(sizes) - sizes
        a, w = names[(which % n_names).astype(np.int64)], names[(which // n_names).astype(np.int64)]
        side, mix = math.isqrt(self.buckets), np.uint64(0x9E3779B97F4A7C15)  # the low bits tell, the high ones are the tables' parts
        bucket = (parts(w * mix, side) * np.uint64(side) + parts(a * mix, side)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")  # still by word and context within a bucket
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            own = order[ends[b] : ends[b + 1]]
            if len(own):
                begin = np.repeat(first[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own])
                at = begin + np.arange(len(begin))
                yield "pair", b, pack_types(w[own], a[own], trained[own]), pack(sizes[own], row[at], n[at])
        return kept


def merged(table: pa.Table) -> Iterator[tuple]:
    """(kind, slice, a, b): a bucket's pair types in the order of words and contexts, and each slice's pairs among them."""
    w, a, n = zip(*(types_of(keys.as_py()) for keys in table.column("a")), strict=True)
    ends = np.cumsum([len(x) for x in w])
    w, a, n = map(np.concatenate, (w, a, n))
    order = np.lexsort((a, w))
    w, a, n = w[order], a[order], n[order]
    first = starts(w, a)
    type_of = np.empty(len(order), np.int64)
    type_of[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    types = pack_types(w[first], a[first], np.add.reduceat(n, first))
    del w, a, n, order
    yield "types", None, types, None
    for which, s, places in zip(np.split(type_of, ends[:-1]), table.column("slice").to_pylist(), table.column("b").to_pylist(), strict=True):
        yield "post", s, pack(steps(which)), places


def asked(kind: str, bucket: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Rows that ask the parts of a table for the sums of ascending keys."""
    ends = np.searchsorted(parts(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
    for p in range(buckets):
        if ends[p] < ends[p + 1]:
            part = slice(ends[p], ends[p + 1])
            yield kind, bucket, p, None, pack(steps(keys[part])), pack(*(x[part] for x in values)), None


def summed(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys of all that ask a part, the sums of each value, and where each asker's keys are."""
    keys = [np.cumsum(unpack(x.as_py())[0], dtype=np.uint64) for x in table.column("a")]
    values = zip(*(unpack(x.as_py()) for x in table.column("b")), strict=True)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(where, np.concatenate(x).astype(float), len(distinct)) for x in values]
    return distinct, sums, np.split(where, np.cumsum([len(x) for x in keys])[:-1])


def answers(table: pa.Table, kind: str) -> list[np.ndarray]:
    """What a bucket's asking has brought, in the order of its keys."""
    rows = sorted((r["part"], r["b"]) for r in table.select(["kind", "part", "b"]).to_pylist() if r["kind"] == kind)
    return [np.concatenate(x) for x in zip(*(unpack(b) for _, b in rows), strict=True)]


def learn_discounts(types: DataFrame) -> np.ndarray:
    """From how many pairs have each count up to DISCOUNTED + 1."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(DISCOUNTED + 2, np.int64)
        for batch in batches:
            for data in batch.column("a"):
                _, a, total = types_of(data.as_py())
                n += np.bincount(total[(total <= DISCOUNTED + 1) & (a != SHARED)], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n)], ["r", "n"])

    found = map_batches(types.select("a"), counted, "r int, n long").groupBy("r").agg(F.sum("n").alias("n"))
    return discounts({row.r: row.n for row in found.collect() if row.r})


def katz_scores(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a null or empty text is an end alone.
    ``training`` says which rows are learned from. ``base_score`` is the log10 probability under add-one shares of
    single tokens, ``score`` the one under the backoff model; without training rows they are the same. Ids may be null
    or repeat, each row is scored by itself; an empty table gives an empty one; other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    kind_of_id = texts.schema["doc_id"].dataType.simpleString()
    schema, arrow_id = PACKED.format(kind_of_id), to_arrow_type(texts.schema["doc_id"].dataType)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(arrow_id)]
    own, shared_words = learn_vocabulary(written(count_words(texts.filter("training")))) if VOCABULARY is not None else (None, 0)
    head = spark.sparkContext.broadcast(own)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = math.isqrt(max(BUCKETS, size // BUCKET_BYTES)) ** 2

    def arrays(rows: list[tuple]) -> list[pa.Array]:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
        return [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slicer, n = Slicer(head.value, buckets), TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                rows = slicer.slice(part.column("text").to_pylist(), part.column("training").to_pylist())
                out = [(kind, n % buckets if kind == "text" else b, None, n, x, y, ids if kind == "text" else None) for kind, b, x, y in rows]
                yield pa.RecordBatch.from_arrays(arrays(out), NAMES)
                n += 1

    def gathered(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == "text":
            return table.select(NAMES)
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_arrays(arrays([(kind, bucket, None, s, x, y, None) for kind, s, x, y in merged(table)]), NAMES)

    held = written(map_batches(texts, sliced, schema).groupBy("kind", "bucket").applyInArrow(lean_table(gathered), schema))
    types = held.filter("kind = 'types'")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("a").to_pylist(), strict=True):
                w, a, n = types_of(data)
                w, n = w[a != SHARED], n[a != SHARED]
                first = starts(w) if len(w) else []
                rows = list(asked("word", bucket, buckets, w[first], np.add.reduceat(n, first))) if len(w) else []
                yield pa.RecordBatch.from_arrays(arrays(rows), NAMES)

    def tell_words(table: pa.Table) -> pa.Table:
        words, (n,), places = summed(table)
        rows = [("word", b, p, None, None, pack(n[at].astype(np.int64)), None) for b, p, at in zip(table.column("bucket").to_pylist(), table.column("part").to_pylist(), places, strict=True)]
        facts = np.array([n.sum(), ((n > 0) & (words != UNKNOWN)).sum(), n[words == UNKNOWN].sum()], np.int64)
        return pa.Table.from_arrays(arrays([*rows, ("facts", None, None, None, pack(facts), None, None)]), NAMES)

    counts = written(map_batches(types.select("bucket", "a"), ask_words, schema).groupBy("part").applyInArrow(lean_table(tell_words), schema))
    facts = [unpack(r.a)[0].astype(np.int64) for r in counts.filter("kind = 'facts'").select("a").collect()]  # one for each part
    tokens, words, unknown = (int(x) for x in np.sum(facts, axis=0)) if facts else (0, 0, 0)
    words += shared_words
    model = Model(tokens, words, unknown + shared_words + 1, learn_discounts(types))
    counts = counts.filter("kind = 'word'")

    def with_counts(table: pa.Table) -> tuple[np.ndarray, ...]:
        """A bucket's pair types, their words' training counts, and which are pairs."""
        w, a, n = types_of(next(r["a"] for r in table.select(["kind", "a"]).to_pylist() if r["kind"] == "types"))
        pair, count = a != SHARED, n.copy()  # a shared word's is in one bucket
        if pair.any():
            distinct = w[pair][starts(w[pair])]
            count[pair] = answers(table, "word")[0].astype(np.int64)[np.searchsorted(distinct, w[pair])]
        return w, a, n, count, pair

    def ask_contexts(table: pa.Table) -> pa.Table:
        w, a, n, count, pair = with_counts(table)
        w, a, n, count = (x[pair] for x in (w, a, n, count))
        contexts, which = np.unique(a, return_inverse=True)
        sums = [np.bincount(which, x, len(contexts)) for x in (n, model.kept(n), model.unigram(w, count) * (n > 0))]
        return pa.Table.from_arrays(arrays(list(asked("context", table.column("bucket")[0].as_py(), buckets, contexts, *sums))), NAMES)

    def tell_contexts(table: pa.Table) -> pa.Table:
        _, (total, kept, seen), places = summed(table)
        found = backoff(kept, seen, total)
        rows = [("context", b, p, None, None, pack(found.scale[at], found.weight[at]), None) for b, p, at in zip(table.column("bucket").to_pylist(), table.column("part").to_pylist(), places, strict=True)]
        return pa.Table.from_arrays(arrays(rows), NAMES)

    weights = types.unionByName(counts).groupBy("bucket").applyInArrow(lean_table(ask_contexts), schema).groupBy("part").applyInArrow(lean_table(tell_contexts), schema)

    def scored(table: pa.Table) -> pa.Table:
        w, a, n, count, pair = with_counts(table)
        base = np.where(w == UNKNOWN, 0, np.log10(count + 1.0))
        known, log = (count > 0) & (w != UNKNOWN), base.copy()
        if pair.any():
            _, which = np.unique(a[pair], return_inverse=True)
            scale, weight = (x[which] for x in answers(table, "context"))
            with np.errstate(divide="ignore"):
                log[pair] = np.where(n[pair] > 0, np.log10(model.kept(n[pair]) * scale), np.log10(weight * model.unigram(w[pair], count[pair])))
        out = []
        behind_shared = (a == SHARED) | (w != UNKNOWN)
        base, known = base * behind_shared, known & behind_shared
        at = [i for i, kind in enumerate(table.column("kind").to_pylist()) if kind == "post"]
        slices, which, places = (table.column(x) for x in ("slice", "a", "b"))
        for i in at:
            types = np.cumsum(unpack(which[i].as_py())[0], dtype=np.int64)
            sizes, row, times = unpack(places[i].as_py())
            rows, where = np.unique(row, return_inverse=True)
            types, times = np.repeat(types, sizes), times.astype(float)
            sums = [np.bincount(where, x[types] * times, len(rows)) for x in (log, base, known)]
            out.append(("sum", None, None, slices[i].as_py(), pack(rows), pack(*sums[:2], sums[2].astype(np.int64)), None))
        return pa.Table.from_arrays(arrays(out), NAMES)

    def finished(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        text = next(row for row in rows if row["kind"] == "text")
        n, shared = (x.astype(np.int64) for x in unpack(text["a"]))
        sizes, held_by, times = (x.astype(np.int64) for x in unpack(text["b"]))
        sums = np.zeros((3, len(n) + len(sizes)))
        for row in rows:
            if row["kind"] == "sum":
                (at,), values = unpack(row["a"]), unpack(row["b"])
                sums[:, at] += np.array(values)
        pair = np.repeat(len(n) + np.arange(len(sizes)), sizes)
        score, base, known = (x[: len(n)] + np.bincount(held_by, x[pair] * times, len(n)) for x in sums)
        score, known = score - shared * math.log10(model.shared_mass), np.rint(known).astype(np.int64)
        base = base - n * math.log10(tokens + words + 1)
        columns = [pa.array(text["ids"], arrow_id), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(score if tokens else base)]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sums = held.filter("kind != 'text'").unionByName(counts).unionByName(weights).groupBy("bucket").applyInArrow(lean_table(scored), schema)
    result = f"doc_id {kind_of_id}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return held.filter("kind = 'text'").unionByName(sums).groupBy("slice").applyInArrow(lean_table(finished), result)
