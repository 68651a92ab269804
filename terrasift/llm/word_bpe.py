"""BPE with word ends, for texts of any length: halves are encoded apart and joined exactly.

White space parts words for the normalizer, the split pattern and special tokens alike, so words are encoded one by one
and recent ones are remembered. What the pattern leaves whole (a piece) may still be as long as a text without spaces.
A piece over ``LONG`` symbols is halved until its leaves are short enough; leaves are rows of their own, encoded in
parallel. Neighbours are then joined round by round: the last tokens of the left half and the first of the right one are
encoded anew as one string, in a window that grows until its first and last tokens are those that were there. As each
token of such a vocabulary is merged before anything that it is part of, a sequence of tokens is the encoding of its
text if each two neighbours are the encoding of theirs; so a window whose ends agree makes the join exact.

The vocabulary is a file of fixed size; the driver reads it and broadcasts it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import BATCH_BYTES, broadcast_key, doc_texts, map_batches, once, written

#: Symbols of a piece that is encoded at once.
LONG = 2048
#: Words that a worker remembers; when they are more, the half that was met first stays: the frequent ones.
REMEMBERED = 300_000
#: Rows of an Arrow batch that are encoded together.
TOGETHER = 500
#: What an encoder can give of a text, and its type: ids, ids as little-endian 32-bit integers, what they decode to.
COLUMNS = {"ids": "array<int>", "packed": "binary", "decoded": "string"}
_PART = "rid long, part int, leaf int, leaves int, symbols string, ids array<int>"


class WordBpe:
    """Encoder and decoder of one worker, over the tokenizers library."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(definition)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: at for at, (a, b) in enumerate(merges)}
        if len(made) < len(merges) or any(max(made.get(a, -1), made.get(b, -1)) > at for at, (a, b) in enumerate(merges)):
            raise ValueError("a token is merged in two ways, or after one that it is part of")
        self.end = model["end_of_word_suffix"] or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: For what stands before a word's end, and for the end.
        self.inner = models.BPE(vocab=vocabulary, merges=merges)
        self.last = models.BPE(vocab=vocabulary, merges=merges, end_of_word_suffix=self.end) if self.end else self.inner
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.parts = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = dict.fromkeys(range(max(names.values()) + 1), "")
        self.token.update({i: name for name, i in names.items()})
        self.known: dict[bytes, tuple[bytes, str]] = {}

    def decode(self, ids: list[int]) -> str:
        """What the library's ``decode`` gives for a vocabulary without a decoder: tokens with spaces between them."""
        return " ".join([self.token[i] for i in ids])

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """The ids and their tokens, of texts whose words aren't long."""
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        known, split = self.known, [text.split() for text in texts]
        new = list({word for words in split for word in words if word not in known})
        for word, coded in zip(new, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False), strict=True):
            known[word] = (np.array(coded.ids, "<u4").tobytes(), self.decode(coded.ids))
        out = []
        for words in split:
            found = [known[word] for word in words]
            out.append((b"".join([ids for ids, _ in found]), " ".join([tokens for _, tokens in found if tokens])))
        return out

    def pieces(self, text: str) -> Iterator[list[int] | str]:
        """The parts of a text in order: ids of what is short, and long pieces as strings of symbols."""
        short: list[int] = []
        for word in text.encode("utf-8", "surrogatepass").split():
            if len(word) <= LONG:
                short += np.frombuffer(self.encode([word])[0][0], "<u4").tolist()
                continue
            for part in self.parts.split(word.decode("utf-8", "replace")):
                if not part:
                    continue
                if part in self.special:
                    short.append(self.special[part])
                    continue
                for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    if len(symbols) <= LONG:
                        short += [t.id for t in self.last.tokenize(symbols)]
                    else:
                        if short:
                            yield short
                            short = []
                        yield symbols
        if short:
            yield short

    def symbols(self, ids: list[int], last: bool) -> str:
        """The symbols of tokens, without the mark of the word's end."""
        joined = "".join([self.token[i] for i in ids])
        return joined.removesuffix(self.end) if last and self.end else joined

    def leaf(self, symbols: str, last: bool) -> list[int]:
        return [t.id for t in (self.last if last else self.inner).tokenize(symbols)]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The ids of two neighbours' text; ``last`` if the word ends there."""
        if not left or not right:
            return left or right
        size = 2
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            window = left[-a:] + right[:b]
            at_end = last and b == len(right)
            found = self.leaf(self.symbols(window, at_end), at_end)
            if (a == len(left) or found[0] == window[0]) and (b == len(right) or found[-1] == window[-1]):
                return left[:-a] + found + right[b:]
            size *= 2


def _worker(definition: Broadcast) -> WordBpe:
    return once(broadcast_key("word-bpe", definition), lambda: WordBpe(definition.value))


def _arrays(coded: list[tuple[bytes, str]], columns: tuple[str, ...]) -> list[pa.Array]:
    made = {
        "ids": lambda: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(ids) // 4 for ids, _ in coded)]).astype("<i4")), pa.array(np.frombuffer(b"".join([ids for ids, _ in coded]), "<i4"))),
        "packed": lambda: pa.array([ids for ids, _ in coded], pa.binary()),
        "decoded": lambda: pa.array([tokens for _, tokens in coded], pa.string()),
    }
    return [made[c]() for c in columns]


def leaves_of(symbols: str) -> list[str]:
    """Halves of halves, of at most LONG symbols each; as many as a power of two."""
    parts = [symbols]
    while max(map(len, parts)) > LONG:
        parts = [half for part in parts for half in (part[: len(part) // 2], part[len(part) // 2 :])]
    return parts


def _tree(docs: DataFrame, definition: Broadcast) -> DataFrame:
    """rid, ids of texts with long words, by way of their leaves."""

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(definition)
        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = []
                for part, piece in enumerate(bpe.pieces(text)):
                    parts = leaves_of(piece) if isinstance(piece, str) else [None]
                    rows += [(rid, part, leaf, len(parts), symbols, None if symbols is not None else piece) for leaf, symbols in enumerate(parts)]
                if rows:
                    yield _batch(rows)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(definition)
        for batch in batches:
            rows = [(*row[:4], None, row[5] if row[4] is None else bpe.leaf(row[4], row[2] + 1 == row[3])) for row in zip(*batch.to_pydict().values(), strict=True)]
            if rows:
                yield _batch(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(definition)
        for batch in batches:
            rows = []
            for rid, part, leaf, leaves, halves in zip(*(batch.column(c).to_pylist() for c in ("rid", "part", "leaf", "leaves", "halves")), strict=True):
                ids = [half["ids"] for half in halves]
                rows.append((rid, part, leaf, leaves, None, ids[0] if len(ids) == 1 else bpe.join(*ids, leaf + 1 == leaves)))
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["rid", "part", "leaf", "leaves", "symbols", "ids"])

    parts = map_batches(docs.select("rid", "text"), parted, _PART, BATCH_BYTES).repartition("rid", "part", "leaf")
    now = written(map_batches(parts, encoded, _PART, BATCH_BYTES).drop("symbols"))
    while (now.agg(F.max("leaves")).first()[0] or 1) > 1:
        half = F.floor(F.col("leaf") / 2).cast("int").alias("leaf"), F.ceil(F.col("leaves") / 2).cast("int").alias("leaves")
        pairs = now.select("rid", "part", *half, F.struct("leaf", "ids").alias("at"))
        pairs = pairs.groupBy("rid", "part", "leaf", "leaves").agg(F.sort_array(F.collect_list("at")).alias("halves"))
        now = written(map_batches(pairs, joined, _PART, BATCH_BYTES).drop("symbols"))
    inside = F.sort_array(F.collect_list(F.struct("part", "ids")))
    return now.groupBy("rid").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def word_bpe_encode(docs: DataFrame, definition: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id and ``columns`` out of COLUMNS: one row for each row of ``docs``.

    ``definition`` is a file of the tokenizers library with a BPE model, as JSON. Special tokens that a text spells out
    are single ids; none are added. A null or empty text, or one of white space alone, has no ids and decodes to the empty
    text. Ids of documents may be null or repeat, and other columns aren't looked at. Texts are read whole; only
    those with a word of over LONG bytes take the way by leaves, and a shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    rows = doc_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                coded = bpe.encode(batch.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_arrays(coded, columns)], ["doc_id", *columns])

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The columns of ids that leaves led to."""
        bpe = _worker(shared)
        for batch in batches:
            coded = [(np.array(ids, "<u4").tobytes(), bpe.decode(ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_arrays(coded, columns)], ["doc_id", *columns])

    schema = f"doc_id {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    # fewer characters than LONG may still be more bytes: a character has three at most outside of surrogate pairs
    long = F.col("text").rlike(r"[^\x20\x09-\x0D]{%d}" % (LONG // 4))
    short = map_batches(rows.filter(~long), encoded, schema, BATCH_BYTES)
    rest = written(rows.filter(long).withColumn("rid", F.monotonically_increasing_id()))
    if rest.isEmpty():
        return short
    found = _tree(rest, shared)
    ids = rest.select("rid", "doc_id").join(found, "rid", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return short.unionByName(map_batches(ids, given, schema, BATCH_BYTES))
