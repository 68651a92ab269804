"""Byte-level BPE: exact merges in linear time, and decoding.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick pass finds the longest vocabulary entry at each place.
The encoder takes the longest entry, falls back to shorter ones, and steps back where none fits. An entry fits behind
its neighbour if merging by rank would leave the border between the two alone; that test depends on the two ids only
and is remembered. Each match of the split pattern is encoded separately, and recent matches are remembered as well.

The vocabulary is a file of fixed size; the driver reads it and broadcasts its tables.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrasift.llm.common import BATCH_BYTES, broadcast_key, doc_texts, map_batches, once

#: Entries of a worker's memories; they start anew when full.
REMEMBERED = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: base64 bytes and their id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_by_rank(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The plain definition: merge the pair of lowest rank, leftmost first, while its rank is under ``below``."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def halves_of(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each id the two ids that it is merged from; a byte has itself. Entries that no merge reaches are left out."""
    found = {}
    for token, rank in ranks.items():
        if len(token) == 1:
            found[rank] = (rank, rank)
        elif len(parts := merge_by_rank(token, ranks, rank)) == 2:
            found[rank] = (ranks[parts[0]], ranks[parts[1]])
    return found


class ByteBpe:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, halves: dict[int, tuple[int, int]] | None = None):
        self.halves = halves_of(ranks) if halves is None else halves
        self.token = {rank: token for token, rank in ranks.items()}
        self.pairs = {both: rank for rank, both in self.halves.items() if len(self.token[rank]) > 1}
        self.split = regex.compile(pattern).findall
        #: Reversed entries: a match that ends at a place of the reversed text starts there in the text.
        self.finder = ahocorasick.Automaton()
        for rank in self.halves:
            self.finder.add_word(self.token[rank].decode("latin-1")[::-1], rank)
        self.finder.make_automaton()
        self.length = {rank: len(token) for rank, token in self.token.items()}
        #: Entries that merging reaches: a piece that is one of them is merged to it.
        self.whole = {self.token[rank]: rank for rank in self.halves}
        self.shorter: dict[int, int] = {}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def prefix(self, rank: int) -> int:
        """The longest other entry that ``rank`` begins with, or -1."""
        if (found := self.shorter.get(rank)) is None:
            token = self.token[rank]
            ranks = (self.id_of(token[:n]) for n in range(len(token) - 1, 0, -1))
            found = self.shorter[rank] = next((r for r in ranks if r >= 0), -1)
        return found

    def id_of(self, token: bytes) -> int:
        return self.finder.get(token.decode("latin-1")[::-1], -1)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border: undo the later merge on either side, and look for an earlier one across."""
        if (known := self.fitting.get((left, right))) is not None:
            return known
        a, b, bound = left, right, 1 << 62
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < bound:
                answer = False
                break
            whole_a, whole_b = self.length[a] == 1, self.length[b] == 1
            if whole_a and whole_b:
                answer = True
                break
            if whole_b or (not whole_a and a > b):
                bound, a = a, self.halves[a][1]
            else:  # of equal ranks the left one is merged first
                bound, b = b + 1, self.halves[b][0]
        if len(self.fitting) >= REMEMBERED // 2:
            self.fitting.clear()
        self.fitting[left, right] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        whole = self.whole.get(piece)
        if whole is not None:
            return [whole]
        length, prefix, fitting = self.length, self.prefix, self.fitting
        # of the matches that end at a place the finder gives the longest first: reversed, it is the one that stays
        longest = dict([*self.finder.iter(piece.decode("latin-1")[::-1])][::-1])
        if len(longest) < n:
            raise ValueError("the vocabulary lacks a byte of the text")
        out, at, dead = [], 0, bytearray(n + 1)
        rank = longest[n - 1] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while rank >= 0:
                if not dead[at + length[rank]]:
                    if last < 0:
                        break
                    fit = fitting.get((last, rank))
                    if self.fits(last, rank) if fit is None else fit:
                        break
                rank = prefix(rank)
            if rank >= 0:
                out.append(rank)
                at += length[rank]
                rank = longest[n - 1 - at] if at < n else -1
            else:  # nothing fits here: this place can't be a border
                dead[at] = 1
                rank = out.pop()
                at -= length[rank]
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        known, out = self.known, []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), "<i4").tobytes()
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)


class Decoder:
    """The entries' bytes one after another, to be picked by ranges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.pool = np.zeros(self.start[-1], np.uint8)
        for token, rank in ranks.items():
            self.pool[self.start[rank] : self.start[rank + 1]] = np.frombuffer(token, np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of ids between ``ends``, as an array of binary values."""
        sizes = self.size[ids]
        behind = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(behind[-1]) + np.repeat(self.start[ids] - behind[:-1], sizes)
        offsets = pa.array(behind[ends].astype(np.int32)).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(self.pool[places])])


def _worker(tables: Broadcast) -> tuple[ByteBpe, Decoder]:
    """This worker's encoder and decoder, built once."""

    def make() -> tuple[ByteBpe, Decoder]:
        ranks, pattern, halves = tables.value
        return ByteBpe(ranks, pattern, halves), Decoder(ranks)

    return once(broadcast_key("bpe", tables), make)


def broadcast_tables(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    ranks = load_ranks(path)
    return spark.sparkContext.broadcast((ranks, pattern, halves_of(ranks)))


def bpe_encode(docs: DataFrame, tables: Broadcast, decode: bool = False) -> DataFrame:
    """doc_id, ids array<int>: one row for each row of ``docs``, without a shuffle.

    With ``decode`` also ``decoded``, the bytes that the ids stand for. A null or empty text has no ids; ids of documents
    may be null or repeat; other columns are not looked at.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decoder = _worker(tables)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                coded = [bpe.encode(text) for text in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
                flat = np.frombuffer(b"".join(coded), "<i4")
                arrays = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), pa.array(flat))]
                if decode:
                    arrays.append(decoder.decode(flat, ends))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"][: len(arrays)])

    rows = doc_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, encode, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decode, BATCH_BYTES)


def bpe_decode(coded: DataFrame, tables: Broadcast) -> DataFrame:
    """The columns of ``coded`` and ``decoded``, the bytes of ``ids``; null ids have null bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _worker(tables)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                column = batch.column("ids")
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = decoder.decode(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
                if column.null_count:
                    texts = pc.if_else(column.is_valid(), texts, None)
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return map_batches(coded, decode, T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]), BATCH_BYTES)
