"""Content-addressed store of token ids.

A document's ids are cut where a rolling hash of the last ids meets a mask, so that equal passages give equal chunks
wherever they stand. Each distinct chunk is stored once, under its digest. A recipe lists a document's chunks; a Merkle
node over their digests, and one over each block of recipes, verify what is read back.

One pass encodes the texts and cuts them. A task sends the bytes of a chunk once, towards the partition of its digest;
the rows of recipes go by document, so no partition gathers the copies of a frequent chunk. The store is four Parquet
tables in a folder: ``log`` (recipe rows; bytes with the first row of each chunk), ``recipes`` in ascending doc_id
order, ``manifest`` (the Merkle nodes above the recipes: of blocks, of parts, and the root) and ``meta`` (the width of
ids).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm.common import broadcast_key, doc_texts, map_batches, once, running_total, written

#: Ids in a chunk: least, on average about least + 2 ** bits, most.
LEAST, BITS, MOST = 256, 10, 8192
#: Ids that the rolling hash sees.
WINDOW = 16
#: Recipes below one Merkle node of the second level.
BLOCK = 1024
#: Words that an encoder remembers, and new ones that it encodes together.
REMEMBERED, TOGETHER = 1_200_000, 2000
#: A single space before a visible character starts a new match of the split pattern, whatever stands around it. Texts
#: with other spaces, or none but one at an end, are encoded as they are.
_UNUSUAL = r"^ | $| [^!-~\x{A1}-\x{167F}\x{3001}-\x{D7FF}]"

LOG = "doc_id {0}, rid long, seq int, n int, after long, hash binary, data binary"


def width_of(definition: str) -> np.dtype:
    """16 bits for an id if all of the vocabulary fit, else 32."""
    known = json.loads(definition)
    ids = [*known["model"]["vocab"].values(), *(token["id"] for token in known["added_tokens"])]
    return np.dtype("<u2" if max(ids) < 1 << 16 else "<u4")


class Encoder:
    """A byte-level BPE of the tokenizers library that remembers the ids of recent words.

    Texts are cut at single spaces into words, of which only new ones are encoded: many at a time as one text, to be told
    apart by the lengths of the ids in bytes. The ids of all words met stand one after another in ``pool``.

    A special token that a text spells out is one id, as the library has it, or plain text if ``special_as_text``.
    """

    def __init__(self, definition: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab()
        self.width = width_of(definition)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = "|".join([_UNUSUAL, *(re.sub(r"([^0-9A-Za-z_])", r"\\\1", token) for token in added)])
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, at in vocabulary.items():
            self.sizes[at] = len(token)  # a character stands for a byte
        self.words = pa.array([], pa.string())
        self.start = np.zeros(1, np.int64)
        self.pool = np.zeros(0, self.width)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.width) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: pa.Array) -> None:
        """Ids of words that each follow a space."""
        pools, starts, last = [self.pool], [self.start], len(self.pool)
        groups = [words.slice(at, TOGETHER) for at in range(0, len(words), TOGETHER)]
        for group, coded in zip(groups, self.ids([" " + " ".join(group.to_pylist()) for group in groups]), strict=True):
            ends = np.cumsum(pc.binary_length(group.cast(pa.binary())).to_numpy() + 1)
            behind = np.cumsum(self.sizes[coded])
            at = np.searchsorted(behind, ends)
            if at[-1] >= len(behind) or (behind[at] != ends).any():
                raise ValueError("an id crosses the border of a word")
            pools.append(coded)
            starts.append(last + at + 1)
            last += len(coded)
        self.words = pa.concat_arrays([self.words, words])
        self.pool, self.start = np.concatenate(pools), np.concatenate(starts)

    def forget(self) -> None:
        """Keeps the half that was met first: the frequent words."""
        self.words = pa.concat_arrays([self.words.slice(0, REMEMBERED // 2), pa.array([], pa.string())])
        self.start = self.start[: len(self.words) + 1].copy()
        self.pool = self.pool[: self.start[-1]].copy()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        usual = pc.invert(pc.match_substring_regex(texts, self.unusual))
        out: list[np.ndarray] = [self.pool[:0]] * len(texts)
        rest = np.flatnonzero(~usual.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(rest, self.ids([texts[i].as_py() for i in rest]), strict=True):
            out[i] = ids
        split = pc.split_pattern(texts.filter(usual), " ")
        if not len(split):
            return out
        ends = np.cumsum(split.value_lengths().to_numpy())
        first = np.concatenate([[0], ends[:-1]])
        met = split.flatten().dictionary_encode()
        names, index = met.dictionary, met.indices.to_numpy().copy()
        heads = self.ids(names.take(pa.array(index[first])).to_pylist())  # nothing stands before them
        index[first] = len(names) + np.arange(len(first))
        needed = np.zeros(len(names) + len(first), bool)
        needed[index] = True
        if len(self.words) > REMEMBERED:
            self.forget()
        place = pc.index_in(names, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = needed[: len(names)] & (place < 0)
        place[new] = np.arange(len(self.words), len(self.words) + new.sum())
        self.learn(names.filter(pa.array(new)))
        # the ids of each word met and of heads as bytes, then of all words in their order
        width = self.width.itemsize
        borders = np.concatenate([self.start, self.start[-1] + np.cumsum([len(ids) for ids in heads])]) * width
        data = np.concatenate([self.pool, *heads])
        coded = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(data)])
        place = np.concatenate([place, len(self.words) + np.arange(len(first))])
        whole = coded.take(pa.array(place[index]))
        offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1] // width
        ids = np.frombuffer(whole.buffers()[2], self.width)
        plain = np.flatnonzero(usual.to_numpy(zero_copy_only=False)).tolist()
        for i, low, high in zip(plain, offsets[first].tolist(), offsets[ends].tolist(), strict=True):
            out[i] = ids[low:high]
        return out


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """At each place a hash of the last WINDOW ids, as sums of shifted hashes of one id, doubled four times."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] * np.uint64(0xBF58476D1CE4E5B9 + 2 * span)
        span *= 2
    return h


def cuts(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Ends of the chunks within each of the streams that stand one after another in ``ids``.

    What the window sees of the stream before doesn't matter: no chunk ends within the first LEAST ids.
    """
    places = np.flatnonzero(rolling_hash(ids) >> np.uint64(64 - BITS) == 0) + 1
    borders = np.cumsum([0, *sizes])
    out = []
    for size, first, low, high in zip(sizes, borders.tolist(), *np.searchsorted(places, [borders[:-1], borders[1:]], side="right").tolist(), strict=False):
        ends, last = [], 0
        for place in [*(places[low:high] - first).tolist(), size]:
            while place - last > MOST:
                last += MOST
                ends.append(last)
            if place - last >= LEAST:
                last = place
                ends.append(last)
        if last < size:
            ends.append(size)
        out.append(ends)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _chunked(definition, end_id: int, key: str) -> Callable:
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = once(key, lambda: Encoder(definition.value)), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                rows: list[tuple] = []
                coded = [np.append(ids, ids.dtype.type(end_id)) for ids in encoder.encode(batch.column("text"))]
                for row, (ids, ends) in enumerate(zip(coded, cuts(np.concatenate(coded), [*map(len, coded)]), strict=True)):
                    last = 0
                    for seq, end in enumerate(ends):
                        name = digest(data := ids[last:end].tobytes())
                        rows.append((row, seq, end - last, len(ids) - end, name, None if name in sent else data))
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(name)
                        last = end
                row, seq, n, after, name, data = zip(*rows, strict=True)
                keys = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "rid")]
                rest = [pa.array(seq, pa.int32()), pa.array(n, pa.int32()), pa.array(after, pa.int64()), pa.array(name, pa.binary()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays([*keys, *rest], ["doc_id", "rid", "seq", "n", "after", "hash", "data"])

    return chunks


def _stored_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by digest, those with bytes first: the bytes stay with the first row of each."""
    last = None
    for batch in batches:
        names, data = batch.column("hash").to_pylist(), batch.column("data").to_pylist()
        for i, name in enumerate(names):
            if name == last:
                data[i] = None
            last = name
        at = batch.schema.get_field_index("data")
        yield batch.set_column(at, "data", pa.array(data, pa.binary()))


def write_store(docs: DataFrame, definition: str, path: str, end_id: int = 0) -> None:
    """Encodes the texts with ``end_id`` behind each, and writes the store.

    Null and empty texts hold the end id alone. Rows that repeat an id stay apart, in any order among themselves; null
    ids come first. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    rows = doc_texts(docs).withColumn("rid", F.monotonically_increasing_id())
    schema = LOG.format(rows.schema["doc_id"].dataType.simpleString())
    log = map_batches(rows, _chunked(shared, end_id, broadcast_key("encoder", shared)), schema)
    by = F.when(F.col("data").isNotNull(), F.xxhash64("hash")).otherwise(F.xxhash64("rid", "seq"))
    dealt = log.withColumn("by", by).repartition("by").drop("by").sortWithinPartitions("hash", F.col("data").isNull(), "rid", "seq")
    log = written(map_batches(dealt, _stored_once, schema), f"{path}/log")
    leaf = F.struct("seq", "n", "after", "hash")
    recipes = log.groupBy("doc_id", "rid").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(leaf)).alias("chunks"))
    recipes = recipes.withColumn("node", F.sha2(F.array_join(F.transform("chunks", lambda c: F.hex(c["hash"])), ","), 256))
    ordered = running_total(recipes, ["doc_id", "rid"], "n_tokens", "start")
    written(ordered.withColumn("block", F.floor(F.col("rank") / BLOCK)), f"{path}/recipes")
    written(merkle_nodes(spark, path), f"{path}/manifest")
    spark.createDataFrame([(width_of(definition).str,)], "width string").write.mode("overwrite").parquet(f"{path}/meta")


def merkle_nodes(spark: SparkSession, path: str) -> DataFrame:
    """part, block, node: of each block's recipes, of each part's blocks (block null), and of all parts, the root.

    A part is a range of recipes that one task has written, so the root is over as many nodes as there are tasks.
    """

    def above(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(order, "node")))
        return nodes.groupBy(*by).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["node"]), ","), 256).alias("node"))

    blocks = above(spark.read.parquet(f"{path}/recipes"), ["part", "block"], "rank")
    parts = above(blocks, ["part"], "block")
    return blocks.unionByName(parts, allowMissingColumns=True).unionByName(above(parts, [], "part"), allowMissingColumns=True)


def damaged(spark: SparkSession, path: str) -> DataFrame | None:
    """rid of the recipes below nodes that differ from the manifest; None without any. All if the root differs."""
    key = F.struct(F.coalesce("part", F.lit(-1)), F.coalesce("block", F.lit(-1)))
    again = merkle_nodes(spark, path).select(key.alias("key"), "part", "block", F.col("node").alias("again"))
    kept = spark.read.parquet(f"{path}/manifest").select(key.alias("key"), F.col("part").alias("p"), F.col("block").alias("b"), "node")
    wrong = written(again.join(kept, "key", "full").filter(~F.col("again").eqNullSafe(F.col("node"))).select(F.coalesce("part", "p").alias("part"), F.coalesce("block", "b").alias("block")))
    if wrong.isEmpty():
        return None
    recipes = spark.read.parquet(f"{path}/recipes").select("rid", "part", "block")
    blocks = wrong.filter("block IS NOT NULL")
    # nodes above changed blocks change too; if nothing below tells which, all is in doubt
    return recipes.join(blocks, ["part", "block"], "left_semi").select("rid") if not blocks.isEmpty() else recipes.select("rid")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each document: doc_id, rid, start, n_tokens, seq, n, after, hash."""
    return spark.read.parquet(f"{path}/recipes").select("doc_id", "rid", "start", "n_tokens", "node", F.inline("chunks"))


def _shift_tables() -> np.ndarray:
    """For 2 ** k zero bytes behind a crc, tables by byte of the crc."""

    def times(matrix: list[int], value: int) -> int:
        out = 0
        for bit, column in enumerate(matrix):
            if value >> bit & 1:
                out ^= column
        return out

    step = [0xEDB88320, *(1 << bit for bit in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, column) for column in step]
    tables = []
    for _ in range(48):
        tables.append([[times(step, byte << 8 * place) for byte in range(256)] for place in range(4)])
        step = [times(step, column) for column in step]
    return np.array(tables, np.uint32)


def shift_crc(crc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The share of a part's crc32 in that of a whole in which ``behind`` more bytes follow; shares are joined by xor."""
    crc, behind = crc.astype(np.uint32), behind.astype(np.int64)
    for k, table in enumerate(_TABLES):
        if not (behind >> k).any():
            break
        on = (behind >> k & 1).astype(bool)
        x = crc[on]
        crc[on] = table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]
    return crc


_TABLES = _shift_tables()


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified for each document, from the stored bytes.

    Each chunk is read once: its bytes must have its digest, and give the crc32 of its ids as 32-bit integers. The
    crc32 of a document is the xor of its chunks' shares, so no document is put together in one place. A document is
    verified if all its chunks are there and sound, its recipe has its node, and the nodes above it agree with the
    manifest up to the root. A lost chunk leaves its documents unverified, a lost recipe all of its block.
    """
    width = spark.read.parquet(f"{path}/meta").first().width

    def inspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = batch.column("hash"), batch.column("data").to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, width).astype("<u4").tobytes()) for x in data]
            sound = [digest(x) == name for x, name in zip(data, names.to_pylist(), strict=True)]
            held = [len(x) // np.dtype(width).itemsize for x in data]
            yield pa.RecordBatch.from_arrays([names, pa.array(crc, pa.int64()), pa.array(held, pa.int32()), pa.array(sound)], ["hash", "crc", "held", "sound"])

    @F.pandas_udf("long")
    def share(crc: pd.Series, behind: pd.Series) -> pd.Series:
        return pd.Series(shift_crc(crc.fillna(0).to_numpy(), behind.to_numpy()).astype(np.int64))

    log = spark.read.parquet(f"{path}/log").filter("data IS NOT NULL").select("hash", "data")
    chunks = map_batches(log, inspected, "hash binary, crc long, held int, sound boolean")
    read = read_recipes(spark, path).join(chunks, "hash", "left").withColumn("share", share("crc", F.col("after") * 4))
    named = F.sort_array(F.collect_list(F.struct("seq", "hash")))
    whole = read.groupBy("doc_id", "rid", "start", "n_tokens", "node").agg(
        F.bit_xor("share").alias("ids_crc32"),
        F.coalesce(F.sum("held"), F.lit(0)).alias("held"),
        F.min(F.coalesce("sound", F.lit(False))).alias("sound"),
        F.sha2(F.array_join(F.transform(named, lambda c: F.hex(c["hash"])), ","), 256).alias("again"),
    )
    verified = F.col("sound") & (F.col("again") == F.col("node")) & (F.col("held") == F.col("n_tokens"))
    if (doubtful := damaged(spark, path)) is not None:
        whole = whole.join(doubtful.withColumn("doubtful", F.lit(True)), "rid", "left")
        verified = verified & F.col("doubtful").isNull()
    return whole.select("doc_id", "start", F.col("held").alias("n_tokens"), "ids_crc32", verified.alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, data: the stored ids of each document put together again."""
    log = spark.read.parquet(f"{path}/log").filter("data IS NOT NULL").select("hash", "data")
    read = read_recipes(spark, path).join(log, "hash").groupBy("doc_id", "rid", "start")
    parts = read.agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("parts"))
    empty = F.lit(b"").cast(T.BinaryType())
    return parts.select("doc_id", "start", F.aggregate("parts", empty, lambda held, x: F.concat(held, x["data"])).alias("data"))
