"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which of their tokens overlap.

The alignment is relational: tokens are exploded with their places, their ends are sums of byte lengths over a window, an
equi-join on text and end finds the cuts that both have, a running count of cuts is the id of a group, and each stretch
between two neighbouring ends is one link, of the token of either side that covers it. So links take no join of a
group's tokens with each other, whatever its size.

It runs over stretches instead of whole texts: no token of either crosses the place before a space that follows a visible
character (the constructor makes sure of that), so a text's tokens are those of its stretches one after another, and a
stretch that occurs a million times is aligned once. Texts are dealt into blocks of ``BLOCK`` characters, each with a
dictionary of its stretches. What a stretch gives goes back to the blocks that hold it, where a document's groups are
put together in order, and its links are counted.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.llm.common import BATCH_BYTES, broadcast_key, doc_texts, give_back, map_batches, once, written

#: Characters of the texts that share a dictionary; a longer text has its own.
BLOCK = 32_000_000
#: Pairs of ids that are broadcast at most; more take a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Rows of a task whose stretches are told apart together, and stretches that are encoded together.
GATHERED, TOGETHER = 400_000, 5000
#: Stretches of documents that are put together at once.
WORDS = 100_000
#: Rows of a task that are packed together, and their columns.
PACKED = 400_000
NO_WORDS = pa.schema([("local", pa.int32()), ("fine", pa.bool_()), *((c, pa.int32()) for c in ("n_a", "n_b", "n_groups")), ("groups", pa.string()), ("pairs", pa.list_(pa.int64()))])
#: A pair of ids as one number: A's times this, and B's.
PAIR = 1 << 24
#: A table dealt by uid is dealt well enough for a join on uid and end; rows come by uid, so lists need no hash table.
DEALT_BY_UID = {"requireAllClusterKeysForCoPartition": "false", "execution_useObjectHashAggregateExec": "false"}
#: What a written table was shuffled by goes once it is written.
NO_LEFTOVERS = {"classic_shuffleDependency_fileCleanup_enabled": "true"}
#: White space by any table of characters, and what some tables count as such.
_SPACE = r"\s\u180e\u200b\ufeff"
_ODD = re.compile(rf"[{_SPACE}]")
_IDS = pa.list_(pa.int32())
_UNUSUAL = re.compile(rf"[{_SPACE}] ")
_BORDER = re.compile(rf"(?<=[^{_SPACE}])(?= )")


class Tokenizers:
    """Both encoders of one worker: ``a`` is a byte-level BPE as JSON, ``b`` a sentencepiece model with byte fallback."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("a piece goes on behind a space, so texts can't be cut there")
        self.space = self.b.piece_to_id("▁")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

        self.size_a = np.zeros(self.a.get_vocab_size(), np.int64)
        for token, i in self.a.get_vocab().items():
            self.size_a[i] = len(token)  # a character of a byte-level token stands for a byte
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def lengths(self) -> list[list[tuple[int, int]]]:
        """The bytes of each id, of either side."""
        return [list(enumerate(sizes.tolist())) for sizes in (self.size_a, self.size_b)]

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of a space and each stretch, and whether B's bytes are those of the text. A's always are."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        b = [ids or [self.space] for ids in self.b.encode(stretches, num_threads=1)]
        known = self.bytes_b
        return a, b, [b"".join([known[i] for i in ids]) == b" " + s.encode() for ids, s in zip(b, stretches, strict=True)]

    def encode_together(self, stretches: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """The same as arrays: as one text, told apart by the lengths of tokens, if their bytes are those of the text."""
        text = " ".join(stretches)
        ids = [np.array(x, np.int32) for x in (self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text))]
        ends = np.cumsum([len(s.encode()) + 1 for s in stretches])
        behind = [np.cumsum(sizes[x]) for sizes, x in zip((self.size_a, self.size_b), ids, strict=True)]
        at = [np.searchsorted(x, ends) for x in behind]
        if all(n[-1] < len(x) and (x[n] == ends).all() for n, x in zip(at, behind, strict=True)) and b"".join([self.bytes_b[i] for i in ids[1].tolist()]) == b" " + text.encode():
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n + 1]).astype(np.int32)), pa.array(x)) for n, x in zip(at, ids, strict=True)]
            return *lists, pa.array(np.ones(len(stretches), bool))
        a, b, fine = self.encode(stretches)
        return pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())), pa.array(fine)


def stretches_of(text: str) -> list[str]:
    """The stretches of a space and ``text``, each without the space that it begins with."""
    if _UNUSUAL.search(text) is None and text[:1] != " ":
        return text.split(" ")
    return [stretch[1:] for stretch in _BORDER.split(" " + text)]


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, compression="zstd", write_statistics=False)
    return sink.getvalue().to_pybytes()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's dictionary, and its texts as places in it: many rows in one compressed value."""
    task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    found: dict[str, int] = defaultdict()
    found.default_factory = found.__len__
    size, n, ids, words = 0, 0, [], []
    names, kinds = ("block", "local", "stretch", "pack"), (pa.int64(), pa.int32(), pa.string(), pa.binary())

    def rows(*values: pa.Array | None) -> pa.RecordBatch:
        count = next(len(v) for v in values if v is not None)
        return pa.RecordBatch.from_arrays([pa.array(np.full(count, task + n)), *(v if v is not None else pa.nulls(count, k) for v, k in zip(values, kinds[1:], strict=True))], names)

    def texts() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
        table = pa.table({"doc_id": pa.chunked_array(ids), "words": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(words)))})
        return rows(None, None, pa.array([_pack(table)], pa.binary()))

    def dictionary() -> Iterator[pa.RecordBatch]:
        listed = list(found)
        for at in range(0, len(listed), 50_000):
            part = listed[at : at + 50_000]
            yield rows(pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part, pa.string()), None)

    for whole in batches:
        column, lines = whole.column("doc_id"), whole.column("text").to_pylist()
        first = 0
        for at, text in enumerate(lines):
            words.append(np.array(list(map(found.__getitem__, stretches_of(text))) if text else [], np.int32))
            size += len(text) + 1
            if size >= BLOCK:
                ids.append(column.slice(first, at + 1 - first))
                yield texts()
                yield from dictionary()
                found.clear()
                size, n, first, ids, words = 0, n + 1, at + 1, [], []
        if first < len(lines):
            ids.append(column.slice(first))
    if words:
        yield texts()
        yield from dictionary()


def _encoded(shared: Broadcast, key: str):
    def coded(tokenizers: Tokenizers, names: list[str]) -> list[pa.Array]:
        """a, b, fine of stretches. What ends in white space ends its text, and takes in what would follow."""
        alone = np.array([not s or _ODD.match(s[-1]) is not None for s in names])
        parts = [np.flatnonzero(~alone), np.flatnonzero(alone)]
        found = [tokenizers.encode_together([names[i] for i in parts[0].tolist()])] if len(parts[0]) else []
        found += [tuple(pa.array(x, k) for x, k in zip(tokenizers.encode([names[i]]), (_IDS, _IDS, pa.bool_()), strict=True)) for i in parts[1].tolist()]
        back = pa.array(np.argsort(np.concatenate(parts), kind="stable"))
        return [pa.concat_arrays(x).take(back) for x in zip(*found, strict=True)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each stretch of GATHERED rows, with its places in blocks."""
        for held in gathered(batches, GATHERED):
            tokenizers = once(key, lambda: Tokenizers(*shared.value))
            table = pa.Table.from_batches(held).combine_chunks()
            met = table.column("stretch").chunk(0).dictionary_encode()
            index = met.indices.to_numpy()
            order, ends = pa.array(np.argsort(index, kind="stable")), np.concatenate([[0], np.cumsum(np.bincount(index))]).astype(np.int32)
            names = met.dictionary.to_pylist()
            places = [pa.ListArray.from_arrays(pa.array(ends), table.column(c).take(order).combine_chunks()) for c in ("block", "local")]
            for at in range(0, len(names), TOGETHER):
                part = names[at : at + TOGETHER]
                yield pa.RecordBatch.from_arrays([*coded(tokenizers, part), *(x.slice(at, len(part)) for x in places)], ["a", "b", "fine", "blocks", "locals"])

    return encode


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, until they have ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield held
            held, n = [], 0
    if n:
        yield held


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Spark's settings for what is run inside, given with _ for the dots behind ``spark.sql``."""
    names = {"spark.sql." + name.replace("_", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def token_ends(texts: DataFrame, ids: str, lengths: DataFrame) -> DataFrame:
    """uid, end, ``ids``_id: the tokens of each text, by the byte that they end at."""
    tokens = texts.select("uid", F.posexplode(ids).alias("pos", "id"))
    ends = F.sum("length").over(Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    # as many rows as the vocabulary
    return tokens.join(F.broadcast(lengths), "id").select("uid", ends.alias("end"), F.col("id").alias(f"{ids}_id"))


def align(texts: DataFrame, lengths_a: DataFrame, lengths_b: DataFrame) -> DataFrame:
    """uid, n_a, n_b, n_groups, groups, pairs of texts given as uid, a, b: their ids in the order of the text.

    ``groups`` is ``a1,a2|b1;a3|b2`` and so on; ``pairs`` has a number for each link. ``uid`` is unique; a text without
    tokens has no row. The ids of both sides stand for the same bytes.
    """
    dealt = texts.select("uid", "a", "b").repartition("uid")
    merged = token_ends(dealt, "a", lengths_a).join(token_ends(dealt, "b", lengths_b), ["uid", "end"], "full")
    # from the last end on, each end closes what the token before covers
    behind = Window.partitionBy("uid").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = (F.col("a_id").isNotNull() & F.col("b_id").isNotNull()).cast("int")
    covered = F.last("a_id", True).over(behind) * F.lit(PAIR).cast("long") + F.last("b_id", True).over(behind)
    placed = merged.select("uid", F.struct("end", "a_id", "b_id", F.sum(both).over(behind).alias("group"), covered.alias("pair")).alias("at"))
    listed = placed.groupBy("uid").agg(F.array_sort(F.collect_list("at")).alias("ends"))

    def tokens(n: int, side: str) -> Column:
        """One side's tokens, to be put in order: group by group, A's before B's. Groups are counted from the end."""
        found = F.filter("ends", lambda x: x[side].isNotNull())
        return F.transform(found, lambda x: F.struct((-x["group"]).alias("group"), F.lit(n).alias("side"), x["end"].alias("end"), x[side].alias("id")))

    sides = listed.select("uid", "ends", tokens(0, "a_id").alias("a"), tokens(1, "b_id").alias("b"))
    ordered = sides.withColumn("tokens", F.array_sort(F.concat("a", "b")))

    def text(token: Column, at: Column) -> Column:
        """An id with what separates it from the next one."""
        behind = F.get("tokens", at + 1)
        same = behind["group"] == token["group"]
        mark = F.when(behind.isNull(), "").when(~same, ";").when(behind["side"] != token["side"], "|").otherwise(",")
        return F.concat(token["id"].cast("string"), mark)

    return ordered.select(
        "uid",
        F.size("a").alias("n_a"),
        F.size("b").alias("n_b"),
        F.get("ends", F.lit(0))["group"].cast("int").alias("n_groups"),
        F.array_join(F.transform("tokens", text), "").alias("groups"),
        F.transform("ends", lambda x: x["pair"]).alias("pairs"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for one block as one compressed value, of PACKED rows of a task at a time: they are mostly alike."""
    for held in gathered(batches, PACKED):
        table = pa.Table.from_batches(held).combine_chunks()
        blocks = table.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        table, blocks = table.drop_columns(["block"]).take(pa.array(order)), blocks[order]
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(blocks)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(blocks[low])]), pa.array([_pack(table.slice(low, high - low))], pa.binary())], ["block", "pack"])


def _unpacked(packs: pa.Table) -> pa.Table:
    return pa.concat_tables([pq.read_table(pa.BufferReader(pack.as_buffer()), use_threads=False) for pack in packs.column("pack")])


def _bytes(values: pa.BinaryArray) -> memoryview:
    """All values one after another."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return memoryview(values.buffers()[2])[ends[0] : ends[-1]]


def _documents(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of a block from what its stretches gave, as many batches as there are portions."""
    out = pa.Table.from_batches(list(_portions(docs, words)))
    give_back()
    return out


def _portions(docs: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
    """Documents of WORDS stretches together, or a longer one alone. What a stretch takes is only held for a portion."""
    docs = _unpacked(docs).combine_chunks()
    words = _unpacked(words) if words.num_rows else NO_WORDS.empty_table()
    words = words.take(pc.sort_indices(words.column("local"))).combine_chunks()
    column = lambda table, c: (lambda x: x.chunk(0) if x.num_chunks else pa.array([], x.type))(table.column(c))
    lists, ids = column(docs, "words"), column(docs, "doc_id")
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    counts = {c: column(words, c).fill_null(0).to_numpy() for c in ("n_a", "n_b", "n_groups")}
    broken = ~column(words, "fine").to_numpy(zero_copy_only=False).astype(bool)
    text = pc.binary_join_element_wise(column(words, "groups").fill_null("").cast(pa.binary()), pa.scalar(b"", pa.binary()), pa.scalar(b";", pa.binary()))
    links = column(words, "pairs")
    n_links = links.value_lengths().fill_null(0).to_numpy()
    link_ends = np.concatenate([[0], np.cumsum(n_links)])
    names, pairs = np.unique(links.flatten().to_numpy(), return_inverse=True)
    pairs = pairs.astype(np.int32)
    del docs, words, links
    n, first = len(ends) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS, side="right")) - 1)
        own, borders = flat[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        # of a document with a stretch that B's bytes don't give back nothing counts
        lost = sums(broken[own], borders) > 0
        if lost.any():
            sizes = np.diff(borders)
            own, borders = own[np.repeat(~lost, sizes)], np.concatenate([[0], np.cumsum(np.where(lost, 0, sizes))])
        totals = {c: sums(of[own], borders) for c, of in (*counts.items(), ("n_links", n_links))}
        taken = text.take(pa.array(own))
        data, places = _bytes(taken), np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :][borders].tolist()
        digests = [hashlib.sha256(data[low : high - 1]).hexdigest() if high > low else "" for low, high in zip(places[:-1], places[1:], strict=True)]
        each = n_links[own]
        behind = np.cumsum(each)
        linked = pairs[np.arange(behind[-1] if len(behind) else 0) + np.repeat(link_ends[own] - behind + each, each)]
        document = np.repeat(np.arange(last - first), totals["n_links"])
        known, times = np.unique(document * len(names) + linked, return_counts=True)
        found = np.bincount(known // max(len(names), 1), minlength=last - first)
        offsets = pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32))
        known = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (names[known % max(len(names), 1)], times)]
        arrays = [ids.slice(first, last - first), *(pa.array(x.astype(np.int64)) for x in totals.values()), pa.array(digests, pa.string()), *known]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *totals, "groups_sha256", "pairs", "times"])
        first = last


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values between each two ends."""
    behind = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return behind[ends[1:]] - behind[ends[:-1]]


def aligned_documents(docs: DataFrame, a: str, b: bytes) -> DataFrame:
    """uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs array<long>, times array<long>, written.

    One row for each row of ``docs``. Texts begin with a space for both tokenizers. A text that is null or empty, or that
    B's ids don't give back byte by byte, has no tokens: zeros, an empty digest, no pairs. Ids of documents may be null or
    repeat, other columns aren't looked at. ``pairs`` lists the different pairs of ids that are linked in the text,
    as A's id * PAIR + B's; ``times`` how many links each has.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((a, b))
    rows = doc_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    split = written(map_batches(rows, _blocks, "block long, local int, stretch string, pack binary", BATCH_BYTES))
    # a stretch comes to one task from all blocks that hold it; what is gathered of a task's rows is bounded, though
    dealt = split.filter("local IS NOT NULL").select("block", "local", "stretch").repartition("stretch")
    encoded = map_batches(dealt, _encoded(shared, broadcast_key("alignment", shared)), "a array<int>, b array<int>, fine boolean, blocks array<long>, locals array<int>")
    texts = written(encoded.withColumn("uid", F.monotonically_increasing_id()))
    lengths = [spark.createDataFrame(x, "id int, length int") for x in Tokenizers(a, b).lengths()]
    with settings(spark, **DEALT_BY_UID):
        found = align(texts.filter("fine"), *lengths)
        places = texts.select("uid", "fine", F.arrays_zip("blocks", "locals").alias("places"))
        back = places.join(found, "uid", "left").withColumn("place", F.explode("places"))
        rows = back.select("place.blocks", "place.locals", "fine", "n_a", "n_b", "n_groups", "groups", "pairs").toDF("block", *NO_WORDS.names)
        words = written(rows)
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    texts = split.filter("local IS NULL").select("block", "pack")
    words = map_batches(words, _packed, "block long, pack binary")
    put = texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_documents, schema)
    return written(put.withColumn("uid", F.monotonically_increasing_id()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best: how many documents link a pair, and whether A's id has no pair with more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # at most as many rows as B's vocabulary for one id of A
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {PAIR}")))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def cross_alignment(docs: DataFrame, a: str, b: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; see ``aligned_documents``.

    A pair's count is the number of documents that link it. ``n_best`` is the number of links whose pair has the highest
    count of A's id, ``count_sum`` the sum of counts over links.
    """
    with settings(docs.sparkSession, **NO_LEFTOVERS):
        aligned = aligned_documents(docs, a, b)
        counts = written(pair_counts(aligned))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    links = aligned.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("uid", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    joined = aligned.drop("pairs", "times").join(sums, "uid", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
