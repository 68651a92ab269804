"""Near-duplicates by an inverted join on the coordinates of MinHash signatures.

A document's five-word shingles become a signature of COORDINATES minima. Two sets of similarity 0.75 agree in 48 of 64
coordinates on average, and in fewer than MATCHES with a chance of 1 in 22,900. Documents are posted under
(coordinate, value) pairs. Prefix merging: of two signatures that agree MATCHES times, the COORDINATES - MATCHES + 1
posts that come first in any common order share one, so only those are posted, the rarest first. Skip merging: a pair
is counted in the first post that both have, and not at all once confirmed links have joined the two.

Within a post documents are compared in blocks of bounded size. Most members of a post are there by chance, the more of
them the larger the corpus, so a member doesn't bring its signature: SKETCHED bits of each coordinate tell what can't
agree often enough, and the values of its shared posts that come before tell exactly whether a pair has met in one. What
has a match there meets again with its full sets, which confirm the links. A block gives as many links as join its
members, not all pairs of them. Equal sets are one node throughout, so copies cost nothing.

A post of more than BLOCK documents is dealt out over blocks, some members of each being in the next one too. A family
of near copies, however large, becomes one component that way, in linear time. Only the members outside the post's
largest component then meet all those that they haven't met, block by block; no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import doc_texts, map_batches, once, written
from terrasift.llm.components import connected_components
from terrasift.llm.shingles import Shingler, mixed, name_of

COORDINATES, MATCHES = 64, 34
#: Bits of each coordinate that members of posts bring.
SKETCHED = 4
#: Similarity as a share of 100.
SIMILAR = 75
#: Documents of a block: those of larger posts are dealt over several. One in BRIDGE of a block's is in the next one too.
BLOCK, BRIDGE = 512, 32
#: Values of coordinates that are known as frequent: counted from this many in one batch on, and this many at most.
#: They only decide which posts come first; any order gives the same links.
OFTEN, FREQUENT = 8, 50_000
#: Ids that are broadcast at most; more take a shuffle join.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(10)
_TIMES = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingler(width: int) -> Shingler:
    return once(f"shingler-{width}", lambda: Shingler(width))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        values = (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1) >> np.uint64(32)
        least = np.minimum(least, values.astype(np.uint32))
    return least


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), sig."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingler(width).of_text(text.as_py()) for text in batch.column("text"))
            rows = [(len(s), name_of(s), signature(s).tobytes() if len(s) else None) for s in sets]
            n, node, sig = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_shingles", "node", "sig"])

    rows = doc_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, signed, f"doc_id {kind}, n_shingles long, node binary, sig binary")


def _posts(sigs: np.ndarray) -> np.ndarray:
    """The (coordinate, value) pairs of signatures as integers, the coordinate in the upper half."""
    return sigs.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))


def _keys(sigs: np.ndarray) -> np.ndarray:
    """The same, spread evenly."""
    return mixed(_posts(sigs))


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def frequent_keys(nodes: DataFrame) -> np.ndarray:
    """Keys of frequent coordinate values and their counts, as far as single batches see them often."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(_keys(_table(batch.column("sig"))), return_counts=True)
            on = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(key[on].view(np.int64)), pa.array(n[on])], ["key", "n"])

    counted = map_batches(nodes.select("sig"), often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas().sort_values("key", key=lambda k: k.to_numpy().view(np.uint64))
    return np.stack([top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64).astype(np.uint64)])


def prefix_posts(nodes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """key, node for the posts of each node that come first."""
    shared = nodes.sparkSession.sparkContext.broadcast(frequent)
    least = COORDINATES - MATCHES + 1

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in batches:
            sigs = _table(batch.column("sig"))
            keys = _keys(sigs)
            often = np.zeros(keys.shape, np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                often = np.where(known[at] == keys, count[at], 0).astype(np.uint64)
            first = np.lexsort((keys, often), axis=1)[:, :least]
            key = np.take_along_axis(_posts(sigs), first, axis=1).ravel()
            node = np.repeat(batch.column("node").to_numpy(), least)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], ["key", "node"])

    return map_batches(nodes.select("node", "sig"), posted, "key long, node long")


def sketches(sigs: np.ndarray) -> np.ndarray:
    """SKETCHED bits of each coordinate, two coordinates to a byte."""
    low = (sigs & np.uint32((1 << SKETCHED) - 1)).astype(np.uint8)
    return low[:, ::2] | low[:, 1::2] << SKETCHED


def sketched(column: list[bytes]) -> np.ndarray:
    """The bits of ``sketches``, a coordinate each."""
    packed = np.frombuffer(b"".join(column), np.uint8).reshape(-1, COORDINATES // 2)
    return np.stack([packed & ((1 << SKETCHED) - 1), packed >> SKETCHED], axis=2).reshape(-1, COORDINATES)


def in_brief(posts: DataFrame) -> DataFrame:
    """Members of blocks with ``before``, the bits of their shared posts with a lower coordinate, the values of these and a sketch.

    ``posts`` has key, block, side, node, n, shared, sig.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1)
        for batch in batches:
            sigs = _table(batch.column("sig"))
            coord = batch.column("key").to_numpy().view(np.uint64) >> np.uint64(32)
            before = batch.column("shared").to_numpy().view(np.uint64) & ((one << coord) - one)
            there = (before[:, None] >> np.arange(COORDINATES, dtype=np.uint64) & one).astype(bool)
            ends = 4 * np.concatenate([[0], np.cumsum(there.sum(1))])
            flat = sigs[there].tobytes()
            values = [flat[low:high] for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            sketch = [x.tobytes() for x in sketches(sigs)]
            arrays = [pa.array(before.view(np.int64)), pa.array(values, pa.binary()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, BRIEF[:5]), *arrays], BRIEF)

    return map_batches(posts.select(*BRIEF[:5], "shared", "sig"), told, "key long, block long, side int, node long, n long, before long, `values` binary, sketch binary")


BRIEF = ["key", "block", "side", "node", "n", "before", "values", "sketch"]


class Group:
    """The members of a block of a post."""

    def __init__(self, columns: dict[str, list]):
        self.node = columns["node"]
        self.n = np.array(columns["n"], np.int64)
        self.side = np.array(columns["side"])
        self.before = np.array(columns["before"], np.int64).view(np.uint64)
        self.sets = columns.get("shingles")
        if "sig" in columns:
            self.told = self.value = np.frombuffer(b"".join(columns["sig"]), np.uint32).reshape(-1, COORDINATES)
        else:
            self.told, self.value = sketched(columns["sketch"]), np.zeros((len(self.n), COORDINATES), np.uint32)
            there = (self.before[:, None] >> np.arange(COORDINATES, dtype=np.uint64) & np.uint64(1)).astype(bool)
            self.value[there] = np.frombuffer(b"".join(columns["values"]), np.uint32)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Members i < j of like size that agree often enough and first meet in this post, the most alike first.

        By sketches more may seem to agree.
        """
        found = [(np.zeros(0, np.int64),) * 3]
        weights = np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64)
        for i in range(len(self.n) - 1):
            rest = slice(i + 1, None)
            small, large = np.minimum(self.n[i], self.n[rest]), np.maximum(self.n[i], self.n[rest])
            across = (self.side[rest] != self.side[i]) | (self.side[rest] == 0)
            js = np.flatnonzero((100 * small >= SIMILAR * large) & across) + i + 1
            n = (self.told[js] == self.told[i]).sum(1)
            js, n = js[n >= MATCHES], n[n >= MATCHES]
            if len(js):
                same = ((self.value[js] == self.value[i]) * weights).sum(1, dtype=np.uint64)
                first = same & self.before[js] & self.before[i] == 0
                found.append((np.full(first.sum(), i), js[first], n[first]))
        i, j, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-n, kind="stable")
        return i[order], j[order]

    def links(self) -> list[tuple[int, int]]:
        """Pairs whose full sets are similar, without those that others have joined already."""
        root = list(range(len(self.n)))
        out = []
        for i, j in zip(*(x.tolist() for x in self.pairs()), strict=True):
            a, b = i, j
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                inter = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                if 100 * inter >= SIMILAR * (self.n[i] + self.n[j] - inter):
                    root[b] = a
                    out.append((i, j))
        return out


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Group]]:
    """((key, block), members) of blocks with two members at least; a block's rows follow each other."""
    held: dict[str, list] = {name: [] for name in names}
    last = None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in names if name != "shingles"}
        if "shingles" in names:
            lists = batch.column("shingles")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            columns["shingles"] = np.split(flat, ends[:-1])
        key = list(zip(*(batch.column(name).to_pylist() for name in ("key", "block")), strict=True))
        starts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
        for start, end in zip(starts, [*starts[1:], len(key)], strict=True):
            if key[start] != last:
                if len(held["n"]) > 1:
                    yield last, Group(held)
                held, last = {name: [] for name in names}, key[start]
            for name in names:
                held[name] += list(columns[name][start:end])
    if len(held["n"]) > 1:
        yield last, Group(held)


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "node")


MEMBER = "key long, block long, side int, before long, node long"


def matched(posts: DataFrame) -> DataFrame:
    """The members of each block that may agree often enough with another one there. ``posts`` has what BRIEF names."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), group in groups_of(batches, BRIEF[2:]):
            at = np.unique(np.concatenate(group.pairs()))
            if len(at):
                same = [pa.array([x] * len(at), pa.int64()) for x in (key, block)]
                own = [pa.array(group.side[at], pa.int32()), pa.array(group.before[at].view(np.int64)), pa.array([group.node[i] for i in at], pa.int64())]
                yield pa.RecordBatch.from_arrays([*same, *own], ["key", "block", "side", "before", "node"])

    return map_batches(by_block(posts), found, MEMBER)


def confirmed(members: DataFrame) -> DataFrame:
    """u, v: links between members of blocks, by their full sets. ``members`` also has n, sig, shingles."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups_of(batches, ["node", "n", "side", "before", "sig", "shingles"]):
            if pairs := group.links():
                yield pa.RecordBatch.from_arrays([pa.array([group.node[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    return map_batches(by_block(members), found, "u long, v long")


def dealt(posts: DataFrame) -> DataFrame:
    """Adds ``block`` and ``side`` to posts with ``posted``, their sizes: one block, or several with bridges."""
    parts = F.ceil(F.col("posted") / BLOCK).cast("int")
    rows = posts.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    bridge = (F.col("parts") > 1) & (F.pmod(F.xxhash64(F.lit("bridge"), "node"), F.lit(BRIDGE)) == 0)
    both = F.when(bridge, F.array(F.col("own"), F.pmod(F.col("own") + 1, F.col("parts")))).otherwise(F.array("own"))
    return rows.withColumn("block", F.explode(both)).withColumn("side", F.lit(0)).drop("parts", "own")


def left_over(hot: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks in which the members of large posts meet that no component joins yet.

    ``hot`` has the posts' members, ``roots`` components found so far. Of a post's parts those outside its largest
    component meet each other and the ones inside; a block of two parts compares one side with the other.
    """
    rows = hot.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("posted")).filter("most.n < posted")
    in_parts = lambda n: F.greatest(F.lit(1), F.ceil(n / (BLOCK // 2))).cast("int")
    sizes = sizes.select("key", F.col("most.root").alias("largest"), in_parts(F.col("posted") - F.col("most.n")).alias("outside"), in_parts(F.col("most.n")).alias("inside"))
    rows = rows.drop("posted").join(sizes, "key").withColumn("in", F.col("root") == F.col("largest"))
    own = F.when(F.col("in"), F.col("outside") + F.pmod(F.xxhash64("node"), F.col("inside"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outside")))
    last = F.when(F.col("in"), F.col("outside")).otherwise(F.col("outside") + F.col("inside")) - 1
    rows = rows.withColumn("own", own.cast("long")).select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    low, high = F.least("own", F.col("other").cast("long")), F.greatest("own", F.col("other").cast("long"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    block = low * (F.col("outside") + F.col("inside")) + high
    return rows.withColumn("block", block).withColumn("side", side).select("key", "node", "block", "side")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """name, shingles array<long> of the given nodes, from the text of each node's document."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingler(width).of_text(text.as_py()) for text in batch.column("text").slice(at, 500)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.binary()), lists], ["name", "shingles"])

    ids = nodes.select(F.col("doc_id").alias("wanted")).distinct()
    ids = F.broadcast(ids) if nodes.count() <= BROADCAST_IDS else ids
    chosen = doc_texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    return map_batches(chosen, listed, "name binary, shingles array<long>").dropDuplicates(["name"])


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a document with fewer than ``width`` words
    has its whole sequence as one shingle. Null and empty texts and ones without words have none, and are linked with
    nothing. Rows with the same doc_id but different texts stay apart; ids may be null, but a component's id is the
    least that isn't. An empty table gives an empty one. Other columns are not looked at.
    """
    signed = written(signatures(docs, width))
    nodes = signed.filter("node IS NOT NULL").groupBy(F.col("node").alias("name"))
    nodes = nodes.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    # numbers take less than names wherever nodes are shuffled
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    every = prefix_posts(nodes, frequent_keys(nodes))
    shared = written(every.groupBy("key").agg(F.count(F.lit(1)).alias("posted")).filter("posted > 1"))
    posts = written(every.join(shared, "key").select("key", "node", "posted"))
    bits = posts.select("node", F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("key", 32).cast("int")).alias("bit"))
    bits = written(bits.groupBy("node").agg(F.bit_or("bit").alias("shared")))

    def links_of(blocks: DataFrame) -> DataFrame:
        members = written(matched(in_brief(blocks.join(bits, "node").join(nodes.select("node", "n", "sig"), "node"))))
        met = written(members.select("node").distinct().join(nodes, "node"))
        sets = full_sets(docs, met, width)
        return written(confirmed(members.join(met.select("node", "name", "n", "sig"), "node").join(sets, "name")))

    links = links_of(dealt(posts))
    large = posts.filter(F.col("posted") > BLOCK)
    if not large.isEmpty():
        more = written(left_over(large, connected_components(links)))
        if not more.isEmpty():
            links = links.unionByName(links_of(more))
    roots = connected_components(links)
    parts = nodes.select("node", "name", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = parts.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = written(parts.join(least, "root").select(F.col("name").alias("node"), "component_id"))
    out = signed.drop("sig").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
