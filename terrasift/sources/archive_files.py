"""HTTP archives as files: a sink that commits whole documents, and a reader that splits them.

Both reach files by pyarrow from the workers, so a path is a local or mounted folder, or a store that pyarrow knows.
"""

from __future__ import annotations

import math
import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from terrasift.schemas import ENTRY
from terrasift.sources.archive import VERSION, ready_to_save
from terrasift.sources.scratch import staged

#: Entries of a document at most, and bytes that a task reads of one.
EACH, RANGE = 10_000, 64 << 20
#: Bytes behind a range that are read first for its last entry, then twice as many each time.
TAIL = 8 << 10
#: Bytes for which a pass over ranges takes a task, and its tasks at most; ranges of fewer bytes share one.
TASK, MOST_TASKS = 8 << 20, 20_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it. Paths are as Spark names them: nothing in them is escaped."""
    if found := re.match(r"(?!file:)([A-Za-z][A-Za-z0-9+.-]*://[^/]*)/*(.*)", path, re.S):
        system, root = fs.FileSystem.from_uri(found.group(1) + "/")
        return system, posixpath.join(root, found.group(2))
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", path))


# Writing


@dataclass
class Written(WriterCommitMessage):
    """What a task has put into the job's temporary folder."""

    documents: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows come grouped by document and in order; each document is one file.

    Tasks write below a folder of the job, which commit empties into place and abort deletes: neither a failed task nor a
    failed job leaves a document. Files are their owner's alone where the system has such rights, as a capture may hold
    credentials.
    """

    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.job = path, replace, uuid.uuid4().hex

    def folder(self) -> tuple[fs.FileSystem, str, str]:
        system, path = opened(self.path)
        return system, path, posixpath.join(path, f"_temporary-{self.job}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self.folder()
        folder = posixpath.join(folder, str(TaskContext.get().taskAttemptId()))
        system.create_dir(folder, recursive=True)
        names, out, now = [], None, None
        try:
            rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
            for document, head, entry in rows:
                if document != now:
                    if out:
                        out.write(b"\n]}}\n")
                        out.close()
                    name = posixpath.join(folder, f"{document}.har")
                    out, now, first = system.open_output_stream(name), document, True
                    if isinstance(system, fs.LocalFileSystem):
                        os.chmod(name, 0o600)
                    names.append(f"{posixpath.basename(folder)}/{document}.har")
                    out.write(f'{{"log":{head[:-1]},"entries":[\n'.encode())
                if entry is not None:
                    out.write((entry if first else f",\n{entry}").encode())
                    first = False
            if out:
                out.write(b"\n]}}\n")
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path, folder = self.folder()
        system.create_dir(path, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".har")]
        names = [name for message in messages if message for name in message.documents]
        taken = {posixpath.basename(x) for x in old} & {posixpath.basename(name) for name in names}
        if taken and not self.replace:
            self.abort(messages)
            raise ValueError(f"documents are there already: {sorted(taken)[:3]}")
        for name in names:
            system.move(posixpath.join(folder, name), posixpath.join(path, posixpath.basename(name)))
        if self.replace:
            for name in {posixpath.basename(x) for x in old} - {posixpath.basename(name) for name in names}:
                system.delete_file(posixpath.join(path, name))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, folder = self.folder()
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class ArchiveSink(DataSource):
    """``format("http_archive")``: rows of document, head and entry, both JSON; see ``save_archives``."""

    @classmethod
    def name(cls) -> str:
        return "http_archive"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        if schema.names != ["document", "head", "entry"]:
            raise ValueError("an archive is written from document, head and entry")
        return ArchiveWriter(self.options["path"], overwrite)


def entry_json(entry: Column) -> Column:
    """An entry as JSON text: what is null is left out, the cache and the initiator are JSON already."""
    ready = ready_to_save(entry)
    text = F.to_json(ready.dropFields("cache", "_initiator"))
    raw = F.concat(F.lit(',"cache":'), ready["cache"], F.coalesce(F.concat(F.lit(',"_initiator":'), entry["_initiator"]), F.lit("")), F.lit("}"))
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), raw)


def archive_head(creator: str, version: str, pages: Column | None = None, comment: Column | None = None) -> Column:
    """An archive's own fields as JSON: all but its entries."""
    fields = [F.lit(VERSION).alias("version"), F.struct(F.lit(creator).alias("name"), F.lit(version).alias("version")).alias("creator")]
    fields += [c.alias(name) for name, c in (("pages", pages), ("comment", comment)) if c is not None]
    return F.to_json(F.struct(*fields))


def save_archives(entries: DataFrame, path: str, head: Column | None = None, each: int = EACH, mode: str = "append") -> None:
    """Writes rows of source_id, entry_index and entry as documents of at most ``each`` entries.

    A document is named after its source and its number, so one large source is written by many tasks. Equal documents
    in the folder are an error, but for the mode "overwrite", which replaces all of them.
    """
    spark = entries.sparkSession
    spark.dataSource.register(ArchiveSink)
    name = F.url_encode(F.col("source_id"))
    name = F.when(F.length(name) > 150, F.sha2("source_id", 256)).otherwise(name)
    part = F.lpad(F.floor(F.col("entry_index") / each).cast("string"), 8, "0")
    rows = entries.select(F.concat_ws("-", name, part).alias("document"), "entry_index", (archive_head("terrasift", "1") if head is None else head).alias("head"), entry_json(F.col("entry")).alias("entry"))
    dealt = rows.repartition("document").sortWithinPartitions("document", "entry_index").select("document", "head", "entry")
    dealt.write.format("http_archive").mode(mode).save(path)


# Reading

#: Keys that matter, and what makes them ones: the bracket or the text behind.
_KEYS = {b'"log"': (rb"\s*:\s*", rb"\{"), b'"entries"': (rb"\s*:\s*", rb"\["), b'"version"': (rb"\s*:\s*", rb'"([^"\\]*)"')}
_KEY = re.compile(rb'"(?=(log|entries|version)")')
_LONGEST = max(map(len, _KEYS))
OUTSIDE, INSIDE, ESCAPED = range(3)
#: Where nothing closes.
_NO_LOW = 1 << 30
_OPENS = "array<struct<depth: int, n: bigint>>"
_EVENT = f"struct<key: string, depth: int, low: int, value: string, opens: {_OPENS}>"
_SCAN = f"path string, length bigint, start bigint, ways array<struct<left: int, depth: int, low: int, events: array<{_EVENT}>, opens: {_OPENS}>>"
_PLAN = "path string, start bigint, state int, depth int, logged boolean, inside boolean, n bigint"


@dataclass
class Bytes:
    """A file's bytes by ranges."""

    path: str
    length: int
    handle: object = field(default=None)

    def __enter__(self) -> Bytes:
        system, path = opened(self.path)
        self.handle = system.open_input_file(path)
        return self

    def __exit__(self, *error: object) -> None:
        self.handle.close()

    def get(self, start: int, end: int) -> bytes:
        self.handle.seek(start)
        return self.handle.read(max(0, min(end, self.length) - start))

    def behind(self, at: int, gap: bytes, wanted: bytes) -> str | None:
        """What stands behind a key: the text in ``wanted``'s group, or the bracket; None if it is something else."""
        size = 256
        while True:
            data = self.get(at, at + size)
            if found := re.match(gap + wanted, data):
                return found.group(found.lastindex or 0).decode("utf-8", "replace")
            rest = data[re.match(rb"\s*:?\s*", data).end() :]
            if len(data) < size or (rest and (wanted[:1] != b'"' or rest[:1] != b'"' or b"\\" in rest or b'"' in rest[1:])):
                return None
            size *= 4


class Marks:
    """Quotes and brackets of JSON text as arrays, for whatever state it begins in; ``more`` goes on behind the text."""

    def __init__(self, more: bytes, size: int):
        self.more, self.size = more, min(size, len(more))
        self.text = np.frombuffer(more, np.uint8, self.size)
        slashes = np.flatnonzero(self.text == 0x5C)
        gaps = np.flatnonzero(np.diff(slashes) > 1)
        #: where runs of backslashes begin and end
        self.runs = (slashes[np.r_[0, gaps + 1]], slashes[np.r_[gaps, len(slashes) - 1]] + 1) if len(slashes) else (slashes, slashes)
        self.all_quotes = np.flatnonzero(self.text == 0x22)
        # brackets and braces differ in one bit, what opens and what closes in others
        folded = self.text | 0x20
        self.all_brackets = np.flatnonzero((folded == 0x7B) | (folded == 0x7D))
        self.all_keys = [(m.start(), b'"' + m[1] + b'"') for m in _KEY.finditer(more) if m.start() < self.size]

    def of(self, state: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]], int]:
        """(places of brackets outside strings, +1 or -1 of each, keys that may matter, the state behind) from ``state`` on."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), [], state
        begin, end = self.runs
        odd = (end - begin + ((begin == 0) & (state == ESCAPED))) % 2 == 1
        escaped = end[odd]
        if state == ESCAPED and not (len(begin) and begin[0] == 0):
            escaped = np.r_[0, escaped]
        quotes = self.all_quotes[~np.isin(self.all_quotes, escaped)] if len(escaped) else self.all_quotes
        within = int(state != OUTSIDE)
        brackets = self.all_brackets[(np.searchsorted(quotes, self.all_brackets) + within) % 2 == 0]
        steps = np.where(self.text[brackets] & 2, 1, -1)
        keys = []
        for place, key in self.all_keys:
            n = int(np.searchsorted(quotes, place))
            if n < len(quotes) and quotes[n] == place and (n + within) % 2 == 0:
                keys.append((place, key))
        if (len(quotes) + within) % 2 == 0:
            return brackets, steps, keys, OUTSIDE
        return brackets, steps, keys, ESCAPED if len(escaped) and escaped[-1] == self.size else INSIDE


def marks(file: Bytes, start: int, end: int) -> Marks:
    """The marks of a range, with so much behind it that a key which goes on there is seen whole."""
    return Marks(file.get(start, end + _LONGEST), min(end, file.length) - start)


def value_of(file: Bytes, place: int, key: bytes) -> tuple[str, str] | None:
    """A key with what stands behind it, or None if that isn't what makes it matter."""
    value = file.behind(place + len(key), *_KEYS[key])
    return None if value is None else (key[1:-1].decode(), value)


def _opens(depths: np.ndarray, steps: np.ndarray, braces: np.ndarray) -> list[dict]:
    """How many objects open at each depth, but for those that lie deeper than where they could be entries."""
    lows = np.minimum.accumulate(np.where(steps < 0, depths, _NO_LOW))
    # an entry opens where the list is left behind by no bracket and by no more than the entry before it
    found, counts = np.unique(depths[braces & (steps > 0) & ((lows == depths - 1) | (lows == _NO_LOW))], return_counts=True)
    return [{"depth": depth, "n": n} for depth, n in zip(found.tolist(), counts.tolist(), strict=True)]


def scanned(file: Bytes, start: int, size: int, state: int, seen: Marks | None = None) -> dict:
    """How a range changes the state and the depth if it begins in ``state``; depths count from its beginning."""
    seen = seen or marks(file, start, start + size)
    brackets, steps, keys, left = seen.of(state)
    depths, braces = np.cumsum(steps), seen.text[brackets] == 0x7B
    found = [(place, hit) for place, key in keys if (hit := value_of(file, start + place, key))]
    # the least depth at a closing bracket, between each two keys
    cuts = np.searchsorted(brackets, [place for place, _ in found]).tolist()
    edges = [0, *cuts, len(brackets)]
    lows = [int(np.min(depths[a:b][steps[a:b] < 0], initial=_NO_LOW)) for a, b in zip(edges, edges[1:], strict=False)]
    opens = [_opens(depths[a:b], steps[a:b], braces[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    events = [{"key": hit[0], "depth": int(depths[n - 1]) if n else 0, "value": hit[1], "low": low, "opens": new} for (_, hit), n, low, new in zip(found, cuts, lows[1:], opens[1:], strict=True)]
    return {"left": left, "depth": int(depths[-1]) if len(depths) else 0, "low": lows[0], "events": events, "opens": opens[0]}


_OPENS_KIND = pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64())]))
_EVENT_KIND = pa.struct([("key", pa.string()), ("depth", pa.int32()), ("low", pa.int32()), ("value", pa.string()), ("opens", _OPENS_KIND)])
_WAY_KIND = pa.struct([("left", pa.int32()), ("depth", pa.int32()), ("low", pa.int32()), ("events", pa.list_(_EVENT_KIND)), ("opens", _OPENS_KIND)])
_SCAN_KIND = pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("ways", pa.list_(_WAY_KIND))])


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                with Bytes(row["path"], row["length"]) as file:
                    seen = marks(file, row["start"], row["start"] + size)
                    row["ways"] = [scanned(file, row["start"], size, state, seen) for state in (OUTSIDE, INSIDE, ESCAPED)]
            yield pa.RecordBatch.from_pylist(rows, _SCAN_KIND)

    return run


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state, the depth and the place in the document at which each range of a file begins, and how many entries begin in it.

    A range's depths hold whatever follows; so a file's ranges are gone through once, without their bytes.
    """
    for batch in batches:
        for path, ranges in zip(batch.column("path").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            state, depth, logged, inside, version, rows = OUTSIDE, 0, False, False, "", []
            for r in sorted(ranges, key=lambda r: r["start"]):
                begins, n = (path, r["start"], state, depth, logged, inside), 0
                way = r["ways"][state]
                parts = [(None, way["low"], way["opens"]), *((e, e["low"], e["opens"]) for e in way["events"])]
                for event, low, opens in parts:
                    at = depth + event["depth"] if event else None
                    if event and event["key"] == "log" and at == 1:
                        logged = True
                    elif event and event["key"] == "entries" and at == 2 and logged:
                        inside = True
                    elif event and event["key"] == "version" and at == 2 and logged:
                        version = event["value"]
                    n += sum(o["n"] for o in opens if depth + o["depth"] == 4) if inside else 0
                    logged, inside = logged and depth + low >= 2, inside and depth + low >= 3
                rows.append((*begins, n))
                state, depth = way["left"], depth + way["depth"]
            if version != VERSION:
                raise ValueError(f"{path}: " + (f"unsupported version {version}" if version else "log.version is required"))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()), strict=True)], ["path", "start", "state", "depth", "logged", "inside", "n"])


def entries_from(file: Bytes, start: int, size: int, state: int, depth: int, logged: bool, inside: bool, whole: bool = True) -> Iterator[tuple[int, bytes]]:
    """(place, JSON text) of the entries that begin in a range; the last one is read to its end.

    Without ``whole`` only where they begin, and nothing behind the range is read.
    """
    at, end = start, min(start + size, file.length)
    ahead = TAIL  # bytes read at once of what goes on behind the range
    begun, held = None, []  # where an entry begins, and its bytes before this block
    while at < file.length:
        stop = min(end if at < end else at + ahead, file.length)
        ahead = ahead if at < end else min(2 * ahead, 1 << 20)
        seen = marks(file, at, stop)
        data = memoryview(seen.more)
        brackets, steps, keys, left = seen.of(state)
        depths = depth + np.cumsum(steps)
        opens = (steps > 0) & (depths == 4) & (seen.text[brackets] == 0x7B)
        # where entries begin and end, where the list or the log ends, and keys: the last of these between two brackets
        told = np.flatnonzero(opens | ((steps < 0) & (depths <= 3)))
        places = [(place, d, step, None) for place, d, step in zip(brackets[told].tolist(), depths[told].tolist(), steps[told].tolist(), strict=True)]
        cuts = np.searchsorted(brackets, [place for place, _ in keys]).tolist()
        places += [(place, int(depths[n - 1]) if n else depth, 0, key) for (place, key), n in zip(keys, cuts, strict=True)]
        for place, now, step, key in sorted(places, key=lambda x: x[0]):
            if step > 0:
                if inside:
                    if at >= end:
                        return
                    begun = at + place
                    if not whole:
                        yield begun, b""
            elif step < 0:
                if now == 3 and begun is not None:
                    if whole:
                        yield begun, b"".join([*held, data[max(begun - at, 0) : place + 1]])
                    begun, held = None, []
                logged, inside = logged and now >= 2, inside and now >= 3
            elif now in (1, 2) and (found := value_of(file, at + place, key)):
                logged = logged or (now == 1 and found[0] == "log")
                inside = inside or (now == 2 and logged and found[0] == "entries")
        if begun is not None:
            held.append(data[max(begun - at, 0) : seen.size])
        depth, state, at = int(depths[-1]) if len(depths) else depth, left, stop
        if at >= end and (begun is None or not whole):
            return


def _read(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with Bytes(row["path"], row["length"]) as file:
                    rows, n = [], row["before"]
                    for place, text in entries_from(file, row["start"], size, row["state"], row["depth"], row["logged"], row["inside"]):
                        rows.append((row["path"], row["start"], n, place, text.decode("utf-8", "replace")))
                        n += 1
                        if len(rows) == 500:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["source_id", "range", "place", "offset", "text"])


def _planned_ranges(spark: SparkSession, path: str, size: int) -> tuple[DataFrame, int]:
    """A row for each range, written, with how it begins; and the tasks that a pass over the ranges takes."""
    # folders are listed once: there may be very many small documents
    files = staged(spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0"))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start"))
    # rows that name ranges are small, what they name isn't: by their own size Spark would put them together again
    told = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.col("length") / size)).alias("ranges"), F.sum("length").alias("bytes")).first()
    n = 1 if not told["n"] else max(1, min(told["ranges"], max(math.ceil(told["bytes"] / TASK), spark.sparkContext.defaultParallelism), MOST_TASKS))
    scan = ranges.repartition(n, "path", "start").mapInArrow(_scan(size), _SCAN)
    # written: however often entries are read from here, files are scanned once
    plan = scan.groupBy("path").agg(F.collect_list(F.struct("start", "ways")).alias("ranges")).mapInArrow(_planned, _PLAN)
    return staged(plan.join(files, "path")), n


def _entries(ranges: DataFrame, n: int, size: int) -> DataFrame:
    rows = ranges.repartition(n, "path", "start").mapInArrow(_read(size), "source_id string, range bigint, place bigint, offset bigint, text string")
    return rows.withColumn("entry", F.from_json("text", ENTRY)).drop("text")


def split_entries(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """source_id, range, place, offset, entry: entries of archives of any size, in ranges of ``size`` bytes.

    Which of an archive's ranges begin inside a string, and how deep, is found out by a first pass over all of them at
    once: each says how it would change either state, and the answers are put together file by file. A second pass reads
    the entries that begin in a range. ``range`` and ``place`` (within the range), or ``offset`` alone, order the entries
    of a source. Documents of another version fail.
    """
    plan, n = _planned_ranges(spark, path, size)
    return _entries(plan.withColumn("before", F.lit(0).cast("bigint")), n, size)


def numbered_entries(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """source_id, entry_index, entry of archives of any size, read as by ``split_entries``.

    What begins in each range is counted by the pass that finds how it begins, so a range knows the number of its first
    entry and entries are neither read twice nor joined.
    """
    plan, n = _planned_ranges(spark, path, size)
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = plan.filter("n > 0").withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    return _entries(before, n, size).select("source_id", F.col("place").cast("int").alias("entry_index"), "entry")


def indexed(entries: DataFrame) -> DataFrame:
    """source_id, entry_index, entry of ``split_entries``, read twice: places are counted over a source's ranges first."""
    counts = entries.groupBy("source_id", "range").count()
    ahead = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_id", "range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    joined = entries.join(before, ["source_id", "range"])
    return joined.select("source_id", (F.col("before") + F.col("place")).cast("int").alias("entry_index"), "entry")
