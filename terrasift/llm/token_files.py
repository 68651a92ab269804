"""Documents' lengths from flat token files.

A token file is nothing but ids of fixed width, documents one after another, each closed by the end-of-document id; it
has no index. Files are cut into blocks of bounded size that are searched for separators side by side, as vectors. A
prefix scan over the blocks' summaries (separators in them, place of the last one) then stitches documents that run
over borders: it tells each block how many documents ended before it, and where its first one began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import broadcast_key, doc_texts, map_batches, once, written
from terrasift.llm.content_store import Encoder, width_of

#: Bytes of a block.
BLOCK = 4 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow knows, by URI; plain paths are local or mounted."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, definition: str, end_id: int, folder: str) -> DataFrame:
    """Writes a file for each partition of ``docs`` into ``folder``; path, ordinal, doc_id of the documents in them.

    A file counts once the table returned names it: one of a task that failed or ran twice is never read.
    """
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    key = broadcast_key("encoder", shared)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store = once(key, lambda: Encoder(shared.value, special_as_text=True)), filesystem(folder)[0]
        path, n, out = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, None
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 4000):
                    batch = whole.slice(at, 4000)
                    out = out or store.open_output_stream(path)
                    for ids in encoder.encode(batch.column("text")):
                        out.write(np.append(ids, ids.dtype.type(end_id)).tobytes())
                    places = pa.array(range(n, n + batch.num_rows), pa.int64())
                    n += batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([path] * batch.num_rows), places, batch.column("doc_id")], ["path", "ordinal", "doc_id"])
        finally:
            if out:
                out.close()

    rows = doc_texts(docs)
    return written(map_batches(rows, put, f"path string, ordinal long, doc_id {rows.schema['doc_id'].dataType.simpleString()}"))


def separators(paths: DataFrame, folder: str, end_id: int, width: str = "<u2") -> DataFrame:
    """path, block, size, ends: the separators' places (in ids of the file) in each block of the files."""
    size = np.dtype(width).itemsize
    step = BLOCK // size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = filesystem(folder)[0]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                length = store.get_file_info(path).size
                if length % size:
                    raise ValueError(f"{path} ends within an id")
                starts = list(range(0, length // size, step))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(range(len(starts)), pa.int64())], ["path", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = filesystem(folder)[0]
        for batch in batches:
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    ids = np.frombuffer(file.read_at(BLOCK, block * BLOCK), width)
                ends = np.flatnonzero(ids == end_id) + block * step
                arrays = [pa.array([path]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "block", "size", "ends"])

    blocks = map_batches(paths.select("path").distinct(), cut, "path string, block long").repartition("path", "block")
    return map_batches(blocks, search, "path string, block long, size long, ends array<long>")


def scan_token_files(paths: DataFrame, folder: str, end_id: int, width: str = "<u2") -> DataFrame:
    """path, ordinal, start, n_tokens, closed: the documents of the files, in ids; ends aren't counted.

    Two ends in a row hold an empty document. Ids behind the last end of a file are a document that isn't closed; an
    empty file has none.
    """
    found = written(separators(paths, folder, end_id, width))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    stitched = summary.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_ordinal"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("first_start"),
    )
    each = found.join(stitched, ["path", "block"]).select("*", F.posexplode("ends").alias("at", "end"))
    start = F.when(F.col("at") == 0, F.col("first_start")).otherwise(F.get("ends", F.col("at") - 1) + 1)
    closed = each.select("path", (F.col("first_ordinal") + F.col("at")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    files = found.groupBy("path").agg(F.sum("size").alias("size"), F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.array_max("ends")) + 1, F.lit(0)).alias("start"))
    rest = files.filter("start < size").select("path", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, definition: str, end_id: int, folder: str) -> DataFrame:
    """doc_id, n_tokens, start (in its file): documents are written to token files, and these are searched.

    Null and empty texts have no tokens; ids may be null or repeat, each row is a document of its own; an empty table
    gives an empty one. Other columns are not looked at.
    """
    names = write_token_files(docs, definition, end_id, folder)
    width = width_of(definition).str
    found = scan_token_files(names, folder, end_id, width).filter("closed")
    ids = names.join(found, ["path", "ordinal"])
    return ids.select("doc_id", "n_tokens", "start")
