"""Files by name, for layouts that Spark's readers cannot address: heads of files, byte ranges, one file per row.

Paths are those that Spark uses. Local ones and the stores that pyarrow knows (S3, GCS, Azure, HDFS) can be read in
tasks; others raise. Everything that can go through a Spark reader does.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    local = re.sub(r"^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(path)


def list_files(path: str, suffix: str = "") -> list[tuple[str, int, float]]:
    """(path, bytes, time of the last change in seconds) of the files at or below a path. What is hidden by a leading
    dot or underscore is left out."""
    store, inside = open_store(path)
    info = store.get_file_info(inside)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size, f.mtime_ns / 1e9) for f in found
                  if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_")))


def read_range(path: str, start: int, size: int) -> bytes:
    store, inside = open_store(path)
    with store.open_input_file(inside) as f:
        f.seek(start)
        return f.read(size)


THREADS = 16   # folders that one process removes at a time


def _folders(path: str) -> list[str]:
    """The folder and those below it; none where it is not there."""
    store, inside = open_store(path)
    if store.get_file_info(inside).type != fs.FileType.Directory:
        return []
    return [inside] + [f.path for f in store.get_file_info(fs.FileSelector(inside, recursive=True)) if f.type == fs.FileType.Directory]


def empty(spark: SparkSession, path: str) -> None:
    """Leaves the files at or below a folder without content: their blocks are free at once, their names stay."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for f in store.get_file_info(fs.FileSelector(folder)):
                    if f.type == fs.FileType.File:
                        store.open_output_stream(f.path).close()
            yield batch

    folders = _folders(path)
    if folders:
        rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(spark.sparkContext.defaultParallelism)
        rows.mapInArrow(cut, "folder string").write.format("noop").mode("overwrite").save()


def remove(path: str) -> None:
    """Removes a folder with all that it holds, if it is there; folders in it several at a time."""
    store, inside = open_store(path)
    if store.get_file_info(inside).type != fs.FileType.Directory:
        return
    with ThreadPoolExecutor(THREADS) as several:
        list(several.map(store.delete_dir, [f.path for f in store.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.Directory]))
    store.delete_dir(inside)


def room(path: str) -> float:
    """How many files can still be made beside a path, where the file system keeps a number of them."""
    store, inside = open_store(path)
    free = os.statvfs(inside).f_favail if isinstance(store, fs.LocalFileSystem) else 0
    return free or float("inf")


def move(path: str, to: str) -> None:
    """Gives a folder another path in its store."""
    store, inside = open_store(path)
    store.move(inside, open_store(to)[1])


def write_named(rows: DataFrame, path: str) -> str:
    """One file per row (name, value) below `path`; a name may hold folders. Files are written under a name of
    their own and moved into place, so that a task that runs twice leaves no half file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = open_store(path)
        made, own = set(), uuid.uuid4().hex
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value")):
                target = f"{inside}/{name}"
                folder, _, last = target.rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                first = f"{folder}/.{last}.{own}"
                with store.open_output_stream(first) as f:
                    f.write(value.as_buffer())
                store.move(first, target)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    rows.select("name", "value").mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
    return path
