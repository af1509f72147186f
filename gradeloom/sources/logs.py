"""Logs of a fact-checking run: one file per part of a task, rewritten as the part goes on, and one per result.

A part's file opens with its `task_meta`, followed by all steps, which may be megabytes. Only the head is read, and
of it only the one object. Batch and stream share listing and parsing; the stream gives a file again whenever it has
changed, which Spark's own file source does not.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gradeloom.sources.store import list_files, read_range

# How the files are named, and the characters in which the object must lie.
PART_NAME = re.compile(r"task_([a-zA-Z][a-zA-Z0-9_-]*)_(\d+)_attempt_(\d+)_retry_(\d+)_chunk_(\d+)\.json")
RESULT_NAME = re.compile(r"(?!task_)([a-zA-Z][a-zA-Z0-9_-]*)_(\d+)\.json")
HEAD_CHARS = 8192

LOG = ("kind string, model string, task_id long, attempt_id int, retry_id int, chunk int, status string, start_time string, "
       "end_time string, seq double")
COLUMNS = pa.schema([
    ("kind", pa.string()), ("model", pa.string()), ("task_id", pa.int64()), ("attempt_id", pa.int32()), ("retry_id", pa.int32()), ("chunk", pa.int32()),
    ("status", pa.string()), ("start_time", pa.string()), ("end_time", pa.string()), ("seq", pa.float64())])
FILES_PER_TASK = 2000
FILES_PER_BATCH = 1000


def meta_of(head: str) -> dict | None:
    """The object after "task_meta" at the head of a log; null where it is missing, cut off or broken."""
    name = head.find('"task_meta"')
    at = head.find("{", name)
    if name < 0 or at < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(head, at)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def log_row(path: str, changed: float) -> tuple | None:
    """The row of a log file; null for files that are neither a part nor a result."""
    name = path.rsplit("/", 1)[-1]
    result = RESULT_NAME.fullmatch(name)
    part = PART_NAME.fullmatch(name)
    if part is None:
        return result and ("result", result[1], int(result[2]), None, None, None, None, None, None, changed)
    try:
        head = read_range(path, 0, 4 * HEAD_CHARS).decode("utf-8", "replace")[:HEAD_CHARS]
    except FileNotFoundError:   # removed since it was listed
        head = ""
    meta = meta_of(head) or {}
    return ("part", part[1], *map(int, part.groups()[1:]), _text(meta.get("status")), _text(meta.get("start_time")),
            _text(meta.get("end_time")), changed)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, float]]):
        self.files = files


def _partitions(files: list[tuple[str, int, float]], per_task: int) -> list[_Files]:
    named = [(p, t) for p, _, t in files if PART_NAME.fullmatch(p.rsplit("/", 1)[-1]) or RESULT_NAME.fullmatch(p.rsplit("/", 1)[-1])]
    return [_Files(named[at:at + per_task]) for at in range(0, len(named), per_task)] or [_Files([])]


def _rows(partition: _Files) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(partition.files), FILES_PER_BATCH):
        rows = [row for path, changed in partition.files[at:at + FILES_PER_BATCH] if (row := log_row(path, changed)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(COLUMNS)], schema=COLUMNS)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path, self.per_task = options["path"], int(options.get("filesPerTask", FILES_PER_TASK))

    def partitions(self):
        return _partitions(list_files(self.path, ".json"), self.per_task)

    def read(self, partition):
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are times of change. The last moment is left to the next batch, so that no file of the same instant
    is passed over."""

    def __init__(self, options):
        self.path, self.per_task = options["path"], int(options.get("filesPerTask", FILES_PER_TASK))

    def initialOffset(self):
        return {"until": 0.0}

    def latestOffset(self):
        return {"until": time.time() - 0.05}

    def partitions(self, start, end):
        return _partitions([f for f in list_files(self.path, ".json") if start["until"] <= f[2] < end["until"]], self.per_task)

    def read(self, partition):
        return _rows(partition)

    def commit(self, end):
        pass

    def stop(self):
        pass


class RunLogs(DataSource):
    """Format `run_logs`: option path, and filesPerTask."""

    @classmethod
    def name(cls):
        return "run_logs"

    def schema(self):
        return LOG

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def read_run_logs(spark: SparkSession, path: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """One row per log file: kind part or result, what its name says, and for parts the head's status and times. A part
    whose head cannot be read has no status. Other files are passed over."""
    spark.dataSource.register(RunLogs)
    return spark.read.format("run_logs").option("filesPerTask", files_per_task).load(path)


def stream_run_logs(spark: SparkSession, path: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """The same as a stream: a file comes again when it has changed; `seq` grows with its changes."""
    spark.dataSource.register(RunLogs)
    return spark.readStream.format("run_logs").option("filesPerTask", files_per_task).load(path)


def parts(logs: DataFrame) -> DataFrame:
    """Of each part (task and chunk) of the run, whatever its attempts, one row per file: task_id, chunk, status, start_time, end_time."""
    return logs.where("kind = 'part'").select("model", "task_id", "attempt_id", "retry_id", "chunk", "status", "start_time", "end_time", "seq")


def results(logs: DataFrame) -> DataFrame:
    """task_id of the tasks that have a result."""
    return logs.where("kind = 'result'").select("task_id").distinct()
