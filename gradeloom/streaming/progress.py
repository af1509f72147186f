"""Run progress kept current while log files land or change.

Tasks are tracked by a stateful processor: per task the status of each part, and whether it has a result. A task
that is finished keeps a mark for a while, so that a late log of its parts changes nothing, and then a timer drops its
state; so does a task that nothing has been heard of for longer. State holds the tasks of that time, not of the
whole run. A call to the state store costs far more than a task's few words, so tasks share a row of state with the
others of their group (a hash of the task): a group is read and written once per batch, and has one timer.

What changes in a micro-batch is written to a folder named after the batch: a batch that is retried overwrites its own
folder. Every COMPACT batches the changes are merged into a snapshot, in buckets by key, and older folders go. Reading
takes the newest snapshot and the batches after it, so its cost and the number of files do not grow with the run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATUS_LOG = "task_id bigint, chunk bigint, seq bigint, status string"
STATEMENT_LOG = "model string, task_id bigint, verification string"
TASK = "task_id long, completed boolean, chunks long, chunks_completed long, chunks_running long, version long"

GROUPS = 4096       # of tasks; fixed for the life of a checkpoint
COMPACT = 20        # batches between snapshots
BUCKETS = 8         # files of a snapshot
KEEP_DONE_MS = 600_000        # how long a finished task is remembered
KEEP_IDLE_MS = 86_400_000     # and one that nothing is heard of

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_SHUFFLE = "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_updates(log: DataFrame) -> DataFrame:
    """Newest status per (task, chunk) of a stream of status reports."""
    return log.groupBy("task_id", "chunk").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def verdict_updates(statements: DataFrame) -> DataFrame:
    """Verdict counts per (model, task) of a stream of statements."""
    from gradeloom.operators.scores import verdict_counts

    return verdict_counts(statements, "model", "task_id")


class TaskTracker(StatefulProcessor):
    """Per task of a group: the newest status of each part, whether there is a result, and when the task is forgotten.

    State is a JSON object, task: [done, version, until, {part: [status, seq]}], and the time of the group's timer.
    """

    def __init__(self, keep_done_ms: int, keep_idle_ms: int):
        self.keep_done_ms, self.keep_idle_ms = keep_done_ms, keep_idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("tasks", "tasks string, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.group.get()
        tasks, timer = (json.loads(held[0]), held[1]) if held is not None else ({}, 0)
        touched = {}   # whether a task was finished before this batch
        for _, task_id, kind, part, status, seq in rows:
            name = str(task_id)
            task = tasks.setdefault(name, [False, 0, 0, {}])
            before = touched.setdefault(name, task[0])
            if kind == "result":
                task[0] = True
            elif not before:
                known = task[3].get(part)
                if known is None or known[1] <= seq:
                    task[3][part] = [(status or "").lower(), float(seq)]
        now = int(timerValues.getCurrentProcessingTimeInMs())
        for name, before in touched.items():
            task = tasks[name]
            done, version, until, parts = task
            # a new time is set when the task ends, or when half of the old one is over
            if done != before or until - now < self.keep_idle_ms // 2 and not done:
                task[2] = now + (self.keep_done_ms if done else self.keep_idle_ms)
            if done and before:
                continue
            task[1] = version = max(version + 1, now)   # grows even where a forgotten task comes back
            statuses = [status for status, _ in parts.values()]
            yield Row(task_id=int(name), completed=done, chunks=len(statuses), chunks_completed=statuses.count("completed"),
                      chunks_running=statuses.count("running"), version=version)
            if done:
                task[3] = {}
        self._keep(tasks, timer)

    def _keep(self, tasks: dict, timer: int) -> None:
        """Stores the tasks, with a timer not after the first that is to be forgotten."""
        due = min(until for _, _, until, _ in tasks.values())
        if not timer or due < timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.group.update((json.dumps(tasks), timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # what the tasks came to stays in the output; only the state goes
        held = self.group.get()
        now = max(int(timerValues.getCurrentProcessingTimeInMs()), int(expiredTimerInfo.getExpiryTimeInMs()))
        tasks = {name: task for name, task in json.loads(held[0]).items() if task[2] > now} if held is not None else {}
        if tasks:
            self._keep(tasks, 0)
        else:
            self.group.clear()
        return iter([])

    def close(self) -> None:
        pass


def track_tasks(logs: DataFrame, keep_done_ms: int = KEEP_DONE_MS, keep_idle_ms: int = KEEP_IDLE_MS) -> DataFrame:
    """Changed tasks of a stream of log rows (see `sources.logs`): task_id, completed, chunks, chunks_completed,
    chunks_running, and a version that grows with each change."""
    logs.sparkSession.conf.set(_PROVIDER, _ROCKS)
    rows = logs.select(
        F.expr(f"pmod(xxhash64(task_id), {GROUPS})").alias("group"), "task_id", "kind",
        F.concat_ws("/", "attempt_id", "retry_id", "chunk").alias("part"), "status", "seq")
    return rows.groupBy("group").transformWithState(
        TaskTracker(keep_done_ms, keep_idle_ms), TASK, "update", "processingTime")


# ---- output --------------------------------------------------------------------------------


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the complete folders name=number below a folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found = [f.getPath().getName() for f in store.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(name + "=")
                  and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _newest(rows: DataFrame, keys: list[str], newest: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(newest, *[c for c in others if c != newest])).alias("r")).select(*keys, "r.*")


def _changes(spark: SparkSession, out: str) -> tuple[DataFrame | None, list[int], list[int]]:
    """(rows of the newest snapshot and of the batches after it, all snapshots, all batches)"""
    snapshots, batches = _numbers(spark, out, "snapshot"), _numbers(spark, out, "batch")
    last = snapshots[-1] if snapshots else -1
    paths = [f"{out}/snapshot={n}" for n in snapshots[-1:]] + [f"{out}/batch={n}" for n in batches if n > last]
    return spark.read.parquet(*paths) if paths else None, snapshots, batches


def compact(spark: SparkSession, out: str, keys: list[str], newest: str, upto: int, buckets: int = BUCKETS) -> None:
    """Merges what there is up to a batch into a snapshot. The snapshot counts once it is complete; the one before it
    stays until the next one, for readers that have already opened it."""
    rows, snapshots, batches = _changes(spark, out)
    if rows is None or upto in snapshots:
        return
    _newest(rows, keys, newest).repartition(buckets, *keys).write.mode("overwrite").parquet(f"{out}/snapshot={upto}")
    keep = snapshots[-1] if snapshots else -1
    for n in snapshots[:-1]:
        _remove(spark, f"{out}/snapshot={n}")
    for n in batches:
        if n <= keep:
            _remove(spark, f"{out}/batch={n}")


def run(updates: DataFrame, out: str, checkpoint: str, keys: list[str], newest: str, available_now: bool = True,
        every: str = "1 minute", compact_every: int = COMPACT, state_partitions: int | None = None) -> None:
    """Writes the changed rows of each micro-batch below `out`, and a snapshot every `compact_every` batches. `newest` only
    grows within a key. With available_now it ends when all there is has been read. `state_partitions` is the number of
    pieces of a new checkpoint's state, each opened and committed in every batch; by default the session's shuffle partitions."""
    spark = updates.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(spark, out, keys, newest, batch_id)

    writer = updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    shuffle = spark.conf.get(_SHUFFLE)
    try:
        spark.conf.set(_SHUFFLE, str(state_partitions or shuffle))
        started = writer.trigger(**trigger).start()   # takes the settings of this moment
    finally:
        spark.conf.set(_SHUFFLE, shuffle)
    if available_now:
        started.awaitTermination()


def read_log(spark: SparkSession, path: str, schema: str, max_files: int = 10_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def current(spark: SparkSession, out: str, keys: list[str], newest: str) -> DataFrame:
    """The latest row per key of what `run` has written."""
    rows, _, _ = _changes(spark, out)
    if rows is None:
        raise ValueError(f"nothing has been written below {out}")
    return _newest(rows, keys, newest)
