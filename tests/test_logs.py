"""Log files of a run: names, heads, and progress that follows them."""

import json
import os
import time

import pytest

from gradeloom.operators import progress as P
from gradeloom.sources import logs, store
from gradeloom.streaming import progress as SP


def part(folder, task, chunk, status, tail="", **meta):
    text = json.dumps({"task_meta": {"status": status, "task_description": 'brace } and "quote"', **meta}}, indent=2)[:-1] + tail
    (folder / f"task_model-x_{task}_attempt_1_retry_0_chunk_{chunk}.json").write_text(text)


def test_heads():
    assert logs.meta_of('{"task_meta": {"status": "running", "x": {"y": "}"}}, "step_logs": [') == {"status": "running", "x": {"y": "}"}}
    for head in ("", "{}", '"task_meta"', '{"task_meta": {"status": "run', '{"task_meta": null, "step_logs": []}', '{"task_meta": [1]}'):
        assert logs.meta_of(head) is None or head.startswith('{"task_meta": null')


def test_only_the_head_is_read(spark, tmp_path, monkeypatch):
    part(tmp_path, 3, 0, "Running", ', "step_logs": ["' + "x" * 100_000 + '"]}', start_time="2025-01-01T10:00:00Z")
    part(tmp_path, 3, 1, "completed", ', "step_logs": [ broken', end_time="2025-01-01T10:30:00+08:00")
    (tmp_path / "task_model-x_4_attempt_2_retry_1_chunk_7.json").write_text("no json")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "model-x_9.json").write_text("[]")
    for other in ("summary.json", "task_model-x_9.json", "model-x_5.txt", ".model-x_6.json"):
        (tmp_path / other).write_text("[]")
    rows = logs.read_run_logs(spark, str(tmp_path), 1)
    assert rows.rdd.getNumPartitions() == 4
    got = sorted((r.kind, r.model, r.task_id, r.attempt_id, r.retry_id, r.chunk, r.status) for r in rows.collect())
    assert got == [("part", "model-x", 3, 1, 0, 0, "Running"), ("part", "model-x", 3, 1, 0, 1, "completed"),
                   ("part", "model-x", 4, 2, 1, 7, None), ("result", "model-x", 9, None, None, None, None)]
    sizes = []
    monkeypatch.setattr(logs, "read_range", lambda p, a, n: sizes.append(n) or store.read_range(p, a, n))
    path = str(tmp_path / "task_model-x_3_attempt_1_retry_0_chunk_0.json")
    assert logs.log_row(path, 1.0)[6] == "Running" and sizes == [4 * logs.HEAD_CHARS]
    summary = P.progress_summary(logs.parts(rows), logs.results(rows), 5)
    row = P.eta(logs.parts(rows), summary).first()
    assert (row.completed, row.in_progress, row.not_started, row.elapsed_minutes) == (1, 2, 2, 30.0)
    assert logs.read_run_logs(spark, str(tmp_path / "none")).count() == 0


def test_stream_sees_changed_files(spark, tmp_path):
    run, out, state = tmp_path / "run", str(tmp_path / "out"), str(tmp_path / "state")
    run.mkdir()

    def look():
        time.sleep(0.2)
        SP.run(SP.track_tasks(logs.stream_run_logs(spark, str(run))), out, state, ["task_id"], "version", compact_every=2)
        return {r.task_id: (r.completed, r.chunks, r.chunks_completed, r.chunks_running) for r in SP.current(spark, out, ["task_id"], "version").collect()}

    part(run, 1, 0, "running")
    part(run, 2, 0, "running")
    assert look() == {1: (False, 1, 0, 1), 2: (False, 1, 0, 1)}
    part(run, 1, 0, "completed")
    part(run, 1, 1, "Running")
    assert look() == {1: (False, 2, 1, 1), 2: (False, 1, 0, 1)}
    (run / "model-x_1.json").write_text("[]")
    assert look()[1][0] is True
    part(run, 1, 1, "failed")     # late: the task is finished
    part(run, 2, 0, "completed")
    got = look()
    assert got[1][0] is True and got[2] == (False, 1, 1, 0)
    assert len([n for n in os.listdir(out) if n.startswith("snapshot=")]) <= 2


@pytest.mark.parametrize("batches", [60])
def test_files_stay_few_over_many_batches(spark, tmp_path, batches):
    out = str(tmp_path / "out")
    most = 0
    for n in range(batches):
        spark.createDataFrame([(n % 7, n), (100, n)], "k long, v long").coalesce(1).write.parquet(f"{out}/batch={n}")
        if (n + 1) % 5 == 0:
            SP.compact(spark, out, ["k"], "v", n, buckets=2)
        most = max(most, len(os.listdir(out)))
    assert most <= 2 * 5 + 3
    got = {r.k: r.v for r in SP.current(spark, out, ["k"], "v").collect()}
    assert got == {100: batches - 1} | {k: max(n for n in range(batches) if n % 7 == k) for k in range(7)}
    # a snapshot without its mark does not count
    os.makedirs(f"{out}/snapshot=999")
    assert {r.k: r.v for r in SP.current(spark, out, ["k"], "v").collect()} == got


def test_finished_and_silent_tasks_are_forgotten(spark, tmp_path):
    run, out, state = tmp_path / "run", str(tmp_path / "out"), str(tmp_path / "state")
    run.mkdir()
    for task in range(20):
        part(run, task, 0, "completed")
        (run / f"model-x_{task}.json").write_text("[]")

    def held():
        time.sleep(0.2)
        query = (SP.track_tasks(logs.stream_run_logs(spark, str(run)), 50, 200_000).writeStream.outputMode("update")
                 .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
        query.awaitTermination()
        return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]

    first = held()
    time.sleep(0.3)
    part(run, 99, 0, "running")
    after = held()
    assert max(first) >= 20 and after[-1] < max(first) / 2
    assert {r.task_id for r in SP.current(spark, out, ["task_id"], "version").where("completed").collect()} == set(range(20))


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.json", "one"), ("a/2.json", "zwei é"), ("b.json", "")], "name string, value string")
    store.write_named(rows, str(tmp_path / "out"))
    store.write_named(rows.where("name = 'b.json'").selectExpr("name", "'again' AS value"), str(tmp_path / "out"))
    found = {p.split("/out/")[1]: open(p).read() for p, _, _ in store.list_files(str(tmp_path / "out"))}
    assert found == {"a/1.json": "one", "a/2.json": "zwei é", "b.json": "again"}


def test_log_queries_hold_a_slice_of_files_at_a_time(spark, tmp_path, monkeypatch):
    from gradeloom.catalog import judging
    from gradeloom.catalog.registry import QUERIES

    spark.range(400).selectExpr(
        "id AS event_id", "element_at(array('view', 'click', 'error'), cast(id % 7 % 3 + 1 AS int)) AS event_type",
        "timestamp_micros(1700000000000000 + id * 1000003) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    names = ["run_logs", "progress_from_files", "progress_stream"]
    run = lambda: [sorted(map(str, QUERIES[n](spark, str(tmp_path)).collect())) for n in names]
    whole = run()
    assert len(whole[0]) == 200 + 17 and len(whole[2]) == 50
    held = []
    plain = judging.remove
    monkeypatch.setattr(judging, "remove", lambda p: (held.append(len(store.list_files(p))), plain(p)))
    monkeypatch.setattr(judging, "SLICE", 80)
    monkeypatch.setattr(judging, "STREAM_SLICE", 120)
    assert run() == whole
    assert len(held) == 3 + 3 + 2 and max(held) < 200 and sum(held) == 3 * len(whole[0])


def log_events(spark, path, n):
    spark.range(n).selectExpr(
        "id AS event_id", "element_at(array('view', 'click', 'error'), cast(id % 7 % 3 + 1 AS int)) AS event_type",
        "timestamp_micros(1700000000000000 + id * 1000003) AS ts").write.parquet(f"{path}/events.parquet")


@pytest.mark.parametrize("name", ["run_logs", "progress_from_files"])
def test_log_files_are_spread_and_empty_before_they_go(spark, tmp_path, monkeypatch, name):
    from gradeloom.catalog import judging
    from gradeloom.catalog.registry import QUERIES

    log_events(spark, tmp_path, 400)
    whole = sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect()))
    plain, emptied, gone = (judging.empty, judging.remove), [], []

    def empty(s, p):
        emptied.append(sum(size > 0 for _, size, _ in store.list_files(p)))
        plain[0](s, p)

    def remove(p):
        gone.append([(f.split("/")[-2], size) for f, size, _ in store.list_files(p)])
        plain[1](p)
        assert not os.path.exists(p)

    monkeypatch.setattr(judging, "empty", empty)
    monkeypatch.setattr(judging, "remove", remove)
    monkeypatch.setattr(judging, "SLICE", 60)
    monkeypatch.setattr(judging, "EMPTIED", 120)
    assert sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect())) == whole
    assert len(emptied) == 4 and sum(emptied) == 217 and max(emptied) < 150
    assert len(gone) == 4 and all(size == 0 for held in gone for _, size in held)
    assert all(len({folder for folder, _ in held}) > 5 for held in gone)


class Handle:
    """Stands in for the state of one group, and counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_tasks_of_a_group_share_calls_to_the_state():
    tracker, handle = SP.TaskTracker(50, 1000), Handle()
    tracker.init(handle)

    def take(now, *rows):
        handle.calls = 0
        got = {r.task_id: tuple(r)[1:5] for r in tracker.handleInputRows((7,), iter([(7, *r) for r in rows]), Clock(now))}
        assert handle.calls <= 4
        return got

    def expire():
        at = min(handle.timers)
        handle.timers.remove(at)
        list(tracker.handleExpiredTimer((7,), Clock(at), Clock(at)))
        return at, set(json.loads(handle.value[0])) if handle.value else None

    many = [(t, "part", f"1/0/{c}", "Running", 1.0) for t in range(100) for c in range(3)]
    assert take(10, *many) == {t: (False, 3, 0, 3) for t in range(100)}
    # an older report changes nothing, a newer one and a missing status do; each task knows its own parts
    assert take(20, (1, "part", "1/0/0", "completed", 0.5), (2, "part", "1/0/0", "Completed", 2.0), (3, "part", "1/0/1", None, 1.0)) == {
        1: (False, 3, 0, 3), 2: (False, 3, 1, 2), 3: (False, 3, 0, 2)}
    assert take(30, (4, "result", "", None, 2.0), (4, "part", "1/0/9", "completed", 2.0)) == {4: (True, 4, 1, 3)}
    assert take(40, (4, "part", "1/0/0", "failed", 9.0)) == {}     # late: the task is finished
    assert expire() == (80, {str(t) for t in range(100) if t != 4})
    assert take(700, (5, "part", "1/0/0", "completed", 3.0)) == {5: (False, 3, 1, 2)}
    assert expire() == (1010, {"5"})                               # heard of since
    assert take(1100, (4, "part", "1/0/0", "running", 9.0)) == {4: (False, 1, 0, 1)}
    assert expire() == (1700, {"4"}) and expire() == (2100, None) and not handle.timers


def test_state_lies_in_the_pieces_asked_for(spark, tmp_path):
    run, out, state = tmp_path / "run", str(tmp_path / "out"), str(tmp_path / "state")
    run.mkdir()
    for task in range(20):
        part(run, task, 0, "running")
    time.sleep(0.2)
    session = spark.conf.get("spark.sql.shuffle.partitions")
    SP.run(SP.track_tasks(logs.stream_run_logs(spark, str(run))), out, state, ["task_id"], "version", state_partitions=3)
    assert sorted(n for n in os.listdir(f"{state}/state/0") if n.isdigit()) == ["0", "1", "2"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == session
    assert SP.current(spark, out, ["task_id"], "version").count() == 20
