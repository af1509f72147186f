import time

from pyspark.sql import functions as F

from gradeloom.operators import judging as J, progress as P
from gradeloom.plans.fact_check import fact_check, ratios
from gradeloom.streaming import progress as SP


def test_failures_are_values(spark):
    seen = {}

    def flaky(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "dead" or seen[prompt] < 3 and prompt == "slow":
            raise ValueError("down")
        return "Correct" if prompt != "mute" else ""

    df = spark.createDataFrame([("dead",), ("slow",), ("fine",), ("mute",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.reply, r.tries, r.error) for r in J.call_scorer(df, "prompt", flaky, tries=3).collect()}
    assert got == {"dead": (None, 3, "ValueError: down"), "slow": ("Correct", 3, None), "fine": ("Correct", 1, None), "mute": (None, 3, "empty reply")}


def test_exact_matches_cost_no_call(spark):
    calls = spark.sparkContext.accumulator(0)

    def judge(prompt):
        calls.add(1)
        return "incorrect" if prompt == "p2" else "who knows"

    rows = [(1, "equivalence", "5", "$5", "p1"), (2, "equivalence", "x", "y", "p2"), (3, "yes_no", "x", "x", "p3"), (4, "conclusion_zh", "x", None, "p4")]
    df = spark.createDataFrame(rows, "task_id int, verifier string, truth string, answer string, prompt string")
    out = J.apply_judge(df, judge, tries=1)
    got = {r.task_id: r.verdict for r in out.collect()}
    assert got == {1: "CORRECT", 2: "INCORRECT", 3: "NOT_ATTEMPTED", 4: "INCORRECT"} and calls.value == 2


def test_incomplete_scores_are_asked_again(spark):
    df = spark.createDataFrame([(1, "m", "a", "short", ["x", "y"]), (1, "m", "b", "full", ["x"])], "query_id int, model string, dimension string, prompt string, criteria array<string>")
    got = {r.dimension: (r.ok, len(r.scores), r.tries) for r in J.score_with_retries(df, lambda p: '[{"criterion": "x", "score": 7, "analysis": "-"}]', in_flight=2).collect()}
    assert got == {"a": (False, 0, 3), "b": (True, 1, 1)}


def test_calls_use_all_cores_and_keep_their_rows(spark):
    from pyspark import TaskContext

    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS task_id", "id", "concat('p', id) AS prompt")
    got = J.ask_all(rows, ["task_id"], "prompt", lambda p: f"{p} {TaskContext.get().partitionId()}").collect()
    assert {r.reply.split()[0] for r in got} == {f"p{i}" for i in range(20_000)}
    assert all(r.reply.split()[0] == r.prompt for r in got)
    per_task = {}
    for r in got:
        per_task[r.reply.split()[1]] = per_task.get(r.reply.split()[1], 0) + 1
    assert len(per_task) >= 300 and max(per_task.values()) < 3 * J.CALLS_PER_TASK
    assert J.deal_calls(rows.limit(3), ["task_id"])[1] == 3 and J.deal_calls(rows.limit(0), ["task_id"])[1] == 1


def test_expected_time_cuts_tasks(spark):
    rows = spark.range(1000).selectExpr("id AS task_id", "concat('p', id) AS prompt", "id % 10 AS pages")
    assert J.deal_calls(rows, ["task_id"], cost=F.col("pages"), per_task=45)[1] == 100
    assert J.deal_calls(rows, ["task_id"], per_task=1, per_second=5.0)[1] == spark.sparkContext.defaultParallelism


def test_tasks_do_not_grow_with_the_rows(spark):
    rows = spark.range(200_000).selectExpr("id AS task_id", "concat('p', id) AS prompt")
    most = J.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    dealt, tasks = J.deal_calls(rows, ["task_id"])
    assert tasks == dealt.rdd.getNumPartitions() == most < 200_000 / J.CALLS_PER_TASK
    asked = J.call_scorer(dealt, "prompt", lambda p: p[1:], tasks=tasks)
    assert asked.where("reply = task_id").count() == 200_000


def test_several_calls_are_under_way(spark):
    active = []

    def slow(prompt):
        active.append(prompt)
        time.sleep(0.2)
        most = len(active)
        active.remove(prompt)
        return f"{prompt} {most}"

    rows = spark.range(40).selectExpr("concat('p', id) AS prompt").coalesce(1)
    got = [r.reply.split() for r in J.call_scorer(rows, "prompt", slow, in_flight=20).collect()]
    assert [p for p, _ in got] == [f"p{i}" for i in range(40)] and 10 <= max(int(n) for _, n in got) <= 20


def test_rate_and_time_limits(spark):
    rows = spark.range(12).selectExpr("concat('p', id) AS prompt").coalesce(1)
    start = time.monotonic()
    assert len(J.call_scorer(rows, "prompt", lambda p: p, per_second=10.0, tasks=2).collect()) == 12
    assert time.monotonic() - start >= 11 * 0.2
    late = J.call_scorer(rows.limit(2), "prompt", lambda p: time.sleep(3) if p == "p0" else p, timeout=0.3).collect()
    assert {(r.prompt, r.reply, r.error, r.tries) for r in late} == {("p0", None, "timed out after 0.3 s", 1), ("p1", "p1", None, 1)}


def test_fact_check(spark):
    reports = spark.createDataFrame([("m/1", "q", "# T\n\none\n\ntwo\n\nbroken"), ("m/2", "q", "three")], "task_id string, user_query string, report string")

    def check(prompt):
        assert "[user_query start]>>>\nq\n" in prompt
        if "broken" in prompt:
            raise TimeoutError
        return '```json\n{"core_state": [{"statement": "s", "verification": "Right"}, {"statement": "u", "verification": "Wrong"}]\n```'

    got = {r.task_id: (r.chunks, r.dropped_chunks, r.total, r.right) for r in fact_check(reports, check, in_flight=2, tries=1).collect()}
    assert got == {"m/1": (3, 1, 4, 2), "m/2": (1, 0, 2, 1)}
    board = ratios(fact_check(reports, check, in_flight=2, tries=1).selectExpr("*", "substring_index(task_id, '/', 1) AS model")).first()
    assert (board.micro, board.macro, board.tasks) == (0.5, 0.5, 2)


def test_stream_follows_new_files_and_restarts(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    rows = [(1, 0, 1, "running"), (1, 1, 2, "running"), (2, 0, 3, "failed"), (1, 0, 4, "completed"), (2, 0, 5, "running")]
    df = spark.createDataFrame(rows, "task_id long, chunk long, seq long, status string")
    keys = ["task_id", "chunk"]
    for part in ("seq <= 3", "seq > 3"):
        df.where(part).coalesce(1).write.mode("append").json(log)
        SP.run(SP.status_updates(SP.read_log(spark, log, SP.STATUS_LOG, 1)), out, state, keys, "seq")
    got = {(r.task_id, r.chunk): r.status for r in SP.current(spark, out, keys, "seq").collect()}
    want = {(r.task_id, r.chunk): r.status for r in P.latest_status(df).collect()}
    assert got == want == {(1, 0): "completed", (1, 1): "running", (2, 0): "running"}


def test_progress_and_time_left(spark):
    chunks = spark.createDataFrame([(1, "completed"), (2, "Running"), (2, "completed")], "task_id int, status string")
    results = spark.createDataFrame([(1,), (9,)], "task_id int")
    summary = P.progress_summary(chunks, results, 2)
    row = summary.first()
    assert (row.completed, row.in_progress, row.not_started, row.chunks, row.chunks_running) == (2, 1, 0, 2, 1)
    times = spark.createDataFrame([("2025-01-01T10:00:00Z", "2025-01-01T10:30:00.5+08:00"), ("", None)], "start_time string, end_time string")
    left = P.eta(times, summary).first()
    assert round(left.elapsed_minutes, 4) == 30.0083 and round(left.minutes_left, 4) == 15.0042
    none = P.eta(times, P.progress_summary(chunks.where("task_id = 2"), results.where("task_id < 0"), 5)).first()
    assert none.minutes_left is None
