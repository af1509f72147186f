"""Calls to a scorer the caller supplies: a function from prompt text to reply text.

The call is the costly part, so rows that need none are settled before it, and a scorer's failure becomes a
value in the row instead of a failed job. Replies are kept in reliable storage before anything reads them
twice: a lost executor repeats the calls of its unfinished tasks only.

Tasks are cut by expected call time, not by bytes: prompts are small, and a partition of a few megabytes would
hold hours of calls. `deal_calls` keeps the open rows, adds up their costs (one per call unless told
otherwise) and deals them into as many tasks as make CALLS_PER_TASK each, into one per core at
least and TASKS_PER_CORE per core at most; adaptive execution does not merge such partitions. Beyond that the
tasks of a core even out by themselves, and their number must not grow with the rows: starting one, with its
shuffle blocks and its file of replies, takes longer than a quick scorer needs for all of its calls. Each task has `in_flight` calls under way in a
pool of threads, the next batch is fed while the last calls of the one before are still out, and rows keep
their order. `per_second` bounds the calls of the whole job: there are then no more tasks than cores,
and each takes its equal part of the rate.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradeloom.operators.answers import CORRECT, INCORRECT, NOT_ATTEMPTED, answer_match, parse_judgement
from gradeloom.session import cut

Scorer = Callable[[str], str]

# Verdict names come from `answers`; verifiers that settle exact matches without a call.
EXACT_FIRST = ["equivalence", "choice_abc"]
CALLS_PER_TASK = 64
TASKS_PER_CORE = 80


def deal_calls(rows: DataFrame, keys: list[str], prompt: str = "prompt", cost: Column | None = None,
               per_task: float = CALLS_PER_TASK, per_second: float | None = None) -> tuple[DataFrame, int]:
    """(the rows dealt out for calling, number of tasks). Rows go by a hash of key and prompt, so the rows of a hot
    key are spread as well. `cost` is the expected time of a row's call in units of which a task gets `per_task`, or more
    where that would make over TASKS_PER_CORE tasks per core."""
    kept = cut(rows)
    n, total = kept.agg(F.count("*"), F.sum(F.lit(1.0) if cost is None else cost)).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(-(-(total or 0) // per_task), TASKS_PER_CORE * cores), min(n, cores), 1)
    tasks = int(min(tasks, cores) if per_second else tasks)
    return kept.repartition(tasks, F.xxhash64(*keys, prompt)), tasks


class _Pace:
    """Lets calls of one task start no closer than the given time to each other."""

    def __init__(self, seconds: float):
        self.seconds, self.free, self.lock = seconds, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.seconds:
            with self.lock:
                start = max(time.monotonic(), self.free)
                self.free = start + self.seconds
            time.sleep(max(0.0, start - time.monotonic()))


class _TooLong(Exception):
    pass


def _within(scorer: Scorer, text: str, seconds: float | None) -> str:
    """The scorer's reply; a call that takes longer than `seconds` is left behind."""
    if not seconds:
        return scorer(text)
    got: list = []

    def call():
        try:
            got.append((scorer(text), None))
        except Exception as e:
            got.append((None, e))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise _TooLong
    reply, error = got[0]
    if error is not None:
        raise error
    return reply


def call_scorer(df: DataFrame, prompt: str, scorer: Scorer, *, tries: int = 3, check: Callable[[str, dict], str | None] | None = None,
                context: list[str] | None = None, in_flight: int = 8, per_second: float | None = None, tasks: int = 1,
                timeout: float | None = None, pause: float = 0.0) -> DataFrame:
    """Adds reply, error and tries. A reply that is empty, raises, or that `check` objects to is asked
    for again after `pause` seconds, `tries` times in all; then reply is null and error says why. A call longer
    than `timeout` seconds is given up at once. `check` gets the reply and the row's `context` columns. `tasks` is
    how many tasks share `per_second` (see `deal_calls`)."""
    extra = [("reply", pa.string(), T.StringType()), ("error", pa.string(), T.StringType()), ("tries", pa.int32(), T.IntegerType())]
    names = context or []
    apart = tasks / per_second if per_second else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = _Pace(apart)

        def ask(text, row):
            error = None
            for n in range(1, tries + 1):
                if pause and n > 1:
                    time.sleep(pause)
                pace.wait()
                try:
                    reply = _within(scorer, text, timeout)
                    error = "empty reply" if not reply else check(reply, row) if check else None
                    if error is None:
                        return reply, None, n
                except _TooLong:
                    return None, f"timed out after {timeout} s", n
                except Exception as e:  # any failure of the scorer is data
                    error = f"{type(e).__name__}: {e}"
            return None, error, tries

        def done(b, calls):
            got = [c.result() for c in calls]
            cols = [pa.array([g[i] for g in got], type=kind) for i, (_, kind, _) in enumerate(extra)]
            return pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *[e[0] for e in extra]])

        with ThreadPoolExecutor(in_flight) as pool:
            out: deque = deque()
            for b in batches:
                rows = [dict(zip(names, v)) for v in zip(*[b.column(c).to_pylist() for c in names])] if names else [{}] * b.num_rows
                out.append((b, [pool.submit(ask, t, r) for t, r in zip(b.column(prompt).to_pylist(), rows)]))
                # one batch ahead, so that no call waits for the last one of the batch before
                if len(out) > 1:
                    yield done(*out.popleft())
            while out:
                yield done(*out.popleft())

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, _, t in extra]])
    return df.mapInArrow(run, schema)


def ask_all(rows: DataFrame, keys: list[str], prompt: str, scorer: Scorer, *, cost: Column | None = None,
            per_second: float | None = None, **how) -> DataFrame:
    """`call_scorer` over rows dealt out by call time; the replies are kept."""
    dealt, tasks = deal_calls(rows, keys, prompt, cost, per_second=per_second)
    return cut(call_scorer(dealt, prompt, scorer, per_second=per_second, tasks=tasks, **how))


def apply_judge(answers: DataFrame, scorer: Scorer, *, tries: int = 5, **how) -> DataFrame:
    """Verdict per answer. `answers` has task_id, verifier, truth, answer and prompt.

    Exact matches are settled at once; the rest is put to the scorer (`how`: see `ask_all`). No readable reply after
    all tries: NOT_ATTEMPTED.
    """
    settled = (
        F.when(F.col("verifier").isin(EXACT_FIRST) & answer_match(F.col("truth"), F.col("answer")), CORRECT)
        .when((F.col("verifier") == "conclusion_zh") & F.col("answer").isNull(), INCORRECT)
    )
    marked = answers.withColumn("verdict", settled)
    free = marked.where("verdict IS NOT NULL").withColumn("asked", F.lit(False))
    open_ = marked.where("verdict IS NULL").drop("verdict")
    asked = (
        ask_all(open_, ["task_id"], "prompt", scorer, tries=tries, **how)
        .withColumn("verdict", F.coalesce(parse_judgement(F.col("verifier"), F.col("reply")), F.lit(NOT_ATTEMPTED)))
        .withColumn("asked", F.lit(True)).drop("reply", "error", "tries")
    )
    return free.unionByName(asked)


def _scores_missing(reply: str, row: dict) -> str | None:
    """Objection to a score reply: no JSON list, or a criterion without a number."""
    import json

    given = {item["criterion"]: float(item["score"]) for item in json.loads(reply)}
    lost = [c for c in row["criteria"] if c not in given]
    return f"no score for {lost[0]}" if lost else None


def score_with_retries(dimensions: DataFrame, scorer: Scorer, *, tries: int = 3, **how) -> DataFrame:
    """Criterion scores per dimension: (…, ok, scores, error, tries). `dimensions` has query_id, model,
    dimension, prompt and the array criteria. A dimension that fails all tries is empty and not ok, so
    it is neither cached nor counted. `how`: see `ask_all`."""
    asked = ask_all(dimensions, ["query_id", "model", "dimension"], "prompt", scorer, tries=tries, check=_scores_missing,
                    context=["criteria"], **how)
    scores = F.from_json("reply", "array<struct<criterion:string,score:double>>")
    return asked.withColumn("ok", F.col("reply").isNotNull()).withColumn(
        "scores", F.when(F.col("ok"), scores).otherwise(F.array().cast("array<struct<criterion:string,score:double>>")))
