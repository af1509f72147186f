"""Queries that call a scorer, and the streams. The scorers here are fixed rules on the prompt length,
so that the checks can follow them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, rounded
from gradeloom.catalog.attempts import MATCH
from gradeloom.catalog.progress import LOGS, STATE
from gradeloom.catalog.scores import D2, FIX, GATE
from gradeloom.catalog.traces import SEG
from gradeloom.operators import judging as J, progress as P
from gradeloom.operators.generation import CHECK_TEMPLATE
from gradeloom.plans import fact_check as FC, process, quality
from gradeloom.session import fresh_path
from gradeloom.sources import logs, store
from gradeloom.sources.store import empty, move, remove, write_named
from gradeloom.streaming import progress as SP


def word_judge(prompt: str) -> str:
    if len(prompt) % 7 == 0:
        raise RuntimeError("no reply")
    return " Correct." if len(prompt) % 2 == 0 else "incorrect"


@query("apply_judge", "v_pair", MATCH.replace("{a}", "answer") + """, g AS (SELECT *, length(concat('Q', task_id, ' ', truth)) AS len, task_id % 2 = 0 AS eq FROM m)
SELECT task_id, CASE WHEN eq AND is_match THEN 'CORRECT' WHEN NOT eq THEN CASE WHEN answer IS NULL THEN 'INCORRECT' ELSE 'NOT_ATTEMPTED' END
 WHEN len % 7 = 0 THEN 'NOT_ATTEMPTED' WHEN len % 2 = 0 THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict,
 NOT ((eq AND is_match) OR (NOT eq AND answer IS NULL)) AS asked FROM g""")
def _(d):
    rows = d.v_pair.selectExpr("task_id", "truth", "answer", "CASE WHEN task_id % 2 = 0 THEN 'equivalence' ELSE 'conclusion_zh' END AS verifier",
                               "concat('Q', task_id, ' ', truth) AS prompt")
    return J.apply_judge(rows, word_judge, tries=2).select("task_id", "verdict", "asked")


def list_scorer(prompt: str) -> str:
    import json

    if len(prompt) % 5 == 0:
        return "not json"
    names = prompt.split("|")[1:]
    return json.dumps([{"criterion": n, "score": len(prompt) % 11} for n in (names[:-1] if len(prompt) % 5 == 1 else names)])


@query("score_with_retries", "v_criteria", """, p AS (SELECT query_id, dimension, list(criterion ORDER BY criterion) AS c,
 concat('Score ', query_id, '|', string_agg(criterion, '|' ORDER BY criterion)) AS prompt FROM v_criteria GROUP BY query_id, dimension)
SELECT query_id, dimension, length(prompt) % 5 > 1 AS ok, CASE WHEN length(prompt) % 5 > 1 THEN len(c) ELSE 0 END AS n_scores, CASE WHEN length(prompt) % 5 > 1 THEN 1 ELSE 3 END AS tries FROM p""")
def _(d):
    # three criteria at most per query and dimension
    rows = d.v_criteria.groupBy("query_id", "dimension").agg(F.sort_array(F.collect_list("criterion")).alias("criteria"))
    rows = rows.withColumn("model", F.lit("m")).withColumn("prompt", F.expr("concat('Score ', query_id, '|', array_join(criteria, '|'))"))
    return J.score_with_retries(rows, list_scorer).select("query_id", "dimension", "ok", F.size("scores").cast("bigint").alias("n_scores"), "tries")


def part_checker(prompt: str) -> str:
    n = len(prompt)
    if n % 13 == 0:
        return ""
    word = ("Right", "Wrong", "Conflict", "Unknown")[n % 4]
    if n % 11 == 0:
        return f'{{"statement": "s", "verification": "{word}"'
    return f'Here: {{"core_state": [{{"statement": "s", "verification": " {word} "}}, {{"statement": "t", "verification": "Right"}}]}}'


FRAME = len(CHECK_TEMPLATE) - len("{query}{part}")


@query("fact_check_chain", "v_report", SEG + f""", sg AS (SELECT doc_id, seg, length(string_agg(p, '' ORDER BY n)) + length('source of report') + {FRAME} AS n FROM rs GROUP BY ALL),
v AS (SELECT doc_id, n, n % 13 = 0 OR n % 11 = 0 AS lost FROM sg)
SELECT doc_id AS task_id, count(*) AS chunks, count(*) FILTER (lost) AS dropped_chunks, 2 * count(*) FILTER (NOT lost) AS total,
 count(*) FILTER (NOT lost) + count(*) FILTER (NOT lost AND n % 4 = 0) AS "right", count(*) FILTER (NOT lost AND n % 4 = 1) AS wrong, count(*) FILTER (NOT lost AND n % 4 = 2) AS conflict,
 count(*) FILTER (NOT lost AND n % 4 = 3) AS unknown FROM v GROUP BY doc_id""")
def _(d):
    reports = d.wide("v_report").select(F.col("doc_id").alias("task_id"), F.lit("source of report").alias("user_query"), "report")
    return FC.fact_check(reports, part_checker, tries=2)


@query("quality_board", "v_criteria v_reply_score", D2 + f""", dim AS (SELECT query_id, model, dimension, sum(score * weight) / sum(weight) AS s FROM m WHERE hit = n GROUP BY ALL),
w AS (SELECT query_id, dimension, sum(weight) AS w FROM v_criteria GROUP BY ALL),
tot AS (SELECT query_id, model, sum(s * w) / sum(w) AS t FROM dim JOIN w USING (query_id, dimension) GROUP BY ALL),
qm AS (SELECT model, avg(t) FILTER (t > 0) AS a, count(*) FILTER (t > 0) AS k FROM tot GROUP BY model),
dm AS (SELECT model, dimension, avg(s) AS s FROM dim JOIN tot USING (query_id, model) WHERE t > 0 GROUP BY ALL)
SELECT model, round(a, 9) AS average_total_score, k AS total_queries, row_number() OVER (ORDER BY a DESC, model) AS rank,
 round((SELECT avg(s) FROM dm WHERE dm.model = qm.model AND dimension NOT IN {FIX}), 9) AS meta_avg FROM qm""")
def _(d):
    weights = d.v_criteria.groupBy("query_id", "dimension").agg(F.sum("weight").alias("raw_weight"))
    return rounded(quality.quality_board(d.v_criteria, d.v_reply_score, weights), "average_total_score", "meta_avg")


ALIGNED = """, ak AS (SELECT *, reply::json AS j FROM v_alignment_reply WHERE json_valid(reply)),
an AS (SELECT unnest(['findings_to_report', 'report_to_process', 'contradiction']) AS dimension),
ag AS (SELECT * FROM ak WHERE (SELECT bool_and(coalesce(list_contains(json_keys(j, '$.' || dimension), 'score'), false)) FROM an)),
ascore AS (SELECT model, dimension, (j -> dimension ->> 'score')::double AS score FROM ag CROSS JOIN an)"""


@query("process_board", "v_process_reply v_alignment_reply", GATE + ALIGNED + """, d AS (SELECT model, dimension, avg(score) AS a FROM gs GROUP BY ALL),
ad AS (SELECT model, dimension, avg(score) AS a FROM ascore GROUP BY ALL),
b AS (SELECT model, (SELECT avg(a) FROM d WHERE d.model = r.model) AS i, (SELECT avg(a) FROM ad WHERE ad.model = r.model) AS al FROM (SELECT DISTINCT model FROM v_process_reply) r)
SELECT model, round(i, 9) AS intrinsic_avg, round(al, 9) AS alignment_avg, round(coalesce((i + al) / 2, i, al), 9) AS overall_avg,
 row_number() OVER (ORDER BY coalesce((i + al) / 2, i, al, 0) DESC, model) AS rank FROM b""")
def _(d):
    board = process.process_board(d.wide("v_process_reply"), d.wide("v_alignment_reply"))
    return rounded(board, "intrinsic_avg", "alignment_avg", "overall_avg")


FOLDERS = 64            # of a slice's files: writers in one folder wait for each other
PART_FILE = f"concat(pmod(xxhash64(task_id, chunk), {FOLDERS}), '/task_m_', task_id, '_attempt_1_retry_0_chunk_', chunk, '.json')"
RESULT_FILE = f"concat(pmod(xxhash64(task_id), {FOLDERS}), '/m_', task_id, '.json')"
SLICE = 50_000          # log files of a slice, 16 KB each
AT_ONCE = 2             # such slices that lie on disk with their content at a time
STREAM_SLICE = 100_000  # log files of a slice of the stream, which costs two micro-batches per slice and takes one at a time
EMPTIED = 8_000_000     # files without content that may lie on disk: removing files slows down making others, so it waits


def log_slices(d, files):
    """(part rows, result rows) of the logs, in slices of whole tasks with about so many files. The rows are put in order by
    slice once, so that each slice reads its own."""
    n = d.v_chunk_log.select("task_id", "chunk").distinct().count() + d.v_result_log.count()
    k = max(1, -(-n // files))
    if k == 1:
        yield d.v_chunk_log, d.v_result_log
        return
    path, slice_ = fresh_path(d.spark, "slices"), F.expr(f"pmod(xxhash64(task_id), {k})").alias("slice")
    tables = {"parts": d.v_chunk_log, "results": d.v_result_log}
    for name, rows in tables.items():
        rows.select("*", slice_).repartition(k, "slice").write.partitionBy("slice").parquet(f"{path}/{name}")
    sliced = [d.spark.read.parquet(f"{path}/{name}") for name in tables]
    for i in range(k):
        yield tuple(rows.where(F.col("slice") == i).drop("slice") for rows in sliced)


def part_files(d, rows):
    """(name, value) of the log files of the last status of each part in `rows`."""
    last = rows.groupBy("task_id", "chunk").agg(
        F.max_by("status", "seq").alias("status"), F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("start_time"),
        F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("end_time"))
    # a row is small, its file is not: as many writers as cores
    last = last.repartition(d.spark.sparkContext.defaultParallelism, "task_id", "chunk")
    meta = F.struct(F.col("task_id").cast("string").alias("task_id"), F.lit('a "{" in quotes').alias("task_description"), "status", "start_time", "end_time")
    steps = F.array_repeat(F.struct(F.lit("x" * 200).alias("message")), 60)
    return last.select(F.expr(PART_FILE).alias("name"), F.to_json(F.struct(meta.alias("task_meta"), steps.alias("step_logs"))).alias("value"))


def result_files(rows):
    return rows.selectExpr(f"{RESULT_FILE} AS name", "'[]' AS value")


def cleared(paths, files):
    """Goes through folders of emptied files, about so many in each, and removes them (with what `before` set aside) when there
    are many files, or more than the disk can take again, or at the end."""
    waiting = []
    for path in paths:
        waiting.append(path)
        if len(waiting) * files >= min(EMPTIED, store.room(path)):
            clear(waiting)
    clear(waiting)


def clear(waiting):
    while waiting:
        store.remove(before(waiting[-1]))
        remove(waiting.pop())


def before(path):
    return f"{path}-before"


def logs_of(d):
    """Rows of all log files. Files are far larger than the rows they are made from, so they are written, read and emptied in
    slices; the rows are kept."""
    kept = fresh_path(d.spark, "rows")

    def read(numbered):
        i, (parts, results) = numbered
        path = fresh_path(d.spark, "run")
        write_named(part_files(d, parts).unionByName(result_files(results)), path)
        logs.read_run_logs(d.spark, path).write.parquet(f"{kept}/slice={i}")
        empty(d.spark, path)
        return path

    with ThreadPoolExecutor(AT_ONCE) as several:
        cleared(several.map(read, enumerate(log_slices(d, SLICE))), SLICE)
    return d.spark.read.schema(logs.LOG).parquet(f"{kept}/slice=*")


@query("run_logs", LOGS, """SELECT 'part' AS kind, task_id, chunk::int AS chunk, arg_max(status, seq) AS status, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS start_time FROM v_chunk_log GROUP BY ALL
UNION ALL SELECT 'result', task_id, -1, '-', '-' FROM v_result_log""")
def _(d):
    return logs_of(d).select("kind", "task_id", F.coalesce("chunk", F.lit(-1)).alias("chunk"), F.coalesce("status", F.lit("-")).alias("status"),
                             F.coalesce("start_time", F.lit("-")).alias("start_time"))


@query("progress_from_files", LOGS, STATE + """, el AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts)))::double / 60000000 AS m FROM v_chunk_log)
SELECT completed, in_progress, greatest(0, 1000000 - completed - in_progress) AS not_started, round(m, 9) AS elapsed_minutes, round(m / completed, 9) AS minutes_per_task,
 round((greatest(0, 1000000 - completed - in_progress) + in_progress) * (m / completed), 4) AS minutes_left FROM pr, el""")
def _(d):
    rows = logs_of(d)
    out = rounded(P.eta(logs.parts(rows), P.progress_summary(logs.parts(rows), logs.results(rows), 1_000_000)), "elapsed_minutes", "minutes_per_task")
    return out.withColumn("minutes_left", F.round("minutes_left", 4))


@query("progress_stream", LOGS, STATE + " SELECT task_id, completed, chunks, chunks_completed, chunks_running FROM ts")
def _(d):
    spark, out, state = d.spark, fresh_path(d.spark, "tasks"), fresh_path(d.spark, "state")

    def look(path):
        SP.run(SP.track_tasks(logs.stream_run_logs(spark, path)), out, state, ["task_id"], "version", compact_every=1,
               state_partitions=spark.sparkContext.defaultParallelism)

    def followed():
        for parts, results in log_slices(d, STREAM_SLICE):
            # the run is looked at twice: when each part has reported once, and after all logs have been written again
            path = fresh_path(spark, "run")
            write_named(part_files(d, parts.groupBy("task_id", "chunk").agg(
                F.min_by("status", "seq").alias("status"), F.min("seq").alias("seq"), F.min("ts").alias("ts"))), path)
            look(path)
            move(path, before(path))
            empty(spark, before(path))
            write_named(part_files(d, parts).unionByName(result_files(results)), path)
            look(path)
            empty(spark, path)
            yield path   # each task lies in one slice: nothing more is heard of these

    cleared(followed(), 2 * STREAM_SLICE)
    return SP.current(spark, out, ["task_id"], "version").drop("version")


@query("progress_stream_verdicts", "v_verdict", """SELECT model, task_id, count(*) AS total, count(*) FILTER (trim(verification) = 'Right') AS "right",
 count(*) FILTER (trim(verification) = 'Wrong') AS wrong, count(*) FILTER (trim(verification) = 'Conflict') AS conflict,
 count(*) FILTER (trim(verification) NOT IN ('Right', 'Wrong', 'Conflict')) AS unknown FROM v_verdict GROUP BY ALL""")
def _(d):
    spark = d.spark
    log, out, state = fresh_path(spark, "log"), fresh_path(spark, "counts"), fresh_path(spark, "state")
    d.v_verdict.select("model", "task_id", "verification").repartition(4).write.json(log)
    keys = ["model", "task_id"]
    SP.run(SP.verdict_updates(SP.read_log(spark, log, SP.STATEMENT_LOG, max_files=2)), out, state, keys, "total", compact_every=2)
    return SP.current(spark, out, keys, "total")
