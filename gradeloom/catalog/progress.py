"""Queries over run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, rounded
from gradeloom.operators import progress as P

SPAN = """, sp AS (SELECT span_id, max(path) FILTER (type = 'span_start') AS path,
 (max(epoch_us(ts)) FILTER (type = 'span_end') - min(epoch_us(ts)) FILTER (type = 'span_start')) // 1000 AS duration_ms FROM v_span GROUP BY span_id)"""


@query("span_durations", "v_span", SPAN + " SELECT * FROM sp")
def _(d):
    return P.span_durations(d.v_span)


@query("span_durations_by_path", "v_span", SPAN + " SELECT path, count(*) AS spans, cast(sum(duration_ms) AS bigint) AS total_ms, max(duration_ms) AS max_ms FROM sp WHERE duration_ms IS NOT NULL GROUP BY path")
def _(d):
    return P.durations_by_path(P.span_durations(d.v_span))


@query("price_calls", "", """SELECT o_orderkey AS call_id, concat('NATION_', o_custkey % 30) AS model, o_custkey AS input_tokens, o_orderkey % 777 AS output_tokens,
round(o_custkey / 1000.0::double * ((n_nationkey + 1) / 8.0::double) + (o_orderkey % 777) / 1000.0::double * (n_regionkey + 1), 9) AS cost,
round((o_custkey * 1.25::double + (o_orderkey % 777) * 10) / 1000000, 9) AS rough FROM orders LEFT JOIN nation ON n_name = concat('NATION_', o_custkey % 30)""")
def _(d):
    calls = d.orders.selectExpr("o_orderkey AS call_id", "concat('NATION_', o_custkey % 30) AS model", "o_custkey AS input_tokens", "o_orderkey % 777 AS output_tokens")
    prices = d.nation.selectExpr("n_name AS model", "CAST((n_nationkey + 1) / 8 AS DOUBLE) AS input_price", "CAST(n_regionkey + 1 AS DOUBLE) AS output_price")
    out = P.price_calls(calls, prices).withColumn("rough", P.rough_cost(F.col("input_tokens"), F.col("output_tokens")))
    return rounded(out, "cost", "rough")


STATE = """, lt AS (SELECT task_id, chunk, lower(arg_max(status, seq)) AS status FROM v_chunk_log GROUP BY ALL),
ts AS (SELECT task_id, task_id IN (SELECT task_id FROM v_result_log) AS completed, count(*) AS chunks, count(*) FILTER (status = 'completed') AS chunks_completed,
  count(*) FILTER (status = 'running') AS chunks_running FROM lt GROUP BY task_id),
pr AS (SELECT (SELECT count(*) FROM v_result_log) AS completed, count(*) FILTER (NOT completed) AS in_progress, cast(coalesce(sum(chunks) FILTER (NOT completed), 0) AS bigint) AS chunks,
  cast(coalesce(sum(chunks_completed) FILTER (NOT completed), 0) AS bigint) AS chunks_completed, cast(coalesce(sum(chunks_running) FILTER (NOT completed), 0) AS bigint) AS chunks_running FROM ts)"""
LOGS = "v_chunk_log v_result_log"


@query("latest_status", LOGS, "SELECT task_id, chunk, arg_max(status, seq) AS status FROM v_chunk_log GROUP BY ALL")
def _(d):
    return P.latest_status(d.v_chunk_log)


@query("task_states", LOGS, STATE + " SELECT * FROM ts")
def _(d):
    return P.task_states(P.latest_status(d.v_chunk_log), d.v_result_log)


@query("progress_summary", LOGS, STATE + " SELECT *, greatest(0, 1000000 - completed - in_progress) AS not_started FROM pr")
def _(d):
    return P.progress_summary(P.latest_status(d.v_chunk_log), d.v_result_log, 1_000_000)


@query("eta", LOGS, STATE + """, el AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts)))::double / 60000000 AS m FROM v_chunk_log)
SELECT completed, in_progress, greatest(0, 1000000 - completed - in_progress) AS not_started, round(m, 9) AS elapsed_minutes, round(m / completed, 9) AS minutes_per_task,
 round((greatest(0, 1000000 - completed - in_progress) + in_progress) * (m / completed), 4) AS minutes_left FROM pr, el""")
def _(d):
    log = d.v_chunk_log
    times = log.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("start_time")).withColumn("end_time", F.col("start_time"))
    summary = P.progress_summary(P.latest_status(log), d.v_result_log, 1_000_000)
    out = rounded(P.eta(times, summary), "elapsed_minutes", "minutes_per_task")
    return out.withColumn("minutes_left", F.round("minutes_left", 4))
