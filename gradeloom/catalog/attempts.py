"""Queries over answers, attempts and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, rounded
from gradeloom.operators import answers as A, attempts as T

K = 3


@query("valid_answer", "v_answer", """SELECT task_id, coalesce(answer, '') <> '' AND NOT regexp_matches(coalesce(answer, ''),
'NO_ANSWER|INSUFFICIENT_INFO|CANNOT_DETERMINE|None|none|N/A|n/a|NONE|Unknown|unknown|UNKNOWN|No \\\\boxed\\{\\} content found\\.') AS is_valid FROM v_answer""")
def _(d):
    return d.v_answer.select("task_id", A.valid_answer(F.col("answer")).alias("is_valid"))


MATCH = """, n AS (SELECT *, coalesce(try_cast(translate(a, '$%,', '') AS double), 'inf'::double) AS an,
 try_cast(truth AS double) AS tn FROM (SELECT *, {a} AS a FROM v_pair)),
 m AS (SELECT task_id, truth, answer, coalesce(CASE WHEN tn IS NOT NULL THEN an = tn
   WHEN regexp_matches(truth, '[,;]') THEN
     len(regexp_split_to_array(truth, '[,;]')) = len(regexp_split_to_array(a, '[,;]')) AND
     len(list_filter(range(1, len(regexp_split_to_array(truth, '[,;]')) + 1), lambda i: NOT (
       CASE WHEN try_cast(regexp_split_to_array(truth, '[,;]')[i] AS double) IS NOT NULL
         THEN coalesce(try_cast(translate(regexp_split_to_array(a, '[,;]')[i], '$%,', '') AS double), 'inf'::double) = try_cast(regexp_split_to_array(truth, '[,;]')[i] AS double)
         ELSE lower(regexp_replace(regexp_split_to_array(a, '[,;]')[i], '\\s', '', 'g')) = lower(regexp_replace(regexp_split_to_array(truth, '[,;]')[i], '\\s', '', 'g')) END))) = 0
   ELSE lower(regexp_replace(a, '[\\s[:punct:]]', '', 'g')) = lower(regexp_replace(truth, '[\\s[:punct:]]', '', 'g')) END, false) AS is_match FROM n)"""
MATCHED = MATCH + " SELECT task_id, truth, answer, is_match FROM m"


@query("answer_match", "v_pair", MATCHED.replace("{a}", "answer"))
def _(d):
    return A.match_answers(d.v_pair)


@query("answer_match_none", "v_pair", MATCHED.replace("{a}", "coalesce(answer, 'None')"))
def _(d):
    return A.match_answers(d.v_pair, missing="None")


@query("parse_judgement", "v_judge_reply", """SELECT event_id, verifier, coalesce(CASE verifier
 WHEN 'equivalence' THEN CASE lower(rtrim(trim(reply), '.')) WHEN 'correct' THEN 'CORRECT' WHEN 'incorrect' THEN 'INCORRECT' END
 WHEN 'choice_ab' THEN CASE regexp_extract(reply, '[AB]') WHEN 'A' THEN 'CORRECT' WHEN 'B' THEN 'INCORRECT' END
 WHEN 'choice_abc' THEN CASE regexp_extract(reply, '[ABC]') WHEN 'A' THEN 'CORRECT' WHEN 'B' THEN 'INCORRECT' END
 WHEN 'yes_no' THEN CASE reply WHEN 'yes' THEN 'CORRECT' WHEN 'no' THEN 'INCORRECT' END
 WHEN 'conclusion_zh' THEN CASE regexp_extract(reply, '结论:*\\s*(正确|错误)', 1) WHEN '正确' THEN 'CORRECT' WHEN '错误' THEN 'INCORRECT' END
 ELSE CASE WHEN regexp_matches(reply, '"answer_score":\\s*1') THEN 'CORRECT' WHEN regexp_matches(reply, '"answer_score":\\s*0') THEN 'INCORRECT'
   WHEN regexp_matches(reply, '"score":\\s*1') THEN 'CORRECT' WHEN regexp_matches(reply, '"score":\\s*0') THEN 'INCORRECT' END END, 'NOT_ATTEMPTED') AS verdict
FROM v_judge_reply""")
def _(d):
    return d.v_judge_reply.select(
        "event_id", "verifier", A.parse_judgement(F.col("verifier"), F.col("reply")).alias("verdict"))


@query("route_verifier", "v_benchmark_name", """, rules(prio, part, verifier) AS (VALUES (1, 'gaia', 'equivalence'), (2, 'finsearchcomp', 'score_json'),
 (3, 'simpleqa', 'choice_abc'), (4, 'xbench', 'conclusion_zh'), (5, 'browsecomp-zh', 'choice_ab_zh'), (6, 'browsecomp', 'choice_ab'), (7, 'hle', 'yes_no'),
 (8, 'webwalkerqa', 'equivalence'), (9, 'frames', 'equivalence'), (10, 'seal', 'equivalence'))
SELECT task_id, benchmark, coalesce(arg_min(verifier, prio), 'equivalence') AS verifier FROM v_benchmark_name
 LEFT JOIN rules ON contains(benchmark, part) GROUP BY ALL""")
def _(d):
    return d.v_benchmark_name.withColumn("verifier", A.route_verifier(F.col("benchmark")))


PASS = """, a AS (SELECT *, min(retry_id) FILTER (is_valid_box) OVER (PARTITION BY task_id, attempt_id) AS stop FROM v_attempt WHERE attempt_id <= 3 AND retry_id < 5),
s AS (SELECT task_id, attempt_id, coalesce(bool_or(is_correct) FILTER (retry_id = stop), false) AS won, count(*) FILTER (stop IS NULL OR retry_id <= stop) AS retries FROM a GROUP BY ALL),
w AS (SELECT *, min(attempt_id) FILTER (won) OVER (PARTITION BY task_id) AS won_at FROM s),
pk AS (SELECT task_id, bool_or(won) AS pass_at_k_success, count(*) FILTER (won_at IS NULL OR attempt_id <= won_at) AS total_attempts,
  cast(coalesce(sum(retries) FILTER (won_at IS NULL OR attempt_id <= won_at), 0) AS bigint) AS total_retries FROM w GROUP BY task_id)"""


@query("pass_at_k", "v_attempt", PASS + " SELECT * FROM pk")
def _(d):
    return T.pass_at_k(d.v_attempt, K)


@query("accuracy", "v_attempt", PASS + """ SELECT task_id % 7 AS benchmark, count(*) AS tasks, count(*) FILTER (pass_at_k_success) AS passed,
round(avg(pass_at_k_success::int), 9) AS accuracy FROM pk GROUP BY 1""")
def _(d):
    passed = T.pass_at_k(d.v_attempt, K).withColumn("benchmark", F.col("task_id") % 7)
    return rounded(T.accuracy(passed, "benchmark"), "accuracy")


@query("run_statistics", "v_attempt", PASS + """, r AS (SELECT task_id % 13 AS run, round(avg(pass_at_k_success::int) * 100, 2) AS s FROM pk GROUP BY 1)
SELECT run % 2 AS bench, count(*) AS num_runs, round(avg(s), 9) AS average_score, round(coalesce(stddev_samp(s), 0), 9) AS std_dev, min(s) AS min_score, max(s) AS max_score FROM r GROUP BY 1""")
def _(d):
    passed = T.pass_at_k(d.v_attempt, K).withColumn("run", F.col("task_id") % 13)
    runs = T.accuracy(passed, "run").select(
        (F.col("run") % 2).alias("bench"),
        F.concat(F.round(F.col("accuracy") * 100, 2).cast("string"), F.lit("%")).alias("score"))
    return rounded(T.run_statistics(runs, "bench"), "average_score", "std_dev")


@query("primary_attempt", "v_attempt", """, o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempt_id, retry_id) AS n FROM v_attempt),
p AS (SELECT task_id, arg_min(n, n) AS h, arg_min(answer, n) AS ha, arg_min(n, n) FILTER (status = 'completed' AND answer <> '') AS f,
  max(n) FILTER (status = 'completed') AS t FROM o GROUP BY task_id)
SELECT o.task_id, attempt_id, retry_id, answer, status FROM p JOIN o ON o.task_id = p.task_id
 AND o.n = CASE WHEN ha <> '' THEN h ELSE coalesce(f, t, h) END""")
def _(d):
    return T.primary_attempt(d.v_attempt)


@query("prior_summaries", "v_attempt", """SELECT a.task_id, a.attempt_id, a.retry_id,
 (SELECT cast(count(*) AS int) FROM v_attempt b WHERE b.task_id = a.task_id AND b.attempt_id = a.attempt_id AND b.retry_id < a.retry_id AND b.failure <> '') AS n_prior,
 coalesce((SELECT '=== Previous Attempts Analysis ===' || chr(10) || 'The following summarizes what was tried before and why it did not work.' || chr(10)
   || 'Use this to guide a NEW approach. Avoid repeating the same mistakes.' || chr(10) || chr(10)
   || string_agg('[Attempt ' || rn || ']' || chr(10) || failure || chr(10), '' ORDER BY rn)
   || chr(10) || '=== End of Previous Attempts ===' || chr(10) || 'Based on the above analysis, try a different approach.' || chr(10) FROM (
   SELECT failure, row_number() OVER (ORDER BY retry_id) AS rn FROM v_attempt b WHERE b.task_id = a.task_id AND b.attempt_id = a.attempt_id
     AND b.retry_id < a.retry_id AND b.failure <> '') x), '') AS prior_text FROM v_attempt a""")
def _(d):
    return T.prior_summaries(d.v_attempt).select("task_id", "attempt_id", "retry_id", "n_prior", "prior_text")
