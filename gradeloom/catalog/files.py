"""Queries of loaders, writers, selection and reuse.

A loader needs files, so its query first writes the table as JSON below the shared folder, in the
layout of the loader, and then loads that. The checks read the tables directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query
from gradeloom.operators import select as L
from gradeloom.session import fresh_path
from gradeloom.sources import entries as E, sinks
from gradeloom.sources.benchmarks import standardize_benchmark

FILE = r"/file=([^/]+)/"


def _array_files(rows, path):
    """JSON-array files, one per value of `file`, for the loaders to read: at most a thousand rows each."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in ("file", "pos")]))
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", body.alias("j")))), lambda x: x["j"])
    rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(items, ",\n"), F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    return path


def _entries(d):
    """Entries of up to a thousand ids to a file; some without response, some with both question fields."""
    return d.documents.selectExpr(
        "concat(source, '_text_', (doc_id - doc_id % 1000) div 1000) AS file", "doc_id AS pos", "doc_id AS id",
        "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN concat('rw ', doc_id) END AS rewritten_query", "concat('q ', doc_id) AS query",
        "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN NULL ELSE text END AS response",
        "CASE WHEN doc_id % 2 = 0 THEN array(named_struct('filename', 'f.txt', 'type', 'txt', 'dir', concat('d/', doc_id), 'size', '1')) ELSE array() END AS files",
        "named_struct('category', lang) AS annotation")


@query("load_entries_array", "", """SELECT concat(source, '_text_', doc_id // 1000, '/', doc_id) AS task_id, text AS task_question,
CASE WHEN doc_id % 3 = 1 THEN concat('rw ', doc_id) ELSE concat('q ', doc_id) END AS user_query, concat(source, '_text_', doc_id // 1000) AS model,
CASE WHEN doc_id % 2 = 0 THEN concat('d/', doc_id) ELSE 'none' END AS file, lang AS category FROM documents WHERE doc_id % 7 > 1""")
def _(d):
    path = _array_files(_entries(d), fresh_path(d.spark, "entries"))
    return E.load_entries_array(d.spark, path, FILE).select(
        "task_id", "task_question", "user_query", "model", F.coalesce(F.col("files")[0]["dir"], F.lit("none")).alias("file"), "annotation.category")


@query("load_entries_ranges", "", """SELECT concat(source, '_text_', doc_id // 1000, '/', doc_id) AS task_id, text AS task_question,
CASE WHEN doc_id % 3 = 1 THEN concat('rw ', doc_id) ELSE concat('q ', doc_id) END AS user_query, concat(source, '_text_', doc_id // 1000) AS model,
CASE WHEN doc_id % 2 = 0 THEN concat('d/', doc_id) ELSE 'none' END AS file, lang AS category FROM documents WHERE doc_id % 7 > 1""")
def _(d):
    # ranges far smaller than a file, so that items lie across their borders
    path = _array_files(_entries(d), fresh_path(d.spark, "entries"))
    return E.load_entries_array(d.spark, path, FILE, range_bytes=50_000, suffix=".txt").select(
        "task_id", "task_question", "user_query", "model", F.coalesce(F.col("files")[0]["dir"], F.lit("none")).alias("file"), "annotation.category")


def _task_lines(d):
    """Task lines with blank lines between them and, for every eleventh, no valid JSON."""
    line = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("task_question"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("ground_truth"),
        F.struct("source").alias("metadata")))
    one = F.expr("concat(',\"file_path\":\"a/', doc_id, '\"}')")
    two = F.expr("concat(',\"file_path\":[\"a/', doc_id, '\",\"b\"]}')")
    body = F.regexp_replace(line, r"\}$", "")
    with_path = F.when(F.col("doc_id") % 3 == 0, F.concat(body, one)).when(F.col("doc_id") % 3 == 1, F.concat(body, two)).otherwise(line)
    broken = F.when(F.col("doc_id") % 11 == 5, F.concat(with_path, F.lit(" }"))).otherwise(with_path)
    path = fresh_path(d.spark, "lines")
    d.documents.select(F.concat(broken, F.lit("\n")).alias("value")).write.text(path)
    return path


@query("load_tasks_jsonl", "", """SELECT doc_id::string AS task_id, text AS task_question, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS ground_truth,
CASE doc_id % 3 WHEN 0 THEN concat('a/', doc_id) WHEN 1 THEN concat('a/', doc_id, ',b') ELSE '-' END AS paths, source FROM documents WHERE doc_id % 11 <> 5""")
def _(d):
    return E.load_tasks_jsonl(d.spark, _task_lines(d)).select(
        "task_id", "task_question", "ground_truth", F.coalesce(F.array_join("file_path", ","), F.lit("-")).alias("paths"), F.col("metadata")["source"].alias("source"))


@query("load_tasks_jsonl_rejects", "", "SELECT count(*) AS rejected FROM documents WHERE doc_id % 11 = 5")
def _(d):
    return E.rejected_lines(d.spark, _task_lines(d)).agg(F.count("*").alias("rejected"))


@query("load_tasks_dir", "", """SELECT concat('m', item_id % 3, '/', item_id) AS task_id, text AS task_question, concat('q', item_id) AS user_query, concat('m', item_id % 3) AS model,
CASE WHEN item_id % 5 = 0 THEN 'T' ELSE '-' END AS topic, CASE WHEN item_id % 5 = 1 THEN 'p.txt' ELSE '-' END AS file_path FROM benchmark WHERE item_id % 5 < 3""")
def _(d):
    made = d.benchmark.selectExpr("concat('m', item_id % 3) AS model", "item_id AS item", """CASE item_id % 5
        WHEN 0 THEN to_json(named_struct('topic', 'T', 'entries', array(named_struct('query', concat('q', item_id), 'response', text))))
        WHEN 1 THEN to_json(named_struct('query', concat('q', item_id), 'response', text, 'attachments', 'p.txt', 'entries', CAST(array() AS array<string>)))
        WHEN 2 THEN to_json(named_struct('user_query', concat('q', item_id), 'response', text))
        WHEN 3 THEN to_json(named_struct('rewritten_query', concat('q', item_id), 'response', text))
        ELSE to_json(named_struct('query', '', 'response', text)) END AS value""")
    path = fresh_path(d.spark, "items")
    made.write.partitionBy("model", "item").text(path)
    return E.load_tasks_dir(d.spark, path, r"/model=([^/]+)/", r"/item=([^/]+)/").select(
        "task_id", "task_question", "user_query", "model", F.coalesce("topic", F.lit("-")).alias("topic"), F.coalesce("file_path", F.lit("-")).alias("file_path"))


@query("load_results_glob", "", """WITH f AS (SELECT *, concat('m', doc_id % 4) AS model,
 concat('m', doc_id % 4, CASE WHEN doc_id % 4 = 3 OR doc_id % 8 < 4 THEN '_multimodal_' ELSE '_text_' END, 1000 + doc_id // 200) AS file FROM documents)
SELECT model, doc_id::string AS id, text AS response FROM f WHERE file = (SELECT min(g.file) FROM f g WHERE g.model = f.model
 AND (contains(g.file, '_text_') OR f.model = 'm3'))""")
def _(d):
    rows = d.documents.selectExpr(
        "concat('m', doc_id % 4, CASE WHEN doc_id % 4 = 3 OR doc_id % 8 < 4 THEN '_multimodal_' ELSE '_text_' END, 1000 + doc_id div 200) AS file",
        "doc_id AS pos", "doc_id AS id", "text AS response")
    path = _array_files(rows, fresh_path(d.spark, "results"))
    return E.load_results_glob(d.spark, path, ["m0", "m1", "m2", "m3", "m9"], "text", FILE, "*.txt").select("model", "id", "response")


CELLS = """, c AS (SELECT model, task_id, count(*) AS total, count(*) FILTER (trim(verification) = 'Right') AS r, count(*) FILTER (trim(verification) = 'Wrong') AS w,
 count(*) FILTER (trim(verification) = 'Conflict') AS x FROM v_verdict GROUP BY ALL)"""


@query("load_score_cells", "v_verdict", CELLS + """ SELECT task_id::string AS task_id, model, r::int AS "right", w::int AS wrong, x::int AS conflict, (total - r - w - x)::int AS unknown
FROM c WHERE NOT (model = 'm4' AND task_id % 2 = 0)""")
def _(d):
    from gradeloom.operators.scores import verdict_counts

    counts = verdict_counts(d.v_verdict, "task_id", "model")
    cell = F.when(~((F.col("model") == "m4") & (F.col("task_id") % 2 == 0)), F.struct("right", "wrong", "conflict", "unknown"))
    # ten models per task
    per_task = counts.select("task_id", F.struct("model", cell.alias("cell")).alias("e")).groupBy("task_id").agg(
        F.map_from_entries(F.collect_list("e")).alias("m"))
    path = fresh_path(d.spark, "cells")
    per_task.select(F.to_json(F.create_map(F.col("task_id").cast("string"), F.col("m")), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return E.load_score_cells(d.spark, path, "factuality", whole_files=False)


@query("split_entries", "", """SELECT doc_id AS id, source FROM (SELECT * FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 400) WHERE doc_id % 5 <> 0""")
def _(d):
    rows = d.documents.selectExpr("doc_id AS id", "doc_id AS pos", "lang AS category", "source")
    return E.split_entries(rows, rows.where("id % 5 = 0"), "en", 400).select("id", "source")


@query("ground_truth_coalesce", "", """SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN p_name WHEN p_partkey % 4 = 1 THEN p_type ELSE '' END AS truth FROM part""")
def _(d):
    made = d.part.selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS a", "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS b")
    return made.select("p_partkey", E.ground_truth_coalesce(F.col("a"), F.col("b")).alias("truth"))


@query("standardize_benchmark", "", """WITH b AS (SELECT *, p_partkey % 11 AS k, p_partkey AS i FROM part)
SELECT CASE k WHEN 1 THEN i::string WHEN 6 THEN CASE WHEN i % 2 = 0 THEN concat('futurex_test_', i) ELSE concat('id', i) END WHEN 8 THEN i::string WHEN 9 THEN i::string ELSE concat('id', i) END AS task_id,
 p_name AS task_question, CASE k WHEN 6 THEN '' WHEN 7 THEN CASE WHEN i % 2 = 0 THEN p_type ELSE p_brand END ELSE p_type END AS ground_truth,
 CASE k WHEN 2 THEN concat('f/', i) WHEN 4 THEN concat('f/', i) ELSE '-' END AS file_path,
 CASE k WHEN 6 THEN concat('dataset_name=Futurex-Online;end_time=;level=', p_size, ';original_id=', CASE WHEN i % 2 = 0 THEN '' ELSE concat('id', i) END, ';source=futurex-ai/Futurex-Online;split=test')
  WHEN 7 THEN concat('dataset_name=FinSearchComp;ground_truth_finance=', p_brand, ';judge_prompt_template=t', p_size, ';original_id=id', i, ';response_reference=', CASE WHEN i % 2 = 0 THEN p_type ELSE '' END, ';source=ByteSeedXpert/FinSearchComp;split=test')
  WHEN 10 THEN concat('reference_steps=s', p_size) ELSE concat('level=', p_size) END AS meta FROM b""")
def _(d):
    raw = """CASE p_partkey % 11
        WHEN 0 THEN to_json(map('Unnamed: 0', id, 'Prompt', p_name, 'Answer', p_type, 'level', size))
        WHEN 1 THEN to_json(map('question', p_name, 'answer', p_type, 'level', size))
        WHEN 2 THEN to_json(map('task_id', id, 'Question', p_name, 'Final answer', p_type, 'file_path', file, 'file_name', 'x', 'level', size))
        WHEN 3 THEN to_json(map('task_id', id, 'Question', p_name, 'answer', p_type, 'level', size))
        WHEN 4 THEN to_json(map('id', id, 'question', p_name, 'answer', p_type, 'image', file, 'image_preview', 'x', 'rationale_image', 'y', 'level', size))
        WHEN 5 THEN to_json(map('id', id, 'Question', p_name, 'answer', p_type, 'level', size))
        WHEN 6 THEN to_json(map(IF(p_partkey % 2 = 0, 'nothing', 'id'), id, 'prompt', p_name, 'level', size, 'other', 'dropped'))
        WHEN 7 THEN to_json(map('prompt_id', id, 'prompt', p_name, 'response_reference', IF(p_partkey % 2 = 0, p_type, ''), 'ground_truth', p_brand, 'judge_prompt_template', concat('t', size)))
        WHEN 8 THEN to_json(map('problem', p_name, 'answer', p_type, 'canary', 'c', 'level', size))
        WHEN 9 THEN to_json(map('Question', p_name, 'Answer', p_type, 'canary', 'c', 'level', size))
        ELSE to_json(map('id', id, 'prompt', p_name, 'answer', p_type, 'canary', 'c', 'reference_steps', concat('s', size))) END"""
    from gradeloom.sources.benchmarks import LAYOUTS

    layout = F.element_at(F.array(*map(F.lit, LAYOUTS)), (F.col("p_partkey") % 11 + 1).cast("int"))
    rows = (
        d.part.selectExpr("*", "concat('id', p_partkey) AS id", "cast(p_size AS string) AS size", "concat('f/', p_partkey) AS file")
        .select(layout.alias("layout"), F.lit("test").alias("split"), F.col("p_partkey").alias("row_idx"), F.expr(raw).alias("raw"))
    )
    out = standardize_benchmark(rows)
    meta = F.array_join(F.transform(F.sort_array(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    return out.select("task_id", "task_question", "ground_truth", F.coalesce("file_path", F.lit("-")).alias("file_path"), meta.alias("meta"))


@query("write_results", "v_attempt", """SELECT task_id, pass_at_k_success, attempt_id, retry_id, answer, status FROM v_attempt JOIN
(SELECT DISTINCT task_id, false AS pass_at_k_success FROM v_attempt) USING (task_id)""")
def _(d):
    tasks = d.v_attempt.select("task_id").distinct().withColumn("pass_at_k_success", F.lit(False))
    path = sinks.write_results(tasks, d.v_attempt, fresh_path(d.spark, "out"))
    back = d.spark.read.schema(
        "task_id bigint, pass_at_k_success boolean, attempts array<struct<attempt_id:int,retry_id:int,answer:string,status:string>>").json(path)
    return back.select("task_id", "pass_at_k_success", F.inline("attempts"))


@query("run_summary", "v_attempt", "SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM v_attempt")
def _(d):
    return sinks.run_summary(d.v_attempt)


@query("select_entries", "", """SELECT doc_id AS id, source AS model FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7""")
def _(d):
    rows = d.documents.selectExpr("doc_id AS id", "source AS model", "doc_id AS pos")
    return L.select_entries(rows, d.labels.select(F.col("doc_id").alias("id")), 7).select("id", "model")


@query("sample_queries", "", "SELECT doc_id AS id, lang FROM (SELECT * FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 60)")
def _(d):
    return L.sample_queries(d.documents.selectExpr("doc_id AS id", "lang"), 60)


@query("pending_tasks", "", "SELECT o_orderkey AS task_id, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0")
def _(d):
    tasks = d.orders.selectExpr("o_orderkey AS task_id", "o_totalprice")
    outputs = d.wide("orders").selectExpr("o_orderkey AS task_id", "CASE o_orderkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{]' WHEN 2 THEN '[1] x' END AS content")
    return L.pending_tasks(tasks, outputs)


@query("cache_reuse", "", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS value, o_orderkey % 3 = 0 AS cached,
o_orderkey % 3 = 0 OR o_custkey % 5 <> 0 AS ok FROM orders""")
def _(d):
    cache = d.orders.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS id", "'old' AS value")
    requests = d.orders.selectExpr("o_orderkey AS id", "o_custkey")
    got, _new = L.cache_reuse(requests, cache, lambda df: df.selectExpr("id", "o_custkey", "'new' AS value", "o_custkey % 5 <> 0 AS ok"), ["id"])
    return got.select("id", "value", "cached", "ok")

