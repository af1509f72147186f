"""Chains of many steps as queries: compression by a scorer, the process graph, stored results. Scorers are fixed
rules that the checks can follow."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, rounded
from gradeloom.catalog.traces import pack_sql
from gradeloom.operators.scores import ALIGNMENT_DIMENSIONS, INTRINSIC_DIMENSIONS
from gradeloom.plans import compress, process
from gradeloom.session import fresh_path
from gradeloom.sources import sinks
from gradeloom.sources.results import ResultStore, with_store


def end_of_prompt(prompt: str) -> str:
    if len(prompt) % 7 == 0:
        raise RuntimeError("no reply")
    return prompt[-150:]


FRAME = len(re.sub(r"\{\w+\}", "", compress.PROMPT))
BEFORE = compress.PROMPT.split("{parts}")[1].split("{query}")[0].replace("\n", "' || chr(10) || '")


@query("compress_with_scorer", "v_trace", pack_sql(700) + f""", c AS (SELECT doc_id, chunk_no, chunk FROM pk WHERE doc_id IN (SELECT doc_id FROM v_trace WHERE length(process) > 700)
  UNION ALL SELECT doc_id, 0, process FROM v_trace WHERE length(process) <= 700),
p AS (SELECT *, {FRAME} + length((chunk_no + 1)::text) + length((count(*) OVER (PARTITION BY doc_id))::text) + length(concat('q', doc_id)) + length(chunk) AS n FROM c),
r AS (SELECT doc_id, string_agg(CASE WHEN n % 7 = 0 THEN substr(chunk, 1, 140) ELSE right(concat('{BEFORE}', 'q', doc_id, chr(10), chr(10), chunk), 150) END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_no) AS t FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(t) > 600 THEN concat(substr(t, 1, 600), chr(10), chr(10), '[... truncated ...]') ELSE t END AS compressed, 1 AS rounds FROM r""")
def _(d):
    traces = d.wide("v_trace").selectExpr("doc_id", "concat('q', doc_id) AS query", "process")
    return compress.compress_with(traces, ["doc_id"], end_of_prompt, max_chars=600, chunk_chars=700, tries=1)


def asked_for(prompt: str) -> int:
    return int(re.search(r"Question: q(\d+)", prompt)[1])


def structurer(prompt: str) -> str:
    n = asked_for(prompt)
    if n % 9 == 4:
        raise RuntimeError("no reply")
    return '{"steps": []}' if n % 9 == 5 else '{"steps": [], "global_findings": []}'


def judge(prompt: str) -> str:
    n = asked_for(prompt)
    own = prompt.startswith(process.INTRINSIC[:20])
    names, least = (INTRINSIC_DIMENSIONS, 5) if own else (ALIGNMENT_DIMENSIONS, 6)
    return json.dumps({d: {"score": 1 + (n * (1 if own else 3) + k) % 7} for k, d in enumerate(names) if k or n % least})


def entries_of(d):
    return d.documents.selectExpr(
        "source AS model", "doc_id AS entry_id", "concat('q', doc_id) AS query", "CASE WHEN doc_id % 10 = 7 THEN ' \\n' ELSE text END AS process", "'the report' AS response")


def _names(dimensions, factor, least):
    rows = ", ".join(f"('{name}', {k})" for k, name in enumerate(dimensions))
    return f"""SELECT source AS model, dimension, avg(1 + (doc_id * {factor} + k) % 7) AS a FROM e CROSS JOIN (VALUES {rows}) AS names(dimension, k)
 WHERE doc_id % {least} <> 0 GROUP BY ALL"""


@query("process_graph", "", f"""WITH e AS (SELECT * FROM documents WHERE doc_id % 10 <> 7 AND doc_id % 9 NOT IN (4, 5)),
i AS (SELECT model, avg(a) AS a FROM ({_names(INTRINSIC_DIMENSIONS, 1, 5)}) GROUP BY model), al AS (SELECT model, avg(a) AS a FROM ({_names(ALIGNMENT_DIMENSIONS, 3, 6)}) GROUP BY model)
SELECT model, round(i.a, 9) AS intrinsic_avg, round(al.a, 9) AS alignment_avg, round(coalesce((i.a + al.a) / 2, i.a, al.a), 9) AS overall_avg,
 row_number() OVER (ORDER BY coalesce((i.a + al.a) / 2, i.a, al.a) DESC, model) AS rank FROM i FULL JOIN al USING (model)""")
def _(d):
    done = process.process_graph(d.spark, entries_of(d), fresh_path(d.spark, "graph"), structurer, judge, tries=1)
    return rounded(done["board"], "intrinsic_avg", "alignment_avg", "overall_avg")


@query("result_store", "", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 <> 0 OR o_orderkey % 2 = 0 AND o_custkey % 5 <> 0 THEN o_custkey * 2 END AS value,
 o_orderkey % 2 = 0 AND o_custkey % 5 <> 0 AS cached FROM orders""")
def _(d):
    store = ResultStore(d.spark, fresh_path(d.spark, "results"), "id bigint, value bigint", ["id"])
    requests = d.orders.selectExpr("o_orderkey AS id", "o_custkey")
    compute = lambda rows: rows.selectExpr("id", "o_custkey * 2 AS value", "o_custkey % 5 <> 0 AS ok")
    # a first run asks for every other id, a second one for all
    with_store(requests.where("id % 2 = 0"), store, compute, rounds=2)
    return with_store(requests, store, compute, rounds=3).select("id", "value", "cached")


@query("write_items", "", "SELECT source AS item, doc_id, text FROM documents")
def _(d):
    path = sinks.write_items(d.documents.selectExpr("source AS item", "doc_id", "text"), fresh_path(d.spark, "items"), "item")
    return d.spark.read.schema("doc_id bigint, text string, item string").json(path).select("item", "doc_id", "text")
