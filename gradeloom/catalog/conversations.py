"""Queries over message histories and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query
from gradeloom.operators import conversations as C


@query("strip_think", "v_message", """SELECT conv_id, turn, CASE WHEN role = 'assistant'
THEN regexp_replace(text, '<think>.*?</think>\\s*', '', 'gs') ELSE text END AS text FROM v_message""")
def _(d):
    return d.v_message.select("conv_id", "turn", C.strip_think(F.col("role"), F.col("text")).alias("text"))


WS = "' ' || chr(9) || chr(10) || chr(13)"


@query("failure_summary", "v_message", f""", a AS (SELECT conv_id, turn, text,
 trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(text, '<think>.*?</think>', '', 'gs'), {WS}), '<use_mcp_tool>.*', '', 'gs'), {WS}),
   '\\\\boxed\\{{\\s*\\}}', '', 'g'), {WS}) AS body,
 coalesce(trim(regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1)[-1], {WS}), '') AS thought FROM v_message)
SELECT conv_id, turn, CASE WHEN body <> '' THEN body ELSE thought END AS summary FROM a""")
def _(d):
    short = d.v_message
    return short.select("conv_id", "turn", C.failure_summary(F.col("text")).alias("summary"))


BOX = "regexp_extract_all(text, '\\\\boxed\\{((?:[^{}]|\\{[^{}]*\\})*)\\}', 1)[-1]"


@query("boxed_answer", "v_message", f""", b AS (SELECT *, coalesce({BOX}, '') AS box, max(turn) OVER (PARTITION BY conv_id) AS mx FROM v_message),
f AS (SELECT conv_id, arg_max(box, turn) FILTER (role = 'assistant' AND box <> '') AS fallback FROM b GROUP BY conv_id)
SELECT conv_id, coalesce(nullif(box, ''), fallback, 'No \\boxed{{}} content found.') AS boxed_answer FROM b JOIN f USING (conv_id) WHERE turn = mx""")
def _(d):
    m = d.v_message
    summaries = m.groupBy("conv_id").agg(F.max_by("text", "turn").alias("summary"))
    return C.boxed_answer(summaries, m)


CALLS = """, t AS (SELECT conv_id, turn, 0 AS call_pos, CASE WHEN conv_id % 7 = 0 THEN 'agent-worker' ELSE 'tool-search' END AS server, 'find' AS tool,
 concat('{"q": "', turn % 2, '", "a": ', conv_id % 2, '}') AS arguments FROM conversations WHERE turn % 3 <> 2
 UNION ALL SELECT conv_id, turn, 1, 'tool-read', 'open', concat('{"u": ', turn, '}') FROM conversations WHERE turn % 3 <> 2)"""


@query("extract_tool_calls", "v_tool_text", CALLS + " SELECT * FROM t")
def _(d):
    return C.extract_tool_calls(d.v_tool_text, "conv_id", "turn")


@query("extract_tool_calls_quoted", "", """SELECT conv_id, turn, 0 AS call_pos, 'w' AS server, 'run' AS tool,
 concat('{"code": "see </arguments> and </use_mcp_tool> ', turn, '"}') AS arguments FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'x', 'y', '' FROM conversations WHERE turn % 2 = 0""")
def _(d):
    texts = d.conversations.selectExpr("conv_id", "turn", """concat(text, '<USE_MCP_TOOL id="1"><server_name>w</server_name> <tool_name>run</tool_name><arguments>{"code": "see </arguments> and </use_mcp_tool> ',
        turn, '"} </arguments>\n</use_mcp_tool> ', CASE WHEN turn % 2 = 0 THEN '<use_mcp_tool><server_name>x</server_name><tool_name> y</tool_name><arguments></arguments></use_mcp_tool>'
        ELSE '<use_mcp_tool><server_name>x</server_name></use_mcp_tool>' END) AS text""")
    return C.extract_tool_calls(texts, "conv_id", "turn")


@query("native_tool_calls", "", """SELECT conv_id, turn, 0 AS call_pos, 'web-tools' AS server, 'find' AS tool, concat('id', turn) AS call_id,
 CASE turn % 4 WHEN 3 THEN 'error=Failed to parse arguments;raw={broken' WHEN 2 THEN concat('flag=true;none=null;q=', role) ELSE concat('n=', turn, ';q=', role, ';sub={"a":[1,"x"]}') END AS arguments FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'read', 'open', 'second', 'u=1' FROM conversations WHERE turn % 4 IN (1, 3)""")
def _(d):
    arguments = F.expr("""CASE turn % 4 WHEN 3 THEN '{broken' WHEN 2 THEN concat("{'q': '", role, "', 'flag': True, 'none': None}")
        ELSE concat('{"q": "', role, '", "n": ', turn, ', "sub": {"a":[1,"x"]}}') END""")
    named = d.conversations.withColumn("a", arguments)
    flat = F.to_json(F.expr("""named_struct('output', array(
        named_struct('type', 'function_call', 'name', 'web-tools-find', 'arguments', a, 'call_id', concat('id', turn)),
        named_struct('type', 'message', 'name', 'no-call', 'arguments', '{}', 'call_id', 'm')))"""))
    nested = F.to_json(F.expr("""array(
        named_struct('id', concat('id', turn), 'function', named_struct('name', 'web-tools-find', 'arguments', a)),
        named_struct('id', 'second', 'function', named_struct('name', 'read-open', 'arguments', '{"u": 1}')))"""))
    replies = named.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, flat).otherwise(nested).alias("reply"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("arguments")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")
    return C.native_tool_calls(replies, "reply", "conv_id", "turn").withColumn("arguments", told)


@query("broken_tool_calls", "v_tool_text", """SELECT conv_id, turn, 'Unclosed use_mcp_tool tag' AS error,
regexp_extract(text, '(?s)<use_mcp_tool>.*$') AS content FROM v_tool_text WHERE turn % 3 = 2""")
def _(d):
    return C.broken_tool_calls(d.v_tool_text, "conv_id", "turn")


@query("duplicate_tool_calls", "v_tool_text", CALLS + """, k AS (SELECT *, concat(server, ':', tool, ':', CASE WHEN tool = 'find' THEN
 concat('{"a":', conv_id % 2, ',"q":"', turn % 2, '"}') ELSE concat('{"u":', turn, '}') END) AS call_key FROM t WHERE server <> 'agent-worker')
SELECT *, min(turn) OVER (PARTITION BY conv_id, call_key) AS first_turn, min(turn) OVER (PARTITION BY conv_id, call_key) < turn AS is_duplicate FROM k""")
def _(d):
    return C.duplicate_tool_calls(C.extract_tool_calls(d.v_tool_text, "conv_id", "turn"))


@query("cap_calls", "", """SELECT doc_id AS turn_id, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS calls,
len(string_split(text, chr(10))) > 10 AS exceeded FROM documents""")
def _(d):
    turns = d.documents.select(F.col("doc_id").alias("turn_id"), F.split("text", "\n").alias("calls"))
    return C.cap_calls(turns, "calls", 10).withColumn("calls", F.array_join("calls", "\n"))


def _keep(k, extra=""):
    return f""", r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM v_message WHERE role IN ('user', 'tool'))
SELECT conv_id, turn, role, CASE WHEN a > 1 AND z > {k} THEN 'Tool result is omitted to save tokens.' ELSE text END AS text
FROM v_message LEFT JOIN r USING (conv_id, turn)"""


@query("keep_recent_results", "v_message", _keep(1))
def _(d):
    return C.keep_recent_results(d.v_message, 1)


@query("keep_recent_results_first_only", "v_message", _keep(0))
def _(d):
    return C.keep_recent_results(d.v_message, 0)


OUT = """, o AS (SELECT conv_id, turn, CASE WHEN n_calls > 0 THEN 'has_tool_calls' WHEN finish_reason = 'length' THEN 'finish_reason_length'
 WHEN contains(text, '<server_name>') THEN 'mcp_tag_without_tool_calls' WHEN contains(text, 'I cannot continue') THEN 'refusal_detected'
 ELSE 'normal_completion' END AS outcome FROM v_turn)"""


def _outcomes(d):
    return d.v_turn.select("conv_id", "turn", C.turn_outcome(F.col("n_calls"), F.col("finish_reason"), F.col("text")).alias("outcome"))


@query("turn_outcome", "v_turn", OUT + " SELECT * FROM o")
def _(d):
    return _outcomes(d)


@query("rollback_runs", "v_turn", OUT + """, f AS (SELECT *, outcome NOT IN ('has_tool_calls', 'normal_completion') AS rb FROM o),
g AS (SELECT *, sum(CASE WHEN rb THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f)
SELECT conv_id, min(turn) AS run_start, count(*) AS run_length, count(*) > 5 AS over_limit FROM g WHERE rb GROUP BY conv_id, island""")
def _(d):
    turns = _outcomes(d).withColumn("rolled_back", C.is_rollback(F.col("outcome")))
    return C.rollback_runs(turns, 5)


@query("context_budget", "", """SELECT c.conv_id, c.turn, c.prompt_tokens, c.completion_tokens,
 prompt_tokens + completion_tokens + cast(floor((coalesce(length(n.text), 0) // 4) * 1.5) AS bigint) + 13 + 512 + 1000 AS estimated_total,
 prompt_tokens > 0 AND prompt_tokens + completion_tokens + cast(floor((coalesce(length(n.text), 0) // 4) * 1.5) AS bigint) + 13 + 512 + 1000 >= 4000 AS over_limit
FROM (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN 0 ELSE length(text) * (turn + 1) END AS prompt_tokens, length(text) % 50 AS completion_tokens
  FROM conversations WHERE role = 'assistant') c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 AND n.role = 'user'""")
def _(d):
    m = d.conversations
    calls = m.where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "CASE WHEN conv_id % 9 = 0 THEN 0 ELSE length(text) * (turn + 1) END AS prompt_tokens",
        "cast(length(text) % 50 AS bigint) AS completion_tokens")
    return C.context_budget(calls, m, "Summarise what was found so far for me.", 512, 4000)
