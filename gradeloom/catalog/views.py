"""Views that give the parquet tables the shapes the operators work on.

Each view is one SQL text that Spark and DuckDB both read, so a query and its check see the same
rows. Views are row-wise (no window, no sort), so they cost one scan at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, tuple[list[str], str]] = {
    # one row per checked statement
    "v_verdict": (["lineitem"], """
        SELECT concat('m', cast(l_suppkey % 10 AS string)) AS model, l_partkey % 100 AS task_id,
               l_orderkey AS chunk_idx, l_linenumber AS pos,
               CASE WHEN l_returnflag = 'R' THEN 'Right'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN ' Wrong '
                    WHEN l_returnflag = 'A' THEN 'Conflict'
                    WHEN l_linestatus = 'O' THEN 'Unknown' ELSE 'right' END AS verification
        FROM lineitem"""),
    # one checked chunk of a report with the checker's reply
    "v_chunk": (["lineitem"], """
        SELECT concat('m', cast(l_suppkey % 10 AS string), '/', cast(l_partkey % 100 AS string)) AS task_id,
               l_orderkey * 10 + l_linenumber AS chunk_idx, l_suppkey AS seed,
               l_linenumber <> 7 AS ok,
               CASE WHEN l_linenumber = 6 THEN 'no object here'
                    WHEN l_linenumber = 5 THEN concat('```json', chr(10), '{"statement": "s', cast(l_partkey AS string),
                         '", "verification": "Right"}', chr(10), '```')
                    ELSE concat('Result: {"core_state": [{"statement": "a', cast(l_partkey AS string),
                         '", "verification": "Right", "evidence": [{"source": "u", "excerpt": "e"}]}, {"statement": "b',
                         cast(l_suppkey AS string), '", "verification": " Wrong "}]} done') END AS summary
        FROM lineitem"""),
    # criterion scores; a null score is a failed criterion
    "v_criterion": (["lineitem"], """
        SELECT l_orderkey % 500 AS query_id, concat('m', cast(l_suppkey % 10 AS string)) AS model,
               CASE l_linenumber WHEN 1 THEN 'coverage' WHEN 2 THEN 'insight' WHEN 3 THEN 'instruction_following'
                    WHEN 4 THEN 'clarity' ELSE concat('extra_', cast(l_linenumber AS string)) END AS dimension,
               concat('c', cast(l_partkey AS string)) AS criterion, l_quantity AS weight,
               CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN NULL ELSE l_discount * 100 END AS score,
               l_orderkey * 1000 + l_suppkey AS pos
        FROM lineitem"""),
    # raw weights, not normalised; extra_6 deliberately has none
    "v_dim_weight": (["v_criterion"], """
        SELECT query_id, dimension, sum(weight) AS raw_weight FROM v_criterion
        WHERE dimension <> 'extra_6' GROUP BY query_id, dimension"""),
    # criteria of a query and dimension, unique by text
    "v_criteria": (["lineitem"], """
        SELECT l_orderkey % 500 AS query_id,
               CASE l_linenumber WHEN 1 THEN 'coverage' WHEN 2 THEN 'insight' WHEN 3 THEN 'instruction_following'
                    WHEN 4 THEN 'clarity' ELSE concat('extra_', cast(l_linenumber AS string)) END AS dimension,
               concat('c', cast(l_partkey % 3 AS string)) AS criterion, max(l_quantity) AS weight
        FROM lineitem GROUP BY 1, 2, 3"""),
    # judge replies per criterion, with repeats
    "v_reply_score": (["lineitem"], """
        SELECT l_orderkey % 500 AS query_id, concat('m', cast(l_suppkey % 3 AS string)) AS model,
               CASE l_linenumber WHEN 1 THEN 'coverage' WHEN 2 THEN 'insight' WHEN 3 THEN 'instruction_following'
                    WHEN 4 THEN 'clarity' ELSE concat('extra_', cast(l_linenumber AS string)) END AS dimension,
               concat('c', cast(l_partkey % 3 AS string)) AS criterion, l_discount * 100 AS score,
               cast(round(l_extendedprice * 100) AS bigint) * 100 + cast(round(l_discount * 100) AS bigint) AS pos
        FROM lineitem"""),
    # 5 intrinsic dimensions from the priority, 3 alignment dimensions from the status
    "v_process": (["orders"], """
        SELECT concat('m', cast(o_custkey % 10 AS string)) AS model, o_orderkey AS entry_id, 'intrinsic' AS family,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'search_breadth' WHEN '2' THEN 'analytical_depth'
                    WHEN '3' THEN 'progressive_refinement' WHEN '4' THEN 'critical_thinking' ELSE 'efficiency' END AS dimension,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1 + o_custkey % 7 END AS score FROM orders
        UNION ALL
        SELECT concat('m', cast(o_custkey % 10 AS string)), o_orderkey, 'alignment',
               CASE o_orderstatus WHEN 'F' THEN 'findings_to_report' WHEN 'O' THEN 'report_to_process' ELSE 'contradiction' END,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1 + o_orderkey % 10 END FROM orders"""),
    # judge reply of one entry: eight scores in one JSON text, some incomplete
    "v_process_reply": (["orders"], """
        SELECT concat('m', cast(o_custkey % 10 AS string)) AS model, o_orderkey AS entry_id,
               concat('{"search_breadth": {"score": ', cast(1 + o_custkey % 7 AS string),
                 '}, "analytical_depth": {"score": 5}, "progressive_refinement": {"score": 6}, ',
                 CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN '"critical_thinking": {"note": "x"}, '
                      WHEN o_orderkey % 5 = 2 THEN '"critical_thinking": 4, '
                      ELSE '"critical_thinking": {"score": 4}, ' END,
                 '"efficiency": {"score": ', CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '3' END, '}}') AS reply
        FROM orders"""),
    # the same for how a report fits its trace: three scores, some replies cut off or without one of them
    "v_alignment_reply": (["orders"], """
        SELECT concat('m', cast(o_custkey % 10 AS string)) AS model, o_orderkey AS entry_id,
               concat('{"findings_to_report": {"score": ', cast(1 + o_custkey % 9 AS string), '}, ',
                 CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '"report_to_process": {"score": 6}, ' END,
                 '"contradiction": {"score": ', CASE WHEN o_orderkey % 8 = 0 THEN 'null' ELSE '9' END,
                 CASE WHEN o_orderkey % 7 = 3 THEN '' ELSE '}}' END) AS reply
        FROM orders"""),
    # score by entry, dimension and strategy
    "v_strategy": (["lineitem"], """
        SELECT concat('m', cast(l_orderkey % 10 AS string)) AS model, l_orderkey AS entry_id,
               CASE l_linenumber % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'small' ELSE 'large' END AS strategy,
               CASE WHEN l_partkey % 8 < 5 THEN 'intrinsic' ELSE 'alignment' END AS family,
               concat('d', cast(l_partkey % 8 AS string)) AS dimension, max(1 + l_suppkey % 10) AS score,
               max(1000 + l_orderkey % 977) AS raw_len, max(100 + l_suppkey) AS kept_len
        FROM lineitem GROUP BY 1, 2, 3, 4, 5"""),
    # three attempts of five retries per task
    "v_attempt": (["events"], """
        SELECT cast((event_id - event_id % 15) / 15 AS bigint) AS task_id,
               cast((event_id % 15 - event_id % 5) / 5 + 1 AS int) AS attempt_id, cast(event_id % 5 AS int) AS retry_id,
               event_type <> 'error' AND event_type <> 'view' AS is_valid_box, event_type = 'purchase' AS is_correct,
               CASE WHEN event_type = 'click' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN event_type IN ('error', 'view') THEN '' ELSE cast(event_id AS string) END AS answer,
               CASE WHEN event_type = 'error' THEN concat('tried ', cast(event_id AS string)) END AS failure
        FROM events"""),
    # answers with and without the markers that make them invalid
    "v_answer": (["part"], """
        SELECT p_partkey AS task_id,
               CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN concat('Nonetheless ', p_name)
                    WHEN 3 THEN concat('none of ', p_name) WHEN 4 THEN concat(p_name, ' N/A')
                    WHEN 5 THEN concat('No ', chr(92), 'boxed{} content found.') ELSE p_name END AS answer
        FROM part"""),
    # two engines, ten ranks each per query
    "v_search": (["pages"], """
        SELECT cast((page_id - page_id % 20) / 20 AS bigint) AS query_id, cast(page_id % 2 AS int) AS engine,
               cast((page_id % 20 - page_id % 2) / 2 + 1 AS int) AS rnk, page_id,
               CASE WHEN page_id % 11 = 10 THEN NULL WHEN page_id % 13 = 12 THEN ''
                    WHEN page_id % 17 = 3 THEN concat('https://huggingface.co/datasets/d', cast(page_id AS string))
                    WHEN page_id % 17 = 5 THEN concat('https://huggingface.co/spaces/d', cast(page_id AS string))
                    WHEN page_id % 3 < 2 THEN concat('https://Site', cast(page_id % 4 AS string), '.Example.org/a/',
                         cast(page_id % 2 AS string), CASE page_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '#part' WHEN 2 THEN '//#x'
                         WHEN 3 THEN ';v=1?q=A' ELSE '' END)
                    ELSE url END AS link,
               CASE WHEN page_id % 9 = 0 THEN 'Jan 2026' WHEN page_id % 9 = 1 THEN NULL ELSE '2025-03-01' END AS date,
               CASE WHEN page_id % 7 = 0 THEN 'outlook 2026' ELSE 'plain snippet' END AS snippet
        FROM pages"""),
    "v_span": (["events"], """
        SELECT event_id - event_id % 2 AS span_id,
               CASE WHEN event_id % 2 = 0 THEN 'span_start' ELSE 'span_end' END AS type,
               event_type AS path, ts, user_id AS task_id FROM events"""),
    # traces in the four layouts; quotes and backslashes are taken out so that the JSON layout stays valid
    "v_trace": (["documents"], """
        SELECT doc_id, source AS model,
               CASE doc_id % 5
                 WHEN 0 THEN concat('[{"step": 1, "type": "think", "content": "', replace(replace(replace(text, chr(92), ''), '"', ''''), chr(10),
                      '"}, {"step": 2, "type": "search", "keywords": ["a", "b"], "output": "'), '"}]')
                 WHEN 1 THEN concat('lead in ', '[reasoning] <think>', replace(replace(text, '. ', concat('</think> [web_search] ')), chr(10),
                      concat(chr(10), ' [scrape] http://x.org/', chr(10))), ' [run_python_code] print(1)')
                 WHEN 2 THEN concat('preamble [Step 1] ', replace(text, chr(10), concat(chr(10), ' [Step 2] [Search] ')))
                 WHEN 3 THEN concat('<think>', replace(text, chr(10), '</think> rest <think>'), '</think>')
                 ELSE replace(replace(text, '. ', concat('.  ', chr(10), chr(10), chr(10), chr(10))), chr(10), concat(' ', chr(10))) END AS process
        FROM documents"""),
    # reports with headings and blank lines between paragraphs
    "v_report": (["documents"], """
        SELECT doc_id, source AS model,
               concat('# Report ', cast(doc_id AS string), chr(10), chr(10),
                      replace(replace(text, chr(10), concat(chr(10), chr(10))), '? ', concat('?', chr(10), chr(10), '## Part', chr(10), chr(10)))) AS report
        FROM documents"""),
    # assistant turns with think blocks, tool calls and boxed answers
    "v_message": (["conversations"], """
        SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'tool' ELSE role END AS role,
               CASE WHEN role <> 'assistant' THEN text
                    WHEN (conv_id + turn) % 6 = 0 THEN concat('<think>plan ', cast(turn AS string), '</think>  ', text)
                    WHEN (conv_id + turn) % 6 = 1 THEN concat('<think>a</think><think> last ', cast(conv_id AS string), ' </think> ', '<use_mcp_tool>', text)
                    WHEN (conv_id + turn) % 6 = 2 THEN concat(text, ' so ', chr(92), 'boxed{', cast(conv_id AS string), '} or ', chr(92), 'boxed{', cast(turn AS string), '}')
                    WHEN (conv_id + turn) % 6 = 3 THEN concat(text, ' ', chr(92), 'boxed{ } ', chr(92), 'boxed{open')
                    WHEN (conv_id + turn) % 6 = 4 THEN concat('I''m unable to go on. ', text)
                    ELSE concat(text, ' ', chr(92), 'boxed{f{', cast(turn AS string), '}}') END AS text
        FROM conversations"""),
    # assistant turns that call tools
    "v_tool_text": (["conversations"], """
        SELECT conv_id, turn,
               CASE WHEN turn % 3 = 2 THEN concat(text, ' <use_mcp_tool> <server_name>s', cast(conv_id % 3 AS string), '</server_name>')
                    ELSE concat(text, ' <use_mcp_tool>', chr(10), '<server_name> ', CASE WHEN conv_id % 7 = 0 THEN 'agent-worker' ELSE 'tool-search' END,
                      ' </server_name>', chr(10), '<tool_name>find</tool_name>', chr(10), '<arguments>', chr(10), '{"q": "', cast(turn % 2 AS string),
                      '", "a": ', cast(conv_id % 2 AS string), '}', chr(10), '</arguments>', chr(10), '</use_mcp_tool> then <use_mcp_tool><server_name>tool-read</server_name><tool_name>open</tool_name><arguments>{"u": ',
                      cast(turn AS string), '}</arguments></use_mcp_tool>') END AS text
        FROM conversations"""),
    # one row per assistant turn: what the client reported
    "v_turn": (["events"], """
        SELECT cast((event_id - event_id % 40) / 40 AS bigint) AS conv_id, event_id % 40 AS turn,
               CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS n_calls,
               CASE WHEN event_type = 'error' THEN 'length' ELSE 'stop' END AS finish_reason,
               CASE event_type WHEN 'view' THEN 'see <server_name> cut' WHEN 'signup' THEN 'I cannot continue' ELSE 'done' END AS text
        FROM events"""),
    # judge replies by verifier
    "v_judge_reply": (["events"], """
        SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'equivalence' WHEN 1 THEN 'choice_ab' WHEN 2 THEN 'choice_abc'
                              WHEN 3 THEN 'yes_no' WHEN 4 THEN 'conclusion_zh' ELSE 'score_json' END AS verifier,
               CASE event_id % 6
                 WHEN 0 THEN CASE event_type WHEN 'click' THEN ' Correct. ' WHEN 'view' THEN 'incorrect' WHEN 'error' THEN 'CORRECT' ELSE 'maybe' END
                 WHEN 1 THEN CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'xB A' WHEN 'error' THEN 'C' ELSE '' END
                 WHEN 2 THEN CASE event_type WHEN 'click' THEN 'it is C' WHEN 'view' THEN 'B' WHEN 'error' THEN 'AB' ELSE 'none' END
                 WHEN 3 THEN CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'no' ELSE 'Yes' END
                 WHEN 4 THEN CASE event_type WHEN 'click' THEN '结论:: 正确' WHEN 'view' THEN '结论:错误' ELSE '正确' END
                 ELSE CASE event_type WHEN 'click' THEN '{"score": 0, "answer_score":  1}' WHEN 'view' THEN '{"answer_score": 0, "score": 1}'
                      WHEN 'error' THEN '{"score": 1}' ELSE '{"score": 2}' END END AS reply
        FROM events"""),
    # benchmark of each task
    "v_benchmark_name": (["part"], """
        SELECT p_partkey AS task_id,
               concat(CASE p_partkey % 10 WHEN 0 THEN 'gaia-validation' WHEN 1 THEN 'finsearchcomp' WHEN 2 THEN 'simpleqa' WHEN 3 THEN 'xbench-ds'
                      WHEN 4 THEN 'browsecomp-zh' WHEN 5 THEN 'browsecomp' WHEN 6 THEN 'hle-text' WHEN 7 THEN 'webwalkerqa'
                      WHEN 8 THEN 'gaia-hle' ELSE p_type END, '') AS benchmark FROM part"""),
    # truth and answer pairs for matching
    "v_pair": (["part"], """
        SELECT p_partkey AS task_id,
               CASE p_partkey % 6 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN concat(p_name, ', ', p_type) WHEN 2 THEN concat(cast(p_size AS string), ';', p_name)
                    WHEN 3 THEN p_name WHEN 4 THEN concat(' ', cast(p_size AS string), '.0 ') ELSE p_brand END AS truth,
               CASE p_partkey % 12 WHEN 0 THEN concat('$', cast(p_size AS string), '.00') WHEN 6 THEN concat(cast(p_size AS string), ' units')
                    WHEN 1 THEN concat(upper(p_name), ',', p_type) WHEN 7 THEN p_name
                    WHEN 2 THEN concat(cast(p_size AS string), '%,', upper(p_name)) WHEN 8 THEN concat('x;', p_name)
                    WHEN 3 THEN concat(upper(p_name), '!') WHEN 9 THEN concat('the ', p_name)
                    WHEN 4 THEN cast(p_size AS string) WHEN 10 THEN cast(p_size + 1 AS string)
                    WHEN 5 THEN replace(p_brand, '#', ' ') ELSE NULL END AS answer
        FROM part"""),
    # generated task queries with the replies of the three stages
    "v_generated": (["documents"], """
        SELECT doc_id AS qid, text AS query, lang AS topic, source AS persona,
               CASE doc_id % 14 WHEN 0 THEN 'FinTech' WHEN 1 THEN ' Crypto policy' WHEN 2 THEN 'banking' WHEN 3 THEN 'data governance' WHEN 4 THEN 'LLM systems'
                    WHEN 5 THEN 'clinical trials' WHEN 6 THEN 'Supply Chain' WHEN 7 THEN 'hiring' WHEN 8 THEN 'carbon markets' WHEN 9 THEN 'quantum'
                    WHEN 10 THEN 'geopolitics' WHEN 11 THEN 'sports' WHEN 12 THEN 'Health finance' ELSE 'economics of energy' END AS domain,
               doc_id % 4 <> 0 AS searchable,
               CASE WHEN doc_id % 9 = 0 THEN '{"needs_deep_research": true}' WHEN doc_id % 9 = 1 THEN 'not json'
                    ELSE concat('{"needs_deep_research": ', CASE WHEN doc_id % 8 = 0 THEN 'false' ELSE 'true' END, ', "confidence_score": ', cast(cast(doc_id % 10 AS double) / 10 AS string),
                         ', "search_complexity": "High"}') END AS dr_reply,
               CASE WHEN doc_id % 10 = 0 THEN '{}' ELSE concat('{"overall_quality": "', CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END,
                    '", "requires_search": ', CASE WHEN doc_id % 7 = 0 THEN 'false' ELSE 'true' END,
                    CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat(', "quality_score": ', cast(cast(doc_id % 20 AS double) / 20 AS string)) END, '}') END AS quality_reply
        FROM documents"""),
    # seed questions by topic
    "v_seed": (["part"], """
        SELECT p_partkey AS pos, concat(p_type, CASE WHEN p_partkey % 3 = 0 THEN ' goods ' ELSE ' market ' END, p_brand) AS topic,
               CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE concat('How will ', p_name, ' change over ', cast(p_size AS string), ' years') END AS query FROM part"""),
    "v_topic": (["supplier"], """
        SELECT s_suppkey AS topic_id, CASE s_suppkey % 4 WHEN 0 THEN concat('SMALL market Brand#', cast(s_suppkey % 25 AS string))
                    WHEN 1 THEN concat('large MARKET of ', s_name) WHEN 2 THEN 'no seed' ELSE concat('Economy goods Brand#', cast(s_suppkey % 25 AS string)) END AS topic FROM supplier"""),
    # log of one chunk
    "v_chunk_log": (["events"], """
        SELECT cast((event_id - event_id % 8) / 8 AS bigint) AS task_id, event_id % 4 AS chunk, event_id AS seq,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'Running' ELSE 'completed' END AS status, ts
        FROM events"""),
    "v_result_log": (["events"], """
        SELECT DISTINCT cast((event_id - event_id % 24) / 8 AS bigint) AS task_id FROM events"""),
}


def register(spark: SparkSession, sf_dir: str, name: str) -> None:
    if name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return
    deps, sql = VIEWS[name]
    for dep in deps:
        register(spark, sf_dir, dep)
    spark.sql(sql).createOrReplaceTempView(name)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    register(spark, sf_dir, name)
    return spark.table(name)


def with_views(*names: str) -> str:
    """The WITH head that gives DuckDB the same views."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
