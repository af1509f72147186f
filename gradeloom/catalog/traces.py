"""Queries over traces, reports and judge replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query
from gradeloom.operators import reports as R, traces as T

M = "chr(57344)"


@query("detect_trace_format", "v_trace", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'json_array'
WHEN len(regexp_extract_all(process, '\\[(?:reasoning|web_search|scrape|run_python_code)\\]')) >= 2 THEN 'block_text'
WHEN len(regexp_extract_all(process, '\\[Step [0-9]+\\]')) >= 2 THEN 'step_text' ELSE 'plain_text' END AS trace_format FROM v_trace""")
def _(d):
    return d.wide("v_trace").select("doc_id", T.detect_trace_format(F.col("process")).alias("trace_format"))


STEPS = """, jl AS (SELECT doc_id, string_split(replace(replace(text, chr(92), ''), '"', ''''), chr(10)) AS l FROM documents WHERE doc_id % 5 = 0),
js AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS x FROM jl),
jline AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN concat('[Step 1] [think]', CASE WHEN x = '' THEN '' ELSE chr(10) || x END)
 ELSE concat('[Step 2] [search]', chr(10), 'Queries: a, b', CASE WHEN x = '' THEN '' ELSE concat(chr(10), 'Output: ', substr(x, 1, 300)) END) END AS line FROM js)"""


@query("trace_steps_json", "v_trace", STEPS + " SELECT doc_id, cast(pos AS int) AS pos, line FROM jline")
def _(d):
    return T.trace_steps_json(d.wide("v_trace"), "doc_id")


@query("unreadable_traces", "v_trace", "SELECT doc_id, length(process) + 1 AS n_chars FROM v_trace WHERE doc_id % 5 = 0")
def _(d):
    broken = d.wide("v_trace").withColumn("process", F.when(F.col("doc_id") % 5 == 0, F.concat("process", F.lit("]"))).otherwise(F.lit("plain")))
    return T.unreadable_traces(broken, "doc_id").withColumn("n_chars", F.col("n_chars").cast("bigint"))


WS = "' ' || chr(9) || chr(10) || chr(13)"
BLOCKS = f""", bp AS (SELECT doc_id, string_split(regexp_replace(process, '\\[(reasoning|web_search|scrape|run_python_code)\\]|<think>(.*?)</think>',
   {M} || '\\1' || chr(57345) || '\\2' || chr(57346), 'gs'), {M})[2:] AS l FROM v_trace),
bu AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS p FROM bp),
bb AS (SELECT doc_id, n, coalesce(nullif(split_part(p, chr(57345), 1), ''), 'reasoning') AS type,
  trim(CASE WHEN starts_with(p, chr(57345)) THEN split_part(split_part(p, chr(57345), 2), chr(57346), 1) ELSE split_part(p, chr(57346), 2) END, {WS}) AS content FROM bu),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, type, content FROM bb WHERE content <> ''),
bl AS (SELECT doc_id, pos, CASE type WHEN 'reasoning' THEN concat('[Reasoning]', chr(10), nullif(trim(regexp_replace(content, '</?think>', '', 'g'), {WS}), ''))
  WHEN 'web_search' THEN concat('[Search] ', trim(split_part(content, chr(10), 1), {WS}))
  WHEN 'scrape' THEN concat('[Scrape] ', trim(split_part(content, chr(10), 1), {WS}), chr(10), CASE WHEN contains(content, chr(10)) THEN substr(content, instr(content, chr(10)) + 1, 500) ELSE '' END)
  ELSE concat('[Code Execution]', chr(10), substr(content, 1, 500)) END AS line FROM b),
bn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, line FROM bl WHERE line <> concat('[Reasoning]', chr(10)))"""


@query("trace_blocks", "v_trace", BLOCKS + " SELECT doc_id, cast(pos AS int) AS pos, type, content FROM b")
def _(d):
    return T.trace_blocks(d.wide("v_trace"), "doc_id")


@query("format_blocks", "v_trace", BLOCKS + " SELECT doc_id, cast(pos AS int) AS pos, line FROM bn")
def _(d):
    return T.format_blocks(d.wide("v_trace"), "doc_id")


# text cut at `n` characters, back to the last blank line beyond 0.7 * n
def cut(c, n):
    head = f"substr({c}, 1, {n})"
    last = f"({n} - instr(reverse({head}), chr(10) || chr(10)) - 1)"
    return (f"CASE WHEN length({c}) <= {n} THEN {c} ELSE concat(CASE WHEN contains({head}, chr(10) || chr(10)) AND {last} > 0.7 * {n} "
            f"THEN substr({head}, 1, {last}) ELSE {head} END, chr(10), chr(10), '[... truncated ...]') END")


STEPTEXT = f""", sp AS (SELECT doc_id, string_split(regexp_replace(process, '(\\[Step [0-9]+\\])', {M} || '\\1' || chr(57345), 'g'), {M}) AS l FROM v_trace),
su AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS p FROM sp),
st AS (SELECT doc_id, n, CASE WHEN contains(p, chr(57345)) THEN concat(split_part(p, chr(57345), 1), ' ', trim(split_part(p, chr(57345), 2), {WS}))
  ELSE trim(p, {WS}) END AS x FROM su),
sj AS (SELECT doc_id, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY n) FILTER (x <> ''), '') AS t FROM st GROUP BY doc_id)"""


@query("trace_steps_text", "v_trace", STEPTEXT + f" SELECT doc_id, {cut('t', 900)} AS text FROM sj")
def _(d):
    return d.wide("v_trace").select("doc_id", T.trace_steps_text(F.col("process"), 900).alias("text"))


PLAIN = """, pl AS (SELECT doc_id, regexp_replace(regexp_replace(process, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\r]+(\\n|$)', '\\1', 'g') AS t FROM v_trace)"""


@query("truncate_paragraph", "v_trace", PLAIN + f" SELECT doc_id, {cut('t', 400)} AS text FROM pl")
def _(d):
    return d.wide("v_trace").select("doc_id", T.plain_trace(F.col("process"), 400).alias("text"))


def squeeze(src, n, head, floor):
    body = "CASE WHEN contains(line, chr(10)) THEN substr(line, instr(line, chr(10)) + 1) ELSE '' END"
    return f"""(SELECT doc_id, CASE WHEN length(string_agg(line, chr(10) || chr(10) ORDER BY pos)) <= {n} OR any_value(ratio) >= 1
   THEN string_agg(line, chr(10) || chr(10) ORDER BY pos)
   ELSE string_agg(CASE WHEN body = '' THEN split_part(line, chr(10), 1) ELSE concat(split_part(line, chr(10), 1), chr(10),
     CASE WHEN length(body) > greatest(cast(floor(length(body) * ratio) AS int), {floor}) THEN substr(body, 1, greatest(cast(floor(length(body) * ratio) AS int), {floor})) || '...' ELSE body END) END,
     chr(10) || chr(10) ORDER BY pos) END AS text
  FROM (SELECT *, {body} AS body, greatest({n} - count(*) OVER (PARTITION BY doc_id) * {head}, {n // 2})::double / sum(length(line)) OVER (PARTITION BY doc_id) AS ratio FROM {src}) GROUP BY doc_id)"""


@query("compress_trace", "v_trace", STEPS + BLOCKS + STEPTEXT + PLAIN + f""",
f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'json_array'
 WHEN len(regexp_extract_all(process, '\\[(?:reasoning|web_search|scrape|run_python_code)\\]')) >= 2 THEN 'block_text'
 WHEN len(regexp_extract_all(process, '\\[Step [0-9]+\\]')) >= 2 THEN 'step_text' ELSE 'plain_text' END AS trace_format FROM v_trace),
cj AS {squeeze('jline', 1200, 60, 100)}, cb AS {squeeze('bn', 1200, 40, 80)}
SELECT f.doc_id, f.trace_format, CASE trace_format WHEN 'json_array' THEN cj.text WHEN 'block_text' THEN cb.text WHEN 'step_text' THEN {cut('sj.t', 1200)} ELSE {cut('pl.t', 1200)} END AS compressed
FROM f LEFT JOIN cj USING (doc_id) LEFT JOIN cb USING (doc_id) JOIN sj USING (doc_id) JOIN pl USING (doc_id)""")
def _(d):
    return T.compress_trace(d.wide("v_trace"), 1200).select("doc_id", "trace_format", "compressed")


TAGGED = "(\\[(?:reasoning|web_search|scrape|run_python_code)\\])"
STEPPED = "(\\[Step [0-9]+\\])"


def _marked(pattern):
    return f"string_split(regexp_replace(process, '{pattern}', {M} || '\\1', 'g'), {M})"


# JSON items are written without blanks, but count with one after each comma and colon: five in the first, eight in others
def pack_sql(limit):
    """Views up to `pk`, the chunks of all traces."""
    return f""", k AS (SELECT doc_id, process, CASE WHEN doc_id % 5 = 0 THEN 'json_array'
 WHEN len(regexp_extract_all(process, '{TAGGED}')) >= 2 THEN 'block_text' WHEN len(regexp_extract_all(process, '{STEPPED}')) >= 2 THEN 'step_text' ELSE 'plain_text' END AS f FROM v_trace),
j AS (SELECT doc_id, string_split(replace(replace(text, chr(92), ''), '"', chr(39)), chr(10)) AS t FROM documents WHERE doc_id % 5 = 0),
k2 AS (SELECT doc_id, f, CASE f WHEN 'block_text' THEN {_marked(TAGGED)} WHEN 'step_text' THEN {_marked(STEPPED)}
   ELSE list_concat([''], string_split_regex(process, '\\n\\s*\\n')) END AS l, 0 AS blanks FROM k WHERE f <> 'json_array'
  UNION ALL SELECT doc_id, 'json_array', list_concat(['', concat('{{"step":1,"type":"think","content":"', t[1], '"}}')],
   list_transform(t[2:], lambda x: concat('{{"step":2,"type":"search","keywords":["a","b"],"output":"', x, '"}}'))), 1 FROM j),
s AS (SELECT doc_id, f, l, list_transform(l, lambda x, i: length(x) + CASE WHEN blanks = 0 OR i = 1 THEN 0 WHEN i = 2 THEN 5 ELSE 8 END) AS n FROM k2),
w AS (SELECT doc_id, 2 AS i, 0 AS chunk_no, n[2] AS size FROM s
  UNION ALL SELECT w.doc_id, i + 1, CASE WHEN size + n[i + 1] > {limit} THEN chunk_no + 1 ELSE chunk_no END,
   CASE WHEN size + n[i + 1] > {limit} THEN n[i + 1] ELSE size + n[i + 1] END FROM w JOIN s USING (doc_id) WHERE i < len(l)),
pk AS (SELECT doc_id, f AS trace_format, chunk_no, CASE WHEN f = 'json_array' THEN concat('[', string_agg(l[i], ',' ORDER BY i), ']')
 WHEN f = 'plain_text' THEN string_agg(l[i], chr(10) || chr(10) ORDER BY i)
 ELSE concat(CASE WHEN chunk_no = 0 THEN l[1] ELSE '' END, string_agg(l[i], '' ORDER BY i)) END AS chunk
FROM w JOIN s USING (doc_id) GROUP BY doc_id, f, l, chunk_no)"""


@query("pack_chunks", "v_trace", pack_sql(700) + " SELECT * FROM pk")
@query("pack_chunks_all", "v_trace", pack_sql(700) + " SELECT * FROM pk")
def _(d):
    return T.pack_chunks(d.wide("v_trace"), "doc_id", limit=700)


@query("pack_chunks_tagged", "v_trace", pack_sql(2000) + " SELECT * FROM pk")
def _(d):
    # wider chunks, so that tagged segments share them
    return T.pack_chunks(d.wide("v_trace"), "doc_id", limit=2000)


@query("truncate_report", "v_report", """SELECT doc_id, CASE WHEN length(report) > 500 THEN concat(substr(report, 1, 500), chr(10), chr(10), '[... report truncated ...]')
ELSE report END AS report FROM v_report""")
def _(d):
    return d.wide("v_report").select("doc_id", R.truncate_report(F.col("report"), 500).alias("report"))


SEG = f""", rp AS (SELECT doc_id, string_split(regexp_replace(report, '(\\n\\s*\\n)', '\\1' || {M}, 'g'), {M}) AS l FROM v_report),
ru AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS p FROM rp),
rs AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(p, '^ {{0,3}}#{{1,6}} [^\\n]*\\s*$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM ru WHERE p <> '')"""


@query("segment_reports", "v_report", SEG + " SELECT doc_id, cast(seg AS int) AS idx, string_agg(p, '' ORDER BY n) AS segment FROM rs GROUP BY ALL")
def _(d):
    return R.segment_reports(d.wide("v_report"), "doc_id")


# replies that carry one object in the places a judge may put it
def _replies(d):
    return d.wide("part").selectExpr("p_partkey AS id", r"""CASE p_partkey % 7
        WHEN 0 THEN concat(' {"a": ', p_size, ', "b": [1, 2]} ')
        WHEN 1 THEN concat('text\n```json\n{"a": ', p_size, ', "b": [1, 2]}\n```\nmore')
        WHEN 2 THEN concat('so <json_output> {"a": ', p_size, ', "b": [1, 2]} </json_output> end')
        WHEN 3 THEN concat('I say {"a": ', p_size, ', "b": [1, 2]} and {more')
        WHEN 4 THEN concat('list [', p_size, '] only')
        WHEN 5 THEN concat('```\n{"a": ', p_size, ', "b": [1, 2]}\n```')
        ELSE 'nothing {here' END AS reply""")


OBJ = "concat('{\"a\": ', p_size, ', \"b\": [1, 2]}')"


@query("extract_json", "", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 IN (0, 1, 2, 3, 5) THEN {OBJ} WHEN p_partkey % 7 = 4 THEN concat('[', p_size, ']') END AS json FROM part""")
def _(d):
    return R.extract_json(_replies(d), "reply", "process").select("id", F.trim("json").alias("json"))


@query("extract_json_tasks", "", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 IN (0, 1, 2, 3, 5) THEN {OBJ}
WHEN p_partkey % 7 = 4 THEN concat('[', p_size, ']') END AS json FROM part""")
def _(d):
    return R.extract_json(_replies(d), "reply", "tasks").select("id", "json")


@query("extract_json_quality", "", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 IN (1, 2, 5) THEN {OBJ} WHEN p_partkey % 7 IN (0, 3) THEN '[1, 2]'
WHEN p_partkey % 7 = 4 THEN concat('[', p_size, ']') END AS json FROM part""")
def _(d):
    return R.extract_json(_replies(d), "reply", "quality").select("id", "json")


@query("repair_json", "", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 3 THEN concat('{"a": "', p_name, ' ', chr(92), '"quoted', chr(92), '" x", "b": [1, 2]}')
WHEN 5 THEN NULL ELSE concat('{"a": "', p_name, '"}') END AS json, p_partkey % 6 BETWEEN 1 AND 4 AS repaired FROM part""")
def _(d):
    broken = d.part.selectExpr("p_partkey AS id", r"""CASE p_partkey % 6
        WHEN 0 THEN concat('{"a": "', p_name, '"}') WHEN 1 THEN concat('{"a": "', p_name, '"} tail') WHEN 2 THEN concat('{"a": "', p_name)
        WHEN 3 THEN concat('{"a": "', p_name, ' "quoted" x", "b": [1, 2,],}') WHEN 4 THEN concat('{"a": "', p_name, '}')
        ELSE 'no json' END AS payload""")
    return R.repair_json(broken, "payload").drop("payload")


MERGE = """, p AS (SELECT concat('m', l_suppkey % 10, '/', l_partkey % 100) AS task_id, l_orderkey * 10 + l_linenumber AS chunk_idx, l_linenumber AS n, l_partkey, l_suppkey FROM lineitem)"""


def _chunks(d):
    return d.wide("v_chunk").withColumn("json", R.verdict_block(F.col("summary")))


@query("merge_chunks", "v_chunk", MERGE + """ SELECT task_id, chunk_idx, 0 AS pos, concat(CASE n WHEN 5 THEN 's' ELSE 'a' END, l_partkey) AS statement, 'Right' AS verification FROM p WHERE n <= 5
UNION ALL SELECT task_id, chunk_idx, 1, concat('b', l_suppkey), ' Wrong ' FROM p WHERE n <= 4""")
def _(d):
    return R.merge_chunks(_chunks(d)).select("task_id", "chunk_idx", "pos", "statement", "verification")


@query("dropped_chunks", "v_chunk", MERGE + " SELECT task_id, count(*) AS chunks, count(*) FILTER (n > 5) AS dropped_chunks FROM p GROUP BY task_id")
def _(d):
    return R.dropped_chunks(_chunks(d))


# structured traces made from the lines of the documents; some lack a key
def _structured(d):
    return d.wide("documents").selectExpr("doc_id", "source AS model", """CASE WHEN doc_id % 9 = 4 THEN '{"steps": []}' WHEN doc_id % 9 = 5 THEN 'not json' WHEN doc_id % 9 = 6 THEN '{"steps": null, "global_findings": null}'
        ELSE to_json(named_struct('steps', transform(split(text, '\\n'), (x, i) -> named_struct('step_id', i + 1, 'action_type',
          element_at(array('plan', 'search', 'read', 'analyze', 'synthesize', 'verify'), cast((i + doc_id) % 6 + 1 AS int)), 'summary', x, 'key_findings', array(x))),
        'global_findings', transform(slice(split(text, '\\n'), 1, 3), (x, i) -> named_struct('finding', x, 'first_found_at_step', i + 1, 'related_steps', array(i),
          'evidence_strength', element_at(array('strong', 'moderate', 'weak'), cast((i + doc_id) % 3 + 1 AS int)))))) END AS structured""")


@query("structure_gate", "", "SELECT doc_id FROM documents WHERE doc_id % 9 NOT IN (4, 5)")
def _(d):
    return R.structure_gate(_structured(d)).select("doc_id")


@query("finding_counts", "", """SELECT doc_id, CASE WHEN doc_id % 9 = 6 THEN 0 ELSE len(string_split(text, chr(10))) END AS num_steps,
CASE WHEN doc_id % 9 = 6 THEN 0 ELSE least(3, len(string_split(text, chr(10)))) END AS num_global_findings FROM documents WHERE doc_id % 9 NOT IN (4, 5)""")
def _(d):
    counts = R.finding_counts(R.structure_gate(_structured(d)), "doc_id")
    return counts.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("num_steps", "num_global_findings")])


@query("action_counts", "", """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 9 NOT IN (4, 5, 6))
SELECT 'action_type' AS field, ['plan', 'search', 'read', 'analyze', 'synthesize', 'verify'][(i + doc_id) % 6 + 1] AS value, count(*) AS n FROM (SELECT doc_id, unnest(range(0, n)) AS i FROM l) GROUP BY ALL
UNION ALL SELECT 'evidence_strength', ['strong', 'moderate', 'weak'][(i + doc_id) % 3 + 1], count(*) FROM (SELECT doc_id, unnest(range(0, least(3, n))) AS i FROM l) GROUP BY ALL""")
def _(d):
    return R.action_counts(R.structure_gate(_structured(d)))
