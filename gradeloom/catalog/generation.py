"""Queries of task generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query
from gradeloom.operators import generation as G

FLAGS = """, fl AS (SELECT *, searchable AS f1,
 CASE WHEN qid % 9 = 0 THEN false WHEN qid % 9 = 1 THEN false ELSE qid % 8 <> 0 AND (qid % 10)::double / 10 >= 0.7::double END AS f2,
 qid % 10 <> 0 AND qid % 3 <> 2 AND qid % 7 <> 0 AND qid % 11 <> 0 AND (qid % 20)::double / 20 <= 0.75::double AS f3 FROM v_generated)"""
DOMAIN = """CASE qid % 14 WHEN 0 THEN 'tech' WHEN 1 THEN 'policy' WHEN 2 THEN 'finance' WHEN 3 THEN 'policy' WHEN 4 THEN 'tech' WHEN 5 THEN 'health'
 WHEN 6 THEN 'trade' WHEN 7 THEN 'education' WHEN 8 THEN 'energy' WHEN 9 THEN 'science' WHEN 10 THEN 'trade' WHEN 11 THEN 'tech' WHEN 12 THEN 'finance' ELSE 'energy' END"""


@query("deep_research_filter", "v_generated", FLAGS + " SELECT qid, query FROM fl WHERE f2")
def _(d):
    return G.deep_research_filter(d.v_generated).select("qid", "query")


@query("hard_query_filter", "v_generated", FLAGS + " SELECT qid, query FROM fl WHERE f3")
def _(d):
    return G.hard_query_filter(d.v_generated).select("qid", "query")


@query("normalize_domain", "v_generated", f"SELECT qid, domain AS raw, {DOMAIN} AS domain FROM v_generated")
def _(d):
    return d.v_generated.select("qid", F.col("domain").alias("raw"), G.normalize_domain(F.col("domain")).alias("domain"))


STAGES = [("search_valid", "passed_search"), ("dr_filtered", "passed_research"), ("quality_filtered", "passed_quality")]


@query("funnel_counts", "v_generated", FLAGS + """ SELECT 0 AS step, 'generated' AS stage, count(*) AS n FROM fl
UNION ALL SELECT 1, 'search_valid', count(*) FROM fl WHERE f1 UNION ALL SELECT 2, 'dr_filtered', count(*) FROM fl WHERE f1 AND f2
UNION ALL SELECT 3, 'quality_filtered', count(*) FROM fl WHERE f1 AND f2 AND f3""")
def _(d):
    return G.funnel_counts(G.stage_flags(d.v_generated), STAGES)


@query("domain_distribution", "v_generated", f"SELECT {DOMAIN} AS domain, count(*) AS n FROM v_generated GROUP BY 1")
def _(d):
    return G.domain_distribution(d.v_generated)


@query("export_queries", "v_generated", FLAGS + f""" SELECT row_number() OVER (ORDER BY qid) AS id, query, 'text-auto' AS category, {DOMAIN} AS domain, topic, persona,
 CASE WHEN qid % 9 < 2 THEN 0::double ELSE (qid % 10)::double / 10 END AS dr_confidence,
 CASE WHEN qid % 10 = 0 OR qid % 11 = 0 THEN 0::double ELSE (qid % 20)::double / 20 END AS quality_score,
 CASE WHEN qid % 9 < 2 THEN '' ELSE 'High' END AS search_complexity FROM fl WHERE f1""")
def _(d):
    rows = G.stage_flags(d.v_generated).where("passed_search").selectExpr(
        "*", "CAST(NULL AS STRING) AS anchored_event", "CAST(NULL AS BOOLEAN) AS time_sensitive", "10 AS result_count",
        "4 AS source_diversity", "true AS has_recent")
    return G.export_queries(rows).select(
        "id", "query", *[f"annotation.{c}" for c in (
            "category", "domain", "topic", "persona", "dr_confidence", "quality_score", "search_complexity")])


SEEDS = """, s AS (SELECT *, substr(query, 1, 100) AS prefix, min(pos) OVER (PARTITION BY topic) AS tp FROM v_seed WHERE length(query) > 20),
t AS (SELECT DISTINCT topic FROM v_topic),
w AS (SELECT DISTINCT topic, lower(x) AS word FROM (SELECT topic, unnest(string_split(topic, ' ')) AS x FROM (SELECT topic FROM t UNION SELECT topic FROM s)) WHERE length(x) > 3),
n1 AS (SELECT t.topic, (SELECT count(*) FROM s WHERE s.topic = t.topic) AS c FROM t),
pairs AS (SELECT DISTINCT a.topic, b.topic AS st FROM w a JOIN w b ON a.word = b.word JOIN t ON t.topic = a.topic WHERE a.topic <> b.topic),
m1 AS (SELECT t.topic, 1 AS tier, s.tp, s.pos, s.query, s.prefix FROM t JOIN s ON s.topic = t.topic),
m2 AS (SELECT p.topic, 2, s.tp, s.pos, s.query, s.prefix FROM pairs p JOIN n1 ON n1.topic = p.topic AND n1.c < 5 JOIN s ON s.topic = p.st),
cnt AS (SELECT topic, count(*) AS c FROM (SELECT topic FROM m1 UNION ALL SELECT topic FROM m2) GROUP BY topic),
m3 AS (SELECT t.topic, 3, s.tp, s.pos, s.query, s.prefix FROM t LEFT JOIN cnt USING (topic) CROSS JOIN s WHERE coalesce(cnt.c, 0) < 2),
pool AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
u AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY topic, prefix ORDER BY tier, tp, pos) = 1),
ms AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY tier, tp, pos) AS rank, tier, query FROM u QUALIFY rank <= 5)"""


@query("match_seeds", "v_seed v_topic", SEEDS + " SELECT topic, cast(rank AS int) AS rank, tier, query FROM ms")
def _(d):
    return G.match_seeds(d.v_topic, d.v_seed, 5)


CHECK = "concat(chr(10), '[user_query start]>>>', chr(10), {q}, chr(10), '[user_query end]>>>', chr(10), chr(10), '[part_start]>>>', chr(10), {p}, chr(10), '[part_end]>>>', chr(10))"


@query("build_prompts", "v_report", f"SELECT doc_id, {CHECK.format(q='model', p='report')} AS prompt FROM v_report")
def _(d):
    return d.wide("v_report").select("doc_id", G.check_prompt(F.col("model"), F.col("report")).alias("prompt"))


@query("build_prompts_by_attachment", "v_report", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('Task {', model, '} facts: ', report) ELSE concat('Task ', model) END AS prompt FROM v_report""")
def _(d):
    return d.wide("v_report").select("doc_id", G.choose_template(
        F.col("doc_id") % 3 == 0, "Task {{{task}}} facts: {facts}", "Task {task}", task=F.col("model"), facts=F.col("report")).alias("prompt"))


TEMPLATE = "Write {n} questions on {topic} ({subtopics}).\nTrends:\n{trends}\nExamples:\n{seeds}\nJSON {{only}}"


@query("build_prompts_generation", "v_seed v_topic", SEEDS + """, tr AS (SELECT lang AS k, topic, doc_id AS pos, concat('- [', CASE WHEN doc_id % 2 = 0 THEN 'recent' ELSE source END, '] ', lang, ': ', substr(text, 1, 150)) AS line,
  row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS rn FROM (SELECT *, concat('SMALL market Brand#', doc_id % 30) AS topic FROM documents)),
ta AS (SELECT topic, string_agg(line, chr(10) ORDER BY pos) AS x FROM tr WHERE rn <= 15 GROUP BY topic),
sa AS (SELECT topic, string_agg('- ' || substr(query, 1, 300), chr(10) ORDER BY rank) AS x FROM ms GROUP BY topic)
SELECT t.topic, concat('Write 6 questions on ', t.topic, ' (a, b).', chr(10), 'Trends:', chr(10), coalesce(ta.x, '(No trends found — use known recent developments)'), chr(10),
 'Examples:', chr(10), coalesce(sa.x, '(No seeds available)'), chr(10), 'JSON {only}') AS prompt FROM t LEFT JOIN ta USING (topic) LEFT JOIN sa USING (topic)""")
def _(d):
    topics = d.v_topic.select("topic").distinct().withColumn("subtopics", F.array(F.lit("a"), F.lit("b")))
    trends = d.documents.selectExpr(
        "concat('SMALL market Brand#', doc_id % 30) AS topic", "doc_id AS pos", "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS date",
        "lang AS title", "text AS snippet")
    return G.generation_prompts(topics, trends, G.match_seeds(topics, d.v_seed, 5), TEMPLATE, 6)
