"""Queries over statement verdicts, criterion scores and process scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, rounded
from gradeloom.operators import scores as S
from gradeloom.session import cut


COUNTS = """, c AS (SELECT model, task_id, count(*) AS total,
  count(*) FILTER (trim(verification) = 'Right') AS "right", count(*) FILTER (trim(verification) = 'Wrong') AS wrong,
  count(*) FILTER (trim(verification) = 'Conflict') AS conflict FROM v_verdict GROUP BY ALL)"""


@query("verdict_counts", "v_verdict", COUNTS + """
SELECT model, task_id, total, "right", wrong, conflict, total - "right" - wrong - conflict AS unknown FROM c""")
def _(d):
    return S.verdict_counts(d.v_verdict, "model", "task_id")


@query("right_ratio_micro", "v_verdict", """SELECT model, count(*) FILTER (trim(verification) = 'Right') AS "right",
count(*) AS total, round(count(*) FILTER (trim(verification) = 'Right')::double / count(*), 9) AS right_ratio
FROM v_verdict GROUP BY model""")
def _(d):
    return rounded(S.right_ratio_micro(S.verdict_counts(d.v_verdict, "model")), "right_ratio")


@query("right_ratio_macro", "v_verdict", COUNTS + """
SELECT model, count(*) AS tasks, round(avg("right"::double / total), 9) AS right_ratio FROM c GROUP BY model""")
def _(d):
    return rounded(S.right_ratio_macro(S.verdict_counts(d.v_verdict, "model", "task_id")), "right_ratio")


@query("normalize_weights", "v_dim_weight", """SELECT query_id, dimension, raw_weight,
round(CASE WHEN sum(raw_weight) OVER (PARTITION BY query_id) > 0
  THEN raw_weight / sum(raw_weight) OVER (PARTITION BY query_id) ELSE raw_weight END, 9) AS norm_weight FROM v_dim_weight""")
def _(d):
    return rounded(S.normalize_weights(d.v_dim_weight, ["query_id"], "raw_weight"), "norm_weight")


@query("normalize_dimension", "", """SELECT query_id, dimension, weight FROM (
 SELECT l_orderkey AS query_id, translate(lower(nm), ' -', '__') AS dimension, w AS weight,
   row_number() OVER (PARTITION BY l_orderkey, translate(lower(nm), ' -', '__') ORDER BY w DESC) AS rn
 FROM (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'Time-Frame Fit' WHEN 1 THEN 'time frame fit' ELSE 'Depth' END AS nm,
   l_partkey * 100000 + l_suppkey AS w FROM lineitem)) WHERE rn = 1""")
def _(d):
    named = d.lineitem.selectExpr(
        "l_orderkey AS query_id",
        "CASE l_linenumber % 3 WHEN 0 THEN 'Time-Frame Fit' WHEN 1 THEN 'time frame fit' ELSE 'Depth' END AS name",
        "l_partkey * 100000 + l_suppkey AS weight")
    return S.normalize_dimension(named.withColumn("pos", F.col("weight")), ["query_id"], "name", "pos", "weight")


@query("default_weights", "v_dim_weight", """,
w AS (SELECT query_id, dimension, raw_weight AS weight FROM v_dim_weight WHERE query_id % 3 <> 0),
q AS (SELECT DISTINCT l_orderkey % 500 AS query_id FROM lineitem),
x AS (SELECT DISTINCT query_id, dimension FROM v_dim_weight WHERE dimension LIKE 'extra%'),
miss AS (SELECT query_id, 1.0::double / (4 + (SELECT count(*) FROM x WHERE x.query_id = q.query_id)) AS weight FROM q
         WHERE query_id NOT IN (SELECT query_id FROM w))
SELECT query_id, dimension, round(weight, 9) AS weight FROM w
UNION ALL SELECT query_id, unnest(['coverage', 'insight', 'instruction_following', 'clarity']), round(weight, 9) FROM miss
UNION ALL SELECT miss.query_id, dimension, round(weight, 9) FROM miss JOIN x USING (query_id)""")
def _(d):
    w = d.v_dim_weight
    given = w.where("query_id % 3 <> 0").withColumnRenamed("raw_weight", "weight")
    extras = w.where("dimension LIKE 'extra%'").select("query_id", "dimension").distinct()
    queries = d.lineitem.selectExpr("l_orderkey % 500 AS query_id").distinct()
    return rounded(S.default_weights(queries, given, extras), "weight")


@query("default_criteria", "v_criteria", """,
g AS (SELECT query_id, dimension, criterion, weight FROM v_criteria WHERE (query_id + length(dimension)) % 4 <> 0)
SELECT query_id, dimension, criterion, weight FROM g
UNION ALL SELECT query_id, dimension, concat(lbl, dimension), w FROM
 (SELECT DISTINCT query_id, dimension FROM v_criteria) a
 CROSS JOIN (VALUES ('Core quality of ', 0.5::double), ('Depth and specificity of ', 0.3::double), ('Relevance and task-alignment of ', 0.2::double)) t(lbl, w)
 WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = a.query_id AND g.dimension = a.dimension)""")
def _(d):
    c = d.v_criteria
    return S.default_criteria(c, c.where("(query_id + length(dimension)) % 4 <> 0"))


@query("reuse_criteria", "v_criteria", """,
r AS (SELECT o_orderkey % 700 AS query_id, max(o_custkey) AS report_id FROM orders GROUP BY 1)
SELECT r.query_id, report_id, dimension, criterion, weight FROM r JOIN v_criteria USING (query_id)""")
def _(d):
    reports = d.orders.groupBy((F.col("o_orderkey") % 700).alias("query_id")).agg(F.max("o_custkey").alias("report_id"))
    return S.reuse_criteria(reports, d.v_criteria)


@query("reuse_criteria_missing", "v_criteria", """
SELECT DISTINCT o_orderkey % 700 AS query_id FROM orders WHERE o_orderkey % 700 NOT IN (SELECT query_id FROM v_criteria)""")
def _(d):
    return S.without_criteria(d.orders.select((F.col("o_orderkey") % 700).alias("query_id")), d.v_criteria)


D2 = """, reply AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, model, dimension, criterion ORDER BY pos DESC) AS rn
  FROM v_reply_score WHERE model IS NOT NULL) WHERE rn = 1 AND score IS NOT NULL),
crit AS (SELECT *, count(*) OVER (PARTITION BY query_id, dimension) AS n FROM v_criteria),
m AS (SELECT r.query_id, model, r.dimension, r.criterion, weight, score, n,
  count(*) OVER (PARTITION BY r.query_id, model, r.dimension) AS hit FROM reply r JOIN crit c
  ON r.query_id = c.query_id AND r.dimension = c.dimension AND r.criterion = c.criterion)"""


@query("join_criterion_scores", "v_criteria v_reply_score",
       D2 + " SELECT query_id, model, dimension, criterion, weight, round(score, 9) AS score FROM m WHERE hit = n")
def _(d):
    return rounded(S.join_criterion_scores(d.v_criteria, d.v_reply_score), "score")


DIM = """, dim AS (SELECT query_id, model, dimension,
  sum(score * weight) FILTER (score IS NOT NULL) / nullif(sum(weight) FILTER (score IS NOT NULL), 0) AS dimension_score
  FROM v_criterion GROUP BY ALL)"""
TOT = DIM + """, tot AS (SELECT query_id, model, coalesce(sum(dimension_score * coalesce(raw_weight, 0)) FILTER (dimension_score IS NOT NULL)
  / nullif(sum(coalesce(raw_weight, 0)) FILTER (dimension_score IS NOT NULL), 0), 0.0::double) AS total_score
  FROM dim LEFT JOIN v_dim_weight USING (query_id, dimension) GROUP BY ALL)"""
QV = "v_criterion v_dim_weight"


def _dims(d):
    return S.dimension_score(d.v_criterion)


def _weights(d):
    # totals and weighted means divide by the sum of the weights used, so raw ones serve
    return d.v_dim_weight.withColumnRenamed("raw_weight", "weight")


def _scored(d):
    """Totals and dimension scores for queries that read both more than once: kept, not recomputed."""
    dims = cut(_dims(d))
    return cut(S.total_score(dims, _weights(d))), dims


@query("dimension_score", "v_criterion", DIM + " SELECT query_id, model, dimension, round(dimension_score, 9) AS dimension_score FROM dim")
def _(d):
    return rounded(_dims(d), "dimension_score")


@query("total_score", QV, TOT + " SELECT query_id, model, round(total_score, 9) AS total_score FROM tot")
def _(d):
    return rounded(S.total_score(_dims(d), _weights(d)), "total_score")


MEANS = TOT + """, qm AS (SELECT model, coalesce(avg(total_score) FILTER (total_score > 0), 0.0::double) AS average_total_score,
  count(*) FILTER (total_score > 0) AS total_queries FROM tot GROUP BY model),
dm AS (SELECT model, dimension, coalesce(avg(dimension_score), 0.0::double) AS dimension_average FROM dim JOIN tot USING (query_id, model)
  WHERE total_score > 0 GROUP BY ALL)"""


@query("quality_summary", QV, MEANS + """ SELECT model, round(average_total_score, 9) AS average_total_score, total_queries, dimension,
round(dimension_average, 9) AS dimension_average FROM qm LEFT JOIN dm USING (model)""")
def _(d):
    return rounded(S.quality_summary(*_scored(d)), "average_total_score", "dimension_average")


FIX = "('coverage', 'insight', 'instruction_following', 'clarity')"


@query("query_spec_score", QV, DIM + f""" SELECT query_id, model, round(sum(dimension_score * coalesce(raw_weight, 0))
/ nullif(sum(coalesce(raw_weight, 0)), 0), 9) AS query_spec FROM dim LEFT JOIN v_dim_weight USING (query_id, dimension)
WHERE dimension NOT IN {FIX} AND dimension_score IS NOT NULL GROUP BY ALL""")
def _(d):
    return rounded(S.query_spec_score(_dims(d), _weights(d)), "query_spec")


@query("meta_average", QV, MEANS + f""" SELECT model, round(coalesce(avg(dimension_average) FILTER (dimension NOT IN {FIX}), 0), 9) AS meta_avg
FROM dm GROUP BY model""")
def _(d):
    return rounded(S.meta_average(S.dimension_means(*_scored(d))), "meta_avg")


@query("leaderboard_quality", QV, MEANS + """ SELECT model, round(average_total_score, 9) AS average_total_score, total_queries,
row_number() OVER (ORDER BY average_total_score DESC, model) AS rank FROM qm""")
def _(d):
    return rounded(S.leaderboard_quality(S.quality_means(S.total_score(_dims(d), _weights(d)))), "average_total_score")


GATE = """, k AS (SELECT *, reply::json AS j FROM v_process_reply),
names AS (SELECT unnest(['search_breadth', 'analytical_depth', 'progressive_refinement', 'critical_thinking', 'efficiency']) AS dimension),
g AS (SELECT * FROM k WHERE (SELECT bool_and(coalesce(list_contains(json_keys(j, '$.' || dimension), 'score'), false)) FROM names)),
gs AS (SELECT model, entry_id, dimension, (j -> dimension ->> 'score')::double AS score FROM g CROSS JOIN names)"""


@query("score_gate", "v_process_reply", GATE + " SELECT * FROM gs")
def _(d):
    return S.score_gate(d.wide("v_process_reply"), S.INTRINSIC_DIMENSIONS)


PS = """, dimsx AS (SELECT 'intrinsic' AS family, unnest(['search_breadth', 'analytical_depth', 'progressive_refinement', 'critical_thinking', 'efficiency']) AS dimension
 UNION ALL SELECT 'alignment', unnest(['findings_to_report', 'report_to_process', 'contradiction'])),
ps AS (SELECT m.model, x.family, x.dimension, avg(p.score) AS avg, count(p.score) AS count FROM (SELECT DISTINCT model FROM pf) m CROSS JOIN dimsx x
 LEFT JOIN pf p ON p.model = m.model AND p.dimension = x.dimension GROUP BY ALL)"""
# next to the table, models of which one family, or no score at all, is known
FAMILIES = """SELECT * FROM (VALUES ('only_i', -1, 'intrinsic', 'search_breadth', 7), ('only_i', -2, 'intrinsic', 'efficiency', 4),
 ('only_a', -1, 'alignment', 'contradiction', 9), ('none', -1, 'intrinsic', 'efficiency', NULL)) AS few(model, entry_id, family, dimension, score)"""
PF = f", pf AS (SELECT model, entry_id, family, dimension, score FROM v_process UNION ALL {FAMILIES})"
PO = PF + PS + """, po AS (SELECT model, avg(avg) FILTER (family = 'intrinsic') AS i, avg(avg) FILTER (family = 'alignment') AS a FROM ps GROUP BY model)"""


def _process(d):
    return S.process_summary(d.v_process.select("model", "entry_id", "family", "dimension", "score").union(d.spark.sql(FAMILIES)))


@query("process_summary", "v_process", PF + PS + " SELECT model, family, dimension, round(avg, 9) AS avg, count FROM ps")
def _(d):
    return rounded(_process(d), "avg")


@query("process_overall", "v_process", PO + """ SELECT model, round(i, 9) AS intrinsic_avg, round(a, 9) AS alignment_avg,
round(coalesce((i + a) / 2, i, a), 9) AS overall_avg FROM po""")
def _(d):
    return rounded(S.process_overall(_process(d)), "intrinsic_avg", "alignment_avg", "overall_avg")


@query("leaderboard_process", "v_process", PO + """ SELECT model, round(i, 9) AS intrinsic_avg, round(a, 9) AS alignment_avg,
round(coalesce((i + a) / 2, i, a), 9) AS overall_avg,
row_number() OVER (ORDER BY coalesce((i + a) / 2, i, a, 0) DESC, model) AS rank FROM po""")
def _(d):
    return rounded(S.leaderboard_process(S.process_overall(_process(d))), "intrinsic_avg", "alignment_avg", "overall_avg")


STRATEGIES = ["rule", "small", "large"]


@query("compare_strategies", "v_strategy", """SELECT model, entry_id, dimension, max(score::double) FILTER (strategy = 'rule') AS rule,
max(score::double) FILTER (strategy = 'small') AS small, max(score::double) FILTER (strategy = 'large') AS large FROM v_strategy GROUP BY ALL""")
def _(d):
    return S.compare_strategies(d.v_strategy.withColumn("score", F.col("score").cast("double")), STRATEGIES)


@query("strategy_means", "v_strategy", """, p AS (SELECT strategy, dimension, avg(score) AS a, count(score) AS n FROM v_strategy GROUP BY ALL)
SELECT strategy, dimension, round(a, 9) AS avg, n, round((SELECT avg(q.a) FROM p q WHERE q.strategy = p.strategy), 9) AS overall FROM p""")
def _(d):
    return rounded(S.strategy_means(d.v_strategy), "avg", "overall")


@query("compression_ratio", "v_strategy", """, w AS (SELECT model, entry_id, max(raw_len) FILTER (strategy = 'rule') AS raw_len,
 max(kept_len) FILTER (strategy = 'rule') AS a, max(kept_len) FILTER (strategy = 'small') AS b, max(kept_len) FILTER (strategy = 'large') AS c
 FROM v_strategy GROUP BY ALL)
SELECT model, entry_id, coalesce(raw_len, 0) AS raw_len, round(CASE WHEN raw_len > 0 THEN coalesce(a, 0) / raw_len ELSE 0::double END, 9) AS ratio_rule,
round(CASE WHEN raw_len > 0 THEN coalesce(b, 0) / raw_len ELSE 0::double END, 9) AS ratio_small,
round(CASE WHEN raw_len > 0 THEN coalesce(c, 0) / raw_len ELSE 0::double END, 9) AS ratio_large FROM w""")
def _(d):
    return rounded(S.compression_ratio(d.v_strategy, STRATEGIES), *[f"ratio_{s}" for s in STRATEGIES])


@query("compare_judges", "v_strategy", """, p AS (SELECT model, entry_id, dimension, max(score) FILTER (strategy = 'small') AS a,
 max(score) FILTER (strategy = 'large') AS b FROM v_strategy GROUP BY ALL)
SELECT dimension, round(avg(b - a), 9) AS mean_diff, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dimension""")
def _(d):
    return rounded(S.compare_judges(d.v_strategy, "small", "large"), "mean_diff")


@query("source_strategy_means", "v_strategy", """, e AS (SELECT model, strategy, entry_id, family, avg(score) AS m FROM v_strategy GROUP BY ALL)
SELECT model, strategy, round(avg(m) FILTER (family = 'intrinsic'), 9) AS intrinsic, round(avg(m) FILTER (family = 'alignment'), 9) AS alignment
FROM e GROUP BY ALL""")
def _(d):
    return rounded(S.source_strategy_means(d.v_strategy), "intrinsic", "alignment")


PHASE = """, e AS (SELECT concat('m', o_custkey % 10, '_', o_orderkey) AS entry_key, o_totalprice AS price FROM orders),
s AS (SELECT concat('m', o_custkey % 10, '_', o_orderkey) AS entry_key, concat('now', o_orderkey) AS structured FROM orders WHERE o_orderkey % 3 = 0),
c AS (SELECT concat('m', o_custkey % 10, '_', o_orderkey) AS entry_key, concat('old', o_orderkey) AS structured FROM orders WHERE o_orderkey % 2 = 0)"""


def _phase(d):
    keyed = d.orders.withColumn("entry_key", F.expr("concat('m', o_custkey % 10, '_', o_orderkey)"))
    return (
        keyed.selectExpr("entry_key", "o_totalprice AS price"),
        keyed.where("o_orderkey % 3 = 0").selectExpr("entry_key", "concat('now', o_orderkey) AS structured"),
        keyed.where("o_orderkey % 2 = 0").selectExpr("entry_key", "concat('old', o_orderkey) AS structured"),
    )


@query("phase_join", "v_process", PHASE + """ SELECT entry_key, price, coalesce(s.structured, c.structured) AS structured
FROM e LEFT JOIN s USING (entry_key) LEFT JOIN c USING (entry_key) WHERE coalesce(s.structured, c.structured) IS NOT NULL""")
def _(d):
    return S.phase_join(*_phase(d))


@query("phase_join_skipped", "v_process", PHASE + """ SELECT entry_key, price FROM e WHERE entry_key NOT IN (SELECT entry_key FROM s)
AND entry_key NOT IN (SELECT entry_key FROM c)""")
def _(d):
    return S.phase_skipped(*_phase(d))
