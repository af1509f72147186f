import random

from pytest import approx

from gradeloom.operators import scores as S
from gradeloom.plans.quality import quality_board


# a few published cells, copied by hand
CELLS = [("71", "chatgpt", 41, 6, 0, 7), ("71", "claude", 38, 3, 1, 11), ("71", "gemini", 26, 3, 2, 6), ("71", "glm", 30, 5, 0, 11), ("71", "grok", 17, 2, 0, 4)]


def test_ratios_of_published_cells(spark):
    cells = spark.createDataFrame(CELLS, "task_id string, model string, right int, wrong int, conflict int, unknown int")
    got = {r.model: r.right_ratio for r in S.right_ratio_micro(S.total_of_counts(cells)).collect()}
    assert got["chatgpt"] == approx(41 / 54) and got["claude"] == approx(38 / 53) and got["grok"] == approx(17 / 23)


def test_unknown_is_the_rest(spark):
    df = spark.createDataFrame([("t", v) for v in ["Right", " Right\n", "right", "Wrong", None, "Conflict ", "?"]], "task string, verification string")
    r = S.verdict_counts(df, "task").first()
    assert (r.total, r.right, r.wrong, r.conflict, r.unknown) == (7, 2, 1, 1, 3)


def test_weights_sum_to_one_or_stay(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 6.0), (2, 0.0), (2, 0.0)], "q int, w double")
    got = sorted((r.q, r.norm_weight) for r in S.normalize_weights(df, ["q"], "w").collect())
    assert got == [(1, 0.25), (1, 0.75), (2, 0.0), (2, 0.0)]


def test_total_rescales_over_the_scored_dimensions(spark):
    dims = spark.createDataFrame([(1, "m", "a", 8.0), (1, "m", "b", None), (1, "m", "c", 4.0), (2, "m", "x", 5.0)],
                                 "query_id int, model string, dimension string, dimension_score double")
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4), (1, "c", 0.1)], "query_id int, dimension string, weight double")
    got = {r.query_id: r.total_score for r in S.total_score(dims, w).collect()}
    assert got[1] == approx((8 * 0.5 + 4 * 0.1) / 0.6) and got[2] == 0.0
    assert S.quality_means(S.total_score(dims, w)).first().total_queries == 1


def test_one_missing_criterion_fails_the_dimension(spark):
    crit = spark.createDataFrame([(1, "a", "x", 1.0), (1, "a", "y", 3.0), (1, "b", "z", 1.0)], "query_id int, dimension string, criterion string, weight double")
    reply = spark.createDataFrame([(1, "m", "a", "x", 9.0, 1), (1, "m", "a", "x", 5.0, 2), (1, "m", "a", "other", 5.0, 3), (1, "m", "b", "z", 7.0, 4)],
                                  "query_id int, model string, dimension string, criterion string, score double, pos int")
    assert [(r.dimension, r.score) for r in S.join_criterion_scores(crit, reply).collect()] == [("b", 7.0)]
    got = {r.dimension: r.dimension_score for r in S.complete_dimension_score(crit, reply).collect()}
    assert got == {"a": None, "b": 7.0}
    weights = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], "query_id int, dimension string, raw_weight double")
    assert quality_board(crit, reply, weights).first().average_total_score == approx(7.0)


def test_both_ways_to_dimension_scores_agree(spark):
    rng = random.Random(1)
    crit = spark.createDataFrame([(q, d, c, rng.random()) for q in range(9) for d in "ab" for c in "xyz"], "query_id int, dimension string, criterion string, weight double")
    reply = spark.createDataFrame([(rng.randrange(9), rng.choice("mn"), rng.choice("ab"), rng.choice("xyz"), rng.random(), i) for i in range(150)],
                                  "query_id int, model string, dimension string, criterion string, score double, pos int")
    slow = {(r.query_id, r.model, r.dimension): r.dimension_score for r in S.dimension_score(S.join_criterion_scores(crit, reply)).collect()}
    fast = {(r.query_id, r.model, r.dimension): r.dimension_score for r in S.complete_dimension_score(crit, reply).where("dimension_score IS NOT NULL").collect()}
    assert slow.keys() == fast.keys() and all(slow[k] == approx(fast[k]) for k in slow)


def test_process_overall_with_one_family(spark):
    df = spark.createDataFrame([("m", "search_breadth", 4), ("m", "search_breadth", 5), ("m", "efficiency", 8)], "model string, dimension string, score int")
    summary = S.process_summary(df)
    assert summary.count() == 8 and summary.where("count = 0 AND avg IS NULL").count() == 6
    row = S.process_overall(summary).first()
    assert row.overall_avg == approx((4.5 + 8) / 2) and row.alignment_avg is None


def test_gate_needs_the_key_not_the_value(spark):
    rows = [(1, '{"a": {"score": null}, "b": {"score": 3}, "note": "x"}'), (2, '{"a": {"score": 1}, "b": {}}'), (3, '{"a": {"score": 1}, "b": 2}'), (4, "junk")]
    got = S.score_gate(spark.createDataFrame(rows, "entry_id int, reply string"), ["a", "b"]).orderBy("dimension").collect()
    assert [(r.entry_id, r.dimension, r.score) for r in got] == [(1, "a", None), (1, "b", 3.0)]


def test_later_name_wins(spark):
    df = spark.createDataFrame([(1, "Time-Fit", 1, 0.1), (1, "time fit", 2, 0.9)], "q int, name string, pos int, w double")
    assert S.normalize_dimension(df, ["q"], "name", "pos", "w").collect()[0][1:] == ("time_fit", 0.9)
