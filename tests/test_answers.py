import pytest
from pyspark.sql import functions as F

from gradeloom.operators import answers as A, attempts as T
from gradeloom.functions.text import as_float


def col(spark, values, fn, kinds="a string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}")
    return [r[0] for r in df.orderBy("i").select(fn.alias("x")).collect()]


def test_float_reading(spark):
    got = col(spark, ["1", " 2.5 ", "1_000", "1__0", "1d", "1e3", ".5", "5.", "-inf", "NaN", "", "1,000", "0x1"], as_float(F.col("a")))
    want = [1.0, 2.5, 1000.0, None, None, 1000.0, 0.5, 5.0, float("-inf"), None, None, None, None]
    assert got[:9] == want[:9] and got[9] != got[9] and got[10:] == want[10:]


@pytest.mark.parametrize("truth,answer,want", [
    ("5", "$5.00", True), ("5", "5 units", False), ("inf", "words", True), ("nan", "nan", False),
    ("1,000", "1000", False), ("1,000", "1, 000", True), ("a, b", "A ,B", True), ("a,b", "a,b,c", False),
    ("a;2", "A,2.0", True), ("New York!", "new york", True), ("New York", "york", False), ("x", None, False),
    ("a, b!", "a, b", False), ("None", None, False),
])
def test_match(spark, truth, answer, want):
    assert col(spark, [(truth, answer)], A.answer_match(F.col("t"), F.col("a")), "t string, a string") == [want]


def test_null_answer_as_text(spark):
    assert col(spark, [("None", None)], A.answer_match(F.col("t"), F.col("a"), "None"), "t string, a string") == [True]


def test_valid_answer(spark):
    got = col(spark, ["Nonetheless", "", None, "NONE", "No \\boxed{} content found.", "nOne", "42"], A.valid_answer(F.col("a")))
    assert got == [False, False, False, False, False, True, True]


def test_judgements(spark):
    cases = [
        ("equivalence", "Correct.", "CORRECT"), ("equivalence", "correct, yes", "NOT_ATTEMPTED"), ("choice_ab", "C B", "INCORRECT"),
        ("choice_abc", "C", "NOT_ATTEMPTED"), ("choice_abc", "A", "CORRECT"), ("yes_no", "no", "INCORRECT"), ("yes_no", "No", "NOT_ATTEMPTED"),
        ("conclusion_zh", "结论: 错误", "INCORRECT"), ("score_json", '"score": 1, "answer_score": 0', "INCORRECT"), ("score_json", None, "NOT_ATTEMPTED"),
    ]
    got = col(spark, [c[:2] for c in cases], A.parse_judgement(F.col("v"), F.col("r")), "v string, r string")
    assert got == [c[2] for c in cases]


def test_routes(spark):
    got = col(spark, ["gaia-hle", "browsecomp-zh", "browsecomp", "seal-0", "other", "xbench-browsecomp"], A.route_verifier(F.col("a")))
    assert got == ["equivalence", "choice_ab_zh", "choice_ab", "equivalence", "equivalence", "conclusion_zh"]


def run_loop(rows, k, max_retry):
    """The attempt loop, step by step."""
    by = {(a, r): (v, c) for a, r, v, c in rows}
    attempts = retries = 0
    for a in range(1, k + 1):
        if (a, 0) not in by:
            break
        attempts = a
        for r in range(max_retry):
            if (a, r) not in by:
                break
            retries += 1
            valid, correct = by[a, r]
            if valid:
                if correct:
                    return True, attempts, retries
                break
    return False, attempts, retries


def test_pass_at_k_follows_the_loop(spark):
    import random

    rng = random.Random(5)
    data, want = [], {}
    for task in range(60):
        rows = [(a, r, rng.random() < 0.4, rng.random() < 0.4) for a in range(1, 5) for r in range(4)]
        want[task] = run_loop(rows, 3, 3)
        data += [(task, *x) for x in rows]
    df = spark.createDataFrame(data, "task_id int, attempt_id int, retry_id int, is_valid_box boolean, is_correct boolean")
    got = {r.task_id: (r.pass_at_k_success, r.total_attempts, r.total_retries) for r in T.pass_at_k(df, 3, 3).collect()}
    assert got == want


def test_primary_attempt_follows_the_loop(spark):
    import random

    rng = random.Random(6)
    data, want = [], {}
    for task in range(80):
        rows = [(1, r, rng.choice(["", "x", "y", None]), rng.choice(["completed", "failed"])) for r in range(5)]
        head = rows[0]
        for row in rows[1:]:
            if not head[2] and row[3] == "completed":
                head = row
        want[task] = head[1]
        data += [(task, *x) for x in rows]
    df = spark.createDataFrame(data, "task_id int, attempt_id int, retry_id int, answer string, status string")
    assert {r.task_id: r.retry_id for r in T.primary_attempt(df).collect()} == want


def test_run_statistics_of_one_run(spark):
    row = T.run_statistics(spark.createDataFrame([("45.20%",)], "score string")).first()
    assert (row.num_runs, row.average_score, row.std_dev) == (1, 45.2, 0.0)
