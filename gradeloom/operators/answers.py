"""Answer checks as columns: validity, matching, judge replies, routing. No shuffle in any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.text import (
    as_float, contains_any, equal_numbers, loose_number, reads_as_float, squeeze, trim_blank,
)

# An answer that contains one of these is no answer.
INVALID_MARKERS = [
    "NO_ANSWER", "INSUFFICIENT_INFO", "CANNOT_DETERMINE", "None", "none", "N/A", "n/a", "NONE",
    "Unknown", "unknown", "UNKNOWN", "No \\boxed{} content found.",
]

# Verdict names.
CORRECT, INCORRECT, NOT_ATTEMPTED = "CORRECT", "INCORRECT", "NOT_ATTEMPTED"

# Benchmark name parts in order of precedence, and the judge they go to.
VERIFIER_RULES = [
    ("gaia", "equivalence"), ("finsearchcomp", "score_json"), ("simpleqa", "choice_abc"),
    ("xbench", "conclusion_zh"), ("browsecomp-zh", "choice_ab_zh"), ("browsecomp", "choice_ab"),
    ("hle", "yes_no"), ("webwalkerqa", "equivalence"), ("frames", "equivalence"), ("seal", "equivalence"),
]


def valid_answer(answer: Column) -> Column:
    """False for a missing or empty answer and for one that contains an invalid marker anywhere."""
    filled = F.coalesce(answer, F.lit(""))
    return (filled != "") & ~contains_any(filled, INVALID_MARKERS)


def answer_match(truth: Column, answer: Column, missing: str | None = None) -> Column:
    """Whether an answer equals the truth: as number, as list, or as text without blanks and punctuation.

    `missing` is the text a null answer stands for; without it a null answer never matches.
    """
    given = answer if missing is None else F.coalesce(answer, F.lit(missing))

    def number_equal(a, t):
        return equal_numbers(loose_number(a), as_float(t))

    wanted, parts = F.split(truth, "[,;]", -1), F.split(given, "[,;]", -1)
    pairs = F.arrays_zip(wanted.alias("t"), parts.alias("a"))
    as_list = (F.size(wanted) == F.size(parts)) & F.forall(pairs, lambda p: F.when(
        reads_as_float(p["t"]), number_equal(p["a"], p["t"])).otherwise(
        squeeze(p["a"], False) == squeeze(p["t"], False)))
    verdict = (
        F.when(reads_as_float(truth), number_equal(given, truth))
        .when(truth.rlike("[,;]"), as_list)
        .otherwise(squeeze(given) == squeeze(truth))
    )
    return F.coalesce(verdict, F.lit(False))


def parse_judgement(verifier: Column, reply: Column) -> Column:
    """Verdict in a judge's reply, by the reply format of the verifier. Unreadable: NOT_ATTEMPTED."""
    word = F.lower(F.rtrim(trim_blank(reply), F.lit(".")))
    two, three = F.regexp_extract(reply, "[AB]", 0), F.regexp_extract(reply, "[ABC]", 0)
    # The two words of the Chinese conclusion line.
    conclusion = F.regexp_extract(reply, r"(?U)结论:*\s*(正确|错误)", 1)
    score = (
        F.when(reply.rlike(r'"answer_score":\s*1'), CORRECT).when(reply.rlike(r'"answer_score":\s*0'), INCORRECT)
        .when(reply.rlike(r'"score":\s*1'), CORRECT).when(reply.rlike(r'"score":\s*0'), INCORRECT)
    )

    def choose(c, right, wrong):
        return F.when(c == right, CORRECT).when(c == wrong, INCORRECT)

    verdict = (
        F.when(verifier == "equivalence", choose(word, "correct", "incorrect"))
        .when(verifier.isin("choice_ab", "choice_ab_zh"), choose(two, "A", "B"))
        .when(verifier == "choice_abc", choose(three, "A", "B"))
        .when(verifier == "yes_no", choose(reply, "yes", "no"))
        .when(verifier == "conclusion_zh", choose(conclusion, "正确", "错误"))
        .when(verifier == "score_json", score)
    )
    return F.coalesce(verdict, F.lit(NOT_ATTEMPTED))


def route_verifier(benchmark: Column) -> Column:
    """Judge for a benchmark: the first rule whose name part occurs, else plain equivalence.

    Ten fixed rules in order are a CASE column; a rule-table join would be a nested loop.
    """
    chain = None
    for part, verifier in VERIFIER_RULES:
        hit = benchmark.contains(part)
        chain = F.when(hit, verifier) if chain is None else chain.when(hit, verifier)
    return chain.otherwise("equivalence")


def match_answers(df: DataFrame, missing: str | None = None) -> DataFrame:
    return df.withColumn("is_match", answer_match(F.col("truth"), F.col("answer"), missing))
