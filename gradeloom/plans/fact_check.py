"""Fact checking of reports from text to ratios, as one chain of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.operators.generation import check_prompt
from gradeloom.operators.judging import Scorer, ask_all
from gradeloom.operators.reports import dropped_chunks, merge_chunks, repair_json, segment_reports, verdict_block
from gradeloom.operators.scores import right_ratio_macro, right_ratio_micro, verdict_counts


def check_chunks(reports: DataFrame, scorer: Scorer, *, tries: int = 5, **how) -> DataFrame:
    """One row per report part with the scorer's payload. `reports` has task_id, user_query and report.

    The parts of one report go to different partitions, so a long report does not wait in one task.
    The result is kept before it is used. `how`: see `ask_all`.
    """
    parts = segment_reports(reports, "task_id", "user_query").withColumnRenamed("idx", "chunk_idx")
    prompts = parts.select("task_id", "chunk_idx", check_prompt(F.col("user_query"), F.col("segment")).alias("prompt"))
    asked = ask_all(prompts, ["task_id", "chunk_idx"], "prompt", scorer, tries=tries, **how).drop("prompt")
    payload = asked.select("task_id", "chunk_idx", F.col("reply").isNotNull().alias("ok"), verdict_block(F.col("reply")).alias("payload"))
    return repair_json(payload, "payload")


def fact_check(reports: DataFrame, scorer: Scorer, *, tries: int = 5, **how) -> DataFrame:
    """Verdict counts per report, with the number of parts that were lost on the way."""
    chunks = check_chunks(reports, scorer, tries=tries, **how)
    counts = verdict_counts(merge_chunks(chunks), "task_id")
    return dropped_chunks(chunks).join(counts, "task_id", "left").fillna(0)


def ratios(counts: DataFrame) -> DataFrame:
    """Both ratios per model of counts with a model column."""
    micro = right_ratio_micro(counts).select("model", "right", "total", F.col("right_ratio").alias("micro"))
    return micro.join(right_ratio_macro(counts).select("model", "tasks", F.col("right_ratio").alias("macro")), "model", "left")
