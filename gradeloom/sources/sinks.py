"""Writers. All of them write in parallel, one file per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def nest_attempts(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per task with its attempts as an ordered array: at most attempts x retries entries."""
    step = F.struct("attempt_id", "retry_id", "answer", "status", "is_valid_box", "is_correct")
    nested = attempts.groupBy("task_id").agg(F.sort_array(F.collect_list(step)).alias("attempts"))
    return tasks.join(nested, "task_id", "left")


def write_results(tasks: DataFrame, attempts: DataFrame, path: str) -> str:
    """Results as JSON lines, one task per line."""
    nest_attempts(tasks, attempts).write.json(path)
    return path


def run_summary(results: DataFrame) -> DataFrame:
    """How many tasks completed and failed."""
    return results.agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))


def write_items(entries: DataFrame, path: str, name: str = "item") -> str:
    """One folder per item, for consumers that look items up by name. Rows of an item meet in one
    task first, so each folder gets one file."""
    entries.repartition(name).write.partitionBy(name).json(path)
    return path
