"""Benchmark runs: attempts and retries per task, pass@k, accuracy, run statistics.

A task's list of attempts is bounded by k; retries are counted, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def pass_at_k(attempts: DataFrame, k: int, max_retry: int | None = None) -> DataFrame:
    """Success per task within k attempts. An attempt ends at its first valid answer and succeeds
    if that answer is correct; the task ends at its first success. Counts run up to the stop, and rows
    that repeat a retry count once. With `max_retry` an attempt is read as a run with that many retries."""
    read = F.col("attempt_id") <= k
    if max_retry is not None:
        read &= F.col("retry_id") < max_retry
    within = attempts.where(read).groupBy("task_id", "attempt_id", "retry_id").agg(
        F.min(F.when(F.col("is_valid_box"), F.struct("is_correct"))).alias("valid"))
    valid_at = F.when(F.col("valid").isNotNull(), F.col("retry_id"))
    ends = within.groupBy("task_id", "attempt_id").agg(
        F.min(valid_at).alias("stop"), F.min_by("valid.is_correct", valid_at).alias("correct"))
    step = within.join(ends, ["task_id", "attempt_id"]).groupBy("task_id", "attempt_id").agg(
        F.first(F.coalesce("correct", F.lit(False))).alias("won"),
        F.count_if(F.col("stop").isNull() | (F.col("retry_id") <= F.col("stop"))).alias("retries"))
    per_task = step.groupBy("task_id").agg(
        F.min(F.when(F.col("won"), F.col("attempt_id"))).alias("won_at"),
        F.collect_list(F.struct("attempt_id", "retries")).alias("steps"),
    )
    ran = F.filter("steps", lambda s: F.col("won_at").isNull() | (s["attempt_id"] <= F.col("won_at")))
    return per_task.select(
        "task_id",
        F.col("won_at").isNotNull().alias("pass_at_k_success"),
        F.size(ran).cast("bigint").alias("total_attempts"),
        F.aggregate(ran, F.lit(0).cast("bigint"), lambda acc, s: acc + s["retries"]).alias("total_retries"),
    )


def primary_attempt(attempts: DataFrame) -> DataFrame:
    """Headline answer of a task: the first attempt's, replaced by later completed ones only while
    it is empty. That is: the first if filled, else the first filled completed one, else the last
    completed one, else the first."""
    at = F.struct("attempt_id", "retry_id")
    row = F.struct("attempt_id", "retry_id", "answer", "status")
    done = F.col("status") == "completed"
    filled = F.coalesce(F.col("answer"), F.lit("")) != ""
    pick = attempts.groupBy("task_id").agg(
        F.min_by(row, at).alias("head"),
        F.min_by(row, F.when(done & filled, at)).alias("fill"),
        F.max_by(row, F.when(done, at)).alias("tail"),
    )
    best = F.when(F.coalesce(F.col("head.answer"), F.lit("")) != "", F.col("head")).otherwise(
        F.coalesce("fill", "tail", "head"))
    return pick.select("task_id", best.alias("b")).select("task_id", "b.*")


def accuracy(results: DataFrame, *keys: str) -> DataFrame:
    """Tasks passed over all tasks."""
    passed = F.col("pass_at_k_success").cast("int")
    return results.groupBy(*keys).agg(
        F.count("*").alias("tasks"), F.count_if("pass_at_k_success").alias("passed"), F.avg(passed).alias("accuracy"))


def run_statistics(runs: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one run), least and greatest of run scores such as '61.25%'."""
    score = F.translate("score", "%", "").try_cast("double")
    return (
        runs.withColumn("__s", score).where("__s IS NOT NULL").groupBy(*keys)
        .agg(
            F.count("*").alias("num_runs"), F.avg("__s").alias("average_score"),
            F.coalesce(F.stddev_samp("__s"), F.lit(0.0).cast("double")).alias("std_dev"),
            F.min("__s").alias("min_score"), F.max("__s").alias("max_score"),
        )
    )


# What stands before and after the summaries of earlier retries.
SUMMARIES_HEAD = (
    "=== Previous Attempts Analysis ===\n"
    "The following summarizes what was tried before and why it did not work.\n"
    "Use this to guide a NEW approach. Avoid repeating the same mistakes.\n"
)
SUMMARIES_FOOT = "=== End of Previous Attempts ===\nBased on the above analysis, try a different approach.\n"


def prior_summaries(attempts: DataFrame) -> DataFrame:
    """Each retry with the failure summaries of the attempt's earlier retries, numbered from 1, between a
    head and a foot; '' where there are none.

    The window holds one attempt: as many rows as it took retries. No row is left out.
    """
    w = (Window.partitionBy("task_id", "attempt_id").orderBy("retry_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.collect_list(F.when(F.col("failure") != "", F.col("failure"))).over(w)
    text = F.array_join(F.transform("__e", lambda s, i: F.concat(
        F.lit("[Attempt "), (i + 1).cast("string"), F.lit("]\n"), s, F.lit("\n"))), "")
    return (
        attempts.withColumn("__e", earlier)
        .withColumn("n_prior", F.size("__e"))
        .withColumn("prior_text", F.when(F.size("__e") > 0, F.concat_ws(
            "\n", F.lit(SUMMARIES_HEAD), text, F.lit(SUMMARIES_FOOT))).otherwise(""))
        .drop("__e")
    )
