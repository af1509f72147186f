"""Run logs: spans, costs, progress and time left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def span_durations(events: DataFrame) -> DataFrame:
    """Duration of each span in whole milliseconds, from its start and end event, in one grouping."""
    ends = events.groupBy("span_id").agg(
        F.max(F.when(F.col("type") == "span_start", F.col("path"))).alias("path"),
        F.min(F.when(F.col("type") == "span_start", F.col("ts"))).alias("__a"),
        F.max(F.when(F.col("type") == "span_end", F.col("ts"))).alias("__b"))
    return ends.select("span_id", "path", F.timestamp_diff("MILLISECOND", F.col("__a"), F.col("__b")).alias("duration_ms"))


def durations_by_path(spans: DataFrame) -> DataFrame:
    """Closed spans, total and longest duration per path."""
    return spans.where("duration_ms IS NOT NULL").groupBy("path").agg(
        F.count("*").alias("spans"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call from the model's prices per thousand tokens; null for a model without price.
    Spark broadcasts the price table when it measures it as small."""
    cost = F.col("input_tokens") / 1000 * F.col("input_price") + F.col("output_tokens") / 1000 * F.col("output_price")
    return calls.join(prices, "model", "left").withColumn("cost", cost).drop("input_price", "output_price")


def rough_cost(input_tokens: Column, output_tokens: Column) -> Column:
    """Flat estimate: 1.25 per million tokens in, 10 per million out."""
    return (input_tokens * F.lit(1.25).cast("double") + output_tokens * 10) / 1_000_000


def latest_status(log: DataFrame) -> DataFrame:
    """Last reported status of each (task, chunk)."""
    return log.groupBy("task_id", "chunk").agg(F.max_by("status", "seq").alias("status"))


def task_states(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """One row per task seen: completed if it has a result, else in progress, with its chunk counts."""
    seen = chunks.select("task_id", F.lower("status").alias("status"), F.lit(False).alias("done")).unionByName(
        results.select("task_id", F.lit(None).cast("string").alias("status"), F.lit(True).alias("done")))
    return seen.groupBy("task_id").agg(
        F.bool_or("done").alias("completed"),
        F.count_if(~F.col("done")).alias("chunks"),
        F.count_if(F.col("status") == "completed").alias("chunks_completed"),
        F.count_if(F.col("status") == "running").alias("chunks_running"),
    )


def progress_summary(chunks: DataFrame, results: DataFrame, expected: int) -> DataFrame:
    """Task and chunk totals of a run; chunk totals cover the tasks in progress."""
    open_ = ~F.col("completed")

    def of_open(c):
        return F.coalesce(F.sum(F.when(open_, F.col(c))), F.lit(0)).alias(c)

    sums = task_states(chunks, results).agg(
        F.count_if("completed").alias("completed"), F.count_if(open_).alias("in_progress"),
        of_open("chunks"), of_open("chunks_completed"), of_open("chunks_running"))
    return sums.withColumn("not_started", F.greatest(F.lit(0), F.lit(expected) - F.col("completed") - F.col("in_progress")))


def iso_time(c: Column) -> Column:
    """ISO time without its zone, as written; null when unreadable."""
    return F.regexp_replace(c, r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$", "").try_cast("timestamp_ntz")


def eta(chunk_times: DataFrame, summary: DataFrame) -> DataFrame:
    """Minutes elapsed, per completed task, and left; null while nothing is completed.

    `summary` is the one row of `progress_summary`.
    """
    # the two ends of the run as one scalar value
    ends = chunk_times.agg(F.struct(
        F.min(iso_time(F.col("start_time"))).alias("a"), F.max(iso_time(F.col("end_time"))).alias("b"))).scalar()
    minutes = F.timestamp_diff("MICROSECOND", F.col("__t.a"), F.col("__t.b")) / F.lit(60_000_000).cast("double")
    per_task = F.col("elapsed_minutes") / F.nullif("completed", F.lit(0))
    return (
        summary.withColumn("__t", ends).withColumn("elapsed_minutes", minutes)
        .withColumn("minutes_per_task", per_task)
        .withColumn("minutes_left", (F.col("not_started") + F.col("in_progress")) * F.col("minutes_per_task"))
        .select("completed", "in_progress", "not_started", "elapsed_minutes", "minutes_per_task", "minutes_left")
    )
