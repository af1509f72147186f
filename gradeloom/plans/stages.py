"""Chains of stages with resumable outputs.

Each stage gets the outputs of those before it and returns its rows, or its rows and the rows it rejects. Both are
written below the chain's folder; a stage whose output is complete there is read, not run again. So a chain that was
lost goes on with the stage that was under way, and gives the same rows as one that was not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Stage = Callable[[dict[str, DataFrame]], DataFrame | tuple[DataFrame, DataFrame]]


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run_stages(spark: SparkSession, out: str, stages: list[tuple[str, Stage]]) -> dict[str, DataFrame]:
    """Outputs by stage name, and of stages that reject rows these under `name.rejects`."""
    done: dict[str, DataFrame] = {}
    for name, stage in stages:
        path, rejects = f"{out}/{name}", f"{out}/{name}.rejects"
        if not _complete(spark, path):
            made = stage(done)
            rows, lost = made if isinstance(made, tuple) else (made, None)
            # the rows come last: once they are complete the stage is
            if lost is not None:
                lost.write.mode("overwrite").parquet(rejects)
            rows.write.mode("overwrite").parquet(path)
        done[name] = spark.read.parquet(path)
        if _complete(spark, rejects):
            done[f"{name}.rejects"] = spark.read.parquet(rejects)
    return done


def stage_counts(done: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows, rejected) of a chain."""
    counts = None
    for name, rows in done.items():
        lost = name.endswith(".rejects")
        one = rows.agg(F.count("*").alias("n")).select(
            F.lit(name.removesuffix(".rejects")).alias("stage"), F.when(F.lit(not lost), F.col("n")).alias("rows"),
            F.when(F.lit(lost), F.col("n")).alias("rejected"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy("stage").agg(F.max("rows").alias("rows"), F.coalesce(F.max("rejected"), F.lit(0)).alias("rejected"))
