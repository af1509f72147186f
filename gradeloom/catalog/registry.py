"""Table of registered queries and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.catalog.views import load, with_views
from gradeloom.session import INPUT_PARTITIONS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Named access to the tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def wide(self, name: str) -> DataFrame:
        """The same for row-wise work that costs far more than the scan, dealt out where the session asks for it."""
        rows = load(self.spark, self.sf_dir, name)
        wanted = self.spark.conf.get(INPUT_PARTITIONS, None)
        return rows.repartition(int(wanted)) if wanted else rows


def query(name: str, views: str = "", sql: str | None = None):
    """Registers `fn(data)` under `name`; `sql` is the check, over the listed views."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql is not None:
            names = views.split()
            if not names:
                ORACLES[name] = sql
            elif sql.lstrip().startswith(","):
                ORACLES[name] = with_views(*names) + sql
            else:
                ORACLES[name] = with_views(*names) + " " + sql
        return fn

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Rounds for comparison with the check; the operators themselves return unrounded values.

    Nine places: means of whole numbers often end exactly on a five at six places.
    """
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), 9))
    return df
