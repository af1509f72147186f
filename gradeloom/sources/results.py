"""Results kept between runs: an append-only store of keyed rows.

Rows go to a folder of their own, and count from the moment a file of the same name stands among the commits; creating
that file is one step of the file system. A folder that a lost job left half written has no such file and is never
read. Rows are never changed: of several with one key the earliest commit counts, so that a result once used stays.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.session import cut


class ResultStore:
    """Rows with the columns of `schema` (DDL), kept by the columns `keys` below `path`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def commits(self) -> list[str]:
        """Names of all commits, the earliest first."""
        store, folder = self._at(f"{self.path}/commits")
        return sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []

    def read(self) -> DataFrame:
        """All committed rows, one per key."""
        names = self.commits()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names])
        others = [c for c in rows.columns if c not in self.keys]
        # folders are named by time, so the least path is the earliest commit
        first = F.min_by(F.struct(*others), F.col("_metadata.file_path")) if others else None
        kept = rows.groupBy(*self.keys).agg(first.alias("r")).select(*self.keys, "r.*") if others else rows.distinct()
        return kept.select(*rows.columns)

    def add(self, rows: DataFrame) -> str:
        """Writes rows and commits them; the commit's name."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).write.parquet(f"{self.path}/data/{name}")
        store, mark = self._at(f"{self.path}/commits/{name}")
        store.mkdirs(mark.getParent())
        if not store.createNewFile(mark):
            raise FileExistsError(name)
        return name


def with_store(requests: DataFrame, store: ResultStore, compute: Callable[[DataFrame], DataFrame], rounds: int = 8) -> DataFrame:
    """`requests` with their results: stored ones, and for the others those of `compute` (rows with the store's columns
    and `ok`). What is open is computed in `rounds` parts by a hash of the key, each committed before the next begins, so
    a lost job loses one part at most. Failures (not `ok`) are not stored and have no result; `cached` says which results
    were there before."""
    before = cut(store.read())
    keys = store.keys
    open_ = cut(requests.join(before, keys, "left_anti"))
    part = F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(rounds))
    for n in range(rounds):
        some = open_.where(part == n)
        if some.head(1):
            store.add(compute(some).where("ok"))
    marked = before.select(*keys).withColumn("cached", F.lit(True))
    return requests.join(store.read(), keys, "left").join(marked, keys, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
