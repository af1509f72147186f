"""Which entries a run takes up: white list, limits, samples, resume, cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.jsontext import is_json
from gradeloom.functions.numbering import first_n, first_rows
from gradeloom.session import cut


def entry_limit(n: int | None, zero_means_all: bool) -> int | None:
    """The benchmark runner reads null and negative limits as 'all', the report runs null and zero."""
    if n is None or n < 0 or (n == 0 and zero_means_all):
        return None
    return n


def select_entries(entries: DataFrame, whitelist: DataFrame | None = None, first: int | None = None, zero_means_all: bool = True) -> DataFrame:
    """White-listed entries, and of these the first n per model in file order."""
    picked = entries if whitelist is None else entries.join(whitelist.select("id").distinct(), "id", "left_semi")
    n = entry_limit(first, zero_means_all)
    return picked if n is None else first_n(picked, ["model"], [F.col("pos")], n)


def sample_queries(queries: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """n queries by a seeded hash of their id, in id order; all of them if there are no more than n."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return first_rows(queries.withColumn("__draw", draw), ["__draw", key], n).drop("__draw").orderBy(key)


def pending_tasks(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tasks without a readable output; an output that is no JSON is written again."""
    done = outputs.where(is_json(F.col("content"))).select("task_id")
    return tasks.join(done, "task_id", "left_anti")


def cache_reuse(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all results, new cache rows). Cached keys are taken from the cache, the others computed once:
    the computed part is kept before it is used twice. Only successful rows (`ok`) go to the cache."""
    hits = requests.join(cache, keys).withColumn("ok", F.lit(True)).withColumn("cached", F.lit(True))
    fresh = cut(compute(requests.join(cache.select(*keys), keys, "left_anti"))).withColumn("cached", F.lit(False))
    return hits.unionByName(fresh), fresh.where("ok").drop("ok", "cached")


def report_key(report: Column) -> Column:
    """Stable cache key of a report text."""
    return F.sha2(report, 256)


def weight_key(query: Column, dimensions: Column) -> Column:
    """Cache key of weights: the query and the names of its dimensions, not only their number."""
    return F.concat_ws(":", query.cast("string"), F.sha2(F.array_join(F.sort_array(dimensions), "\n"), 256))
