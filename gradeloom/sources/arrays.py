"""Items of JSON-array files, read by many tasks however large a file is.

Spark reads a file that is one JSON array in one task. Here a file is cut into byte ranges. Where a range begins is
unknown: inside a text or outside, and how deep. So a first pass over the ranges notes, for either case, how quotes and
brackets change the state; summed up in order (three numbers per range), this tells the state at the start of each
range. In the second pass each range gives the items that begin in it, and reads on until the last of them ends.

A file counts as an array of objects if it opens with a bracket and ends with its partner, every item is a JSON object,
and nothing but blanks and one comma less than items lies between. Other files give no items; they are told apart by
`broken`. (A comma in a wrong place is not seen where their number is right.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeloom.functions.jsontext import is_json
from gradeloom.session import cut
from gradeloom.sources.store import list_files, read_range

RANGE = 32 << 20      # bytes of a range
TASKS_PER_CORE = 4    # at least, as far as there are ranges
TASK = 32 << 20       # bytes of ranges looked at by one task, where there are more than a core's share
FEW = 10_000          # broken files that are sent to every task
_BLOCK = 4 << 20      # bytes looked at together
_AHEAD = 16 << 10     # bytes first read behind a range, to where its last item ends; twice as many each time
_QUOTE, _ESCAPE, _COMMA = b'"\\,'
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"[{")] = 1
_DEPTH[list(b"]}")] = -1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Quotes that open or close a text: those not behind an odd number of backslashes; `before` of them end what came
    before."""
    place = np.arange(len(data))
    other = np.where(data != _ESCAPE, place, -1 - before)
    last = np.maximum.accumulate(np.concatenate([[-1 - before], other]))[:-1]
    return (data == _QUOTE) & ((place - 1 - last) % 2 == 0)


def _backslashes_at_end(part: bytes, before: int) -> int:
    n = len(part) - len(part.rstrip(b"\\"))
    return before + n if n == len(part) else n


def _backslashes_before(path: str, start: int) -> int:
    """How many backslashes end the bytes before a place."""
    n, size = 0, 64
    while start > n:
        part = read_range(path, max(0, start - n - size), min(size, start - n))
        run = _backslashes_at_end(part, 0)
        n, size = n + run, 2 * size
        if run < len(part):
            break
    return n


def summary(path: str, start: int, size: int) -> tuple[int, int, int]:
    """(quotes modulo 2, depth change if the range begins outside a text, and if it begins inside one)"""
    odd, change, before = 0, [0, 0], _backslashes_before(path, start)
    for at in range(start, start + size, _BLOCK):
        part = read_range(path, at, min(_BLOCK, start + size - at))
        data = np.frombuffer(part, np.uint8)
        quote = _quotes(data, before)
        # texts lie behind an odd number of quotes if the range begins outside, else behind an even number
        inside = (np.cumsum(quote) - quote + odd) % 2
        depth = _DEPTH[data]
        change = [c + int(depth[inside == k].sum()) for k, c in enumerate(change)]
        odd = (odd + int(quote.sum())) % 2
        before = _backslashes_at_end(part, before)
    return odd, *change


def items(path: str, start: int, size: int, length: int, in_text: int, depth: int) -> tuple[list[tuple[int, bytes]], tuple[int, int, int]]:
    """The items (place, bytes) that begin in a range of a file of `length` bytes, and what else lies in the range at the
    array's own level: (array openings, commas, anything that should not be there)."""
    found, held, open_at = [], [], None
    opened = commas = stray = 0
    ahead = _AHEAD
    at, before, odd = start, _backslashes_before(path, start), in_text
    while at < length and (at < start + size or open_at is not None):
        own = at < start + size
        part = read_range(path, at, min(_BLOCK, (start + size if own else min(at + ahead, length)) - at))
        ahead = ahead if own else 2 * ahead
        data = np.frombuffer(part, np.uint8)
        quote = _quotes(data, before)
        change = np.where((np.cumsum(quote) - quote + odd) % 2 == 0, _DEPTH[data], 0)
        after = depth + np.cumsum(change)
        prior = after - change
        ends = np.flatnonzero((prior == 2) & (after == 1))
        if open_at is not None:
            if len(ends):
                found.append((open_at, b"".join([*held, part[:ends[0] + 1]])))
                open_at = None
            else:
                held.append(part)
        if own:
            for k in np.flatnonzero((prior == 1) & (after == 2)).tolist():
                end = np.searchsorted(ends, k)
                if end < len(ends):
                    found.append((at + k, part[k:ends[end] + 1]))
                else:
                    open_at, held = at + k, [part[k:]]
            level = np.maximum(prior, after) <= 1
            opens, closes = level & (prior == 0) & (data == 91), level & (after == 0) & (data == 93) & (prior == 1)
            comma = level & (data == _COMMA) & (prior == 1)
            opened += int(opens.sum())
            commas += int(comma.sum())
            stray += int((level & ~opens & ~closes & ~comma & ~_BLANK[data]).sum())
        odd = (odd + int(quote.sum())) % 2
        depth = int(after[-1])
        before = _backslashes_at_end(part, before)
        at += len(part)
    return found, (opened, commas, stray + (open_at is not None))


def _ranges(spark: SparkSession, path: str, suffix: str, size: int) -> DataFrame:
    """(file, start, size, length) of ranges with the state they begin in."""
    files = spark.createDataFrame([(p, n) for p, n, _ in list_files(path, suffix) if n], "file string, length long")
    starts = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    n, total = starts.agg(F.count("*"), F.sum(F.least(F.lit(size), F.col("length") - F.col("start")))).first()
    # by bytes: small ranges share a task, so that the number of tasks does not follow the number of ranges
    tasks = max(1, min(n, max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK))))
    ranges = starts.withColumn("size", F.least(F.lit(size), F.col("length") - F.col("start"))).repartition(tasks, "file", "start")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [summary(*r) for r in zip(batch["file"], batch["start"], batch["size"])]
            for k, name in enumerate(("odd", "outside", "inside")):
                batch[name] = [g[k] for g in got]
            yield batch

    seen = cut(ranges.mapInPandas(look, "file string, length long, start long, size long, odd long, outside long, inside long"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    told = seen.withColumn("in_text", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).withColumn(
        "change", F.when(F.col("in_text") == 0, F.col("outside")).otherwise(F.col("inside")))
    return cut(told.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))).repartition(tasks, "file", "start"))


def read_array_items(spark: SparkSession, path: str, suffix: str = ".json", size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(items, broken): file, place (in bytes) and value (its JSON text) of every object of the array files at or below a path;
    and the files that are no such array, which give no items. Empty files are broken without being listed."""
    ranges = _ranges(spark, path, suffix, size)

    fields = "file string, start long, place long, value string, opened long, commas long, stray long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in fields.split(", "))])
        for batch in batches:
            for r in batch.to_pylist():
                found, level = items(r["file"], r["start"], r["size"], r["length"], r["in_text"], r["depth"])
                rows = [(r["file"], r["start"], p, v.decode("utf-8", "replace"), None, None, None) for p, v in found]
                columns = zip(*[*rows, (r["file"], r["start"], None, None, *level)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    wide = ranges.mapInArrow(read, fields)
    rows = cut(wide.withColumn("bad", F.when(F.col("value").isNotNull(), ~(F.col("value").startswith("{") & is_json(F.col("value"))))))
    last = ranges.groupBy("file").agg(F.sum("change").alias("depth"), (F.sum("odd") % 2).alias("odd"))
    told = rows.groupBy("file").agg(
        F.sum("opened").alias("opened"), F.sum("commas").alias("commas"), F.sum("stray").alias("stray"), F.count("value").alias("items"),
        F.count_if("bad").alias("bad")).join(last, "file")
    sound = ((F.col("depth") == 0) & (F.col("odd") == 0) & (F.col("opened") == 1) & (F.col("stray") == 0) & (F.col("bad") == 0)
             & (F.col("commas") == F.greatest(F.col("items") - 1, F.lit(0))))
    broken = cut(told.where(~sound).select("file"))
    found = rows.where(F.col("value").isNotNull())
    if broken.count() <= FEW:   # items stay where they are
        kept = found.join(F.broadcast(broken), "file", "left_anti")
    else:   # by range, since one file may hold most of the items
        kept = found.join(broken.join(ranges, "file").select("file", "start"), ["file", "start"], "left_anti")
    return kept.select("file", "place", "value"), broken
