"""Loaders of result files and task lists.

Every loader reads with a fixed schema (no inference pass), takes names from the file path, and
leaves the rest to the scan: files are the unit of parallelism, lines too where the format has them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.functions.jsontext import is_json
from gradeloom.functions.numbering import first_rows
from gradeloom.functions.text import first_present, let, present
from gradeloom.sources.arrays import read_array_items

# Default patterns: file name without extension, and the folder it lies in.
STEM = r"([^/]+?)(?:\.[^./]*)?$"
FOLDER = r"([^/]+)/[^/]+$"

ENTRY = (
    "id string, chat_id string, query string, rewritten_query string, response string, process string, "
    "files array<struct<filename:string,type:string,dir:string,size:string>>, "
    "annotation struct<category:string,language:string,origin_id:string,pattern:string,domain:string,topic:string,persona:string>, "
    "_corrupt_record string"
)
TASK = "task_id string, task_question string, ground_truth string, file_path string, metadata map<string,string>"


def from_path(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def query_text(rewritten_first: bool = True) -> Column:
    """The question of an entry. Fact checking and quality scoring prefer the rewritten one and pass
    over empty texts; process scoring takes `query` whenever it is there, even empty."""
    if rewritten_first:
        return first_present(F.col("rewritten_query"), F.col("query"))
    return F.coalesce("query", "rewritten_query")


def read_entries(spark: SparkSession, path: str | list[str], stem: str = STEM, range_bytes: int | None = None,
                 suffix: str = ".json") -> DataFrame:
    """All entries of JSON-array files, with the file's stem. Files are read whole, each by one task; with `range_bytes` in
    ranges of that size (see `sources.arrays`; one path, in a store that tasks can open), which files of many gigabytes
    need."""
    if range_bytes:
        items, broken = read_array_items(spark, path, suffix, range_bytes)
        fields = ENTRY.removesuffix(", _corrupt_record string")
        read = items.select(F.from_json("value", fields).alias("e"), "file").select("e.*", F.lit(None).cast("string").alias("_corrupt_record"), "file")
        lost = broken.select(*[F.lit(None).cast(t.dataType).alias(t.name) for t in read.schema.fields[:-2]], F.lit("").alias("_corrupt_record"), "file")
        return read.unionByName(lost).withColumn("stem", F.regexp_extract("file", stem, 1)).drop("file")
    rows = spark.read.schema(ENTRY).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("stem", from_path(stem))


def load_entries_array(spark: SparkSession, path: str | list[str], stem: str = STEM, range_bytes: int | None = None,
                       suffix: str = ".json") -> DataFrame:
    """Tasks of JSON-array files: id 'stem/id', the response as text to check. Entries without
    response are left out; an empty file list is null. `range_bytes`: see `read_entries`."""
    e = read_entries(spark, path, stem, range_bytes, suffix)
    return e.where(F.coalesce("response", F.lit("")) != "").select(
        F.concat_ws("/", "stem", F.coalesce("id", F.lit(""))).alias("task_id"),
        F.col("response").alias("task_question"),
        F.lit("").alias("ground_truth"),
        F.when(F.size("files") > 0, F.col("files")).alias("files"),
        F.coalesce(query_text(), F.lit("")).alias("user_query"),
        F.col("stem").alias("model"), "id", "annotation")


def unreadable_files(spark: SparkSession, path: str | list[str], stem: str = STEM) -> DataFrame:
    """Stems of files that are no JSON array of entries."""
    return read_entries(spark, path, stem).where("_corrupt_record IS NOT NULL AND response IS NULL").select("stem").distinct()


def _task_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "")
    return lines.withColumn("__ok", is_json(F.col("value"))).withColumn("t", F.from_json("value", TASK))


def load_tasks_jsonl(spark: SparkSession, path: str | list[str], on_bad: str = "skip") -> DataFrame:
    """Tasks from JSON lines. Blank lines are skipped; unreadable ones are skipped too, or fail the
    job with on_bad='fail'. A single file path becomes a list of one."""
    lines = _task_lines(spark, path)
    if on_bad == "fail":
        checked = F.when(F.col("__ok"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("unreadable task line: "), F.substring("value", 1, 200))).cast("boolean"))
        lines = lines.where(checked)
    else:
        lines = lines.where("__ok")
    paths = F.when(F.col("t.file_path").startswith("["), F.from_json("t.file_path", "array<string>")).otherwise(
        F.array(F.col("t.file_path")))
    return lines.select(
        "t.task_id", "t.task_question", F.coalesce("t.ground_truth", F.lit("")).alias("ground_truth"),
        F.when(F.col("t.file_path").isNotNull(), paths).alias("file_path"), "t.metadata")


def rejected_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines `load_tasks_jsonl` skips."""
    return _task_lines(spark, path).where("NOT __ok").select("value")


def load_tasks_dir(spark: SparkSession, path: str | list[str], folder: str = FOLDER, stem: str = STEM) -> DataFrame:
    """Tasks from one-object files below model folders. Three shapes, by the keys present: a filled
    list `entries`, else query + response, else user_query + response; items without either text are
    left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        from_path(folder).alias("model"), from_path(stem).alias("stem"), F.from_json("value", "map<string,string>").alias("m"))

    def task(m, entry):
        has = lambda *keys: F.map_contains_key(m, keys[0]) & F.map_contains_key(m, keys[1])
        extra = lambda k: F.when(entry.isNotNull(), m[k]).alias(k)
        flat, named = has("query", "response"), has("user_query", "response")
        question = F.when(entry.isNotNull(), entry["query"]).when(flat, m["query"]).when(named, m["user_query"])
        answer = F.when(entry.isNotNull(), entry["response"]).when(flat | named, m["response"])
        row = F.struct(
            answer.alias("task_question"), question.alias("user_query"),
            first_present(m["file_path"], m["file_paths"], m["attachments"]).alias("file_path"), *map(extra, ("query_id", "topic", "language")))
        return F.when((F.coalesce(question, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != ""), F.array(row))

    # no row or one per file, decided where the text is parsed
    first = lambda m: F.try_element_at(F.from_json(m["entries"], "array<struct<query:string,response:string>>"), F.lit(1))
    rows = let(F.col("m"), lambda m: let(first(m), lambda e: task(m, e)))
    return files.select(F.concat_ws("/", present(F.col("model")), "stem").alias("task_id"), "model", F.inline(rows))


def choose_files(spark: SparkSession, path: str, models: list[str], kind: str, stem: str = STEM, glob: str = "*.json") -> DataFrame:
    """One result file per model: the first by name among those named '{model}_{kind}...', else among
    '{model}_...'; of equal names in several folders the first path. Only files that `glob` fits count, and
    only names are read (the content column is pruned)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
        .select(F.col("_metadata.file_path").alias("file_path"), "path", F.regexp_extract("path", stem, 1).alias("stem"))
    )
    fits = F.filter(F.array(*map(F.lit, models)), lambda m: F.col("stem").startswith(F.concat(m, F.lit("_"))))
    ranked = files.withColumn("model", F.explode(fits)).withColumn(
        "prio", F.when(F.col("stem").startswith(F.concat("model", F.lit(f"_{kind}"))), 0).otherwise(1))
    best = ranked.groupBy("model").agg(F.min(F.struct("prio", "stem", "path", "file_path")).alias("b"))
    return best.select("model", "b.stem", "b.path", "b.file_path")


def load_results_glob(spark: SparkSession, path: str, models: list[str], kind: str = "text", stem: str = STEM, glob: str = "*.json") -> DataFrame:
    """Entries of the chosen file of each model. The choice, one path per model, is made from names; only these files are
    read."""
    chosen = choose_files(spark, path, models, kind, stem, glob)
    picked = chosen.select("model", "path").collect()
    if not picked:
        return spark.createDataFrame([], ENTRY).withColumn("stem", F.lit("")).withColumn("model", F.lit(""))
    rows = (
        spark.read.schema(ENTRY).option("multiLine", True).json([_literal(r.path) for r in picked])
        .withColumn("stem", from_path(stem)).withColumn("__file", F.col("_metadata.file_path"))
    )
    return rows.join(chosen.select("model", F.col("file_path").alias("__file")), "__file").drop("__file")


def _literal(path: str) -> str:
    """A path in which no character is a wildcard."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def explode_cells(lines: DataFrame, scores: str) -> DataFrame:
    """(task, model, scores) rows of texts `value` that hold nested task -> model -> scores maps; null
    cells were not evaluated. The parse stands inside the explode, which evaluates it once."""
    tasks = F.from_json("value", f"map<string,map<string,struct<{scores}>>>")
    return (
        lines.select(F.explode(tasks).alias("task_id", "by_model"))
        .select("task_id", F.explode("by_model").alias("model", "cell"))
        .where("cell IS NOT NULL")
        .select("task_id", "model", "cell.*")
    )


# The fields of the three kinds of published score cells.
CELL_FIELDS = {
    "factuality": "right:int,wrong:int,conflict:int,unknown:int",
    "report": "coverage:double,insight:double,instruction_following:double,clarity:double,query_spec:double,total_weighted_score:double",
    "process": "intrinsic:map<string,int>,alignment:map<string,int>,_overall_from_per_task:double",
}


def load_score_cells(spark: SparkSession, path: str | list[str], kind: str = "factuality", whole_files: bool = True) -> DataFrame:
    """Score cells of JSON files; with whole_files=False each line is a map of its own, which lets
    large files split."""
    return explode_cells(spark.read.text(path, wholetext=whole_files, recursiveFileLookup=True), CELL_FIELDS[kind])


def ground_truth_coalesce(reference: Column, truth: Column) -> Column:
    """The reference answer, else the ground truth, else ''; empty counts as absent."""
    return F.coalesce(present(reference), present(truth), F.lit(""))


def split_entries(entries: DataFrame, existing: DataFrame, category: str | None = None, first: int | None = None) -> DataFrame:
    """Entries still to be written out: of one category if given, the first n in file order, without
    those that exist already. `entries` has id, pos and category."""
    picked = entries if category is None else entries.where(F.col("category") == category)
    if first is not None:
        picked = first_rows(picked, ["pos", "id"], first)
    return picked.join(existing.select("id"), "id", "left_anti")
