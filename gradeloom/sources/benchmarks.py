"""Benchmark layouts as one declarative table: where each keeps its id, question and answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.text import first_present
from gradeloom.sources.entries import ground_truth_coalesce

# By layout, the keys of id, question and answer, and keys that are not kept. An id of
# None is the row number; protected sets come in decrypted.
LAYOUTS = {
    "frames": ("Unnamed: 0", "Prompt", "Answer", []),
    "webwalkerqa": (None, "question", "answer", []),
    "gaia": ("task_id", "Question", "Final answer", ["file_path", "file_name"]),
    "gaia-text": ("task_id", "Question", "answer", []),
    "hle": ("id", "question", "answer", ["image", "image_preview", "rationale_image"]),
    "hle-text": ("id", "Question", "answer", []),
    "futurex": ("id", "prompt", None, ["prompt", "id"]),
    "finsearchcomp": ("prompt_id", "prompt", None, ["response_reference", "ground_truth"]),
    "browsecomp": (None, "problem", "answer", ["canary"]),
    "browsecomp-zh": (None, "Question", "Answer", ["canary"]),
    "xbench-ds": ("id", "prompt", "answer", ["canary"]),
}
# Keys that two layouts add to the metadata, the names of their sources, and the only
# keys that the layouts with a closed metadata list keep.
FUTUREX_KEPT = ["level", "end_time"]
XBENCH_KEPT = ["reference_steps"]
SOURCES = {
    "futurex": ("futurex-ai/Futurex-Online", "Futurex-Online"),
    "finsearchcomp": ("ByteSeedXpert/FinSearchComp", "FinSearchComp"),
}


def standardize_benchmark(rows: DataFrame) -> DataFrame:
    """(task_id, task_question, ground_truth, file_path, metadata) of rows (layout, split, row_idx, raw).

    `raw` is the JSON object of one item. All layouts go through one pass: the keys are looked up by
    the row's layout, and the keys not used become metadata.
    """
    names = list(LAYOUTS)

    def per_layout(pick) -> Column:
        chain = None
        for n in names:
            value = pick(n)
            chain = F.when(F.col("layout") == n, value) if chain is None else chain.when(F.col("layout") == n, value)
        return chain

    def key(i):
        return per_layout(lambda n: F.lit(LAYOUTS[n][i]).cast("string"))

    m = F.col("m")
    used = per_layout(lambda n: F.array(*[F.lit(k) for k in (*LAYOUTS[n][:3], *LAYOUTS[n][3]) if k]))
    kept = (
        F.when(F.col("layout") == "futurex", F.map_filter(m, lambda k, v: k.isin(FUTUREX_KEPT)))
        .when(F.col("layout") == "xbench-ds", F.map_filter(m, lambda k, v: k.isin(XBENCH_KEPT)))
        .otherwise(F.map_filter(m, lambda k, v: ~F.array_contains(used, k)))
    )
    none = F.create_map().cast("map<string,string>")

    def added(n):
        source, title = SOURCES[n]
        base = [F.lit("source"), F.lit(source), F.lit("split"), F.col("split"), F.lit("original_id"),
                F.coalesce(m[LAYOUTS[n][0]], F.lit("")), F.lit("dataset_name"), F.lit(title)]
        if n == "finsearchcomp":
            base += [F.lit("response_reference"), F.coalesce(m["response_reference"], F.lit("")),
                     F.lit("ground_truth_finance"), F.coalesce(m["ground_truth"], F.lit(""))]
        if n == "futurex":
            base += [x for k in FUTUREX_KEPT for x in (F.lit(k), F.coalesce(m[k], F.lit("")))]
        return F.create_map(*base).cast("map<string,string>")

    extra = F.when(F.col("layout") == "futurex", added("futurex")).when(
        F.col("layout") == "finsearchcomp", added("finsearchcomp")).otherwise(none)
    number = F.col("row_idx").cast("string")
    made_id = F.when(F.col("layout").isin("futurex", "finsearchcomp"), F.concat_ws("_", "layout", "split", number)).when(
        key(0).isNull(), number).otherwise("")
    truth = (
        F.when(F.col("layout") == "finsearchcomp", ground_truth_coalesce(m["response_reference"], m["ground_truth"]))
        .when(F.col("layout") == "futurex", "")
        .otherwise(F.coalesce(m[key(2)], F.lit("")))
    )
    parsed = rows.withColumn("m", F.from_json("raw", "map<string,string>"))
    return parsed.select(
        "layout", F.coalesce(m[key(0)], made_id).alias("task_id"), F.coalesce(m[key(1)], F.lit("")).alias("task_question"),
        truth.alias("ground_truth"),
        F.when(F.col("layout").isin("gaia", "hle"), first_present(m["file_path"], m["image"])).alias("file_path"),
        F.map_concat(kept, F.map_filter(extra, lambda k, v: ~F.map_contains_key(kept, k))).alias("metadata"))
