"""Score tables: statement verdicts, weighted quality scores, process scores, leaderboards.

All of it is partial aggregation plus equi-joins on (query, model, dimension) keys; no window runs
over input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.numbering import with_group_values
from gradeloom.functions.text import let, snake_name, trim_blank

# The dimensions every report is scored on, and those of a research trace.
FIXED_DIMENSIONS = ["coverage", "insight", "instruction_following", "clarity"]
INTRINSIC_DIMENSIONS = [
    "search_breadth", "analytical_depth", "progressive_refinement", "critical_thinking", "efficiency",
]
ALIGNMENT_DIMENSIONS = ["findings_to_report", "report_to_process", "contradiction"]


# ---- fact checking -------------------------------------------------------------------------


def verdict_counts(statements: DataFrame, *keys: str) -> DataFrame:
    """Right / wrong / conflict / unknown per key; unknown is whatever the first three are not."""
    v = trim_blank(F.col("verification"))
    out = statements.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(v == "Right").alias("right"),
        F.count_if(v == "Wrong").alias("wrong"),
        F.count_if(v == "Conflict").alias("conflict"),
    )
    return out.withColumn("unknown", F.expr("total - right - wrong - conflict"))


def right_ratio_micro(counts: DataFrame) -> DataFrame:
    """Right statements over all statements, per model; models without statements are absent."""
    return (
        counts.groupBy("model")
        .agg(F.sum("right").alias("right"), F.sum("total").alias("total"))
        .where("total > 0")
        .withColumn("right_ratio", F.col("right") / F.col("total"))
    )


def right_ratio_macro(counts: DataFrame) -> DataFrame:
    """Mean over tasks of the task's own ratio; tasks without statements do not count."""
    return (
        counts.where("total > 0")
        .groupBy("model")
        .agg(F.count("*").alias("tasks"), F.avg(F.col("right") / F.col("total")).alias("right_ratio"))
    )


def total_of_counts(cells: DataFrame) -> DataFrame:
    """Adds the total to a table of the four verdict counts."""
    return cells.withColumn("total", F.expr("right + wrong + conflict + unknown"))


# ---- weights and criteria ------------------------------------------------------------------


def normalize_weights(df: DataFrame, keys: list[str], weight: str, out: str = "norm_weight") -> DataFrame:
    """weight / sum of the group's weights; a group that sums to zero or less keeps its weights."""
    summed = with_group_values(df, keys, __sum=F.sum(weight))
    share = F.when(F.col("__sum") > 0, F.col(weight) / F.col("__sum")).otherwise(F.col(weight))
    return summed.withColumn(out, share).drop("__sum")


def normalize_dimension(df: DataFrame, keys: list[str], name: str, pos: str, value: str) -> DataFrame:
    """Dimension names in snake case; where two names of a group collide, the later one wins."""
    return (
        df.groupBy(*keys, snake_name(F.col(name)).alias("dimension"))
        .agg(F.max_by(value, pos).alias(value))
    )


def default_weights(queries: DataFrame, weights: DataFrame, extras: DataFrame) -> DataFrame:
    """Given weights, and for queries without any an equal share for each fixed and extra dimension."""
    missing = queries.select("query_id").join(weights, "query_id", "left_anti")
    n_extra = extras.groupBy("query_id").agg(F.count("*").alias("__n"))
    share = (
        missing.join(n_extra, "query_id", "left")
        .select("query_id", (F.lit(1.0).cast("double") / (F.lit(len(FIXED_DIMENSIONS)) + F.coalesce("__n", F.lit(0)))).alias("weight"))
    )
    fixed = share.select("query_id", F.explode(F.array(*map(F.lit, FIXED_DIMENSIONS))).alias("dimension"), "weight")
    extra = share.join(extras.select("query_id", snake_name(F.col("dimension")).alias("dimension")), "query_id").select(
        "query_id", "dimension", "weight")
    return weights.select("query_id", "dimension", "weight").unionByName(fixed).unionByName(extra)


def default_criteria(dimensions: DataFrame, criteria: DataFrame) -> DataFrame:
    """Given criteria, and three general ones for every (query, dimension) that has none."""
    # Label and weight of the three stand-in criteria.
    stand_ins = [("Core quality of ", 0.5), ("Depth and specificity of ", 0.3), ("Relevance and task-alignment of ", 0.2)]
    rows = F.array(*[
        F.struct(F.concat(F.lit(label), F.col("dimension")).alias("criterion"), F.lit(w).cast("double").alias("weight"))
        for label, w in stand_ins
    ])
    filled = (
        dimensions.select("query_id", "dimension").distinct()
        .join(criteria.select("query_id", "dimension"), ["query_id", "dimension"], "left_anti")
        .select("query_id", "dimension", F.inline(rows))
    )
    return criteria.select("query_id", "dimension", "criterion", "weight").unionByName(filled)


def reuse_criteria(reports: DataFrame, criteria: DataFrame) -> DataFrame:
    """Reports paired with the criteria of an earlier run; reports whose query has none drop out."""
    return reports.join(criteria, "query_id")


def without_criteria(reports: DataFrame, criteria: DataFrame) -> DataFrame:
    """The queries that `reuse_criteria` leaves out."""
    return reports.select("query_id").distinct().join(criteria, "query_id", "left_anti")


def join_criterion_scores(criteria: DataFrame, replies: DataFrame) -> DataFrame:
    """Scores matched to criteria by text. The last of several scores for one criterion counts, and a
    dimension with any criterion unscored is dropped as failed."""
    unit = ["query_id", "model", "dimension"]
    last = (
        replies.groupBy(*unit, "criterion").agg(F.max_by("score", "pos").alias("score"))
        .where(F.col("score").isNotNull())
    )
    wanted = with_group_values(criteria, ["query_id", "dimension"], n_criteria=F.count("*"))
    matched = last.join(wanted, ["query_id", "dimension", "criterion"])
    complete = (
        matched.groupBy(*unit).agg(F.count("*").alias("__n"), F.max("n_criteria").alias("__all"))
        .where("__n = __all").select(*unit)
    )
    return matched.join(complete, unit, "left_semi").select(*unit, "criterion", "weight", "score")


def complete_dimension_score(criteria: DataFrame, replies: DataFrame) -> DataFrame:
    """`join_criterion_scores` and `dimension_score` in one: only the sums per (query, model,
    dimension) are kept, so completeness is a count in the same aggregation."""
    unit = ["query_id", "model", "dimension"]
    last = replies.groupBy(*unit, "criterion").agg(F.max_by("score", "pos").alias("score"))
    wanted = with_group_values(criteria, ["query_id", "dimension"], n_criteria=F.count("*"))
    sums = last.join(wanted, ["query_id", "dimension", "criterion"]).groupBy(*unit).agg(
        F.count("score").alias("__n"), F.max("n_criteria").alias("__all"),
        F.sum(F.col("score") * F.col("weight")).alias("__sw"), F.sum("weight").alias("__w"))
    ratio = F.when((F.col("__n") == F.col("__all")) & (F.col("__w") > 0), F.col("__sw") / F.col("__w"))
    return sums.select(*unit, ratio.alias("dimension_score"))


# ---- quality scores ------------------------------------------------------------------------


def dimension_score(scored: DataFrame) -> DataFrame:
    """Weighted mean per (query, model, dimension); null where nothing was scored or weights sum to 0."""
    w = F.when(F.col("score").isNotNull(), F.col("weight"))
    sums = scored.groupBy("query_id", "model", "dimension").agg(
        F.sum(F.col("score") * w).alias("__sw"), F.sum(w).alias("__w"))
    ratio = F.when(F.col("__w") > 0, F.col("__sw") / F.col("__w"))
    return sums.select("query_id", "model", "dimension", ratio.alias("dimension_score"))


def total_score(dims: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted total per (query, model) over the dimensions that have a score, their weights
    rescaled to 1. A dimension without weight counts 0; without any usable weight the total is 0."""
    w = F.coalesce(F.col("weight"), F.lit(0.0).cast("double"))
    live = F.col("dimension_score").isNotNull()
    sums = (
        dims.join(weights.select("query_id", "dimension", "weight"), ["query_id", "dimension"], "left")
        .groupBy("query_id", "model")
        .agg(F.sum(F.when(live, w * F.col("dimension_score"))).alias("__sw"), F.sum(F.when(live, w)).alias("__w"))
    )
    ratio = F.when(F.col("__w") > 0, F.col("__sw") / F.col("__w"))
    return sums.select("query_id", "model", F.coalesce(ratio, F.lit(0.0).cast("double")).alias("total_score"))


def quality_means(totals: DataFrame) -> DataFrame:
    """Mean total and number of entries per model, over entries with a total above zero."""
    good = F.when(F.col("total_score") > 0, F.col("total_score"))
    return totals.groupBy("model").agg(
        F.coalesce(F.avg(good), F.lit(0.0).cast("double")).alias("average_total_score"),
        F.count(good).alias("total_queries"),
    )


def dimension_means(totals: DataFrame, dims: DataFrame) -> DataFrame:
    """Mean per model and dimension over the same entries, failed dimensions ignored."""
    valid = totals.where("total_score > 0").select("query_id", "model")
    return (
        dims.join(valid, ["query_id", "model"], "left_semi")
        .groupBy("model", "dimension")
        .agg(F.coalesce(F.avg("dimension_score"), F.lit(0.0).cast("double")).alias("dimension_average"))
    )


def quality_summary(totals: DataFrame, dims: DataFrame) -> DataFrame:
    """One row per model and dimension with the model's mean total and entry count."""
    return quality_means(totals).join(dimension_means(totals, dims), "model", "left")


def query_spec_score(dims: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the query's own (non-fixed) dimensions, per entry."""
    own = dims.where(~F.col("dimension").isin(FIXED_DIMENSIONS) & F.col("dimension_score").isNotNull())
    w = F.coalesce(F.col("weight"), F.lit(0.0).cast("double"))
    return (
        own.join(weights.select("query_id", "dimension", "weight"), ["query_id", "dimension"], "left")
        .groupBy("query_id", "model")
        .agg(F.sum(w * F.col("dimension_score")).alias("__sw"), F.sum(w).alias("__w"))
        .select("query_id", "model", F.when(F.col("__w") > 0, F.col("__sw") / F.col("__w")).alias("query_spec"))
    )


def meta_average(means: DataFrame) -> DataFrame:
    """The printed variant: plain mean of a model's non-fixed dimension means, 0 if it has none."""
    own = F.when(~F.col("dimension").isin(FIXED_DIMENSIONS), F.col("dimension_average"))
    return means.groupBy("model").agg(F.coalesce(F.avg(own), F.lit(0.0).cast("double")).alias("meta_avg"))


def ranked(df: DataFrame, score: Column, tie: str = "model") -> DataFrame:
    """Rank of a leaderboard: its rows are one per model, so the unpartitioned window stays tiny."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(score.desc(), F.col(tie))).cast("bigint"))


def leaderboard_quality(means: DataFrame) -> DataFrame:
    return ranked(means, F.col("average_total_score"))


# ---- process scores ------------------------------------------------------------------------


def score_gate(replies: DataFrame, dimensions: list[str]) -> DataFrame:
    """Scores of one judge family. An entry counts only if every dimension is an object with a
    `score` key; the score itself may still be null."""
    parsed = F.from_json("reply", ", ".join(f"{d} map<string,string>" for d in dimensions))

    def scores(r):
        complete = F.lit(True)
        for d in dimensions:
            complete = complete & F.coalesce(F.map_contains_key(r[d], "score"), F.lit(False))
        return F.when(complete, F.array(*[
            F.struct(F.lit(d).alias("dimension"), r[d]["score"].try_cast("double").alias("score")) for d in dimensions]))

    kept = [c for c in replies.columns if c != "reply"]
    # one parse per reply: a filter on the parsed columns would repeat it for every dimension
    return replies.select(*kept, F.inline(let(parsed, scores)))


def process_summary(scores: DataFrame) -> DataFrame:
    """Mean and count per model for all eight dimensions, with zero counts where nothing was scored."""
    pairs = [("intrinsic", d) for d in INTRINSIC_DIMENSIONS] + [("alignment", d) for d in ALIGNMENT_DIMENSIONS]
    of = lambda d: F.when(F.col("dimension") == d, F.col("score"))
    wide = scores.groupBy("model").agg(
        *[F.avg(of(d)).alias(f"avg_{d}") for _, d in pairs], *[F.count(of(d)).alias(f"n_{d}") for _, d in pairs])
    return wide.select("model", F.inline(F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(d).alias("dimension"), F.col(f"avg_{d}").alias("avg"), F.col(f"n_{d}").alias("count"))
        for f, d in pairs])))


def process_overall(summary: DataFrame) -> DataFrame:
    """Family means are means of the unrounded dimension means; the overall is their mean, or the one
    family that has scores."""
    out = summary.groupBy("model").agg(
        F.avg(F.when(F.col("family") == "intrinsic", F.col("avg"))).alias("intrinsic_avg"),
        F.avg(F.when(F.col("family") == "alignment", F.col("avg"))).alias("alignment_avg"))
    both = (F.col("intrinsic_avg") + F.col("alignment_avg")) / 2
    return out.withColumn("overall_avg", F.coalesce(both, F.col("intrinsic_avg"), F.col("alignment_avg")))


def leaderboard_process(overall: DataFrame) -> DataFrame:
    return ranked(overall, F.coalesce("overall_avg", F.lit(0.0).cast("double")))


# ---- comparisons ---------------------------------------------------------------------------


def compare_strategies(scores: DataFrame, strategies: list[str]) -> DataFrame:
    """Score by entry and dimension, one column per strategy."""
    return scores.groupBy("model", "entry_id", "dimension").pivot("strategy", strategies).agg(F.max("score"))


def strategy_means(scores: DataFrame) -> DataFrame:
    """Mean and count per strategy and dimension, with the strategy's mean of dimension means."""
    per_dim = scores.groupBy("strategy", "dimension").agg(F.avg("score").alias("avg"), F.count("score").alias("n"))
    overall = per_dim.groupBy("strategy").agg(F.avg("avg").alias("overall"))
    return per_dim.join(overall, "strategy")


def compression_ratio(lengths: DataFrame, strategies: list[str]) -> DataFrame:
    """Kept over raw length per entry and strategy; the raw length is that of the first strategy."""
    wide = lengths.groupBy("model", "entry_id").agg(
        F.max(F.when(F.col("strategy") == strategies[0], F.col("raw_len"))).alias("raw_len"),
        *[F.max(F.when(F.col("strategy") == s, F.col("kept_len"))).alias(f"__{s}") for s in strategies])
    return wide.select("model", "entry_id", F.coalesce("raw_len", F.lit(0)).alias("raw_len"), *[
        F.when(F.col("raw_len") > 0, F.coalesce(F.col(f"__{s}"), F.lit(0)) / F.col("raw_len"))
        .otherwise(F.lit(0.0).cast("double")).alias(f"ratio_{s}") for s in strategies])


def compare_judges(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Mean of second minus first per dimension, over entries scored by both."""
    pair = scores.groupBy("model", "entry_id", "dimension").agg(
        F.max(F.when(F.col("strategy") == first, F.col("score"))).alias("a"),
        F.max(F.when(F.col("strategy") == second, F.col("score"))).alias("b"))
    return pair.where("a IS NOT NULL AND b IS NOT NULL").groupBy("dimension").agg(
        F.avg(F.col("b") - F.col("a")).alias("mean_diff"), F.count("*").alias("n"))


def source_strategy_means(scores: DataFrame) -> DataFrame:
    """Per source model and strategy: the mean of each entry's own family means."""
    entry = scores.groupBy("model", "strategy", "entry_id", "family").agg(F.avg("score").alias("m"))
    return entry.groupBy("model", "strategy").agg(
        F.avg(F.when(F.col("family") == "intrinsic", F.col("m"))).alias("intrinsic"),
        F.avg(F.when(F.col("family") == "alignment", F.col("m"))).alias("alignment"))


def phase_join(entries: DataFrame, structured: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries with their structured trace: this run's, or else the cached one. The rest is skipped."""
    return (
        entries.join(structured.select("entry_key", F.col("structured").alias("__now")), "entry_key", "left")
        .join(cache.select("entry_key", F.col("structured").alias("__old")), "entry_key", "left")
        .withColumn("structured", F.coalesce("__now", "__old"))
        .where(F.col("structured").isNotNull())
        .drop("__now", "__old")
    )


def phase_skipped(entries: DataFrame, structured: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries that `phase_join` leaves out."""
    known = structured.where("structured IS NOT NULL").select("entry_key").unionByName(
        cache.where("structured IS NOT NULL").select("entry_key"))
    return entries.join(known, "entry_key", "left_anti")
