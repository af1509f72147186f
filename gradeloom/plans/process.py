"""Process quality from raw entries, or from judge replies, to the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.functions.text import trim_blank
from gradeloom.operators import scores as S
from gradeloom.operators.judging import Scorer, ask_all
from gradeloom.operators.reports import structure_gate
from gradeloom.operators.traces import compress_trace
from gradeloom.plans.stages import run_stages

KEYS = ["model", "entry_id"]

# The caller may bring its own; {query}, {trace}, {structured} and {report} are filled in.
STRUCTURE = "List the steps and the findings of this trace as JSON with the keys steps and global_findings.\nQuestion: {query}\n\n{trace}"
INTRINSIC = "Score the process by itself, as JSON with one object per dimension.\nQuestion: {query}\n\n{structured}"
ALIGNMENT = "Score how the report fits the process, as JSON with one object per dimension.\nQuestion: {query}\n\n{structured}\n\n{report}"


def process_board(intrinsic: DataFrame, alignment: DataFrame) -> DataFrame:
    """Leaderboard of replies (model, entry_id, reply); an incomplete reply drops its family only."""
    gated = S.score_gate(intrinsic, S.INTRINSIC_DIMENSIONS).withColumn("family", F.lit("intrinsic")).unionByName(
        S.score_gate(alignment, S.ALIGNMENT_DIMENSIONS).withColumn("family", F.lit("alignment")))
    return S.leaderboard_process(S.process_overall(S.process_summary(gated)))


def _filled(template: str, **values) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def process_graph(spark: SparkSession, entries: DataFrame, out: str, structurer: Scorer, judge: Scorer, max_chars: int = 30_000,
                  structure: str = STRUCTURE, intrinsic: str = INTRINSIC, alignment: str = ALIGNMENT, **how) -> dict[str, DataFrame]:
    """All stages from raw entries (model, entry_id, query, process, response) to the board, resumable below `out`.

    compressed: traces under `max_chars`; blank ones are rejected. structured: the structurer's replies; those without steps
    and findings are rejected. intrinsic, alignment: the judge's scores by dimension; incomplete replies are rejected, which
    costs an entry that family only. board: the leaderboard. `how`: see `ask_all`.
    """
    def compressed(done):
        blank = trim_blank(F.coalesce("process", F.lit(""))) == ""
        short = compress_trace(entries.where(~blank), max_chars).select(*KEYS, "query", "response", "trace_format", "compressed")
        return short, entries.where(blank).select(*KEYS)

    def structured(done):
        prompt = _filled(structure, query=F.col("query"), trace=F.col("compressed"))
        asked = ask_all(done["compressed"].select(*KEYS, "query", "response", prompt.alias("prompt")), KEYS, "prompt", structurer, **how)
        told = asked.select(*KEYS, "query", "response", F.col("reply").alias("structured"), "error")
        fine = structure_gate(told.where("structured IS NOT NULL"))
        return fine.drop("error"), told.join(fine.select(*KEYS), KEYS, "left_anti").select(*KEYS, "error")

    def judged(template, dimensions):
        def stage(done):
            prompt = _filled(template, query=F.col("query"), structured=F.col("structured"), report=F.col("response"))
            asked = ask_all(done["structured"].select(*KEYS, prompt.alias("prompt")), KEYS, "prompt", judge, **how)
            scores = S.score_gate(asked.select(*KEYS, "reply"), dimensions)
            return scores, asked.join(scores.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS, "error")
        return stage

    def board(done):
        scores = done["intrinsic"].withColumn("family", F.lit("intrinsic")).unionByName(done["alignment"].withColumn("family", F.lit("alignment")))
        return S.leaderboard_process(S.process_overall(S.process_summary(scores)))

    return run_stages(spark, out, [
        ("compressed", compressed), ("structured", structured), ("intrinsic", judged(intrinsic, S.INTRINSIC_DIMENSIONS)),
        ("alignment", judged(alignment, S.ALIGNMENT_DIMENSIONS)), ("board", board)])
