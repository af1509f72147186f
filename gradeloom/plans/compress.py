"""Traces shortened by a scorer: packed into chunks, each chunk put to the scorer, the replies rejoined in order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.text import trim_blank
from gradeloom.operators.judging import Scorer, ask_all
from gradeloom.operators.traces import CHUNK_CHARS, pack_chunks
from gradeloom.session import cut

PROMPT = (
    "Shorten this part ({part} of {parts}) of a research trace. Keep every query, all reasoning, decisions, findings, failures and "
    "checks in their order; leave out page texts, repeats and markup.\nQuestion: {query}\n\n{text}"
)
# What stands between parts, what marks a cut end, and the share of a part that stays if its call fails.
BETWEEN, CUT, FALLBACK = "\n\n---\n\n", "\n\n[... truncated ...]", 5
SHRINK = 0.9      # a trace that keeps more than this share in a round is not asked for again


def _prompt(template: str) -> Column:
    values = {"{part}": (F.col("chunk_no") + 1).cast("string"), "{parts}": F.col("__parts").cast("string"), "{query}": F.col("query"), "{text}": F.col("chunk")}
    return F.concat(*[values.get(p, F.lit(p)) for p in re.split(r"(\{part\}|\{parts\}|\{query\}|\{text\})", template) if p])


def one_round(traces: DataFrame, keys: list[str], scorer: Scorer, chunk_chars: int = CHUNK_CHARS, template: str = PROMPT, **how) -> DataFrame:
    """`traces` (keys, query, process) with `shortened`. Traces up to `chunk_chars` are one chunk; a call that fails leaves the first
    fifth of `chunk_chars` of its chunk. A blank trace gives the empty text without a call."""
    long_ = F.length("process") > chunk_chars
    filled = traces.where(trim_blank(F.col("process")) != "").select(*keys, F.coalesce("query", F.lit("")).alias("query"), "process")
    chunks = pack_chunks(filled.where(long_), *keys, "query", limit=chunk_chars).drop("trace_format").unionByName(
        filled.where(~long_).select(*keys, "query", F.lit(0).alias("chunk_no"), F.col("process").alias("chunk")))
    counted = chunks.join(chunks.groupBy(*keys).agg(F.count("*").alias("__parts")), keys)
    asked = ask_all(counted.withColumn("prompt", _prompt(template)), [*keys, "chunk_no"], "prompt", scorer, **how)
    text = F.coalesce("reply", F.substring("chunk", 1, chunk_chars // FALLBACK))
    # as many texts as the trace has chunks
    joined = asked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_no", text.alias("text")))).alias("parts")).select(
        *keys, F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), BETWEEN).alias("shortened"))
    return traces.join(joined, keys, "left").withColumn("shortened", F.coalesce("shortened", F.lit("")))


def compress_with(traces: DataFrame, keys: list[str], scorer: Scorer, max_chars: int = 30_000, chunk_chars: int = CHUNK_CHARS,
                  rounds: int = 1, template: str = PROMPT, **how) -> DataFrame:
    """(keys, compressed, rounds): traces shortened by the scorer until they have at most `max_chars` characters.

    A trace goes into a further round only while it is too long, has lost a tenth in the last one, and `rounds` allows; so the
    number of rounds is bounded by the logarithm of length over budget as well. What is too long in the end is cut
    there. Each round is kept, so a later one never repeats its calls. `how`: see `ask_all`.
    """
    todo = cut(traces.select(*keys, "query", "process"))
    settled = None
    for n in range(1, rounds + 1):
        after = cut(one_round(todo, keys, scorer, chunk_chars, template, **how).select(*keys, "query", "process", "shortened"))
        again = (F.length("shortened") > max_chars) & (F.length("shortened") <= SHRINK * F.length("process"))
        again = F.coalesce(again, F.lit(False)) if n < rounds else F.lit(False)
        over = F.length("shortened") > max_chars
        ended = after.where(~again).select(*keys, F.when(over, F.concat(F.substring("shortened", 1, max_chars), F.lit(CUT))).otherwise(
            F.col("shortened")).alias("compressed"), F.lit(n).alias("rounds"))
        settled = ended if settled is None else settled.unionByName(ended)
        todo = after.where(again).select(*keys, "query", F.col("shortened").alias("process"))
        if n < rounds and not todo.head(1):
            break
    return settled
