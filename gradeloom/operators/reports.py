"""Reports and judge replies: segments, truncation, JSON in free text, structured traces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradeloom.functions.jsontext import has_keys, strict_json
from gradeloom.functions.text import let, trim_blank

# Report budget and the note that replaces the rest.
REPORT_CHARS = 30_000
REPORT_CUT = "\n\n[... report truncated ...]"

# Where replies hold JSON. Patterns with the group that is the value, and for `quality` the order of trying.
TAGGED = (r"(?s)<json_output>\s*(.*?)\s*</json_output>", 1)
FENCED_IN_TASKS = (r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
FENCED_IN_PROCESS = (r"(?s)```(?:json)?\s*\n(.*?)\n```", 1)
IN_QUALITY = [
    (r"(?s)```json\s*(.*?)\s*```", 1),
    (r"(?s)```\s*(.*?)\s*```", 1),
    (r"(?s)<json_output>\s*(.*?)\s*</json_output>", 1),
    (r"(?s)\[.*?\]", 0),
    (r"(?s)\{.*?\}", 0),
]


def truncate_report(report: Column, max_chars: int = REPORT_CHARS) -> Column:
    return F.when(F.length(report) > max_chars, F.concat(F.substring(report, 1, max_chars), F.lit(REPORT_CUT))).otherwise(report)


def segments(report: Column) -> Column:
    """Logical parts of a report: one per paragraph, headings kept with the text after them. The parts
    put together are the report again.

    Paragraphs are matched with the border that ends them. A part ends at each paragraph that is no
    heading, so it is the slice between two such places, and the work is linear in the report.
    """
    paragraphs = F.regexp_extract_all(report, F.lit(r"(?s).*?\n\s*\n|.+"), 0)

    def parts(p: Column, ends: Column) -> Column:
        def upto(end: Column, k: Column) -> Column:
            start = F.when(k > 0, F.get(ends, k - 1) + 1).otherwise(0)
            return F.array_join(F.slice(p, start + 1, end - start + 1), "")

        last = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(-1))
        closed = F.transform(ends, upto)
        rest = F.array_join(F.slice(p, last + 2, F.size(p)), "")
        return F.when(last + 1 < F.size(p), F.array_append(closed, rest)).otherwise(closed)

    def place(x: Column, i: Column) -> Column:
        return F.when(~x.rlike(r"^ {0,3}#{1,6} [^\n]*\s*$"), i)

    return let(paragraphs, lambda p: let(
        F.filter(F.transform(p, place), lambda i: i.isNotNull()), lambda ends: parts(p, ends)))


def segment_reports(reports: DataFrame, *keys: str) -> DataFrame:
    return reports.select(*keys, F.posexplode(segments(F.col("report"))).alias("idx", "segment"))


# ---- JSON in replies -----------------------------------------------------------------------


def _first_valid(*candidates: Column) -> Column:
    return F.coalesce(*[F.when(strict_json(c).isNotNull(), c) for c in candidates])


def _between(text: Column, opened: str, closed: str) -> Column:
    """From the first opening to the last closing character, null without both in that order."""
    start = F.locate(opened, text)
    end = F.length(text) - F.length(F.substring_index(text, closed, -1))
    found = text.contains(opened) & text.contains(closed) & (end >= start)
    return F.when(found, F.substring(text, start, end - start + 1))


@F.pandas_udf(T.StringType())
def _balanced_block(texts: pd.Series) -> pd.Series:
    """First balanced {...}, else first balanced [...], braces in strings counted like any other."""

    def block(text, opened, closed):
        start, depth = text.find(opened), 0
        for at in range(start, len(text)) if start >= 0 else ():
            depth += (text[at] == opened) - (text[at] == closed)
            if depth == 0:
                return text[start:at + 1]
        return None

    def find(text):
        import json

        for pair in ("{}", "[]"):
            got = block(text, *pair)
            try:
                json.loads(got or "")
                return got
            except ValueError:
                pass
        return None

    return texts.map(find, na_action="ignore")


def extract_json(df: DataFrame, text: str, mode: str, out: str = "json") -> DataFrame:
    """First readable JSON value in a reply, as text; null if there is none.

    process  whole text, fenced block, <json_output>, first balanced block
    tasks    fenced block, first { to last }, first [ to last ]
    quality  <json_output>, fenced blocks, then the first readable [...] or {...} without nesting
    """
    t = F.col(text)
    tag = F.regexp_extract(t, *TAGGED)
    if mode == "tasks":
        return df.withColumn(out, _first_valid(F.regexp_extract(t, *FENCED_IN_TASKS), _between(t, "{", "}"), _between(t, "[", "]")))
    if mode == "quality":
        # the first readable match of each pattern
        hits = [F.try_element_at(F.filter(F.regexp_extract_all(t, F.lit(p), g), lambda m: strict_json(m).isNotNull()), F.lit(1)) for p, g in IN_QUALITY]
        return df.withColumn(out, trim_blank(F.coalesce(_first_valid(tag), *hits)))
    fence = F.regexp_extract(t, *FENCED_IN_PROCESS)
    easy = df.withColumn("__easy", _first_valid(t, fence, tag))
    # the Python function sees only what the patterns left over
    rest = _balanced_block(F.when(F.col("__easy").isNull(), t))
    return easy.withColumn(out, F.coalesce(F.col("__easy"), rest)).drop("__easy")


def verdict_block(text: Column) -> Column:
    """Text from the first { to the last }, which a code fence around it does not change; null without
    braces."""
    return _between(text, "{", "}")


def _mend(text: str) -> str | None:
    """Reads broken JSON: open strings and brackets are closed, what follows the first complete value
    is cut, trailing commas and Python words are accepted. Null if that is not enough."""
    import json
    import re

    start = re.search(r"[{\[]", text or "")
    if not start:
        return None
    out, closers, quoted, skip = [], [], False, False
    body = text[start.start():].rstrip()
    for at, ch in enumerate(body):
        out.append(ch)
        if quoted:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                # a quote ends the string only where JSON could go on
                after = body[at + 1:].lstrip()
                if after == "" or after[0] in ",:}]":
                    quoted = False
                else:
                    out[-1] = '\\"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            closers.append("}" if ch == "{" else "]")
        elif closers and ch == closers[-1]:
            closers.pop()
            if not closers:
                break
    if quoted:
        # brackets swallowed by the open string go back behind its new quote
        tail = []
        while closers and out and (out[-1] == closers[0] or out[-1].isspace()) and len(tail) < len(closers):
            last = out.pop()
            if not last.isspace():
                tail.append(last)
        out.append('"')
    whole = "".join(out) + "".join(reversed(closers))
    words = {"None": "null", "True": "true", "False": "false"}
    relaxed = re.sub(r'("(?:[^"\\]|\\.)*")|\b(None|True|False)\b|,(?=\s*[}\]])',
                     lambda m: m.group(1) or words.get(m.group(2) or "", ""), whole)
    for candidate in (whole, relaxed, relaxed.replace("'", '"')):
        try:
            return json.dumps(json.loads(candidate, strict=False), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def _mended(texts: pd.Series) -> pd.Series:
    return texts.map(_mend, na_action="ignore")


def repair_json(df: DataFrame, text: str, out: str = "json") -> DataFrame:
    """Strict JSON passes through; only what is left reaches the Python function, the other rows hand
    it a null. `repaired` tells which rows were mended."""
    return (
        df.withColumn("__good", F.coalesce(strict_json(F.col(text)).isNotNull(), F.lit(False)))
        .withColumn("__fixed", _mended(F.when(~F.col("__good"), F.col(text))))
        .withColumn(out, F.when(F.col("__good"), F.col(text)).otherwise(F.col("__fixed")))
        .withColumn("repaired", ~F.col("__good") & F.col("__fixed").isNotNull())
        .drop("__good", "__fixed")
    )


VERDICT_NAMES = ["statement", "verification", "evidence", "reasoning"]
VERDICT_FIELDS = "statement string, verification string, evidence array<struct<source:string,excerpt:string>>, reasoning string"
VERDICT = "struct<statement:string,verification:string,evidence:array<struct<source:string,excerpt:string>>,reasoning:string>"


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Statements of the readable chunks. A payload with a list `core_state` gives its items, any
    other object is one statement. Columns (chunk_idx, pos) carry the order."""
    def statements(j):
        parsed = F.from_json(j, f"core_state array<{VERDICT}>, {VERDICT_FIELDS}")
        listed = let(parsed, lambda o: F.coalesce(o["core_state"], F.array(F.struct(*[o[n].alias(n) for n in VERDICT_NAMES]))))
        return F.when(F.json_object_keys(j).isNotNull(), listed)

    # unreadable payloads give no rows inside the explode: as a filter the parse would run twice
    return (
        chunks.where("ok")
        .select("task_id", "chunk_idx", F.posexplode(let(F.col("json"), statements)).alias("pos", "s"))
        .select("task_id", "chunk_idx", "pos", "s.*")
    )


def dropped_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks per task that failed or could not be read, and so leave the denominator."""
    lost = ~F.col("ok") | F.col("json").isNull()
    return chunks.groupBy("task_id").agg(F.count("*").alias("chunks"), F.count_if(lost).alias("dropped_chunks"))


# ---- structured traces ---------------------------------------------------------------------

STRUCTURED = (
    "steps array<struct<step_id:int,action_type:string,summary:string,key_findings:array<string>>>,"
    "global_findings array<struct<finding:string,first_found_at_step:int,related_steps:array<int>,evidence_strength:string>>"
)


def structure_gate(df: DataFrame, text: str = "structured") -> DataFrame:
    """Structured traces that have both `steps` and `global_findings`."""
    return df.where(has_keys(F.col(text), "steps", "global_findings"))


def finding_counts(structured: DataFrame, *keys: str) -> DataFrame:
    """Number of steps and of global findings per entry."""
    s = F.from_json("structured", STRUCTURED)
    n = lambda f: F.greatest(F.size(s[f]), F.lit(0))
    return structured.select(*keys, n("steps").alias("num_steps"), n("global_findings").alias("num_global_findings"))


def action_counts(structured: DataFrame) -> DataFrame:
    """Steps by action type and findings by strength of evidence, over all entries."""
    s = F.from_json("structured", STRUCTURED)
    kinds = F.concat(
        F.transform(s["steps"], lambda x: F.struct(F.lit("action_type").alias("field"), x["action_type"].alias("value"))),
        F.transform(s["global_findings"], lambda x: F.struct(F.lit("evidence_strength").alias("field"), x["evidence_strength"].alias("value"))))
    return structured.select(F.inline(kinds)).groupBy("field", "value").agg(F.count("*").alias("n"))
