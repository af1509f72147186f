"""Message histories: one row per (conversation, turn).

Text rules are row-wise columns. What looks across turns uses per-conversation aggregates joined
back, or a join on (conversation, turn): a conversation that holds a third of all rows is split like
any other key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradeloom.functions.jsontext import is_object, strict_json
from gradeloom.functions.numbering import first_n, last_before, with_group_values
from gradeloom.functions.text import contains_any, let, trim_blank

# Fixed values.
OMITTED = "Tool result is omitted to save tokens."
NO_BOX = "No \\boxed{} content found."
TOOL_TAGS = ["<use_mcp_tool>", "</use_mcp_tool>", "<server_name>", "</server_name>", "<arguments>", "</arguments>"]
REFUSALS = [
    "time constraint", "I'm sorry, but I can't", "I'm sorry, I cannot solve", "I cannot continue", "I'm unable to",
]
UNCOUNTED_SERVERS = ["agent-worker", "skills-worker"]


# ---- text of one message -------------------------------------------------------------------


def strip_think(role: Column, text: Column) -> Column:
    """Assistant text without its think blocks and the blanks after them."""
    return F.when(role == "assistant", F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")).otherwise(text)


def failure_summary(text: Column) -> Column:
    """Text without think blocks, without anything from a tool call on, without empty boxes; if that
    leaves nothing, the last think block."""
    t = F.coalesce(text, F.lit(""))
    thought = r"(?s)<think>(.*?)</think>"
    thoughts = F.regexp_extract_all(t, F.lit(thought), 1)
    spoken = F.substring_index(F.regexp_replace(t, thought, ""), "<use_mcp_tool>", 1)
    body = trim_blank(F.regexp_replace(spoken, r"\\boxed\{\s*\}", ""))
    last = trim_blank(F.coalesce(F.try_element_at(thoughts, F.lit(-1)), F.lit("")))
    return F.when(body != "", body).otherwise(last)


_BOX = r"\\boxed\{([^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*\}[^{}]*+)*)\}"


def _deep_box(text: str) -> str:
    """Last balanced box of one text, braces paired in one pass."""
    partner, opened = {}, []
    for at, ch in enumerate(text):
        if ch == "{":
            opened.append(at)
        elif ch == "}" and opened:
            partner[opened.pop()] = at
    found, at = "", text.find("\\boxed{")
    while at >= 0:
        brace = at + 6
        end = partner.get(brace)
        if end is not None:
            found = text[brace + 1:end]
        at = text.find("\\boxed{", (brace if end is None else end) + 1)
    return found


@F.pandas_udf(T.StringType())
def _deep_boxes(texts: pd.Series) -> pd.Series:
    return texts.map(_deep_box, na_action="ignore")


def last_box(df: DataFrame, text: str, out: str) -> DataFrame:
    """Content of the last balanced \\boxed{...}, '' if none.

    A pattern covers up to three levels. Only rows with a box the pattern could not pair (deeper,
    nested or unclosed) reach the Python function; the others hand it a null.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hits = F.regexp_extract_all(t, F.lit(_BOX), 1)
    opens = (F.length(t) - F.length(F.replace(t, F.lit("\\boxed{"), F.lit("")))) / 7
    return (
        df.withColumn("__hits", hits)
        .withColumn("__hard", F.when(opens > F.size("__hits"), t))
        .withColumn(out, F.coalesce(
            _deep_boxes("__hard"), F.try_element_at("__hits", F.lit(-1)), F.lit("")))
        .drop("__hits", "__hard")
    )


def boxed_answer(summaries: DataFrame, messages: DataFrame) -> DataFrame:
    """Boxed answer of a conversation's summary; without one, that of the last assistant message
    that has a box; without any, a fixed notice. Where `summaries` has a column final_retry, only the last
    retry may fall back on a message; the others get the notice."""
    spoken = last_box(messages.where("role = 'assistant'").select("conv_id", "turn", "text"), "text", "__b")
    fallback = spoken.groupBy("conv_id").agg(
        F.max_by("__b", F.when(F.col("__b") != "", F.col("turn"))).alias("__fallback"))
    final = F.col("final_retry") if "final_retry" in summaries.columns else F.lit(True)
    own = last_box(summaries.select("conv_id", "summary", final.alias("__final")), "summary", "__own")
    return own.join(fallback, "conv_id", "left").select("conv_id", F.coalesce(
        F.nullif("__own", F.lit("")), F.when(F.col("__final"), F.col("__fallback")), F.lit(NO_BOX)).alias("boxed_answer"))


# ---- tool calls ----------------------------------------------------------------------------

# The elements of a call, in their order.
_ELEMENTS = ["server_name", "tool_name", "arguments"]


def _element(name: str, inside: str) -> str:
    return rf"<{name}\b[^>]*>{inside}</{name}>"


# An element ends where what must follow it follows, so arguments may hold any text, closing tags too.
_CALL = "(?is)" + _element("use_mcp_tool", rf"\s*{r'\s*'.join(_element(e, '(.*?)') for e in _ELEMENTS)}\s*")


def _calls(text: Column) -> Column:
    """Array of (server, tool, arguments), each found from its opening on."""
    found = lambda k: F.regexp_extract_all(text, F.lit(_CALL), F.lit(k))
    return F.transform(F.arrays_zip(found(1).alias("s"), found(2).alias("t"), found(3).alias("a")), lambda c: F.struct(
        trim_blank(c["s"]).alias("server"), trim_blank(c["t"]).alias("tool"), trim_blank(c["a"]).alias("arguments")))


def extract_tool_calls(messages: DataFrame, *keys: str) -> DataFrame:
    """One row per well-formed call: position in the message, server, tool, arguments text."""
    return (
        messages.where(F.col("text").contains("<") & F.lower("text").contains("<use_mcp_tool"))
        .select(*keys, F.posexplode(_calls(F.col("text"))).alias("call_pos", "c"))
        .select(*keys, "call_pos", "c.server", "c.tool", "c.arguments")
    )


# Names of other notations as JSON has them, in the order of replacement.
_OTHER_NOTATION = [("'", '"'), ("None", "null"), ("True", "true"), ("False", "false")]


def call_arguments(text: Column, mended: Column | None = None) -> Column:
    """Arguments of a call as a map of JSON texts. What is no JSON object is read with single quotes and the names of
    another notation replaced, or as `mended` if that is given; what still is none becomes {error, raw}. Texts come without
    their quotes, other values as they are written."""
    def read(t: Column) -> Column:
        return F.when(F.coalesce(is_object(strict_json(t)), F.lit(False)), F.from_json(t, "map<string,string>"))

    other = text
    for a, b in _OTHER_NOTATION:
        other = F.replace(other, F.lit(a), F.lit(b))
    tries = [read(text), *([read(mended)] if mended is not None else []), read(other)]
    return F.coalesce(*tries, F.create_map(F.lit("error"), F.lit("Failed to parse arguments"), F.lit("raw"), F.coalesce(text, F.lit(""))))


def native_tool_calls(messages: DataFrame, reply: str, *keys: str) -> DataFrame:
    """Calls of native replies: one row per call with its position, server, tool, arguments (see `call_arguments`) and id.

    Two shapes are read: an object whose list `output` holds items of type function_call with name, arguments and call_id,
    and a list of calls with id and function {name, arguments}. A name is split at its last '-'; one without is no call.
    """
    call = "struct<type:string,name:string,arguments:string,call_id:string,id:string,function:struct<name:string,arguments:string>>"
    text = F.col(reply)
    flat = F.filter(F.from_json(text, f"struct<output:array<{call}>>")["output"], lambda c: c["type"] == "function_call")
    nested = F.from_json(F.when(F.ltrim(text).startswith("["), text), f"array<{call}>")

    def row(c: Column, name: Column, arguments: Column, call_id: Column) -> Column:
        server, tool = split_native_name(name)
        return F.struct(server, tool, arguments.alias("text"), call_id.alias("call_id"), name.contains("-").alias("whole"))

    found = F.coalesce(
        F.transform(nested, lambda c: row(c, c["function"]["name"], c["function"]["arguments"], c["id"])),
        F.transform(flat, lambda c: row(c, c["name"], c["arguments"], c["call_id"])))
    rows = messages.select(*keys, F.posexplode(found).alias("call_pos", "c")).where("c.whole")
    return rows.select(*keys, "call_pos", "c.server", "c.tool", call_arguments(F.col("c.text")).alias("arguments"), "c.call_id")


def broken_tool_calls(messages: DataFrame, *keys: str) -> DataFrame:
    """Reject rows: for each tag, the text from an opening that nothing closes."""

    def unclosed(tag):
        after = F.regexp_extract("text", rf"(?is)^(?:.*</{tag}>)?(.*)$", 1)
        return F.struct(F.lit(f"Unclosed {tag} tag").alias("error"), F.regexp_extract(after, rf"(?is)<{tag}[^>]*>.*$", 0).alias("content"))

    tags = ["use_mcp_tool", "server_name", "tool_name", "arguments"]
    return (
        messages.where(F.col("text").contains("<"))
        .select(*keys, F.inline(F.array(*[unclosed(t) for t in tags])))
        .where("content <> ''")
    )


def split_native_name(name: Column) -> list[Column]:
    """Server and tool of a native call name, split at the last '-'."""
    return [F.regexp_extract(name, r"(?s)^(.*)-", 1).alias("server"), F.substring_index(name, "-", -1).alias("tool")]


def call_key(server: Column, tool: Column, arguments: Column) -> Column:
    """server:tool:arguments with keys sorted at every level (a variant stores objects sorted)."""
    canonical = F.coalesce(F.to_json(F.try_parse_json(arguments)), arguments)
    return F.concat_ws(":", server, tool, canonical)


def duplicate_tool_calls(calls: DataFrame) -> DataFrame:
    """Calls whose key was already used in an earlier turn of the conversation; sub-agent and skill
    calls do not take part."""
    counted = calls.where(~contains_any(F.col("server"), UNCOUNTED_SERVERS)).withColumn(
        "call_key", call_key(F.col("server"), F.col("tool"), F.col("arguments")))
    seen = with_group_values(counted, ["conv_id", "call_key"], first_turn=F.min("turn"))
    return seen.withColumn("is_duplicate", F.col("first_turn") < F.col("turn"))


def cap_calls(turns: DataFrame, calls: str, limit: int = 10) -> DataFrame:
    """The first `limit` calls of a turn and whether there were more; the calls are one array per turn."""
    return turns.withColumn("exceeded", F.size(calls) > limit).withColumn(calls, F.slice(calls, 1, limit))


# ---- across turns --------------------------------------------------------------------------


def keep_recent_results(messages: DataFrame, k: int) -> DataFrame:
    """Of the user and tool messages of a conversation, the first and the last k keep their text; the
    others' is replaced by a notice. k = -1 changes nothing, k = 0 keeps only the first."""
    if k < 0:
        return messages
    results = messages.where(F.col("role").isin("user", "tool")).select("conv_id", "turn")
    bounds = results.groupBy("conv_id").agg(F.min("turn").alias("__first"))
    if k > 0:
        tail = first_n(results, ["conv_id"], [F.col("turn").desc()], k)
        bounds = bounds.join(tail.groupBy("conv_id").agg(F.min("turn").alias("__from")), "conv_id")
    else:
        bounds = bounds.withColumn("__from", F.lit(None).cast("bigint"))
    omit = (
        F.col("role").isin("user", "tool") & (F.col("turn") != F.col("__first"))
        & (F.col("__from").isNull() | (F.col("turn") < F.col("__from")))
    )
    return (
        messages.join(bounds, "conv_id", "left")
        .withColumn("text", F.when(omit, F.lit(OMITTED)).otherwise(F.col("text")))
        .drop("__first", "__from")
    )


def turn_outcome(n_calls: Column, finish_reason: Column, text: Column) -> Column:
    """What becomes of an assistant turn; everything but the first and last outcome is rolled back."""
    return (
        F.when(n_calls > 0, "has_tool_calls")
        .when(finish_reason == "length", "finish_reason_length")
        .when(contains_any(text, TOOL_TAGS), "mcp_tag_without_tool_calls")
        .when(contains_any(text, REFUSALS), "refusal_detected")
        .otherwise("normal_completion")
    )


def is_rollback(outcome: Column) -> Column:
    return outcome.isin("finish_reason_length", "mcp_tag_without_tool_calls", "refusal_detected")


def rollback_runs(turns: DataFrame, limit: int = 5) -> DataFrame:
    """Runs of consecutive rollbacks: start, length, and whether the limit was passed.

    `turns` has conv_id, turn (counting up by one) and rolled_back.
    """
    marked = last_before(turns.select("conv_id", "turn", "rolled_back"), ["conv_id"], "turn",
                         F.when(~F.col("rolled_back"), F.col("turn")), "__reset")
    return (
        marked.where("rolled_back").groupBy("conv_id", "__reset")
        .agg(F.min("turn").alias("run_start"), F.count("*").alias("run_length"))
        .withColumn("over_limit", F.col("run_length") > limit).drop("__reset")
    )


def context_budget(calls: DataFrame, messages: DataFrame, summary_prompt: str, max_tokens: int, max_context: int) -> DataFrame:
    """Whether the next summary call would still fit, per model call.

    The estimate adds the tokens of the call, one and a half times a quarter of the characters of the
    user message right after it and of the summary prompt, the reply limit and 1000. The next message
    is found by a join on (conversation, turn), so no conversation is gathered.
    """

    def padded(n_chars):
        return F.floor(F.floor(n_chars / 4) * 1.5).cast("bigint")

    nxt = messages.where("role = 'user'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("__len"))
    total = (
        F.col("prompt_tokens") + F.col("completion_tokens") + padded(F.coalesce("__len", F.lit(0)))
        + padded(F.lit(len(summary_prompt))) + F.lit(max_tokens) + F.lit(1000)
    )
    live = (F.lit(max_context) > 0) & (F.col("prompt_tokens") > 0)
    return (
        calls.join(nxt, ["conv_id", "turn"], "left")
        .withColumn("estimated_total", total.cast("bigint"))
        .withColumn("over_limit", live & (F.col("estimated_total") >= max_context))
        .drop("__len")
    )
