"""Research traces: layout, steps and blocks, compression, packing.

A trace is one text in one row and its pieces never leave that row: they are arrays worked on with
higher-order functions, so nothing here shuffles, however long or lopsided the traces are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.jsontext import is_array, is_object, member, strict_json, text_member
from gradeloom.functions.text import cut_at_paragraph, let, present, trim_blank

# Names of block tags, and how step types are shortened.
BLOCK_TAGS = "reasoning|web_search|scrape|run_python_code"
FULL_TYPES = [
    "think", "thinking", "content", "message", "agent_think", "synthesis", "research_plan", "response", "stage",
    "launch_research", "complete_task", "agent_start", "tldr", "final_report", "response_summary",
]
SHORT_TYPES = [
    "search", "terminal", "tool", "web_search", "web_fetch", "url_extraction", "skill", "read_file", "data_files",
]
# How much of each part is kept.
MAX_RESULTS, MAX_SNIPPET, MAX_BODY, MAX_OUTPUT, MAX_QUERIES = 3, 200, 500, 300, 5
CHUNK_CHARS = 40_000
# Labels of shortened steps and blocks.
QUERIES, QUERY, TOOL, OUTPUT = "Queries: ", "Query: ", "Tool: ", "Output: "
SUMMARY, PLAN = "Summary: ", "Plan: "
NO_DETAILS = "(search/tool step, details omitted)"
REASONING, SEARCH, SCRAPE, CODE = "[Reasoning]\n", "[Search] ", "[Scrape] ", "[Code Execution]\n"


def _lit(s: str) -> Column:
    return F.lit(s)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, _lit(""))


def _lines(*parts: Column) -> Column:
    """Non-null parts joined by line breaks."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n")


def _pieces(text: Column, opening: str, lead: bool = False) -> Column:
    """Array of pieces, each from an opening to the next one or the end; text before the first is left out, or with `lead`
    the first piece. Openings are found once and the text is cut at them, which is linear in its length."""
    heads = F.regexp_extract_all(text, F.lit(f"(?s){opening}"), 0)

    def joined(segments: Column) -> Column:
        found = F.zip_with(heads, F.slice(segments, F.lit(2), F.size(segments)), lambda head, rest: F.concat(head, rest))
        return F.concat(F.slice(segments, 1, 1), found) if lead else found

    return let(F.split(text, f"(?s){opening}", -1), joined)


def trace_items(process: Column) -> Column:
    """The items of a trace that is one JSON array, as variants; null for others. What looks at a trace's layout and
    what works on its steps share this one parse."""
    t = trim_blank(process)
    return F.try_variant_get(strict_json(F.when(t.startswith("["), t)), "$", "array<variant>")


# ---- layout --------------------------------------------------------------------------------


def detect_trace_format(process: Column, items: Column | None = None) -> Column:
    """json_array, block_text, step_text or plain_text, in this order of precedence. `items`: see `trace_items`."""
    t = trim_blank(process)
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), 0))

    def stepwise(first: Column) -> Column:
        return is_object(first) & (member(first, "step").isNotNull() | member(first, "type").isNotNull())

    return (
        F.when(stepwise(F.get(trace_items(process) if items is None else items, F.lit(0))), "json_array")
        .when(count(rf"\[(?:{BLOCK_TAGS})\]") >= 2, "block_text")
        .when(count(r"\[Step [0-9]+\]") >= 2, "step_text")
        .otherwise("plain_text")
    )


# ---- JSON steps ----------------------------------------------------------------------------


def _content(step: Column) -> Column:
    return F.coalesce(*[present(text_member(step, k)) for k in ("content", "thinking_text", "text")], _lit(""))


def _sources(step: Column) -> Column:
    """Source objects of a search step: a filled list, or a text that holds a list."""
    found = []
    for key in ("sources", "search_results", "organic"):
        m = member(step, key)
        direct = F.when(is_array(m), F.try_variant_get(m, "$", "array<variant>"))
        inner = strict_json(text_member(step, key))
        found.append(F.coalesce(F.when(F.size(direct) > 0, direct), F.when(is_array(inner), F.try_variant_get(inner, "$", "array<variant>"))))
    return F.coalesce(*found, F.array().cast("array<variant>"))


def _search_body(step: Column) -> Column:
    queries = []
    for key in ("keywords", "queries", "query", "content"):
        m = member(step, key)
        many = F.when(is_array(m), F.try_variant_get(m, "$", "array<string>"))
        one = present(text_member(step, key))
        shown = F.when(F.size(many) > 0, F.concat(_lit(QUERIES), F.array_join(F.slice(many, 1, MAX_QUERIES), ", "))).when(
            one.isNotNull(), F.when(F.length(one) < 500, F.concat(_lit(QUERY), one)).otherwise(""))
        queries.append(shown)
    asked = present(F.coalesce(*queries))
    shown_hits = lambda sources: F.transform(F.slice(sources, 1, MAX_RESULTS), lambda s, i: F.concat(
        _lit("  ["), (i + 1).cast("string"), _lit("] "), _or_empty(F.try_variant_get(s, "$.title", "string")), _lit(": "),
        F.substring(_or_empty(F.try_variant_get(s, "$.snippet", "string")), 1, MAX_SNIPPET)))
    name = present(F.try_variant_get(step, "$.name", "string"))
    output = present(text_member(step, "output"))
    body = let(_sources(step), lambda sources: _lines(
        F.when(name.isNotNull(), F.concat(_lit(TOOL), name)), asked,
        F.when(F.size(sources) > 0, F.array_join(shown_hits(sources), "\n")),
        F.when(output.isNotNull() & (F.size(sources) == 0), F.concat(_lit(OUTPUT), F.substring(output, 1, MAX_OUTPUT)))))
    return F.coalesce(present(body), _lit(NO_DETAILS))


def _step_line(step: Column) -> Column:
    kind = F.coalesce(F.try_variant_get(step, "$.type", "string"), _lit("unknown"))
    head = F.concat(_lit("[Step "), F.coalesce(F.try_variant_get(step, "$.step", "string"), _lit("?")), _lit("] ["), kind, _lit("]"))
    stage = F.concat(head, _lit(" "), _or_empty(F.try_variant_get(step, "$.name", "string")), _lit(" ("),
                     _or_empty(F.try_variant_get(step, "$.status", "string")), _lit(", "),
                     _or_empty(F.try_variant_get(step, "$.duration", "string")), _lit("ms)"))
    plan = member(step, "plan_items")
    plan_list = F.when(is_array(plan), F.try_variant_get(plan, "$", "array<string>"))
    summary = present(text_member(step, "thinking_summary"))
    thinking = _lines(
        head, present(text_member(step, "thinking_text")),
        F.when(summary.isNotNull(), F.concat(_lit(SUMMARY), summary)),
        F.when(F.size(plan_list) > 0, F.concat(_lit(PLAN), F.array_join(plan_list, "; "))).otherwise(present(text_member(step, "plan_items"))))

    def spoken(content):
        full = F.when(content == "", F.when(kind == "stage", stage).otherwise(head)).when(kind == "thinking", thinking).otherwise(
            F.concat(head, _lit("\n"), content))
        other = F.when(content == "", head).otherwise(F.concat(head, _lit("\n"), F.substring(content, 1, MAX_BODY)))
        return F.when(kind.isin(FULL_TYPES), full).otherwise(other)

    return F.when(kind.isin(SHORT_TYPES), F.concat(head, _lit("\n"), _search_body(step))).otherwise(let(_content(step), spoken))


def step_lines(items: Column) -> Column:
    """Array of shortened step texts of the items of a JSON trace; null when there are none."""
    return F.transform(F.filter(items, is_object), _step_line)


def trace_steps_json(traces: DataFrame, *keys: str) -> DataFrame:
    """One row per step; traces that are no JSON array give none (see `unreadable_traces`)."""
    parsed = traces.withColumn("__items", trace_items(F.col("process")))
    return parsed.select(*keys, F.posexplode(step_lines(F.col("__items"))).alias("pos", "line"))


def unreadable_traces(traces: DataFrame, *keys: str) -> DataFrame:
    """Reject rows: traces that start like a JSON array but cannot be read as one."""
    t = trim_blank(F.col("process"))
    return traces.where(t.startswith("[") & strict_json(t).isNull()).select(*keys, F.length("process").alias("n_chars"))


# ---- tagged blocks -------------------------------------------------------------------------


def blocks(process: Column) -> Column:
    """Array of (type, content). A block runs from its tag to the next tag or think block; a think
    block is reasoning, and the text between its end and the next tag is dropped."""
    found = _pieces(process, rf"\[(?:{BLOCK_TAGS})\]|<think>.*?</think>")

    def block(p: Column) -> Column:
        name = F.regexp_extract(p, rf"^\[({BLOCK_TAGS})\]", 1)
        tagged = F.substring(p, F.length(name) + 3, F.length(p))
        return F.struct(
            F.when(name != "", name).otherwise("reasoning").alias("type"),
            trim_blank(F.when(name != "", tagged).otherwise(
                F.regexp_extract(p, "(?s)^<think>(.*?)</think>", 1))).alias("content"))

    named = F.transform(found, block)
    return F.filter(named, lambda b: b["content"] != "")


def trace_blocks(traces: DataFrame, *keys: str) -> DataFrame:
    return traces.select(*keys, F.posexplode(blocks(F.col("process"))).alias("pos", "b")).select(*keys, "pos", "b.*")


def block_line(block: Column) -> Column:
    """Shortened text of one block; '' when nothing is left of it."""
    kind, content = block["type"], block["content"]
    head = trim_blank(F.substring_index(content, "\n", 1))
    cut = F.locate("\n", content)
    rest = F.when(cut > 0, F.substring(content, cut + 1, F.length(content))).otherwise("")
    thought = trim_blank(F.regexp_replace(content, "</?think>", ""))
    organic = F.slice(F.from_json(rest, "organic array<struct<title string, snippet string>>")["organic"], 1, MAX_RESULTS)
    hits = F.transform(organic, lambda r: F.concat(
        _lit("  - "), _or_empty(r["title"]), _lit(": "), F.substring(_or_empty(r["snippet"]), 1, MAX_SNIPPET)))
    return (
        F.when(kind == "reasoning", F.when(thought == "", "").otherwise(F.concat(_lit(REASONING), thought)))
        .when(kind == "web_search", _lines(F.concat(_lit(SEARCH), head), F.when(F.size(hits) > 0, F.array_join(hits, "\n"))))
        .when(kind == "scrape", F.concat(_lit(SCRAPE), head, _lit("\n"), F.substring(rest, 1, MAX_BODY)))
        .otherwise(F.concat(_lit(CODE), F.substring(content, 1, MAX_BODY)))
    )


def block_lines(process: Column) -> Column:
    return F.filter(F.transform(blocks(process), block_line), lambda x: x != "")


def format_blocks(traces: DataFrame, *keys: str) -> DataFrame:
    return traces.select(*keys, F.posexplode(block_lines(F.col("process"))).alias("pos", "line"))


# ---- numbered steps and plain text ---------------------------------------------------------


def step_texts(process: Column) -> Column:
    """Array of '[Step N] text' pieces, the text before the first marker as its own piece."""
    marked = _pieces(process, r"\[Step [0-9]+\]", lead=True)

    def step(p: Column) -> Column:
        name = F.regexp_extract(p, r"^\[Step [0-9]+\]", 0)
        rest = trim_blank(F.substring(p, F.length(name) + 1, F.length(p)))
        return F.when(name != "", F.concat(name, _lit(" "), rest)).otherwise(rest)

    return F.filter(F.transform(marked, step), lambda x: x != "")


def trace_steps_text(process: Column, max_chars: int = 30_000) -> Column:
    return cut_at_paragraph(F.array_join(step_texts(process), "\n\n"), max_chars)


def plain_trace(process: Column, max_chars: int = 30_000) -> Column:
    """Runs of blank lines collapsed, line ends trimmed, cut at a paragraph."""
    t = F.regexp_replace(process, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")
    return cut_at_paragraph(t, max_chars)


# ---- compression ---------------------------------------------------------------------------


def compress_lines(lines: Column, max_chars: int, head_chars: int, floor: int) -> Column:
    """Pieces joined by blank lines, every body shortened in proportion when the whole is too long.

    The first line of a piece is never cut and a body keeps at least `floor` characters, so the
    result may still be longer than `max_chars`.
    """
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    budget = F.greatest(F.lit(max_chars) - F.size(lines) * head_chars, F.lit(max_chars // 2)).cast("double")

    def shorten(x, ratio):
        at = F.locate("\n", x)
        body = F.when(at > 0, F.substring(x, at + 1, F.length(x))).otherwise("")
        head = F.substring_index(x, "\n", 1)

        def cut(t):
            allowed = F.greatest((F.length(t) * ratio).cast("int"), F.lit(floor))
            kept = F.when(F.length(t) > allowed, F.concat(F.substring(t, F.lit(1), allowed), _lit("..."))).otherwise(t)
            return F.when(t == "", head).otherwise(F.concat(head, _lit("\n"), kept))

        return let(body, cut)

    def squeezed(ratio):
        return F.when(ratio >= 1, F.array_join(lines, "\n\n")).otherwise(
            F.array_join(F.transform(lines, lambda x: shorten(x, ratio)), "\n\n"))

    whole = F.array_join(lines, "\n\n")
    return let(whole, lambda j: F.when(F.length(j) <= max_chars, j).otherwise(
        let(budget / F.nullif(total, F.lit(0)), squeezed)))


def compress_trace(traces: DataFrame, max_chars: int = 30_000) -> DataFrame:
    """Any trace brought under the character budget by the rule of its layout."""
    p, kind = F.col("process"), F.col("trace_format")
    # Characters reserved per piece and least body length, by layout.
    text = (
        F.when(trim_blank(p) == "", "")
        .when(kind == "json_array", compress_lines(F.col("__steps"), max_chars, 60, 100))
        .when(kind == "block_text", compress_lines(F.col("__blocks"), max_chars, 40, 80))
        .when(kind == "step_text", trace_steps_text(p, max_chars))
        .otherwise(plain_trace(p, max_chars))
    )
    return (
        traces.withColumn("__items", trace_items(p)).withColumn("trace_format", detect_trace_format(p, F.col("__items")))
        .withColumn("__steps", F.when(kind == "json_array", step_lines(F.col("__items"))))
        .withColumn("__blocks", F.when(kind == "block_text", block_lines(p)))
        .withColumn("compressed", text)
        .drop("__items", "__steps", "__blocks")
    )


# ---- packing -------------------------------------------------------------------------------


def pack(pieces: Column, limit: int, sep: str, lengths: Column | None = None) -> Column:
    """Greedy in-order packing: a piece that would take the chunk over `limit` starts the next one; a
    piece longer than `limit` stands alone. Separators do not count. `lengths` are other lengths to go by.

    The fold carries numbers only (where chunks start); texts are joined once, at the end.
    """
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def add(s, n):
        full = (s["at"] == 0) | (s["size"] + n > limit)
        return F.struct(
            F.when(full, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"),
            F.when(full, n).otherwise(s["size"] + n).alias("size"),
            (s["at"] + 1).alias("at"))

    def chunks(p: Column, starts: Column) -> Column:
        def joined(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(p))
            return F.array_join(F.slice(p, start + 1, end - start), sep)

        return F.transform(starts, joined)

    return let(pieces, lambda p: let(
        F.aggregate(F.transform(p, F.length) if lengths is None else lengths, zero, add, lambda s: s["starts"]), lambda starts: chunks(p, starts)))


def standard_length(value: Column) -> Column:
    """Length of a variant as JSON text in the usual form, with a blank after each comma and colon."""
    def told(text: Column) -> Column:
        bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
        return F.length(text) + F.length(F.regexp_replace(bare, "[^,:]", ""))

    return let(F.coalesce(F.to_json(value), _lit("null")), told)


def pack_chunks(traces: DataFrame, *keys: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of a trace, cut between its steps, its tagged segments or its paragraphs."""
    p, kind = F.col("process"), F.col("trace_format")

    def at_markers(pattern):
        def with_lead(found):
            # the text before the first marker goes with the first chunk, uncounted
            told = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))
            lead = F.substring(p, 1, F.length(p) - told)
            return F.transform(pack(found, limit, ""), lambda c, i: F.when(i == 0, F.concat(lead, c)).otherwise(c))

        return let(_pieces(p, pattern), with_lead)

    items = F.col("__items")
    # the text of each step, keys in their order; strings get their quotes back
    steps = F.zip_with(F.from_json(F.when(kind == "json_array", p), "array<string>"), items, lambda text, item: F.when(
        F.coalesce(F.schema_of_variant(item) == "STRING", F.lit(True)), F.coalesce(F.to_json(item), _lit("null"))).otherwise(text))
    as_array = F.transform(pack(steps, limit, ",", F.transform(items, standard_length)), lambda c: F.concat(_lit("["), c, _lit("]")))
    chunks = (
        F.when(kind == "json_array", as_array)
        .when(kind == "block_text", at_markers(rf"\[(?:{BLOCK_TAGS})\]"))
        .when(kind == "step_text", at_markers(r"\[Step [0-9]+\]"))
        .otherwise(pack(F.split(p, r"(?U)\n\s*\n"), limit, "\n\n"))
    )
    # any filled JSON list is packed by its items, whether or not they are steps
    layout = F.when(F.coalesce(F.size(items) > 0, F.lit(False)), "json_array").otherwise(detect_trace_format(p, items))
    return traces.withColumn("__items", trace_items(p)).withColumn("trace_format", layout).select(
        *keys, "trace_format", F.posexplode(chunks).alias("chunk_no", "chunk"))
