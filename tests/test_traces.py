import json
import random

from pyspark.sql import functions as F

from gradeloom.operators import traces as T
from tests.test_answers import col


def test_formats(spark):
    texts = ['[{"step": 1}]', '[{"type": null}]', '[{"x": 1}]', "[1, 2]", '[{"step": 1}] tail', "[reasoning] a [scrape] b", "[reasoning] a <think>b</think>",
             "[Step 1] a [Step 22] b", "plain", "[Step 1] [reasoning] [web_search] [Step 2]"]
    assert col(spark, texts, T.detect_trace_format(F.col("a"))) == [
        "json_array", "json_array", "plain_text", "plain_text", "plain_text", "block_text", "plain_text", "step_text", "plain_text", "block_text"]


def test_json_steps(spark):
    steps = [
        {"step": 1, "type": "think", "content": "all of it"}, {"step": "2", "type": "stage", "name": "plan", "status": "ok", "duration": 12},
        {"type": "thinking", "thinking_text": "t", "thinking_summary": "s", "plan_items": ["a", "b"]}, {"step": 4, "type": "thinking", "content": "c", "plan_items": "one"},
        {"step": 5, "type": "search", "queries": ["q"] * 7, "sources": [{"title": "T", "snippet": "x" * 300}] * 4, "name": "web", "output": "hidden"},
        {"step": 6, "type": "tool", "output": "o" * 400}, {"step": 7, "type": "skill", "query": "z" * 600}, {"step": 8, "type": "search", "search_results": '[{"title": "E"}]'},
        {"step": 9, "type": "odd", "text": "u" * 600}, {"step": 10, "content": ["not text"]}, "no object", {"step": 11, "type": "message"},
    ]
    got = col(spark, [json.dumps(steps)], T.step_lines(T.trace_items(F.col("a"))))[0]
    hits = "".join(f"\n  [{i}] T: {'x' * 200}" for i in (1, 2, 3))
    assert got == [
        "[Step 1] [think]\nall of it", "[Step 2] [stage] plan (ok, 12ms)", "[Step ?] [thinking]\nt\nSummary: s\nPlan: a; b", "[Step 4] [thinking]\none",
        "[Step 5] [search]\nTool: web\nQueries: q, q, q, q, q" + hits, "[Step 6] [tool]\nOutput: " + "o" * 300, "[Step 7] [skill]\n(search/tool step, details omitted)",
        "[Step 8] [search]\n  [1] E: ", "[Step 9] [odd]\n" + "u" * 500, "[Step 10] [unknown]", "[Step 11] [message]",
    ]


def test_blocks(spark):
    text = "lost [reasoning] a <think>b</think> lost too [web_search] q\n" + json.dumps({"organic": [{"title": "T", "snippet": "s"}]}) + "[scrape] http://x\nbody [run_python_code] [reasoning] <think>open"
    rows = col(spark, [text], T.blocks(F.col("a")))[0]
    assert [(r["type"], r["content"].split("\n")[0]) for r in rows] == [("reasoning", "a"), ("reasoning", "b"), ("web_search", "q"), ("scrape", "http://x"), ("reasoning", "<think>open")]
    assert col(spark, [text], T.block_lines(F.col("a")))[0] == [
        "[Reasoning]\na", "[Reasoning]\nb", "[Search] q\n  - T: s", "[Scrape] http://x\nbody", "[Reasoning]\nopen"]


def squeeze(lines, n, head_chars, floor):
    whole = "\n\n".join(lines)
    if len(whole) <= n:
        return whole
    ratio = max(n - head_chars * len(lines), n // 2) / sum(map(len, lines))
    if ratio >= 1:
        return whole
    out = []
    for x in lines:
        head, _, body = x.partition("\n")
        keep = max(int(len(body) * ratio), floor)
        out.append(head + ("\n" + (body[:keep] + "..." if len(body) > keep else body) if body else ""))
    return "\n\n".join(out)


def test_compression(spark):
    rng = random.Random(8)
    sets = [[f"[S {i}]" + ("\n" + "xé" * rng.randrange(0, 150) if rng.random() < 0.8 else "") for i in range(rng.randrange(1, 12))] for _ in range(150)]
    got = col(spark, [(s,) for s in sets], T.compress_lines(F.col("a"), 900, 60, 100), "a array<string>")
    assert got == [squeeze(s, 900, 60, 100) for s in sets]


def packed(pieces, n, sep):
    out, cur, size = [], [], 0
    for p in pieces:
        if cur and size + len(p) > n:
            out.append(sep.join(cur))
            cur, size = [], 0
        cur.append(p)
        size += len(p)
    return out + ([sep.join(cur)] if cur else [])


def test_packing(spark):
    rng = random.Random(9)
    sets = [["p" * rng.randrange(0, 60) for _ in range(rng.randrange(0, 25))] for _ in range(150)]
    assert col(spark, [(s,) for s in sets], T.pack(F.col("a"), 50, "\n\n"), "a array<string>") == [packed(s, 50, "\n\n") for s in sets]


def test_packed_text_is_the_trace(spark):
    df = spark.createDataFrame([(1, "pre [Step 1] aaaa [Step 2] bbbb [Step 3] c")], "id int, process string")
    got = [r.chunk for r in T.pack_chunks(df, "id", limit=16).orderBy("chunk_no").collect()]
    assert "".join(got) == "pre [Step 1] aaaa [Step 2] bbbb [Step 3] c" and got[0] == "pre [Step 1] aaaa "


def test_budget_of_any_layout(spark):
    rows = [(1, "   "), (2, "a\n\n\n\nb  \nc"), (3, "[Step 1]  x \n[Step 2] y"), (4, "[reasoning] r [scrape] u")]
    got = {r.id: r.compressed for r in T.compress_trace(spark.createDataFrame(rows, "id int, process string"), 100).collect()}
    assert got == {1: "", 2: "a\n\nb\nc", 3: "[Step 1] x\n\n[Step 2] y", 4: "[Reasoning]\nr\n\n[Scrape] u\n"}
