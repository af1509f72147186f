import random

from pyspark.sql import functions as F

from gradeloom.functions import numbering as N
from gradeloom.operators import conversations as C
from tests.test_answers import col


def test_boxes_of_any_depth(spark):
    texts = ["\\boxed{a} \\boxed{b}", "\\boxed{{{{{deep}}}}}", "\\boxed{x \\boxed{y} z}", "\\boxed{open \\boxed{in}", "none", "\\boxed{a} \\boxed{", None, "} \\boxed{f{1}g{2}}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.b for r in C.last_box(df, "t", "b").orderBy("i").collect()]
    assert got == ["b", "{{{{deep}}}}", "x \\boxed{y} z", "in", "", "a", "", "f{1}g{2}"]


def test_box_fallback(spark):
    msgs = spark.createDataFrame([(1, 0, "assistant", "\\boxed{old}"), (1, 1, "user", "\\boxed{user}"), (2, 0, "assistant", "no")], "conv_id int, turn int, role string, text string")
    sums = spark.createDataFrame([(1, "\\boxed{}"), (2, "x"), (3, "\\boxed{new}")], "conv_id int, summary string")
    assert {r.conv_id: r.boxed_answer for r in C.boxed_answer(sums, msgs).collect()} == {1: "old", 2: C.NO_BOX, 3: "new"}


def test_failure_summary(spark):
    texts = ["<think>a</think> rest <use_mcp_tool>x", "<think>a</think><think> b </think>\\boxed{ }", "", None]
    assert col(spark, texts, C.failure_summary(F.col("a"))) == ["rest", "b", "", ""]


def test_strip_think_only_for_the_assistant(spark):
    rows = [("assistant", "<think>x\ny</think>\n ok"), ("user", "<think>x</think> ok")]
    assert col(spark, rows, C.strip_think(F.col("r"), F.col("t")), "r string, t string") == ["ok", "<think>x</think> ok"]


def test_keep_recent(spark):
    rng = random.Random(2)
    convs = {c: [(t, rng.choice(["user", "assistant", "tool", "system"])) for t in range(rng.randrange(1, 12))] for c in range(30)}
    df = spark.createDataFrame([(c, t, r, f"{c}-{t}") for c, m in convs.items() for t, r in m], "conv_id int, turn int, role string, text string")
    for k in (-1, 0, 1, 3):
        want = {}
        for c, m in convs.items():
            results = [t for t, r in m if r in ("user", "tool")]
            keep = set(results) if k < 0 or len(results) <= 1 else {results[0], *(results[-min(k, len(results) - 1):] if k else [])}
            want.update({(c, t): f"{c}-{t}" if r not in ("user", "tool") or t in keep else C.OMITTED for t, r in m})
        assert {(r.conv_id, r.turn): r.text for r in C.keep_recent_results(df, k).collect()} == want


def test_rollback_runs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(7)
    flags = {c: [rng.random() < 0.6 for _ in range(40)] for c in range(20)}
    want = set()
    for c, seq in flags.items():
        start = None
        for t, f in enumerate(seq + [False]):
            if f and start is None:
                start = t
            if not f and start is not None:
                want.add((c, start, t - start, t - start > 3))
                start = None
    df = spark.createDataFrame([(c, t, f) for c, s in flags.items() for t, f in enumerate(s)], "conv_id int, turn int, rolled_back boolean")
    got = {(r.conv_id, r.run_start, r.run_length, r.over_limit) for r in C.rollback_runs(df, 3).collect()}
    assert got == want


def test_calls_and_duplicates(spark):
    call = "<use_mcp_tool><server_name>{s}</server_name><tool_name>t</tool_name><arguments>{a}</arguments></use_mcp_tool>"
    rows = [
        (1, 0, call.format(s="web", a='{"b": {"y": 1, "x": 2}, "a": 1}')), (1, 1, "hm " + call.format(s="web", a='{"a":1,"b":{"x":2,"y":1}}')),
        (1, 2, call.format(s="agent-worker", a="{}")), (1, 3, call.format(s="agent-worker", a="{}")), (2, 0, "<USE_MCP_TOOL x=1><server_name>cut"), (3, 0, "plain"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    dup = C.duplicate_tool_calls(C.extract_tool_calls(df, "conv_id", "turn"))
    assert sorted((r.turn, r.is_duplicate) for r in dup.collect()) == [(0, False), (1, True)]
    assert sorted(r.error for r in C.broken_tool_calls(df, "conv_id", "turn").collect()) == ["Unclosed server_name tag", "Unclosed use_mcp_tool tag"]
    assert tuple(spark.createDataFrame([("a-b-c",)], "n string").select(*C.split_native_name(F.col("n"))).first()) == ("a-b", "c")


def test_calls_with_any_text_in_their_arguments(spark):
    call = "<use_mcp_tool>\n<server_name>s</server_name><tool_name n='1'> t </tool_name>\n<arguments>{a}</arguments></use_mcp_tool>"
    texts = [call.format(a='{"x": "</use_mcp_tool>"}') + call.format(a=""), call.format(a="</arguments> <arguments>") + " and", call.replace("<tool_name", "<other"), call.format(a="1").upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.call_pos, r.server, r.tool, r.arguments) for r in C.extract_tool_calls(df, "id").collect())
    assert got == [(0, 0, "s", "t", '{"x": "</use_mcp_tool>"}'), (0, 1, "s", "t", ""), (1, 0, "s", "t", "</arguments> <arguments>"), (3, 0, "S", "T", "1")]


def test_arguments_of_calls(spark):
    texts = ['{"a": "x", "b": [1, 2], "c": null}', "{'a': 'x', 'b': False}", "[1]", "nothing", None, '{"a": 1} tail', ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.m for r in df.select("id", C.call_arguments(F.col("t")).alias("m")).collect()}
    failed = lambda t: {"error": "Failed to parse arguments", "raw": t}
    assert got == {0: {"a": "x", "b": "[1,2]", "c": None}, 1: {"a": "x", "b": "false"}, 2: failed("[1]"), 3: failed("nothing"), 4: failed(""),
                   5: failed('{"a": 1} tail'), 6: failed("")}


def test_cap(spark):
    df = spark.createDataFrame([(1, list(range(12))), (2, [1])], "id int, calls array<int>")
    assert [(len(r.calls), r.exceeded) for r in C.cap_calls(df, "calls").orderBy("id").collect()] == [(10, True), (1, False)]
