"""Chains that survive being stopped: compression in rounds, stages, stored results; and first rows of any number."""

import os

import pytest
from pyspark.sql import functions as F

from gradeloom.catalog.chains import judge, structurer
from gradeloom.functions.numbering import first_rows
from gradeloom.operators.traces import pack_chunks
from gradeloom.plans.compress import BETWEEN, CUT, compress_with
from gradeloom.plans.process import process_graph
from gradeloom.plans.stages import run_stages, stage_counts
from gradeloom.sources.results import ResultStore, with_store


def test_compression_in_rounds(spark):
    text = "\n\n".join(f"paragraph {i} " + "x" * 60 for i in range(40))
    rows = [("long", "q", text), ("short", None, "one"), ("blank", "q", " \n"), ("stubborn", "keep", text), ("dead", "fail", text)]
    traces = spark.createDataFrame(rows, "id string, query string, process string")

    def scorer(prompt):
        question, body = prompt.split("\nQuestion: ")[1].split("\n\n", 1)
        if question == "fail":
            raise ValueError
        return body if question == "keep" else body[: max(1, len(body) // 2)]

    got = {r.id: (r.compressed, r.rounds) for r in compress_with(traces, ["id"], scorer, 400, 500, rounds=6, tries=1).collect()}
    assert got["short"] == ("o", 1) and got["blank"] == ("", 1)
    chunks = [r.chunk for r in pack_chunks(traces.where("id = 'long'"), "id", limit=500).orderBy("chunk_no").collect()]
    once = {r.id: (r.compressed, r.rounds) for r in compress_with(traces, ["id"], scorer, 400, 500, tries=1).collect()}
    joined = BETWEEN.join(c[: len(c) // 2] for c in chunks)
    assert once["long"] == (joined[:400] + CUT, 1)
    assert got["long"][1] >= 3 and len(got["long"][0]) <= 400
    assert got["stubborn"][1] == 1 and got["stubborn"][0].endswith(CUT)       # loses nothing, so it is not asked again
    assert got["dead"][0].startswith("paragraph 0") and len(got["dead"][0]) <= 400 + len(CUT)


def test_a_stopped_chain_goes_on(spark, tmp_path):
    rows = [(f"m{i % 3}", i, f"q{i}", " " if i % 10 == 7 else f"trace {i}", "report") for i in range(60)]
    entries = spark.createDataFrame(rows, "model string, entry_id long, query string, process string, response string")
    whole = process_graph(spark, entries, str(tmp_path / "whole"), structurer, judge, tries=1)
    want = sorted(map(str, whole["board"].collect()))
    counts = {r.stage: (r["rows"], r.rejected) for r in stage_counts(whole).collect()}
    blank = sum(i % 10 == 7 for i in range(60))
    bad = sum(i % 10 != 7 and i % 9 in (4, 5) for i in range(60))
    assert counts["compressed"] == (60 - blank, blank) and counts["structured"] == (60 - blank - bad, bad)
    assert counts["intrinsic"][1] == sum(i % 10 != 7 and i % 9 not in (4, 5) and i % 5 == 0 for i in range(60))

    for stop in ("structured", "alignment"):
        out = str(tmp_path / stop)

        def stopping(prompt):
            if stop == "structured" or prompt.startswith("Score how"):
                raise KeyboardInterrupt
            return judge(prompt)

        with pytest.raises(Exception):
            process_graph(spark, entries, out, stopping if stop == "structured" else structurer, stopping, tries=1)
        assert os.path.exists(f"{out}/compressed/_SUCCESS") and not os.path.exists(f"{out}/board/_SUCCESS")
        kept = os.path.getmtime(f"{out}/compressed/_SUCCESS")
        again = process_graph(spark, entries, out, structurer, judge, tries=1)
        assert sorted(map(str, again["board"].collect())) == want and os.path.getmtime(f"{out}/compressed/_SUCCESS") == kept


def test_stages_without_rejects(spark, tmp_path):
    done = run_stages(spark, str(tmp_path / "s"), [("a", lambda d: spark.range(5).toDF("x")), ("b", lambda d: d["a"].where("x > 2"))])
    assert {r.stage: (r["rows"], r.rejected) for r in stage_counts(done).collect()} == {"a": (5, 0), "b": (2, 0)}


def test_second_run_makes_no_call(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), "id bigint, value string", ["id"])
    asked = spark.sparkContext.accumulator(0)

    def compute(rows):
        def call(i):
            asked.add(1)
            return f"v{i}"
        return rows.select("id", F.udf(call)("id").alias("value"), (F.col("id") % 4 != 3).alias("ok"))

    requests = spark.range(20).repartition(3)
    first = {r.id: (r.value, r.cached) for r in with_store(requests, store, compute, 3).collect()}
    assert first == {i: (f"v{i}" if i % 4 != 3 else None, False) for i in range(20)}
    made = asked.value
    again = {r.id: (r.value, r.cached) for r in with_store(requests.where("id % 4 <> 3"), store, compute, 3).collect()}
    assert again == {i: (f"v{i}", True) for i in range(20) if i % 4 != 3} and asked.value == made
    assert not [n for n in store.commits() if not os.path.isdir(f"{store.path}/data/{n}")]


def test_torn_writes_are_not_read_and_lost_jobs_keep_their_parts(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), "id bigint, value string", ["id"])
    assert store.read().count() == 0
    store.add(spark.createDataFrame([(1, "first")], store.schema))
    store.add(spark.createDataFrame([(1, "second"), (2, "b")], store.schema))
    spark.createDataFrame([(3, "torn")], store.schema).write.parquet(f"{store.path}/data/99999999999999999999-x")
    assert {(r.id, r.value) for r in store.read().collect()} == {(1, "first"), (2, "b")}
    parts = []

    def failing(rows):
        parts.append(rows.count())
        if len(parts) == 3:
            raise RuntimeError("lost")
        return rows.selectExpr("id", "'new' AS value", "true AS ok")

    with pytest.raises(RuntimeError):
        with_store(spark.range(100), store, failing, 6)
    assert store.read().count() == 2 + parts[0] + parts[1]


@pytest.mark.parametrize("n", [0, 1, 37, 500, 501, 9999])
def test_first_rows(spark, n):
    df = spark.range(500).selectExpr("id", "id * 7919 % 13 AS a", "concat('t', id % 10) AS b").repartition(5)
    got = sorted(r.id for r in first_rows(df, ["a", "b", "id"], n).collect())
    assert got == sorted(sorted(range(500), key=lambda i: (i * 7919 % 13, f"t{i % 10}", i))[:n])
