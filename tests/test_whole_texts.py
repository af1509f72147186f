"""No text is lost or treated otherwise because of the characters it holds, its size or its file's name."""

import json
import time

from pyspark.sql import functions as F

from gradeloom.functions.jsontext import is_json
from gradeloom.operators import attempts, reports as R, select as S, traces as T
from gradeloom.sources import entries as E

BORDERS = ""


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_segments_are_the_report(spark):
    for text in [f"a{BORDERS}b\n\n# h\n\nx", "", "# only\n\n", "p\n \n\nq\n\n", "# a\n\n## b\n\ntext\n\n# tail", "\n\nx"]:
        assert "".join(one(spark, text, R.segments)) == text


def test_segments_are_linear(spark):
    text = "\n\n".join(f"paragraph {i}" for i in range(80_000))
    start = time.time()
    parts = one(spark, text, R.segments)
    assert len(parts) == 80_000 and "".join(parts) == text
    assert time.time() - start < 60


def test_blocks_keep_every_character(spark):
    text = f"lead [reasoning] p{BORDERS}q <think>t{BORDERS}</think> x [web_search] s{BORDERS}"
    got = [(b.type, b.content) for b in one(spark, text, T.blocks)]
    assert got == [("reasoning", f"p{BORDERS}q"), ("reasoning", f"t{BORDERS}"), ("web_search", f"s{BORDERS}")]
    assert one(spark, f"a{BORDERS} [Step 1] b{BORDERS}", T.step_texts) == [f"a{BORDERS}", f"[Step 1] b{BORDERS}"]


def test_pack_is_greedy(spark):
    pieces = ["aa", "bbb", "c", "dddddd", "e", "f"]
    got = one(spark, json.dumps(pieces), lambda t: T.pack(F.from_json(t, "array<string>"), 5, "|"))
    assert got == ["aa|bbb", "c", "dddddd", "e|f"]
    assert one(spark, "[]", lambda t: T.pack(F.from_json(t, "array<string>"), 5, "|")) == []


def test_json_of_any_size(spark):
    big = spark.range(1).select(F.concat(F.lit('["'), F.repeat(F.lit("x"), 140_000_000), F.lit('"]')).alias("v"))
    row = big.select(is_json(F.col("v")).alias("whole"), is_json(F.concat("v", F.lit("]"))).alias("broken")).first()
    assert (row.whole, row.broken) == (True, False)
    assert [one(spark, t, is_json) for t in ('{"a":1}', "{'a':1}", "[1] x", "1", "")] == [True, False, False, True, False]
    done = big.select(F.lit("t1").alias("task_id"), F.col("v").alias("content"))
    assert S.pending_tasks(done.select("task_id"), done).count() == 0


def test_one_file_per_model(spark, tmp_path):
    def put(name, *ids):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps([{"id": i, "response": "r"} for i in ids]))

    put("a/m1_text_1.json", "right")
    put("b/m1_text_1.json", "same stem")
    put("a/m1_text_0.log", "other extension")
    put("a/m 2_multimodal_1.json", "only kind left")
    put("a/m3_text_1.json", "not asked for")
    rows = E.load_results_glob(spark, str(tmp_path), ["m1", "m 2"]).select("model", "id").collect()
    assert sorted(map(tuple, rows)) == [("m 2", "only kind left"), ("m1", "right")]


def test_late_retries_stay(spark):
    rows = [(1, 1, r, False, False, f"f{r}") for r in range(9)] + [(1, 1, 9, True, True, "")]
    df = spark.createDataFrame(rows, "task_id int, attempt_id int, retry_id int, is_valid_box boolean, is_correct boolean, failure string")
    got = attempts.pass_at_k(df, 1).first()
    assert (got.pass_at_k_success, got.total_attempts, got.total_retries) == (True, 1, 10)
    assert attempts.prior_summaries(df).agg(F.max("n_prior")).first()[0] == 9


def test_steps_pack_by_their_standard_length(spark):
    import random

    rng = random.Random(4)
    equal = [{"type": "think", "content": "x" * 50, "step": 1}] * 24
    mixed = [rng.choice([{"b": "é, \"q\": \\", "a": [1, 2.50, None]}, {"step": 1, "n": {"k": "v,:" * rng.randint(0, 9)}}, "text, s: t", 12, []])
             for _ in range(60)]
    for steps, limit in ((equal, 345), (mixed, 120), (mixed, 10)):
        want, open_, size = [], [], 0
        for step in steps:
            n = len(json.dumps(step, ensure_ascii=False))
            if size + n > limit and open_:
                want.append(open_)
                open_, size = [], 0
            open_, size = [*open_, step], size + n
        want.append(open_)
        df = spark.createDataFrame([(1, json.dumps(steps, ensure_ascii=False))], "i int, process string")
        got = [r.chunk for r in T.pack_chunks(df, "i", limit=limit).orderBy("chunk_no").collect()]
        assert [json.loads(c) for c in got] == want
        assert all(list(g) == list(s) for c, part in zip(got, want) for g, s in zip(json.loads(c), part) if isinstance(s, dict))
