import json

import pytest

from gradeloom.sources import entries as E, sinks


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_entry_arrays(spark, tmp_path):
    put(tmp_path, "glm_text.json", json.dumps([
        {"id": 1, "rewritten_query": "", "query": "q", "response": "r", "files": []}, {"id": "x", "rewritten_query": "rw", "query": "q", "response": "r2", "files": [{"dir": "d"}]},
        {"id": 3, "response": ""}]))
    put(tmp_path, "bad.json", "{not json")
    got = {r.task_id: (r.user_query, r.files) for r in E.load_entries_array(spark, str(tmp_path)).collect()}
    assert set(got) == {"glm_text/1", "glm_text/x"} and got["glm_text/1"] == ("q", None) and got["glm_text/x"][0] == "rw"
    assert [r.stem for r in E.unreadable_files(spark, str(tmp_path)).collect()] == ["bad"]


def test_query_precedence(spark):
    df = spark.createDataFrame([("", "rw"), (None, "rw"), ("q", "")], "query string, rewritten_query string")
    assert [tuple(r) for r in df.select(E.query_text().alias("a"), E.query_text(False).alias("b")).collect()] == [("rw", ""), ("rw", "rw"), ("q", "q")]


def test_task_lines(spark, tmp_path):
    put(tmp_path, "t.jsonl", '{"task_id": "1", "task_question": "q", "file_path": "a.txt", "metadata": {"k": 1}}\n\n{"task_id": "2", "task_question": "q", "file_path": ["a", "b"]}\n{oops\n')
    got = {r.task_id: (r.file_path, r.ground_truth) for r in E.load_tasks_jsonl(spark, str(tmp_path)).collect()}
    assert got == {"1": (["a.txt"], ""), "2": (["a", "b"], "")}
    assert E.rejected_lines(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="unreadable task line"):
        E.load_tasks_jsonl(spark, str(tmp_path), on_bad="fail").collect()


def test_task_folders(spark, tmp_path):
    put(tmp_path, "m1/a.json", json.dumps({"query_id": 7, "topic": "T", "entries": [{"query": "q", "response": "r"}, {"query": "no"}]}))
    put(tmp_path, "m1/b.json", json.dumps({"query": "q2", "response": "r2", "entries": [], "attachments": "f.txt"}))
    put(tmp_path, "m2/c.json", json.dumps({"user_query": "q3", "response": "r3"}))
    put(tmp_path, "m2/d.json", json.dumps({"rewritten_query": "q4", "response": "r4"}))
    put(tmp_path, "m2/e.json", json.dumps({"query": "q5", "response": ""}))
    put(tmp_path, "m2/f.json", "[]")
    got = {r.task_id: (r.user_query, r.task_question, r.topic, r.file_path) for r in E.load_tasks_dir(spark, str(tmp_path)).collect()}
    assert got == {"m1/a": ("q", "r", "T", None), "m1/b": ("q2", "r2", None, "f.txt"), "m2/c": ("q3", "r3", None, None)}


def test_result_file_choice(spark, tmp_path):
    for name in ("a_text_2.json", "a_text_1.json", "a_multimodal_0.json", "b_multimodal.json", "ab_text.json"):
        put(tmp_path, name, json.dumps([{"id": 1, "response": name}]))
    got = {r.model: r.response for r in E.load_results_glob(spark, str(tmp_path), ["a", "b", "c"]).collect()}
    assert got == {"a": "a_text_1.json", "b": "b_multimodal.json"}


def test_score_cells(spark, tmp_path):
    put(tmp_path, "f.json", json.dumps({"71": {"m": {"right": 4, "wrong": 1, "conflict": 0, "unknown": 2}, "n": None}, "72": {"n": {"right": 1, "wrong": 0, "conflict": 0, "unknown": 0}}}, indent=1))
    assert sorted(tuple(r) for r in E.load_score_cells(spark, str(tmp_path)).collect()) == [("71", "m", 4, 1, 0, 2), ("72", "n", 1, 0, 0, 0)]
    put(tmp_path / "p", "p.json", json.dumps({"1": {"m": {"intrinsic": {"efficiency": 6}, "alignment": {"contradiction": 7}, "_overall_from_per_task": 7.03}}}))
    assert E.load_score_cells(spark, str(tmp_path / "p"), "process").first()["_overall_from_per_task"] == 7.03


def test_items_and_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "m_1"), (2, "y", "m_2")], "id int, response string, item string")
    back = spark.read.json(sinks.write_items(df, str(tmp_path / "items")))
    assert sorted((r.id, r.item) for r in back.collect()) == [(1, "m_1"), (2, "m_2")]
    tasks = spark.createDataFrame([(1,), (2,)], "task_id int")
    tries = spark.createDataFrame([(1, 2, 0, "b", "completed", True, True), (1, 1, 0, "", "failed", False, False)],
                                  "task_id int, attempt_id int, retry_id int, answer string, status string, is_valid_box boolean, is_correct boolean")
    rows = {r.task_id: r.attempts for r in spark.read.json(sinks.write_results(tasks, tries, str(tmp_path / "r"))).collect()}
    assert [a.attempt_id for a in rows[1]] == [1, 2] and rows[2] is None
