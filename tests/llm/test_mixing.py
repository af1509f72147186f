"""Mixing of sources: targets against the rule read literally, draws, and special cases."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gradeloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = share * sum(sizes.values())
    stopped = set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(cap * sizes[s] for s in stopped)
        target = {s: cap * sizes[s] if s in stopped else rest * w[s] / sum(w[o] for o in free) for s in names}
        above = {s for s in free if target[s] > cap * sizes[s]}
        if not above:
            return target
        stopped |= above


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.one_of(st.none(), st.text("abé𝄞z", max_size=3)), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)


def test_targets_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    sizes = {f"s{k:03}": (k * k * 7919) % 1000 + 1 for k in range(60)}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in want)


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(20000).selectExpr(
        "id AS doc_id", "concat('s', id % 7 * (id % 3)) AS source", "repeat('word ', cast(1 + id % 50 AS int)) AS text")
    rows = mixing.mix_report(docs)
    per = rows.groupBy("source_size", "target").agg({"taken": "sum"}).collect() if "source" in rows.columns else \
        rows.groupBy("source_size", "target").sum("taken").collect()
    for size, target, taken in per:
        assert abs(taken - target) < 5 * math.sqrt(0.25 * size * 50)
    assert sum(r[1] for r in per) == pytest.approx(1.5 * sum(r[0] for r in per))
    again = mixing.mix_report(docs.repartition(7))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    copies = {r.doc_id: r.copies for r in rows.collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}


def test_many_sources_take_the_shuffled_way(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 > 1 THEN concat('s', id % 700) END AS source", "'a b' AS text")
    want = sorted(map(tuple, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "HOT", 2)
    assert sorted(map(tuple, mixing.mix_report(docs).collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(mixing, "HOT", 4)
    assert sorted(map(tuple, mixing.mix_report(docs).collect()), key=str) == sorted(want, key=str)


def test_special_cases(spark):
    rows = [(1, "a b\tc\r\n d", "x"), (1, "a b\tc\r\n d", "x"), (2, None, "x"), (3, "", None), (None, "e f g", None), (4, "w " * 50_000, "y")]
    docs = spark.createDataFrame([(*r, 1, "t", 0) for r in rows], "doc_id long, text string, source string, size int, target string, copies int")
    got = sorted(((r.doc_id, r["size"], r.source_size) for r in mixing.mix_report(docs).collect()), key=str)
    assert got == sorted([(1, 4, 8)] * 2 + [(2, 0, 8), (3, 0, 2), (None, 2, 2), (4, 50_000, 50_000)], key=str)
    assert all(r.taken <= 2 * r["size"] for r in mixing.mix_report(docs).collect())
    assert mixing.mix(docs).columns == docs.columns
    empty = docs.withColumn("text", docs["text"].substr(1, 0))
    assert {(r.target, r.taken) for r in mixing.mix_report(empty).collect()} == {(0.0, 0)}
    assert mixing.mix_report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.source_targets(docs, share=3)
