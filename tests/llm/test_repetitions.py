"""Runs of words against their definition."""

import hashlib
import zlib

import duckdb
from hypothesis import given, settings, strategies as st

from gradeloom.llm import queries, repetitions as R

SF = "/root/testdata/sf0.001"


def plain_lyndon(w):
    def is_lyndon(x):
        return all(x < x[k:] for k in range(1, len(x)))

    return [max(n for n in range(1, len(w) - i + 1) if is_lyndon(w[i:i + n])) for i in range(len(w))]


def plain_runs(w, least=24, periods=3):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, periods * q):
                run = w[start:start + length]
                if all(run[p:] != run[:-p] for p in range(1, q)):
                    out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14))
def test_lyndon_array(words):
    assert R.lyndon_array(words) == plain_lyndon(words)


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=9), st.integers(1, 8)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(pieces, st.sampled_from([(24, 3), (6, 3), (2, 2), (5, 2), (12, 4)]))
def test_runs(parts, limits):
    words = [w for part, times in parts for w in part * times]
    assert R.find_runs(words, *limits) == plain_runs(words, *limits)


def test_long_runs():
    assert R.find_runs([1] * 30000) == [(0, 30000, 1)]
    words = list(range(500)) + [7, 8, 9] * 10000 + [7, 1, 2]
    assert R.find_runs(words) == [(500, 30001, 3)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    assert R.find_runs(fib[-1], 12, 3) == plain_runs(fib[-1], 12, 3)


def test_query_against_definition(spark):
    rows = {r.doc_id: r for r in queries.op12_word_runs(spark, SF).collect()}
    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(rows) == len(texts)
    hits = 0
    for doc_id, text in texts:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        # a run of these lengths holds strings of eight words again one period later: without any, no run
        strings = [tuple(words[i:i + 8]) for i in range(n - 7)]
        runs = plain_runs(words) if len(set(strings)) < len(strings) and n < 3000 else R.find_runs(words)
        hits += len(runs) > 0
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        row = rows[doc_id]
        assert row.n_runs == len(runs)
        if runs:
            best = max(runs, key=lambda r: (r[1] * 10 ** 9 // r[2], -r[0], -r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert hits >= 5


ROWS = [(1, "ab " * 40 + "end"), (1, "ab " * 40 + "end"), (2, None), (None, ""), (None, "x\ty\n" * 30), (2 ** 60 + 1, "short"),
        (4, "so it goes on " * 40_000)]


def test_special_cases(spark):
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in ROWS], "doc_id long, text string, start long, period int")
    got = sorted(((r.doc_id, r.start, r.length, r.period) for r in R.word_runs(docs).collect()), key=str)
    assert got == sorted([(1, 0, 40, 1)] * 2 + [(None, 0, 60, 2), (4, 0, 160_000, 4)], key=str)
    kept = R.collapse_runs(docs)
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert texts == sorted([(1, "ab end")] * 2 + [(2, None), (None, ""), (None, "x y"), (2 ** 60 + 1, "short"), (4, "so it goes on")], key=str)
    report = R.run_report(docs)
    assert report.count() == len(ROWS) and report.where(f"doc_id = {2 ** 60 + 1}").count() == 1
    assert report.where("doc_id = 2").first().n_runs == 0
    assert R.run_report(docs.limit(0)).count() == 0 and R.word_runs(docs.limit(0)).count() == 0
