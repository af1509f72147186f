import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.jsontext import has_keys, strict_json
from gradeloom.functions.text import canonical_url, cut_at_paragraph, readable_url
from gradeloom.operators import generation as G, reports as R, search as H
from tests.test_answers import col


@pytest.mark.parametrize("url,want", [
    ("HTTP://WWW.Ex.org/A/b//?q=1#frag", "http://www.ex.org/A/b?q=1"), ("https://ex.org", "https://ex.org/"), ("https://ex.org/a;p=1/b;v=2", "https://ex.org/a;p=1/b"),
    ("ex.org/a/", "://ex.org/a"), ("", ""), (None, ""), ("https://Ex.org?x=/", "https://ex.org/?x=/"),
])
def test_canonical_url(spark, url, want):
    assert col(spark, [(url,)], canonical_url(F.col("a"))) == [want]


@pytest.mark.parametrize("url,want", [
    ("http://a/%E4%B8%AD%2Fx%20y+z", "http://a/中%2Fx%20y+z"), ("http://a/%7Eu%2fb", "http://a/~u%2fb"), ("http://a/100%", "http://a/100%"),
    ("a/%7E", "a/%7E"), ("http://a/%2541", "http://a/%2541"), (None, None),
])
def test_readable_url(spark, url, want):
    assert col(spark, [(url,)], readable_url(F.col("a"))) == [want]


def test_cut_at_paragraph(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", "\n", "\n\n", " "]) for _ in range(rng.randrange(5, 90))) for _ in range(300)]

    def cut(t, n):
        if len(t) <= n:
            return t
        head = t[:n]
        at = head.rfind("\n\n")
        return (head[:at] if at > n * 0.7 else head) + "\n\n[... truncated ...]"

    assert col(spark, texts, cut_at_paragraph(F.col("a"), 40)) == [cut(t, 40) for t in texts]


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1} x', "[1] , [2]", "1, 2", '"s"', "", "{", ' {"a": [1]} ', "null", None]
    ok = col(spark, texts, F.coalesce(strict_json(F.col("a")).isNotNull(), F.lit(False)))
    assert ok == [True, False, False, False, True, False, False, True, True, False]
    assert col(spark, ['{"a":null,"b":1}', '{"a":1}', "[]", "x", None], has_keys(F.col("a"), "a", "b")) == [True, False, False, False, False]


def test_extract_json_modes(spark):
    nested = 'text [1, [2]] and {"a": {"b": 1}} end'
    rows = spark.createDataFrame([(nested,)], "t string")
    get = lambda m: R.extract_json(rows, "t", m).first().json
    assert get("process") == '{"a": {"b": 1}}'
    assert get("tasks") == '{"a": {"b": 1}}'
    assert get("quality") is None  # the short patterns stop at the first closing bracket


@pytest.mark.parametrize("broken,want", [
    ('{"a": "x', '{"a": "x"}'), ('{"a": "x}', '{"a": "x"}'), ('{"a": [1, 2,],} tail', '{"a": [1, 2]}'), ('{"a": "say "hi" now"}', '{"a": "say \\"hi\\" now"}'),
    ("{'a': None}", '{"a": null}'), ("nothing", None), ('{"a": {"b": "c', '{"a": {"b": "c"}}'),
])
def test_repair(spark, broken, want):
    row = R.repair_json(spark.createDataFrame([(1, broken)], "i int, t string"), "t").first()
    assert row.json == want and row.repaired == (want is not None)


def test_merge_chunks(spark):
    rows = [
        ("t", 0, True, '{"core_state": [{"statement": "a", "verification": "Right"}, {"statement": "b", "verification": "Wrong"}]}'),
        ("t", 1, True, '{"statement": "c", "verification": "Right"}'), ("t", 2, True, "junk"), ("t", 3, False, '{"statement": "d"}'),
        ("t", 4, True, '{"core_state": {"statement": "no list"}}'),
    ]
    chunks = spark.createDataFrame(rows, "task_id string, chunk_idx int, ok boolean, json string")
    assert [(r.chunk_idx, r.pos, r.statement) for r in R.merge_chunks(chunks).orderBy("chunk_idx", "pos").collect()] == [
        (0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (4, 0, None)]


def test_segments_are_the_report(spark):
    rng = random.Random(4)
    reports = ["".join(rng.choice(["# Head\n\n", "text line\n", "more. ", "\n\n", "\n \n", "## Sub\n\n"]) for _ in range(30)) for _ in range(100)]
    got = col(spark, reports, R.segments(F.col("a")))
    assert ["".join(g) for g in got] == reports
    assert all(not s.startswith("# Head") or len(s.strip().splitlines()) > 1 or s is g[-1] for g in got for s in g)


def test_markup(spark):
    md = "see [a](http://x) ![p](q.png) <http://y.org>\n\n\n\nend  "
    assert col(spark, [md], H.strip_markdown_links(F.col("a"))) == ["see a  http://y.org\n\nend"]
    pages = spark.createDataFrame([(1, '<html><title>T &amp; U</title><body><script>x("</p>")</script><p>Hi <b>you</b></p><a href="javascript:x">go</a><a href="/r"><i></i></a>'
                                       "<img src='data:image/png;base64,AAAA' alt=\"pic\"></body></html>")], "page_id bigint, html string")
    assert tuple(H.page_text(pages).first()) == (1, "T & U", "Hi you go")
    assert [(r.href, r.text) for r in H.page_links(pages).collect()] == [("", "go")]
    assert [(r.alt, r.src) for r in H.page_images(pages).collect()] == [("pic", "data:image/png;base64...")]


def test_domains_and_templates(spark):
    got = col(spark, ["Climate finance", "Investments", "HR", "Quantum", "misc", " LLMs", "regulation of drugs"], G.normalize_domain(F.col("a")))
    assert got == ["finance", "finance", "education", "science", "tech", "tech", "policy"]
    assert col(spark, ["{b}"], G.fill("{{x}} {a} {a}", a=F.col("a"))) == ["{x} {b} {b}"]


def test_payload(spark):
    text = '{"knowledgeGraph": 1, "organic": [{"snippet": "s", "position": 2}], "credits": 3}'
    keep = col(spark, [text, "no"], H.trim_search_payload(F.col("a"), drop_graph=True, drop_answer=False, drop_snippets=False))
    assert keep == ['{"credits":3,"organic":[{"position":2,"snippet":"s"}]}', "no"]
