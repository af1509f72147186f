"""Nulls, empty and long texts, repeated rows, clashing column names and empty tables, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import exact, fingerprints, language, lines, minhash, packing, pieces, suffixes, toxicity, urls

LONG = "a long story about the same old river and its many bends " * 3000
CLASHES = ("lang string, source string, n_chars long, kept boolean, node long, label long, text_sha256 string, "
           "row long, spans string, key long, part int, peek int, norm string, lead string, h long, salt int, "
           "token long, score double, predicted int, held_out boolean, ids string, length long, piece int, "
           "signature string, fingerprint string, host string, verdict string, component_id long")
ROWS = [
    (1, "One small text of seven short words"), (1, "One small text of seven short words"),
    (2, "ONE small text of seven SHORT words"), (3, None), (4, ""), (None, "no id here"), (None, None),
    (5, LONG), (6, LONG + "end"), (7, "123 456 !!"), (8, "é"), (8, "another text with the id eight"),
]


@pytest.fixture(scope="module")
def docs(spark):
    n = len(CLASHES.split(", ")) - 3
    rows = [(i, t, "en" if k % 2 else "fr", "s", 0, *[None] * n) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + CLASHES)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 0, 0), (2, 1, 1), (2, 1, 0), (5, None, 1), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def pages(spark):
    html = "<nav><a href='/'>Home</a></nav><p>Page {}</p><p></p><footer>Foot</footer>"
    rows = [(i, f"http://A.Example.net/en/{i}", html.format(i), "x", "y") for i in range(6)]
    rows += [(6, None, None, "x", "y"), (None, "no scheme", "<p>text</p>", "x", "y"), (6, None, None, "x", "y"),
             (7, "https://www.example.com/de/x?q#f", "", "x", "y"), (8, "ftp://NET", "plain\n", "x", "y"),
             (9, "://org/fr/" + "x" * 50000, "<p>" + "y " * 50000, "x", "y")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string, line string")


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=str)


ALL = sorted((i for i, _ in ROWS), key=str)


def test_exact_groups(docs, none):
    out = exact.exact_groups(docs)
    assert ids(out) == ALL
    rows = {(r.doc_id, r.text_sha256): r for r in out.collect()}
    same = hashlib.sha256(b"one small text of seven short words").hexdigest()
    assert (rows[2, same].keep_id, rows[2, same].group_size, rows[2, same].kept) == (2, 3, True)
    assert not rows[1, same].kept
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[4, empty].kept and rows[3, empty].keep_id == 4 and rows[None, empty].group_size == 3
    assert exact.exact_groups(none).count() == 0


def test_one_of_rows_that_repeat_stays(spark):
    twin = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x"), (None, "X")], "doc_id long, text string")
    assert exact.exact_groups(twin).where("kept").count() == 2
    assert exact.drop_copies(twin).count() == 2


def test_drop_copies_keeps_columns(docs, none):
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns and out.count() == 8
    assert exact.drop_copies(none).count() == 0


def test_packing(docs, none):
    out = packing.pack(docs, packing.default_tokenizer(), capacity=64)
    rows = out.collect()
    assert sorted({r.doc_id for r in rows}, key=str) == sorted({i for i, _ in ROWS}, key=str)
    assert all(1 <= r.length <= 64 and r.length * 4 == len(r.ids) for r in rows)
    assert sum(r.length == 1 for r in rows if r.doc_id in (3, 4)) == 2
    assert packing.pack(none, packing.default_tokenizer()).count() == 0


def test_language(docs, none):
    out = {(r.doc_id, r.lang_pred) for r in language.language_report(docs).collect()}
    assert {p for d, p in out if d in (3, 4, 7)} == {"und"}
    assert {p for d, p in out if d in (2, 5, 6)} <= {"en", "fr", "und"}
    assert language.language_report(docs).count() == len(ROWS)
    assert language.language_report(none).count() == 0


def test_urls(spark, pages):
    rules = urls.rule_table(spark, urls.SITE_RULES + urls.WORD_RULES)
    rows = urls.judge(pages, rules).collect()
    assert len(rows) == 12
    by = {r.page_id: r for r in rows}
    assert (by[0].host, by[0].path, by[0].rule, by[0].verdict) == ("a.example.net", "/en/0", "example.net/en/", "allow")
    assert (by[6].host, by[6].path, by[6].rule, by[6].verdict) == ("", "", None, "allow")
    assert (by[7].host, by[7].path, by[7].rule, by[7].verdict) == ("www.example.com", "/de/x", "example.com/de/", "block")
    assert (by[8].host, by[8].path, by[8].rule) == ("net", "", None)
    assert by[9].rule == "org/fr/"
    assert by[None].host == ""
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_fingerprints(docs, none):
    rows = fingerprints.edit_report(docs, ranges=3).collect()
    assert sorted((r.doc_id for r in rows), key=str) == ALL
    order = sorted(((i if i is not None else -1, t or "") for i, t in ROWS))
    chain = {}
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        chain.setdefault(i, []).append(hashlib.sha256(fingerprints.edited(t, following).encode()).hexdigest())
    got = {}
    for r in rows:
        got.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r.edited_sha256)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in chain.items()}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.edit_report(none).count() == 0
    assert fingerprints.edit_report(docs.where("doc_id = 2")).first().near_next == 1


def test_passages(docs, none):
    out = suffixes.passage_report(docs)
    assert ids(out) == ALL
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[5].n_removed == rows[5].n_bytes == len(LONG) and rows[5].n_spans == 1
    assert rows[6].n_bytes - rows[6].n_removed == 3
    assert rows[3].n_bytes == 0 and rows[1].n_removed == 0
    kept = suffixes.drop_passages(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert kept.where("doc_id = 6").first().text == "end"
    assert suffixes.passage_report(none).count() == 0


def test_near_groups(docs, none):
    out = minhash.near_groups(docs, words=4)
    assert ids(out) == ALL
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()]
    assert (2, 4, 1, False) in rows and rows.count((1, 4, 1, True)) == 2
    assert (3, 0, 3, True) in rows and (4, 0, 4, True) in rows and (None, 0, None, True) in rows
    assert (6, [r for r in rows if r[0] == 6][0][1], 5, False) in rows
    assert minhash.near_groups(none).count() == 0
    assert minhash.drop_near_copies(docs).columns == docs.columns


def test_lines(pages):
    rows = lines.drop_site_lines(pages).collect()
    assert len(rows) == 12
    by = {r.page_id: r for r in rows}
    assert (by[2].n_lines, by[2].n_dropped, by[2].kept_text) == (3, 2, "Page 2")
    assert (by[6].n_lines, by[6].kept_text) == (0, "")
    assert lines.drop_site_lines(pages.limit(0)).count() == 0


def test_toxicity(docs, none, labels):
    out = toxicity.toxicity_report(docs, labels)
    assert ids(out) == ALL
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.toxicity_report(none, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity_report(docs, labels.limit(0)).collect()} == {0}


def test_pieces(docs, none):
    rows = pieces.piece_report(docs, pieces.default_model()).collect()
    assert sorted((r.doc_id for r in rows), key=str) == ALL and all(r.round_trip for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (3, 4)} == {0}
    assert pieces.piece_report(none, pieces.default_model()).count() == 0


def test_held_out_of_null_id(spark):
    from gradeloom.llm.common import held_out

    row = spark.range(1).select(held_out(F.lit(None).cast("long")).alias("h")).first()
    assert row.h is True


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    near = " ".join(f"word{i}" for i in range(60))
    rows = [(5, near), (8, near + " more"), (8, "quite another text that resembles nothing else in here"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in minhash.drop_near_copies(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[3]], key=str)


def test_lines_of_small_hosts(spark):
    pages = spark.createDataFrame(
        [(1, "http://two.org/a", "<p>Menu</p><p>A</p>"), (2, "http://two.org/b", "<p>Menu</p><p>B</p>"), (3, "http://one.org/", "<p>Menu</p>")],
        "page_id long, url string, html string")
    assert {r.page_id: r.kept_text for r in lines.drop_site_lines(pages).collect()} == {1: "A", 2: "B", 3: "Menu"}


def test_examples_are_different_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda raw, langs: seen.append(langs))
    rows = [(1, "the same words", "en")] * 30 + [(1, f"other words {'x' * k}", "en") for k in range(9)] + [(2, "des mots", "fr")]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=5)
    assert sorted(seen[0]) == ["en"] * 5 + ["fr"]
    texts = []
    monkeypatch.setattr(toxicity, "train", lambda t, y: texts.append(sorted(zip(t, y))))
    a, b, c = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5][:3]   # not held out
    docs = spark.createDataFrame([(a, "a"), (a, "a"), (a, "b"), (b, "c"), (b, "c"), (c, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (a, 1), (b, 0), (c, 0)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, {0: 9, 1: 9})
    assert texts == [[("", 0), ("a", 1), ("b", 1), ("c", 0)]]


def test_other_models_are_refused():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()).serialized_model_proto())
    assert model.trainer_spec.model_type == pieces.BPE


def test_entries_of_other_chunks():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def across(strings, starts):
        entries = np.zeros(len(strings), suffixes._ENTRY)
        entries["string"], entries["start"] = strings, starts
        frame = next(suffixes._across(iter([pd.DataFrame({"part": [0, 0], "entries": [entries[:1].tobytes(), entries[1:].tobytes()]})])))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.Array.from_pandas(frame["marks"], type=kind).to_pylist()

    assert across([1, 2, 3], [0, 1, -1]) == []     # nothing repeats: no rows, of the right type
    assert across([5, 5, 7], [3, -1, 4]) == [[{"first": 3, "last": 3}]]
    assert across([5, 5, 6, 6], [3, -1, 4, -1]) == [[{"first": 3, "last": 4}]]


def test_hot_and_other_hosts_lose_the_same_lines(spark, monkeypatch):
    rows = [(i, f"http://{'hot' if i % 2 else f'h{i % 40}'}.org/{i}", f"<p>Menu</p><p>Page {i}</p>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, lines.drop_site_lines(pages).collect()))
    for shares, most in (((3, 2), 1 << 20), ((1, 1), 1 << 20), ((1000, 3), 0), ((1, 1), 0)):
        monkeypatch.setattr(lines, "HOT", shares)
        monkeypatch.setattr(lines, "HOT_BYTES", most)
        assert sorted(map(tuple, lines.drop_site_lines(pages).collect())) == want
    assert all(r[4] == f"Page {r[0]}" for r in want)
