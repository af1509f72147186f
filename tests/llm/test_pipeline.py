"""The pipeline: each stage on what the one before kept, against plain versions of their rules."""

import collections

import corpus_pipeline
from gradeloom.llm import minhash
from tests.llm.test_methods import near, passages

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "passage_dedup", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = before.collect(), docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
    before, after = kept["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(labels.get(i) != 0 for i in gone) or len(gone) < 0.2 * len(before)

    before, after = kept["exact_dedup"]
    largest = {}
    for r in before:
        key = r.text.translate({c: c + 32 for c in range(65, 91)})
        largest[key] = max(largest.get(key, -1), r.doc_id)
    assert {r.doc_id for r in after} == set(largest.values())

    before, after = kept["near_dedup"]
    groups = near({r.doc_id: r.text for r in before}, 5, 80)
    assert {r.doc_id for r in after} == {i for i, (_, c) in groups.items() if i == c}

    before, after = kept["passage_dedup"]
    texts = {r.doc_id: r.text for r in before}
    expected = dict(zip(texts, passages([t.encode() for t in texts.values()], corpus_pipeline.PASSAGE_BYTES)))
    assert len(after) == len(before)
    for r in after:
        n, removed, _, _ = expected[r.doc_id]
        assert n - removed - 6 <= len(r.text.encode()) <= n - removed and r.n_chars == (len(r.text) if removed else r.n_chars)

    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    used = collections.Counter()
    for r in after:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_empty_table_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if "text" not in out.columns else out


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert minhash.SIZE > minhash.MATCHES
