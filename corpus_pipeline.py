"""From raw documents to packed training sequences.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame over everything that the one before kept:
toxic documents go, exact copies go, of near copies one stays, long repeated passages are cut out of the
texts, and what is left is tokenised and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import exact, minhash, packing, suffixes, toxicity
from gradeloom.llm.common import table
from gradeloom.session import fresh_path

PASSAGE_BYTES = 240   # about fifty short words: what repeats over this length is cut out
PASSAGE_LEAD = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on the labelled documents among them, does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    # the documents' own columns travel as one, so that none of them can clash with the classifier's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return toxicity.score(rows, model).where("predicted = 0").select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs, words=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.drop_passages(docs, PASSAGE_BYTES, PASSAGE_LEAD)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = packing.tokenise(docs, packing.default_tokenizer())
    return packing.place(packing.with_digest(pieces))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("passage_dedup", drop_passages),
    ("packing", pack),
]

# the classifier, the signatures and the tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
