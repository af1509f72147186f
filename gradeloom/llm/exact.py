"""Exact duplicates by sorting contents.

Texts are normalised (A-Z lower-cased), range-partitioned by sampled splitters, sorted externally in
their partition, and compared in full with their neighbour. Splitters are drawn from a short leading
key (first characters, hash, salt), so the sample that Spark's range partitioner sends to the driver
stays small however long the texts are. The salt, a hash of the id, splits the run of a text that
makes up much of the table over many partitions; runs of one text that a salt or a splitter has cut are
stitched together by the SHA-256 of the text. The text itself is shuffled once and then dropped.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.common import ascii_lower
from gradeloom.session import cut

LEAD_CHARS = 24
SALTS = 1024


def sorted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, text_sha256, run_head (largest id of its run of equal neighbours)
    and run_pos (place in the run, from 1)."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id", "norm",
        F.substring("norm", 1, LEAD_CHARS).alias("lead"),
        F.xxhash64("norm").alias("h"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    # the window asks for equal (lead, h, salt, norm) together; the range exchange already gives that
    ranged = keyed.repartitionByRange("lead", "h", "salt")
    run = Window.partitionBy("lead", "h", "salt", "norm").orderBy(F.col("doc_id").desc_nulls_last())
    return ranged.select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"),
        F.first("doc_id").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("run_head"),
        F.row_number().over(run).alias("run_pos"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Of equal texts the row with the largest id stays. A null text counts as empty. Null ids are smaller
    than any other; where all ids of a group are null, keep_id is null and one row stays. Rows that
    repeat id and text count one by one, and exactly one of them stays. An empty table gives no rows.
    Other columns, whatever their names, are ignored.
    """
    rows = cut(sorted_runs(docs, id_col, text_col, salts))
    # written out, so that both sides of the join are exchanged and a hot group can be split
    groups = cut(rows.groupBy("text_sha256").agg(
        F.max("run_head").alias("keep_id"), F.count("*").alias("group_size")))
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("run_pos") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that exact_groups keeps: one of each group."""
    stays = exact_groups(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha_kept"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    found = docs.withColumn("__sha", sha).join(
        stays, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__sha_kept")), "left_semi")
    # rows that repeat id and text are one
    return found.dropDuplicates([id_col, "__sha"]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
"""
