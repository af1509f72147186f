"""Document fingerprints by a quartile bucket digest.

Byte triplets of a text are hashed into buckets and counted. Each bucket is written as the quartile its
count falls in (two bits), behind a header with the length on a logarithmic scale and the two ratios of
the quartile bounds. Two digests are compared by a difference score with a fixed bound; likeness is one
minus the share of that bound.

The triplets are (first, fourth, seventh byte) and (first, fifth, sixth byte) of a sliding window:
syllables of a language fill adjacent bytes alike in every text, wider gaps tell texts apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BUCKETS = 256
SHAPES = ((0, 3, 7), (0, 4, 6), (0, 5, 11))
HEADER_COST = 12      # most that the header adds to a difference
LENGTH_BASE = 1.15    # one step of the length code


def digest(data: bytes) -> str:
    """Hex digest: length code, ratio nibbles, two bits per bucket. The empty text has one as well."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if data:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        for i, (x, y, z) in enumerate(SHAPES):
            if len(b) > z:
                n = len(b) - z
                h = (b[x:x + n] * np.uint32(0x9E3779B1)) ^ (b[y:y + n] * np.uint32(0x85EBCA77) + np.uint32(i))
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D) ^ (b[z:z + n] * np.uint32(0x27D4EB2F))
                h = (h ^ (h >> np.uint32(13))) * np.uint32(0x165667B1)
                counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    bounds = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(bounds, counts, "left").astype(np.uint8)  # how many bounds lie below the count
    length = min(255, int(np.log(len(data) + 1) / np.log(LENGTH_BASE)))
    top = max(int(bounds[2]), 1)
    ratios = (int(bounds[0]) * 15 // top) << 4 | (int(bounds[1]) * 15 // top)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    return bytes([length, ratios]).hex() + packed.tobytes().hex()


def _parts(digests: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), -1)
    codes = np.stack([raw[:, 2:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(digests), -1)
    return raw[:, 0].astype(int), np.stack([raw[:, 1] >> 4, raw[:, 1] & 15], 1).astype(int), codes.astype(int)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """One minus difference over bound, in 0..1; equal digests give 1.

    A bucket adds its quartile steps, three steps counting as four; the header adds at most HEADER_COST.
    The bound is what two digests of unrelated texts reach on average if quartiles are independent, and
    differences beyond it count as the bound.
    """
    if not left:
        return np.zeros(0)
    (la, ra, ca), (lb, rb, cb) = _parts(left), _parts(right)
    steps = np.abs(ca - cb)
    body = np.where(steps == 3, 4, steps).sum(1)
    head = np.minimum(np.abs(la - lb) // 2 + np.abs(ra - rb).sum(1), HEADER_COST)
    bound = BUCKETS * 1.375 + HEADER_COST
    return 1 - np.minimum(body + head, bound) / bound


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns and `fingerprint`. A null text counts as empty. Row by row, no shuffle."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: digest(t.encode("utf-8", "surrogatepass")))

    udf = F.pandas_udf(run, "string")
    return docs.withColumn("fingerprint", udf(F.coalesce(F.col(text_col), F.lit(""))))


# --- each document against its edited text and its successor --------------------------------------------

def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the first of `following`, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FIRST = -(1 << 63)


def with_successor(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(part, peek, key, doc_id, text): documents dealt out by ranges of ids, each range followed by a copy
    of the document that comes after its last (peek = 1).

    Range bounds are quantiles of the ids, `ranges` of them, so the text is shuffled once and never
    sorted as a whole; the copies are one document per range. Null ids come first, and rows that repeat
    an id lie in one range.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("key"))
    bounds = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100_000).alias("q"))
    found = bounds.first()["q"] or []
    splits = sorted(set(found))
    dealt = rows.withColumn("part", _bucket("key", splits))
    heads = sorted((r["part"], r["head"]) for r in
                   dealt.groupBy("part").agg(F.min("key").alias("head")).collect())
    # the head of a range is also what follows the last of the range before; the first follows the very last
    before = {p: heads[i - 1][0] for i, (p, _) in enumerate(heads)}
    head_of = {h: before[p] for p, h in heads}
    peek_at = _lookup("key", head_of)
    return dealt.withColumn("peek_at", peek_at).select(
        "doc_id", "text", "key",
        F.explode(F.when(F.col("peek_at").isNull(), F.array(F.struct("part", F.lit(0).alias("peek"))))
                  .otherwise(F.array(F.struct("part", F.lit(0).alias("peek")),
                                     F.struct(F.col("peek_at").alias("part"), F.lit(1).alias("peek"))))).alias("at")
    ).select("at.part", "at.peek", "key", "doc_id", "text")


def _bucket(column: str, splits: list[int]):
    """Number of splits below the value, by binary search in a batch; `splits` has one entry per range."""
    table = np.array(splits, dtype=np.int64)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(np.searchsorted(table, values.to_numpy(), "left").astype(np.int32))

    return F.pandas_udf(run, "int")(F.col(column))


def _lookup(column: str, table: dict[int, int]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(table).astype("Int32")

    return F.pandas_udf(run, "int")(F.col(column))


def edit_report(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger (doc_id, text); after the last comes the first, and
    a table of one row follows itself. Null ids come first. A null text counts as empty. Rows that repeat
    an id follow each other in the order of their texts. An empty table gives no rows; other columns are
    ignored.
    """
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def report(ids: list, texts: list[str]) -> pd.DataFrame:
        """All but the last text, each with its successor."""
        own = [t.encode("utf-8", "surrogatepass") for t in texts]
        new = [edited(a, b).encode("utf-8", "surrogatepass") for a, b in zip(texts, texts[1:])]
        prints, changed = [digest(x) for x in own], [digest(x) for x in new]
        out = pd.DataFrame({
            "doc_id": pd.array(ids[:-1], dtype="Int64"), "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(x).hexdigest() for x in new],
            "fingerprint": prints[:-1], "edited_fingerprint": changed,
            "near_edited": likeness(prints[:-1], changed), "near_next": likeness(prints[:-1], prints[1:])})
        return out[columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_part, held_id, held_text, ended = None, None, None, True
        for batch in batches:
            at = 0
            parts, peeks = batch["part"].to_numpy(), batch["peek"].to_numpy()
            ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            texts = batch["text"].tolist()
            while at < len(batch):
                end = at
                while end < len(batch) and end - at < 400 and parts[end] == parts[at] and not peeks[end]:
                    end += 1
                if end < len(batch) and parts[end] == parts[at] and peeks[end]:
                    stop, last = end + 1, True
                else:
                    stop, last = end, False
                group_ids, group_texts = ids[at:stop], texts[at:stop]
                if held_part == parts[at] and not ended:
                    group_ids, group_texts = [held_id, *group_ids], [held_text, *group_texts]
                elif held_part == parts[at] and ended:
                    at = stop  # further rows that repeat the id of the peeked document
                    continue
                if len(group_texts) > 1:
                    yield report(group_ids, group_texts)
                held_part, held_id, held_text, ended = parts[at], group_ids[-1], group_texts[-1], last
                at = stop

    dealt = with_successor(docs, ranges)
    sorted_ = dealt.repartition("part").sortWithinPartitions("part", "peek", "key", "text")
    return sorted_.mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
