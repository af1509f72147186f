"""Removal of long repeated passages by sorting suffixes.

A byte goes if a string of WIDTH bytes that covers it starts anywhere else in the table as well. To find
such strings exactly, one would sort the suffix of every byte. Three steps avoid most of that:

1. Each start s has an anchor: the least hash among the LEAD-byte strings within [s, s + WIDTH). Equal
   strings have equal anchors, and consecutive starts mostly share one, so a text is a list of stretches
   (anchor, starts lo..hi), one per 180 bytes or so. Stretches are counted, before the shuffle, by anchor
   and by the hash of all bytes they cover. An anchor that occurs once repeats nothing; a stretch seen twice
   repeats all of its starts. Neither needs its bytes again.
2. The rest (stretches that differ, but share an anchor with another, or hold theirs more than once) send their bytes to be sorted:
   range-partitioned by sampled splitters on the anchor, the tokens that lead the suffixes, then sorted
   in their bucket by multikey quicksort: by the first character, ties by the next, and so on, a
   character here being a block of bytes. Neighbours that tie to the end are repeats.
3. An anchor whose stretches lie in several buckets (its bucket's least or greatest, and that of another one too)
   is compared across the boundary: its suffixes are counted once more by their hash over the whole table. A
   hot anchor spans many buckets, and none of them holds more than its share of bytes.

Memory: a bucket is read as a stream in chunks of CHUNK starts and one anchor more. Texts move twice, bytes to be sorted once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gradeloom.session import cut

WIDTH = 400      # bytes of a string that must not repeat
LEAD = 48        # bytes of the leading string that serves as anchor
BLOCK = 100      # bytes of one character of the sort
CHUNK = 1 << 20  # starts sorted at once
PART = 1 << 20   # bytes of stretches whose starts are compared at once between chunks
PIECE = 1 << 22  # bytes of a text hashed at once

_BYTES = np.random.default_rng(20240301).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: np.uint64, n: int) -> np.ndarray:
    key = str(which)
    if key not in _powers or len(_powers[key]) < n:
        _powers[key] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, which)]), dtype=np.uint64)
    return _powers[key][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sums(data: bytes) -> np.ndarray:
    """Running sums from which the hash of any stretch follows."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _power(_STEP, len(raw)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    return _mix((sums[start + size] - sums[start]) * _power(_BACK, len(sums))[start])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window: running minima from both sides of blocks of the window's size."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.uint64(2 ** 64 - 1))
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def stretches(data: bytes, width: int, lead: int) -> tuple[np.ndarray, ...]:
    """anchor, hash of the bytes covered, first start, last start, and whether the anchor occurs more than
    once, of each run of starts with one anchor."""
    anchors, covers, lows, highs, again = [], [], [], [], []
    for at in range(0, max(len(data) - width + 1, 0), PIECE):
        part = data[at:at + PIECE + width - 1]
        sums = _sums(part)
        leads = _hashes(sums, np.arange(len(part) - lead + 1), lead)
        least = _least(leads, width - lead + 1)
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        lo = np.concatenate([[0], change])
        hi = np.concatenate([change, [len(least)]]) - 1
        anchors.append(least[lo])
        covers.append(_hashes(sums, lo, hi - lo + width) ^ _mix((hi - lo).astype(np.uint64)))
        lows.append(lo + at)
        highs.append(hi + at)
        again.append(np.array([np.count_nonzero(leads[a:b + width - lead + 1] == least[a]) > 1
                               for a, b in zip(lo.tolist(), hi.tolist())]))
    if not anchors:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool)
    return (np.concatenate(anchors).view(np.int64), np.concatenate(covers).view(np.int64),
            np.concatenate(lows), np.concatenate(highs), np.concatenate(again))


def multikey_sort(characters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are equal in all characters to another row: (row numbers, group numbers), ties together.

    Multikey quicksort by columns: rows are sorted by their first character, and only runs of ties are
    sorted by the next.
    """
    rows = np.arange(len(characters[0]))
    group = np.zeros(len(rows), np.int64)
    for column in characters:
        order = np.lexsort((column[rows], group))
        rows, group = rows[order], group[order]
        value = column[rows]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])]) if len(rows) else np.zeros(0, bool)
        group = np.cumsum(new)
        tied = np.bincount(group)[group] > 1 if len(rows) else np.zeros(0, bool)
        rows, group = rows[tied], group[tied]
    return rows, group


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted numbers as (first, last) of each run without a gap."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], edge + 1])].tolist(), starts[np.concatenate([edge, [len(starts) - 1]])].tolist()))


_ENTRY = np.dtype([("string", "<i8"), ("anchor", "<i8"), ("cover", "<i8"), ("start", "<i4")])
_FOUND = "anchor long, cover long, marks array<struct<first:long,last:long>>, part int, entries binary"


def _sort_chunk(rows: list[tuple], width: int, outer: set) -> tuple[list[tuple], np.ndarray]:
    """Repeats among the stretches (anchor, cover, whole, bytes) of a chunk, sorted by anchor.

    Gives (anchor, cover, runs of repeated starts) of each stretch that has any, and entries to compare with
    other chunks, for `outer` anchors, which lie in several: all starts that are alone here, and of those that
    repeat here one of each kind, marked by a start of -1, to answer for the rest. Of stretches known to repeat as a whole no
    start is reported; they only answer.
    """
    size = np.array([len(b) - width + 1 for *_, b in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    sums = _sums(b"".join(b for *_, b in rows))
    base = np.cumsum([0] + [len(b) for *_, b in rows])[:-1]
    start = base[owner] + inside
    anchor = np.array([r[0] for r in rows], np.int64)
    cover = np.array([r[1] for r in rows], np.int64)
    known = np.array([r[2] for r in rows], bool)
    block = -(-width // -(-width // BLOCK))
    columns = [anchor[owner]]
    columns += [_hashes(sums, start + at, min(block, width - at)).view(np.int64) for at in range(0, width, block)]
    repeated, kind = multikey_sort(columns)
    found = np.zeros(len(start), bool)
    found[repeated] = True
    answered = found.copy()
    answered[repeated[np.concatenate([[True], kind[1:] != kind[:-1]])] if len(kind) else repeated] = False
    edges = np.concatenate([[0], np.cumsum(size)])
    marks = [(a, c, [{"first": x, "last": y} for x, y in _runs(np.flatnonzero(found[edges[i]:edges[i + 1]]))])
             for i, (a, c, whole, _) in enumerate(rows) if not whole and found[edges[i]:edges[i + 1]].any()]
    asks = np.flatnonzero(~answered & np.isin(anchor, list(outer))[owner]) if outer else np.zeros(0, np.int64)
    entries = np.zeros(len(asks), _ENTRY)
    entries["string"] = _hashes(sums, start[asks], width).view(np.int64)
    entries["anchor"], entries["cover"] = anchor[owner[asks]], cover[owner[asks]]
    entries["start"] = np.where(known[owner[asks]] | found[asks], -1, inside[asks])
    return marks, entries


def _repeats(batches: Iterator[pd.DataFrame], width: int, split: set, parts: int, chunk: int) -> Iterator[pd.DataFrame]:
    """Chunks of one bucket, which arrives sorted by anchor. A chunk ends between anchors; only an anchor with more than
    `chunk` starts is cut, and like those in `split`, which several buckets hold, compared once more: its entries
    go out packed, by the `parts` that their strings fall into."""
    def flush(rows: list[tuple], cut_anchors: set) -> pd.DataFrame:
        marks, entries = _sort_chunk(rows, width, split | cut_anchors)
        part = entries["string"].astype(np.uint64) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        packed = [(int(part[group[0]]), entries[group].tobytes())
                  for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(group)]
        n, m = len(marks), len(packed)
        # nullable from the start: a detour over floating point would round the hashes
        return pd.DataFrame({
            "anchor": pd.array([r[0] for r in marks] + [None] * m, dtype="Int64"),
            "cover": pd.array([r[1] for r in marks] + [None] * m, dtype="Int64"),
            "marks": pd.Series([r[2] for r in marks] + [None] * m, dtype=object),
            "part": pd.array([None] * n + [p for p, _ in packed], dtype="Int32"),
            "entries": pd.Series([None] * n + [e for _, e in packed], dtype=object)})

    rows: list[tuple] = []
    starts, since, before = 0, 0, set()   # all starts held, those of the last anchor, an anchor cut just before
    for batch in batches:
        for row in zip(batch["anchor"].tolist(), batch["cover"].tolist(), batch["whole"].tolist(), batch["bytes"]):
            if rows and row[0] != rows[-1][0]:
                if starts >= chunk:
                    yield flush(rows, before)
                    rows, starts, before = [], 0, set()
                since = 0
            elif rows and since >= chunk:
                yield flush(rows, before | {row[0]})
                rows, starts, since, before = [], 0, 0, {row[0]}
            rows.append(row)
            starts += len(row[3]) - width + 1
            since += len(row[3]) - width + 1
    if rows:
        yield flush(rows, before)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of all chunks, sorted by part: (anchor, cover, marks) of starts whose string another chunk has too."""
    def repeated(entries: np.ndarray) -> pd.DataFrame:
        _, which, times = np.unique(entries[["anchor", "string"]], return_inverse=True, return_counts=True)
        hits = entries[(times[which] > 1) & (entries["start"] >= 0)]
        hits = np.unique(hits[["anchor", "cover", "start"]])
        ends = np.flatnonzero((hits["cover"][1:] != hits["cover"][:-1]) | (hits["anchor"][1:] != hits["anchor"][:-1])) + 1
        groups = [g for g in np.split(hits, ends) if len(g)]
        return pd.DataFrame({
            "anchor": np.array([g["anchor"][0] for g in groups], np.int64), "cover": np.array([g["cover"][0] for g in groups], np.int64),
            "marks": pd.Series([[{"first": int(x), "last": int(y)} for x, y in _runs(g["start"])] for g in groups], dtype=object)})

    held: list[bytes] = []
    last = None
    for batch in batches:
        for part, entries in zip(batch["part"], batch["entries"]):
            if part != last and held:
                yield repeated(np.frombuffer(b"".join(held), _ENTRY))
                held = []
            held.append(entries)
            last = part
    if held:
        yield repeated(np.frombuffer(b"".join(held), _ENTRY))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds `__id` and `__hash`, a key that only rows of equal id and text share."""
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn(
        "__hash", F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))))


KEY = ["__id", "__hash"]


def repeated_spans(docs: DataFrame, width: int = WIDTH, lead: int = LEAD) -> DataFrame:
    """(KEY, spans): for rows with repeats, all [start, end) in bytes that repeated strings cover; they may
    overlap. `docs` has the columns KEY (see `_keyed`) and text, which is not null."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 400):
                part = batch.iloc[at:at + 400]
                got = [stretches(t.encode("utf-8", "surrogatepass"), width, lead) for t in part["text"]]
                n = [len(g[0]) for g in got]
                yield pd.DataFrame({
                    **{k: np.repeat(part[k].to_numpy(), n) for k in KEY}, "anchor": np.concatenate([g[0] for g in got]),
                    "cover": np.concatenate([g[1] for g in got]), "lo": np.concatenate([g[2] for g in got]),
                    "hi": np.concatenate([g[3] for g in got]), "again": np.concatenate([g[4] for g in got])})

    keys = ", ".join(f"{k} long" for k in KEY)
    found = cut(docs.select(*KEY, "text").mapInPandas(
        find, f"{keys}, anchor long, cover long, lo long, hi long, again boolean"))

    # stretches with equal bytes, and anchors with several of them or several times in one
    kinds = cut(found.groupBy("anchor", "cover").agg(
        F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct(*KEY, "lo", "hi")).alias("one")))
    several = cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("several")))
    unsure = cut(kinds.join(several, "anchor", "left").where("several OR again").select("anchor", "cover", (F.col("n") > 1).alias("whole"), "one.*"))

    # their bytes; stretches that repeat as a whole only answer for others
    asked = unsure.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "cover", "whole", "lo", "hi")).alias("asked"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, asked_ in zip(batch["text"], batch["asked"]):
                data = text.encode("utf-8", "surrogatepass")
                out += [(s["anchor"], s["cover"], s["whole"], data[s["lo"]:s["hi"] + width]) for s in asked_]
            yield pd.DataFrame(out, columns=["anchor", "cover", "whole", "bytes"])

    sent = cut(docs.select(*KEY, "text").join(asked, KEY).select("text", "asked").mapInPandas(
        extract, "anchor long, cover long, whole boolean, bytes binary"))
    bucketed = cut(sent.repartitionByRange("anchor", "cover").sortWithinPartitions("anchor", "cover"))

    # anchors that lie in several buckets: each bucket is a range, so they are among its least and its greatest
    ends = bucketed.groupBy(F.spark_partition_id().alias("bucket")).agg(F.min("anchor").alias("least"), F.max("anchor").alias("most"))
    split = {r[0] for r in ends.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("anchor"))
             .groupBy("anchor").count().where("count > 1").select("anchor").collect()}   # fewer than buckets

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows that repeat id and text bring the same bytes twice; they are one kind
        last = None
        for batch in batches:
            key = list(zip(batch["anchor"], batch["cover"]))
            fresh = [k != before for k, before in zip(key, [last, *key[:-1]])]
            last = key[-1] if key else last
            yield batch[fresh]

    # entries of one part are compared in one task: about PART bytes of stretches fall into each
    parts = int((bucketed.agg(F.sum(F.length("bytes"))).first()[0] or 0) // PART + 1)
    chunk = CHUNK
    sorted_ = cut(bucketed.mapInPandas(lambda batches: _repeats(once(batches), width, split, parts, chunk), _FOUND))
    inner = sorted_.where(F.col("part").isNull()).select("anchor", "cover", "marks")
    across = sorted_.where(F.col("part").isNotNull()).select("part", "entries")
    outer = across.repartition("part").sortWithinPartitions("part").mapInPandas(
        _across, "anchor long, cover long, marks array<struct<first:long,last:long>>")

    # stretches that repeat as a whole, then parts of the others
    full = kinds.where("n > 1").select("anchor", "cover", F.array(F.struct(
        F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))).alias("marks"))
    marks = cut(full.unionByName(inner).unionByName(outer))
    placed = found.join(marks, ["anchor", "cover"]).select(*KEY, "lo", "hi", F.explode("marks").alias("m"))
    spans = placed.select(*KEY, F.struct(
        (F.col("lo") + F.col("m.first")).alias("start"),
        (F.coalesce(F.col("lo") + F.col("m.last"), F.col("hi")) + width).alias("end")).alias("span"))
    return spans.groupBy(*KEY).agg(F.collect_list("span").alias("spans"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _remaining(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(data)]))


def drop_passages(docs: DataFrame, width: int = WIDTH, lead: int = LEAD) -> DataFrame:
    """The rows of `docs`, all columns, with repeated passages cut out of `text`; `n_chars`, if there, is
    counted anew. A character of which a byte goes, goes. Null texts stay null; a text of which nothing is
    left becomes empty."""
    keyed = _keyed(docs)
    found = cut(repeated_spans(keyed.select(*KEY, F.coalesce("text", F.lit("")).alias("text")), width, lead)).withColumnRenamed("spans", "__spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([
                text if text is None or marks is None else
                _remaining(data := text.encode("utf-8", "surrogatepass"),
                           merge([(s["start"], s["end"]) for s in marks])).decode("utf-8", "ignore")
                for text, marks in zip(texts, spans)], dtype=object)

    udf = F.pandas_udf(run, "string")
    out = keyed.join(found, KEY, "left").withColumn("text", udf("text", "__spans"))
    if "n_chars" in docs.columns:
        changed = F.col("__spans").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def with_spans(docs: DataFrame, width: int = WIDTH, lead: int = LEAD) -> DataFrame:
    """doc_id, text (null as empty), spans (null where nothing repeats) of every row."""
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    found = cut(repeated_spans(rows, width, lead))
    return rows.join(found, KEY, "left").select("doc_id", "text", "spans")


def passage_report(docs: DataFrame, width: int = WIDTH, lead: int = LEAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text of every row. In kept_text a character of which a byte
    went is gone as a whole; the hash is of the remaining bytes.

    A null text counts as empty. Texts shorter than `width` lose nothing. Rows that repeat id and text
    repeat each other. An empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                data = text.encode("utf-8", "surrogatepass")
                cuts = merge([(s["start"], s["end"]) for s in spans]) if spans is not None else []
                kept = _remaining(data, cuts)
                out.append((doc_id, len(data), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore")))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
            yield frame.astype({"doc_id": "Int64"})

    return with_spans(docs, width, lead).mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
