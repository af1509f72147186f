"""Periodic runs of words, found through Lyndon words, and texts without the repeats.

A run is a longest stretch that keeps a period; here only runs of at least `least` words and three periods
count. Each run holds a Lyndon word as long as its period that is, for one of the two orders of words, the
longest Lyndon word starting at its place. So all runs follow from two Lyndon arrays:

1. Grouping, the first phase of Baier's suffix sorter: positions are grouped by word. Groups are worked off
   from the last in order to the first; each member hands the group's text to the nearest position before it
   that lies in an earlier group, and positions that got the same text as often move into a new group, right
   behind their old one. A group's text, when its turn comes, is the longest Lyndon word at its members, so
   its length is their entry in the Lyndon array; suffixes need no sorting to the end. The same pass with the
   words' order turned round gives the second array.
2. Extension: a Lyndon word of length q at i is a root if words q apart agree from i on to the right and from
   i - 1 on to the left far enough. Both extensions compare word numbers, in steps that double.

Grouping is only done where a run can lie. In a run of the lengths above, each eight words but the last
period's come again one period later, so it lies wholly inside a stretch of eight-word strings that occur more
than once in the text (strings are told apart by a hash here, which can only make stretches longer). Elsewhere
there is no such run.

All work is inside the row: a text never leaves its task, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LEAST = 24     # words of a run
PERIODS = 3    # and periods
STRING = 8     # words that come again inside a run: LEAST / PERIODS

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOOP = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_array(words: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by grouping. Words are numbers from 0."""
    n = len(words)
    groups = max(words, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(groups)]   # places of each group, ascending
    for place, word in enumerate(words):
        members[word].append(place)
    length = [1] * groups                # of the group's text
    lower = list(range(-1, groups - 1))  # groups in order, as a list in both directions
    higher = list(range(1, groups + 1))
    group = list(words)
    left = list(range(-1, n - 1))        # places not worked off yet, likewise
    right = list(range(1, n + 1))
    out = [0] * n
    at = groups - 1
    while at >= 0:
        asked: dict[int, int] = {}       # place -> how often this group points to it
        own = length[at]
        for place in members[at]:
            if group[place] == at:       # else it has moved to a later group
                out[place] = own
                before, after = left[place], right[place]
                if after < n:
                    left[after] = before
                if before >= 0:
                    right[before] = after
                    asked[before] = asked.get(before, 0) + 1
        fresh: dict[tuple[int, int], list[int]] = {}
        for place, times in asked.items():
            fresh.setdefault((group[place], -times), []).append(place)
        # new groups lie right behind their old one; put in last, the least often asked comes first
        for old, minus in sorted(fresh) if len(fresh) > 1 else fresh:
            new, after = len(members), higher[old]
            places = fresh[old, minus]
            members.append(places)
            length.append(length[old] - minus * own)
            lower.append(old)
            higher.append(after)
            higher[old] = new
            if after < len(lower):
                lower[after] = new
            for place in places:
                group[place] = new
        at = lower[at]
    return out


def _agree_right(data: bytes, a: int, b: int) -> int:
    """How many words agree from a and b on (four bytes a word, a < b)."""
    a, b, start, step = 4 * a, 4 * b, 4 * b, 64
    while b < len(data):
        size = min(step, len(data) - b)
        if data[a:a + size] == data[b:b + size]:
            a, b, step = a + size, b + size, 2 * size
        elif size == 4:
            break
        else:
            step = max(4, size // 8 * 4)
    return (b - start) // 4


def _agree_left(data: bytes, a: int, b: int) -> int:
    """How many words agree before a and b (a < b)."""
    a, b, start, step = 4 * a, 4 * b, 4 * a, 64
    while a > 0:
        size = min(step, a)
        if data[a - size:a] == data[b - size:b]:
            a, b, step = a - size, b - size, 2 * size
        elif size == 4:
            break
        else:
            step = max(4, size // 8 * 4)
    return (start - a) // 4


def stretches(words: np.ndarray, string: int = STRING) -> list[tuple[int, int]]:
    """[start, end) of the longest stretches of strings of `string` words that occur more than once."""
    if len(words) < 2 * string:
        return []
    h = words.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < string:   # strings of twice the size; the last step may overlap
        step = min(size, string - size)
        h = (h[:-step] * _FACTOR) ^ (h[:-step] >> np.uint64(29)) ^ ((h[step:] + np.uint64(size)) * (_FACTOR << np.uint64(1) | np.uint64(1)))
        size += step
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    starts = np.zeros(len(words) + 1, np.int32)
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(starts, again, 1)
    np.add.at(starts, again + string, -1)
    inside = np.concatenate([[0], np.cumsum(starts) > 0, [0]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(inside))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def find_runs(words: list, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and `periods` periods (two or more), by start and period."""
    if len(words) < max(least, periods):
        return []
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
    data = ids.tobytes()
    found: set[tuple[int, int, int]] = set()
    for a, b in stretches(ids, max(1, least // periods) if periods > 2 else 1):
        if b - a < least:
            continue
        values, ranks = np.unique(ids[a:b], return_inverse=True)
        for numbers in (ranks, len(values) - 1 - ranks):
            period = np.array(lyndon_array(numbers.tolist()))
            place = np.arange(a, b)
            fits = place + period < b
            place, period = place[fits], period[fits]
            roots = ids[place] == ids[place + period]
            end: dict[int, int] = {}      # of the last stretch looked at, by period
            for i, q in zip(place[roots].tolist(), period[roots].tolist()):
                if i + q < end.get(q, 0):
                    continue              # part of a stretch with this period that has been measured
                stop = i + q + _agree_right(data, i, i + q)
                start = i - _agree_left(data, i, i + q)
                end[q] = stop
                if stop - start >= max(least, periods * q):
                    found.add((start, stop - start, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that lie in no run behind its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks (space, tab to carriage return), as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def _texts(docs: DataFrame) -> DataFrame:
    # ids as text: a column of numbers with nulls would come as floating point
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")


def _number(doc_id: str | None) -> int | None:
    return None if doc_id is None else int(doc_id)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = list(zip(*rows)) or [()] * len(names)
    return pd.DataFrame({
        n: pd.array(list(c), dtype="string" if n.endswith("sha256") else "Int64") for n, c in zip(names, columns)})


def word_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, start, length, period of every run of every text. Null and short texts have none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _frame([(_number(i), *r) for i, t in zip(batch["doc_id"], batch["text"])
                          for r in find_runs(words_of(t), least, periods)], names)

    names = ["doc_id", "start", "length", "period"]
    return _texts(docs).mapInPandas(run, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """The rows of `docs`, all columns, with each run in `text` cut to its first period. A text without runs stays as it is,
    blanks included; of others the words left are joined by one blank. `n_chars`, if there, is counted anew."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([
                text if not (runs := find_runs(words := words_of(text), least, periods)) else
                b" ".join(kept_words(words, runs)).decode("utf-8", "surrogatepass") for text in texts], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(run, "string")("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def looped(words: list, doc_id: int | None) -> list:
    """The words of one document in ten, from some place on, repeated with a period: input with known runs."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[:n - a]


def _summary(doc_id: int | None, words: list) -> tuple:
    runs = find_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest())


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row, after
    `looped`.

    A null text has no words, and a text without runs four nulls. A null id counts as the empty text in the
    choice of loops. Rows that repeat are reported one by one; an empty table gives no rows; other columns
    are ignored.
    """
    names = [c.split()[0] for c in _LOOP.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _frame([_summary(i := _number(doc_id), looped(words_of(text), i))
                          for doc_id, text in zip(batch["doc_id"], batch["text"])], names)

    return _texts(docs).mapInPandas(run, _LOOP)
