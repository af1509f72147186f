"""How far the sources of a language differ from each other and from the language, term by term.

A language keeps the terms of at least LEAST of its documents. In a group (language, source) a kept term has a
smoothed share in billionths, which depends on its count there alone. So what two groups differ by follows
from how often each pair of counts meets: the table of terms by (count in the one, count in the other).

All these tables come from one product. Kept terms are rows, (group, count level) pairs are columns, and a cell
is one where the term has that count in that group. The matrix times its transpose holds, for each two
columns, the number of terms with both: the joint tables of all groups at once. The product is cut into blocks:

* rows: terms are numbered by language and count, TERMS of them make a block. Terms of like frequency have few
  levels, so a block has few columns, and levels are numbered inside the block;
* columns: groups are dealt into blocks of about GROUPS by a hash.

Each (term block, group block) is one row of a table, a panel; two panels of a term block are multiplied in a
task (0/1 matrices in single precision: sums up to TERMS are exact), and each cell of the product that is not
zero is priced once, times its number of terms. Prices are whole numbers, so sums of blocks are exact.

Counts are aggregated before the shuffle; nothing is ever gathered by group, source or term, only by block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.numbering import first_n, number_rows
from gradeloom.session import cut

LEAST = 10             # documents of a kept term
TOP = 10               # terms reported per group
TERMS = 128            # of a block
GROUPS = 32            # of a block, about
UNIT = 1_000_000_000   # shares are in this part of one

HELD = 300_000         # terms that a task holds while it counts

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Bytes of terms, A-Z lower-cased; all others are blanks. Bytes from 128 on are parts of letters beyond ASCII.
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents that hold the term. A task adds up as many terms as it may
    hold before it hands them on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        fresh = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()),
                     pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "d"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                terms = text.encode().translate(_LOWER).split()
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                n, d = held[lang, source]
                fresh -= len(n)
                n.update(terms)
                d.update(set(terms))
                fresh += len(n)
                if fresh > HELD:
                    yield from flush()
                    fresh = 0
        yield from flush()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """Smoothed shares of counts, exactly."""
    return np.array([1 + UNIT * (int(c) + 2) // (int(total) + 2 * int(kept)) for c in counts.tolist()], np.int64)


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _fields(column: pa.Array, row: int, *names: str) -> list:
    value = column[row].values
    return [value.field(n) for n in names]


class _Panel:
    """Counts of the terms of a block in the groups of a block: a level per term and group."""

    def __init__(self, entries, groups, kept: int):
        sources, totals = groups
        self.sources = sources.to_pylist()
        self.totals = totals.to_pylist()
        self.kept = kept
        at = {s: i for i, s in enumerate(self.sources)}
        self.n = np.zeros((len(self.sources), TERMS), np.int64)
        if entries is not None:
            t, source, n = entries
            self.n[[at[s] for s in source.to_pylist()], t.to_numpy(zero_copy_only=False)] = n.to_numpy(zero_copy_only=False)

    def columns(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The indicator matrix of the first `size` terms (terms by levels), and group and share of each level."""
        marks, owner, share = [], [], []
        for g, counts in enumerate(self.n[:, :size]):
            levels, which = np.unique(counts, return_inverse=True)
            one = np.zeros((size, len(levels)), np.float32)
            one[np.arange(size), which] = 1
            marks.append(one)
            owner.append(np.full(len(levels), g))
            share.append(_shares(levels, self.totals[g], self.kept))
        return np.concatenate(marks, 1), np.concatenate(owner), np.concatenate(share)


def _priced(left: _Panel, right: _Panel, size: int) -> np.ndarray:
    """For each group of the one panel and each of the other, the price of their joint table."""
    a, a_group, a_share = left.columns(size)
    b, b_group, b_share = (a, a_group, a_share) if right is left else right.columns(size)
    joint = a.T @ b
    i, j = np.nonzero(joint)
    value = _price(a_share[i], b_share[j]) * joint[i, j].astype(np.int64)
    out = np.zeros(len(left.sources) * len(right.sources), np.int64)
    np.add.at(out, a_group[i] * len(right.sources) + b_group[j], value)
    return out.reshape(len(left.sources), len(right.sources))


def _panels(counts: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, stats, panels): kept terms by block; groups by block, with the words each has of kept terms; and the
    counts of each block by block, for all of them that any kept term falls into."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= LEAST)
    numbered = cut(number_rows(kept.drop("d"), ["lang", "total", "term"], "id").select(
        "lang", "term", "total", F.floor((F.col("id") - 1) / TERMS).alias("tb")))
    inside = cut(counts.join(numbered.drop("total"), ["lang", "term"]).select("lang", "source", "term", "n", "tb"))
    words = inside.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    # of groups a language has, the most: as many blocks as that asks for, the same for all languages
    most = groups.groupBy("lang").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    blocks = -(-most // GROUPS)

    def block(source: str) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(blocks)).alias("gb")

    sizes = numbered.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    stats = cut(
        groups.join(words, ["lang", "source"], "left").groupBy("lang", block("source"))
        .agg(F.collect_list(F.struct("source", F.coalesce("words", F.lit(0)).alias("words"))).alias("groups"))
        .join(sizes, "lang"))
    rows = numbered.groupBy("lang", "tb").agg(F.sort_array(F.collect_list(F.struct("term", "total"))).alias("terms"))
    entries = inside.groupBy("lang", "tb", block("source")).agg(
        F.collect_list(F.struct("term", "source", "n")).alias("entries"))
    # terms in their order in the block, in place of their names
    place = F.transform("entries", lambda e: F.struct(
        (F.array_position(F.col("names"), e["term"]) - 1).cast("int").alias("t"), e["source"].alias("source"), e["n"].alias("n")))
    named = cut(rows.withColumn("names", F.col("terms.term")))
    light = named.select("lang", "tb").join(stats.select("lang", "gb"), "lang")
    panels = cut(
        light.join(entries, ["lang", "tb", "gb"], "left").join(named.select("lang", "tb", "names"), ["lang", "tb"])
        .select("lang", "tb", "gb", place.alias("entries"), F.size("names").alias("size")))
    return named.drop("names"), stats, panels


def _pair_values(stats: DataFrame, panels: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each two groups of a language with kept terms, once for a < b."""
    right = panels.select("lang", "tb", F.col("gb").alias("gb2"), F.col("entries").alias("entries2"))
    met = panels.join(right, ["lang", "tb"]).where(F.col("gb") <= F.col("gb2"))
    own = stats.select("lang", "gb", "groups", "kept")
    other = stats.select("lang", F.col("gb").alias("gb2"), F.col("groups").alias("groups2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, first, second, value = [], [], [], []
            col = {n: batch.column(n) for n in batch.schema.names}
            for row in range(batch.num_rows):
                kept, size = col["kept"][row].as_py(), col["size"][row].as_py()

                def panel(suffix: str) -> _Panel:
                    entries = col["entries" + suffix]
                    return _Panel(_fields(entries, row, "t", "source", "n") if entries[row].is_valid else None,
                                  _fields(col["groups" + suffix], row, "source", "words"), kept)

                left = panel("")
                same = col["gb"][row] == col["gb2"][row]
                right_ = left if same else panel("2")
                got = _priced(left, right_, size)
                for i, a in enumerate(left.sources):
                    for j, b in enumerate(right_.sources):
                        if a < b or (not same and b < a):
                            lang.append(col["lang"][row].as_py())
                            first.append(min(a, b))
                            second.append(max(a, b))
                            value.append(int(got[i, j]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(value, pa.int64())],
                names=["lang", "a", "b", "value"])

    rows = met.join(own, ["lang", "gb"]).join(other, ["lang", "gb2"])
    return rows.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))


def _term_values(terms: DataFrame, stats: DataFrame, panels: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): per panel and group the `top` terms that are more frequent than in the language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            col = {n: batch.column(n) for n in batch.schema.names}
            for row in range(batch.num_rows):
                if not col["entries"][row].is_valid:
                    continue
                lang, kept, everything, size = (col[n][row].as_py() for n in ("lang", "kept", "all", "size"))
                panel = _Panel(_fields(col["entries"], row, "t", "source", "n"), _fields(col["groups"], row, "source", "words"), kept)
                names, totals = (f.to_pylist() for f in _fields(col["terms"], row, "term", "total"))
                q = _shares(np.array(totals, np.int64), everything, kept)
                for g, source in enumerate(panel.sources):
                    here = np.flatnonzero(panel.n[g, :size])
                    p = _shares(panel.n[g, here], panel.totals[g], kept)
                    here, p = here[p > q[here]], p[p > q[here]]
                    value = _price(p, q[here])
                    # terms of a block are sorted by name, so ties keep that order
                    for k in np.argsort(-value, kind="stable")[:top].tolist():
                        for target, v in zip(out, (lang, source, names[here[k]], int(value[k]))):
                            target.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()))],
                names=["lang", "source", "item", "value"])

    rows = panels.join(terms, ["lang", "tb"]).join(stats, ["lang", "gb"])
    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def source_audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of every group (lang, source) that occurs.

    Part `pair`: the other sources of the language, by how far they differ. Part `term`: the `top` kept terms that
    tell the source from the language. Ranks go from the largest value down, ties by the item's bytes. Null lang,
    source and text count as empty; groups without terms take part in pairs; in a language without kept
    terms all pairs are 0. Every row is a document, rows that repeat too. An empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(_counts(rows))
    groups = cut(rows.select("lang", "source").distinct())
    terms, stats, panels = _panels(counts, groups)
    values = _pair_values(stats, panels)
    both = values.unionByName(values.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = others.join(both, (others["lang"] == both["lang"]) & (others["source"] == both["a"]) & (others["item"] == both["b"]), "left").select(
        others["lang"], "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    best = first_n(_term_values(terms, stats, panels, top), ["lang", "source"], order, top).withColumn("part", F.lit("term"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(*order)
    return pairs.unionByName(best).select(
        "lang", "source", "part", "item", F.col("value").cast("long"), F.row_number().over(ranked).alias("rank"))


ORACLE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms
    FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS words FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
words AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS words FROM cells GROUP BY lang, source),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           CAST(1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (coalesce(w.words, 0) + 2 * l.v) AS BIGINT) AS p,
           CAST(1 + (CAST({UNIT} AS HUGEINT) * (k.total + 2)) // (l.words + 2 * l.v) AS BIGINT) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
    LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source),
priced AS (
    SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
