"""Divergence of sources against a plain count, and its special cases."""

import collections
import re

import pytest

from gradeloom.llm import divergence

UNIT = 1_000_000_000


def plain(rows, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= 10)
        sources = {d[1] for d in own}

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + UNIT * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2]) for s in sources}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(collections.Counter(t for d in own for t in d[2]))
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(price(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-price(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def rows():
    words = "the river Runs élan über a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    out = []
    for k in range(400):
        text = " ".join(words[(k * i + i * i) % (5 + k % 24)] for i in range(k % 23))
        out.append((("en", "fr", None)[k % 7 % 3], None if k % 11 == 0 else f"s{k % 5 if k % 3 else 0}", text if k % 13 else None))
    return out + [("xx", "alone", "few words"), ("xx", "empty", ""), ("yy", "one", "the the")]


SCHEMA = "lang string, source string, text string, n long, term string, tb long, gb long, words long, total long, a string, b string"


@pytest.mark.parametrize("terms, groups", [(128, 32), (3, 2)])
def test_against_plain_counts(spark, monkeypatch, terms, groups):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    docs = spark.createDataFrame([(*r, *[None] * 8) for r in rows()], SCHEMA)
    assert got(divergence.source_audit(docs)) == plain(rows())


def test_language_without_kept_terms_and_empty_table(spark):
    docs = spark.createDataFrame([("xx", "b", "few words"), ("xx", "a", None), (None, None, "x")], "lang string, source string, text string")
    assert got(divergence.source_audit(docs)) == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]
    assert divergence.source_audit(docs.limit(0)).count() == 0


def test_product_counts_terms_with_both_levels():
    import numpy as np

    rng = np.random.default_rng(5)
    panel = divergence._Panel.__new__(divergence._Panel)
    panel.sources, panel.totals, panel.kept = ["a", "b", "c"], [40, 50, 0], 100
    panel.n = np.zeros((3, divergence.TERMS), np.int64)
    panel.n[:2, :100] = rng.integers(0, 4, (2, 100))
    value = divergence._priced(panel, panel, 100)
    p = [divergence._shares(panel.n[g, :100], panel.totals[g], 100) for g in range(3)]
    assert value[0, 1] == divergence._price(p[0], p[1]).sum() and value[2, 1] == divergence._price(p[2], p[1]).sum()
    assert value[0, 0] == 0


def test_shares_beyond_64_bits():
    import numpy as np

    big = 9 * 10 ** 17
    assert divergence._shares(np.array([big]), 3 * big, 10).tolist() == [1 + UNIT * (big + 2) // (3 * big + 20)]
