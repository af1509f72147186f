"""Every operator against a plain version of its rule: brute force, library, round trip or held-out rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gradeloom.llm import fingerprints, language, minhash, packing, pieces, queries, suffixes, toxicity, urls
from gradeloom.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


# --- packing

@settings(max_examples=25, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=120))
def test_plan_holds_every_piece_once(capacity, lengths):
    counts = collections.Counter(min(n, capacity) for n in lengths)
    seen, packs = collections.Counter(), 0
    numbers = collections.defaultdict(list)
    for g in packing.plan(dict(counts), capacity):
        end = 0
        for length, first, copies, at in sorted(g.items, key=lambda item: item[3]):
            assert at == end
            end = at + length * copies
            seen[length] += copies * g.packs
            numbers[length] += range(first, first + copies * g.packs)
        assert end + g.free == capacity and g.packs > 0
        packs += g.packs
    assert seen == counts
    assert all(sorted(n) == list(range(counts[k])) for k, n in numbers.items())
    if counts:
        total = sum(k * n for k, n in counts.items())
        assert packs <= 1.5 * total / capacity + 1


def test_least_squares_is_not_negative():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 12)), np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.non_negative_least_squares(a, a @ x), x, atol=1e-6)


def test_packing_against_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = queries.op1_pattern_packing(spark, SF).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc_id, text in texts.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by[doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert own[-1].start + own[-1].length == len(ids)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert len(ends) <= sum(ends.values()) / 4096 * 1.1 + 1


def test_words_encode_as_the_whole_text():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["a\x1cb  c", "É́ x <|endoftext|> y", "don't 've x", "İI ΑΣ ΑΣ. \xa0z", "漢字 5678 !!??", "", " \n", "x" * 300]
    assert packing._ids_of_words(packing.default_tokenizer(), odd) == [
        np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


@pytest.mark.parametrize("mark", [",", "."])
def test_words_before_a_mark_encode_as_the_whole_text(mark):
    """Letters that the tokenizer turns into a letter and a combining mark, then every letter of one unit."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["\u09b9\u09df", "I\u0130", "\u0958", "\ufb2a", "caf\u00e9", "stra\u00dfe", "A\u03a3", "x\u00b2", "\u00c9T\u00c9"]
    words = [w + mark for w in odd] + ["a" + chr(c) + mark for c in range(0x10000) if chr(c).isalnum()]
    assert packing._ids_of_words(packing.default_tokenizer(), words) == [
        np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]


# --- language and toxicity

def test_language_of_held_out_rows(spark):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").df()
    held = rows.merge(truth, on="doc_id")
    held = held[held["held_out"]]
    assert (held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert held["score"].between(0, 1).all()


def test_families_decide_first():
    texts_ = {"en": "the and that with which", "de": "der die und nicht mit auch", "fr": "le la les des est une que",
              "es": "el los las una por con"}
    rows = [(" ".join(np.random.default_rng(i).permutation(t.split())), lang) for lang, t in texts_.items() for i in range(30)]
    model = language.train(np.stack([language.counts(t) for t, _ in rows]), [lang for _, lang in rows])
    assert model.families == ["germanic", "romance"] and set(model.pair_weights) == {("de", "en"), ("es", "fr")}
    assert model.predict(["die der und", "las los el"])[0] == ["de", "es"]


def test_toxicity_reaches_misspellings():
    rng = np.random.default_rng(2)
    syllables = ["ka", "lo", "mi", "ter", "on", "ves", "pu", "ran"]
    words = ["".join(rng.choice(syllables, 3)) for _ in range(400)]
    bad = ["stupidest", "worthless", "disgusting"]
    docs, labels = [], []
    for i in range(300):
        text = list(rng.choice(words, 80))
        if i % 3 == 0:
            text[::20] = rng.choice(bad, 4)
        docs.append(" ".join(text))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(docs[:200], np.array(labels[:200]))
    got = model.score(docs[200:]) >= 0.5
    assert (got == np.array(labels[200:], bool)).mean() > 0.97
    clean = " ".join(words[:60])
    assert model.score([clean])[0] < 0.5 < model.score([clean + " wworthless stupidesst disgustingg"])[0]


def test_toxicity_sample_of_many_labelled_rows(spark, monkeypatch):
    docs = spark.range(8000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(8000).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append(np.bincount(toxic).tolist()))
    toxicity.fit(docs, labels)
    assert seen == [[3000, 1500]]


def test_subwords_do_not_depend_on_neighbours():
    ids, n = toxicity.subwords(["idiot", "ab", "worthless"])
    parts = np.split(ids, np.cumsum(n)[:-1])
    for word, part in zip(["idiot", "ab", "worthless"], parts):
        alone, _ = toxicity.subwords([word])
        assert sorted(alone) == sorted(part)


# --- urls

def test_rules_by_hand(spark):
    cases = {
        "http://net/": ("net/", "block"), "http://x.NET/a": ("net/", "block"), "http://xnet/": (None, "allow"),
        "http://example.net/en/a": ("example.net/en/", "allow"), "http://example.net/EN/": ("net/", "block"),
        "https://a.b.example.com/de/?q": ("example.com/de/", "block"), "http://example.com/dex/": (None, "allow"),
        "http://w.org/fr/": ("org/fr/", "allow"), "http://w.org/?x=/fr/": (None, "allow"),
        "http://casino.example.com/": (None, "block"), "http://mycasinox.example.com/": (None, "allow"),
        "http://ads.w.org/fr/": ("org/fr/", "allow"), "http://w.com#://net/": (None, "allow")}
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    rules = urls.rule_table(spark, urls.SITE_RULES + urls.WORD_RULES)
    got = {list(cases)[r.page_id]: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == cases


def test_word_rules_against_their_expressions(spark):
    """Every form of every rule, also where another of its words is the rarest token of the table."""
    hosts = ["spamfarm", "spam-farm", "spam--farm", "a.spamfarm", "x-spam-farm", "myspamfarm", "spamfarms", "link-farm",
             "linkfarm", "casino", "poker", "porn", "xxx", "adult-content", "malware", "ad", "ads", "adsx", "x"]
    paths = ["", "/", "/clicktrack/", "/click-track/", "/clicktracks/", "/wp-login.php", "/wp-login.php5?x", "/wp-login.phpx",
             "/wp-login.ph", "/a/ads/", "/ads", "/link-farm", "/casino"]
    made = [f"http://{h}.example.com{p}" for h in hosts for p in paths]
    many = [f"http://x.example.com/{w}/{i}" for w in ("spam", "farm", "click", "track", "wp", "login") for i in range(30)]
    all_ = [*made, *many]
    pages = spark.createDataFrame(list(enumerate(all_)), "page_id long, url string")
    got = {r.page_id: r.matched for r in urls.judge(pages, urls.rule_table(spark, urls.WORD_RULES)).collect()}
    expected = [next((r.pattern for r in urls.WORD_RULES if re.search(r.pattern, u.split("://", 1)[1])), None) for u in all_]
    assert {all_[i]: m for i, m in got.items()} == dict(zip(all_, expected))


# --- fingerprints

def test_fingerprints_of_the_table(spark, texts):
    rows = {r.doc_id: r for r in queries.op4_fingerprints(spark, SF).collect()}
    order = sorted(texts)
    for i, following in zip(order, order[1:] + order[:1]):
        own, new = texts[i], fingerprints.edited(texts[i], texts[following])
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(fingerprints.digest(t.encode()) for t in (own, new))
    near = np.array([(r.near_edited, r.near_next) for r in rows.values()])
    assert (near[:, 0] > near[:, 1]).mean() > 0.95


def test_likeness_bounds():
    a, b = fingerprints.digest(b"x" * 500), fingerprints.digest(bytes(range(256)) * 9)
    same, other, back = fingerprints.likeness([a, a, b], [a, b, a])
    assert same == 1 and 0 <= other < 1 and other == back


# --- repeated passages

def passages(texts, width):
    seen = collections.Counter(t[k:k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def report(spark, texts, width, lead):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(suffixes.passage_report(docs, width, lead).collect(), key=lambda r: r.doc_id)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def test_passages_of_the_table(spark, texts):
    rows = queries.op5_suffix_dedup(spark, SF).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    order = sorted(texts)
    assert [got[i] for i in order] == passages([texts[i].encode() for i in order], 400)


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_short_passages_in_small_chunks(spark, monkeypatch, chunk):
    """Few letters, so that anchors repeat inside stretches, and chunks so small that anchors span many."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "PART", 16 * chunk)
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abé"), 300))
    texts_ = ["".join(rng.choice(list("ab"), n)) for n in (0, 5, 19, 20, 60, 200)]
    for _ in range(40):
        at, n = rng.integers(0, 250), rng.integers(10, 80)
        texts_.append("".join(rng.choice(list("xy"), 7)) + base[at:at + n] + "".join(rng.choice(list("zw"), 9)))
    texts_ += ["a" * 70, base, base[:50] + "!" + base[50:]]
    assert report(spark, texts_, 20, 6) == passages([t.encode() for t in texts_], 20)


def test_multikey_sort_finds_equal_rows():
    rng = np.random.default_rng(4)
    table = rng.integers(0, 3, (200, 4))
    rows, group = suffixes.multikey_sort(list(table.T))
    seen = collections.Counter(map(tuple, table))
    assert sorted(rows) == [i for i, r in enumerate(map(tuple, table)) if seen[r] > 1]
    assert len({(g, *table[r]) for r, g in zip(rows, group)}) == len(set(group))


# --- near duplicates

def near(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def groups(spark, texts, words):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = minhash.near_groups(docs, words).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_near_groups_of_the_table(spark, texts):
    assert groups(spark, texts, 4) == near(texts, 4, 80)


def test_hot_group_in_small_blocks(spark, monkeypatch):
    """A chain: neighbours are alike, the ends are not, and blocks hold few members."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    made, now = {}, list(words)
    for i in range(14):
        made[i] = " ".join(now)
        for at in rng.choice(200, 3):
            now[at] = f"n{i}x{at}"
    made[100], made[101], made[102] = "a b", "A  B\n", "a b c"
    assert groups(spark, made, 4) == near(made, 4, 80)


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 9)] + [(50, 40), (41, 50), (7, 7), (60, 60)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {i: 0 for i in range(10)} | {40: 40, 41: 40, 50: 40}


# --- pieces

def test_pieces_match_the_library(texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.default_model())
    own = pieces.Pieces(pieces.default_model())
    odd = ["Hello  world\n x\tÈé 漢 ▁a  ", "", " ", "   ", "      a  ", "a" * 60, "▁▁", "the thethethe x",
           "0000000 11111111 ====== ----------------- .......", "日本語のテキスト 🙂👍🏽", "á \x00 b"]
    all_ = [*texts.values(), *odd]
    got = own.encode(all_)
    assert got == [np.array(library.encode(t), "<u4").tobytes() for t in all_]
    assert [own.decode(x) for x in got] == [t.replace("▁", " ") for t in all_]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aeinst hTo\n,.é", max_size=30))
def test_forward_pass_is_the_merge_rule(text):
    own = _model()
    word = "▁" + text.replace(" ", "▁")
    parts = [p for w in pieces._WORDS.findall(word) for p in own.merged(w)]
    assert b"".join(np.array(own.ids(parts), "<u4").tobytes() for _ in [0]) == (own.encode([text])[0] if text else
                                                                               np.array(own.ids(parts), "<u4").tobytes())


_kept = []


def _model():
    if not _kept:
        _kept.append(pieces.Pieces(pieces.default_model()))
    return _kept[0]


# --- words in parts, digests

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZÉßµª'sStT0.,-_!$\"(é়য字İ", min_size=1, max_size=7), min_size=1, max_size=12))
def test_words_in_parts_encode_as_the_whole_text(words):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    text = " ".join(words)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing._ids_of_words(path, [text])[0], "<u4").tolist() == want


def test_table_of_words_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 6)
    table = packing._Words(packing.default_tokenizer())
    texts = ["one two three four five", "one (two) six. seven", "one two 'single' O'Neill's", "x" * 90 + " one"]
    for _ in range(2):
        for t in texts:
            assert table.ids([t])[0] == table.encode([t])[0]
    assert len(table.young) + len(table.old) < 20


def test_toxicity_of_held_out_rows(spark):
    rows = toxicity.toxicity_report(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall())
    got = [(r.predicted, labels[r.doc_id]) for r in rows.where("held_out").collect() if r.doc_id in labels]
    hits = sum(p == 1 == y for p, y in got)
    recall, precision = hits / sum(y == 1 for _, y in got), hits / max(1, sum(p == 1 for p, _ in got))
    print(f"held out: {len(got)}, recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.8 and precision >= 0.85


def test_training_holds_few_ngrams_at_full_width():
    import tracemalloc

    import numpy as np

    from gradeloom.llm import toxicity

    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(3000)]
    texts = [" ".join(words[k] for k in rng.integers(0, 3000, 200)) + (" vile" if i % 3 == 0 else "") for i in range(600)]
    labels = np.array([int(i % 3 == 0) for i in range(600)])
    entries = sum(len(toxicity._bags([t])[0]) for t in texts)
    tracemalloc.start()
    try:
        model = toxicity.train(texts, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # an n-gram of a text: its bucket, its weight and a byte for its text
    assert most < 16 * entries + (24 << 20)
    assert model.score(["vile " + texts[1]])[0] > model.score([texts[1]])[0]
