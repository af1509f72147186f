"""Array files read in ranges against the whole-file reading."""

import json

import pytest
from hypothesis import given, settings, strategies as st

from gradeloom.sources import arrays, entries as E

leaves = st.one_of(st.none(), st.booleans(), st.integers(-99, 99), st.text('a"\\{}[],é\n ', max_size=8))
objects = st.dictionaries(st.text('k"\\{[', max_size=3), st.recursive(leaves, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("x]", max_size=2), c, max_size=2), max_leaves=6), max_size=4)


def in_ranges(path, size):
    """What the two passes give, put together as the table operations do."""
    length = path.stat().st_size
    found, text, depth, opened, commas, stray = [], 0, 0, 0, 0, 0
    for start in range(0, length, size):
        n = min(size, length - start)
        got, (o, c, s) = arrays.items(str(path), start, n, length, text, depth)
        found += got
        opened, commas, stray = opened + o, commas + c, stray + s
        odd, outside, inside = arrays.summary(str(path), start, n)
        depth += inside if text else outside
        text = (text + odd) % 2
    sound = depth == 0 and text == 0 and opened == 1 and not stray and commas == max(0, len(found) - 1)
    return [v.decode() for _, v in found], sound


@settings(max_examples=150, deadline=None)
@given(st.lists(objects, max_size=5), st.integers(1, 40), st.sampled_from([None, 1]), st.integers(1, 30), st.booleans())
def test_any_cut_gives_the_items(tmp_path_factory, rows, size, indent, block, ascii_):
    path = tmp_path_factory.mktemp("a") / "x.json"
    path.write_text(" " + json.dumps(rows, indent=indent, ensure_ascii=ascii_) + "\n")
    before, arrays._BLOCK = arrays._BLOCK, block
    try:
        got, sound = in_ranges(path, size)
    finally:
        arrays._BLOCK = before
    assert sound and [json.loads(v) for v in got] == rows


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1}] x', '{"a": 1}', '[{"a": "x}]', '[1, {"a": 1}]', '["s"]', '[[{}]]', '[{}][{}]', "[{} {}]", "[{},,{}]", ""])
def test_broken_files(tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    for size in (3, 100):
        got, sound = in_ranges(path, size)
        assert not sound or any(not v.startswith("{") for v in got)


def test_equal_to_whole_files_on_many_tasks(spark, tmp_path, monkeypatch):
    rows = [{"id": str(i), "query": f'q "{i}" \\', "response": "x[{" * (i % 50), "files": [], "process": "p" * (i % 90), "other": [1, {"a": "]"}]} for i in range(3000)]
    (tmp_path / "big.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "small.json").write_text(json.dumps(rows[:2]))
    (tmp_path / "bad.json").write_text(json.dumps(rows[:9])[:-5])
    (tmp_path / "odd.json").write_text('[{"id": 1, "response": }]')
    plain, cut = E.read_entries(spark, str(tmp_path)), E.read_entries(spark, str(tmp_path), range_bytes=20_000)
    assert cut.columns == plain.columns
    key = lambda df: sorted(map(str, df.where("stem IN ('big', 'small')").drop("_corrupt_record").collect()))
    assert key(plain) == key(cut)
    assert {r.stem for r in cut.where("_corrupt_record IS NOT NULL").collect()} == {"bad", "odd"}
    assert cut.where("stem IN ('bad', 'odd') AND id IS NOT NULL").count() == 0
    assert arrays._ranges(spark, str(tmp_path / "big.json"), ".json", 20_000).rdd.getNumPartitions() >= 10
    monkeypatch.setattr(arrays, "FEW", 0)
    assert key(plain) == key(E.read_entries(spark, str(tmp_path), range_bytes=20_000))
    assert sorted(map(str, E.load_entries_array(spark, str(tmp_path / "big.json")).collect())) == sorted(
        map(str, E.load_entries_array(spark, str(tmp_path / "big.json"), range_bytes=9_999).collect()))


def test_small_ranges_share_tasks_and_read_little_beyond(spark, tmp_path, monkeypatch):
    rows = [{"id": str(i), "response": "x" * 400} for i in range(4000)]
    path = tmp_path / "big.json"
    path.write_text(json.dumps(rows))
    cores = spark.sparkContext.defaultParallelism
    ranges = arrays._ranges(spark, str(path), ".json", 2_000)
    assert ranges.count() > 800 and ranges.rdd.getNumPartitions() == arrays.TASKS_PER_CORE * cores
    assert arrays._ranges(spark, str(path), ".json", 1 << 20).rdd.getNumPartitions() == 2
    read = []
    plain = arrays.read_range
    monkeypatch.setattr(arrays, "read_range", lambda p, a, n: read.append(n) or plain(p, a, n))
    found, _ = arrays.items(str(path), 0, 2_000, path.stat().st_size, 0, 0)
    assert len(found) == 5 and sum(read) <= 2_000 + arrays._AHEAD
    # an item far longer than the first look behind its range
    path.write_text(json.dumps([{"a": "y" * 300_000}, {"b": 1}]))
    found, _ = arrays.items(str(path), 0, 10, path.stat().st_size, 0, 0)
    assert [len(json.loads(v)["a"]) for _, v in found] == [300_000]
