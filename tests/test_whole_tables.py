"""Queries over whole views, against plain versions of their rules."""

import collections
import json
import re

from __spark_entry__ import queries
from gradeloom.catalog.registry import Data

SF = "/root/testdata/sf0.001"


def test_searchable_filter_reads_every_result(spark):
    rows = {r.query_id: r for r in queries()["searchable_filter_all"](spark, SF).collect()}
    counts = collections.Counter(r.query_id for r in Data(spark, SF).v_search.collect())
    assert {i: r.result_count for i, r in rows.items() if i >= 0} == {i: n for i, n in counts.items() if n >= 3}
    few = {i: (r.result_count, r.source_diversity, r.has_recent) for i, r in rows.items() if i < 0}
    assert few == {-3: (3, 2, False), -4: (3, 2, True)}


def packed(pieces, sizes, limit=700):
    chunks, size = [], 0
    for piece, n in zip(pieces, sizes):
        if chunks and size + n <= limit:
            chunks[-1].append(piece)
            size += n
        else:
            chunks.append([piece])
            size = n
    return chunks


def plain_chunks(process):
    """(layout, chunks) of a trace; chunks of JSON as lists of items with their keys in order."""
    try:
        items = json.loads(process, object_pairs_hook=lambda pairs: tuple(("key", *p) for p in pairs))
        usual = [json.dumps(x, ensure_ascii=False) for x in json.loads(process)]
    except ValueError:
        items = None
    if items and isinstance(items, list):
        return "json_array", packed(items, map(len, usual))
    for layout, marker in (("block_text", r"\[(?:reasoning|web_search|scrape|run_python_code)\]"), ("step_text", r"\[Step [0-9]+\]")):
        starts = [m.start() for m in re.finditer(marker, process)]
        if len(starts) >= 2:
            found = [process[a:b] for a, b in zip(starts, [*starts[1:], len(process)])]
            chunks = ["".join(c) for c in packed(found, map(len, found))]
            return layout, [process[:starts[0]] + chunks[0], *chunks[1:]]
    parts = re.split(r"\n\s*\n", process)
    return "plain_text", ["\n\n".join(c) for c in packed(parts, map(len, parts))]


def test_pack_chunks_of_every_trace(spark):
    got = collections.defaultdict(list)
    for r in queries()["pack_chunks_all"](spark, SF).orderBy("doc_id", "chunk_no").collect():
        assert r.chunk_no == len(got[r.doc_id])
        got[r.doc_id].append((r.trace_format, r.chunk))
    traces = {r.doc_id: r.process for r in Data(spark, SF).v_trace.collect() if r.process is not None}
    assert set(got) == set(traces)
    seen = set()
    for i, process in traces.items():
        layout, chunks = plain_chunks(process)
        own = [c for _, c in got[i]]
        if layout == "json_array":
            own = [json.loads(c, object_pairs_hook=lambda pairs: tuple(("key", *p) for p in pairs)) for c in own]
        assert {k for k, _ in got[i]} == {layout} and own == chunks, i
        seen.add(layout)
    assert seen == {"json_array", "block_text", "step_text", "plain_text"}
