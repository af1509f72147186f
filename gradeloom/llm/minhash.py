"""Near duplicates by an inverted index over signature coordinates.

Every distinct set of word shingles gets a MinHash signature. It is posted under its coordinate-value
pairs; two sets that agree in at least MATCHES of SIZE coordinates are candidates, and a candidate pair
becomes a link if the full sets are similar enough. At MATCHES of SIZE, a pair at the similarity of 0.8
is missed about four times in a million.

Prefix: with the pairs of a set ordered from rare to frequent, sets that agree in MATCHES coordinates
share one of their SIZE - MATCHES + 1 rarest, so only these are posted. A passage that occurs in every
third document fills long lists, but they rank last and stay unposted.

Skip: lists of true near copies may be as long as the group. Their members are first compared with one
pivot per list, which is linear; members found in one component need no further comparison. What is left
(members of different components in one list) is merged in blocks of bounded size, lists with the same
members once, each pair in the first list that it shares. A block holds the sets of its members, so pairs
are confirmed where they are found and only links that join components leave the task. No pair is capped
away; what is skipped is known to be connected.

Copies with one set are one node throughout. The sets of candidates alone are kept for confirmation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.components import components
from gradeloom.session import cut

SIZE = 64
MATCHES = 36
POSTED = SIZE - MATCHES + 1
BLOCK = 1024      # members of a list that meet in one task

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _STEP)]), dtype=np.uint64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `words` words, A-Z lower-cased; words are what stands
    between ASCII white space. A shorter text is one run; a text without words has none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(parts), np.uint8)
    place = np.arange(len(data)) - np.repeat(start, size)
    word = _mix(np.add.reduceat(_BYTES[data] * _powers(int(size.max()))[place], start) + size.astype(np.uint64))
    run = min(words, len(parts))
    total = np.zeros(len(parts) - run + 1, np.uint64)
    for i in range(run):
        total = total * _STEP + word[i:i + len(total)]
    return np.unique(_mix(total + np.uint64(run)))


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each of SIZE hash functions, as 32-bit numbers."""
    least = np.full(SIZE, 1 << 32, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at:at + 4096, None] * _FACTORS >> np.uint64(32)).min(0))
    return least.astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, node (hash of the set; null if empty), signature."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "n_shingles": [len(s) for s in sets],
                "node": pd.array([node_of(s) if len(s) else None for s in sets], dtype="Int64"),
                "signature": [signature(s) if len(s) else None for s in sets]})

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _text_key(F.col("text")).alias("key")).mapInPandas(
        run, "doc_id long, key long, n_shingles long, node long, signature array<int>")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _postings(nodes: DataFrame) -> DataFrame:
    """(token, node, tokens): the posted coordinate-value pairs of each node, with all that it posts."""
    pair = F.posexplode("signature").alias("coordinate", "value")
    tokens = nodes.select("node", pair).select(
        "node", (F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value").cast("long")
                 .bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    shared = cut(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"))
    # pairs that occur once are the rarest and lead nowhere: they only use up the prefix
    ranked = tokens.join(shared, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("often", "token"))).alias("ranked"))
    left = F.lit(POSTED - SIZE) + F.size("ranked")
    posted = ranked.where(left > 0).select("node", F.slice("ranked.token", F.lit(1), left).alias("tokens"))
    return posted.select("node", "tokens", F.explode("tokens").alias("token"))


def _matching(left: str, right: str):
    return F.size(F.filter(F.zip_with(left, right, lambda x, y: x == y), lambda same: same))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar: 100 * common >= percent * union."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").where(
        common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    return postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _distinct_lists(postings: DataFrame) -> DataFrame:
    """Of lists with the same members one is enough. Members are compared by two hashes of the whole list,
    which aggregate before the shuffle."""
    prints = postings.groupBy("token").agg(
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.count("*").alias("members"))
    lists = cut(prints.groupBy("x", "y", "members").agg(F.min("token").alias("token")).select("token"))
    kept = postings.select("node", "token").join(lists, "token")
    return kept.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select(
        "node", "tokens", F.explode("tokens").alias("token"))


def _link_block(node: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, sig: np.ndarray,
                sets: list[np.ndarray], shared_before, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join components, between the members in `left` and in `right`."""
    _, number = np.unique(label, return_inverse=True)
    root = list(range(number.max() + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    marked = np.zeros(ids.max() + 1, np.int64)
    links = []
    for i in np.flatnonzero(left):
        js = np.flatnonzero(right & (label != label[i]) & (node > node[i] if left is right else True))
        js = js[(sig[js] == sig[i]).sum(1) >= MATCHES]
        js = np.array([j for j in js if find(number[j]) != find(number[i]) and not shared_before(i, j)], np.int64)
        if not len(js):
            continue
        own = ids[start[i]:start[i] + size[i]]
        marked[own] = 1
        common = np.array([marked[ids[start[j]:start[j] + size[j]]].sum() for j in js])
        marked[own] = 0
        for j in js[common * 100 >= (size[i] + size[js] - common) * percent]:
            x, y = find(number[i]), find(number[j])
            if x != y:
                root[x] = y
                links.append((int(node[i]), int(node[j])))
    return links


def _merge(postings: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the components met in one list.

    Members of a list meet in blocks; each candidate pair is looked at in the first list it shares, and
    only if nothing in the task has joined its components yet.
    """
    marked = cut(_labelled(postings, labels))
    split = cut(marked.groupBy("token").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("members")
    ).where("least <> most").select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a member of block i meets all blocks: it goes to every unordered pair of blocks that holds i
    rows = (
        marked.join(split, "token").withColumn("own", own)
        .join(nodes.select("node", "signature"), "node").join(sets, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                "own", "node", "label", "tokens", "signature", "shingles")
    )
    keys = ["token", "low", "high"]

    def link(group: pd.DataFrame) -> list[tuple[int, int]]:
        token, low, high = (int(group[k].iloc[0]) for k in keys)
        own = group["own"].to_numpy()
        earlier = [{int(t) for t in ts if t < token} for ts in group["tokens"]]
        left = own == low
        return _link_block(
            group["node"].to_numpy(), group["label"].to_numpy(), left, left if low == high else own == high,
            np.stack(group["signature"].to_list()), group["shingles"].to_list(),
            lambda i, j: not earlier[i].isdisjoint(earlier[j]), percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            k = batch[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]
            links = [x for a, b in zip(cuts, cuts[1:]) for x in link(batch.iloc[a:b])]
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
            held = batch.iloc[cuts[-1]:]
        if held is not None and len(held):
            yield pd.DataFrame(link(held), columns=["a", "b"], dtype=np.int64)

    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInPandas(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Rows are linked whose shingle sets share at least `percent` of a hundred parts of their union;
    component_id is the smallest id reachable. Rows without words, null texts among them, have the size 0
    and are linked with nothing. Null ids are passed over when the smallest is sought; kept says whether
    the row's id is the component's, null counting as equal to null. Rows that repeat an id are looked at
    each with its own text. An empty table gives no rows; other columns are ignored.
    """
    return _groups(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(sketches(plain, words))
    nodes = cut(sketch.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")))
    postings = cut(_postings(nodes))

    # one pivot per list
    pivots = cut(postings.groupBy("token").agg(F.min("node").alias("pivot"), F.count("*").alias("members"))
                 .where("members > 1").drop("members"))
    listed = postings.join(pivots, "token")
    first = listed.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("ga"), F.col("n").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("gb"), F.col("n").alias("nb"))
    first = cut(first.join(one, "a").join(two, "b").where(
        (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (_matching("ga", "gb") >= MATCHES)
    ).select("a", "b"))

    postings = cut(_distinct_lists(listed.select("node", "token")))

    # the sets of all that are in some list, computed again from their texts
    wanted = postings.select("node").distinct()
    holders = sketch.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "found": [node_of(s) for s in sets],
                                "shingles": [s.view(np.int64) for s in sets]})

    texts = plain.withColumn("text", F.coalesce("text", F.lit(""))).join(
        holders.select("node", F.col("doc_id").alias("holder")), F.col("doc_id").eqNullSafe(F.col("holder")))
    sets = cut(texts.select("node", "text").mapInPandas(sets_of, "node long, found long, shingles array<long>")
               .where("node = found").drop("found").dropDuplicates(["node"]))

    links = cut(_confirm(first, sets, percent))
    labels = components(links)
    more = cut(_merge(postings, labels, nodes, sets, percent))
    if more.head(1):
        labels = components(links.unionByName(more))

    named = _labelled(nodes.select("node", "least"), labels)
    least = cut(named.groupBy("label").agg(F.min("least").alias("component_id")))
    of_node = cut(named.join(least, "label").select("node", "component_id"))
    out = sketch.join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, without those whose group has a smaller id. Rows with a null id
    stay. Rows that share an id but not their text are judged each by its own group."""
    dropped = _groups(docs, words, percent).where("NOT kept").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(cut(dropped), (F.col("doc_id") == F.col("__id")) & (_text_key(docs["text"]) == F.col("__key")), "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])
