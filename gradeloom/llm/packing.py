"""Packing documents into sequences of fixed length.

The method: histogram of piece lengths; patterns of up to three documents that fill a sequence on a
grid of lengths; repeat counts fitted to the histogram by non-negative least squares and rounded down;
what is left is packed best-fit, longest first, into free space of the patterns and new sequences.

Everything on the driver works on counts per length, never on documents: at most `capacity` lengths,
whatever the input. Documents are numbered by (length, id, piece) with a distributed sort, and the plan
is a list of number ranges ("the next 800 pieces of 512 tokens go to sequences 40-439, two each"), so
placing a document is one look-up of its number.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.numbering import number_rows
from gradeloom.session import cut

CAPACITY = 4096
END_ID = 1
GRID = 256          # length classes of the pattern fit
CACHED_WORDS = 900_000
CACHED_LENGTH = 40  # longer words are encoded anew each time

# Letters of ASCII and Latin-1, with ASCII punctuation before and after them.
_MARKS = r"[!-/:-@\[-`{-~]*"
_SIMPLE = re.compile(rf"({_MARKS})([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)({_MARKS})")

_ID = attrgetter("id")
_tokenizers: dict[str, "_Words"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """How a byte-level model writes bytes: visible ones as the character of that number, the others as the
    next characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Words:
    """Ids of words, kept in a table.

    The tokenizer splits at white space before anything else, so a text's ids are those of its words. It
    normalises (NFC, lower case) and then splits a word into runs: of letters, of single digits, of other marks, and
    contractions (an apostrophe and the letters after it). So the ids of a word of plain letters with marks
    before and after are those of its marks, its letters and its marks, unless an apostrophe opens it. Letters of
    ASCII and Latin-1 stay one letter each when they are normalised; others may end in a combining mark then,
    which joins the marks behind, so words with them are encoded whole. A run of letters goes to the model
    directly.

    The table has two halves. Words are looked up in the younger one and fetched from the older one;
    when the younger is full it becomes the older, and what has not been asked for since is forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}   # of this batch
        self.written = _byte_letters()

    def encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def _run(self, letters: str) -> bytes:
        """Ids of a run of letters of ASCII and Latin-1."""
        low = letters.lower()
        ids = self.letters.get(low)
        if ids is None:
            text = low if low.isascii() else low.encode().decode("latin-1").translate(self.written)
            ids = self.letters[low] = array("I", map(_ID, self.model.tokenize(text))).tobytes()
        return ids

    def learn(self, words: set[str]) -> None:
        """Puts words into the younger half."""
        young, old = self.young, self.old
        whole, joined = [], []
        for word in words:
            ids = old.get(word)
            if ids is not None:
                young[word] = ids
                continue
            parts = _SIMPLE.fullmatch(word)
            if parts is None or parts[1].startswith("'"):
                whole.append(word)
            elif parts[1] or parts[3]:
                joined.append((word, parts))
            else:
                young[word] = self._run(word)
        marks = {m for _, parts in joined for m in (parts[1], parts[3])} - {""}
        known = dict(zip(marks, self.encode(list(marks)))) | {"": b""}
        for word, parts in joined:
            young[word] = known[parts[1]] + self._run(parts[2]) + known[parts[3]]
        if whole:
            young.update(zip(whole, self.encode(whole)))
        self.letters.clear()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit numbers. Python also splits at four control
        characters that are no white space to the tokenizer; texts with one go to it whole, and so do texts that
        hold one of its special tokens."""
        plain = [not any(c in text for c in "\x1c\x1d\x1e\x1f") and not any(s in text for s in self.special) for text in texts]
        split = [text.split() if p else [] for text, p in zip(texts, plain)]
        new = set().union(*split).difference(self.young)
        self.learn(new)
        of = self.young.__getitem__
        out = [b"".join(map(of, words)) if p else self.encode([text])[0] for text, words, p in zip(texts, split, plain)]
        for word in new:
            if len(word) > CACHED_LENGTH:
                del self.young[word]
        if len(self.young) > CACHED_WORDS // 2:
            self.old, self.young = self.young, {}
        return out


def _ids_of_words(path: str, texts: list[str]) -> list[bytes]:
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path)
    return _tokenizers[path].ids(texts)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids (binary, little-endian uint32).

    The end token closes each document; documents over `capacity` tokens are cut into pieces of that
    length, the last one shorter. A null or empty text is the end token alone. Other columns are ignored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], "<u4").tobytes()
        size = 4 * capacity
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                rows = []
                for doc_id, ids in zip(part["doc_id"], _ids_of_words(tokenizer, part["text"].tolist())):
                    ids += end
                    rows += [(doc_id, k, s // 4, len(ids[s:s + size]) // 4, ids[s:s + size])
                             for k, s in enumerate(range(0, len(ids), size))]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return clean.mapInPandas(run, "doc_id long, piece int, start long, length long, ids binary")


# --- the fit, on counts per length -------------------------------------------------------------------

def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |ax - b|: an active set grown by the column that helps most. All columns are offered in
    each round, by their slope; only those in the set, no more than there are rows, are ever solved for."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(rounds):
        slope = a.T @ (b - a[:, active] @ x[active])
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        active.append(best)
        while active:
            fit = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if fit.min() > 0:
                break
            now = x[active]
            falls = fit <= 0
            step = np.min(now[falls] / np.maximum(now[falls] - fit[falls], 1e-300))
            moved = now + step * (fit - now)
            x[active] = np.maximum(moved, 0)
            stays = moved > 1e-12 * max(1.0, moved.max())
            stays &= ~(falls & (now == 0))
            for i in np.array(active)[~stays]:
                x[i] = 0
            active = [i for i, s in zip(active, stays) if s]
        x[:] = 0
        if active:
            x[active] = fit
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """Multisets of one to three length classes that fill a sequence to the brim."""
    full = [(classes,)]
    full += [(classes - b, b) for b in range(1, classes // 2 + 1)]
    full += [(classes - b - c, b, c) for c in range(1, classes // 3 + 1) for b in range(c, (classes - c) // 2 + 1)]
    return full


@dataclass
class Group:
    """`packs` sequences of equal make-up. Items: (length, first number within the length, copies per
    sequence, offset in the sequence)."""
    packs: int
    free: int
    items: list[tuple[int, int, int, int]]

    def split(self, packs: int) -> tuple[Group, Group]:
        rest = [(length, first + packs * copies, copies, at) for length, first, copies, at in self.items]
        return Group(packs, self.free, self.items), Group(self.packs - packs, self.free, rest)


def plan(counts: dict[int, int], capacity: int = CAPACITY, classes: int = GRID) -> list[Group]:
    """Groups of sequences that hold every piece once."""
    classes = min(classes, capacity)
    step = -(-capacity // classes)
    classes = capacity // step
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    groups: list[Group] = []

    def take(length: int, n: int) -> int:
        first = int(used[length])
        used[length] += n
        left[length] -= n
        return first

    # full pieces stand alone; they would only blur the fit
    if left[capacity]:
        n = int(left[capacity])
        groups.append(Group(n, 0, [(capacity, take(capacity, n), 1, 0)]))

    # fit on length classes, a length counting as the class above it
    of_class = -(-np.arange(capacity + 1) // step)
    seen = np.bincount(of_class, weights=left, minlength=classes + 2)[1:classes + 1]
    shapes = [p for p in patterns(classes) if all(seen[c - 1] > 0 for c in p)]
    if shapes:
        matrix = np.zeros((classes, len(shapes)))
        for j, shape in enumerate(shapes):
            for c in shape:
                matrix[c - 1, j] += 1
        repeats = _fit(matrix, seen)
        stock = seen.astype(np.int64)
        lists = {c: [int(x) for x in np.flatnonzero((of_class == c) & (left > 0))[::-1]] for c in range(1, classes + 1)}
        for j in np.argsort(-repeats, kind="stable"):
            shape = shapes[j]
            need = {c: shape.count(c) for c in shape}
            n = min([int(repeats[j] + 1e-9), *(int(stock[c - 1]) // k for c, k in need.items())])
            if n <= 0:
                continue
            for c, k in need.items():
                stock[c - 1] -= n * k
            groups += _fill(shape, n, lists, left, take, capacity)

    _best_fit(left, take, groups, capacity)
    return groups


def _fit(matrix: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Repeat counts. Rare classes weigh as much as common ones relative to their spread."""
    weight = 1 / np.sqrt(np.maximum(seen, 1))
    return non_negative_least_squares(matrix * weight[:, None], seen * weight)


def _fill(shape, n, lists, left, take, capacity) -> list[Group]:
    """`n` sequences of one pattern, cut wherever the exact lengths change."""
    made = []
    while n:
        run, items, at, wanted = n, [], 0, {}
        picks = []
        for c in shape:
            # the next lengths of the class that still have pieces beyond those picked just now
            for length in lists[c]:
                free = int(left[length]) - wanted.get(length, 0)
                if free > 0:
                    picks.append(length)
                    wanted[length] = wanted.get(length, 0) + 1
                    break
        for length in set(picks):
            run = min(run, int(left[length]) // picks.count(length))
        for length in picks:
            items.append((length, take(length, run), 1, at))
            at += length
        for c in set(shape):
            while lists[c] and left[lists[c][0]] == 0:
                lists[c].pop(0)
        made.append(Group(run, capacity - at, items))
        n -= run
    return made


def _best_fit(left, take, groups: list[Group], capacity: int) -> None:
    """Longest first, each into the sequence with the least sufficient space; new ones only where none fits."""
    by_free: dict[int, list[Group]] = {}
    for g in groups:
        by_free.setdefault(g.free, []).append(g)
    open_at = np.zeros(capacity + 1, dtype=bool)
    for free in by_free:
        open_at[free] = True
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = np.flatnonzero(open_at[length:])
            if len(fits):
                free = length + int(fits[0])
                group = by_free[free].pop()
                open_at[free] = bool(by_free[free])
            else:
                free = capacity
                group = Group(-(-int(left[length]) // (capacity // length)), capacity, [])
                groups.append(group)
            copies = min(free // length, int(left[length]))
            packs = min(group.packs, int(left[length]) // copies)
            if packs < group.packs:
                first, rest = group.split(packs)
                group.packs, group.items = first.packs, first.items
                groups.append(rest)
                by_free.setdefault(free, []).append(rest)
                open_at[free] = True
            group.items = [*group.items, (length, take(length, packs * copies), copies, capacity - free)]
            group.free = free - copies * length
            by_free.setdefault(group.free, []).append(group)
            open_at[group.free] = True


# --- applying the plan ------------------------------------------------------------------------------

def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, anything else).

    Pieces are numbered by (length, doc_id, piece); equal rows take any order among themselves. No piece
    is longer than `capacity`. An empty table gives no rows.
    """
    numbered = number_rows(cut(pieces), ["length", "doc_id", "piece", "start"], "__place")
    counts = {int(r["length"]): int(r["n"]) for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    begin, total = {}, 0
    for length in sorted(counts):
        begin[length] = total
        total += counts[length]
    rows, sequences = [], 0
    for g in plan(counts, capacity):
        for length, first, copies, at in g.items:
            rows.append((begin[length] + first, sequences, copies, at, length))
        sequences += g.packs
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number = batch.pop("__place").to_numpy() - 1
            first, base, copies, at, length = table[np.searchsorted(table[:, 0], number, "right") - 1].T
            batch["sequence_id"] = base + (number - first) // copies
            batch["offset"] = at + (number - first) % copies * length
            yield batch

    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return numbered.mapInPandas(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their ids and their place: tokenise, then place."""
    return place(tokenise(docs, tokenizer, end_id, capacity), capacity)


def with_digest(pieces: DataFrame) -> DataFrame:
    """ids replaced by their CRC-32."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
