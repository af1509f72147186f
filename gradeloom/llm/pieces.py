"""Encoding and decoding with the pieces of a SentencePiece model.

A text is marked (a word sign for every blank, one in front) and falls into marked words: word signs with
the characters up to the next one. No piece holds a word sign behind another character, so the pieces of a
text are those of its words.

Words are encoded by a forward pass over prefixes. The model merges neighbours, best-scored piece first;
for such a model a sequence of pieces is the encoding of a string exactly if each neighbouring pair is the
encoding of the two joined. So each prefix has one last piece: the one that is compatible with the last
piece of the prefix before it. That is what the forward pass stores at each prefix, in place of the best
sum of scores that a unigram model would store.

The distinct words of a batch are sorted, which is a depth-first walk of their trie: a word keeps the
states of the prefix that it shares with the word before and computes the rest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
BPE = 2               # fixed value: the model kind of a model file
CACHED_WORDS = 400_000
CACHED_PAIRS = 300_000
CACHED_LENGTH = 40
SLICE = 500    # texts encoded and decoded at once

_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_models: dict[str, "Pieces"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model file of kind BPE with byte fallback and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = SentencePieceProcessor(model_file=path)
        if sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec.model_type != BPE:
            raise ValueError("the model does not merge neighbours by score")
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        plain = [i for i in range(len(self.text))
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        if any(MARK in t.lstrip(MARK) for t in self.id):
            raise ValueError("a piece holds a word sign behind another character")
        # by its last three characters, how long a piece can be
        self.reach: dict[str, int] = {}
        for t in self.id:
            if len(t) > 2:
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
        shown = {i: bytes([b]) for b, i in self.byte.items()} | {i: self.text[i].encode() for i in plain}
        self.raw = [shown.get(i, b"") for i in range(len(self.text))]
        self.unknown = model.unk_id()
        self.known: dict[str, bytes] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    # --- the rule by definition, on short strings --------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Neighbours joined while the joined string is a piece, the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        """Whether the encoding of the piece's text is the piece."""
        if piece not in self._whole:
            self._whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return self._whole[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the encoding of the two joined is the two: only then do they stand side by side."""
        key = left, right
        if key not in self._pairs:
            if len(self._pairs) > CACHED_PAIRS:
                self._pairs.clear()
            self._pairs[key] = self.merged(left + right) == [left, right]
        return self._pairs[key]

    # --- the forward pass ---------------------------------------------------------------------------------

    def encode_sorted(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each word; the words are distinct and sorted."""
        last: list[str] = [""]   # last piece of each prefix of the word at hand
        before = ""
        score, reach, whole, compatible = self.score, self.reach, self.whole, self.compatible
        for word in words:
            shared = 0
            top = min(len(before), len(word))
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                found = word[end - 1]   # a single character always can stand
                longest = reach.get(word[end - 3:end], 2) if end > 2 else 2
                for start in range(max(0, end - longest), end - 1):
                    piece = word[start:end]
                    if piece in score and whole(piece) and (not start or compatible(last[start], piece)):
                        found = piece
                        break
                last.append(found)
            before = word
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            parts.reverse()
            yield parts

    def ids(self, parts: list[str]) -> list[int]:
        """Ids of pieces; a character that is none becomes its bytes."""
        out: list[int] = []
        for part in parts:
            known = self.id.get(part)
            if known is not None:
                out.append(known)
            elif self.byte:
                out += [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers. Words seen before come from a table of
        at most CACHED_WORDS entries."""
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = sorted(set().union(*split).difference(self.known))
        for word, parts in zip(new, self.encode_sorted(new)):
            self.known[word] = array("I", self.ids(parts)).tobytes()
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > CACHED_LENGTH or len(self.known) > CACHED_WORDS:
                del self.known[word]
        return out

    def decode(self, ids: bytes) -> str:
        """The text again: pieces and bytes joined, word signs to blanks, the one in front taken off."""
        data = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """The input's columns and `ids` (binary, little-endian uint32). A null text counts as empty, and an
    empty text has no ids. Row by row, no shuffle."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            done: list[bytes] = []
            for at in range(0, len(texts), 1000):
                done += _pieces(model).encode(texts.iloc[at:at + 1000].tolist())
            yield pd.Series(done, dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "binary")(F.coalesce(F.col(text_col), F.lit(""))))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The input's columns and the text of its ids; null ids give a null text. Where a text itself holds the
    word sign, a blank comes back in its place."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if x is None else _pieces(model).decode(x) for x in ids], dtype=object)

    return encoded.withColumn(out, F.pandas_udf(run, "string")(F.col(ids_col)))


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (unsigned, of the little-endian unsigned 32-bit ids), decoded_sha256 and
    round_trip (whether decoding gives the text back, word signs counting as blanks) of every row.

    A null text counts as empty; an empty table gives no rows; rows that repeat are reported one by one; other
    columns are ignored. Only models that merge by score (kind BPE) are read: for a unigram model the state of a
    prefix would be a best sum, which this pass does not keep, and `Pieces` refuses it.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _pieces(model)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at:at + SLICE]
                rows = []
                for doc_id, text, ids in zip(part["doc_id"], part["text"], known.encode(part["text"].tolist())):
                    back = known.decode(ids)
                    rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(),
                                 back == text.replace(MARK, " ")))
                yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    # both ways in one worker, a slice of texts at a time: ids never leave it. Ids of documents go as text, since
    # numbers with nulls among them would come as floating point
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(
        run, "doc_id string, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    ).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
