"""Toxicity by subword-bag embeddings.

A word is the mean of the vectors of its character n-grams and itself, a text the mean of its words, and
a linear softmax over that mean gives the score. Vectors and softmax are trained jointly in numpy on a
bounded sample, so a misspelling that was never seen shares the n-gram vectors of the word it bends.

Repetition counts by its square root, and a text of fewer than FLOOR words is averaged as if it had
FLOOR, so one word said a hundred times, or a text of three words, is no more certain than it should be.
N-grams whose share does not differ between the labels by more than chance are left out before training:
they could only memorise single texts.

Because everything after training is linear, a text's score needs one number per n-gram bucket. Applying
it is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.functions.numbering import first_n
from gradeloom.llm.common import held_out

BUCKETS = 1 << 17
SIZES = (4, 5, 6)
WIDTH = 4
ROUNDS = 120
FLOOR = 30         # least number of words that a text is averaged over
SLICE = 50         # texts whose n-grams are listed at a time
LEAST_TEXTS = 5    # an n-gram must occur in so many texts of the sample
LEAST_T = 4.5      # and its mean share must differ by so many standard errors,
LEAST_BUCKETS = 200  # but so many of those that differ most take part in any case
PER_LABEL = {0: 3000, 1: 1500}   # bound of the training sample, by label

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of `<word>` and of the word as a whole, and the number of ids per word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "<" + "><".join(words) + ">"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = np.repeat(np.arange(len(words)), size)
    end = np.repeat(start + size, size)
    at = np.arange(len(c))
    ids, owner = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, min(max(SIZES), len(c)) + 1):
        shifted = np.zeros(len(c), np.uint64)
        shifted[:len(c) - n + 1] = c[n - 1:]
        h = (h ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            fits = at + n <= end
            ids.append((h[fits] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 17))
            owner.append(word[fits])
    # the whole word: a polynomial over its characters
    place = (at - start[word]).astype(np.uint64)
    term = (c + np.uint64(7)) * (place * np.uint64(0x94D049BB133111EB) + np.uint64(0xD6E8FEB86659FD93))
    term ^= term >> np.uint64(31)
    whole = np.add.reduceat(term * np.uint64(0xC2B2AE3D27D4EB4F), start)
    ids.append(whole >> np.uint64(64 - 17))
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(ids)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def shares(words: list[str]) -> dict[str, float]:
    """Part of each word in the mean of its text."""
    found = Counter(words)
    whole = max(sum(n ** 0.5 for n in found.values()), FLOOR)
    return {w: n ** 0.5 / whole for w, n in found.items()}


@dataclass
class Model:
    bucket_logit: np.ndarray
    constant: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1. The words of a batch are looked at once each."""
        bags = [shares(words_of(t)) for t in texts]
        distinct = list({w for bag in bags for w in bag})
        value = dict(zip(distinct, self.word_logits(distinct).tolist()))
        z = np.array([sum(value[w] * p for w, p in bag.items()) for bag in bags]) + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def word_logits(self, words: list[str]) -> np.ndarray:
        ids, n = subwords(words)
        if not len(n):
            return np.zeros(0)
        return np.add.reduceat(self.bucket_logit[ids], np.concatenate([[0], np.cumsum(n)[:-1]])) / n


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, weight) of all texts: the share of a word, divided among its n-grams."""
    bags = [shares(words_of(t)) for t in texts]
    names = sorted({w for bag in bags for w in bag})
    number = {w: i for i, w in enumerate(names)}
    ids, n = subwords(names)
    start = np.concatenate([[0], np.cumsum(n)])[:-1]
    text = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    word = np.array([number[w] for bag in bags for w in bag], dtype=np.int64)
    share = np.array([p for bag in bags for p in bag.values()])
    repeats = n[word]
    inside = np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    bucket = ids[np.repeat(start[word], repeats) + inside]
    key = np.repeat(text, repeats).astype(np.int64) * BUCKETS + bucket
    key, place = np.unique(key, return_inverse=True)
    weight = np.bincount(place, weights=np.repeat(share / np.maximum(repeats, 1), repeats), minlength=len(key))
    return (key // BUCKETS).astype(np.int32), (key % BUCKETS).astype(np.int32), weight.astype(np.float32)


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_bags` of a slice, its text numbers in a byte each."""
    text, bucket, weight = _bags(texts)
    return text.astype(np.uint8), bucket, weight


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> Model:
    """Vectors and softmax, jointly, by gradient descent with momentum on all examples."""
    total = len(texts)
    # in slices, and in narrow types: a slice's n-grams at full width are all that memory holds besides the packed ones
    parts = [_packed(texts[at:at + SLICE]) for at in range(0, total, SLICE)]

    # sums of weights and of their squares by bucket: of each label, and of all
    sums, squares = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    texts_with = np.zeros(BUCKETS, np.int64)
    for i, (text, bucket, weight) in enumerate(parts):
        marked = labels[i * SLICE:(i + 1) * SLICE][text]
        texts_with += np.bincount(bucket, minlength=BUCKETS)
        for label in (0, 1):
            own = marked == label
            sums[label] += np.bincount(bucket[own], weights=weight[own], minlength=BUCKETS)
            squares[label] += np.bincount(bucket[own], weights=weight[own] ** 2, minlength=BUCKETS)

    # how far apart the mean shares of the two labels lie
    error, apart = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for label, sign in ((1, 1), (0, -1)):
        n = max(int((labels == label).sum()), 1)
        apart += sign * sums[label] / n
        error += np.maximum(squares[label] / n - (sums[label] / n) ** 2, 0) / n
    mean = sums.sum(0) / total
    spread = np.sqrt(np.maximum(squares.sum(0) / total - mean ** 2, 0))
    common = texts_with >= LEAST_TEXTS
    usual = float(np.median(spread[common])) if common.any() else 1.0
    t = np.where(common, np.abs(apart) / np.sqrt(error + usual ** 2 / total), 0)
    used = np.flatnonzero(common & (t >= min(LEAST_T, np.sort(t)[-LEAST_BUCKETS])))
    n = np.maximum(np.bincount(labels, minlength=2), 0.5)
    if not len(used):
        return Model(np.zeros(BUCKETS), float(np.log(n[1] / n[0])))

    # every n-gram on the scale of its own spread, so that rare ones can count
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    x = np.zeros((total, len(used)), np.float32)
    for i, (text, bucket, weight) in enumerate(parts):
        kept = place[bucket] >= 0
        x[i * SLICE + text[kept].astype(np.int64), place[bucket[kept]]] = weight[kept]
    del parts
    scale = (1 / (spread[used] + usual) / np.sqrt(len(used))).astype(np.float32)
    centre = mean[used].astype(np.float32)
    x -= centre
    x *= scale

    rng = np.random.default_rng(seed)
    target = np.eye(2, dtype=np.float32)[labels]
    each = np.sqrt(total / (2 * np.maximum(np.bincount(labels, minlength=2), 1)))[labels][:, None].astype(np.float32)
    values = {
        "vectors": rng.normal(0, 0.01, (len(used), WIDTH)).astype(np.float32),
        "softmax": rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), "constant": np.zeros((1, 2), np.float32)}
    speed = {k: np.zeros_like(v) for k, v in values.items()}
    for _ in range(rounds):
        meant = x @ values["vectors"]
        z = meant @ values["softmax"] + values["constant"]
        e = np.exp(z - z.max(1, keepdims=True))
        off = each * (e / e.sum(1, keepdims=True) - target) / total
        slope = {
            "vectors": x.T @ (off @ values["softmax"].T) + 1e-3 * values["vectors"],
            "softmax": meant.T @ off + 1e-3 * values["softmax"], "constant": off.sum(0, keepdims=True)}
        for k, g in slope.items():
            speed[k] = 0.9 * speed[k] - 3 * g
            values[k] = values[k] + speed[k]
    difference = values["softmax"][:, 1] - values["softmax"][:, 0]
    logit = np.zeros(BUCKETS)
    logit[used] = (values["vectors"] @ difference) * scale
    constant = float(values["constant"][0, 1] - values["constant"][0, 0]) - float(logit[used] @ centre)
    return Model(logit, constant)


def fit(docs: DataFrame, labels: DataFrame, per_label: dict[int, int] = PER_LABEL) -> Model | None:
    """Trains on at most so many different documents (id and text) of each label as `per_label` says, chosen by a hash of
    both from rows that are not held out. A document labelled both ways, or by null, is no example; a null text is
    the empty text, and rows that repeat are one. None where one label has no example."""
    marked = (
        labels.where(~held_out(F.col("doc_id"))).where(F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where(F.col("toxic") == F.col("most")).drop("most")
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    order = [F.xxhash64("doc_id", "key"), F.col("doc_id"), F.col("key")]
    found = texts.select("doc_id", "key").join(marked, "doc_id").distinct()
    chosen = first_n(found, ["toxic"], order, max(per_label.values()))
    number = F.row_number().over(Window.partitionBy("toxic").orderBy(*order))
    chosen = chosen.withColumn("n", number).where(
        F.col("n") <= F.when(F.col("toxic") == 1, per_label[1]).otherwise(per_label[0])).drop("n")
    # a bounded number of ids: small enough for every task
    got = texts.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select(
        "doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text"])
    if got["toxic"].nunique() < 2:
        return None
    return train(got["text"].tolist(), got["toxic"].to_numpy().astype(int))


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The input's columns with score and predicted in place of any such columns. Null and empty texts get
    the constant's score; without a model all scores are 0. Very long texts are read whole."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.score(texts.iloc[at:at + 500].tolist()) if model else np.zeros(len(texts.iloc[at:at + 500]))
                     for at in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    plain = docs.drop("score", "predicted")
    udf = F.pandas_udf(run, "double")
    scored = plain.withColumn("score", udf(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null texts count as empty; a null id counts as held out. Rows that repeat are reported one by one, with equal
    results. A score of exactly one half is predicted toxic. Without examples of both labels all scores are 0. An
    empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
