"""Language identification in two steps: language family, then languages within the family.

A text becomes the shares of its hashed character pairs and triples. A linear softmax tells families
apart; within a family, a linear support vector machine for each pair of languages votes.

The models are trained on the driver from a bounded sample: at most PER_LANGUAGE texts of each language,
chosen by a hash of their id from all rows that may be learned from. Applying them is one pass over the
texts without a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.numbering import first_n
from gradeloom.llm.common import held_out

FEATURES = 1 << 13
PER_LANGUAGE = 250   # bound of the training sample
UNKNOWN = "und"

# Families of languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa", "gu"],
    "semitic": ["ar", "he", "am", "mt"],
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def counts(text: str) -> np.ndarray:
    """Occurrences of hashed character pairs and triples of the lower-cased text between two blanks."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    pairs = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(31) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h = np.concatenate([pairs, triples])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return np.bincount(h >> np.uint32(32 - 13), minlength=FEATURES)


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    scale: np.ndarray                     # per feature
    family_weights: np.ndarray            # feature x family, last row the constant
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        x = np.stack([counts(t) for t in texts]).astype(np.float32)
        x *= self.scale / x.sum(1, keepdims=True)
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        family = _softmax(x @ self.family_weights)
        margins = {pair: x @ w for pair, w in self.pair_weights.items()}
        langs, scores = [], []
        for i, k in enumerate(family.argmax(1)):
            members = self.members[self.families[k]]
            votes = dict.fromkeys(members, 0.0)
            sure = {m: [] for m in members}
            for a, b in itertools.combinations(members, 2):
                p = 1 / (1 + np.exp(-4 * float(np.clip(margins[a, b][i], -10, 10))))
                sure[a].append(p)
                sure[b].append(1 - p)
                votes[a if p >= 0.5 else b] += 1
            best = max(members, key=lambda m: (votes[m], sum(sure[m])))
            langs.append(best)
            scores.append(float(family[i, k]) * float(np.mean(sure[best])) if sure[best] else float(family[i, k]))
        return langs, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descend(x: np.ndarray, gradient, shape: tuple[int, ...], ridge: float, rounds: int = 80) -> np.ndarray:
    """Accelerated gradient descent with the step that the largest singular value allows."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-30
    bound = float(np.linalg.norm(x @ v) ** 2) * 2 / len(x) + ridge
    w = np.zeros(shape, np.float32)
    ahead, momentum = w, 1.0
    for _ in range(rounds):
        new = ahead - (gradient(ahead) / len(x) + ridge * ahead) / bound
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = new + np.float32((momentum - 1) / following) * (new - w)
        w, momentum = new, following
    return w


def train(raw: np.ndarray, langs: list[str]) -> Model:
    """Fits all models to rows of feature counts and their languages."""
    x = raw.astype(np.float32)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    scale = (1 / np.sqrt(x.mean(0) + 1e-6)).astype(np.float32)
    x *= scale
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    names = sorted(set(langs))
    families = sorted({family_of(n) for n in names})
    members = {f: [n for n in names if family_of(n) == f] for f in families}
    lang = np.array(langs)
    target = np.array([[family_of(n) == f for f in families] for n in langs], np.float32)
    family_weights = _descend(x, lambda w: x.T @ (_softmax(x @ w) - target), (x.shape[1], len(families)), 1e-4)
    pairs = {}
    for f in families:
        for a, b in itertools.combinations(members[f], 2):
            rows = (lang == a) | (lang == b)
            part, sign = x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32)

            def hinge(w, part=part, sign=sign):
                return part.T @ (-2 * sign * np.maximum(0, 1 - sign * (part @ w)))

            pairs[a, b] = _descend(part, hinge, (x.shape[1],), 1e-3)
    return Model(families, members, scale, family_weights, pairs)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Trains on at most `per_language` different rows (id and text) of each language, chosen by a hash of both; null
    languages, null ids, null texts and texts without a letter are no examples, and rows that repeat are one.
    None where there is no example."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "lang", "text", F.xxhash64("text").alias("key"))
    keys = ["doc_id", "lang", "key"]
    chosen = first_n(rows.select(*keys).distinct(), ["lang"], [F.xxhash64("doc_id", "key"), F.col("doc_id"), F.col("key")], per_language)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "lang": batch["lang"],
                "features": [counts(t).astype("<u4").tobytes() for t in batch["text"]]})

    # at most per_language rows for each language: small enough for every task
    sample = rows.join(F.broadcast(chosen), keys, "left_semi").dropDuplicates(keys)
    got = sample.select("doc_id", "lang", "text").mapInPandas(run, "doc_id long, lang string, features binary").toPandas()
    got = got.sort_values(["doc_id", "lang", "features"])
    if not len(got):
        return None
    raw = np.stack([np.frombuffer(b, "<u4") for b in got["features"]])
    return train(raw, got["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The input's columns with lang_pred and score in place of any such columns.

    Null texts, texts without a letter, and all texts where nothing could be learned are `und` with score
    0. Very long texts are read whole.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
            known = np.flatnonzero(texts.notna().to_numpy()) if model else []
            for at in range(0, len(known), 256):
                rows = known[at:at + 256]
                langs, scores = model.predict([texts.iloc[i] for i in rows])
                out.iloc[rows, 0], out.iloc[rows, 1] = langs, scores
            yield out

    udf = F.pandas_udf(run, "lang_pred string, score double")
    worded = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    plain = docs.drop("lang_pred", "score")
    return plain.withColumn("__said", udf(worded)).select(
        *[F.col(f"`{c}`") for c in plain.columns], "__said.lang_pred", "__said.score")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out.

    Rows that repeat are reported one by one, with equal results, and are one example. Of languages with equal
    votes and certainty the first by name wins. A null id counts as held out. An empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
