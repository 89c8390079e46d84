"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are the n-grams of 1 to 4 characters of its words, word boundaries marked, hashed into
a table of embeddings. A text is the mean of the embeddings of all its features; a linear softmax gives the
language. Embeddings and weights are trained by stochastic gradient descent in numpy.

Because the output is linear in the mean, a text's scores are its feature counts times a table of one
score per bucket and language. Features of a whole text of any length are hashed in a few numpy steps.

Scores are calibrated by one temperature, fitted on a fifth of the learning rows that training leaves
out. ``rejected`` marks predictions whose calibrated score is below the threshold at which at least
``PRECISION`` of those rows were right.

Learning reads a bounded sample of labelled rows (``FIT_ROWS``, chosen by hash of the id, of at most
``FIT_WORDS`` words each, chosen by hash of the word); predictions read whole texts.

Cases: a null text, or one without letters, is ``und`` with score 0 and rejected; without any labelled
row everything is ``und``; null ids and repeated rows are rows like others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.common import fold, read_documents, row_map

FIT_ROWS = 4000
FIT_WORDS = 300
BUCKET_BITS = 14
LONGEST = 4
DIMENSIONS = 12
EPOCHS = 6
RATE = 4.0
PRECISION = 0.99
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text; empty if it has no letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.zeros(len(codes) + 2, np.uint32)  # zeros are word boundaries
    padded[1:-1] = np.where(letter_table()[codes], codes, 0)
    inside = padded != 0
    found, mixed, within = [], None, None
    for n in range(1, LONGEST + 1):
        last = len(padded) - n + 1
        if last <= 0:
            break
        if n == 1:
            mixed, use = padded * np.uint32(1), inside
        else:
            mixed = mixed[:last] * np.uint32(0x9E3779B1) + padded[n - 1 :]
            # inner characters are letters; of two characters one is
            if n == 2:
                use = inside[:last] | inside[1:]
            else:
                within = inside[1 : last + 1] if n == 3 else within[:last] & inside[n - 2 : n - 2 + last]
                use = within
        hashed = (mixed[use] + np.uint32(n)) * np.uint32(0x85EBCA6B)
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        found.append(hashed >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found) if inside.any() else np.zeros(0, np.uint32)


class Model:
    def __init__(self, languages: Sequence[str], embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.bias = list(languages), bias
        self.scores = embeddings @ weights  # of each bucket
        self.temperature, self.threshold = 1.0, 0.0

    def logits(self, text: str) -> np.ndarray | None:
        own = features(text)
        if not len(own):
            return None
        return np.bincount(own, minlength=1 << BUCKET_BITS) @ self.scores / len(own) + self.bias

    def decide(self, logits: np.ndarray | None) -> tuple[str, float, bool]:
        if logits is None:
            return UNDETERMINED, 0.0, True
        p = softmax(logits[None, :] / self.temperature)[0]
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: Sequence[str], labels: Sequence[str], held: np.ndarray, seed: int = 8) -> Model:
    """Fit on the rows not ``held``; calibrate on those that are."""
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    counted = [np.unique(features(t), return_counts=True) for t in texts]
    random = np.random.default_rng(seed)
    embeddings = random.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weights, bias = random.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    rows = [i for i in np.flatnonzero(~held) if len(counted[i][0])]
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for i in random.permutation(rows):
            buckets, counts = counted[i]
            share = counts / counts.sum()
            mean = share @ embeddings[buckets]
            slope = softmax((mean @ weights + bias)[None, :])[0]
            slope[target[i]] -= 1
            back = weights @ slope
            weights -= 0.1 * rate * np.outer(mean, slope)
            bias -= 0.01 * rate * slope
            embeddings[buckets] -= rate * np.outer(share, back)
    model = Model(languages, embeddings, weights, bias)
    checks = [(model.logits(texts[i]), target[i]) for i in np.flatnonzero(held)]
    checks = [(x, y) for x, y in checks if x is not None]
    if checks:
        calibrate(model, np.array([x for x, _ in checks]), np.array([y for _, y in checks]))
    return model


def calibrate(model: Model, logits: np.ndarray, target: np.ndarray) -> None:
    """The temperature of least loss, and the least score from which on enough predictions are right."""
    at = np.arange(len(target))
    losses = {
        t: -np.log(softmax(logits / t)[at, target] + 1e-12).mean() for t in np.geomspace(0.05, 5, 60)
    }
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == target
    order = np.argsort(-score)
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    model.threshold = float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0


def fit(
    labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS
) -> Model | None:
    """Train on at most ``rows`` rows, those whose ids have the least hashes."""
    named = labelled.select(
        F.xxhash64(F.col(doc_id).cast("string")).alias("_order"),
        F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"),
    ).filter("_text IS NOT NULL AND _lang IS NOT NULL")
    # words go to the driver, not texts: at most FIT_WORDS from anywhere in a text
    words = F.array_distinct(F.split(F.lower("_text"), r"\s+"))
    some = F.slice(F.array_sort(F.transform(words, lambda w: F.struct(F.xxhash64(w), w.alias("w")))), 1, FIT_WORDS)
    # first the ids alone, so that only chosen texts are read in full
    bound = named.select("_order").orderBy("_order").limit(rows).agg(F.max("_order")).first()[0]
    if bound is None:
        return None
    sample = named.filter(F.col("_order") <= bound).select("_order", "_id", some["w"].alias("_words"), "_lang")
    found = sample.orderBy("_order", "_id").limit(rows).collect()
    texts = [" ".join(w[:64] for w in r._words) for r in found]
    held = np.array([zlib.crc32((r._id or "").encode()) % 5 == 1 for r in found])
    return train(texts, [r._lang for r in found], held)


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the corpus

    def make():
        own = shared.value

        def row(i, held, data):
            logits = own.logits(data.decode()) if own and data else None
            label, score, rejected = own.decide(logits) if own else (UNDETERMINED, 0.0, True)
            return i, held, label, score, rejected

        return lambda ids, held, texts: list(map(row, ids, held, texts))

    renamed = docs.select(
        F.col(doc_id).alias("_id"), (fold(F.col(doc_id), 5) == 0).alias("_held"), F.col(text).alias("_text")
    )
    schema = f"{doc_id} {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    return row_map(renamed, ["_id", "_held", "_text"], schema, make)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return identify(docs, fit(docs.filter(fold(F.col("doc_id"), 5) != 0)))
