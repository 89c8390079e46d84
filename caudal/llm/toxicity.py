"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Features of a text are its distinct n-grams of ``SHORTEST`` to ``LONGEST`` characters inside words, word ends
marked, hashed to ``1 << BUCKET_BITS`` buckets. A bucket's ratio is the log of its share among toxic documents
over its share among the others, smoothed as by ``SMOOTHING`` further documents at the common rate, so that what
was hardly seen says nothing. Buckets whose count of toxic documents is within ``LEAST_DEVIATIONS`` standard
deviations of what the common rate makes likely are left out: they would repeat the labels of single documents.
A logistic regression over the remaining presences, each scaled by its ratio, gives the score.

Counts per bucket are sums over tasks. Learning reads a bounded sample of labelled rows (``FIT_ROWS``, those with
the least id hashes), whole texts; scoring reads whole texts, a window at a time, so that a very long text costs
its own length and no more.

Cases: a null text counts as empty and has no features, so its score is that of the intercept; null labels are
not learnt from; without toxic or without other labelled rows every score is the smoothed rate of the labels, below one half
if there are none; a document with several label rows counts once for each; null ids and repeated rows are rows like
others (a null id hashes as the empty text); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.common import fold, read_documents, row_map
from caudal.llm.language import letter_table
from caudal.session import checkpointed

FIT_ROWS = 16_000
SHORTEST, LONGEST = 3, 8
BUCKET_BITS = 20
SMOOTHING = 2.0
LEAST_DEVIATIONS = 5.0
PENALTY = 1 / 30
STEPS = 200
RATE = 0.3
WINDOW = 1 << 16
BUCKETS = "bucket int, n long, toxic long"


def windows(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, window by window; an n-gram may come twice."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.zeros(len(codes) + 2, np.uint32)  # zeros are word ends
    padded[1:-1] = np.where(letter_table()[codes], codes, 0)
    for start in range(0, len(codes), WINDOW):
        part = padded[start : start + WINDOW + LONGEST + 1]
        inside = part != 0
        mixed, within = part, None
        for n in range(2, LONGEST + 1):
            last = len(part) - n + 1
            if last <= 0:
                break
            mixed = mixed[:last] * np.uint32(0x9E3779B1) + part[n - 1 :]
            if n == 2:
                continue
            within = inside[1 : last + 1] if n == 3 else within[:last] & inside[n - 2 : n - 2 + last]
            if n >= SHORTEST:
                hashed = (mixed[within] + np.uint32(n)) * np.uint32(0x85EBCA6B)
                hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
                yield hashed >> np.uint32(32 - BUCKET_BITS)


def features(text: str, among: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, or those ``among`` marks."""
    found = [b if among is None else b[among[b]] for b in windows(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


class Model:
    """``table``: what each bucket adds to the log odds, ratios included."""

    def __init__(self, table: np.ndarray, intercept: float):
        self.table, self.intercept = table, float(intercept)
        self.marked = table != 0

    def score(self, text: str) -> float:
        odds = self.intercept + float(self.table[features(text, self.marked)].sum(dtype=float))
        return 1 / (1 + math.exp(-min(max(odds, -30.0), 30.0)))


def deviation(n: Column, toxic: Column, rate: float) -> Column:
    return (toxic - n * rate) / F.sqrt(n * rate * (1 - rate))


def bucket_counts(sample: DataFrame) -> DataFrame:
    """``BUCKETS``: documents and toxic documents that hold a bucket, for rows _text, _toxic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = features(text or "")
                counts[0, own] += 1
                counts[1, own] += toxic
        held = np.flatnonzero(counts[0])
        arrays = [pa.array(held.astype(np.int32)), pa.array(counts[0, held]), pa.array(counts[1, held])]
        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "n", "toxic"])

    parts = sample.select("_text", "_toxic").mapInArrow(run, BUCKETS)
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def regression(rows: list[np.ndarray], target: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept by adaptive gradient steps; ``rows`` hold the positions of what is present."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if len(at) else np.zeros(0, np.int64)
    size, weights, intercept = len(target), np.zeros(len(ratios)), 0.0
    seen, seen_intercept = np.full(len(ratios), 1e-8), 1e-8
    for _ in range(STEPS):
        odds = np.bincount(at, (weights * ratios)[column], size) + intercept
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target
        slope = np.bincount(column, error[at], len(ratios)) * ratios / size + PENALTY * weights / size
        seen += slope * slope
        seen_intercept += error.mean() ** 2
        weights -= RATE * slope / np.sqrt(seen)
        intercept -= RATE * error.mean() / math.sqrt(seen_intercept)
    return weights, intercept


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    rows: int = FIT_ROWS,
) -> Model:
    """Learn from at most ``rows`` of the documents that ``labels`` (joined on ``doc_id``) covers."""
    marked = labels.select(
        F.col(doc_id).alias("_id"), (F.col(toxic) == 1).cast("long").alias("_toxic"),
        F.xxhash64(F.col(doc_id).cast("string")).alias("_order"),
    ).filter("_toxic IS NOT NULL")
    marked = F.broadcast(marked.orderBy("_order", "_id", "_toxic").limit(rows))  # at most ``rows`` short rows
    named = docs.select(F.col(doc_id).alias("_own"), F.col(text).alias("_text"))
    sample = checkpointed(named.join(marked, F.col("_own") == F.col("_id")).select("_text", "_toxic"))
    total, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    if not 0 < positive < total:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), math.log((positive + 0.5) / (total - positive + 1)))
    rate = positive / total
    telling = bucket_counts(sample).filter(F.abs(deviation(F.col("n"), F.col("toxic"), rate)) >= LEAST_DEVIATIONS)
    # a row for each telling bucket, of which there are 1 << BUCKET_BITS at most
    found = telling.orderBy("bucket").toPandas()
    buckets, n, bad = (found[c].to_numpy() for c in ("bucket", "n", "toxic"))
    ratios = np.log((bad + SMOOTHING * rate) / positive)
    ratios -= np.log((n - bad + SMOOTHING * (1 - rate)) / (total - positive))
    among = np.zeros(1 << BUCKET_BITS, bool)
    among[buckets] = True
    shared = docs.sparkSession.sparkContext.broadcast(among)  # of fixed size

    def make():
        own = shared.value
        return lambda texts, marks: [(features((t or b"").decode(), own).tolist(), m) for t, m in zip(texts, marks)]

    data = row_map(sample, ["_text", "_toxic"], "x array<int>, y int", make).collect()
    present = [np.searchsorted(buckets, np.array(r.x, np.int64)) for r in data]
    weights, intercept = regression(present, np.array([r.y for r in data], float), ratios)
    table = np.zeros(1 << BUCKET_BITS, np.float32)
    table[buckets] = weights * ratios
    return Model(table, intercept)


def assess(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (score of one half or more) for every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the corpus

    def make():
        score = shared.value.score
        return lambda ids, texts: [(i, s, int(s >= 0.5)) for i, s in zip(ids, (score((t or b"").decode()) for t in texts))]

    renamed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return row_map(renamed, ["_id", "_text"], f"{doc_id} {kind}, score double, predicted int", make)


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return assess(docs, model).select("doc_id", held, "score", "predicted")
