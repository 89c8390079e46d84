"""Quality decisions by hierarchical empirical Bayes: a document's own evidence and where it comes from.

Evidence is a logistic regression for each cause of rejection (poor quality, toxicity), fitted in numpy on a
bounded sample of labelled documents (``FIT_ROWS``, those with the least id hashes), over measures of the whole
text: shares of repeated, upper-case, symbol-laden, tabular and shouting words, variety, lengths, and what its
words say of the cause. A document is good if no cause holds, so the chances of being without each are multiplied.

A word says as much as the strongest of its pieces: itself and its first ``STEMS`` letters, so that the inflected
words of a rarer language count together. A piece has the log odds of the cause among the labelled documents
that hold it against those of all, shrunk as by ``SHRINKAGE`` further documents at the common rate; no piece is
left out for being rare. At most ``PIECES`` pieces of a cause are kept, those that deviate most. The regression
sees labelled documents with weights from the other ``FOLDS`` - 1 folds only, as rare pieces would else repeat
the label.

Sites are two-level: a host and a path within it. The mean evidence of all documents gives a global
rate of good documents; hosts shrink towards it, and paths towards their host, with strengths estimated by
moments from how much hosts (and paths) really differ. A sparse site so stays near the rate above
it. A document's posterior odds are its evidence odds times the site's prior odds over
those of the fit. Documents with a posterior of at least one half are kept.

All statistics are grouped sums, added up in tasks first, so a host with a third of all
documents is one row per task. Site tables are broadcast only if measured small.

Cases: a null or empty text has the measures of no words, and is rejected: there is nothing to keep;
null hosts or paths are sites of their own; without labels of both kinds every text that has a word is
kept; null ids and repeated rows are rows like others; an empty table gives an empty result;
``keep`` returns all columns, whatever their names.
"""

from __future__ import annotations

import math
import string
import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.common import broadcast_if_small, read_documents, row_map, unused
from caudal.session import checkpointed, scratch_path

FIT_ROWS = 8000
STEMS = (4, 6, 8)
SHRINKAGE = 2.0
LEAST_WEIGHT = 0.5
PIECES = 20_000
FOLDS = 4
CACHED_WORDS = 200_000
COUNTED_DOCUMENTS = 250
ENTRY = np.dtype([
    ("hash", "u8"), ("length", "u2"), ("letters", "u2"), ("upper", "u1"), ("symbols", "u1"),
    ("table", "u1"), ("shout", "u1"), ("digit", "u1"), ("pad", "u1"), ("says", "f4", (2,)),
])
CAUSES = 2
PACKED = struct.Struct("<QHHBBBBBBff")
"""``ENTRY`` as written for one word."""


def plain(word: str) -> str:
    inner = word.strip(string.punctuation)  # none of these is a letter
    return inner.lower() if inner.isalpha() else "".join(filter(str.isalpha, word)).lower()


def digest(piece: str) -> int:
    return xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass")) >> 1


def pieces(letters: str) -> list[int]:
    """Digests of a word and of its beginnings."""
    if not letters:
        return []
    hashed, size = xxhash.xxh3_64_intdigest, len(letters)
    if letters.isascii():
        data = letters.encode()
        return [hashed(data) >> 1, *[hashed(data[:k] + b"-") >> 1 for k in STEMS if size >= k]]
    return [digest(letters), *[digest(letters[:k] + "-") for k in STEMS if size >= k]]


class Pieces(dict):
    """Digests of the pieces of words, as bytes; a bounded table."""

    def __missing__(self, word: str) -> bytes:
        made = np.array(pieces(plain(word)), "i8").tobytes()
        if len(word) < 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = made
        return made

    def of(self, text: str) -> np.ndarray:
        """Each piece of a text once."""
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(text.split()))), "i8"))


class Measures(dict):
    """Measures of texts; a bounded table has what is known of each word.

    When it is full, it becomes the older half, from which words still in use come back.
    """

    def __init__(self, telling: Sequence[dict[int, float]]):
        super().__init__()
        self.weights = {
            piece: tuple(own.get(piece, 0.0) for own in telling) for piece in set().union(*telling)
        }
        self.silent = (0.0,) * len(telling)
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word) or self.measured(word)
        if len(word) < 64:
            if len(self) >= CACHED_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = made
        return made

    def measured(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        if word.isalpha():
            letters, marks = word.lower(), (False, False, False, False)
        else:
            letters, tail = plain(word), word[-2:]
            marks = (
                len(word) > 2 and len(set(tail)) == 1 and not tail[0].isalnum() and tail[0] != "!", word == "|",
                tail == "!!", any(map(str.isdigit, word)),
            )
        return PACKED.pack(
            xxhash.xxh3_64_intdigest(data), min(len(word), 60_000), min(len(letters), 60_000),
            len(letters) > 1 and word.upper() == word, *marks, 0, *self.says(letters),
        )

    def says(self, letters: str) -> tuple[float, ...]:
        """The weight of the strongest piece, for each cause."""
        found = [w for w in map(self.weights.get, pieces(letters)) if w] if self.weights else []
        return tuple(map(max, zip(self.silent, *found))) if found else self.silent

    def of(self, text: str | None) -> list[float]:
        words = (text or "").split()
        n = max(1, len(words))
        e = np.frombuffer(b"".join(map(self.__getitem__, words)), ENTRY)
        repeated = float((e["hash"][1:] == e["hash"][:-1]).sum()) / n
        shares = [repeated, *(float(e[k].sum()) / n for k in ("upper", "symbols", "table", "shout", "digit"))]
        spoken = []
        for c in range(CAUSES):
            weights = e["says"][:, c]
            total, squares = float(weights.sum(dtype=float)), float(np.square(weights).sum(dtype=float))
            strongest = weights if len(weights) <= 3 else np.partition(weights, -3)[-3:]
            spoken += [
                float(strongest.max(initial=0.0)), float(strongest.sum()), min(10.0, total),
                math.log1p(1000 * total / n), math.log1p(1000 * squares / n), math.log1p(squares),
            ]
        length = float(e["length"].sum())
        return [
            *shares, *(float(s > 0.1) for s in shares), *(math.sqrt(s) for s in shares),
            math.log1p(len(words)), len(np.unique(e["hash"])) / n**0.8, length / n / 10,
            1 - float(e["letters"].sum()) / max(1.0, length), *spoken, float(not len(words)),
        ]


class Evidence:
    """A logistic regression for each cause that has cases; ``base`` is the rate of good documents in its sample."""

    def __init__(self, telling: Sequence[dict[int, float]], rows: np.ndarray, causes: np.ndarray, good: np.ndarray):
        self.telling = list(telling)
        self.middle, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
        x = np.hstack([(rows - self.middle) / self.scale, np.ones((len(rows), 1))])
        self.weights = [self._fitted(x, 1 - bad) for bad in causes.T if 0 < bad.sum() < len(bad)]
        self.base = float(good.mean())

    @staticmethod
    def _fitted(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        ridge = np.eye(x.shape[1])
        weights = np.zeros(x.shape[1])
        for _ in range(25):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge
            change = np.linalg.solve(curve, x.T @ (good - p) - ridge @ weights)
            weights += change * min(1.0, 4.0 / (np.abs(change).max() + 1e-9))
        return weights

    def logit(self, measured: Sequence[Sequence[float]]) -> np.ndarray:
        x = (np.array(measured) - self.middle) / self.scale
        good = np.zeros(len(x))  # log of the chance that no cause holds
        for weights in self.weights:
            good -= np.logaddexp(0, -np.clip(x @ weights[:-1] + weights[-1], -12, 12))
        return np.clip(good - np.log(-np.expm1(np.minimum(good, -1e-12))), -12, 12)


def weight(n: Column, bad: Column, rate: float) -> Column:
    """Log odds of a cause among ``n`` documents of which ``bad`` have it, against ``rate``, shrunk."""
    odds = (bad + SHRINKAGE * rate) / (n - bad + SHRINKAGE * (1 - rate))
    return F.log(odds) - math.log(rate / (1 - rate))


def _counted(texts: list[bytes | None], *marks: list[int]) -> list[tuple]:
    """Piece, fold, documents that hold it, and those of them with each cause."""
    words, rows = Pieces(), []
    for start in range(0, len(texts), COUNTED_DOCUMENTS):
        part = slice(start, start + COUNTED_DOCUMENTS)
        held = [words.of((t or b"").decode()) for t in texts[part]]
        fold, *causes = (np.repeat(m[part], list(map(len, held))) for m in marks)
        key = np.concatenate(held)
        order = np.lexsort((fold, key))
        key, fold = key[order], fold[order]
        first = np.flatnonzero(np.r_[len(key) > 0, (key[1:] != key[:-1]) | (fold[1:] != fold[:-1])][: len(key)])
        if len(first):
            sums = [np.add.reduceat(c[order], first) for c in causes]
            n = np.diff(np.r_[first, len(key)])
            rows += zip(*(a.tolist() for a in (key[first], fold[first], n, *sums)))
    return rows


def telling_pieces(sample: DataFrame) -> list[list[dict[int, float]]]:
    """For each fold, weights of pieces from all other folds by cause; at last, those from all folds."""
    marks = ["_fold", "_poor", "_toxic"]
    found = row_map(
        sample, ["_text", *marks], "piece long, fold int, n long, _poor long, _toxic long", lambda: _counted
    )
    sizes = np.zeros((FOLDS, 1 + CAUSES))
    for r in sample.groupBy("_fold").agg(F.count(F.lit(1)), F.sum("_poor"), F.sum("_toxic")).collect():
        sizes[r[0]] = r[1:]
    total = sizes.sum(axis=0)
    sums = [
        F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
        for f in range(FOLDS) for c in ("n", "_poor", "_toxic")
    ]
    totals = [F.sum(c).alias(c) for c in ("n", "_poor", "_toxic")]
    counts = checkpointed(found.groupBy("piece").agg(*totals, *sums))
    out: list[list[dict[int, float]]] = [[] for _ in range(FOLDS + 1)]
    for c, cause in enumerate(("_poor", "_toxic"), 1):
        rate = total[c] / total[0]
        if not 0 < rate < 1:
            for own in out:
                own.append({})
            continue
        z = (F.col(cause) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        rows = (
            counts.filter(weight(F.col("n"), F.col(cause), rate) >= LEAST_WEIGHT)
            .orderBy(z.desc(), "piece").limit(PIECES)
            .select("piece", *(f"{k}{f}" for f in range(FOLDS) for k in ("n", cause))).collect()
        )
        table = np.array([r[1:] for r in rows], float).reshape(len(rows), FOLDS, 2)
        for f in range(FOLDS + 1):
            n, bad = (table.sum(axis=1) - (table[:, f] if f < FOLDS else 0)).T
            left = total - (sizes[f] if f < FOLDS else 0)
            own_rate = min(max(left[c] / max(1.0, left[0]), 1e-6), 1 - 1e-6)
            w = np.log((bad + SHRINKAGE * own_rate) / (n - bad + SHRINKAGE * (1 - own_rate)))
            w -= math.log(own_rate / (1 - own_rate))
            out[f].append({r[0]: float(v) for r, v in zip(rows, w) if v >= LEAST_WEIGHT})
    return out


def fit(
    docs: DataFrame, labels: DataFrame, good: Column, doc_id: str = "doc_id", text: str = "text",
    rows: int = FIT_ROWS, toxic: Column | None = None,
) -> Evidence | None:
    """Learn from at most ``rows`` of the documents that ``labels`` (joined on ``doc_id``) covers.

    ``good`` is a condition on ``labels``; rows for which it is null are left out. ``toxic`` tells which of the
    others are toxic (by default column ``toxic``, if there is one); the rest is of poor quality, or both.
    """
    if toxic is None:
        toxic = F.col("toxic") == 1 if "toxic" in labels.columns else F.lit(False)
    poor = ~good & (~toxic | (F.col("quality") == 0)) if "quality" in labels.columns else ~good & ~toxic
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    marked = labels.select(
        F.col(doc_id).alias("_id"), good.cast("int").alias("_good"), flag(poor).alias("_poor"),
        flag(~good & toxic).alias("_toxic"),
    ).filter("_good IS NOT NULL")
    marked = marked.withColumn("_order", F.xxhash64(F.col("_id").cast("string"))).orderBy("_order", "_id").limit(rows)
    marked = F.broadcast(marked.withColumn("_fold", F.pmod("_order", F.lit(FOLDS)).cast("int")))  # at most ``rows`` short rows
    named = docs.select(F.col(doc_id).alias("_own"), F.col(text).alias("_text"))
    sample = checkpointed(
        named.join(marked, F.col("_own") == F.col("_id")).select("_text", "_fold", "_good", "_poor", "_toxic")
    )
    total, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_good"), F.lit(0))).first()
    if not 0 < positive < total:
        return None
    weights = telling_pieces(sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights[:FOLDS])  # of at most FOLDS * CAUSES * PIECES numbers

    def make():
        measures = [Measures(own) for own in shared.value]
        return lambda texts, folds, *marks: [
            (measures[f].of((t or b"").decode()), *m) for t, f, *m in zip(texts, folds, *marks)
        ]

    data = row_map(
        sample, ["_text", "_fold", "_good", "_poor", "_toxic"], "x array<double>, good int, poor int, toxic int", make
    ).collect()
    causes = np.array([(r.poor, r.toxic) for r in data], float)
    return Evidence(weights[-1], np.array([r.x for r in data]), causes, np.array([r.good for r in data], float))


def evidence_column(docs: DataFrame, evidence: Evidence | None, text: str) -> Column:
    """Log odds of being good, from the whole text alone; null where there are no words."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)  # of fixed size
    tables: list[Measures] = []

    @F.pandas_udf("double")
    def logits(texts: pd.Series) -> pd.Series:
        own = shared.value
        if not tables:
            tables.append(Measures(own.telling if own else [{}] * CAUSES))
        measured = [tables[0].of(t) for t in texts]
        values = own.logit(measured) if own and measured else np.full(len(texts), 12.0)
        return pd.Series([None if m[-1] else v for m, v in zip(measured, values)], dtype="float64")

    return logits(F.col(text))


def _strength(rate: float, groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of a beta prior by moments: binomial variance over the variance between groups."""
    row = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n"),
        F.sum(F.col("_n") * (F.col("_p") / F.col("_n") - mean) ** 2).alias("ss"),
        F.sum(F.col("_n").cast("double") ** 2).alias("n2"), F.sum("_v").alias("v"),
    ).first()
    if not row.n or row.k < 2:
        return 100.0
    within = row.v / row.n  # mean variance of the evidence inside groups
    effective = row.n - row.n2 / row.n
    between = (row.ss - (row.k - 1) * within) / effective if effective > 0 else 0.0
    return float(np.clip(rate * (1 - rate) / between - 1, 1.0, 1e6)) if between > 1e-9 else 1e6


def site_rates(evidence: DataFrame) -> tuple[float, DataFrame]:
    """Global rate, and _host, _path, _rate (posterior mean), for rows _host, _path, _logit."""
    p = 1 / (1 + F.exp(-F.col("_logit")))
    sums = evidence.filter("_logit IS NOT NULL").groupBy("_host", "_path").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_p"), F.sum(p * p).alias("_p2")
    )
    sums = checkpointed(sums.withColumn("_v", F.greatest(F.col("_p2") - F.col("_p") ** 2 / F.col("_n"), F.lit(0.0))))
    hosts = sums.groupBy("_host").agg(*(F.sum(c).alias(c) for c in ("_n", "_p", "_v")))
    total = hosts.agg(F.sum("_p"), F.sum("_n")).first()
    rate = total[0] / total[1] if total[1] else 0.5
    k_host = _strength(rate, hosts, F.lit(rate))
    shrunk = hosts.select(
        F.col("_host").alias("_h"), ((F.col("_p") + k_host * rate) / (F.col("_n") + k_host)).alias("_host_rate"),
        (F.col("_p") / F.col("_n")).alias("_mean"),
    )
    joined = sums.join(shrunk, F.col("_host").eqNullSafe(F.col("_h")))
    k_path = _strength(rate, joined, F.col("_mean"))
    return rate, joined.select(
        "_host", "_path", ((F.col("_p") + k_path * F.col("_host_rate")) / (F.col("_n") + k_path)).alias("_rate")
    )


def _posterior(logit: Column, rate: Column, base: float) -> Column:
    prior = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    base = min(max(base, 1e-4), 1 - 1e-4)
    moved = logit + F.log(prior / (1 - prior)) - math.log(base / (1 - base))
    return F.coalesce(1 / (1 + F.exp(-moved)), F.lit(0.0))


def assess(
    docs: DataFrame, evidence: Evidence | None, host: Column, path: Column,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, evidence, site_rate, posterior, kept for every row."""
    rows = checkpointed(docs.select(
        F.col(doc_id).alias("_id"), host.alias("_host"), path.alias("_path"),
        evidence_column(docs, evidence, text).alias("_logit"),
    ))
    rate, sites = site_rates(rows)
    sites = broadcast_if_small(sites.select(F.col("_host").alias("_h"), F.col("_path").alias("_q"), "_rate"), 200)
    same = F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_q"))
    prior = F.coalesce("_rate", F.lit(rate))
    posterior = _posterior(F.col("_logit"), prior, evidence.base if evidence else rate)
    return rows.join(sites, same, "left").select(
        F.col("_id").alias(doc_id), (1 / (1 + F.exp(-F.col("_logit")))).alias("evidence"),
        prior.alias("site_rate"), posterior.alias("posterior"), (posterior >= 0.5).alias("kept"),
    )


def keep(docs: DataFrame, evidence: Evidence | None, host: Column, path: Column, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns. Texts are measured once: rows and their evidence are stored first."""
    h, q, logit, site_h, site_q, site_rate = (unused(docs.columns, n) for n in ("_host", "_path", "_logit", "_h", "_q", "_rate"))
    stored = scratch_path(docs.sparkSession, "measured")
    docs.withColumns({h: host, q: path, logit: evidence_column(docs, evidence, text)}).write.parquet(stored)
    measured = docs.sparkSession.read.parquet(stored)
    # reads three short columns
    rate, sites = site_rates(measured.select(F.col(h).alias("_host"), F.col(q).alias("_path"), F.col(logit).alias("_logit")))
    sites = broadcast_if_small(
        sites.select(F.col("_host").alias(site_h), F.col("_path").alias(site_q), F.col("_rate").alias(site_rate)), 200
    )
    same = F.col(h).eqNullSafe(F.col(site_h)) & F.col(q).eqNullSafe(F.col(site_q))
    prior = F.coalesce(F.col(site_rate), F.lit(rate))
    posterior = _posterior(F.col(logit), prior, evidence.base if evidence else rate)
    return measured.join(sites, same, "left").filter(posterior >= 0.5).select(*docs.columns)


def site(column: str) -> tuple[Column, Column]:
    """Host and first path step of addresses like ``host/step/...``, with or without a scheme."""
    bare = F.regexp_replace(F.col(column), r"^[A-Za-z]+://", "")
    return F.substring_index(bare, "/", 1), F.split_part(bare, F.lit("/"), F.lit(2))


def acceptable() -> Column:
    """A label of good quality that is not toxic."""
    return (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    evidence = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), acceptable())
    return assess(docs, evidence, F.col("source"), F.col("lang"))
