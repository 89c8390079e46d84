"""Toxicity against held-out labels and against the model computed in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.llm import toxicity
from caudal.llm.common import fold, read_documents

LABELS = "doc_id long, quality int, toxic int"


def slow_features(text):
    """The n-grams themselves."""
    marked = "".join(c if c.isalpha() else "\0" for c in f"\0{text.lower()}\0")
    found = set()
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        for i in range(len(marked) - n + 1):
            part = marked[i : i + n]
            if "\0" not in part[1:-1]:
                found.add(part)
    return found


def bucket(part):
    mixed = 0
    for i, c in enumerate(part):
        code = 0 if c == "\0" else ord(c)
        mixed = code if not i else (mixed * 0x9E3779B1 + code) % 2**32
    h = (mixed + len(part)) * 0x85EBCA6B % 2**32
    return ((h ^ (h >> 15)) * 0xC2B2AE35 % 2**32) >> (32 - toxicity.BUCKET_BITS)


@pytest.mark.parametrize("text", ["", "a", "ab", "Abc", "one two, three", "the  idiot's réeux!", "x" * 30, "漢字 ok \U0001f600 a1b", "1234 !!"])
def test_features_are_all_n_grams_inside_words(text):
    assert toxicity.features(text).tolist() == sorted({bucket(p) for p in slow_features(text)})


def test_windows_cover_long_texts(monkeypatch):
    text = "some words, and others that go on " * 20
    whole = toxicity.features(text).tolist()
    for size in (1, 7, 50):
        monkeypatch.setattr(toxicity, "WINDOW", size)
        assert toxicity.features(text).tolist() == whole


@pytest.fixture(scope="module")
def trained(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.assess(docs, model).withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    return scored.join(docs, "doc_id").join(labels, "doc_id").filter("held_out").toPandas(), model


def test_held_out_labels(trained):
    """Documents of good quality; junk carries labels at random."""
    rows, _ = trained
    good = rows[rows["quality"] == 1]
    toxic = good[good["toxic"] == 1]
    assert len(toxic) > 60 and (toxic["predicted"] == 1).mean() >= 0.95
    assert (good[good["toxic"] == 0]["predicted"] == 0).mean() >= 0.99
    assert (toxic[toxic["lang"] == "en"]["predicted"] == 1).mean() >= 0.98


def test_scores_are_those_of_plain_sums(trained):
    rows, model = trained
    for r in rows.sort_values("n_chars").head(40).itertuples():
        odds = model.intercept + sum(float(model.table[b]) for b in {bucket(p) for p in slow_features(r.text)})
        assert math.isclose(r.score, 1 / (1 + math.exp(-odds)), rel_tol=1e-6)
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.5)).all()


def test_ratios_and_counts(spark):
    texts = ["bad dog"] * 30 + ["good cat"] * 90 + ["good dog"] * 30
    marks = [1] * 30 + [0] * 120
    sample = spark.createDataFrame(list(zip(texts, marks)), "_text string, _toxic long")
    counts = {r["bucket"]: (r["n"], r["toxic"]) for r in toxicity.bucket_counts(sample).collect()}
    assert counts[bucket("\0bad\0")] == (30, 30) and counts[bucket("dog")] == (60, 30) and counts[bucket("good")] == (120, 0)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.table[bucket("\0bad\0")] > 0 > model.table[bucket("good")]
    assert model.score("a bad cow") > 0.5 > model.score("a good cow")


def test_without_both_kinds_of_labels(spark, awkward):
    none = spark.createDataFrame([], LABELS)
    scores = toxicity.assess(awkward, toxicity.fit(awkward, none)).collect()
    assert len(scores) == awkward.count() and all(r["predicted"] == 0 and 0 < r["score"] < 0.5 for r in scores)
    clean = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, 0), (9, 1, None)], LABELS)
    assert not any(r["predicted"] for r in toxicity.assess(awkward, toxicity.fit(awkward, clean)).collect())
    toxic = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 6)], LABELS)
    assert all(r["predicted"] for r in toxicity.assess(awkward, toxicity.fit(awkward, toxic)).collect())


def test_regression_separates():
    rows = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([], int)] * 20
    weights, intercept = toxicity.regression(rows, np.array([1.0, 1.0, 0.0, 0.0] * 20), np.array([2.0, -1.0]))
    assert 2 * weights[0] + intercept > 0 > intercept
