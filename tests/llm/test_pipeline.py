"""The five stages on the smallest tables, each against plain Python on its own input, and the site rates of its first stage."""

import collections
import math
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from caudal.llm import quality

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACES = re.compile(r"[\x20\x09-\x0D]+")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
SEQUENCE = 1024


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each: {name: rows}, in order."""
    base, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    found = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        found[name] = docs.collect()
    return found


def texts(rows):
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_names_and_order(stages):
    assert list(stages) == ["documents", "quality", "exact_dedup", "near_dedup", "pii", "packing"]
    for name in list(stages)[1:-1]:
        assert stages[name][0].__fields__ == stages["documents"][0].__fields__


def test_quality_keeps_what_it_judges_good(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    evidence = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.acceptable())
    judged = {r["doc_id"]: r for r in quality.assess(docs, evidence, F.col("source"), F.col("lang")).collect()}
    for r in judged.values():  # the posterior is the evidence moved by the site's rate
        if r["evidence"] is not None:
            rate = min(max(r["site_rate"], 1e-4), 1 - 1e-4)
            odds = math.log(r["evidence"] / (1 - r["evidence"])) + math.log(rate / (1 - rate)) - math.log(evidence.base / (1 - evidence.base))
            assert math.isclose(r["posterior"], 1 / (1 + math.exp(-odds)), rel_tol=1e-6)
    assert set(texts(stages["quality"])) == {i for i, r in judged.items() if r["posterior"] >= 0.5}
    before = texts(stages["documents"])
    assert all(before[i] == t for i, t in texts(stages["quality"]).items())


def test_exact_copies(stages):
    groups = collections.defaultdict(list)
    for i, t in texts(stages["quality"]).items():
        groups[t.translate(LOWER)].append(i)
    assert sorted(texts(stages["exact_dedup"])) == sorted(map(max, groups.values()))


def test_near_copies(stages):
    sets = {}
    for i, t in texts(stages["exact_dedup"]).items():
        words = [w for w in SPACES.split(t.translate(LOWER)) if w]
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(texts(stages["near_dedup"])) == sorted(i for i in sets if root[i] == i)


def test_personal_data_is_gone(stages):
    before, after = texts(stages["near_dedup"]), texts(stages["pii"])
    assert before.keys() == after.keys() and sum(bool(MAIL.search(t)) for t in before.values()) > 0
    assert not any(MAIL.search(t) for t in after.values())
    assert all(r["n_chars"] == len(r["text"]) for r in stages["pii"])
    assert sum(before[i] == t for i, t in after.items()) > len(after) / 2  # others are left alone


def test_packed_pieces(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in stages["packing"]:
        pieces[r["doc_id"]].append(r)
    documents = texts(stages["pii"])
    assert pieces.keys() == documents.keys()
    for i, t in documents.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and len(pieces[i]) == -(-len(ids) // SEQUENCE)
    filled = collections.Counter()
    for r in sorted(stages["packing"], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= SEQUENCE


def test_run_is_the_stages(spark, stages):
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    rows = corpus_pipeline.run(spark, SF).select(*key).collect()
    assert sorted(map(tuple, rows)) == sorted(tuple(r[c] for c in key) for r in stages["packing"])


def shrunk(groups, rate, parents):
    """Posterior means of groups of probabilities towards their parents' rates, strength by moments, as documented."""
    n = sum(len(g["p"]) for g in groups)
    squares = sum(len(g["p"]) * (np.mean(g["p"]) - m) ** 2 for g, m in zip(groups, parents["mean"]))
    within = sum(g["spread"] for g in groups) / n
    between = (squares - (len(groups) - 1) * within) / (n - sum(len(g["p"]) ** 2 for g in groups) / n)
    strength = 1e6 if between <= 1e-9 else min(max(rate * (1 - rate) / between - 1, 1.0), 1e6)
    return [(sum(g["p"]) + strength * r) / (len(g["p"]) + strength) for g, r in zip(groups, parents["rate"])]


def test_site_rates_are_those_of_plain_sums(spark):
    rng = random.Random(4)
    rows = [(h, f"{h}{rng.randrange(3)}", rng.gauss({"a": 2, "b": -1, "c": 0.5}[h], 2)) for h in rng.choices("abc", [6, 2, 1], k=300)]
    rows += [("d", None, 1.0), ("d", None, -3.0), (None, "x", 0.2)]
    df = spark.createDataFrame([*rows, ("a", "a0", None)], "_host string, _path string, _logit double")
    rate, sites = quality.site_rates(df)
    p = lambda chosen: np.array([1 / (1 + math.exp(-x)) for h, q, x in rows if chosen(h, q)])
    assert math.isclose(rate, p(lambda h, q: True).mean())
    paths = sorted({(h, q) for h, q, _ in rows}, key=repr)
    spread = {k: ((v := p(lambda h, q: (h, q) == k)) ** 2).sum() - v.sum() ** 2 / len(v) for k in paths}
    hosts = sorted({h for h, _ in paths}, key=repr)
    by_host = [{"p": p(lambda h, q, own=own: h == own), "spread": sum(s for (h, _), s in spread.items() if h == own)} for own in hosts]
    host_rates = dict(zip(hosts, shrunk(by_host, rate, {"mean": [rate] * len(hosts), "rate": [rate] * len(hosts)})))
    means = {own: g["p"].mean() for own, g in zip(hosts, by_host)}
    by_path = [{"p": p(lambda h, q, own=own: (h, q) == own), "spread": spread[own]} for own in paths]
    expected = shrunk(by_path, rate, {"mean": [means[h] for h, _ in paths], "rate": [host_rates[h] for h, _ in paths]})
    found = {(r["_host"], r["_path"]): r["_rate"] for r in sites.collect()}
    assert found.keys() == set(paths)
    for site, value in zip(paths, expected):
        assert math.isclose(found[site], value, rel_tol=1e-9), site
