"""Periodic runs against a comparison of every word with the one a period before it."""

import hashlib
import random
import re
import zlib

import pytest

from caudal.llm import periodic
from caudal.llm.common import read_documents

SF = "/root/testdata/sf0.001"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def slow_runs(words, least, times):
    """(start, length, period), for each period the stretches in which words a period apart are equal."""
    found = []
    for period in range(1, len(words) // times + 1):
        same, start = [words[i] == words[i + period] for i in range(len(words) - period)] + [False], None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            elif not equal and start is not None:
                length = i - start + period
                part = words[start : start + length]
                smaller = any(part[q:] == part[:-q] for q in range(1, period))
                if length >= max(least, times * period) and not smaller:
                    found.append((start, length, period))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    words = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
    if words and rng.random() < 0.7:
        start, period = rng.randrange(len(words)), rng.randint(1, 8)
        for i in range(start + period, rng.choice([len(words), min(len(words), start + 40)])):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (6, 3), (2, 2), (1, 3)])
def test_runs_are_those_of_plain_comparison(least, times):
    rng = random.Random(least)
    texts = [some_words(rng) for _ in range(600)]
    as_bytes = [[b"%d" % w for w in words] for words in texts]
    for words, screened in zip(texts, periodic.find(as_bytes, least, times)):
        expected = slow_runs(words, least, times)
        assert [tuple(r) for r in periodic.runs(words, least, times).tolist()] == expected
        assert [tuple(r) for r in screened.tolist()] == expected


def test_tree_answers_common_beginnings():
    rng = random.Random(3)
    words = [rng.randint(1, 2) for _ in range(300)]
    tree = periodic.SuffixTree(words)
    for a, b in [rng.sample(range(300), 2) for _ in range(2000)]:
        n = 0
        while max(a, b) + n < 300 and words[a + n] == words[b + n]:
            n += 1
        assert tree.common([a], [b]).tolist() == [n]
    assert sorted(range(301), key=lambda i: [*words, 0][i:]) == sorted(range(301), key=lambda i: tree.rank[i])


def test_window_of_a_run_occurs_again():
    assert periodic.window(24, 3) == 9 and periodic.window(4, 2) == 1
    for period in range(1, 60):
        length = max(24, 3 * period)
        assert all(i >= period or i + period <= length - 9 for i in range(length - 8))
    assert any(i < 8 and i + 8 > 24 - 10 for i in range(24 - 9))  # ten words would be too many


def expected_row(doc_id, text):
    words = [w for w in SPACES.split(text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words, 24, 3)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    top = None
    for run in found:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_is_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in read_documents(spark, SF).collect() if len(r["text"]) < 4000}
    found = {r["doc_id"]: tuple(r) for r in periodic.op11_periodic_runs(spark, SF).collect()}
    assert len(found) == read_documents(spark, SF).count()
    assert sum(r[1] > 0 for r in found.values()) > 5
    for doc_id, text in texts.items():
        assert found[doc_id] == expected_row(doc_id, text)


def test_odd_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:8] + [1, 2, 3, 4, 5]
    odd = [None, "", " \t\n ", "a", "a b " * 300, "é\xa0x \x1cy\x85 z " * 20, "ab\x0bc " * 30, "w" * 5000, "x y z " * 40, "one two", None, "", "q " * 24]
    docs = spark.createDataFrame(list(zip(ids, odd)), "doc_id long, text string")
    docs.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd/documents.parquet")
    found = {r["doc_id"]: tuple(r) for r in periodic.op11_periodic_runs(spark, path.rsplit("/", 1)[0]).collect()}
    assert found == {i: expected_row(i, t) for i, t in zip(ids, odd)}


def test_collapsed_text_and_runs(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 10 + "end"), (2, "nothing here")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic.collapse(docs).collect()}
    assert rows[1]["text"] == "start a b c end" and rows[1]["n_words"] == 32
    assert [tuple(r) for r in rows[1]["runs"]] == [(1, 30, 3)] and rows[2]["runs"] == [] and rows[2]["text"] == "nothing here"
