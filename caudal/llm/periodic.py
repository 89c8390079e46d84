"""Periodic runs of words: extensions from Lyndon roots, answered by the suffix trees of a text and of its reversal.

A run is a stretch of at least ``least`` words that is at least ``times`` as long as its smallest period, and that no
neighbouring word extends. Every run holds a Lyndon word as long as its period which is the longest Lyndon word at its
place in one of two orders of the words: the order of the tree's branches, or its reverse. Longest Lyndon words end before
the next smaller (or greater) suffix, so a pass over the ranks of the suffixes names at most two candidates a place.
Each candidate is extended right by the longest common extension of two suffixes, left by that of two
suffixes of the reversal; what is long enough is a run.

Trees are Ukkonen's, in time that grows with the number of words. The common extension of two suffixes is the depth of
their lowest common ancestor: the least depth between their leaves on an Euler tour, of which only the
turning points between neighbouring leaves are kept, looked up in two overlapping spans of a table of minima.

Trees are grown only where a run can be: every window of ``window(least, times)`` words of a run occurs in that run again,
so stretches without such windows, found by hashes of all windows of many texts at once, hold no run. Windows are compared within a
stretch only, again and again until no stretch gets shorter. The test loses no run and decides none.

``collapse`` drops what a run repeats: all its words but those of its first period.

Cases: a null or empty text, or one of white space, has no words and no runs; a text of any length is searched as a whole, in memory that
grows with its longest stretch; ties, repeated rows and null ids are rows like others; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.common import read_documents, row_map

SLICE_BYTES = 4 << 20
RUN = "struct<start:long,length:long,period:long>"
SPACES = r"[\x20\x09-\x0D]+"


class SuffixTree:
    """Ukkonen's tree of symbols from 1 on, ended by a symbol 0 of its own."""

    def __init__(self, symbols: list[int]):
        self.text = [*symbols, 0]
        self.width = max(self.text) + 1
        self.begin, self.end, self.child = [0], [0], {}
        self._grow()
        self._tour()

    def _grow(self) -> None:
        text, width, size = self.text, self.width, len(self.text)
        begin, end, child, link = self.begin, self.end, self.child, [0]
        node = edge = length = waiting = 0  # the place reached, and suffixes that have no leaf yet
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i), end.append(size), link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = 0
                else:
                    first = begin[below]
                    span = end[below] - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(begin)
                    begin.append(first), end.append(first + length), link.append(0)
                    begin.append(i), end.append(size), link.append(0)
                    begin[below] = first + length
                    child[key] = middle
                    child[middle * width + symbol] = middle + 1
                    child[middle * width + text[first + length]] = below
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1

    def _tour(self) -> None:
        """Suffixes in order, their ranks, and a table of least depths between neighbouring leaves."""
        width, size = self.width, len(self.text)
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        nodes = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(keys)
        children = nodes[order].tolist()
        first = np.searchsorted(keys[order], np.arange(len(self.begin) + 1) * width).tolist()
        begin, end = self.begin, self.end
        leaves, turns, turn = [], [], 0
        stack = [(0, 0, -1)]  # a node, its parent's depth, and that depth again if the tour comes back from a sibling
        while stack:
            node, depth, back = stack.pop()
            if back >= 0:
                turn = back
            depth += end[node] - begin[node]
            own = children[first[node] : first[node + 1]]
            if own:
                stack += [(c, depth, depth) for c in own[:0:-1]]
                stack.append((own[0], depth, -1))
            else:
                leaves.append(size - depth)
                turns.append(turn)
        self.rank = np.empty(size, np.int64)
        self.rank[leaves] = np.arange(size)
        rows = [np.array(turns, np.int32)]
        while 1 << len(rows) < size:
            half = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1], np.append(rows[-1][half:], rows[-1][-half:])))
        self.least = np.stack(rows)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common beginnings of the suffixes at ``a`` and ``b``, which differ."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp(high - low)[1] - 1
        return np.minimum(self.least[level, low], self.least[level, high - (1 << level)])


def next_smaller(ranks: list[int]) -> np.ndarray:
    """For each place the next with a smaller number, or the length."""
    found, open_places = [len(ranks)] * len(ranks), []
    for i, rank in enumerate(ranks):
        while open_places and ranks[open_places[-1]] > rank:
            found[open_places.pop()] = i
        open_places.append(i)
    return np.array(found, np.int64)


def runs(symbols: list[int], least: int, times: int) -> np.ndarray:
    """(start, length, period) of all runs by start, then period; symbols are numbers from 1 on."""
    size = len(symbols)
    none = np.zeros((0, 3), np.int64)
    if size < max(least, times):
        return none
    tree = SuffixTree(symbols)
    places = np.arange(size)
    ranks = tree.rank[:size]
    roots = [next_smaller(r.tolist()) for r in (ranks, -ranks)]
    start = np.concatenate([places, places])
    period = np.concatenate(roots) - start
    start, period = (x[start + period < size] for x in (start, period))
    right = tree.common(start, start + period)
    needed = np.maximum(least, times * period)
    # a run has a root that starts in its first period, so less than a period is to the left of it
    near = period + right > needed - period
    start, period, right, needed = (x[near] for x in (start, period, right, needed))
    if not len(start):
        return none
    inner = start > 0
    left = np.zeros(len(start), np.int64)
    back = SuffixTree(symbols[::-1])
    left[inner] = back.common(size - start[inner], size - start[inner] - period[inner])
    length = left + period + right
    found = np.stack([start - left, period, length], axis=1)[length >= needed]
    return np.unique(found, axis=0)[:, [0, 2, 1]]


def window(least: int, times: int) -> int:
    """The greatest number of words of which every sequence in a run occurs in that run again."""
    return least * (times - 2) // times + 1


def mixed(numbers: np.ndarray) -> np.ndarray:
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def stretches(symbols: np.ndarray, bounds: np.ndarray, least: int, times: int) -> np.ndarray:
    """(begin, end) of the parts of ``bounds`` that may hold runs."""
    width = window(least, times)
    while True:
        bounds = bounds[bounds[:, 1] - bounds[:, 0] >= least]
        sizes = bounds[:, 1] - bounds[:, 0]
        total = int(sizes.sum())
        if not total:
            return bounds
        group = np.repeat(np.arange(len(bounds)), sizes)
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = bounds[group, 0] + place
        values = mixed(symbols[at])
        hashed = mixed(group)
        hashed = hashed[: total - width + 1]
        for k in range(width):
            hashed = hashed * np.uint64(0x9FB21C651E98DF25) + values[k : k + len(hashed)]
        inside = np.flatnonzero(place[: len(hashed)] <= sizes[group[: len(hashed)]] - width)
        order = inside[np.argsort(hashed[inside])]
        same = hashed[order][1:] == hashed[order][:-1]
        again = np.zeros(total, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        ahead = np.r_[False, again[:-1]] & (place > 0)
        behind = np.r_[again[1:] & (place[1:] > 0), False]
        first, last = np.flatnonzero(again & ~ahead), np.flatnonzero(again & ~behind)
        bounds = np.stack([at[first], at[last] + width], axis=1)
        if int((bounds[:, 1] - bounds[:, 0]).sum()) == total:
            return bounds


def find(texts: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """The runs of each sequence of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    numbers: dict[bytes, int] = {}
    for words in texts:
        numbers.update(dict.fromkeys(words))
    numbers = dict(zip(numbers, range(1, len(numbers) + 1)))
    symbols = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(sizes.sum()))
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for begin, end in stretches(symbols, np.stack([ends - sizes, ends], axis=1), least, times).tolist():
        # small numbers in the order of first use
        _, first, own = np.unique(symbols[begin:end], return_index=True, return_inverse=True)
        place = np.empty(len(first), np.int64)
        place[np.argsort(first)] = np.arange(1, len(first) + 1)
        part = runs(place[own].tolist(), least, times)
        if len(part):
            text = int(np.searchsorted(ends, begin, side="right"))
            found[text].append(part + np.array([begin - (ends[text] - sizes[text]), 0, 0]))
    return [np.concatenate(parts) if parts else np.zeros((0, 3), np.int64) for parts in found]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(edges)[:-1] == 0).tolist()))


def collapse(docs: DataFrame, least: int = 24, times: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), and text without what runs repeat, words joined by one space."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        def step(ids, texts):
            rows, start = [], 0
            while start < len(ids):  # a slice of texts at a time
                stop, size = start, 0
                while stop < len(ids) and (stop == start or size + len(texts[stop] or b"") <= SLICE_BYTES):
                    size += len(texts[stop] or b"")
                    stop += 1
                words = [(t or b"").split() for t in texts[start:stop]]
                for i, own, found in zip(ids[start:stop], words, find(words, least, times)):
                    rows.append((i, len(own), [tuple(r) for r in found.tolist()], collapsed(own, found)))
                start = stop
            return rows
        return step

    renamed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return row_map(renamed, ["_id", "_text"], f"{doc_id} {kind}, n_words long, runs array<{RUN}>, {text} string", make)


def strongest(found: Column) -> Column:
    """The run with the greatest length in periods; the first of equals."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    start = F.get(found, F.lit(0))
    return F.aggregate(found, start, lambda a, b: F.when(more(a, b), b).otherwise(a))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by hash of the id) repeat a period up to their end.

    A null id hashes as the empty text.
    """
    hashed = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_h"))
    chosen = F.col("_h") % 10 == 0
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    split = hashed.select("doc_id", "text", F.expr("_h div 10").alias("_g"), F.when(chosen, words).alias("_w"))
    counted = split.withColumn("_n", F.size("_w"))
    placed = counted.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    placed = placed.withColumn("_p", F.expr("CAST(1 + (_n - _a) div (3 + _g % 8) AS int)"))
    repeats = F.expr("array_repeat(slice(_w, _a + 1, _p), CAST(ceil((_n - _a) / _p) AS int))")
    tail = F.slice(F.flatten(repeats), F.lit(1), F.col("_n") - F.col("_a"))
    planted = F.concat_ws(" ", F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail))
    return placed.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = collapse(with_planted_runs(read_documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    best = found.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
