"""Language model scores: a unigram base, and a hidden Markov model trained by Baum-Welch.

Tokens are the words of a text, A-Z lowered, then one end. Counts, their total and the number of
distinct tokens cover all learning rows.

The model emits symbols. The most frequent words, at most ``FREQUENT``, are symbols of their own; every
other word belongs to one of ``CLASSES`` classes by its last three bytes, and its class emits it with
probability ``(c + 1) / (class total + class types + 1)``, the last 1 standing for words never seen.
So a text's likelihood is that of its symbols under the Markov chain times those of its rare words in
their classes, and sums to at most 1 over all texts.

Counts of the most frequent words, at most ``KNOWN``, are sent to the tasks as two arrays (64-bit hash of
the word, count). Counts of all other words stay in a table that grows with the corpus; texts
meet it in a shuffle join on (row, word, times), summed per row.

Training: every round runs the scaled forward and backward recursions over all learning rows; each task
adds up its expected counts, and Spark sums these by symbol. The new probabilities, of bounded
size, are the next round's model. Texts are recursed in batches, one step for all texts
that are long enough, so that a long text costs steps, not memory.

Cases: a null or empty text is the end alone; without learning rows every word is unseen; null
ids and repeated rows are rows like others; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
import struct
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from caudal.llm.common import fold, read_documents, row_map
from caudal.session import checkpointed

FREQUENT = 20_000  # with the classes, symbols fit in two bytes
KNOWN = 1_000_000
CLASSES = 64
STATES = 8
ROUNDS = 3
SEED = 10
BATCH_TOKENS = 1 << 20
CACHED_WORDS = 300_000
END = b"\n"
"""The end token: no word holds a line break."""


def tokens(data: bytes | None) -> list[bytes]:
    return [*(data or b"").lower().split(), END]  # of bytes: A-Z and ASCII white space only


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def class_column(word: str) -> Column:
    """``word_class`` as a column expression."""
    return F.crc32(F.expr(f"substring({word}, -3, 3)")) % CLASSES


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def count_tokens(docs: DataFrame) -> DataFrame:
    """_word, _c: counts of every token. Tasks count before the shuffle."""

    def make():
        def rows(texts):
            counts: Counter = Counter()
            for data in texts:
                counts.update(tokens(data))
            return list(counts.items())

        return rows

    return row_map(docs, ["_text"], "_word binary, _n long", make).groupBy("_word").agg(F.sum("_n").alias("_c"))


PACKED = struct.Struct("<iid")
ENTRY = np.dtype([("symbol", "i4"), ("known", "i4"), ("log", "f8")])


class Vocabulary:
    """What tasks know about words: ``words`` and ``counts`` of the most frequent, most frequent first."""

    def __init__(self, words: Sequence[bytes], counts: np.ndarray):
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        order = np.argsort(hashes)
        # arrays of the standard library: numpy is slow at single values
        self.hashes = array("Q", hashes[order].tobytes())
        self.counts, self.rank = array("q", counts[order].tobytes()), array("q", order.tobytes())
        self.frequent = min(FREQUENT, len(words))
        self.symbols = self.frequent + CLASSES

    def entry(self, word: bytes) -> tuple[int, int, float]:
        """Symbol; whether the count is known; log10 of the count plus 1, else 0."""
        value = word_hash(word)
        at = bisect_left(self.hashes, value)
        if at < len(self.hashes) and self.hashes[at] == value:
            rank = self.rank[at]
            return rank if rank < self.frequent else self.frequent + word_class(word), 1, math.log10(self.counts[at] + 1)
        return self.frequent + word_class(word), 0, 0.0


class Lookup(dict):
    """Entries by word; emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> bytes:
        made = PACKED.pack(*self.vocabulary.entry(word))
        if len(word) < 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = made
        return made

    def entries(self, words: Sequence[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), ENTRY)


class Chain:
    """start (S), step (S, S), emit (symbols, S): probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def initial(cls, totals: np.ndarray) -> Chain:
        """Unigram emissions, disturbed so that states can part, and states that tend to stay."""
        random = np.random.default_rng(SEED)
        emit = (totals + 1.0)[:, None] * random.uniform(0.2, 1.8, (len(totals), STATES)) ** 2
        step = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(step, 0.9)
        return cls(np.full(STATES, 1 / STATES), step, emit / emit.sum(axis=0))

    def batches(self, texts: Sequence[np.ndarray]):
        """Indices of texts, longest first, so that a batch's table stays bounded unless one text is longer."""
        order, at = sorted(range(len(texts)), key=lambda i: -len(texts[i])), 0
        while at < len(order):
            take, total = at, 0
            while take < len(order) and (total == 0 or total + len(texts[order[take]]) <= BATCH_TOKENS):
                total += len(texts[order[take]])
                take += 1
            yield order[at:take]
            at = take

    def forward(self, texts: list[np.ndarray], keep: bool):
        """log10 likelihoods; with ``keep`` also scaled states, scales and the number of texts at each step.

        ``texts`` longest first. State rows of step t are those of the texts with more than t symbols.
        """
        lengths = np.array([len(t) for t in texts])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        flat, begin = np.concatenate(texts), np.cumsum(lengths) - lengths
        total, kept, scales, symbols = np.zeros(len(texts)), [], [], []
        state = None
        for t, n in enumerate(active):
            own = flat[begin[:n] + t]
            ahead = self.start if t == 0 else state[:n] @ self.step
            state = ahead * self.emit[own]
            scale = state.sum(axis=1)
            state /= scale[:, None]
            total[:n] += np.log10(scale)
            if keep:
                kept.append(state.astype(np.float32)), scales.append(scale), symbols.append(own)
        return total, kept, scales, symbols, active

    def expected(self, texts: list[np.ndarray], emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> None:
        """Add the expected counts of ``texts``, longest first, to the arrays."""
        _, kept, scales, symbols, active = self.forward(texts, keep=True)
        back = np.ones((0, STATES))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if len(back) < n:  # texts that end here
                back = np.concatenate([back, np.ones((n - len(back), STATES))])
            kept[t], before = kept[t] * back, kept[t - 1]
            if t == 0:
                start += kept[t].sum(axis=0)
                break
            arriving = self.emit[symbols[t]] * back / scales[t][:, None]
            step += self.step * (before[:n].T @ arriving)
            back = arriving @ self.step.T
        expected, all_symbols = np.concatenate(kept), np.concatenate(symbols)
        for state in range(STATES):
            emit[:, state] += np.bincount(all_symbols, expected[:, state], len(emit))


def unpacked(values: Sequence[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint16) for v in values]


def gathered(batches, symbols: int = 0, most: int = 8 * BATCH_TOKENS):
    """Columns of several Arrow batches as lists, up to ``most`` symbols at a time.

    Texts of like length are recursed together, which pays the more texts there are to choose from.
    """
    columns, size = None, 0
    for batch in batches:
        columns = columns or [[] for _ in batch.columns]
        for own, new in zip(columns, batch.columns):
            own += new.to_pylist()
        size += batch.column(symbols).nbytes // 2
        if size >= most:
            yield columns
            columns, size = None, 0
    if columns and columns[0]:
        yield columns


def expected_counts(coded: DataFrame, chain: Chain) -> DataFrame:
    """_symbol, sums by state; transitions from state s are symbol -2 - s, starts are symbol -1.

    Each task sums its rows; the sums by symbol are Spark's.
    """
    shared = coded.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        chain = shared.value
        emit, step, start = np.zeros_like(chain.emit), np.zeros((STATES, STATES)), np.zeros(STATES)
        for values in gathered(batches):
            texts = unpacked(values[0])
            for chosen in chain.batches(texts):
                chain.expected([texts[i] for i in chosen], emit, step, start)
        used = np.flatnonzero(emit.any(axis=1))
        numbers = [*used.tolist(), -1, *range(-2, -2 - STATES, -1)]
        rows = np.concatenate([emit[used], start[None, :], step])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], ["_symbol", "_counts"]
        )

    parts = coded.select("_symbols").mapInArrow(run, "_symbol long, _counts array<double>")
    sums = [F.sum(F.col("_counts")[s]).alias(f"_s{s}") for s in range(STATES)]
    return parts.groupBy("_symbol").agg(*sums)


def baum_welch(coded: DataFrame, totals: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """``coded`` has the _symbols of the learning rows, ``totals`` the occurrences of each symbol.

    The driver holds arrays of (symbols, states) only.
    """
    chain = Chain.initial(totals)
    for _ in range(rounds):
        # one occurrence in all, spread over symbols and states, keeps every symbol possible
        emit = np.tile(((totals + 1) / (totals + 1).sum())[:, None], (1, STATES))
        step, start = np.full((STATES, STATES), 1e-3), np.full(STATES, 1e-3)
        for row in expected_counts(coded, chain).collect():
            values = np.array(row[1:])
            if row[0] >= 0:
                emit[row[0]] += values
            elif row[0] == -1:
                start += values
            else:
                step[-2 - row[0]] += values
        chain = Chain(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return chain


def most_frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows of ``counts`` with at least a count of which at most ``most`` rows exist, and that count."""
    octave = F.floor(F.log2("_c") * 8)
    bins = counts.groupBy(octave.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_c").alias("_least"))
    least, total = 1 << 62, 0
    for row in sorted(bins.collect(), key=lambda r: -r._bin):  # a few hundred rows for any corpus
        total += row._n
        if total > most:
            break
        least = row._least
    return counts.filter(F.col("_c") >= least), least


def code(docs: DataFrame, kind: str, vocabulary: Vocabulary, class_room: np.ndarray) -> DataFrame:
    """For rows _row, _id, _learn, _text, in one pass over the texts:

    _n tokens, _known of them in the vocabulary, their summed logs (_base), those of rare words within
    their classes (_in_class), the _symbols (two bytes each), and _rare: words whose counts tasks lack.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, class_room))

    def make():
        vocabulary, class_room = shared.value
        lookup = Lookup(vocabulary)

        def row(number, i, learn, text):
            words = tokens(text)
            found = lookup.entries(words)
            classes = found["symbol"] - vocabulary.frequent
            in_class = float(found["log"][classes >= 0].sum() - class_room[classes[classes >= 0]].sum())
            unknown = np.flatnonzero(found["known"] == 0)
            rare = Counter(words[k] for k in unknown)
            return (number, i, learn, len(words), len(words) - len(unknown), float(found["log"].sum()), in_class,
                    found["symbol"].astype(np.uint16).tobytes(),
                    [{"word": w, "times": n} for w, n in rare.items()])

        return lambda *columns: list(map(row, *columns))

    schema = (f"_row long, _id {kind}, _learn boolean, _n long, _known long, _base double, _in_class double, "
              "_symbols binary, _rare array<struct<word:binary,times:long>>")
    return row_map(docs, ["_row", "_id", "_learn", "_text"], schema, make)


def likelihoods(coded: DataFrame, chain: Chain) -> DataFrame:
    """_id, _row and _chain, the log10 likelihood of the symbols, with the other columns but _symbols and _rare."""
    shared = coded.sparkSession.sparkContext.broadcast(chain)
    columns = ["_row", "_id", "_n", "_known", "_base", "_in_class", "_symbols"]
    kind = coded.schema["_id"].dataType.simpleString()

    schema = f"_row long, _id {kind}, _n long, _known long, _base double, _in_class double, _chain double"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        chain = shared.value
        for values in gathered(batches, len(columns) - 1):
            texts, out = unpacked(values[-1]), np.zeros(len(values[-1]))
            for chosen in chain.batches(texts):
                out[chosen] = chain.forward([texts[i] for i in chosen], keep=False)[0]
            arrays = [pa.array(v, type=f.type) for v, f in zip([*values[:-1], out.tolist()], target)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return coded.select(*columns).mapInArrow(run, schema)


def score(docs: DataFrame, learning: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``learning`` is a condition on ``docs``: the rows to learn from.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    train = docs.filter(learning).select(F.col(text).alias("_text"))
    counts = checkpointed(count_tokens(train))
    total, types = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count(F.lit(1))).first()
    common, least = most_frequent(counts, KNOWN)
    known = common.toArrow()  # at most KNOWN rows
    words, word_counts = known["_word"].to_pylist(), known["_c"].to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: (-word_counts[i], words[i]))
    words, word_counts = [words[i] for i in order], word_counts[order]
    vocabulary = Vocabulary(words, word_counts)
    sizes = np.zeros((CLASSES, 2))
    rare = counts.filter(F.col("_c") < least)
    for row in rare.groupBy(class_column("_word").alias("_k")).agg(F.sum("_c"), F.count(F.lit(1))).collect():
        sizes[row[0]] = row[1], row[2]
    for word, c in zip(words[vocabulary.frequent :], word_counts[vocabulary.frequent :]):
        sizes[word_class(word)] += c, 1
    totals = np.concatenate([word_counts[: vocabulary.frequent], sizes[:, 0]]).astype(float)
    numbered = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"),
        F.coalesce(learning, F.lit(False)).alias("_learn"), F.col(text).alias("_text"),
    )
    coded = checkpointed(code(numbered, kind, vocabulary, np.log10(sizes.sum(axis=1) + 1)))
    chain = baum_welch(coded.filter("_learn"), totals)
    rows = likelihoods(coded, chain)
    looked_up = (
        coded.select("_row", F.explode("_rare").alias("_r"))
        .select("_row", F.col("_r.word").alias("_word"), F.col("_r.times").alias("_times"))
        .join(rare, "_word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.col("_times") * F.log10(F.coalesce("_c", F.lit(0)) + 1)).alias("_logs"),
            F.sum(F.when(F.col("_c").isNotNull(), F.col("_times")).otherwise(0)).alias("_found"),
        )
    )
    logs = F.coalesce("_logs", F.lit(0.0))
    room = math.log10(total + types + 1)
    return rows.join(looked_up, "_row", "left").select(
        F.col("_id").alias(doc_id), F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_base") + logs - F.col("_n") * F.lit(room)).alias("base_score"),
        (F.col("_chain") + F.col("_in_class") + logs).alias("score"),
    )


def op10_hmm_lm(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    held = fold(F.col("doc_id"), 7) == 2
    scored = score(docs, ~held)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), *scored.columns[1:])
