"""Personal data: patterns, and a linear-chain conditional random field over word shapes that adds to them.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers; each kind on its own,
leftmost and without overlaps. They are applied so that long runs of digits or letters cost no more
than their length.

The random field labels blank-separated words. Features are the shape of a word, of its ends and of its
two neighbours. Words without a digit or ``@`` can only be outside, which cuts a text into short
independent runs; these are decoded by Viterbi in numpy, batched by length. Its weights come from a
small table of labelled word sequences; ``labelled_windows`` makes one from a bounded sample of
documents (``FIT_ROWS``), labelled by the patterns, from which the field learns the shapes and
surroundings that the patterns are too strict for. Spans that touch no pattern's span are added.

Cases: a null or empty text has no spans; without any labelled row only patterns are used; null ids and
repeated rows are rows like others; an empty table gives an empty result; other columns are not read
by ``find`` and are kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.common import read_documents, row_map

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
FIT_ROWS = 2000
FIT_WINDOWS = 3000
AROUND = 4
BUCKETS = 4096
EPOCHS = 4

# fixed values: the patterns of the task
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL_PART.match(text[start - 1]):
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            end = match.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _addresses(text: str) -> list[Span]:
    """A dotted run of numbers holds one candidate per four numbers."""
    found = []
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((1, at, at + length))
            at += length + 1
    return found


def pattern_spans(text: str) -> list[Span]:
    """Spans by kind, then start; ends are exclusive, in code points."""
    found: list[Span] = _emails(text)
    if MARK.search(text):
        found += _addresses(text)
        for match in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", match.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *match.span()))
        for match in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", match.group())) <= 15:
                found.append((3, *match.span()))
    return found


def words_with_marks(text: str) -> list[list[tuple[int, int]]]:
    """Runs of adjacent words (start, end) that each hold a digit or ``@``."""
    runs: list[list[tuple[int, int]]] = []
    at, gap = 0, 0
    while match := MARK.search(text, at):
        start, end, size = match.start(), match.end(), len(text)
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < size and not text[end].isspace():
            end += 1
        if runs and not text[gap:start].strip():
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
        at = gap = end
    return runs


def shape(word: str) -> str:
    """Letters as x or X, digits as d, runs shortened, everything else as it is."""
    kinds = ["d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:64]]
    return "".join(c for k, c in enumerate(kinds) if not k or c != kinds[k - 1])


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str, before: str, after: str) -> list[int]:
    digits = sum(c.isdigit() for c in word)
    longest = max(map(len, NOT_DIGIT.sub(" ", word).split()), default=0)
    own = shape(word)
    return [
        _bucket(f) for f in (
            "bias", f"s={own}", f"n={min(digits, 20)}", f"l={min(longest, 20)}", f"a={word[:1]}", f"z={word[-1:]}",
            f"@={'@' in word}", f".={word.count('.')}", f"p={shape(before)}", f"q={shape(after)}",
            f"sp={own}|{shape(before)}", f"sq={own}|{shape(after)}",
        )
    ]


def neighbours(text: str, run: list[tuple[int, int]]) -> list[str]:
    """The words of a run with the word before it and the word after it, empty at the ends of the text."""
    before = text[max(0, run[0][0] - 80) : run[0][0]].split()[-1:] or [""]
    after = text[run[-1][1] : run[-1][1] + 80].split()[:1] or [""]
    return [*before, *(text[a:b] for a, b in run), *after]


class Field:
    """Weights of features by label, and of label pairs. Runs start and end next to an outside word."""

    def __init__(self):
        self.weights = np.zeros((BUCKETS, len(LABELS)))
        self.pairs = np.zeros((len(LABELS), len(LABELS)))

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """Scores of the inner words of ``neighbours``."""
        return np.array([
            self.weights[features(words[k], words[k - 1], words[k + 1])].sum(axis=0) for k in range(1, len(words) - 1)
        ])

    def train(self, windows: Sequence[tuple[list[str], list[int]]], seed: int = 7) -> Field:
        """Ascend the likelihood, one window at a time, with a step per weight (AdaGrad)."""
        random = np.random.default_rng(seed)
        seen_w, seen_p = np.full_like(self.weights, 1e-2), np.full_like(self.pairs, 1e-2)
        for _ in range(EPOCHS):
            for i in random.permutation(len(windows)):
                words, labels = windows[i]
                used = [features(words[k], words[k - 1], words[k + 1]) for k in range(1, len(words) - 1)]
                node, edge = self._expected(np.array([self.weights[u].sum(axis=0) for u in used]))
                for u, label, p in zip(used, labels, node):
                    slope = -p
                    slope[label] += 1
                    seen_w[u] += slope**2
                    self.weights[u] += 0.2 * slope / np.sqrt(seen_w[u])
                slope = -edge
                for a, b in zip([0, *labels], [*labels, 0]):
                    slope[a, b] += 1
                seen_p += slope**2
                self.pairs += 0.2 * slope / np.sqrt(seen_p)
        return self

    def _expected(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels at each word and expected counts of label pairs."""
        step, emit = np.exp(self.pairs), np.exp(scores - scores.max(axis=1, keepdims=True))
        n = len(scores)
        ahead, back = np.zeros((n, len(LABELS))), np.ones((n, len(LABELS)))
        state = step[0]
        for t in range(n):
            ahead[t] = state * emit[t]
            ahead[t] /= ahead[t].sum()
            state = ahead[t] @ step
        back[-1] = step[:, 0] / step[:, 0].sum()
        for t in range(n - 2, -1, -1):
            back[t] = step @ (emit[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        node = ahead * back
        node /= node.sum(axis=1, keepdims=True)
        edge = np.zeros_like(step)
        edge[0] += node[0]
        edge[:, 0] += node[-1]
        for t in range(1, n):
            both = ahead[t - 1][:, None] * step * (emit[t] * back[t])
            edge += both / both.sum()
        return node, edge

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best labels for runs of one length: scores (runs, words, labels)."""
        runs, n, _ = scores.shape
        best = self.pairs[0] + scores[:, 0]
        origin = np.zeros((n, runs, len(LABELS)), np.int8)
        for t in range(1, n):
            reach = best[:, :, None] + self.pairs
            origin[t] = reach.argmax(axis=1)
            best = reach.max(axis=1) + scores[:, t]
        path = np.zeros((runs, n), np.int8)
        path[:, -1] = (best + self.pairs[:, 0]).argmax(axis=1)
        for t in range(n - 1, 0, -1):
            path[:, t - 1] = origin[t][np.arange(runs), path[:, t]]
        return path


def field_spans(texts: Sequence[str], field: Field) -> list[list[Span]]:
    """Spans the field finds in each of a batch of texts."""
    by_length: dict[int, list] = defaultdict(list)
    for i, text in enumerate(texts):
        for run in words_with_marks(text):
            by_length[len(run)].append((i, run, field.emissions(neighbours(text, run))))
    found: list[list[Span]] = [[] for _ in texts]
    for entries in by_length.values():
        for (i, run, _), path in zip(entries, field.viterbi(np.stack([e[2] for e in entries]))):
            start = 0
            for k in range(1, len(run) + 1):
                if k == len(run) or path[k] != path[start]:
                    if path[start]:
                        a, b = run[start][0], run[k - 1][1]
                        b = a + len(texts[i][a:b].rstrip(".,;:!?\"')"))
                        if b > a:
                            found[i].append((int(path[start]) - 1, a, b))
                    start = k
    return found


def all_spans(texts: Sequence[str], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans, and those with the field's additions, of each text."""
    base = [pattern_spans(t) for t in texts]
    extra = field_spans(texts, field) if field else [[] for _ in texts]
    out = []
    for own, more in zip(base, extra):
        taken = sorted((a, b) for _, a, b in own)
        free = [s for s in more if not any(a < s[2] and s[1] < b for a, b in taken)] if taken else more
        out.append((own, sorted([*own, *free])))
    return out


def labelled_windows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, windows: int = FIT_WINDOWS
) -> DataFrame:
    """words (with one neighbour at either end) and labels, from the ``rows`` documents with the least id hashes."""
    named = docs.select(F.xxhash64(F.col(doc_id).cast("string")).alias("_order"), F.col(text).alias("_text"))
    bound = named.select("_order").orderBy("_order").limit(rows).agg(F.max("_order")).first()[0]

    def make():
        def rows_of(texts):
            out = []
            for data in texts:
                t = (data or b"").decode()
                base = pattern_spans(t)
                for run in words_with_marks(t):
                    labels = [next((k + 1 for k, a, b in base if a < y and x < b), 0) for x, y in run]
                    out.append((neighbours(t, run), labels))
            return out

        return rows_of

    sample = named.filter(F.col("_order") <= F.lit(bound)).orderBy("_order").limit(rows)
    found = row_map(sample, ["_text"], "words array<string>, labels array<int>", make)
    return found.orderBy(F.xxhash64("words"), "words").limit(windows)


def fit(labelled: DataFrame) -> Field | None:
    """Train on a small labelled table (words, labels), read by the driver."""
    rows = labelled.collect()
    return Field().train([(list(r.words), list(r.labels)) for r in rows]) if rows else None


def span_text(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of patterns), base_sha256, spans, n_added."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size, whatever the corpus

    def make():
        own = shared.value

        def rows_of(ids, texts):
            out = []
            for i, (base, spans) in zip(ids, all_spans([(t or b"").decode() for t in texts], own)):
                counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                digest = hashlib.sha256(span_text(base).encode()).hexdigest()
                out.append((i, *counts, digest, span_text(spans), len(spans) - len(base)))
            return out

        return rows_of

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"{doc_id} {kind}, {counts}, base_sha256 string, spans string, n_added long"
    return row_map(docs, [doc_id, text], schema, make)


def redacted(text: str, spans: Sequence[Span]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans together, under the first one's kind."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``length``, where present, is counted anew. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        values = [t or "" for t in texts]
        spans = all_spans(values, shared.value)
        return pd.Series([None if t is None else redacted(v, s[1]) for t, v, s in zip(texts, values, spans)])

    out = docs.withColumn(text, clean(F.col(text)))
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.coalesce(F.char_length(text).cast(kind), F.col(length)))
    return out.select(*docs.columns)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return find(docs, fit(labelled_windows(docs)))
