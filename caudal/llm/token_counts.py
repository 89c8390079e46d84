"""Exact token counts at every prefix of a text, by dynamic programming.

With byte-level BPE the tokens of a prefix follow a rule: the last token of the first ``i`` bytes of a
word is the one token ``t`` ending at ``i`` that may follow the last token of the first ``i - len(t)``
bytes (two tokens may meet if encoding their joined bytes gives just these two). So one pass over a
word yields the count of every prefix, in time proportional to its length however long the word is.
Counts of the prefixes of a text are those of its words, added up, and answer truncation and budget
questions without encoding again.

A text is cut at blanks into chunks whose counts do not depend on their neighbours; counts of chunks
are kept in a bounded table per Python worker. Texts with blanks next to other white space, and texts
with special tokens, take a slower way with the same results.

Cases: a null text counts as empty (0 tokens); an empty table gives an empty result; repeated rows give
repeated results; a null id is passed through; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import operator
import re
from array import array
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame

from caudal.llm.common import read_documents, row_map

# fixed values of the tokenizer family: its splitting pattern, and contractions that fall apart when cut
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'re", "'ve", "'ll")

CACHED_CHUNKS = 600_000
STOPS = ",.;:!?"
CACHED_HEADS = 50_000
HEAD_BYTES = 7
NEVER = 1 << 30
WHITE = frozenset(chr(i) for i in range(0x3001) if regex.match(r"\s", chr(i)))
AFTER_BLANK, BEFORE_BLANK = re.compile(r" \s"), re.compile(r"[^\S ] ")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class PrefixCounter:
    """Counts for one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        unmapped = lambda token: bytes(alphabet[c] for c in token)
        self.ranks = {
            (unmapped(a), unmapped(b)): rank for rank, (a, b) in enumerate(spec["model"]["merges"])
        }
        self.vocabulary = {unmapped(token) for token in spec["model"]["vocab"]}
        self.halves = {a + b: (rank, a, b) for (a, b), rank in self.ranks.items()}
        #: whether every token is merged later than its halves, as in any trained vocabulary
        self.ordered = len(self.halves) == len(self.ranks) and all(
            rank > max(self.halves.get(a, (-1,))[0], self.halves.get(b, (-1,))[0])
            for rank, a, b in self.halves.values()
        )
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.longest = max(map(len, self.vocabulary))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.split = regex.compile(PATTERN).findall
        self.meet: dict[tuple[bytes, bytes], bool] = {}
        self.heads: dict[bytes, tuple[list[int], list[bytes]]] = {}
        self.inner = _Chunks(self._inner, 2 * CACHED_CHUNKS)
        self.first = _Chunks(self._slow)
        self.pieces = _Chunks(self._count_piece, CACHED_CHUNKS // 4)

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether encoding ``left + right`` gives these two tokens."""
        key = (left, right)
        known = self.meet.get(key)
        if known is None:
            if len(self.meet) >= CACHED_CHUNKS:
                self.meet.clear()
            known = self._apart(left, right) if self.ordered else self._encode(left + right) == [left, right]
            self.meet[key] = known
        return known

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts at one edge of a token as it grows, each with the rank of the merge that ends it."""
        known = self.edges.get((token, side))
        if known is None:
            part, ends, known = token, NEVER, []
            while part:
                known.append((part, ends))
                ends, *both = self.halves.get(part, (0, b"", b""))
                part = both[side]
            known.reverse()
            self.edges[token, side] = known
        return known

    def _apart(self, left: bytes, right: bytes) -> bool:
        """No merge across the boundary comes before the merges beside it; of equal ranks the left one is first."""
        ending, starting = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            a, a_ends = ending[i]
            b, b_ends = starting[j]
            across = self.ranks.get((a, b), NEVER)
            if across < a_ends and across <= b_ends and across < NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _encode(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, NEVER) for pair in zip(parts, parts[1:])]
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def word(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of one word, the empty prefix first."""
        # words that begin alike share the counts of that beginning
        head = self.heads.get(data[:HEAD_BYTES]) if len(data) > HEAD_BYTES else None
        counts, last = ([*head[0]], [*head[1]]) if head else ([0], [b""])
        vocabulary, meet = self.vocabulary, self.meet
        for end in range(len(counts), len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = data[start:end]
                if token in vocabulary:
                    left = last[start]
                    fits = not start or meet.get((left, token))
                    if fits or fits is None and self.may_follow(left, token):
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
        if head is None and len(data) > HEAD_BYTES:
            if len(self.heads) >= CACHED_HEADS:
                self.heads.clear()
            self.heads[data[:HEAD_BYTES]] = (counts[: HEAD_BYTES + 1], last[: HEAD_BYTES + 1])
        return counts

    def _piece(self, piece: str) -> list[int]:
        """Counts after each character of a word."""
        return self.pieces[piece]

    def _count_piece(self, piece: str) -> list[int]:
        if piece in CONTRACTIONS:
            return [1, 2, self.word(piece.encode())[-1]]
        data = piece.encode("utf-8", "surrogatepass")
        counts = self.word(data)
        if len(data) == len(piece):
            return counts[1:]
        # a character has one byte more from each of these code points on
        sizes = (1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in piece)
        return [counts[e] for e in accumulate(sizes)]

    def _inner(self, chunk: str) -> bytes:
        """Changes of the count along a blank and a chunk after it.

        ASCII letters are one word with the blank, and stops after them are another.
        """
        letters = chunk.rstrip(STOPS)
        if not (letters.isascii() and letters.isalpha()):
            return self._slow(" " + chunk)
        counts = self._piece(" " + letters)
        if len(letters) < len(chunk):
            total = counts[-1]
            counts = [*counts, *[total + n for n in self._piece(chunk[len(letters) :])]]
        return array("h", map(operator.sub, counts, [0, *counts])).tobytes()

    def _slow(self, text: str) -> bytes:
        """Changes of the count, character by character, of a text without special tokens."""
        changes = array("h")
        before, shown, blank, blank_start = 0, 0, "", 0
        for piece in self.split(text):
            own = self._piece(piece)
            last = before + own[-1]
            if piece[0] in WHITE:
                if blank:  # a cut after this first character makes one word of the white space
                    own = [blank_start + self._piece(blank + piece[0])[-1] - before, *own[1:]]
                else:
                    blank_start = before
                blank = blank + piece if piece[-1] in WHITE else ""
            else:
                blank = ""
            for count in own:
                changes.append(before + count - shown)
                shown = before + count
            before = last
        return changes.tobytes()

    def _plain(self, text: str) -> bytes:
        if text[:1] == " " or text[-1:] == " " or AFTER_BLANK.search(text) or BEFORE_BLANK.search(text):
            return self._slow(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.inner.__getitem__, rest))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of all character prefixes of ``text``, the empty prefix first."""
        found = list(self.special_pattern.finditer(text)) if self.special_pattern else []
        counts, start, total = [np.zeros(1, np.int64)], 0, 0
        for match in found:
            # inside a special token the text is still ordinary
            part = np.frombuffer(self._plain(text[start : match.end() - 1]), np.int16)
            part = total + np.cumsum(part, dtype=np.int64)
            inside = match.end() - match.start() - 1
            total = int(part[-inside - 1]) + 1 if len(part) > inside else total + 1
            counts += [part, np.array([total])]
            start = match.end()
        if start < len(text):
            counts.append(total + np.cumsum(np.frombuffer(self._plain(text[start:]), np.int16), dtype=np.int64))
        return np.concatenate(counts)


class _Chunks(dict):
    """Results by chunk; emptied when full, so memory stays bounded whatever the corpus holds."""

    def __init__(self, make, most: int = CACHED_CHUNKS // 4):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk: str) -> bytes:
        made = self.make(chunk)
        if len(chunk) < 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = made
        return made


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_tables(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and counts: the tokens of each character prefix, from the empty one to the whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        table = counter(path)
        return lambda ids, texts: [
            (i, table.prefix_counts((t or b"").decode()).tolist()) for i, t in zip(ids, texts)
        ]

    return row_map(docs, [doc_id, text], f"{doc_id} {kind}, counts array<int>", make)


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and n_chars_within: characters that fit in ``limit`` tokens."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        table = counter(path)

        def rows(ids, texts):
            for i, data in zip(ids, texts):
                counts = table.prefix_counts((data or b"").decode())
                n = int(counts[-1])
                yield i, len(data or b""), n, n > limit, longest_prefix(counts, limit)

        return lambda ids, texts: list(rows(ids, texts))

    schema = f"{doc_id} {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chars_within long"
    return row_map(docs, [doc_id, text], schema, make)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
