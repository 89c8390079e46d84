"""Byte-pair encoding and decoding with a contiguous array of ranks per word.

A short word is a list of parts and, beside it, the rank of each adjacent pair. The least rank is
looked for repeatedly, its boundary is deleted, and only the two ranks next to it are refreshed. Words
of more than ``SHORT`` parts use a heap over a linked list, with the same result in n log n steps.

Texts are cut at special tokens, brought to the normal form the vocabulary asks for, and split at
blanks; results of blank-separated chunks are kept in a bounded table per Python worker.

Cases: a null text counts as empty (no tokens, empty decoded text); an empty table gives an empty
result; repeated rows give repeated results; a null id is passed through; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame

from caudal.llm.common import read_documents, row_map

# fixed value of the tokenizer family: what a word is
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT = 128
CACHED_CHUNKS = 300_000
NEVER = 1 << 30


def byte_characters() -> list[str]:
    """For each byte the printable character that stands for it in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary with word ends, in lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(model["merges"])}
        self.word_end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        longest_first = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(longest_first) + ")").split if self.special else lambda t: [t]
        self.words = regex.compile(WORDS).findall
        self.characters = byte_characters()
        self.chunks: dict[str, tuple[int, str, str]] = {}

    def merge(self, parts: list[str]) -> list[str]:
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank_of = self.ranks.get
        ranks = [rank_of(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NEVER)
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (parts[a], parts[b]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[parts[a], parts[b]], a, parts[a], parts[b]))
        return [p for p in parts if p]

    def encode_word(self, word: str) -> list[int]:
        parts = [self.characters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.word_end
        return [self.ids[p] for p in self.merge(parts)]

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids and tokens of a chunk, each joined by blanks."""
        known = self.chunks.get(chunk)
        if known is None:
            lower = chunk.lower() if "Σ" not in chunk else "".join(map(str.lower, chunk))
            ids = [i for word in self.words(lower) for i in self.encode_word(word)]
            known = " ".join(map(str, ids)), self.decode(ids)
            if len(chunk) < 64:
                if len(self.chunks) >= CACHED_CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = known
        return known

    def _joined(self, text: str) -> tuple[str, str]:
        ids, tokens = [], []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                ids.append(str(self.special[part]))
                tokens.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            for i, t in map(self._chunk, part.split(" ")):
                if i:
                    ids.append(i)
                    tokens.append(t)
        return " ".join(ids), " ".join(tokens)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self._joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: this vocabulary comes without a decoder."""
        return " ".join(self.tokens[i] for i in ids)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of the whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        bpe = coder(path)
        return lambda ids, texts: [(i, bpe.encode((t or b"").decode())) for i, t in zip(ids, texts)]

    return row_map(docs, [doc_id, text], f"{doc_id} {kind}, ids array<int>", make)


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text the ids decode to; null ids decode to the empty text."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def make():
        bpe = coder(path)
        return lambda keys, lists: [(k, bpe.decode(x or [])) for k, x in zip(keys, lists)]

    return row_map(encoded, [doc_id, ids], f"{doc_id} {kind}, text string", make)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by blanks) and of the decoded text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sha = lambda value: hashlib.sha256(value.encode()).hexdigest()

    def make():
        bpe = coder(path)

        def row(i, data):
            ids, decoded = bpe._joined((data or b"").decode())
            return i, ids.count(" ") + 1 if ids else 0, sha(ids), sha(decoded)

        return lambda ids, texts: list(map(row, ids, texts))

    schema = f"{doc_id} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return row_map(docs, [doc_id, text], schema, make)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
