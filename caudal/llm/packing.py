"""Best-fit packing of documents into sequences of a fixed number of tokens: by groups, then by sizes.

A document's ids are followed by an end id. Only documents longer than a sequence are cut, so that all
pieces but the first are whole sequences; the first piece, shorter or not, is the item to pack.

Each group of items packs its own by best fit, longest first. Bins that are full but for ``SLACK`` tokens
are final, and so are those that even the least filled bin of all groups does not fit. What is left is
joined by best fit over how many bins there are of each fill, a table of at most a sequence's length, so
that this plan is made on the driver, whatever the size of the table. A bin finds its place in the plan by
its fill and its rank among those of the same fill; no task holds all bins of a fill.

No group holds more than ``GROUP_ITEMS`` items on average, whatever the size of the table: groups are
dealt by the hash of a row number, not by any column that could be skewed.

Cases: a null or empty text is the end id alone; an empty table gives an empty result; repeated rows
and null ids are documents of their own; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.common import read_documents, row_map
from caudal.session import checkpointed

SEQUENCE = 1024
SLACK = 2
GROUP_ITEMS = 20_000
END_ID = 2


@functools.lru_cache(maxsize=2)
def fast_encoding(path: str):
    """The byte-level vocabulary of a tokenizers file in the faster library, special tokens included.

    Ranks are ids here: such a vocabulary numbers its tokens in the order of their merges.
    """
    import tiktoken

    from caudal.llm.token_counts import PATTERN, byte_alphabet

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {
        bytes(alphabet[c] for c in token): i
        for token, i in spec["model"]["vocab"].items() if token not in special
    }
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=2)
def library_encoding(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text. The faster library refuses runs of white space of about a million; the other takes them."""
    try:
        return fast_encoding(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(library_encoding(path).encode(text, add_special_tokens=False).ids, np.uint32)


def encoded_pieces(
    docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """_id, first (tokens of the first piece), crcs (CRC-32 of each piece's ids)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        def row(i, data):
            ids = np.append(encode((data or b"").decode(), path), np.uint32(end_id)).astype("<u4")
            first = (len(ids) - 1) % sequence + 1
            cuts = [0, *range(first, len(ids) + 1, sequence)]
            return i, first, [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]

        return lambda ids, texts: list(map(row, ids, texts))

    renamed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return row_map(renamed, ["_id", "_text"], f"_id {kind}, first int, crcs array<long>", make)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; longest items first, fullest bin that fits."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces: list[int] = []  # spaces for which a bin is open, in order
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            chosen = open_by_space[space].pop()
            if not open_by_space[space]:
                del spaces[at]
        else:
            chosen = len(fill)
            fill.append(0)
        bins[item], offsets[item] = chosen, fill[chosen]
        fill[chosen] += size
        space = capacity - fill[chosen]
        if space:
            if not open_by_space[space]:
                insort(spaces, space)
            open_by_space[space].append(chosen)
    return bins, offsets, np.array(fill, np.int64)


def joined(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of items of which only the number of each size is known, longest first.

    Runs (size, from, to, each, bin, offset): the items of a size with ranks ``from`` to ``to`` - 1 go, ``each``
    to a bin, into the bins from number ``bin`` on, one behind the other from ``offset``.
    """
    runs = []
    open_bins: dict[int, list[tuple[int, int]]] = {}  # bins from, number of them; by space
    spaces: list[int] = []  # spaces for which a bin is open, in order
    made = 0

    def leave(space: int, start: int, number: int) -> None:
        if space and number:
            if space not in open_bins:
                insort(spaces, space)
            open_bins.setdefault(space, []).append((start, number))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                start, number = open_bins[space].pop()
                if not open_bins[space]:
                    del open_bins[space], spaces[at]
            else:
                space, start, number = capacity, made, -(-left // (capacity // size))
                made += number
            # a bin just filled is the fullest that fits, so it is filled on
            each = min(space // size, left)
            used = min(number, left // each)
            runs.append((size, rank, rank + used * each, each, start, capacity - space))
            rank, left = rank + used * each, left - used * each
            leave(space - each * size, start, used)
            rest = number - used
            if rest and 0 < left < each:  # one bin more, not filled as far
                runs.append((size, rank, rank + left, left, start + used, capacity - space))
                leave(space - left * size, start + used, 1)
                used, rest, left = used + 1, rest - 1, 0
            if space < capacity:
                leave(space, start + used, rest)
    return runs


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """Pack each group's items; a row per bin, numbered within its group and fill."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, fill = best_fit(pdf["size"].to_numpy(), capacity)
        members: list[list[dict]] = [[] for _ in fill]
        for row, b, offset in zip(pdf["row"], bins, offsets):
            members[b].append({"row": int(row), "offset": int(offset)})
        rank = pd.Series(fill).groupby(fill).cumcount()
        return pd.DataFrame({"size": fill, "members": members, "rank": rank, "_group": pdf["_group"].iloc[0]})

    return items.groupBy("_group").applyInPandas(
        pack, "size int, members array<struct<row:long,offset:int>>, rank long, _group long"
    )


def _joined_bins(packed: DataFrame, capacity: int, slack: int) -> tuple[DataFrame, DataFrame | None]:
    """members of the bins that are final, and _row, _sequence, _offset of those that are joined."""
    room = packed.filter(F.col("size") < capacity - slack)
    per_group = checkpointed(room.groupBy("size", "_group").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["size"]: r["n"] for r in per_group.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    least = min(counts, default=capacity)
    if counts and counts[least] == 1:  # a single bin does not fit into itself
        most = capacity - least if len(counts) > 1 else 0
    else:
        most = capacity - least
    counts = {size: n for size, n in counts.items() if size <= most}
    if sum(counts.values()) < 2:
        return packed.select("members"), None
    runs = joined(counts, capacity)
    plan = packed.sparkSession.createDataFrame(
        runs, "_size int, _from long, _to long, _each long, _bin long, _at int"
    )
    before = Window.partitionBy("size").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_group.filter(F.col("size") <= most).select(
        "size", "_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    ranked = room.filter(F.col("size") <= most).join(starts, ["size", "_group"])
    ranked = ranked.withColumn("_rank", F.col("rank") + F.col("_start"))
    inside = (F.col("size") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    nth = F.col("_rank") - F.col("_from")
    placed = ranked.join(F.broadcast(plan), inside).select(
        (F.col("_bin") + F.floor(nth / F.col("_each"))).alias("_bin"), "members",
        (F.col("_at") + (nth % F.col("_each")) * F.col("size")).cast("int").alias("_at"),
    )
    opener = F.first(F.col("members")[0]["row"]).over(Window.partitionBy("_bin").orderBy("_at"))
    rows = placed.select(opener.alias("_sequence"), "_at", F.explode("members").alias("_m")).select(
        F.col("_m.row").alias("_row"), "_sequence", (F.col("_m.offset") + F.col("_at")).alias("_offset")
    )
    final = (F.col("size") > most) | (F.col("size") >= capacity - slack)
    return packed.filter(final).select("members"), rows


def place(items: DataFrame, capacity: int = SEQUENCE, slack: int = SLACK) -> DataFrame:
    """For rows (_row unique, size 1 to ``capacity``): _row, _sequence, _offset."""
    groups = max(1, -(-items.count() // GROUP_ITEMS))
    packed = checkpointed(_packed(items.select(
        F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"), "size", F.col("_row").alias("row"),
    ), capacity))
    final, more = (packed.select("members"), None) if groups == 1 else _joined_bins(packed, capacity, slack)
    # a bin is known by the row that opens it
    rows = final.select(
        F.col("members")[0]["row"].alias("_sequence"), F.explode("members").alias("_m")
    ).select(F.col("_m.row").alias("_row"), "_sequence", F.col("_m.offset").alias("_offset"))
    return rows if more is None else rows.unionByName(more)


def pack_documents(
    docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    encoded = encoded_pieces(docs, path, sequence, end_id, doc_id, text)
    encoded = checkpointed(encoded.withColumn("_row", F.monotonically_increasing_id()))
    placed = place(encoded.select("_row", F.col("first").alias("size")), sequence)
    rows = encoded.join(placed, "_row").select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    later = F.col("piece") > 0
    alone = -1 - F.monotonically_increasing_id()  # whole pieces are sequences of their own, numbered below zero
    return rows.select(
        F.col("_id").alias(doc_id),
        "piece",
        F.when(later, F.col("first") + (F.col("piece") - 1).cast("long") * sequence).otherwise(0).alias("start"),
        F.when(later, F.lit(sequence)).otherwise(F.col("first")).cast("long").alias("length"),
        "ids_crc32",
        F.when(later, alone).otherwise(F.col("_sequence")).alias("sequence_id"),
        F.when(later, 0).otherwise(F.col("_offset")).cast("long").alias("offset"),
    )


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
