"""Which stored files may hold a key: a Bloom filter and the range of the keys, kept beside each file.

A filter is made of bitmaps of ``WORD_BITS`` bits, as many as its keys need at ``KEY_BITS`` bits a key. A key
belongs to one of them by its hash and sets ``PROBES`` bits there, so testing it reads one bitmap. A filter never
denies a key it holds; about one key in two hundred that it does not hold passes.

All of it is plain aggregates and joins: bitmaps are built in tasks and merged, and no list of keys is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.operators.small import fits_broadcast

WORD_BITS = 1 << 15  # the size of Spark's bitmap aggregate
KEY_BITS = 12
PROBES = 6


def _hash(seed: int, keys: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def _word(keys: Sequence[str]) -> Column:
    return F.pmod(_hash(-1, keys), F.col("_words")).cast("int")


def _positions(keys: Sequence[str]) -> list[Column]:
    return [F.pmod(_hash(i, keys), F.lit(WORD_BITS)) for i in range(PROBES)]


def _bit(bits: str, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def key_filters(rows: DataFrame, keys: Sequence[str], file: str) -> DataFrame:
    """Filters of the keys of each ``file``: file, _words, _word, _bits, _low, _high; a row for each bitmap that is not empty."""
    keys = list(keys)
    held = rows.select(file, *keys).distinct()
    sizes = held.groupBy(file).agg(
        F.ceil(F.count(F.lit(1)) * KEY_BITS / WORD_BITS).alias("_words"),
        F.min(F.struct(*keys)).alias("_low"), F.max(F.struct(*keys)).alias("_high"),
    )
    probes = held.join(sizes.select(file, "_words"), file).select(
        file, "_words", _word(keys).alias("_word"), F.explode(F.array(*_positions(keys))).alias("_at"))
    bitmaps = probes.groupBy(file, "_words", "_word").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    return bitmaps.join(sizes.drop("_words"), file)


def may_hold(filters: DataFrame, wanted: DataFrame, keys: Sequence[str], file: str, name: Sequence[str]) -> DataFrame:
    """The ``name`` columns of the filters that may hold one of the ``wanted`` keys of the same ``file``.

    A key meets the one bitmap of each filter that its hash names: keys and bitmaps join by it, an equality.
    """
    keys, positions = list(keys), [f"_at{i}" for i in range(PROBES)]
    key, bitmap = F.struct(*keys), [file, *name, "_words", "_word"]
    logs = filters.select(file, *[c for c in name if c != file], "_words").distinct()  # a row for each filter
    asked = wanted.select(file, *keys, *[p.alias(c) for p, c in zip(_positions(keys), positions)])
    asked = asked.join(F.broadcast(logs) if fits_broadcast(logs) else logs, file).withColumn("_word", _word(keys))
    tests = [key >= F.col("_low"), key <= F.col("_high")] + [_bit("_bits", F.col(c)) for c in positions]
    side = F.broadcast(filters) if fits_broadcast(filters) else filters
    return asked.join(side, list(dict.fromkeys(bitmap))).filter(reduce(and_, tests)).select(*name).distinct()
