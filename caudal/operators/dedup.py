"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.session import checkpointed, shuffles_freed

WORD_BITS = 1 << 15  # the size of Spark's bitmap aggregate
KEY_BITS = 16
MOST_WORDS = 1 << 13


def not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is complete; otherwise all NULL keys would fall into one group."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def latest_by_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], wanted: Sequence[str] | None = None
) -> DataFrame:
    """The row with the greatest ``order_by`` values per key, rows with a NULL key left out.

    Ties are broken by the greatest remaining values, column by column, so the
    result does not depend on arrival order; NULL is the smallest value.  Spark
    cuts the ranking to its first row in every task before the shuffle, so a
    frequent key sends one row per task, as an aggregate would; without
    duplicates this is a fifth faster than the maximum of the row as a struct
    (3.9 against 4.8 s for 600,000 wide rows, 3.6 against 4.4 s with a quarter repeated).

    ``wanted`` are the columns that will be read. Ties are broken column by column, so those after the last
    wanted one decide between rows that are alike in all before: they are left out, and no value changes.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    if wanted is not None:
        rest = rest[:max((i for i, c in enumerate(rest, 1) if c in wanted), default=0)]
        df = df.select(*[c for c in df.columns if c in (*keys, *order_by, *rest)])
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*order_by, *rest]])
    ranked = not_null(df, keys).withColumn("_rank_of_key", F.row_number().over(newest))
    return ranked.filter("_rank_of_key = 1").drop("_rank_of_key")


def latest_by_repeated_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], wanted: Sequence[str] | None = None
) -> DataFrame:
    """``latest_by_key`` for a stored table in which most keys occur once: only rows whose key may occur again are ranked and shuffled.

    A first pass over the keys counts their hashes. Those that occur again set bits, ``KEY_BITS`` for each up to ``MOST_WORDS`` bitmaps (32 MB),
    which are broadcast. A row whose bit is not set has a key of its own; where bits are shared, rows are ranked needlessly.
    ``df`` is read once more for each kind of row.
    """
    df = not_null(df, keys)
    mark = F.hash(*keys).cast("long") + (1 << 31)
    with shuffles_freed(df.sparkSession):
        again = checkpointed(df.groupBy(mark.alias("_mark")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_mark"))
        words = min(MOST_WORDS, again.count() * KEY_BITS // WORD_BITS + 1)
        word, position = lambda m: m % words, lambda m: F.floor(m / words) % WORD_BITS
        marks = again.groupBy(word(F.col("_mark")).alias("_word")).agg(F.bitmap_construct_agg(position(F.col("_mark"))).alias("_bits"))
        # bytes as numbers of four bytes, of which a bit is read at no cost
        four = F.transform(F.sequence(F.lit(0), F.lit(WORD_BITS // 32 - 1)), lambda i: (
            F.conv(F.hex(F.substring("_bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long") - (1 << 31)).cast("int"))
        marks = checkpointed(marks.select("_word", four.alias("_bits")))  # for both kinds of rows
    marked = df.withColumn("_mark", mark).withColumn("_word", word(F.col("_mark"))).join(F.broadcast(marks), "_word", "left")
    at = position(F.col("_mark"))
    held = F.get("_bits", F.floor(at / 32).cast("int")).cast("long") + (1 << 31)
    bit = F.getbit(held, ((3 - F.floor(at / 8) % 4) * 8 + at % 8).cast("int")) == 1
    marked = marked.withColumn("_again", F.coalesce(bit, F.lit(False)))
    ranked = latest_by_key(marked.filter("_again").select(*df.columns), keys, order_by, wanted)
    return marked.filter("NOT _again").select(*ranked.columns).unionByName(ranked)


def content_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Groups of complete ``columns`` that occur more than once, with their size ``n``."""
    grouped = not_null(df, columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return grouped.filter(F.col("n") > 1)
