"""Hard negatives by inner product: Kronecker-packed products over blocks of rows.

Components are whole numbers, ``floor(scale * x)``. A block packs all its rows: for each dimension, the rows'
components, made non-negative by a bias, stand side by side in fields of one wide integer. An anchor multiplies each
wide integer once, by its own component, biased too, and adds the products up; every field then holds the exact
biased inner product of one row, as fields have room for the greatest sum. Taking off what the biases added, which
follows from sums of components, leaves the scores.

Rows are dealt to blocks of about ``BLOCK_ROWS`` rows by their labels: a label with more than a quarter of that has
blocks of its own, as many as it needs, and rarer ones share blocks. Blocks are packed once and stored. Anchors, in
groups of about ``ANCHOR_ROWS``, meet the blocks that hold their label for their positives, and then all blocks but
those that hold nothing else for their negatives, so that every pair of an anchor and a row is multiplied about once.
A block returns the best few rows of an anchor, or of an anchor and a positive, and these are ranked over all blocks.

A negative of a positive is a row of another label whose score is at least ``percent`` hundredths of the positive's
and not above it.

Cases: rows with a null label, a null vector, a null, NaN or infinite component, another dimension than most, or a
null id take no part, nor do rows with a component so large that scores could exceed ``SCORE_BITS`` bits; zero vectors
do (score 0). Ties go to the smaller id, then to either of rows that repeat an id. Repeated rows are rows of their own:
each is an anchor if its id is one, and a positive of the other. An anchor without positives and a positive without
negatives have no rows. A table without usable rows gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caudal.llm.common import broadcast_if_small
from caudal.session import checkpointed

BLOCK_ROWS = 2048
ANCHOR_ROWS = 2048
SCORE_BITS = 56


class Packing:
    """How rows of ``size`` components of at most ``bias`` in magnitude are packed and multiplied."""

    def __init__(self, size: int, bias: int):
        self.size, self.bias = size, bias
        self.field = np.dtype("<u4" if 4 * bias * bias * size < 1 << 32 else "<u8")

    def pack(self, vectors: np.ndarray) -> list[bytes]:
        """For each dimension, the wide integer whose fields are the rows' biased components."""
        biased = (vectors + self.bias).astype(self.field)
        return [np.ascontiguousarray(column).tobytes() for column in biased.T]

    def scores(self, anchor: np.ndarray, wide: list[int], sums: np.ndarray) -> np.ndarray:
        """Exact inner products of an anchor with all rows packed in ``wide``, whose components add up to ``sums``."""
        total = sum(map(operator.mul, (anchor + self.bias).tolist(), wide))
        fields = np.frombuffer(total.to_bytes(len(sums) * self.field.itemsize, "little"), self.field)
        added = self.bias * (int(anchor.sum()) + self.bias * self.size)
        return fields.astype(np.int64) - self.bias * sums - added


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` first of ``rows`` by score from the top, then by id."""
    if len(rows) > 4 * most:
        least = np.partition(scores[rows], -most)[-most]  # ties included
        rows = rows[scores[rows] >= least]
    return rows[np.lexsort((ids[rows], -scores[rows]))[:most]]


def usable(rows: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> tuple[DataFrame, Packing]:
    """_id, _label, _v (whole numbers) and _row of the rows that take part, and how they are packed."""
    v = F.col("_v")
    named = rows.select(
        F.col(vec_id).cast("long").alias("_id"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_v")
    ).filter("_id IS NOT NULL AND _label IS NOT NULL AND _v IS NOT NULL")
    sound = named.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    common = sound.filter(F.size(v) > 0).groupBy(F.size(v).alias("_d")).count().orderBy(F.desc("count"), "_d").first()
    size = common["_d"] if common else 0
    largest = math.isqrt((1 << SCORE_BITS) // max(1, size))
    whole = sound.filter(F.size(v) == size).withColumn("_v", F.transform(v, lambda x: F.floor(x * scale)))
    small = whole.filter(F.forall(v, lambda x: x.between(-largest, largest)))
    kept = checkpointed(small.withColumn("_row", F.monotonically_increasing_id()))
    greatest = F.max(F.greatest(F.array_max(v), -F.array_min(v)))
    return kept, Packing(size, int(kept.agg(greatest).first()[0] or 0) if size else 0)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with _code (a number for the label), _bucket (of labels), _parts (its blocks) and _part."""
    counts = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    counts = checkpointed(counts.withColumn("_code", F.monotonically_increasing_id()))
    many = F.col("_n") > BLOCK_ROWS // 4
    rare = counts.filter(~many).agg(F.sum("_n")).first()[0] or 0
    shared = F.pmod(F.xxhash64("_code"), F.lit(max(1, -(-rare // BLOCK_ROWS))))
    places = counts.select(
        "_label", "_code", F.when(many, F.col("_code")).otherwise(-1 - shared).alias("_bucket"),
        F.when(many, F.ceil(F.col("_n") / BLOCK_ROWS)).otherwise(1).cast("int").alias("_parts"),
    )
    part = F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")
    return rows.join(broadcast_if_small(places, 64), "_label").withColumn("_part", part)


def packed_blocks(rows: DataFrame, packing: Packing) -> DataFrame:
    """A row for each block: ids, row numbers, label codes and sums of its rows, and the wide integers, as bytes."""
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_id", "_row"])
        vectors = np.stack(frame["_v"].to_list()).astype(np.int64)
        numbers = [frame[c].to_numpy("<i8").tobytes() for c in ("_id", "_row", "_code")]
        key = (int(frame["_bucket"].iloc[0]), int(frame["_part"].iloc[0]))
        return pd.DataFrame([(*key, *numbers, vectors.sum(axis=1).astype("<i8").tobytes(), packing.pack(vectors))],
                            columns=["_bucket", "_part", "_ids", "_rows", "_codes", "_sums", "_wide"])

    schema = "_bucket long, _part int, _ids binary, _rows binary, _codes binary, _sums binary, _wide array<binary>"
    columns = rows.select("_bucket", "_part", "_id", "_row", "_code", "_v")
    return checkpointed(columns.groupBy("_bucket", "_part").applyInPandas(pack, schema))


def met(
    anchors: DataFrame, blocks: DataFrame, groups: int, packing: Packing, wanted: Callable[[int, int], bool],
    find: Callable[..., Iterable[tuple]], schema: str,
) -> DataFrame:
    """What ``find`` yields for each anchor and each block of its _slot that is wanted, given the buckets of both.

    ``find`` takes an anchor (a dictionary), the scores of the block's rows with it, their ids, row numbers and label codes.
    """
    names = [column.split()[0] for column in schema.split(", ")]

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        vectors = [np.array(v, np.int64) for v in asked.pop("_v")]
        queries = asked.to_dict("records")
        for block in held.to_dict("records"):
            ids, rows, codes, sums = (np.frombuffer(block[c], "<i8") for c in ("_ids", "_rows", "_codes", "_sums"))
            wide = [int.from_bytes(b, "little") for b in block["_wide"]]
            for anchor, vector in zip(queries, vectors):
                if wanted(anchor["_bucket"], block["_bucket"]):
                    out += find(anchor, packing.scores(vector, wide, sums), ids, rows, codes)
        return pd.DataFrame(out, columns=names)

    left = anchors.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    right = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return left.groupBy("_group", "_slot").cogroup(right.groupBy("_group", "_slot")).applyInPandas(meet, schema)


def first(df: DataFrame, most: int, by: tuple[str, ...], order: tuple[Column | str, ...]) -> DataFrame:
    """The ``most`` first rows of each group and their _rank; Spark cuts to as many in each task before it shuffles."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= most)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is a condition on ``_id``."""
    kept, packing = usable(rows, scale, vec_id, vector, label)
    placed = checkpointed(dealt(kept))
    blocks = packed_blocks(placed, packing)
    slots, count = max(1, blocks.count()), placed.filter(is_anchor).count()
    groups = max(1, -(-count // ANCHOR_ROWS))
    slot = lambda bucket, part: F.pmod(F.xxhash64(bucket, part), F.lit(slots)).cast("int")
    blocks = blocks.withColumn("_slot", slot(F.col("_bucket"), F.col("_part")))
    anchors = placed.filter(is_anchor).select("_id", "_row", "_code", "_bucket", "_parts", "_v")

    def alike(anchor, scores, ids, rows, codes):
        own = np.flatnonzero((codes == anchor["_code"]) & (rows != anchor["_row"]))
        chosen = best(scores, ids, own, positives)
        return [(anchor["_row"], int(ids[i]), int(rows[i]), int(scores[i])) for i in chosen]

    parts = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda part: slot(F.col("_bucket"), part))
    of_label = anchors.withColumn("_slot", F.explode(F.array_distinct(parts))).drop("_parts")
    found = met(of_label, blocks, groups, packing, operator.eq, alike, "_anchor long, _other long, _of long, _score long")
    found = first(found, positives, ("_anchor",), (F.desc("_score"), "_other", "_of"))
    listed = found.groupBy("_anchor").agg(F.array_sort(F.collect_list(F.struct("_rank", "_other", "_score"))).alias("_list"))
    listed = listed.select(F.col("_anchor").alias("_row"), F.col("_list._other").alias("_others"), F.col("_list._score").alias("_scores"))
    paired = checkpointed(anchors.drop("_parts").join(listed, "_row"))

    def unlike(anchor, scores, ids, rows, codes):
        other = codes != anchor["_code"]
        for rank, (positive, top) in enumerate(zip(anchor["_others"], anchor["_scores"])):
            near = np.flatnonzero(other & (scores <= top) & (100 * scores >= percent * top))
            for i in best(scores, ids, near, negatives):
                yield anchor["_row"], rank, anchor["_id"], int(positive), int(top), int(ids[i]), int(rows[i]), int(scores[i])

    everywhere = paired.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    schema = "_anchor long, _place long, _id long, _positive long, _top long, _other long, _of long, _score long"
    mixed = lambda own, block: block < 0 or block != own
    below = met(everywhere, blocks, groups, packing, mixed, unlike, schema)
    below = first(below, negatives, ("_anchor", "_place"), (F.desc("_score"), "_other", "_of"))
    return below.select(
        F.col("_id").alias("anchor_id"), F.col("_positive").alias("positive_id"), F.col("_rank").cast("int").alias("rank"),
        F.col("_other").alias("negative_id"), F.col("_top").alias("positive_score"), F.col("_score").alias("negative_score"),
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Ids divisible by 100 are anchors; the labels of ids divisible by 7 are moved by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("_id") % 100 == 0)


#: exact at the test sizes, where SQL compares every anchor with every row
ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
