"""Nearest neighbours by inner product: learned binary codes in a multi-index, floats reranked.

Codes are the signs of the vector under learned rotations: for each of ``ROTATIONS`` parts, the
directions of the sample's principal axes, turned until signs lose least (iterative quantisation on at
most ``FIT_ROWS`` vectors). Codes are cut into substrings of 16 bits, each with its own directory of a
block. A code within a distance of ``r`` agrees with the query in at least one of ``m`` substrings but
for ``r // m`` bits, so probing those keys of every directory finds all codes within ``r``. Where the probed
keys hold more entries than the block has codes, comparing the block's codes finds the same ones with less
work. What is found is ranked by the inner product in double precision.

The radius is the ``COVERED`` quantile of the code distances between ``CALIBRATION`` queries and
their true neighbours, searched over all rows. Queries that find too few rows within it are searched
again without one.

Equal vectors are one entry with their smallest ids, as many as any result can use, so many copies of
one vector cost nothing. Entries are dealt to blocks by hash and queries meet them block by block; each pair of blocks
returns the best of each query only.

Cases: vectors that are null, zero, hold null or non-finite components, or have another dimension than
most take no part; a null id is no query and no candidate; repeated rows are candidates of the same
id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caudal.session import checkpointed

ROTATIONS = 4
TURNS = 20
FIT_ROWS = 8000
CALIBRATION = 64
COVERED = 0.98
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
SEED = 4


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """_id and _v (doubles) of the vectors that take part."""
    v = F.col("_v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    named = vectors.select(F.col(vec_id).alias("_id"), F.col(embedding).cast("array<double>").alias("_v"))
    named = named.filter(F.col("_id").isNotNull() & v.isNotNull() & sound & F.exists(v, lambda x: x != 0))
    size = named.groupBy(F.size(v).alias("_d")).count().orderBy(F.desc("count"), "_d").first()
    return named.filter(F.size(v) == (size[0] if size else 0))


def entries(rows: DataFrame, most: int) -> DataFrame:
    """_entry (least id), _v, _members (the ``most`` least ids) of each distinct vector."""
    order = F.row_number().over(W.partitionBy("_v").orderBy("_id"))
    few = rows.withColumn("_k", order).filter(F.col("_k") <= most)  # cut in tasks, before the shuffle
    return few.groupBy("_v").agg(
        F.min("_id").alias("_entry"), F.array_sort(F.collect_list("_id")).alias("_members")
    )


class Codes:
    """Rotations, (directions, dimensions), and packed signs under them."""

    def __init__(self, sample: np.ndarray):
        random = np.random.default_rng(SEED)
        size = sample.shape[1]
        axes = np.linalg.eigh(sample.T @ sample + 1e-9 * np.eye(size))[1]
        projected = sample @ axes
        parts = []
        for _ in range(ROTATIONS):
            turn = np.linalg.qr(random.normal(size=(size, size)))[0]
            for _ in range(TURNS):
                left, _, right = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
                turn = (left @ right).T
            parts.append((axes @ turn).T)
        padding = -len(parts) * size % 64
        self.directions = np.vstack([*parts, np.zeros((padding, size))])

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, substrings) of 16 bits each."""
        return np.packbits(vectors @ self.directions.T >= 0, axis=1).view(np.uint16)


BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ query.view(np.uint64)).sum(axis=1, dtype=np.int64)


class MultiIndex:
    """Directories of the substrings of a block's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.tables = []
        for column in self.codes.T:
            order = np.argsort(column, kind="stable")
            keys, start = np.unique(column[order], return_index=True)
            self.tables.append((keys, start, np.append(start[1:], len(column)), order))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within ``radius`` of the query's."""
        near = radius // len(self.tables)
        hits = [np.flatnonzero(BITS[keys ^ q] <= near) for q, (keys, _, _, _) in zip(query, self.tables)]
        load = sum(int((end[h] - start[h]).sum()) for h, (_, start, end, _) in zip(hits, self.tables))
        if load >= len(self.codes):
            return np.flatnonzero(distances(self.codes, query) <= radius)
        found = [order[start[k] : end[k]] for h, (_, start, end, order) in zip(hits, self.tables) for k in h]
        rows = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return rows[distances(self.codes[rows], query) <= radius]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 0))


FOUND = "_query long, _entry long, _score double, _distance int"


def _search(index: DataFrame, queries: DataFrame, codes: Codes, radius: int, most: int) -> DataFrame:
    """The ``most`` best entries of each query (_entry, _v) within the radius, block pair by block pair."""
    shared = index.sparkSession.sparkContext.broadcast(codes)  # of fixed size
    blocks = max(1, -(-index.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = queries.select(
        F.col("_entry").alias("_query"), F.col("_v").alias("_asked"),
        F.pmod(F.xxhash64("_entry"), F.lit(query_blocks)).cast("int").alias("_qb"),
        F.explode(number(blocks)).alias("_ib"),
    )
    right = index.select(
        F.col("_entry").alias("_held"), F.col("_v").alias("_vector"),
        F.pmod(F.xxhash64("_entry"), F.lit(blocks)).cast("int").alias("_ib"),
        F.explode(number(query_blocks)).alias("_qb"),
    )

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            vectors, ids = _matrix(held["_vector"]), held["_held"].to_numpy()
            block = MultiIndex(shared.value.of(vectors))
            asked_vectors = _matrix(asked["_asked"])
            for query, vector, code in zip(asked["_query"], asked_vectors, shared.value.of(asked_vectors)):
                rows = block.within(code, radius)
                scores = vectors[rows] @ vector
                if len(rows) > 4 * most:  # all that can be among the best, ties included
                    least = np.partition(scores, -most)[-most]
                    rows, scores = rows[scores >= least], scores[scores >= least]
                order = np.lexsort((ids[rows], -scores))[:most]
                away = distances(block.codes[rows[order]], code)
                out += [(query, int(ids[r]), float(s), int(d)) for r, s, d in zip(rows[order], scores[order], away)]
        return pd.DataFrame(out, columns=["_query", "_entry", "_score", "_distance"])

    found = left.groupBy("_qb", "_ib").cogroup(right.groupBy("_qb", "_ib")).applyInPandas(best, FOUND)
    order = W.partitionBy("_query").orderBy(F.desc("_score"), "_entry")
    return found.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row; ``is_query`` is a condition on ``_id``."""
    most = k + 1  # a query may find itself
    rows = checkpointed(usable(vectors, vec_id, embedding))
    index = checkpointed(entries(rows, most))
    asked = checkpointed(rows.filter(is_query).join(index.select("_v", "_entry"), "_v").select("_id", "_entry"))
    queries = index.join(asked.select("_entry").distinct(), "_entry", "left_semi").select("_entry", "_v")
    empty = "query_id long, rank int, vec_id long, score double"
    sample = index.select("_v").orderBy(F.xxhash64("_entry"), "_entry").limit(FIT_ROWS).toPandas()
    if sample.empty:
        return vectors.sparkSession.createDataFrame([], empty)
    codes = Codes(_matrix(sample["_v"]))
    everything = codes.directions.shape[0]
    some = queries.orderBy(F.xxhash64("_entry", F.lit(1)), "_entry").limit(CALIBRATION)
    far = _search(index, some, codes, everything, most).agg(F.percentile("_distance", COVERED)).first()[0]
    found = _listed(checkpointed(_search(index, queries, codes, int(far or 0), most)), index, most)
    found = checkpointed(found)
    enough = min(most, rows.count())
    short = found.filter(F.size("_list") < enough).select("_query")
    if not short.isEmpty():
        again = queries.join(short.withColumnRenamed("_query", "_entry"), "_entry", "left_semi")
        whole = _listed(_search(index, again, codes, everything, most), index, most)
        found = found.join(short, "_query", "left_anti").unionByName(whole)
    own = F.filter("_list", lambda x: x["id"] != F.col("_id"))
    ranked = asked.join(found.withColumnRenamed("_query", "_entry"), "_entry").select(
        "_id", F.posexplode(F.slice(own, 1, k)).alias("_at", "_x")
    )
    return ranked.select(
        F.col("_id").alias("query_id"), (F.col("_at") + 1).cast("int").alias("rank"),
        F.col("_x.id").alias("vec_id"), F.col("_x.score").alias("score"),
    )


def _listed(found: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """_query and _list: its best (score, id), copies included, best first, at most ``most``."""
    members = found.join(index.select("_entry", "_members"), "_entry")
    rows = members.select("_query", "_score", F.explode("_members").alias("_id"))
    order = W.partitionBy("_query").orderBy(F.desc("_score"), "_id")
    best = rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
    listed = F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_id").alias("id"), F.col("_score").alias("score"))))
    return best.groupBy("_query").agg(listed.alias("_list"))


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("_id") % 20 == 0)
