"""Near-duplicates: universal hash minima in bands, verified on signatures and then on whole sets.

A document's set are the hashes of its distinct shingles of ``size`` words (64 bits; a collision inside
a pair of documents is the only inexactness, about one in 10^12 pairs). Fewer words than that are one
shingle; no words, no set and no links.

1. Documents with the same set are one node. Each node has ``BANDS * ROWS`` minima of universal
   hashes. Two sets of similarity 0.8 share no band with a probability of 3 in a million.
2. In each bucket of a band every node is compared with the bucket's least node. A pair is first
   verified on its signatures (8 bits of each minimum; five deviations below the threshold), then on
   the whole sets. Verified links give components.
3. Buckets that still hold several components are searched for links between them, each pair in the first
   band it shares. Nodes with a partner that signatures allow get their whole sets, and links are
   decided where the bucket is, most similar first; a task returns links only, no candidate pairs. Links inside a component are never looked
   for, so a bucket of many mutual near-copies costs no square of its size. Large buckets are
   searched in blocks of bounded size.

Cases: a null or empty text has no set, no links and stands for itself; a null id is in no one's
component id and its row is kept if it has no linked id; repeated rows get equal results; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.common import broadcast_if_small, read_documents, row_map
from caudal.llm.components import connected_components
from caudal.session import checkpointed

BANDS, ROWS = 32, 5
SEED = 20
BLOCK = 2048
GROUP_ROWS = 4000
CACHED_WORDS = 150_000
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh3_64_digest(word)
        if len(word) < 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


class Shingler:
    """Sets and signatures of texts given as UTF-8."""

    def __init__(self, size: int):
        self.size = size
        self.words = _WordHashes()
        random = np.random.default_rng(SEED)
        self.factor = (random.integers(0, 1 << 32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.shift = random.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)

    def shingles(self, data: bytes) -> np.ndarray:
        """Distinct shingle hashes in ascending order."""
        words = data.lower().split()  # of bytes: A-Z and ASCII white space only
        hashes = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint64)
        width = min(self.size, len(words))
        if not width:
            return np.zeros(0, np.uint64)
        count = len(words) - width + 1
        with np.errstate(over="ignore"):
            mixed = np.full(count, width, np.uint64)
            for k in range(width):
                mixed = mixed * MIX[0] + hashes[k : k + count]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX[1]
            mixed = (mixed ^ (mixed >> np.uint64(27))) * MIX[2]
        return np.unique(mixed ^ (mixed >> np.uint64(32)))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for start in range(0, len(short), 2048):
            part = short[start : start + 2048]
            np.minimum(least, (self.factor[:, None] * part + self.shift[:, None]).min(axis=1), out=least)
        return least


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _kind(docs: DataFrame, doc_id: str) -> str:
    return docs.schema[doc_id].dataType.simpleString()


def signatures(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _n (set size), _key (of the set), _bands (a hash each), _sketch (8 bits of each minimum)."""

    def make():
        shingler = Shingler(size)

        def row(i, data):
            shingles = shingler.shingles(data or b"")
            if not len(shingles):
                return i, 0, None, None, None
            least = shingler.minima(shingles)
            bands = [
                xxhash.xxh3_64_intdigest(band.tobytes(), seed=k) - (1 << 63)
                for k, band in enumerate(least.reshape(BANDS, ROWS))
            ]
            # high bits of a product: low bits of minima of such hashes are not independent
            sketch = ((least * np.uint32(2654435769)) >> np.uint32(24)).astype(np.uint8)
            return i, len(shingles), set_key(shingles), bands, sketch.tobytes()

        return lambda ids, texts: list(map(row, ids, texts))

    renamed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {_kind(docs, doc_id)}, _n long, _key binary, _bands array<long>, _sketch binary"
    return row_map(renamed, ["_id", "_text"], schema, make)


def whole_sets(
    docs: DataFrame, nodes: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """_node and _set for nodes (_node, _id, _key), from the texts of their documents."""

    def make():
        shingler = Shingler(size)

        def row(data):
            shingles = shingler.shingles(data or b"")
            return set_key(shingles), shingles.view(np.int64)

        return lambda texts: list(map(row, texts))

    wanted = broadcast_if_small(nodes.select("_id").distinct(), 16)
    renamed = docs.select(F.col(doc_id).alias("_own"), F.col(text).alias("_text"))
    texts = renamed.join(wanted, F.col("_own").eqNullSafe(F.col("_id")), "left_semi")
    sets = row_map(texts, ["_text"], "_key binary, _set array<long>", make)
    found = sets.join(nodes.select("_node", "_key"), "_key")
    return found.groupBy("_node").agg(F.first("_set").alias("_set"))


def _alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches: agreeing minima, corrected for chance agreement of 8 bits."""
    return ((left == right).mean(axis=-1) * 256 - 1) / 255


def least_estimate(percent: int) -> float:
    p = percent / 100
    return p - 5 * (p * (1 - p) / (BANDS * ROWS)) ** 0.5


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (_a, _b) with ``100 * intersection >= percent * union``."""
    common = F.size(F.array_intersect("_left", "_right"))
    union = F.size("_left") + F.size("_right") - common
    return (
        pairs.join(sets.select(F.col("_node").alias("_a"), F.col("_set").alias("_left")), "_a")
        .join(sets.select(F.col("_node").alias("_b"), F.col("_set").alias("_right")), "_b")
        .filter(common * 100 >= union * percent)
        .select("_a", "_b")
    )


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (_a, _b) whose signatures allow the similarity."""
    least = least_estimate(percent)

    def make():
        def rows(a, b, left, right):
            x = np.frombuffer(b"".join(left), np.uint8).reshape(len(a), -1)
            y = np.frombuffer(b"".join(right), np.uint8).reshape(len(a), -1)
            passed = np.flatnonzero(_alike(x, y) >= least)
            return [(a[i], b[i]) for i in passed]

        return rows

    both = pairs.join(nodes.select(F.col("_node").alias("_a"), F.col("_sketch").alias("_left")), "_a").join(
        nodes.select(F.col("_node").alias("_b"), F.col("_sketch").alias("_right")), "_b"
    )
    return row_map(both, ["_a", "_b", "_left", "_right"], "_a long, _b long", make)


MEMBER = "_h long, _i long, _j long, _k int, _node long, _root long, _least long, _block long, _sketch binary, _bands array<long>"


def _partners(pdf: pd.DataFrame, least: float):
    """For each node of a bucket's block pair: its row and, most similar first, rows it may be linked to.

    Only pairs of different components whose signatures allow a link, and each pair in
    the first band they share only. Pairs with the bucket's least node have been compared before.
    """
    sketch = np.frombuffer(b"".join(pdf["_sketch"]), np.uint8).reshape(len(pdf), -1)
    bands = np.stack(pdf["_bands"].to_list())[:, : pdf["_k"].iloc[0]]
    root, node, block = pdf["_root"].to_numpy(), pdf["_node"].to_numpy(), pdf["_block"].to_numpy()
    i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
    rest = node != pdf["_least"].iloc[0]
    right = np.flatnonzero((block == j) & rest)
    for x in np.flatnonzero((block == i) & rest):
        others = right[root[right] != root[x]]
        if i == j:
            others = others[others > x]
        if not len(others):
            continue
        score = _alike(sketch[x], sketch[others])
        keep = score >= least
        keep[keep] = ~(bands[others[keep]] == bands[x]).any(axis=1)
        if keep.any():
            yield x, others[keep][np.argsort(-score[keep], kind="stable")]


def _by_bucket(pdf: pd.DataFrame):
    pdf = pdf.sort_values(["_h", "_i", "_j", "_node"], ignore_index=True)
    starts = np.flatnonzero((pdf[["_h", "_i", "_j"]].diff() != 0).any(axis=1).to_numpy())
    for a, b in zip(starts, [*starts[1:], len(pdf)]):
        yield pdf.iloc[a:b].reset_index(drop=True)


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (_a, _b) between components that share a bucket, no more than join the components there.

    ``members``: _h, _k (band), _node, _root, _sketch, _bands, and _size and _least of the bucket. A
    first pass finds the nodes with a partner that signatures allow; only these get their sets.
    """
    least = least_estimate(percent)
    blocks = F.ceil(F.col("_size") / BLOCK)
    dealt = (
        members.withColumn("_block", F.pmod(F.xxhash64("_node"), blocks))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other"))
        .select(*(part.split()[0] for part in MEMBER.split(", ")))
    )

    def with_partner(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [pdf.iloc[:0]]
        for bucket in _by_bucket(pdf):
            used = {int(row) for x, others in _partners(bucket, least) for row in (x, *others)}
            if used:
                kept.append(bucket.iloc[sorted(used)])
        return pd.concat(kept)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for bucket in _by_bucket(pdf):
            node, found, root = bucket["_node"].to_numpy(), bucket["_set"].to_list(), bucket["_root"].to_numpy().copy()
            for x, others in _partners(bucket, least):
                for y in others:
                    if root[x] == root[y]:
                        continue  # linked meanwhile
                    common = len(np.intersect1d(found[x], found[y], assume_unique=True))
                    if common * 100 >= percent * (len(found[x]) + len(found[y]) - common):
                        out.append((min(node[x], node[y]), max(node[x], node[y])))
                        root[root == root[y]] = root[x]
        return pd.DataFrame(out, columns=["_a", "_b"]).astype("int64")

    return _grouped(checkpointed(_grouped(dealt, with_partner, MEMBER)).join(sets, "_node"), links, "_a long, _b long")


def _grouped(rows: DataFrame, work, schema: str) -> DataFrame:
    """Many buckets to a group: a group of its own for each would cost more than the search."""
    groups = max(1, -(-rows.count() // GROUP_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_h", "_i", "_j"), F.lit(groups)))
    return dealt.repartition(groups, "_group").groupBy("_group").applyInPandas(
        lambda pdf: work(pdf.drop(columns="_group")), schema)


def near_duplicate_classes(
    docs: DataFrame, size: int, percent: int, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _n, _key), and classes (_key, _component: the least id that is reachable)."""
    rows = checkpointed(
        signatures(docs, size, doc_id, text).withColumn("_row", F.monotonically_increasing_id())
    )
    classes = checkpointed(
        rows.filter("_n > 0").groupBy("_key").agg(F.min("_row").alias("_node"), F.min("_id").alias("_least_id"))
    )
    nodes = rows.join(classes.select(F.col("_node").alias("_row")), "_row", "left_semi")
    nodes = nodes.withColumnRenamed("_row", "_node")
    banded = nodes.select("_node", F.posexplode("_bands").alias("_k", "_h"))
    buckets = banded.groupBy("_h").agg(F.min("_node").alias("_least"), F.count(F.lit(1)).alias("_size"))
    members = checkpointed(banded.join(buckets.filter("_size > 1"), "_h"))

    stars = members.filter("_node != _least").select(F.col("_least").alias("_a"), F.col("_node").alias("_b"))
    likely = checkpointed(_likely(stars.distinct(), nodes, percent))
    active = members.select("_node").distinct()
    sets = checkpointed(
        whole_sets(docs, nodes.join(active, "_node", "left_semi").select("_node", "_id", "_key"),
                   size, doc_id, text)
    )
    links = checkpointed(_verify(likely, sets, percent))
    roots = connected_components(links)

    placed = members.filter("_size > 2").join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    mixed = placed.groupBy("_h").agg(F.min("_root").alias("_r1"), F.max("_root").alias("_r2"))
    open_members = placed.join(mixed.filter("_r1 != _r2").select("_h"), "_h", "left_semi")
    sketched = checkpointed(open_members.join(nodes.select("_node", "_sketch", "_bands"), "_node"))
    more = checkpointed(_across(sketched, sets, percent))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))

    placed = classes.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    least = placed.groupBy("_root").agg(F.min("_least_id").alias("_component"))
    return rows.select("_id", "_n", "_key", "_row"), placed.join(least, "_root").select("_key", "_component")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """For every row: doc_id, n_shingles, component_id, kept."""
    rows, classes = near_duplicate_classes(docs, size, percent, doc_id, text)
    alone = rows.filter("_key IS NULL").withColumn("_component", F.col("_id"))
    linked = rows.join(classes, "_key")
    both = linked.select("_id", "_n", "_component").unionByName(alone.select("_id", "_n", "_component"))
    return both.select(
        F.col("_id").alias(doc_id), F.col("_n").alias("n_shingles"),
        F.col("_component").alias("component_id"), _stays().alias("kept"),
    )


def _stays() -> Column:
    return F.col("_id").eqNullSafe(F.col("_component"))


def drop_near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each component, the one with the least id; all columns.

    An id with several texts stays if one of them stays.
    """
    decided = near_duplicates(docs.select(doc_id, text), size, percent, doc_id, text)
    decided = checkpointed(decided.select(F.col(doc_id).alias("_id"), "kept"))
    stay = decided.groupBy("_id").agg(F.max("kept").alias("_any"))
    drop = broadcast_if_small(stay.filter("NOT _any").select("_id"), 16)
    return docs.join(drop, docs[doc_id].eqNullSafe(drop["_id"]), "left_anti")


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), size=4, percent=80)
