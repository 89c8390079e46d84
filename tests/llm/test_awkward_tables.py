"""Every operator on a table of awkward rows, and on one without rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caudal.llm import ann, bpe, exact_dedup, hmm, language, minhash, packing, periodic, pii, quality, token_counts, toxicity

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def languages(docs):
    return language.identify(docs, language.fit(docs))


def qualities(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 1), (9, None, None)],
                                               "doc_id long, quality int, toxic int")
    return quality.assess(docs, quality.fit(docs, labels, quality.acceptable()), F.col("source"), F.col("lang"))


def toxicities(docs):
    labels = docs.sparkSession.createDataFrame([(1, 0), (6, 1), (None, 1), (9, None), (6, 1)], "doc_id long, toxic int")
    return toxicity.assess(docs, toxicity.fit(docs, labels))


BY_ROW = {
    "token_counts": lambda d: token_counts.token_counts(d, BYTES),
    "prefix_tables": lambda d: token_counts.prefix_tables(d, BYTES).select("doc_id", F.size("counts").alias("n")),
    "bpe": lambda d: bpe.digests(d, WORDS),
    "bpe_round_trip": lambda d: bpe.decode(bpe.encode(d, WORDS), WORDS),
    "exact": exact_dedup.exact_duplicates,
    "quality": qualities,
    "pii": lambda d: pii.find(d, pii.fit(pii.labelled_windows(d))),
    "language": languages,
    "minhash": lambda d: minhash.near_duplicates(d, 4, 80),
    "periodic": periodic.collapse,
    "toxicity": toxicities,
    "hmm": lambda d: hmm.score(d, F.col("doc_id") != 2),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_one_result_per_row(awkward, name):
    found = BY_ROW[name](awkward).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in awkward.select("doc_id").collect())


@pytest.mark.parametrize("name", BY_ROW)
def test_no_rows(empty, name):
    assert BY_ROW[name](empty).collect() == []


def test_packing(awkward, empty):
    pieces = packing.pack_documents(awkward, BYTES).toPandas()
    assert (pieces["piece"] == 0).sum() == awkward.count() and pieces["length"].max() <= 1024
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]) == ordered["offset"]).all()
    assert ordered.groupby("sequence_id")["length"].sum().max() <= 1024
    assert (pieces[pieces["doc_id"].isin([3, 4])]["length"] == 1).all()
    assert packing.pack_documents(empty, BYTES).collect() == []


@pytest.mark.parametrize("position", range(4))
def test_filtering_stages_keep_columns_and_repeat_nothing(spark, awkward, empty, tmp_path, position):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = corpus_pipeline.STAGES[position][1]
    kept = stage(spark, awkward, str(tmp_path))
    assert kept.columns == awkward.columns and 0 < kept.count() <= awkward.count()
    none = stage(spark, empty, str(tmp_path))
    assert none.columns == empty.columns and none.count() == 0


def test_exact_stage_keeps_one_of_repeated_rows(awkward):
    kept = sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(awkward).filter("doc_id <= 4 OR doc_id = 11").collect())
    assert kept == [(4, ""), (11, "Hello there, general reader of texts.")]
    same = awkward.filter("doc_id = 1")
    assert exact_dedup.drop_exact_duplicates(same).count() == 1
    marks = [r["kept"] for r in exact_dedup.exact_duplicates(same).collect()]
    assert sorted(marks) == [False, True]


def test_vectors(spark):
    nan, schema = float("nan"), "vec_id long, embedding array<float>, _id string, score int"
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]),
            (6, [1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (7, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    found = ann.nearest(df, F.col("_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [
        (0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 7, 0.5), (0, 4, 7, 0.5), (0, 5, 8, -1.0),
        (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 7, 0.5), (20, 4, 7, 0.5), (20, 5, 8, -1.0)]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("_id") % 20 == 0).collect() == []
