"""Replacing partitions, clustering by several columns, sketches."""

import datetime
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caudal.operators import sketches
from caudal.operators.zorder import quantile_cuts, rank_among, rebuild_zordered, with_zorder
from caudal.sinks import partitions
from caudal.sinks.partitions import PartitionMismatch, forget, read_partitions, replace_partitions
from caudal.sinks.tables import rebuild

DAYS = [datetime.date(2024, 1, d) for d in range(1, 5)]


def days(spark, *rows):
    return spark.createDataFrame(rows, "k int, day date, v string")


def content(df):
    return sorted(((r["k"], str(r["day"]), r["v"]) for r in df.collect()), key=repr)


def test_only_the_partitions_of_a_run_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_partitions(spark, path) is None
    replace_partitions(days(spark, (1, DAYS[0], "a"), (2, DAYS[1], "a"), (3, DAYS[2], "a"), (9, None, "a")), path, "day")
    before = {p for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    replace_partitions(days(spark, (4, DAYS[1], "b"), (5, DAYS[3], "b"), (8, None, "b")), path, "day", covers=[DAYS[2]])
    assert before <= {p for p in (tmp_path / "t" / "data").rglob("*.parquet")}  # nothing is touched in place
    now = [(1, str(DAYS[0]), "a"), (4, str(DAYS[1]), "b"), (5, str(DAYS[3]), "b"), (8, "None", "b")]
    assert content(read_partitions(spark, path)) == now
    assert content(read_partitions(spark, path, as_of=0)) == [(1, str(DAYS[0]), "a"), (2, str(DAYS[1]), "a"), (3, str(DAYS[2]), "a"), (9, "None", "a")]
    plan = read_partitions(spark, path).filter(F.col("day") == DAYS[1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert forget(spark, path) == 3 and content(read_partitions(spark, path)) == now


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    replace_partitions(days(spark, (1, DAYS[0], "a"), (2, DAYS[1], "a")), path, "day")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(partitions, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            replace_partitions(days(spark, (7, DAYS[0], "lost"), (7, DAYS[3], "lost")), path, "day")
    assert content(read_partitions(spark, path)) == [(1, str(DAYS[0]), "a"), (2, str(DAYS[1]), "a")]
    assert replace_partitions(days(spark, (3, DAYS[1], "b")), path, "day") == 1  # over the leftovers
    assert content(read_partitions(spark, path)) == [(1, str(DAYS[0]), "a"), (3, str(DAYS[1]), "b")]


def test_odd_values_and_refusals(spark, tmp_path):
    path = str(tmp_path / "t")
    odd = ["a b", "x/y", "50%", "c=d", "e+f", "é", "2024-01-01 00:00:00", "007"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(odd)], "k int, p string")
    replace_partitions(df, path, "p")
    replace_partitions(df.filter("k IN (1, 4)").withColumn("k", -F.col("k")), path, "p", covers=["50%", "never"])
    found = {r["p"]: r["k"] for r in read_partitions(spark, path).collect()}
    assert found == {p: -i if i in (1, 4) else i for i, p in enumerate(odd) if p != "50%"}
    with pytest.raises(PartitionMismatch):
        replace_partitions(df, path, "k")
    with pytest.raises(PartitionMismatch):
        replace_partitions(df.withColumn("more", F.lit(1)), path, "p")
    replace_partitions(df.limit(0), path, "p", covers=odd)
    assert read_partitions(spark, path).isEmpty()


def test_ranks_are_counts_of_cuts(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 0.0, 0.0, rng.gauss(0, 9)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for parts in (2, 16, 17, 64):
        cuts = quantile_cuts(df, "v", parts)
        assert cuts == sorted(set(cuts)) and len(cuts) < parts
        for r in df.select("v", rank_among(F.col("v"), cuts).alias("n")).collect():
            assert r["n"] == (0 if r["v"] is None else sum(c <= r["v"] for c in cuts))
    assert quantile_cuts(df.limit(0), "v", 8) == []


def test_bits_are_interleaved(spark):
    df = spark.range(64).selectExpr("id % 8 AS a", "id div 8 AS b")
    keys = {(r["a"], r["b"]): r["_z"] for r in with_zorder(df, ["a", "b"], bits=3).collect()}
    assert sorted(keys.values()) == list(range(64))
    assert all(z == sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(3)) for (a, b), z in keys.items())
    with pytest.raises(ValueError):
        with_zorder(df, ["a"] * 8, bits=8)


def shares_of_files(folder, column, values):
    """The share of files whose statistics do not rule a value out, on average."""
    bounds = []
    for p in folder.rglob("*.parquet"):
        meta = pq.ParquetFile(p).metadata
        at = [c.path_in_schema for c in map(meta.row_group(0).column, range(meta.num_columns))].index(column)
        own = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        bounds.append((min(s.min for s in own), max(s.max for s in own)))
    return sum(low <= v <= high for v in values for low, high in bounds) / len(values) / len(bounds)


def test_files_are_skipped_by_either_column(spark, tmp_path):
    df = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("a"), F.concat(F.lit("s"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9_000)) + 1000).alias("b"))
    rebuild_zordered(df, str(tmp_path / "z"), ["a", "b"], files=16)
    df.repartitionByRange(16, "a").sortWithinPartitions("a").write.parquet(str(tmp_path / "a"))
    numbers, texts = range(500, 9500, 900), [f"s{n}" for n in range(1500, 9500, 900)]
    assert shares_of_files(tmp_path / "z", "a", numbers) < 0.45 and shares_of_files(tmp_path / "z", "b", texts) < 0.45
    assert shares_of_files(tmp_path / "a", "b", texts) > 0.9  # which sorting by one column does not give
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "z")).collect())) == sorted(map(tuple, df.collect()))


def test_sketches_merge_over_days_within_the_stated_error(spark):
    values = spark.range(200_000).select((F.col("id") % 20).alias("day"), (F.col("id") % 2).alias("g"), F.pow(F.rand(3), 6).alias("v"))
    data = values.toPandas()
    df = spark.createDataFrame(data).repartition(8)
    daily = sketches.sketch(df.unionByName(df.limit(5).withColumn("v", F.lit(None).cast("double"))), ["g", "day"], "v")
    merged = sketches.merge(daily, ["g"])
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for r in merged.select("g", "_rows", sketches.quantiles(shares).alias("q")).collect():
        own = data[data["g"] == r["g"]]["v"]
        assert r["_rows"] == len(own) and r["q"][0] == own.min() and r["q"][-1] == own.max()
        for share, q in zip(shares, r["q"]):
            assert abs((own <= q).mean() - share) <= sketches.rank_error() + 1 / len(own)
    half = merged.select(sketches.rank_of(F.lit(0.5**6)).alias("r")).collect()
    assert all(abs(r["r"] - 0.5) < 0.02 for r in half)


def test_large_tables_are_not_shuffled_to_be_read(spark, tmp_path, monkeypatch):
    from testbed import recast
    spark.range(1000).withColumnRenamed("id", "l_orderkey").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = lambda: recast._table(spark, str(tmp_path), "lineitem")._jdf.queryExecution().toString()
    assert "Exchange" in plan()
    monkeypatch.setattr(recast, "SPREAD_ROWS", 999)
    assert "Exchange" not in plan()


def test_files_by_date_do_not_grow_with_the_table(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 8).selectExpr(
        "id", "date_add(date '2024-01-01', int(id % 40)) AS day", "sha2(string(id), 256) AS v")
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    kept = spark.conf.get(advisory)
    spark.conf.set(advisory, "200k")  # a date is 80 kB, a quarter of the table 800 kB
    try:
        rebuild(rows, str(tmp_path / "t"), "day")
    finally:
        spark.conf.set(advisory, kept)
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert len({f.parent for f in files}) == 40 and len(files) <= 44
    assert spark.read.parquet(str(tmp_path / "t")).distinct().count() == 40_000
