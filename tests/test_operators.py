import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from caudal.operators import dedup
from caudal.operators.dedup import content_duplicates, latest_by_key
from caudal.operators.fx import convert_on_date, rates_as_of
from caudal.operators.lookup import band_of, first_covering, require_policy_size
from caudal.operators.quantiles import exact_quantiles
from caudal.operators.ranges import cuts, with_ranges
from caudal.operators.rules import drop_and_count, split_by_rules
from caudal.operators.small import fits_broadcast, join_small, shuffled_join, unique_join


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 30,000 rows under key 0, a third without key."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 500)
    return spark.range(30_000).select(key.alias("k"), F.col("id").alias("v"))


def test_latest_does_not_depend_on_order_and_drops_null_keys(spark, rows):
    data = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), (None, 9, "n"), (None, 8, "m")]
    schema = "k string, t int, v string"
    expected = [("a", 2, "z"), ("b", None, "q")]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        assert rows(latest_by_key(spark.createDataFrame(data, schema), ["k"], ["t"]), "k", "t", "v") == expected


def test_latest_reduces_before_the_shuffle(skewed):
    text = plan(latest_by_key(skewed, ["k"], ["v"]))
    above, below = text.split("Exchange hashpartitioning", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


@pytest.mark.parametrize("most_words", [None, 1])
def test_only_rows_whose_key_may_occur_again_are_ranked(spark, monkeypatch, most_words):
    if most_words:  # too few bits: almost all are set, and rows are ranked needlessly
        monkeypatch.setattr(dedup, "KEY_BITS", 1)
        monkeypatch.setattr(dedup, "MOST_WORDS", most_words)
    one = F.when(F.col("id") % 10 == 0, F.col("id") % 4000).otherwise(F.col("id"))
    df = spark.range(100_000).select(F.when(F.col("id") % 99 != 1, F.concat(F.lit("k"), one)).alias("k"), F.lit(5).alias("g"),
                                     (F.col("id") % 7).alias("t"), (F.col("id") % 3).alias("v"), F.col("id").alias("w"))
    expected, ranked = latest_by_key(df, ["k", "g"], ["t"], wanted=["v"]), []
    monkeypatch.setattr(dedup, "latest_by_key", lambda rows, *by: ranked.append(rows.count()) or latest_by_key(rows, *by))
    found = dedup.latest_by_repeated_key(df, ["k", "g"], ["t"], ["v"])
    assert found.columns == expected.columns and found.count() == expected.count()
    assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0
    assert most_words or ranked[0] < 25_000
    assert dedup.latest_by_repeated_key(df.limit(0), ["k", "g"], ["t"]).count() == 0


def test_latest_leaves_out_what_can_decide_nothing(spark, rows):
    random.seed(4)
    data = [tuple(random.choice([None, 1, 2]) for _ in range(6)) for _ in range(600)]
    df = spark.createDataFrame(data, "k int, a int, t int, b int, c int, d int")
    whole, narrow = latest_by_key(df, ["k"], ["t"]), latest_by_key(df, ["k"], ["t"], wanted=["k", "b"])
    assert narrow.columns == ["k", "a", "t", "b"]
    assert rows(narrow) == rows(whole.select(*narrow.columns))
    assert latest_by_key(df, ["k"], ["t"], wanted=["k"]).columns == ["k", "t"]


def test_content_duplicates_skip_incomplete_keys(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None), (2, 1)], "a int, b int")
    assert rows(content_duplicates(df, ["a", "b"]), "a", "b", "n") == [(1, 1, 2)]


def test_rules_are_three_valued_and_lose_nothing(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, -5), (3, None), (-4, -1)], "id int, x int")
    rules = {"positive": "x > 0", "id_ok": "id > 0"}
    valid, bad = split_by_rules(df, rules, "src")
    assert rows(valid, "id") == [(1,), (3,)]
    assert {r["id"]: r["_failed_dq_rules"] for r in bad.collect()} == {2: ["positive"], -4: ["positive", "id_ok"]}
    assert valid.count() + bad.count() == df.count()
    seen = Observation("dq")
    drop_and_count(df, rules, seen).collect()
    assert seen.get == {"rows": 4, "positive": 2, "id_ok": 1}


def test_fx(spark, rows):
    fx = spark.createDataFrame(
        [("MXN", "USD", date(2026, 1, 1), 0.05), ("MXN", "USD", date(2026, 1, 3), 0.06),
         ("MXN", "EUR", date(2026, 1, 2), 9.0), ("ARS", "USD", date(2026, 1, 2), None)],
        "source_currency string, target_currency string, date date, exchange_rate double")
    found = rates_as_of(fx, F.lit(date(2026, 1, 2)))
    assert rows(found, "currency", "to_usd", "fx_date") == sorted(
        [("MXN", 0.05, date(2026, 1, 1)), ("ARS", None, date(2026, 1, 2)), ("USD", 1.0, None)], key=repr)
    df = spark.createDataFrame(
        [(1, "MXN", 100.0, date(2026, 1, 1)), (2, "MXN", 100.0, date(2026, 5, 1)), (3, "USD", 7.0, date(2026, 1, 1)),
         (4, "MXN", 100.0, date(2026, 1, 2)), (5, "MXN", 100.0, None)], "id int, c string, a double, d date")
    usd = convert_on_date(df, fx, {"a": "usd"}, "c", F.col("d"))
    assert rows(usd, "id", "usd") == [(1, 5.0), (2, 6.0), (3, 7.0), (4, None), (5, 6.0)]


def test_range_lookups(spark, rows):
    ranges = spark.createDataFrame([("L", 24, 100, "a"), ("L", 36, 200, "b"), ("M", 12, 50, "c")],
                                   "g string, term int, up int, tag string")
    df = spark.createDataFrame([(1, "L", 50.0), (2, "L", 150.0), (3, "L", 500.0), (4, "M", 1.0), (5, None, 1.0), (6, "L", None)],
                               "id int, g string, v double")
    found = first_covering(df, ranges, F.col("v"), "up", "term", ["tag"], group="g")
    assert rows(found.select("id", "_match.tag")) == [(1, "a"), (2, "b"), (3, None), (4, "c"), (5, None), (6, None)]
    bands = spark.createDataFrame([(0, "E"), (560, "D"), (740, "A")], "floor int, band string")
    scores = spark.createDataFrame([(559,), (560,), (900,), (None,)], "s int")
    assert rows(band_of(scores, bands, F.col("s"), "floor").select("s", "_band.band"), "s", "band") == sorted(
        [(559, "E"), (560, "D"), (900, "A"), (None, None)], key=repr)
    with pytest.raises(ValueError):
        require_policy_size(spark.range(20), 10)


def test_lookup_neither_shuffles_nor_multiplies_the_large_side(spark):
    ranges = spark.createDataFrame([(24, 100), (36, 200)], "term int, up int")
    text = plan(first_covering(spark.range(1000), ranges, F.col("id"), "up", "term", []))
    assert "Window" not in text and "BroadcastNestedLoopJoin BuildRight, Cross" in text


@pytest.mark.parametrize("how", ["left", "inner"])
def test_shuffled_join_is_a_join(spark, skewed, rows, how):
    small = spark.createDataFrame([(i, f"n{i}") for i in range(0, 400)], "k bigint, name string")
    plain = rows(skewed.join(small, ["k"], how), "k", "v", "name")
    assert rows(shuffled_join(skewed, small, ["k"], how), "k", "v", "name") == plain
    assert rows(join_small(skewed, small, ["k"], how), "k", "v", "name") == plain
    # beyond the limit there is no broadcast
    assert "SortMergeJoin" in join_small(skewed, small, ["k"], how, max_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert not fits_broadcast(small.withColumn("wide", F.repeat(F.lit("x"), 1000)), 100_000) and fits_broadcast(small, 100_000)


def test_unique_join_with_a_frequent_key(spark, skewed, rows):
    right = spark.createDataFrame([(i, f"n{i}") for i in range(0, 400)], "k bigint, name string")
    expected = rows(skewed.join(right, ["k"]), "k", "v", "name")
    assert rows(unique_join(skewed, right, ["k"], hot_rows=100), "k", "v", "name") == expected


def test_ranges_bound_what_one_task_gets(spark, skewed):
    keyed = skewed.filter("k IS NOT NULL")
    points = cuts(keyed, ["k"], "v", hot_rows=500)
    assert points.select("k").collect() == [(0,)]
    sizes = [r["count"] for r in with_ranges(keyed, ["k"], "v", points).filter("_hot").groupBy("_range").count().collect()]
    assert max(sizes) < 2 * 500 and sum(sizes) == keyed.filter("k = 0").count()


@pytest.mark.parametrize("kind", ["string", "date", "timestamp"])
def test_ranges_of_any_order(spark, kind):
    days = spark.range(3000).select(F.lit(1).alias("k"), F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")).cast(kind).alias("v"))
    ranged = with_ranges(days, ["k"], "v", cuts(days, ["k"], "v", hot_rows=300))
    bounds = ranged.groupBy("_range").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).orderBy("_range").collect()
    assert len(bounds) >= 8 and all(x.b < y.a for x, y in zip(bounds, bounds[1:])) and max(r.n for r in bounds) < 600


def test_many_cuts_of_a_large_key(spark):
    """The product of a cut's number and the size of the sample is beyond an int."""
    values = spark.range(140_000, numPartitions=4).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    points = cuts(values, ["k"], "v", hot_rows=4)
    assert points.select(F.size("_cuts")).first()[0] > 30_000
    found = with_ranges(values, ["k"], "v", points).groupBy("_range").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_range").collect()
    edges = points.first()["_cuts"]
    assert [r.b for r in found[:-1]] == edges and all(x.b + 1 == y.a for x, y in zip(found, found[1:]))


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_exact_quantiles(spark, hot_rows):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=2000).round(2), "b": np.array([3.0]), "c": np.repeat([1.0, 2.0], 500)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)], "g string, x double")
    shares = [0.0, 0.123, 0.5, 0.999, 1.0]
    found = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "x", shares, "q", hot_rows).collect()}
    for g, xs in data.items():
        assert found[g] == pytest.approx(list(np.quantile(xs, shares)))
