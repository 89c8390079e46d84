import itertools
import random
import shutil

import pytest
from pyspark.sql import functions as F

from caudal.operators.scd import END, START, scd1, scd2
from caudal.streaming import history
from caudal.streaming.history import BucketMismatch, compact, merge_costs, merge_stream, read_history, scd_merge
from caudal.streaming.keyfilter import key_filters, may_hold

SCHEMA = "k int, seq int, state string, note string"


def changes(seed: int, n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    # key 0 has more than a third of the rows; sequences repeat, states stay the same for a while
    return [(0 if rng.random() < 0.4 else rng.randrange(1, 12), rng.randrange(0, 150),
             rng.choice(["a", "b", None]), f"n{i}") for i in range(n)]


def by_hand(data) -> list[tuple]:
    """(key, state, note, start, end) of every version, row by row."""
    def smallest_null(row):
        return tuple((v is not None, v or "") for v in row[2:])

    unique = {}
    for row in data:
        at = row[:2]
        if at not in unique or smallest_null(row) > smallest_null(unique[at]):
            unique[at] = row
    out = []
    for key, group in itertools.groupby(sorted(unique.values(), key=lambda r: r[:2]), key=lambda r: r[0]):
        versions = []
        for _, seq, state, note in group:
            if versions and versions[-1][1] == state:
                versions[-1][2] = note
            else:
                if versions:
                    versions[-1][4] = seq
                versions.append([key, state, note, seq, None])
        out += map(tuple, versions)
    return sorted(out, key=repr)


def versions(df):
    return sorted((tuple(r) for r in df.select("k", "state", "note", START, END).collect()), key=repr)


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_brute_force(spark, seed, hot_rows):
    data = changes(seed)
    df = spark.createDataFrame(data, SCHEMA)
    assert versions(scd2(df, ["k"], "seq", ["state"], ["note"], hot_rows)) == by_hand(data)


def test_large_keys_whose_state_rarely_changes(spark):
    # whole ranges without any change, so versions span several of them
    data = [(0, i, "a" if i < 700 else "b", f"n{i}") for i in range(1000)] + [(1, 1, "x", "y")]
    df = spark.createDataFrame(data, SCHEMA)
    assert versions(scd2(df, ["k"], "seq", ["state"], ["note"], hot_rows=5)) == by_hand(data)


def test_intervals_do_not_overlap_and_one_is_open(spark):
    df = scd2(spark.createDataFrame(changes(3), SCHEMA), ["k"], "seq", ["state"], ["note"])
    found = versions(df)
    for _, group in itertools.groupby(sorted(found, key=lambda r: (r[0], r[3])), key=lambda r: r[0]):
        group = list(group)
        assert [r[4] for r in group] == [r[3] for r in group[1:]] + [None]


def test_rows_without_key_or_sequence_take_no_part(spark):
    df = spark.createDataFrame([(None, 1, "a", "n"), (1, None, "a", "n"), (1, 2, "b", "n")], SCHEMA)
    assert versions(scd2(df, ["k"], "seq", ["state"])) == [(1, "b", "n", 2, None)]
    assert scd1(df, ["k"], "seq").count() == 1


@pytest.mark.parametrize("seed", [4, 5])
def test_batches_in_any_order_equal_one_batch(spark, tmp_path, seed):
    data = changes(seed, 150)
    target = str(tmp_path / "t")
    merge = dict(keys=["k"], sequence="seq", tracked=["state"], untracked=["note"], buckets=4)
    for i, part in enumerate((data[:60], data[60:65], data[65:])):
        scd_merge(spark.createDataFrame(part, SCHEMA), i, target, **merge)
        scd_merge(spark.createDataFrame(part, SCHEMA), i, target, **merge)  # a repeated batch changes nothing
    assert versions(read_history(spark, target)) == by_hand(data)


def test_a_batch_that_failed_before_its_commit_is_redone(spark, tmp_path):
    target = str(tmp_path / "t")
    merge = dict(keys=["k"], sequence="seq", tracked=["state"], untracked=["note"], buckets=4)
    data = changes(6, 80)
    scd_merge(spark.createDataFrame(data[:40], SCHEMA), 0, target, **merge)
    # leftovers of a lost attempt: files of batch 1, no commit
    wrong = spark.createDataFrame([(0, 1, "zzz", "lost", 1, None, 0)], "k int, seq int, state string, note string, "
                                  f"`{START}` int, `{END}` int, bucket int")
    wrong.write.partitionBy("bucket").parquet(f"{target}/history/batch=1")
    assert versions(read_history(spark, target)) == by_hand(data[:40])
    scd_merge(spark.createDataFrame(data[40:], SCHEMA), 1, target, **merge)
    assert versions(read_history(spark, target)) == by_hand(data)


def test_stream_of_type_1(spark, tmp_path, rows):
    data = changes(7, 100)
    df = spark.createDataFrame(data, SCHEMA)
    df.repartition(4, "note").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), keys=["k"], sequence="seq", scd_type=1, buckets=4)
    got = read_history(spark, str(tmp_path / "t"))
    assert rows(got, "k", "seq", "state", "note") == rows(scd1(df, ["k"], "seq"), "k", "seq", "state", "note")


def test_columns_that_appear_later_are_kept(spark, tmp_path):
    target, merge = str(tmp_path / "t"), dict(keys=["k"], sequence="seq", untracked=["note"], buckets=2)
    scd_merge(spark.createDataFrame([(1, 1, "a", "n"), (2, 1, "a", "n")], SCHEMA), 0, target, **merge)
    scd_merge(spark.createDataFrame([(1, 2, "a", "n", "x")], SCHEMA + ", extra string"), 1, target, **merge)
    scd_merge(spark.createDataFrame([(2, 3, "b", "n")], SCHEMA), 2, target, **merge)
    found = {(r["k"], r[START]): (r["state"], r["extra"], r[END]) for r in read_history(spark, target).collect()}
    assert found == {(1, 1): ("a", None, 2), (1, 2): ("a", "x", None), (2, 1): ("a", None, 3), (2, 3): ("b", None, None)}


def test_another_bucket_count_is_refused(spark, tmp_path):
    target, data = str(tmp_path / "t"), spark.createDataFrame(changes(9, 30), SCHEMA)
    scd_merge(data, 0, target, keys=["k"], sequence="seq", buckets=4)
    with pytest.raises(BucketMismatch):
        scd_merge(data, 1, target, keys=["k"], sequence="seq", buckets=8)


def test_few_files_and_compaction(spark, tmp_path):
    data = changes(10, 200)
    target, merge = str(tmp_path / "t"), dict(keys=["k"], sequence="seq", tracked=["state"], untracked=["note"], buckets=4)
    for i in range(3):
        scd_merge(spark.createDataFrame(data[i * 50 : i * 50 + 50], SCHEMA).repartition(8), i, target, **merge)
    assert len(list((tmp_path / "t" / "log").rglob("*.parquet"))) <= 3 * 4 * 2
    compact(spark, target, str(tmp_path / "u"))
    assert versions(read_history(spark, str(tmp_path / "u"))) == by_hand(data[:150])
    scd_merge(spark.createDataFrame(data[150:], SCHEMA), 3, str(tmp_path / "u"), **merge)
    assert versions(read_history(spark, str(tmp_path / "u"))) == by_hand(data)


def test_a_text_sequence_of_a_large_key(spark):
    data = [(k, f"{i:05d}" if k else f"v{i:04d}", "ab"[i // 7 % 2], f"n{i}") for k in (0, 1) for i in range(100)]
    df = spark.createDataFrame(data, "k int, seq string, state string, note string")
    assert versions(scd2(df, ["k"], "seq", ["state"], ["note"], hot_rows=10)) == by_hand(data)


def test_key_filters_deny_no_key_they_hold(spark):
    rows = spark.range(20_000).selectExpr("id AS k", "concat('s', id) AS j", "CAST(id % 3 AS int) AS bucket")
    filters = key_filters(rows, ["k", "j"], "bucket").withColumn("batch", F.lit(1))
    assert filters.filter("_words = 3").count() == 9
    for few in (rows.filter("k IN (17, 18, 19)"), rows.filter("k >= 19997")):
        assert may_hold(filters, few, ["k", "j"], "bucket", ["batch", "bucket"]).count() == 3
    outside = spark.range(5000, 9000).selectExpr("id AS k", "concat('x', id) AS j", "0 AS bucket")  # in range, not held
    passed = sum(not may_hold(filters, outside.filter(F.col("k") == k), ["k", "j"], "bucket", ["bucket"]).isEmpty() for k in range(5000, 5012))
    assert passed <= 1
    beyond = spark.createDataFrame([(50_000, "s50000", 0)], "k long, j string, bucket int")
    assert may_hold(filters, beyond, ["k", "j"], "bucket", ["bucket"]).isEmpty()


def spread(n: int, batches: int) -> list[list[tuple]]:
    """Deliveries whose keys move on: key i changes in delivery i // 20 and the next one, a few come at the end."""
    parts = [[] for _ in range(batches)]
    for k in range(n):
        home = min(k * batches // n, batches - 2)
        late = batches - 1 if k % 40 == 0 else home
        parts[late].append((k, 10 * home, "ab"[k % 2], f"n{k}"))
        parts[home + 1].append((k, 10 * home + 5, "bc"[k % 2], f"m{k}"))
    return parts


def files_of(folder):
    return {p.parent.parent.name + "/" + p.parent.name for p in folder.rglob("*.parquet")}


def test_a_key_is_tested_against_one_bitmap_of_each_filter(spark):
    rows = spark.range(40_000).select(F.col("id").alias("k"), F.lit(0).alias("bucket"))
    filters = key_filters(rows, ["k"], "bucket").withColumn("batch", F.lit(1))
    assert filters.count() > 10  # bitmaps of one filter
    found = may_hold(filters, rows, ["k"], "bucket", ["batch", "bucket"])
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]  # those that make the filters included
    assert any(line.count("_word#") == 2 for line in joins)
    assert found.count() == 1


def test_a_merge_reads_only_logs_that_may_hold_its_keys(spark, tmp_path, monkeypatch):
    """Twenty deliveries with late rows: the history of one batch, and less than half of the earlier logs read."""
    target, parts = str(tmp_path / "t"), spread(400, 20)
    opened, plain = [], history._read_folders

    def watched(session, where, folders, schema):
        opened.append([f for f in folders if f.startswith("log/") and "/bucket=" in f])
        return plain(session, where, folders, schema)

    monkeypatch.setattr(history, "_read_folders", watched)
    merge = dict(keys=["k"], sequence="seq", tracked=["state"], untracked=["note"], buckets=4)
    for i, part in enumerate(parts):
        scd_merge(spark.createDataFrame(part, SCHEMA), i, target, **merge)
    assert versions(read_history(spark, target)) == by_hand([r for part in parts for r in part])
    costs = {r["batch"]: (r["logs_seen"], r["logs_read"]) for r in merge_costs(spark, target).collect()}
    seen, read = (sum(c[i] for c in costs.values()) for i in (0, 1))
    own = sum(len(files_of(tmp_path / "t" / "log" / f"batch={i}")) for i in range(20))
    assert read < seen / 2 and read + own == sum(map(len, opened))
    assert costs[19][1] > costs[10][1]  # the late rows of many deliveries need theirs


def test_logs_without_filters_are_read(spark, tmp_path):
    target, data = str(tmp_path / "t"), changes(11, 120)
    merge = dict(keys=["k"], sequence="seq", tracked=["state"], untracked=["note"], buckets=2)
    scd_merge(spark.createDataFrame(data[:60], SCHEMA), 0, target, **merge)
    shutil.rmtree(f"{target}/filters")  # as a table of an earlier version has none
    for i, part in enumerate((data[60:90], data[90:]), 1):
        scd_merge(spark.createDataFrame(part, SCHEMA), i, target, **merge)
    assert versions(read_history(spark, target)) == by_hand(data)


def test_filters_of_an_uncommitted_batch_are_not_believed(spark, tmp_path):
    target, data = str(tmp_path / "t"), changes(12, 90)
    merge = dict(keys=["k"], sequence="seq", tracked=["state"], untracked=["note"], buckets=2)
    scd_merge(spark.createDataFrame(data[:30], SCHEMA), 0, target, **merge)
    shutil.copytree(f"{target}/log/batch=0", f"{target}/log/batch=1")
    shutil.copytree(f"{target}/filters/batch=0", f"{target}/filters/batch=1")
    scd_merge(spark.createDataFrame(data[30:], SCHEMA), 2, target, **merge)
    assert versions(read_history(spark, target)) == by_hand(data)
    assert merge_costs(spark, target).filter("batch = 2 AND logs_seen > 2").isEmpty()
