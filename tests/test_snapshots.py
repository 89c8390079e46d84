import itertools
import random

import pytest
from pyspark.sql import functions as F

from caudal.operators.scd import END, START
from caudal.operators.snapshots import row_hash, snapshot_changes, snapshots_to_history
from caudal.plans.incremental import delivery_of, read_snapshot, read_snapshot_history, run_incremental

SCHEMA = "k int, a string, b int"


def deliveries(seed, n=4):
    rng = random.Random(seed)
    return [{k: (rng.choice(["x", "y", None]), rng.choice([1, None])) for k in range(30) if rng.random() < 0.7} for _ in range(n)]


def frame(spark, state):
    return spark.createDataFrame([(k, *v) for k, v in state.items()], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_between_two_deliveries(spark, seed):
    before, after = deliveries(seed, 2)
    found = {r["k"]: (r["a"], r["b"], r["_change"]) for r in snapshot_changes(frame(spark, before), frame(spark, after), ["k"]).collect()}
    expected = {k: (*v, "insert") for k, v in after.items() if k not in before}
    expected |= {k: (*v, "delete") for k, v in before.items() if k not in after}
    expected |= {k: (*v, "update") for k, v in after.items() if k in before and before[k] != v}
    assert found == expected


def test_nulls_that_move_between_columns_are_a_change(spark):
    df = spark.createDataFrame([("v", None), (None, "v")], "a string, b string")
    assert df.select(row_hash(["a", "b"])).distinct().count() == 2
    before, after = (spark.createDataFrame([(1, *v)], "k int, a string, b string") for v in (("v", None), (None, "v")))
    assert [tuple(r) for r in snapshot_changes(before, after, ["k"]).collect()] == [(1, None, "v", "update")]


def test_repeated_missing_and_new(spark):
    before = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (None, "n", 1), (2, "x", 1)], SCHEMA)
    after = spark.createDataFrame([(1, "y", 1, 5), (None, "m", 1, 1), (3, "z", 1, None)], SCHEMA + ", c int")
    found = sorted(tuple(r) for r in snapshot_changes(before, after, ["k"]).select("k", "a", "c", "_change").collect())
    assert found == [(1, "y", 5, "update"), (2, "x", None, "delete"), (3, "z", None, "insert")]
    assert snapshot_changes(before, before, ["k"]).isEmpty()
    assert {r["_change"] for r in snapshot_changes(None, after, ["k"]).collect()} == {"insert"}
    assert {r["_change"] for r in snapshot_changes(before, before.limit(0), ["k"]).collect()} == {"delete"}


@pytest.mark.parametrize("seed, hot_rows", [(3, 1_000_000), (4, 2)])
def test_history_of_deliveries(spark, seed, hot_rows):
    states = deliveries(seed)
    expected = []
    for k in range(30):
        groups = [(state, [i for i, _ in g]) for state, g in itertools.groupby(enumerate(s.get(k) for s in states), key=lambda t: t[1])]
        for (state, places), following in itertools.zip_longest(groups, groups[1:]):
            if state is not None:
                expected.append((k, *state, places[0], following[1][0] if following else None))
    found = snapshots_to_history([(i, frame(spark, s)) for i, s in enumerate(states)], ["k"], "place", hot_rows)
    assert sorted(map(tuple, found.select("k", "a", "b", START, END).collect()), key=repr) == sorted(expected, key=repr)


def test_delivery_names(spark):
    paths = ["file:/data/in/agents/d1/part-0.csv", "file:/data/in/agents/d2/sub/part-0.csv", "file:/data/in/agents/whole.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for root in ("/data/in/agents", "file:///data/in/agents/", "file:/data/in/agents"):
        assert [r[0] for r in df.select(delivery_of(F.col("p"), root)).collect()] == ["d1", "d2", "whole.csv"]


def test_several_batches_and_late_files(spark, tmp_path):
    """A delivery of three files in batches of one, a file that comes late, and one for a delivery already merged."""
    def deliver(folder, file, agents):
        path = tmp_path / "landing" / "service_agents" / folder
        path.mkdir(parents=True, exist_ok=True)
        (path / file).write_text("agent_id,agent_status\n" + "".join(f"{a},{s}\n" for a, s in agents))

    def run(base, mode):
        run_incremental(spark, str(tmp_path / "landing"), str(tmp_path / base), ["service_agents"],
                        modes={"service_agents": mode}, buckets=2, files_per_batch=1)

    def newest():
        rows = read_snapshot(spark, str(tmp_path / "s"), "service_agents")
        return sorted((r["agent_id"], r["agent_status"]) for r in rows.collect())

    for i in range(3):
        deliver("one", f"{i}.csv", [(f"A{i}", "Active"), (f"B{i}", "Active")])
    run("s", "snapshot"), run("h", "snapshot_history")
    assert len(newest()) == 6
    deliver("two", "0.csv", [("A0", "Closed"), ("A1", "Active")])
    deliver("one", "late.csv", [("C9", "Active")])
    run("s", "snapshot"), run("h", "snapshot_history")
    assert newest() == [("A0", "Closed"), ("A1", "Active")]
    deliver("two", "more.csv", [("A2", "Active")])
    run("s", "snapshot"), run("h", "snapshot_history")
    assert newest() == [("A0", "Closed"), ("A1", "Active"), ("A2", "Active")]
    found = {(r["agent_id"], r[START]): (r["agent_status"], r[END]) for r in read_snapshot_history(spark, str(tmp_path / "h"), "service_agents").collect()}
    assert found == {("A0", 0): ("Active", 1), ("A0", 1): ("Closed", None), ("A1", 0): ("Active", None), ("A2", 0): ("Active", 1),
                     ("B0", 0): ("Active", 1), ("B1", 0): ("Active", 1), ("B2", 0): ("Active", 1)}
    bad = spark.read.parquet(str(tmp_path / "h" / "quarantine" / "service_agents")).select("agent_id", F.concat_ws(",", "_failed_dq_rules"))
    assert sorted(map(tuple, bad.collect())) == [("A2", "late_delivery"), ("C9", "late_delivery")]
