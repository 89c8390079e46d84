import re
import uuid

import pytest
from pyspark.sql import functions as F

from caudal.plans.policy import policy_tables, resolve_policy
from caudal.plans.profile import credit_profile
from caudal.sinks.bucketed import FrequentKey, bucketed_inputs, save_bucketed
from testbed.queries import gold_inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_small_sides(spark):
    """Sides are broadcast only where a plan says so."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def exchanges(df, column):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"Exchange hashpartitioning\({column}#", plan))


def test_the_profile_of_bucketed_tables_shuffles_by_no_customer(spark, no_small_sides):
    tables, policy = gold_inputs(spark, SF), resolve_policy(policy_tables(spark))
    plain = credit_profile(tables, policy)
    stored = credit_profile(bucketed_inputs(spark, tables, "customer_id", 4, f"b{uuid.uuid4().hex}"), policy)
    assert exchanges(plain, "customer_id") >= 4 and exchanges(stored, "customer_id") == 0
    drop = lambda df: sorted(map(tuple, df.drop("computed_at").collect()), key=repr)
    assert drop(stored) == drop(plain)


def test_a_frequent_key_is_refused_or_left_alone(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 3 * F.col("id")).alias("k"), "id")
    with pytest.raises(FrequentKey, match="0 has more than 99"):
        save_bucketed(df, f"t{uuid.uuid4().hex}", "k", 2, str(tmp_path / "t"), hot_rows=99)
    kept = bucketed_inputs(spark, {"a": df, "b": df.filter("k > 0"), "c": spark.range(3)}, "k", 2, f"u{uuid.uuid4().hex}", hot_rows=99)
    assert kept["a"] is df and "Bucketed: true" in kept["b"].groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert kept["b"].count() == df.filter("k > 0").count() and kept["c"].count() == 3


def test_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def same(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).withColumnRenamed("id", "c").mapInArrow(same, "c bigint")
    assert save_bucketed(df, "once", "c", 2).count() == 1000 and seen.value == 1000
    spark.sql("DROP TABLE once")
