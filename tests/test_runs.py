"""A whole run on files, a policy refresh, and queries against their SQL."""

import pytest
from pyspark.sql import functions as F

from caudal.contracts import ENTITIES
from caudal.plans.medallion import refresh_policy, run_medallion
from caudal.plans.policy import policy_tables
from caudal.quality.gate import QualityGateError
from caudal.sinks.publish import read_export
from testbed import recast
from testbed.compare import connect, difference

SF = "/root/testdata/sf0.001"
QUICK = ["silver_branches", "dq_quarantine", "scd2_untracked", "fx_as_of", "range_first_match", "case_context"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    assert difference(spark, connect(SF), name, SF) == ""


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    """First deliveries of all ten sources as CSV files."""
    folder = str(tmp_path_factory.mktemp("landing"))
    for name, spec in ENTITIES.items():
        raw = recast.raw(spark, SF, f"raw_{name}").filter("_bronze_ingested_at < '2026-07-02'")
        raw = raw.dropDuplicates(list(spec.key)).select(*spec.names)
        if name == "transactions":  # fewer date folders to write
            raw = raw.filter("process_date >= '2026-03-01'")
        raw.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return folder


def test_run_and_refresh(spark, landing, tmp_path):
    base, tables = str(tmp_path), policy_tables(spark)
    manifest = run_medallion(spark, landing, base, tables, run_id="r1")
    customers = spark.read.parquet(f"{base}/silver/customers").count()
    assert manifest["rows"]["customer_credit_offer_options"] == 12 * customers and manifest["as_of_date"] == "2026-06-30"
    metrics = spark.read.parquet(f"{base}/gold/pipeline_quality_metrics")
    assert metrics.filter("layer <> 'gold'").count() == 79 and metrics.filter("layer = 'gold'").count() == 16
    again = refresh_policy(spark, base, tables, "2026-05-31", "r2")
    assert again["as_of_date"] == "2026-05-31" and again["rows"] == manifest["rows"]
    assert read_export(spark, f"{base}/exports", "customer_credit_profile").agg(F.max("as_of_date").cast("string")).first()[0] == "2026-05-31"
    metrics = spark.read.parquet(f"{base}/gold/pipeline_quality_metrics")
    assert metrics.filter("run_id = 'r2'").count() == 14


def test_a_broken_source_stops_the_run(spark, landing, tmp_path):
    from caudal.plans.medallion import build_silver, load_bronze
    bronze = load_bronze(spark, landing, str(tmp_path), ["customers"])
    nobody = {"customers": bronze["customers"].withColumn("credit_score", F.lit(None).cast("string"))}
    with pytest.raises(QualityGateError, match="null_share_credit_score"):
        build_silver(spark, nobody, str(tmp_path), "bad")


def test_metrics_of_a_run_come_from_its_writes(spark, landing, tmp_path, monkeypatch):
    """Counts taken while writing are those of tables scanned afterwards, and no plan reads a raw table for them."""
    from caudal.plans import medallion
    from caudal.quality.metrics import source_metrics
    names, counts, plans = ["products", "service_agents"], {}, []
    monkeypatch.setattr(medallion, "record_and_gate", lambda spark, metrics, *_: plans.append(metrics))
    bronze = medallion.load_bronze(spark, landing, str(tmp_path), names, counts=counts)
    clean = medallion.build_silver(spark, bronze, str(tmp_path), "r", counts)
    scanned = sorted(map(tuple, source_metrics(bronze, clean).collect()))
    assert sorted(map(tuple, plans[0].collect())) == scanned
    plan = plans[0].select("*")._jdf.queryExecution().executedPlan().toString()
    assert "/bronze/" not in plan
    # the key columns of each table, and its content key if it has one
    assert plan.count("FileScan") == sum(1 + bool(ENTITIES[n].content_key) for n in names)
