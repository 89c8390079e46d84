"""Further registered queries: incremental loads, streams by column name, tables written and read back."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from caudal.contracts import AUDIT_COLUMNS, ENTITIES
from caudal.operators.asof import convert_as_of
from caudal.operators.cleanse import declared_type, ensure_columns, flags_to_boolean
from caudal.operators.intervals import first_covering_range, interval_join
from caudal.operators.rules import drop_and_count
from caudal.operators.scd import scd2
from caudal.operators import sketches
from caudal.operators.snapshots import snapshot_changes, snapshots_to_history
from caudal.operators.zorder import rebuild_zordered
from caudal.plans import policy as pol
from caudal.plans import summaries
from caudal.plans.incremental import read_snapshot, read_snapshot_history, run_incremental
from caudal.plans.medallion import build_silver, build_summaries, refresh_policy
from caudal.plans.offers import CARRY, accepted_offers, undeclared
from caudal.plans.options import offer_options
from caudal.plans.profile import credit_profile
from caudal.plans.silver import silver
from caudal.quality.contract import contract_columns, contract_metrics, contract_violations
from caudal.quality.metrics import case_metrics, raw_counts
from caudal.quality.gate import QualityGateError, record_and_gate
from caudal.session import checkpointed, scratch_path
from caudal.sinks.bucketed import bucketed_inputs
from caudal.sinks.constrained import validated_append
from caudal.sinks.partitions import read_partitions, replace_partitions
from caudal.sinks.publish import read_export, read_manifest
from caudal.sinks.tables import rebuild
from caudal.sources.avro import register_avro
from caudal.sources.files import read_files, read_strings
from caudal.streaming.history import read_history, scd_merge
from caudal.streaming.ingest import stream_strings
from caudal.streaming.stateful import read_versions, versions_stream
from testbed.oracle import big, query, rnd
from testbed.queries import (
    _EVENTS_SQL, _METRICS_SQL, _ORDER_COLUMNS, _RULES, _VERSIONS, _event_changes, _source_metrics, _stamped,
    _versions, ORACLE, bronze, case, clean, gold_inputs, policy_of, profile_of, show, stored_inputs, table,
)

# --- files by column name, on streams ----------------------------------------

_LAYOUTS = {
    "F": ["o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"],
    "O": _ORDER_COLUMNS,
    "P": ["o_comment", "o_orderdate", "o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice"],
}


def _streamed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in three layouts, one of them delivered after the first run."""
    base = scratch_path(spark, "by-name")
    orders = table(spark, sf, "orders").withColumns({
        "o_comment": F.concat(F.lit('say "hi",\nline '), F.col("o_orderkey")),
        "o_orderdate": F.to_date("o_orderdate"),
    })
    for delivery in ("OF", "P"):
        for status in delivery:
            (orders.filter(F.col("o_orderstatus") == status).select(*_LAYOUTS[status])
             .write.option("header", True).option("escape", '"').csv(f"{base}/in/{status}"))
        stream_strings(spark, f"{base}/in", _ORDER_COLUMNS,
                       lambda rows, i: rows.write.mode("overwrite").parquet(f"{base}/out/batch={i}"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@case("stream_csv_by_name", ORACLE["csv_by_name"])
def _(spark, sf):
    return _streamed_orders(spark, sf).select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_comment")


@case("stream_rescued", ORACLE["rescued_rows"])
def _(spark, sf):
    part = F.get_json_object
    return _streamed_orders(spark, sf).filter("_rescued_data IS NOT NULL").select(
        "o_orderkey", part("_rescued_data", "$.o_orderpriority").alias("rescued_priority"),
        part("_rescued_data", "$.o_orderdate").alias("rescued_date"),
        part("_rescued_data", "$._file_path").isNotNull().alias("has_file"))


@case("csv_repeated_headers", """
    SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name AS first_value, CAST(s_nationkey AS VARCHAR) AS second_value,
      s_nationkey < 10 AS is_unnamed FROM supplier""")
def _(spark, sf):
    path = scratch_path(spark, "headers")
    rows = table(spark, sf, "supplier").select(
        F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey").alias("value"), (F.col("s_nationkey") < 10).alias("unnamed"))
    for unnamed, header in ((True, "s_suppkey,,"), (False, "s_suppkey,x,x")):
        lines = rows.filter(F.col("unnamed") == unnamed).select(F.lit(1).alias("_at"), "value")
        head = spark.createDataFrame([(0, header)], "_at int, value string")
        head.unionByName(lines).coalesce(1).sortWithinPartitions("_at").select("value").write.mode("append").text(path)
    found = read_strings(spark, path, ["s_suppkey"], multiline=False)
    values = F.from_json("_rescued_data", "map<string,string>")
    first, second = ("#2", "x#2"), ("#3", "x#3")
    return found.select(
        "s_suppkey", F.coalesce(*[values[k] for k in first]).alias("first_value"),
        F.coalesce(*[values[k] for k in second]).alias("second_value"), values["#2"].isNotNull().alias("is_unnamed"))


# --- the incremental path -----------------------------------------------------

_PRODUCT_STATE = [c for c in ENTITIES["products"].names if c not in ("product_id", "last_updated")]
_PRODUCT_CHANGES = f"""
    (SELECT * FROM typed_products WHERE last_updated IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id, last_updated
      ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in _PRODUCT_STATE)}) = 1)"""


def _delivered_products(spark: SparkSession, sf: str, rules=None) -> str:
    """Raw products in three deliveries over two runs, each with its own column order."""
    base = scratch_path(spark, "incremental")
    names = list(ENTITIES["products"].names)
    raw = bronze(spark, sf, "products").select(*names).withColumn(
        "_part", F.pmod(F.xxhash64("product_id", "last_updated"), F.lit(3)))
    layouts = [names, names[::-1], [*names[5:], *names[:5], "loyalty"]]
    for part, layout in enumerate(layouts):
        rows = raw.filter(F.col("_part") == part).withColumn("loyalty", F.lit("7")).select(*layout)
        rows.write.option("header", True).option("escape", '"').csv(f"{base}/landing/products/{part}")
        if part:
            run_incremental(spark, f"{base}/landing", base, ["products"], {"products": rules or {}}, buckets=4)
    return base


@case("incremental_history", query(
    "SELECT * EXCLUDE (one) FROM (" + _VERSIONS.format(
        keys="product_id", seq="last_updated", src=_PRODUCT_CHANGES, tracked=", ".join(_PRODUCT_STATE),
        state="row(" + ", ".join(_PRODUCT_STATE) + ")", last="one", lasts="1 AS one") + ")"))
def _(spark, sf):
    history = read_history(spark, f"{_delivered_products(spark, sf)}/history/products")
    return history.select("product_id", *_PRODUCT_STATE, "__START_AT", "__END_AT")


@case("incremental_quarantine", query("""
    SELECT product_id, last_updated, _failed_dq_rules FROM (SELECT product_id, last_updated,
        concat_ws(',', CASE WHEN credit_limit <= 20000 THEN 'limit' END, CASE WHEN days_past_due > 30 THEN 'late' END,
          CASE WHEN currency = 'COP' THEN 'no_cop' END) AS _failed_dq_rules FROM typed_products) WHERE _failed_dq_rules <> ''
    UNION ALL SELECT NULL, TRY_CAST(last_updated AS DATE), concat_ws(',', 'product_id_missing',
      CASE WHEN CAST(credit_limit AS DOUBLE) <= 20000 THEN 'limit' END, CASE WHEN CAST(days_past_due AS DOUBLE) > 30 THEN 'late' END,
      CASE WHEN currency = 'COP' THEN 'no_cop' END) FROM raw_products WHERE product_id IS NULL"""))
def _(spark, sf):
    base = _delivered_products(spark, sf, _RULES)
    bad = spark.read.parquet(f"{base}/quarantine/products")
    return show(bad.select("product_id", "last_updated", "_failed_dq_rules"))


@case("incremental_snapshot", query("""
    SELECT * EXCLUDE (_bronze_ingested_at) FROM typed_service_agents WHERE agent_status = 'Active'"""))
def _(spark, sf):
    """A whole delivery replaces the one before it."""
    base, names = scratch_path(spark, "snapshot"), list(ENTITIES["service_agents"].names)
    agents = bronze(spark, sf, "service_agents").select(*names)
    for run, (rows, layout) in enumerate(((agents, names), (agents.filter("agent_status = 'Active'"), names[::-1]))):
        rows.select(*layout).write.option("header", True).option("escape", '"').csv(f"{base}/landing/service_agents/{run}")
        run_incremental(spark, f"{base}/landing", base, ["service_agents"], modes={"service_agents": "snapshot"})
    return read_snapshot(spark, base, "service_agents").select(*names)


# --- history -----------------------------------------------------------------

@case("scd2_string_sequence", _EVENTS_SQL)
def _(spark, sf):
    """Large keys whose order column is text."""
    changes = _event_changes(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return scd2(changes, ["user_id"], "ts", ["event_type"], ["event_id", "value"], hot_rows=10).drop("ts")


@case("scd2_stream_new_column", _stamped(_versions(
    "(SELECT * REPLACE (CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value) FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)",
    "user_id", "ts", "event_type", ["event_id", "value"])))
def _(spark, sf):
    """The first delivery lacks a column that a later one brings."""
    target = scratch_path(spark, "widening")
    changes = _event_changes(spark, sf)
    merge = dict(keys=["user_id"], sequence="ts", tracked=["event_type"], untracked=["event_id", "value"], buckets=8)
    scd_merge(changes.filter("event_type = 'error'").drop("value"), 0, target, **merge)
    scd_merge(changes.filter("event_type <> 'error'"), 1, target, **merge)
    return show(read_history(spark, target).drop("ts", "bucket"))


@case("scd2_stream_late", _EVENTS_SQL)
def _(spark, sf):
    """The newest changes come first, the oldest last."""
    target, changes = scratch_path(spark, "late"), _event_changes(spark, sf)
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    middle = changes.agg(F.avg(at)).scalar()
    merge = dict(keys=["user_id"], sequence="ts", tracked=["event_type"], untracked=["event_id", "value"], buckets=8)
    scd_merge(changes.filter(at >= middle), 0, target, **merge)
    scd_merge(changes.filter(at < middle), 1, target, **merge)
    return show(read_history(spark, target).drop("ts", "bucket"))


# --- credit ------------------------------------------------------------------

@case("cashflow_as_of", query("SELECT * FROM cashflow_sum").replace(
    "process_date > (SELECT max(process_date) - 90 FROM silver_transactions)",
    "process_date > DATE '2026-03-31' - 90 AND process_date <= DATE '2026-03-31'"))
def _(spark, sf):
    from datetime import date
    df = summaries.cashflow_summary(clean(spark, sf, "transactions"), clean(spark, sf, "daily_exchange_rates"),
                                    date(2026, 3, 31))
    return show(df, {c: 2 for c in df.columns if c.endswith("_usd_90d")})


@case("policy_from_csv", query("SELECT * FROM profile"))
def _(spark, sf):
    """The profile under policy tables read from CSV files."""
    path = scratch_path(spark, "policy")
    for name, schema in pol.SCHEMAS.items():
        spark.createDataFrame(pol.ROWS[name], schema).coalesce(1).write.option("header", True).csv(f"{path}/{name}.csv")
    policy = pol.resolve_policy(pol.load_policy(spark, path))
    return show(credit_profile(gold_inputs(spark, sf), policy))


@case("offer_refusals", query(f"""
    SELECT reason, {big('count(*)')} AS n FROM (
      SELECT 'unavailable_option' AS reason FROM options WHERE NOT is_available
      UNION ALL SELECT 'above_maximum' FROM options WHERE term_months >= 240
      UNION ALL SELECT 'below_minimum' FROM options WHERE term_months = 36
      UNION ALL SELECT 'unknown_option' FROM silver_customers) GROUP BY reason"""))
def _(spark, sf):
    """Acceptances of all options, some out of range, and one of an unknown option by each customer."""
    policy = policy_of(spark)
    options = checkpointed(offer_options(undeclared(profile_of(spark, sf)), policy, CARRY))
    out_of_range = F.when(F.col("term_months") >= 240, F.col("option_max_amount_usd") + 1.0).when(
        F.col("term_months") == 36, F.col("option_min_amount_usd") - 1.0).otherwise(F.col("option_min_amount_usd"))
    taken = options.select("customer_id", "option_code", "term_months", out_of_range.cast("double").alias("accepted_amount_usd"))
    unknown = clean(spark, sf, "customers").select(
        "customer_id", F.lit("ZZ").alias("option_code"), F.lit(1).alias("term_months"), F.lit(100.0).alias("accepted_amount_usd"))
    rows = taken.unionByName(unknown).withColumns({
        "offer_id": F.concat_ws("-", "customer_id", "option_code", "term_months"), "session_id": F.lit("s"),
        "channel": F.lit("chat"), "language": F.lit("es"), "accepted_at": F.lit("2026-07-01 10:00:00").cast("timestamp")})
    record = accepted_offers(options, rows, policy)
    return record.select(F.explode("refusal_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- tables ------------------------------------------------------------------

@case("rebuild_partitioned", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "rebuild")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    for rows in (orders.filter("o_orderstatus = 'F'"), orders):  # the second replaces the first
        rebuild(rows, path, "o_orderstatus", ["o_custkey"])
    return spark.read.parquet(path).select(*orders.columns)


@case("rebuild_clustered", "SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem")
def _(spark, sf):
    path = scratch_path(spark, "clustered")
    rebuild(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"), path,
            cluster_by=["l_shipdate"])
    return spark.read.parquet(path)


@case("append_validated", f"""
    SELECT 'accepted' AS side, o_orderstatus, {big('count(*)')} AS n FROM orders WHERE o_totalprice > 50000 GROUP BY ALL
    UNION ALL SELECT 'duplicate key', o_orderstatus, {big('count(*)')} FROM orders
      WHERE o_totalprice > 50000 AND o_orderstatus = 'F' GROUP BY ALL
    UNION ALL SELECT 'large', o_orderstatus, {big('count(*)')} FROM orders WHERE NOT o_totalprice > 50000 GROUP BY ALL""")
def _(spark, sf):
    """A second delivery that repeats the first."""
    path = scratch_path(spark, "append")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    rules = dict(pk=["o_orderkey"], checks={"large": "o_totalprice > 50000"}, required=["o_custkey"])
    validated_append(orders.filter("o_orderstatus = 'F'"), path, **rules)
    refused = validated_append(orders, path, **rules)
    sides = refused.select(F.concat_ws(",", "_violations").alias("side"), "o_orderstatus", F.col("_copies").alias("n"))
    accepted = spark.read.parquet(path).select(F.lit("accepted").alias("side"), "o_orderstatus", F.lit(1).alias("n"))
    return sides.unionByName(accepted).groupBy("side", "o_orderstatus").agg(F.sum("n").cast("bigint").alias("n"))


@case("read_formats", """
    SELECT fmt, p_partkey, p_name, p_retailprice FROM part, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS f(fmt)""")
def _(spark, sf):
    base, parts = scratch_path(spark, "formats"), table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    found = None
    for fmt in ("csv", "json", "orc", "parquet"):
        parts.write.format(fmt).save(f"{base}/{fmt}")
        rows = read_files(spark, f"{base}/{fmt}", fmt, schema).withColumn("fmt", F.lit(fmt))
        found = rows if found is None else found.unionByName(rows)
    return found


@case("audit_columns", "SELECT o_orderkey, " + ", ".join(
    f"CAST(NULL AS {t}) AS {c}" for c, t in {k: v.upper() for k, v in AUDIT_COLUMNS.items()}.items()) + " FROM orders")
def _(spark, sf):
    return ensure_columns(table(spark, sf, "orders").select("o_orderkey"))


@case("ordered_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


# --- quality -----------------------------------------------------------------

@case("rule_counts", query(f"""
    SELECT {big('count(*)')} AS n_rows, {big('count(*) FILTER (WHERE credit_limit <= 20000)')} AS n_limit,
      {big('count(*) FILTER (WHERE days_past_due > 30)')} AS n_late,
      {big("count(*) FILTER (WHERE currency = 'COP')")} AS n_no_cop,
      {big('''count(*) FILTER (WHERE (credit_limit > 20000) IS NOT FALSE AND (days_past_due <= 30) IS NOT FALSE
        AND (currency <> 'COP') IS NOT FALSE)''')} AS n_kept FROM silver_products"""))
def _(spark, sf):
    seen = Observation()
    kept = drop_and_count(clean(spark, sf, "products"), _RULES, seen).count()
    row = (seen.get["rows"], *(seen.get[r] for r in _RULES), kept)
    return spark.createDataFrame([row], "n_rows bigint, n_limit bigint, n_late bigint, n_no_cop bigint, n_kept bigint")


@case("metrics_history", query(f"""
    SELECT run_id, table_name, {big('count(*)')} AS n, {big("count(*) FILTER (WHERE status = 'fail')")} AS n_fail
    FROM ({_METRICS_SQL}), (VALUES ('r1'), ('r2')) AS r(run_id) GROUP BY run_id, table_name"""))
def _(spark, sf):
    """Metrics of two runs in one table; a failure is stored before it stops the run."""
    path, metrics = scratch_path(spark, "metrics"), checkpointed(_source_metrics(spark, sf))
    for run in ("r1", "r2"):
        try:
            record_and_gate(spark, metrics, path, ("bronze", "silver"), run)
        except QualityGateError:
            pass  # stored all the same, which this query shows
    return spark.read.parquet(path).groupBy("run_id", "table_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "fail").alias("n_fail"))


@case("broken_contract", query(f"""
    SELECT 'customer_credit_profile' AS table_name, 2e0 AS value, 'fail' AS status, {big('count(*)')} AS n_rows FROM silver_customers"""))
def _(spark, sf):
    """A profile that lacks a promised column and has another in the wrong type."""
    profile = checkpointed(profile_of(spark, sf).drop("risk_band").withColumn("fx_to_usd", F.col("fx_to_usd").cast("string")))
    assert len(contract_violations(profile, contract_columns("customer_credit_profile"))) == 2
    metric = contract_metrics({"customer_credit_profile": profile}).select("table_name", "value", "status")
    return metric.crossJoin(profile.agg(F.count(F.lit(1)).alias("n_rows")))


@case("fixture_assertions", query(f"""
    SELECT {big('count(*)')} AS n_rows, CAST(NULL AS VARCHAR) AS keys_are_unique, CAST(NULL AS VARCHAR) AS keys_are_complete
    FROM silver_transactions"""))
def _(spark, sf):
    """Assertions that stop the query, with a message, when a cleaned table breaks them."""
    counted = clean(spark, sf, "transactions").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("transaction_id").alias("_present"),
        F.count_distinct("transaction_id").alias("_distinct"))
    return counted.select(
        "n_rows",
        F.assert_true(F.col("_distinct") == F.col("n_rows"), "duplicate transaction").cast("string").alias("keys_are_unique"),
        F.assert_true(F.col("_present") == F.col("n_rows"), "transaction without key").cast("string").alias("keys_are_complete"))


@case("case_metrics", query(f"""
    SELECT 'gold' AS layer, 'customer_case_context' AS table_name, metric, 0e0 AS value, '= 0' AS threshold, 'ok' AS status
    FROM (VALUES ('duplicate_case_rows'), ('cases_after_cutoff')) AS m(metric)
    WHERE (SELECT count(*) FROM silver_complaints) >= 0"""))
def _(spark, sf):
    policy = policy_of(spark)
    cases = summaries.case_context(clean(spark, sf, "complaints"), clean(spark, sf, "call_center_interactions"), policy)
    return case_metrics(cases, policy)


@case("refresh_run", query(f"""
    SELECT table_name, {big('n')} AS n_rows, '2026-03-31' AS as_of_date FROM (
      SELECT 'customer_credit_profile' AS table_name, count(*) AS n FROM silver_customers
      UNION ALL SELECT 'customer_credit_offer_options', count(*) * 12 FROM silver_customers
      UNION ALL SELECT 'ref_product_catalog', count(*) FROM ref_product_catalog
      UNION ALL SELECT 'ref_term_grid', count(*) FROM ref_term_grid
      UNION ALL SELECT 'ref_policy_params', count(*) FROM ref_policy_params
      UNION ALL SELECT 'ref_policy_bands', count(*) FROM ref_policy_bands
      UNION ALL SELECT 'ref_segment_adjustments', count(*) FROM ref_segment_adjustments)"""))
def _(spark, sf):
    """A policy refresh on stored clean tables: profile, options, gate, and the whole export."""
    return read_manifest(spark, _refreshed(spark, sf)).select("table_name", "n_rows", "as_of_date")


# columns of the profile that the options have too
_SHARED = "total_rate_adjustment_pp, offer_mode, local_currency, fx_to_usd, risk_band, segment, as_of_date, policy_version"


@case("refresh_run_tables", query(f"SELECT * FROM options JOIN (SELECT * EXCLUDE ({_SHARED}) FROM profile) USING (customer_id)", "DATE '2026-03-31'"))
def _(spark, sf):
    """The options a refresh exported, by value, each with the exported profile of its customer."""
    path = _refreshed(spark, sf)
    profile = read_export(spark, path, "customer_credit_profile").drop(*_SHARED.split(", "))
    return show(read_export(spark, path, "customer_credit_offer_options").drop("computed_at").join(profile, "customer_id"))


def _refreshed(spark: SparkSession, sf: str) -> str:
    """The folder of the export of a refresh for an earlier date."""
    base = scratch_path(spark, "refresh")
    tables = stored_inputs(spark, sf, f"{base}/silver", cases=True)
    calls = "call_center_interactions"
    interactions = silver(bronze(spark, sf, calls), calls, summaries.CASE_READS[calls])
    build_summaries(spark, {**tables, calls: interactions}, policy_of(spark), base)
    refresh_policy(spark, base, pol.policy_tables(spark), "2026-03-31", "r1", sources=list(tables))
    return f"{base}/exports"


# --- merges that read little of their past -----------------------------------

def _line_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as changes of orders: many keys, each of which changes within a few months; one change a day."""
    day, order = F.col("l_shipdate").cast("date").alias("shipped"), F.col("l_orderkey")
    last = F.max(F.struct("l_linenumber", "l_linestatus", "l_quantity")).alias("_last")
    lines = table(spark, sf, "lineitem").groupBy(order, day).agg(last)
    return lines.select("l_orderkey", "shipped", "_last.l_linenumber", "_last.l_linestatus", "_last.l_quantity")


_LINES_SQL = _versions(
    "(SELECT l_orderkey, CAST(l_shipdate AS DATE) AS shipped, l_linenumber, l_linestatus, l_quantity FROM lineitem "
    "QUALIFY row_number() OVER (PARTITION BY l_orderkey, CAST(l_shipdate AS DATE) ORDER BY l_linenumber DESC, l_linestatus DESC, l_quantity DESC) = 1)",
    "l_orderkey", "shipped", "l_linestatus", ["l_linenumber", "l_quantity"])


def _pruned_history(spark: SparkSession, sf: str, batches: int = 10) -> str:
    """Ten deliveries in time order; a few changes of each reach the table only with the last one."""
    target, base = scratch_path(spark, "pruned"), scratch_path(spark, "deliveries")
    changes = _line_changes(spark, sf)
    days = F.datediff("shipped", F.lit("1992-01-01").cast("date"))
    lowest, highest = changes.agg(F.min(days), F.max(days)).first()
    slot = F.floor((days - lowest) * batches / (highest - lowest + 1)).cast("int")
    late = F.pmod(F.xxhash64("l_orderkey", "shipped"), F.lit(5000)) == 0
    changes.withColumn("delivery", F.when(late, batches - 1).otherwise(slot)).write.partitionBy("delivery").parquet(base)
    every = spark.read.parquet(base)
    for i in range(batches):
        rows = every.filter(F.col("delivery") == i).drop("delivery")
        scd_merge(rows, i, target, ["l_orderkey"], "shipped", tracked=["l_linestatus"],
                  untracked=["l_linenumber", "l_quantity"], buckets=4)
    return target


@case("scd2_stream_pruned", _LINES_SQL)
def _(spark, sf):
    return read_history(spark, _pruned_history(spark, sf)).drop("shipped", "bucket")


# --- whole deliveries compared -----------------------------------------------

# the same SELECT for both engines: delivery 1 to 3 of orders, each without some of them and with other values
_DELIVERY = """SELECT o_orderkey, o_custkey, CASE WHEN (o_orderkey + {n}) % 6 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 5 = {n} THEN o_totalprice + {n} ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderkey % 7 <> {n}"""


def _delivery(spark: SparkSession, sf: str, n: int) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(_DELIVERY.format(n=n))


@case("snapshot_changes", f"""
    WITH a AS ({_DELIVERY.format(n=1)}), b AS ({_DELIVERY.format(n=2)})
    SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey,
      CASE WHEN b.o_orderkey IS NULL THEN a.o_custkey ELSE b.o_custkey END AS o_custkey,
      CASE WHEN b.o_orderkey IS NULL THEN a.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
      CASE WHEN b.o_orderkey IS NULL THEN a.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
      CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS _change
    FROM a FULL JOIN b USING (o_orderkey)
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR row(a.o_custkey, a.o_orderstatus, a.o_totalprice)
      IS DISTINCT FROM row(b.o_custkey, b.o_orderstatus, b.o_totalprice)""")
def _(spark, sf):
    return snapshot_changes(_delivery(spark, sf, 1), _delivery(spark, sf, 2), ["o_orderkey"])


@case("snapshot_history", f"""
    WITH every AS ({' UNION ALL '.join(f'SELECT {n} AS place, * FROM ({_DELIVERY.format(n=n)})' for n in (1, 2, 3))}),
    grid AS (SELECT k.o_orderkey, p.place, e.o_orderkey IS NOT NULL AS there, e.o_custkey, e.o_orderstatus, e.o_totalprice
      FROM (SELECT DISTINCT o_orderkey FROM every) k CROSS JOIN (SELECT unnest([1, 2, 3]) AS place) p
      LEFT JOIN every e ON e.o_orderkey = k.o_orderkey AND e.place = p.place),
    marked AS (SELECT *, row(there, o_custkey, o_orderstatus, o_totalprice) IS DISTINCT FROM
        lag(row(there, o_custkey, o_orderstatus, o_totalprice)) OVER (PARTITION BY o_orderkey ORDER BY place) AS begins FROM grid),
    versions AS (SELECT o_orderkey, there, o_custkey, o_orderstatus, o_totalprice, place AS "__START_AT",
        lead(place) OVER (PARTITION BY o_orderkey ORDER BY place) AS "__END_AT" FROM marked WHERE begins)
    SELECT * EXCLUDE (there) FROM versions WHERE there""")
def _(spark, sf):
    """Three deliveries as versions; orders that vanish are closed, and open again if they come back."""
    return snapshots_to_history([(n, _delivery(spark, sf, n)) for n in (1, 2, 3)], ["o_orderkey"], "place")


_AGENT = "agent_id, agent_status, agent_type, avg_csat, hire_date"


@case("incremental_snapshot_history", query(f"""SELECT * FROM (
    WITH every AS (
      SELECT 0 AS place, {_AGENT} FROM typed_service_agents WHERE agent_status = 'Active'
      UNION ALL SELECT 1, {_AGENT} FROM typed_service_agents WHERE agent_status = 'Active' AND agent_type <> 'Chat'
      UNION ALL SELECT 2, agent_id, CASE WHEN agent_type = 'Phone' THEN 'Moved' ELSE agent_status END, agent_type, avg_csat, hire_date
        FROM typed_service_agents WHERE agent_status = 'Active' AND agent_type <> 'Branch'),
    grid AS (SELECT k.agent_id, p.place, e.agent_id IS NOT NULL AS there, e.* EXCLUDE (agent_id, place)
      FROM (SELECT DISTINCT agent_id FROM every) k CROSS JOIN (SELECT unnest([0, 1, 2]) AS place) p
      LEFT JOIN every e ON e.agent_id = k.agent_id AND e.place = p.place),
    versions AS (SELECT *, lead(place) OVER (PARTITION BY agent_id ORDER BY place) AS ends FROM (
      SELECT *, row(there, agent_status) IS DISTINCT FROM lag(row(there, agent_status)) OVER (PARTITION BY agent_id ORDER BY place) AS begins
      FROM grid) WHERE begins)
    SELECT {_AGENT}, place AS "__START_AT", ends AS "__END_AT" FROM versions WHERE there)"""))
def _(spark, sf):
    """Three deliveries of CSV folders over two runs, several files and batches each."""
    base, names = scratch_path(spark, "snapshots"), list(ENTITIES["service_agents"].names)
    agents = bronze(spark, sf, "service_agents").select(*names).filter("agent_status = 'Active'")
    moved = F.when(F.col("agent_type") == "Phone", "Moved").otherwise(F.col("agent_status"))
    deliveries = [agents, agents.filter("agent_type <> 'Chat'"),
                  agents.filter("agent_type <> 'Branch'").withColumn("agent_status", moved)]
    for n, rows in enumerate(deliveries):
        rows.repartition(3).write.option("header", True).option("escape", '"').csv(f"{base}/landing/service_agents/2026-0{n + 1}")
        if n != 1:
            run_incremental(spark, f"{base}/landing", base, ["service_agents"], modes={"service_agents": "snapshot_history"},
                            buckets=2, files_per_batch=4)
    history = read_snapshot_history(spark, base, "service_agents")
    return history.select(*_AGENT.split(", "), "__START_AT", "__END_AT")


@case("scd2_stateful_late", _EVENTS_SQL)
def _(spark, sf):
    """Keyed state instead of logs: newest changes first, oldest last, in two runs over one checkpoint."""
    base, changes = scratch_path(spark, "stateful"), _event_changes(spark, sf)
    middle = F.lit(changes.agg(F.avg(F.unix_micros(F.col("ts").cast("timestamp")))).scalar())
    late = F.unix_micros(F.col("ts").cast("timestamp")) < middle
    for part in (changes.filter(~late), changes.filter(late)):
        part.coalesce(2).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        versions_stream(stream, f"{base}/table", f"{base}/checkpoint", ["user_id"], "ts", ["event_type"])
    return show(read_versions(spark, f"{base}/table", ["user_id"]).select(
        "user_id", "event_id", "event_type", "value", "__START_AT", "__END_AT"))


# --- avro ----------------------------------------------------------------------

@case("read_avro", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
      l_comment_or_flag, CAST(NULL AS VARCHAR) AS _rescued_data
    FROM (SELECT *, CASE WHEN l_linenumber > 3 THEN l_returnflag END AS l_comment_or_flag FROM lineitem)""")
def _(spark, sf):
    """Lines written as Avro files and read back in splits that are much smaller than a file."""
    path = scratch_path(spark, "avro")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
        F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")).alias("l_comment_or_flag"))
    lines.write.format(register_avro(spark)).mode("append").save(path)
    return read_files(spark, path, "avro", splitBytes=200_000)


# --- as-of and interval joins --------------------------------------------------

@case("fx_as_of_gaps", query(f"""
    SELECT transaction_id, CASE WHEN t.currency <> 'USD' THEN f.date END AS fx_date,
      {rnd("CASE WHEN t.currency = 'USD' THEN amount ELSE amount * f.exchange_rate END", 2)} AS usd
    FROM silver_transactions t ASOF LEFT JOIN (
      SELECT * FROM silver_daily_exchange_rates WHERE target_currency = 'USD' AND date_diff('day', DATE '2019-01-01', date) % 11 < 2) f
    ON f.source_currency = t.currency AND f.date <= t.process_date"""))
def _(spark, sf):
    """Rates of two days in eleven only: the days between take the one before; the path for large keys."""
    fx = clean(spark, sf, "daily_exchange_rates").filter("datediff(date, DATE '2019-01-01') % 11 < 2")
    usd = convert_as_of(clean(spark, sf, "transactions"), fx, {"amount": "usd"}, "currency", F.col("process_date"), hot_rows=100)
    return usd.select("transaction_id", "fx_date", F.round("usd", 2).alias("usd"))


# the same SELECTs for both engines
_PRICES = "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price, l_suppkey % 3 AS zone FROM lineitem"
_OFFERS = """SELECT o_orderkey, o_custkey % 3 AS zone, CASE WHEN o_orderkey % 1000 <> 7 THEN CAST(o_totalprice AS DOUBLE) / 4e0 END AS low,
  CAST(o_totalprice AS DOUBLE) / 4e0 + CASE o_orderkey % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 25e-2 WHEN 2 THEN 4e0 WHEN 3 THEN 15e0 ELSE -1e0 END AS high
  FROM orders"""


def _prices_and_offers(spark, sf):
    for name in ("lineitem", "orders"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(_PRICES), spark.sql(_OFFERS)


@case("interval_pairs", f"""
    SELECT o_orderkey, {big('count(*)')} AS lines, min(l_orderkey) AS l_orderkey FROM ({_PRICES}) p JOIN ({_OFFERS}) o
    ON p.zone = o.zone AND (low IS NULL OR low <= price) AND price < high GROUP BY o_orderkey""")
def _(spark, sf):
    """Short, long, open and empty ranges, one for each order."""
    prices, offers = _prices_and_offers(spark, sf)
    pairs = interval_join(prices, offers, "price", "low", "high", ["zone"], closed=False)
    return pairs.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.min("l_orderkey").alias("l_orderkey"))


@case("interval_first_match", f"""
    SELECT l_orderkey, l_linenumber, min(o_orderkey) AS o_orderkey, nullif({big('count(o_orderkey)')}, 0) AS n
    FROM (SELECT row_number() OVER () AS line, * FROM ({_PRICES})) p
    LEFT JOIN ({_OFFERS}) o ON p.zone = o.zone AND (low IS NULL OR low <= price) AND price <= high
    GROUP BY line, l_orderkey, l_linenumber""")
def _(spark, sf):
    prices, offers = _prices_and_offers(spark, sf)
    found = first_covering_range(prices, offers, "price", "low", "high", "o_orderkey", group=["zone"])
    return found.select("l_orderkey", "l_linenumber", "_match.o_orderkey", F.col("_match._ranges").alias("n"))


# --- layouts -------------------------------------------------------------------

_MONTHLY = "SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month FROM orders"


@case("replace_partitions", f"""
    SELECT * REPLACE (CASE WHEN month LIKE '%-03' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice)
    FROM ({_MONTHLY}) WHERE month NOT LIKE '%-04' AND NOT (month LIKE '%-03' AND o_orderkey % 2 = 0)""")
def _(spark, sf):
    """All months, then another version of each March, which takes each April away."""
    path = scratch_path(spark, "monthly")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    replace_partitions(orders, path, "month")
    march = orders.filter("month LIKE '%-03' AND o_orderkey % 2 = 1").withColumn("o_totalprice", -F.col("o_totalprice"))
    replace_partitions(march, path, "month", covers=[f"{year}-04" for year in range(1990, 2011)])
    return read_partitions(spark, path)


@case("rebuild_zordered", "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem")
def _(spark, sf):
    path = scratch_path(spark, "zordered")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    rebuild_zordered(rows, path, ["l_shipdate", "l_extendedprice", "l_orderkey"])
    return spark.read.parquet(path)


_SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


@case("quantile_sketch", f"""
    SELECT l_returnflag, CAST(unnest([{', '.join(map(str, _SHARES))}]) AS DOUBLE) AS share, n, TRUE AS within
    FROM (SELECT l_returnflag, {big('count(*)')} AS n FROM lineitem GROUP BY l_returnflag)""")
def _(spark, sf):
    """Daily sketches merged; whether the exact rank of each quantile, counted over all rows, is within the stated error."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_shipdate", F.col("l_extendedprice").cast("double").alias("v"))
    merged = sketches.merge(sketches.sketch(lines, ["l_returnflag", "l_shipdate"], "v"), ["l_returnflag"])
    wanted = F.arrays_zip(F.array(*map(F.lit, _SHARES)).alias("share"), sketches.quantiles(_SHARES).alias("q"))
    found = merged.select("l_returnflag", F.explode(wanted).alias("w")).select("l_returnflag", "w.share", "w.q")
    ranks = lines.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag", "share").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("v") < F.col("q")).cast("int")).alias("below"),
        F.avg((F.col("v") <= F.col("q")).cast("int")).alias("upto"))
    error = sketches.rank_error()
    return ranks.select("l_returnflag", "share", "n", ((F.col("below") - error <= F.col("share")) & (F.col("share") <= F.col("upto") + error)).alias("within"))


@case("silver_metrics_written", query(_METRICS_SQL))
def _(spark, sf):
    """The metrics of a run that counts while it writes."""
    base = scratch_path(spark, "counted")
    raws, counts = {}, {}
    for name, spec in ENTITIES.items():
        counts[name] = rebuild(bronze(spark, sf, name), f"{base}/bronze/{name}", watch=raw_counts(spec))
        raws[name] = spark.read.parquet(f"{base}/bronze/{name}")
    with contextlib.suppress(QualityGateError):  # these tables have more duplicates than the gate lets pass
        build_silver(spark, raws, base, "counted", counts)
    metrics = spark.read.parquet(f"{base}/gold/pipeline_quality_metrics")
    return metrics.select("layer", "table_name", "metric", "value", "threshold", "status")


@case("profile_bucketed", query("SELECT * FROM profile"))
def _(spark, sf):
    """The profile from tables in buckets of customers."""
    stored = bucketed_inputs(spark, gold_inputs(spark, sf), "customer_id", 8, f"gold_{uuid.uuid4().hex}")
    return show(credit_profile(stored, policy_of(spark)))


# --- declared types, grouping by all ---------------------------------------------

_DECLARED = {"o_orderkey": "bigint", "o_totalprice": "numeric(12, 1)", "is_open": "bit", "o_orderdate": "date", "o_comment": "nvarchar(40)"}


@case("declared_types", """
    SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,1)) AS DOUBLE) AS o_totalprice, o_orderstatus = 'O' AS is_open,
      CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority AS o_comment FROM orders""")
def _(spark, sf):
    """Text columns cast to the types a database declares, its flags to booleans."""
    text = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(14,4)").cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderstatus") == "O", "1").otherwise("0").alias("is_open"),
        F.to_date("o_orderdate").cast("string").alias("o_orderdate"), F.col("o_orderpriority").alias("o_comment"))
    flagged = flags_to_boolean(text, _DECLARED)
    casts = {c: F.col(c).cast(declared_type(t)) for c, t in _DECLARED.items() if t != "bit"}
    return flagged.withColumns(casts).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


_GROUPED = """SELECT country, product_type, currency, product_status, count(*) AS n, count(DISTINCT customer_id) AS customers,
    max(days_past_due) AS latest FROM {products} JOIN {customers} USING (customer_id) GROUP BY ALL"""


@case("group_by_all", query(f"SELECT * REPLACE ({big('n')} AS n, {big('customers')} AS customers) FROM ({_GROUPED.format(products='silver_products', customers='silver_customers')})"))
def _(spark, sf):
    """What customers hold, grouped by every column that is no aggregate."""
    return spark.sql(_GROUPED, products=clean(spark, sf, "products"), customers=clean(spark, sf, "customers"))
