"""Queries over the driver's tables, one per operator, each with the SQL DuckDB should agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.contracts import ENTITIES
from caudal.functions.finance import max_principal, monthly_installment, register_sql
from caudal.functions.keys import identity_hash, sequence_expr
from caudal.operators.cleanse import drop_empty_rows, params_row, project, sanitize_names
from caudal.operators.dedup import content_duplicates, latest_by_key, not_null
from caudal.operators.fx import convert_on_date, rates_as_of
from caudal.operators.lookup import band_of, first_covering
from caudal.operators.quantiles import exact_quantiles
from caudal.operators.rules import split_by_rules
from caudal.operators.scd import END, START, scd1, scd2
from caudal.plans import derivation, offers, summaries
from caudal.plans.medallion import POLICY_TABLES
from caudal.plans.options import featured_options, offer_options, option_grid
from caudal.plans.policy import Policy, policy_tables, resolve_policy
from caudal.plans.profile import (
    PROFILE_READS, agent_context, complaint_facts, credit_products, credit_profile, existing_installments,
    product_facts, transaction_facts, with_term_limits,
)
from caudal.plans.silver import silver, typed_rows
from caudal.quality.gate import gate_status
from caudal.quality.metrics import gold_metrics, load_report, source_metrics
from caudal.session import checkpointed, scratch_path
from caudal.sinks.constrained import validate
from caudal.sinks.publish import publish, read_manifest
from caudal.sinks.tables import add_by_name
from caudal.sources.files import read_strings
from caudal.sources.ledger import list_files, new_files
from caudal.streaming.history import merge_stream, read_history
from caudal.streaming.ingest import append_flow, append_stream, stream_files, stream_table, to_bronze
from testbed import recast
from testbed.oracle import OPEN_STATUSES, big, installment, n_if, principal, query, rnd, shown, stamp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Register a query and, if SQL can say it, its oracle."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# --- inputs ------------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bronze(spark: SparkSession, sf: str, entity: str) -> DataFrame:
    return recast.raw(spark, sf, f"raw_{entity}")


def clean(spark: SparkSession, sf: str, entity: str) -> DataFrame:
    return silver(bronze(spark, sf, entity), entity)


GOLD_INPUTS = ("customers", "products", "transactions", "complaints", "daily_exchange_rates")


def gold_inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {e: clean(spark, sf, e) for e in GOLD_INPUTS}


def profile_inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The clean tables without columns that neither a profile reads nor a choice between rows needs."""
    return {e: silver(bronze(spark, sf, e), e, PROFILE_READS[e]) for e in GOLD_INPUTS}


def stored_inputs(spark: SparkSession, sf: str, base: str = "", cases: bool = False) -> dict[str, DataFrame]:
    """The clean tables as profile and summaries, and with ``cases`` the open cases, read them, each worked out once and stored."""
    base = base or scratch_path(spark, "clean")
    for name in GOLD_INPUTS:
        reads = sorted({*PROFILE_READS[name], *summaries.SUMMARY_READS.get(name, ()),
                        *(summaries.CASE_READS.get(name, ()) if cases else ())})
        silver(bronze(spark, sf, name), name, reads).select(*reads).write.parquet(f"{base}/{name}")
    return {name: spark.read.parquet(f"{base}/{name}") for name in GOLD_INPUTS}


def policy_of(spark: SparkSession, as_of: str = "") -> Policy:
    return resolve_policy(policy_tables(spark), as_of)


def profile_of(spark: SparkSession, sf: str, as_of: str = "") -> DataFrame:
    return credit_profile(profile_inputs(spark, sf), policy_of(spark, as_of))


def priced_products(spark: SparkSession, sf: str) -> DataFrame:
    policy = policy_of(spark)
    rates = rates_as_of(clean(spark, sf, "daily_exchange_rates"), policy.cutoff)
    coded = credit_products(clean(spark, sf, "products"), rates, policy.tables["ref_product_catalog"])
    return existing_installments(coded, policy.tables["ref_term_grid"])


def show(df: DataFrame, digits: dict[str, int] | None = None, **rename) -> DataFrame:
    """Comparable output: timestamps and arrays as text, run times dropped, sums rounded."""
    df = df.drop("computed_at", "_silver_processed_at", "_quarantine_timestamp", "run_at")
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind.startswith("array"):
            c = F.when(c.isNotNull(), F.concat_ws(",", c))
        elif digits and name in digits:
            c = F.round(c, digits[name])
        columns.append(c.alias(rename.get(name, name)))
    return df.select(*columns)


# --- typing, cleaning, deduplication -----------------------------------------

for _entity in ENTITIES:
    def _clean_query(spark, sf, entity=_entity):
        return show(clean(spark, sf, entity))
    case(f"silver_{_entity}", query(f"SELECT {shown(_entity)} FROM silver_{_entity}"))(_clean_query)


@case("typed_cast_silver", query(f"SELECT {shown('call_center_interactions')} FROM typed_call_center_interactions"))
def _(spark, sf):
    return show(typed_rows(bronze(spark, sf, "call_center_interactions"), "call_center_interactions"))


@case("clean_recode_fill", query(
    f"SELECT transaction_country, transaction_type, channel, transaction_status, currency, "
    f"{big('count(*)')} AS n, {big('count(amount_usd)')} AS n_usd FROM typed_transactions GROUP BY ALL"))
def _(spark, sf):
    rows = typed_rows(bronze(spark, sf, "transactions"), "transactions")
    return rows.groupBy("transaction_country", "transaction_type", "channel", "transaction_status", "currency").agg(
        F.count(F.lit(1)).alias("n"), F.count("amount_usd").alias("n_usd"))


@case("null_key_drop", query(
    "SELECT transaction_id, product_id, CAST(amount AS DOUBLE) AS amount FROM raw_transactions WHERE transaction_id IS NOT NULL AND customer_id IS NOT NULL"))
def _(spark, sf):
    rows = not_null(bronze(spark, sf, "transactions"), ["transaction_id", "customer_id"])
    return rows.select("transaction_id", "product_id", F.col("amount").cast("double").alias("amount"))


@case("dedup_latest_simple", """
    SELECT o_custkey, o_orderkey, o_orderdate::DATE AS o_orderdate, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    return latest_by_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@case("dedup_latest_composite", f"""
    SELECT * REPLACE ({stamp('l_shipdate')} AS l_shipdate) FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
      l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""")
def _(spark, sf):
    return show(latest_by_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"]))


@case("content_duplicates", query("""
    SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL HAVING count(*) > 1"""))
def _(spark, sf):
    return content_duplicates(table(spark, sf, "events"), ["user_id", "event_type"])


@case("project_rename_nulls", """
    SELECT o_orderkey AS order_id, o_totalprice AS price, CAST(NULL AS VARCHAR) AS discount_code FROM orders""")
def _(spark, sf):
    wanted = {"o_orderkey": "order_id", "o_totalprice": "price", "o_coupon": "discount_code", "o_custkey": "customer"}
    return project(table(spark, sf, "orders"), wanted, allow_missing=True, exclude=["customer"])


@case("bronze_names_and_empty_rows", """
    SELECT "Cust_Key_", Segment FROM (SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey END AS "Cust_Key_",
      CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS Segment FROM customer) WHERE "Cust_Key_" IS NOT NULL""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("Cust Key=-"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("Segment"),
        F.lit("f").alias("_source_file_name"))
    return drop_empty_rows(sanitize_names(rows)).drop("_source_file_name")


@case("param_pivot", """
    SELECT max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS "BUILDING",
      max(CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(trunc(c_acctbal) AS INTEGER) END) AS "MACHINERY" FROM customer""")
def _(spark, sf):
    params = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("param_name"), F.col("c_acctbal").alias("param_value"))
    return params_row(params, {"BUILDING": "double", "MACHINERY": "int"})


# --- files -------------------------------------------------------------------

_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_comment"]
_EXTRA = {"F": ["o_orderpriority"], "O": [], "P": ["o_orderdate", "o_orderpriority"]}


def _write_mixed_csv(spark, sf) -> str:
    """Orders as CSV in three layouts: other column orders, missing and unknown columns, line breaks."""
    path = scratch_path(spark, "mixed-csv")
    orders = table(spark, sf, "orders").withColumns({
        "o_comment": F.concat(F.lit('say "hi",\nline '), F.col("o_orderkey")),
        "o_orderdate": F.to_date("o_orderdate"),
    })
    layouts = {
        "F": ["o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"],
        "O": _ORDER_COLUMNS,
        "P": ["o_comment", "o_orderdate", "o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice"],
    }
    for status, columns in layouts.items():
        (orders.filter(F.col("o_orderstatus") == status).select(*columns)
         .write.option("header", True).option("escape", '"').csv(f"{path}/{status}"))
    return path


@case("csv_by_name", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice,
      CASE WHEN o_orderstatus <> 'F' THEN 'say "hi",' || chr(10) || 'line ' || o_orderkey END AS o_comment FROM orders""")
def _(spark, sf):
    rows = read_strings(spark, _write_mixed_csv(spark, sf), _ORDER_COLUMNS, recursiveFileLookup=True)
    return rows.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_comment")


@case("rescued_rows", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority AS rescued_priority,
      CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS rescued_date,
      true AS has_file FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def _(spark, sf):
    rows = read_strings(spark, _write_mixed_csv(spark, sf), _ORDER_COLUMNS, recursiveFileLookup=True)
    part = F.get_json_object
    return rows.filter("_rescued_data IS NOT NULL").select(
        "o_orderkey", part("_rescued_data", "$.o_orderpriority").alias("rescued_priority"),
        part("_rescued_data", "$.o_orderdate").alias("rescued_date"),
        part("_rescued_data", "$._file_path").isNotNull().alias("has_file"))


@case("file_ledger_new", """
    SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'""")
def _(spark, sf):
    path = scratch_path(spark, "ledger")
    months = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    months.repartition("month").write.partitionBy("month").parquet(path)
    listing = list_files(spark, path, "*.parquet").withColumn("month", F.regexp_extract("path", r"month=([\d-]+)", 1))
    return new_files(listing, listing.filter("month < '1999-01'")).select("month").distinct()


@case("stream_file_append", """
    SELECT event_id, user_id, event_type, value, true AS has_file FROM events""")
def _(spark, sf):
    base = scratch_path(spark, "stream")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").repartition(6, "event_id") \
        .write.option("header", True).csv(f"{base}/in")
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    for _ in range(2):  # the second run finds nothing new
        files = stream_files(spark, f"{base}/in", schema, header=True, maxFilesPerTrigger=2)
        append_stream(to_bronze(files), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(
        "event_id", "user_id", "event_type", "value", F.col("_source_file_path").isNotNull().alias("has_file"))


@case("stream_append_flows", """
    SELECT flow, name, balance FROM (SELECT 'customer' AS flow, c_name AS name, c_acctbal AS balance FROM customer
      UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier)""")
def _(spark, sf):
    """Two streams into one table."""
    base = scratch_path(spark, "flows")
    for flow, name, balance in (("customer", "c_name", "c_acctbal"), ("supplier", "s_name", "s_acctbal")):
        rows = table(spark, sf, flow).select(F.col(name).alias("name"), F.col(balance).alias("balance"))
        rows.repartition(3, "name").write.parquet(f"{base}/{flow}")
        append_flow(stream_table(spark, f"{base}/{flow}"), f"{base}/all", flow, f"{base}/checkpoint-{flow}")
    return spark.read.parquet(f"{base}/all").select("flow", "name", "balance")


@case("stream_quarantine", """
    SELECT event_id, value, concat_ws(',', CASE WHEN value <= 5 THEN 'big' END, CASE WHEN event_type = 'error' THEN 'no_error' END)
      AS _failed_dq_rules FROM events WHERE value <= 5 OR event_type = 'error'""")
def _(spark, sf):
    """The refused side of a stream, appended to its own table."""
    base = scratch_path(spark, "quarantine")
    table(spark, sf, "events").select("event_id", "event_type", "value").repartition(4, "event_id") \
        .write.parquet(f"{base}/in")
    valid, bad = split_by_rules(stream_table(spark, f"{base}/in"),
                                {"big": "value > 5", "no_error": "event_type <> 'error'"}, "events")
    append_stream(valid, f"{base}/valid", f"{base}/checkpoint-valid")
    append_stream(bad, f"{base}/bad", f"{base}/checkpoint-bad")
    return show(spark.read.parquet(f"{base}/bad").select("event_id", "value", "_failed_dq_rules"))


# --- rules -------------------------------------------------------------------

_RULES = {"limit": "credit_limit > 20000", "late": "days_past_due <= 30", "no_cop": "currency <> 'COP'"}


@case("dq_valid", query("""
    SELECT product_id, credit_limit, days_past_due, currency FROM silver_products
    WHERE (credit_limit > 20000) IS NOT FALSE AND (days_past_due <= 30) IS NOT FALSE AND (currency <> 'COP') IS NOT FALSE"""))
def _(spark, sf):
    valid, _ = split_by_rules(clean(spark, sf, "products"), _RULES)
    return valid.select("product_id", "credit_limit", "days_past_due", "currency")


@case("dq_quarantine", query("""
    SELECT * FROM (SELECT product_id, credit_limit, concat_ws(',', CASE WHEN credit_limit <= 20000 THEN 'limit' END,
        CASE WHEN days_past_due > 30 THEN 'late' END, CASE WHEN currency = 'COP' THEN 'no_cop' END) AS _failed_dq_rules,
      'products' AS _source_table FROM silver_products) WHERE _failed_dq_rules <> ''"""))
def _(spark, sf):
    _, bad = split_by_rules(clean(spark, sf, "products"), _RULES, "products")
    return show(bad.select("product_id", "credit_limit", "_failed_dq_rules", "_source_table"))


# --- history -----------------------------------------------------------------

_VERSIONS = """
    SELECT {keys}, {tracked}, {last}, {seq} AS "__START_AT", lead({seq}) OVER (PARTITION BY {keys} ORDER BY {seq}) AS "__END_AT" FROM (
      SELECT {keys}, {tracked}, min({seq}) AS {seq}, {lasts} FROM (
        SELECT *, sum(CASE WHEN chg THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {seq}) AS ver FROM (
          SELECT *, lag({seq}) OVER w IS NULL OR ({state}) IS DISTINCT FROM lag(({state})) OVER w AS chg
          FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {seq})))
      GROUP BY {keys}, {tracked}, ver)"""


def _versions(src: str, keys: str, seq: str, tracked: str, last: list[str]) -> str:
    state = "row(" + tracked + ")"
    return _VERSIONS.format(
        keys=keys, seq=seq, tracked=tracked, src=src, state=state, last=", ".join(last),
        lasts=", ".join(f"arg_max({c}, {seq}) AS {c}" for c in last))


def _stamped(sql: str) -> str:
    return f"SELECT * REPLACE ({stamp(chr(34) + '__START_AT' + chr(34))} AS \"__START_AT\", {stamp(chr(34) + '__END_AT' + chr(34))} AS \"__END_AT\") FROM ({sql})"


_EVENTS_SQL = _stamped(_versions(
    "(SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)",
    "user_id", "ts", "event_type", ["event_id", "value"]))


def _event_changes(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")


@case("scd1_current", f"""
    SELECT user_id, {stamp('ts')} AS ts, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(spark, sf):
    return show(scd1(_event_changes(spark, sf), ["user_id"], "ts"))


@case("scd2_untracked", _EVENTS_SQL)
def _(spark, sf):
    history = scd2(_event_changes(spark, sf), ["user_id"], "ts", ["event_type"], ["event_id", "value"])
    return show(history.drop("ts"))


@case("scd2_history", query(_versions("deliveries", "order_id", "changed_on", "status, price", ["priority"])))
def _(spark, sf):
    changes = recast.raw(spark, sf, "deliveries")
    return scd2(changes, ["order_id"], "changed_on", ["status", "price"]).drop("changed_on")


@case("scd2_large_keys", _EVENTS_SQL)
def _(spark, sf):
    # a low limit sends the keys with most rows through the range-wise path
    history = scd2(_event_changes(spark, sf), ["user_id"], "ts", ["event_type"], ["event_id", "value"], hot_rows=10)
    return show(history.drop("ts"))


@case("scd2_multi_seq", query(_stamped(_versions(
    "(SELECT complaint_id, strptime(process_date || ' ' || substr(creation_date, 12, 8), '%Y-%m-%d %H:%M:%S') AS seq, status, "
    "priority, resolution FROM raw_complaints)", "complaint_id", "seq", "status, priority", ["resolution"]))))
def _(spark, sf):
    raw = bronze(spark, sf, "complaints").withColumn("at", F.substring("creation_date", 12, 8))
    changes = raw.select("complaint_id", "status", "priority", "resolution",
                         sequence_expr(["process_date", "at"], "yyyy-MM-dd HH:mm:ss").alias("seq"))
    return show(scd2(changes, ["complaint_id"], "seq", ["status", "priority"], ["resolution"]).drop("seq"))


@case("identity_hash_key", """
    SELECT md5(concat_ws('||', coalesce(n_name, '__NULL__'), coalesce(CAST(n_nationkey AS VARCHAR), '__NULL__'),
        coalesce(CAST(s_suppkey AS VARCHAR), '__NULL__'))) AS _identity_hash, s_suppkey
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey > 0""")
def _(spark, sf):
    nation = table(spark, sf, "nation").filter("n_regionkey > 0").select("n_nationkey", "n_name")
    rows = table(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    rows = rows.select("s_suppkey", "n_nationkey", "n_name")
    return rows.select(identity_hash(rows).alias("_identity_hash"), "s_suppkey")


@case("scd2_stream", _EVENTS_SQL)
def _(spark, sf):
    """The batch result again, from files in random time order, three to a micro-batch."""
    base = scratch_path(spark, "scd")
    changes = _event_changes(spark, sf)
    changes.repartition(6, "event_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 3).parquet(f"{base}/in")
    merge_stream(stream, f"{base}/table", f"{base}/checkpoint", keys=["user_id"], sequence="ts",
                 tracked=["event_type"], untracked=["event_id", "value"], buckets=8)
    return show(read_history(spark, f"{base}/table").drop("ts", "bucket"))


@case("scd1_stream", ORACLE["scd1_current"])
def _(spark, sf):
    base = scratch_path(spark, "scd1")
    changes = _event_changes(spark, sf)
    changes.repartition(6, "event_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 3).parquet(f"{base}/in")
    merge_stream(stream, f"{base}/table", f"{base}/checkpoint", keys=["user_id"], sequence="ts",
                 scd_type=1, buckets=8)
    return show(read_history(spark, f"{base}/table").drop("bucket"))


# --- currencies, ranges, joins -----------------------------------------------

@case("fx_as_of", query("SELECT ccy AS currency, to_usd, fx_date FROM fx_now"))
def _(spark, sf):
    return rates_as_of(clean(spark, sf, "daily_exchange_rates"), policy_of(spark).cutoff)


@case("fx_on_date", query(f"""
    SELECT transaction_id, {rnd("CASE WHEN currency = 'USD' THEN amount ELSE amount * rate END", 2)} AS usd
    FROM silver_transactions CROSS JOIN fx_last
    LEFT JOIN fx_day ON ccy = currency AND on_day = least(process_date, last_day)"""))
def _(spark, sf):
    usd = convert_on_date(clean(spark, sf, "transactions"), clean(spark, sf, "daily_exchange_rates"),
                          {"amount": "usd"}, "currency", F.col("process_date"))
    return usd.select("transaction_id", F.round("usd", 2).alias("usd"))


@case("range_first_match", query("""
    SELECT o_orderkey, product_code, (SELECT min(g.term_months) FROM ref_term_grid g
      WHERE g.product_code = o.product_code AND g.max_amount_usd >= o_totalprice / 9) AS term_months
    FROM (SELECT o_orderkey, o_totalprice, codes[1 + o_orderkey % len(codes)] AS product_code
      FROM orders CROSS JOIN (SELECT list_sort(list(DISTINCT product_code)) AS codes FROM ref_term_grid)) o"""))
def _(spark, sf):
    """Every product of the grid, dealt over the orders."""
    grid = policy_of(spark).tables["ref_term_grid"]
    codes = F.broadcast(grid.agg(F.array_sort(F.collect_set("product_code")).alias("codes")))
    at = (F.col("o_orderkey") % F.size("codes") + 1).cast("int")
    wanted = table(spark, sf, "orders").crossJoin(codes).withColumn("product_code", F.element_at("codes", at))
    found = first_covering(wanted, grid, F.col("o_totalprice") / 9, "max_amount_usd", "term_months", [], group="product_code")
    return found.select("o_orderkey", "product_code", F.col("_match.term_months").alias("term_months"))


@case("band_lookup", query("SELECT customer_id, risk_band AS band FROM limits"))
def _(spark, sf):
    bands = policy_of(spark).tables["ref_policy_bands"].select("min_credit_score", "band")
    banded = band_of(clean(spark, sf, "customers"), bands, F.col("credit_score"), "min_credit_score")
    return banded.select("customer_id", F.col("_band.band").alias("band"))


@case("cross_expand", query("""
    SELECT c_custkey, product_code AS option_code, term_months, left(product_code, 2) AS product_code
    FROM customer CROSS JOIN ref_term_grid"""))
def _(spark, sf):
    grid = option_grid(policy_of(spark)).select("option_code", "term_months", "product_code")
    return table(spark, sf, "customer").select("c_custkey").crossJoin(F.broadcast(grid))


@case("anti_linked", query("""
    SELECT interaction_id, customer_id FROM silver_call_center_interactions i
    WHERE NOT EXISTS (SELECT 1 FROM silver_complaints c WHERE c.origin_interaction_id = i.interaction_id)"""))
def _(spark, sf):
    free = summaries.unlinked_interactions(
        clean(spark, sf, "call_center_interactions"), clean(spark, sf, "complaints"))
    return free.select("interaction_id", "customer_id")


# --- aggregates --------------------------------------------------------------

@case("filter_aggs", f"""
    SELECT l_returnflag, {n_if("l_linestatus = 'F'")} AS n_f, {rnd("sum(l_quantity) FILTER (WHERE l_discount > 0.05)", 2)} AS qty,
      bool_or(l_tax > 0.07) AS any_tax, arg_max(l_extendedprice, struct_pack(a := l_shipdate, b := l_extendedprice)) AS last_price,
      max(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) AS has_big
    FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_linestatus") == "F").alias("n_f"),
        F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))), 2).alias("qty"),
        F.bool_or(F.col("l_tax") > 0.07).alias("any_tax"),
        F.max_by("l_extendedprice", F.struct("l_shipdate", "l_extendedprice")).alias("last_price"),
        F.max(F.when(F.col("l_quantity") > 49, 1).otherwise(0)).alias("has_big"))


@case("distinct_months", """
    SELECT o_custkey, CAST(count(DISTINCT date_trunc('month', o_orderdate)) AS BIGINT) AS months FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_distinct(F.date_trunc("month", "o_orderdate")).alias("months"))


@case("multi_distinct", query("""
    SELECT currency, CAST(count(DISTINCT CASE WHEN customer_id IS NOT NULL THEN customer_id || '|' || transaction_type END) AS BIGINT) AS pairs
    FROM silver_transactions GROUP BY currency"""))
def _(spark, sf):
    return clean(spark, sf, "transactions").groupBy("currency").agg(
        F.count_distinct("customer_id", "transaction_type").alias("pairs"))


@case("set_join", """
    SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ', ') AS flags
    FROM lineitem GROUP BY l_suppkey""")
def _(spark, sf):
    flags = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.array_join(F.array_sort(F.collect_set(flags)), ", ").alias("flags"))


_SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@case("exact_quantiles", f"""
    SELECT l_returnflag, array_to_string([printf('%.4f', x) FOR x IN quantile_cont(l_extendedprice, {_SHARES})], ',') AS q
    FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    found = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", _SHARES, "q", hot_rows=1000)
    return found.select("l_returnflag", F.concat_ws(",", F.transform("q", lambda x: F.format_string("%.4f", x))).alias("q"))


# --- annuities ---------------------------------------------------------------

_RATE = "(o_orderkey % 400) / 1e1"
_TERM = "CAST(12 * (o_orderkey % 30) AS INT)"


@case("annuity_installment", f"SELECT o_orderkey, {rnd(installment('o_totalprice', _RATE, _TERM), 2)} AS installment FROM orders")
def _(spark, sf):
    value = monthly_installment(F.col("o_totalprice"), F.expr(_RATE), F.expr(_TERM))
    return table(spark, sf, "orders").select("o_orderkey", F.round(value, 2).alias("installment"))


@case("annuity_principal", f"SELECT o_orderkey, {rnd(principal('o_totalprice / 300', _RATE, _TERM), 2)} AS principal FROM orders")
def _(spark, sf):
    value = max_principal(F.col("o_totalprice") / 300, F.expr(_RATE), F.expr(_TERM))
    return table(spark, sf, "orders").select("o_orderkey", F.round(value, 2).alias("principal"))


@case("annuity_sql_functions", f"""
    SELECT o_orderkey, {rnd(installment('o_totalprice', _RATE, _TERM), 2)} AS installment,
      {rnd(principal('o_totalprice / 300', _RATE, _TERM), 2)} AS principal FROM orders""")
def _(spark, sf):
    register_sql(spark)
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(
        f"SELECT o_orderkey, round(monthly_installment(o_totalprice, {_RATE}, {_TERM}), 2) AS installment, "
        f"round(max_principal(o_totalprice / 300, {_RATE}, {_TERM}), 2) AS principal FROM orders")


# --- credit ------------------------------------------------------------------

@case("existing_installments", query(f"SELECT product_id, product_code, {rnd('owed_usd', 2)} AS installment_usd FROM owed"))
def _(spark, sf):
    return show(priced_products(spark, sf).select("product_id", "product_code", "installment_usd"), {"installment_usd": 2})


_MONEY = ("current_installments_usd", "card_limit_usd", "card_balance_usd")


@case("product_risk", query(
    "SELECT * REPLACE (" + ", ".join(f"{rnd(c, 2)} AS {c}" for c in _MONEY) + ") FROM held"))
def _(spark, sf):
    return show(product_facts(priced_products(spark, sf)), dict.fromkeys(_MONEY, 2))


def _flows(spark, sf):
    policy = policy_of(spark)
    rates = rates_as_of(clean(spark, sf, "daily_exchange_rates"), policy.cutoff)
    return transaction_facts(clean(spark, sf, "transactions"), rates, policy)


@case("deposits_6m", query(
    f"SELECT customer_id, {rnd('avg_monthly_deposits_usd_6m', 2)} AS avg_monthly_deposits_usd_6m, deposit_months_6m "
    "FROM flows WHERE deposit_months_6m > 0"))
def _(spark, sf):
    found = _flows(spark, sf).filter("deposit_months_6m > 0").drop("confirmed_fraud_tx_recent")
    return show(found, {"avg_monthly_deposits_usd_6m": 2})


@case("recent_fraud", query("SELECT customer_id, confirmed_fraud_tx_recent FROM flows WHERE confirmed_fraud_tx_recent > 0"))
def _(spark, sf):
    return _flows(spark, sf).filter("confirmed_fraud_tx_recent > 0").select("customer_id", "confirmed_fraud_tx_recent")


@case("open_complaints", query("SELECT * FROM gripes"))
def _(spark, sf):
    return complaint_facts(clean(spark, sf, "complaints"))


@case("age_term_cap", query(
    "SELECT customer_id, risk_band, max_term_by_age_months, max_term_personal_loan_months, max_term_mortgage_months FROM limits"))
def _(spark, sf):
    return with_term_limits(clean(spark, sf, "customers"), policy_of(spark)).select(
        "customer_id", "risk_band", "max_term_by_age_months", "max_term_personal_loan_months", "max_term_mortgage_months")


@case("reason_codes", query("SELECT customer_id, reason_codes, is_eligible, offer_mode FROM profile"))
def _(spark, sf):
    return show(profile_of(spark, sf).select("customer_id", "reason_codes", "is_eligible", "offer_mode"))


@case("credit_profile", query("SELECT * FROM profile"))
def _(spark, sf):
    return show(profile_of(spark, sf))


@case("agent_context", query("""
    SELECT customer_id, is_eligible, offer_mode, not_proactive_reason, reason_codes, requires_advisor_review,
      can_become_eligible_with_declared_income, risk_band, segment, local_currency, fx_to_usd, fx_date, income_used_usd,
      income_source, current_installments_usd, max_total_installment_usd, available_installment_usd,
      total_rate_adjustment_pp, max_term_personal_loan_months, max_term_mortgage_months, open_complaints,
      open_priority_complaints, open_critical_complaints, as_of_date, policy_version FROM profile"""))
def _(spark, sf):
    return show(agent_context(profile_of(spark, sf)))


@case("policy_refresh", query("SELECT * FROM profile", "DATE '2026-03-31'"))
def _(spark, sf):
    return show(profile_of(spark, sf, "2026-03-31"))


@case("offer_options", query("SELECT * FROM options"))
def _(spark, sf):
    return show(offer_options(profile_of(spark, sf), policy_of(spark)))


@case("featured_option", query("SELECT customer_id, product_code, option_code, term_months, offer_max_amount_usd FROM options WHERE is_featured"))
def _(spark, sf):
    return featured_options(offer_options(profile_of(spark, sf), policy_of(spark))).select(
        "customer_id", "product_code", "option_code", "term_months", "offer_max_amount_usd")


@case("recalculated_offers", query("SELECT * FROM re_options"))
def _(spark, sf):
    redone = offers.recalculate(profile_of(spark, sf), recast.raw(spark, sf, "declarations"), policy_of(spark))
    said = F.from_json("customer_declared_data", ", ".join(f"{a} double" for a in offers.AMOUNTS))
    return show(redone.withColumn("_said", said).select("*", "_said.*").drop("_said", "customer_declared_data"))


# --- accepted offers ---------------------------------------------------------

def _acceptances(spark, sf):
    """One acceptance per available option; amounts too high or negative for some terms, shared ids."""
    policy = policy_of(spark)
    profile = offers.undeclared(profile_of(spark, sf))
    options = checkpointed(offer_options(profile, policy, offers.CARRY))
    factor = F.when(F.col("term_months") >= 240, 2.0).when(F.col("term_months") == 36, -1.0).otherwise(0.9)
    taken = options.filter("is_available").select(
        F.concat_ws("-", F.lit("F"), "product_code", "term_months", F.substring("customer_id", 1, 3)).alias("offer_id"),
        "customer_id", "option_code", "term_months", (F.col("offer_max_amount_usd") * factor).alias("accepted_amount_usd"),
        F.lit("s").alias("session_id"), F.lit("chat").alias("channel"), F.lit("es").alias("language"),
        F.lit("2026-07-01 10:00:00").cast("timestamp").alias("accepted_at"))
    return offers.accepted_offers(options, taken, policy), policy


# all 42 columns of the record, and why it is refused
_RECORD = f"""
    SELECT concat_ws('-', 'F', product_code, term_months, substr(customer_id, 1, 3)) AS offer_id, customer_id, 's' AS session_id,
      'chat' AS channel, 'es' AS language, CASE WHEN offer_mode = 'proactive' THEN 'proactive' ELSE 'customer_interest' END AS offer_origin,
      option_code, product_code, product_type, tier, term_months, amt AS amount_usd, offer_rate_pct AS annual_rate_pct,
      {rnd('inst_now', 2)} AS monthly_installment_usd, local_currency, fx_to_usd, fx_date, round(amt / fx_to_usd) AS amount_local,
      round(inst_now / fx_to_usd) AS monthly_installment_local, income_used_usd, income_source, debt_now AS current_installments_usd,
      max_total_installment_usd, {rnd('dti', 4)} AS debt_to_income_after, risk_band, segment, total_rate_adjustment_pp AS rate_adjustment_pp,
      CAST(NULL AS VARCHAR) AS customer_declared_data, CAST(oc AS INTEGER) AS open_complaints,
      CAST(open_priority_complaints AS INTEGER) AS open_priority_complaints, CAST(open_critical_complaints AS INTEGER) AS open_critical_complaints,
      false AS is_conditional, CASE WHEN oc > 0 THEN 'F04_OPEN_COMPLAINTS' ELSE '' END AS flags, 'identity_document' AS required_documents,
      'accepted' AS status, CAST(NULL AS VARCHAR) AS handoff_ticket_id, CAST(NULL AS VARCHAR) AS advisor_summary,
      DATE '2026-07-31' AS valid_until, as_of_date AS profile_as_of_date, policy_version, '2026-07-01 10:00:00.000000' AS created_at,
      CAST(NULL AS VARCHAR) AS updated_at, concat_ws(',', CASE WHEN amt < option_min_amount_usd THEN 'below_minimum' END,
        CASE WHEN amt > option_max_amount_usd THEN 'above_maximum' END) AS refusal_reasons,
      concat_ws(',', CASE WHEN amt < option_min_amount_usd THEN 'below_minimum' END, CASE WHEN amt > option_max_amount_usd THEN 'above_maximum' END,
        CASE WHEN amt <= 0 THEN 'positive_amounts' END, CASE WHEN dti > 2e-1 + 1e-9 THEN 'within_debt_limit' END) AS broken
    FROM (SELECT *, {installment('amt', 'offer_rate_pct', 'term_months')} AS inst_now,
        (debt_now + {installment('amt', 'offer_rate_pct', 'term_months')}) / income_used_usd AS dti
      FROM (SELECT *, offer_max_amount_usd * (CASE WHEN term_months >= 240 THEN 2e0 WHEN term_months = 36 THEN -1e0 ELSE 9e-1 END) AS amt
        FROM options JOIN (SELECT customer_id, income_used_usd, income_source, max_total_installment_usd, fx_date,
            current_installments_usd AS debt_now, open_complaints AS oc, open_priority_complaints, open_critical_complaints
          FROM profile) USING (customer_id)
        WHERE is_available))"""


@case("accepted_offers", query(f"SELECT * EXCLUDE (broken) FROM ({_RECORD})"))
def _(spark, sf):
    record, _ = _acceptances(spark, sf)
    return show(record, {"debt_to_income_after": 4})


@case("accepted_offers_valid", query(f"""
    SELECT * EXCLUDE (broken) FROM ({_RECORD}) WHERE broken = ''
    QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY customer_id DESC, option_code DESC) = 1"""))
def _(spark, sf):
    record, policy = _acceptances(spark, sf)
    accepted, _ = validate(record, None, **offers.offer_rules(policy))
    return show(accepted, {"debt_to_income_after": 4})


@case("accepted_offers_rejected", query(f"""
    SELECT offer_id, customer_id, option_code, CASE WHEN broken = '' THEN 'duplicate key' ELSE broken END AS _violations,
      CAST(1 AS BIGINT) AS _copies
    FROM (SELECT *, row_number() OVER (PARTITION BY offer_id, broken = '' ORDER BY customer_id DESC, option_code DESC) AS nth FROM ({_RECORD}))
    WHERE broken <> '' OR nth > 1"""))
def _(spark, sf):
    record, policy = _acceptances(spark, sf)
    _, refused = validate(record, None, **offers.offer_rules(policy))
    return show(refused.select("offer_id", "customer_id", "option_code", "_violations", F.col("_copies").cast("bigint").alias("_copies")))


# --- summaries and derivation ------------------------------------------------

@case("products_summary", query(
    f"SELECT * REPLACE ({rnd('total_credit_limit_usd', 2)} AS total_credit_limit_usd, {rnd('total_current_balance_usd', 2)} AS total_current_balance_usd, "
    f"{rnd('avg_credit_interest_rate', 2)} AS avg_credit_interest_rate, {rnd('avg_days_past_due', 1)} AS avg_days_past_due) FROM products_sum"))
def _(spark, sf):
    df = summaries.products_summary(clean(spark, sf, "products"), clean(spark, sf, "daily_exchange_rates"), policy_of(spark))
    return show(df, {"total_credit_limit_usd": 2, "total_current_balance_usd": 2})


@case("complaints_summary", query("SELECT * FROM complaints_sum"))
def _(spark, sf):
    df = summaries.complaints_summary(clean(spark, sf, "complaints"), clean(spark, sf, "daily_exchange_rates"))
    return show(df, {"total_claimed_amount_usd": 2, "total_compensation_granted_usd": 2,
                     "avg_resolution_days": 4, "avg_resolution_satisfaction": 4})


@case("cashflow_summary", query("SELECT * FROM cashflow_sum"))
def _(spark, sf):
    df = summaries.cashflow_summary(clean(spark, sf, "transactions"), clean(spark, sf, "daily_exchange_rates"))
    return show(df, {c: 2 for c in df.columns if c.endswith("_usd_90d")})


# The rule: open cases are complaints with an open status, of any age up to the cutoff, and contacts of the
# 90 days up to the cutoff that were left unresolved, need more work, and led to no complaint.
@case("case_context", query(f"""
    SELECT * FROM (WITH
    led_to_complaint AS (SELECT DISTINCT origin_interaction_id AS interaction_id FROM silver_complaints WHERE origin_interaction_id IS NOT NULL),
    cases AS (
      SELECT customer_id, 'complaint' AS case_source, complaint_id AS case_id, CAST(creation_date AS DATE) AS opened_on,
        reception_channel AS channel, category, case_type, priority, status, sla_breached, is_repeat_complainer, NULL AS sentiment,
        status = 'Escalated' AS is_escalated
      FROM silver_complaints WHERE status IN {OPEN_STATUSES}
      UNION ALL BY NAME
      SELECT customer_id, 'interaction' AS case_source, interaction_id AS case_id, CAST(interaction_date AS DATE) AS opened_on,
        channel, reason_category AS category, 'Unresolved' AS status, detected_sentiment AS sentiment, was_escalated AS is_escalated
      FROM silver_call_center_interactions ANTI JOIN led_to_complaint USING (interaction_id)
      WHERE NOT was_resolved AND (coalesce(requires_followup, false) OR coalesce(was_escalated, false))
        AND date_diff('day', CAST(interaction_date AS DATE), {{as_of}}) < 90)
    SELECT customer_id, case_source, case_id, opened_on, channel, category, case_type, priority, status, sentiment,
      coalesce(is_escalated, false) AS is_escalated, coalesce(sla_breached, false) AS sla_breached,
      coalesce(is_repeat_complainer, false) AS is_repeat_complainer,
      CAST(date_diff('day', opened_on, {{as_of}}) AS INTEGER) AS days_open, {{as_of}} AS as_of_date
    FROM cases WHERE opened_on <= {{as_of}})"""))
def _(spark, sf):
    return summaries.case_context(clean(spark, sf, "complaints"), clean(spark, sf, "call_center_interactions"), policy_of(spark))


@case("observed_catalog", query(f"""
    SELECT country, product_type, h.ccy AS local_currency, {big('count(*)')} AS active_products,
      {big('count(DISTINCT customer_id)')} AS customers, {rnd("100.0 * avg(CAST(currency = 'USD' AS INTEGER))", 1)} AS pct_usd_denominated,
      {rnd('min(interest_rate)', 2)} AS rate_min, {rnd('quantile_cont(interest_rate, 0.5)', 2)} AS rate_p50, {rnd('max(interest_rate)', 2)} AS rate_max,
      round(min(usd)) AS amount_usd_min, round(quantile_cont(usd, 0.5)) AS amount_usd_p50, round(max(usd)) AS amount_usd_max,
      round(min(usd) / hx.to_usd) AS amount_local_min, round(quantile_cont(usd, 0.5) / hx.to_usd) AS amount_local_p50,
      round(max(usd) / hx.to_usd) AS amount_local_max
    FROM (SELECT p.*, p.credit_limit * x.to_usd AS usd FROM silver_products p JOIN fx_end x ON x.ccy = p.currency
      WHERE p.product_status = 'Active' AND p.product_type IN ('Tarjeta Crédito', 'Préstamo Personal', 'Préstamo Hipotecario'))
    JOIN (SELECT customer_id, country FROM silver_customers) USING (customer_id) JOIN homes h USING (country)
    JOIN fx_end hx ON hx.ccy = h.ccy GROUP BY country, product_type, h.ccy, hx.to_usd"""))
def _(spark, sf):
    return derivation.observed_catalog(clean(spark, sf, "customers"), clean(spark, sf, "products"),
                                       clean(spark, sf, "daily_exchange_rates"), policy_of(spark))


@case("quantile_grid", query("""
    SELECT CASE WHEN t.tier IS NULL THEN c.product_code ELSE c.product_code || '-' || t.tier_code END AS product_code,
      c.product_type, t.tier, c.term AS term_months, CAST(c.term // 12 AS INTEGER) AS term_years,
      round(r[coalesce(t.rate_pct, CAST(round(100 * k / (n + 1)) AS INTEGER)) + 1], 1) AS reference_rate_pct,
      greatest(CAST(round(a[coalesce(t.limit_from_pct, CAST(round(100 * (k - 1) / n) AS INTEGER)) + 1], -3) AS INTEGER), min_amount_usd) AS min_amount_usd,
      least(CAST(round(a[coalesce(t.limit_to_pct, CAST(round(100 * k / n) AS INTEGER)) + 1], -3) AS INTEGER), max_amount_usd) AS max_amount_usd,
      true AS is_synthetic
    FROM (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY term) AS k, count(*) OVER (PARTITION BY product_code) AS n
      FROM (SELECT * EXCLUDE (allowed_terms_months), CAST(unnest(string_split(allowed_terms_months, '|')) AS INTEGER) AS term FROM ref_product_catalog)) c
    LEFT JOIN card_tiers t ON c.product_code = 'CC'
    JOIN (SELECT product_type AS pt, quantile_cont(interest_rate, [i / 100 FOR i IN range(101)]) AS r,
        quantile_cont(credit_limit * to_usd, [i / 100 FOR i IN range(101)]) AS a
      FROM silver_products JOIN fx_end ON ccy = currency WHERE product_status = 'Active' GROUP BY product_type) o ON o.pt = c.source_product_type"""))
def _(spark, sf):
    return derivation.term_grid(clean(spark, sf, "products"), clean(spark, sf, "daily_exchange_rates"), policy_of(spark))


# --- quality -----------------------------------------------------------------

def _metric_sql(entity: str) -> str:
    spec = ENTITIES[entity]
    raw, clean_, keys = f"raw_{entity}", f"silver_{entity}", spec.key
    null_key = " OR ".join(f"{k} IS NULL" for k in keys)
    one = (f"SELECT (SELECT count(*) FROM {raw}) AS b, (SELECT count(*) FROM {raw} WHERE {null_key}) AS nk, "
           f"(SELECT count(*) FROM {raw} WHERE _rescued_data IS NOT NULL) AS r, (SELECT count(*) FROM {clean_}) AS s, "
           f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {clean_})) AS dk")
    rows = [
        ("bronze", "rows", "b", "> 0", "b > 0", "fail"),
        ("bronze", "rescued_rows", "r", "= 0 (warn: schema change or malformed rows)", "r = 0", "warn"),
        ("bronze", "null_key_rows", "nk", "= 0 (warn: dropped in silver)", "nk = 0", "warn"),
        ("silver", "rows", "s", "> 0", "s > 0", "fail"),
        ("silver", "key_duplicates_removed_share", rnd("(b - nk - s) / b", 4), "<= 0.05", "(b - nk - s) / b <= 0.05", "fail"),
        ("silver", "key_duplicate_rows_left", "s - dk", "= 0", "s = dk", "fail"),
    ]
    if spec.content_key:
        have = " AND ".join(f"{c} IS NOT NULL" for c in spec.content_key)
        dup = (f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {clean_} WHERE {have} "
               f"GROUP BY {', '.join(spec.content_key)}))")
        rows.append(("silver", "content_duplicate_rows", dup, "= 0 (warn: same record under another id)", f"{dup} = 0", "warn"))
    for column, limit in spec.max_null_share.items():
        share = f"(SELECT avg(CAST({column} IS NULL AS INTEGER)) FROM {clean_})"
        rows.append(("silver", f"null_share_{column}", rnd(share, 4), f"<= {limit:.2f}", f"{share} <= {limit}", "fail"))
    return " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{entity}' AS table_name, '{m}' AS metric, CAST({v} AS DOUBLE) AS value, "
        f"'{t}' AS threshold, CASE WHEN {ok} THEN 'ok' ELSE '{bad}' END AS status FROM ({one})"
        for layer, m, v, t, ok, bad in rows)


_METRICS_SQL = " UNION ALL ".join(_metric_sql(e) for e in ENTITIES)


def _source_metrics(spark, sf):
    raws = {e: bronze(spark, sf, e) for e in ENTITIES}
    return source_metrics(raws, {e: silver(df, e) for e, df in raws.items()})


@case("silver_metrics", query(_METRICS_SQL))
def _(spark, sf):
    return _source_metrics(spark, sf)


@case("gate_status", query(f"""
    SELECT {big('count(*)')} AS n_metrics, {n_if("status = 'warn'")} AS n_warn, {n_if("status = 'fail'")} AS n_fail
    FROM ({_METRICS_SQL})"""))
def _(spark, sf):
    return gate_status(_source_metrics(spark, sf)).drop("failures")


@case("bronze_load_report", query(" UNION ALL ".join(
    f"SELECT '{e}' AS table_name, {big('count(*)')} AS n_rows, {big('count(_rescued_data)')} AS rescued_rows FROM raw_{e}" for e in ENTITIES)))
def _(spark, sf):
    return load_report({e: bronze(spark, sf, e) for e in ENTITIES})


_GOLD_SQL = """
    SELECT 'gold' AS layer, table_name, metric, CAST(value AS DOUBLE) AS value, threshold,
      CASE WHEN good THEN 'ok' ELSE 'fail' END AS status FROM (
      SELECT 'customer_credit_profile' AS table_name, 'rows_vs_silver_customers' AS metric, (SELECT count(*) FROM profile) AS value,
        '= silver customers (' || (SELECT count(*) FROM silver_customers) || ') and = distinct ids (' || (SELECT count(DISTINCT customer_id) FROM profile) || ')' AS threshold,
        (SELECT count(*) = count(DISTINCT customer_id) FROM profile) AND (SELECT count(*) FROM profile) = (SELECT count(*) FROM silver_customers) AS good
      UNION ALL SELECT 'customer_credit_profile', 'rows_missing_cutoff_policy_or_fx', count(*) FILTER (WHERE fx_to_usd IS NULL), '= 0',
        count(*) FILTER (WHERE fx_to_usd IS NULL) = 0 FROM profile
      UNION ALL SELECT 'customer_credit_profile', 'policy_versions_in_profile', count(DISTINCT policy_version),
        '= 1 and = silver policy_version 0.4 (profile: ' || max(policy_version) || ')', count(DISTINCT policy_version) = 1 FROM profile
      UNION ALL SELECT 'customer_credit_profile', 'eligible_share', round(avg(CAST(is_eligible AS INTEGER)), 4), '0.20-0.50',
        avg(CAST(is_eligible AS INTEGER)) BETWEEN 0.2 AND 0.5 FROM profile
      UNION ALL SELECT 'customer_credit_offer_options', 'rows_vs_customers_x_grid', count(*), '= ' || (SELECT 12 * count(*) FROM profile),
        count(*) = (SELECT 12 * count(*) FROM profile) FROM options
      UNION ALL SELECT 'customer_credit_offer_options', 'available_above_capacity', count(*), '= 0', count(*) = 0
        FROM options o JOIN profile p USING (customer_id) WHERE is_available AND offer_monthly_installment_usd > available_installment_usd + 0.01
      UNION ALL SELECT 'customer_credit_offer_options', 'available_above_band_max_term', count(*), '= 0', count(*) = 0
        FROM options o JOIN profile p USING (customer_id) WHERE is_available AND term_months >
          CASE product_code WHEN 'PL' THEN max_term_personal_loan_months WHEN 'MG' THEN max_term_mortgage_months ELSE 999 END
      UNION ALL SELECT 'customer_credit_offer_options', 'available_out_of_range_or_not_eligible', count(*), '= 0', count(*) = 0
        FROM options WHERE is_available AND (offer_max_amount_usd NOT BETWEEN option_min_amount_usd AND option_max_amount_usd
          OR unavailable_reason IS NOT NULL OR offer_mode = 'none')
      UNION ALL SELECT 'customer_credit_offer_options', 'featured_option_violations', count(*), '= 0', count(*) = 0
        FROM (SELECT 1 FROM options GROUP BY customer_id, product_code
          HAVING count(*) FILTER (WHERE is_featured) <> CAST(bool_or(is_available) AS INTEGER) OR bool_or(is_featured AND NOT is_available))
      UNION ALL SELECT 'customer_products_summary', 'duplicate_customer_rows', count(*) - count(DISTINCT customer_id), '= 0',
        count(*) = count(DISTINCT customer_id) FROM products_sum
      UNION ALL SELECT 'customer_complaints_summary', 'duplicate_customer_rows', count(*) - count(DISTINCT customer_id), '= 0',
        count(*) = count(DISTINCT customer_id) FROM complaints_sum
      UNION ALL SELECT 'customer_cashflow_summary', 'duplicate_customer_rows', count(*) - count(DISTINCT customer_id), '= 0',
        count(*) = count(DISTINCT customer_id) FROM cashflow_sum
      UNION ALL SELECT 'customer_credit_profile', 'contract_violations', 0, '= 0', true
      UNION ALL SELECT 'customer_credit_offer_options', 'contract_violations', 0, '= 0', true)"""


@case("gold_metrics", query(_GOLD_SQL))
def _(spark, sf):
    policy, inputs = policy_of(spark), stored_inputs(spark, sf)
    profile, fx = checkpointed(credit_profile(inputs, policy)), inputs["daily_exchange_rates"]
    sums = {
        "customer_products_summary": summaries.products_summary(inputs["products"], fx, policy),
        "customer_complaints_summary": summaries.complaints_summary(inputs["complaints"], fx),
        "customer_cashflow_summary": summaries.cashflow_summary(inputs["transactions"], fx),
    }
    return gold_metrics(profile, checkpointed(offer_options(profile, policy)), sums, inputs["customers"], policy)


@case("export_manifest", query(f"""
    SELECT table_name, {big('n')} AS n_rows, '2026-06-30' AS as_of_date, '0.4' AS policy_version FROM (
      SELECT 'customer_credit_profile' AS table_name, count(*) AS n FROM silver_customers
      UNION ALL SELECT 'customer_credit_offer_options', count(*) * 12 FROM silver_customers
      UNION ALL SELECT 'ref_product_catalog', count(*) FROM ref_product_catalog
      UNION ALL SELECT 'ref_term_grid', count(*) FROM ref_term_grid
      UNION ALL SELECT 'ref_policy_params', count(*) FROM ref_policy_params
      UNION ALL SELECT 'ref_policy_bands', count(*) FROM ref_policy_bands
      UNION ALL SELECT 'ref_segment_adjustments', count(*) FROM ref_segment_adjustments)"""))
def _(spark, sf):
    policy, path = policy_of(spark), scratch_path(spark, "export")
    profile = checkpointed(profile_of(spark, sf))
    publish(spark, {
        "customer_credit_profile": profile,
        "customer_credit_offer_options": offer_options(profile, policy),
        **{name: policy.tables[name] for name in POLICY_TABLES},
    }, path, {"run_id": "manual", "as_of_date": str(policy.as_of_date), "policy_version": policy.policy_version})
    return read_manifest(spark, path).drop("exported_at", "run_id", "folder")


# --- the five delivery cases -------------------------------------------------

def with_delivery(complaints: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The raw tables after a further delivery: a new status, an exact copy, a late record,
    an unknown column and a missing key."""
    def row(df: DataFrame, key: str, pick, only=F.lit(True), **changes) -> DataFrame:
        chosen = df.filter(only).agg(pick(key)).scalar()
        return df.filter(F.col(key) == chosen).limit(1).withColumns(
            {c: v.cast(df.schema[c].dataType) for c, v in changes.items()})

    first, last = F.min, F.max
    later = F.date_add(F.to_date("process_date"), 5)
    new_complaints = row(complaints, "complaint_id", first, F.col("status") == "Open",
                         status=F.lit("Resolved"), process_date=later, resolution_date=later)
    late = row(complaints, "complaint_id", last, complaint_id=F.lit("FIXTURE-LATE-0001"),
               creation_date=F.lit("2024-01-15 10:00:00"), process_date=F.lit("2026-06-20"))
    copy = row(transactions, "transaction_id", first)
    rescued = row(transactions, "transaction_id", last, transaction_id=F.lit("FIXTURE-RESCUED-0001"),
                  _rescued_data=F.lit('{"loyalty_points":"120"}'))
    keyless = row(transactions, "transaction_id", last, transaction_id=F.lit(None))
    return (add_by_name(add_by_name(complaints, new_complaints), late),
            add_by_name(add_by_name(add_by_name(transactions, copy), rescued), keyless))


@case("fixture_cases", query("""
    SELECT 'late_status_update' AS case_name, min(complaint_id) AS record_key, CAST(1 AS BIGINT) AS silver_rows, 'Resolved' AS detail
      FROM raw_complaints WHERE status = 'Open'
    UNION ALL SELECT 'exact_duplicate', min(transaction_id), CAST(1 AS BIGINT), NULL FROM raw_transactions
    UNION ALL SELECT 'late_arrival', 'FIXTURE-LATE-0001', CAST(1 AS BIGINT), '2024-01-15'
    UNION ALL SELECT 'schema_change', 'FIXTURE-RESCUED-0001', CAST(1 AS BIGINT), CAST(1 + count(_rescued_data) AS VARCHAR) FROM raw_transactions
    UNION ALL SELECT 'null_key', NULL, CAST(0 AS BIGINT), CAST(1 + count(*) AS VARCHAR) FROM raw_transactions WHERE transaction_id IS NULL"""))
def _(spark, sf):
    before_c, before_t = bronze(spark, sf, "complaints"), bronze(spark, sf, "transactions")
    complaints, transactions = with_delivery(before_c, before_t)
    done_c, done_t = silver(complaints, "complaints"), silver(transactions, "transactions")

    def outcome(name: str, df: DataFrame, key: str, wanted, detail) -> DataFrame:
        found = df.filter(F.col(key).eqNullSafe(wanted)).agg(
            F.count(F.lit(1)).alias("silver_rows"),
            F.max("status" if name == "late_status_update" else F.lit(None)).alias("_status"),
            (F.max(F.to_date("creation_date")) if name == "late_arrival" else F.lit(None)).alias("_day"))
        return found.select(F.lit(name).alias("case_name"), wanted.alias("record_key"), "silver_rows",
                            detail.cast("string").alias("detail"))

    open_id = before_c.filter("status = 'Open'").agg(F.min("complaint_id")).scalar()
    first_id = before_t.agg(F.min("transaction_id")).scalar()
    rescued = transactions.agg(F.count("_rescued_data")).scalar()
    keyless = transactions.agg(F.count_if(F.col("transaction_id").isNull())).scalar()
    nothing = F.lit(None).cast("string")
    rows = [
        outcome("late_status_update", done_c, "complaint_id", open_id, F.col("_status")),
        outcome("exact_duplicate", done_t, "transaction_id", first_id, nothing),
        outcome("late_arrival", done_c, "complaint_id", F.lit("FIXTURE-LATE-0001"), F.col("_day")),
        outcome("schema_change", done_t, "transaction_id", F.lit("FIXTURE-RESCUED-0001"), rescued),
        outcome("null_key", done_t, "transaction_id", nothing, keyless),
    ]
    result = rows[0]
    for r in rows[1:]:
        result = result.unionByName(r)
    return result
