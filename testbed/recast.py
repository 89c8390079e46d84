"""The driver's tables recast as the bank's raw tables.

The SELECTs use only SQL that Spark and DuckDB read the same way, so both sides
of a comparison start from the same rows; what is compared comes after.  Every
raw column is a STRING.  Some rows are delivered twice (``d`` is the delivery):
the second time later and changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

ORDER_SHIFT = 9086  # moves order dates to 2019-11 ... 2026-06
EVENT_SHIFT = 880   # moves event dates to 2026-06
SPREAD_ROWS = 1_000_000

_TWICE = "(SELECT 1 AS d UNION ALL SELECT 2 AS d) twice"
_LOADED = "CAST('2026-07-0' || CAST(d AS STRING) || ' 00:00:00' AS TIMESTAMP) AS _bronze_ingested_at"
_CLEAN = f"CAST(NULL AS STRING) AS _rescued_data, {_LOADED}"


def _day(expr: str, shift: int, plus: str = "0") -> str:
    return f"CAST(CAST({expr} AS DATE) + {shift} + CAST({plus} AS INT) AS STRING)"


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'true' ELSE 'false' END"


def _pick(expr: str, *values: str | None) -> str:
    cases = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {cases} END"


_COUNTRY = _pick("c_nationkey", "México", "Colombia", "Argentina")
_USD_PER = {"MXN": "5.71433e-2", "COP": "2.43517e-4", "ARS": "1.01731e-3", "USD": "1e0"}


def _usd_per(currency: str) -> str:
    cases = " ".join(f"WHEN '{c}' THEN {r}" for c, r in _USD_PER.items())
    return f"(CASE {currency} {cases} END)"


_ORDER_CCY = _pick("o_orderkey", "MXN", "COP", "ARS", "USD")
_LINE_CCY = _pick("l_suppkey", "MXN", "COP", "ARS", "USD")
_HOME_CCY = _pick("c_nationkey", "MXN", "COP", "ARS")
_DAYS = {
    "spark": "SELECT explode(sequence(lo, hi)) AS day FROM bounds",
    "duckdb": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds",
}

RAW: dict[str, str] = {
    "raw_branches": f"""
        SELECT 'B' || {_text('s_suppkey')} AS branch_id, 'BC' || {_text('s_suppkey % 97')} AS branch_code,
          s_name AS branch_name, {_pick('s_suppkey', 'Urban', 'Rural')} AS branch_type,
          CASE WHEN d = 2 THEN 'Closed' ELSE 'Open' END AS branch_status,
          'Street ' || {_text('s_suppkey')} AS address, 'City ' || {_text('s_nationkey')} AS city,
          'State ' || {_text('s_nationkey')} AS state, {_pick('s_nationkey', 'México', 'Colombia', 'Argentina')} AS country,
          {_text('10000 + s_suppkey')} AS postal_code, {_text('s_acctbal / 211')} AS latitude,
          {_text('s_acctbal / -97')} AS longitude, '555-' || {_text('s_suppkey')} AS phone,
          lower(s_name) || '@bank.test' AS email, '08:30' AS opening_time, '16:00' AS closing_time,
          CAST(DATE '2001-02-03' + CAST(s_suppkey * 5 AS INT) AS STRING) AS branch_opening_date,
          {_flag('s_acctbal > 0')} AS has_atms, {_text('s_suppkey % 9')} || '.0' AS atm_count,
          {_flag('s_nationkey > 3')} AS has_teller_windows,
          CASE WHEN s_nationkey > 3 THEN {_text('s_suppkey % 5')} || '.0' END AS teller_window_count,
          'Zone ' || {_text('s_nationkey % 4')} AS geographic_zone, {_CLEAN}
        FROM supplier CROSS JOIN {_TWICE} WHERE d = 1 OR s_acctbal < 0""",
    "raw_service_agents": f"""
        SELECT 'A' || {_text('s_suppkey')} AS agent_id, 'E' || {_text('s_suppkey % 99')} AS employee_code,
          s_name AS first_name, 'Agent' AS last_name, lower(s_name) || '@bank.test' AS email,
          '556-' || {_text('s_suppkey')} AS phone, {_pick('s_suppkey', 'Phone', 'Chat', 'Branch')} AS agent_type,
          CASE WHEN d = 2 THEN 'On leave' ELSE 'Active' END AS agent_status,
          'B' || {_text('s_suppkey')} AS assigned_branch_id,
          CAST(DATE '2012-05-06' + CAST(s_suppkey * 3 AS INT) AS STRING) AS hire_date,
          {_pick('s_suppkey', 'Junior', 'Senior')} AS experience_level, 'Cards' AS specialty,
          'es,pt' AS languages, {_pick('s_nationkey', 'mexican', 'colombian', 'argentine')} AS native_accent,
          {_pick('s_nationkey', 'México', 'Colombia', 'Argentina')} AS country_of_origin,
          {_pick('s_suppkey', 'Day', 'Night')} AS work_shift,
          {_text('s_acctbal / 2003')} AS avg_csat,
          {_text('s_suppkey * 7')} || '.0' AS total_monthly_interactions, {_CLEAN}
        FROM supplier CROSS JOIN {_TWICE} WHERE d = 1 OR s_acctbal < 0""",
    "raw_marketing_campaigns": f"""
        SELECT 'K' || {_text('p_partkey')} AS campaign_id, p_name AS campaign_name, p_type AS campaign_type,
          'Sell ' || p_brand AS campaign_objective,
          CASE WHEN d = 2 THEN 'Finished' ELSE 'Running' END AS campaign_status,
          p_name || ' for ' || p_brand AS description,
          CAST(DATE '2025-01-01' + CAST(p_size AS INT) AS STRING) AS start_date,
          CAST(DATE '2025-03-01' + CAST(p_size AS INT) AS STRING) AS end_date,
          {_text('p_retailprice * 11')} AS budget, {_text('p_size / 1.73e2')} AS expected_conversion_rate,
          {_pick('p_partkey', 'Premium', 'Plus', 'Basic', 'Student')} AS target_segment,
          {_pick('p_partkey', 'México', 'Colombia', 'Argentina')} AS target_country,
          {_pick('p_partkey', 'CC', 'PL', 'MG')} AS promoted_product, {_CLEAN}
        FROM part CROSS JOIN {_TWICE} WHERE d = 1 OR p_size > 40""",
    "raw_campaign_sends": f"""
        SELECT 'S' || {_text('event_id')} AS send_id, 'K' || {_text('event_id % 200')} AS campaign_id,
          CASE WHEN value < 400 THEN 'C' || {_text('user_id')} END AS customer_id,
          {_day('ts', EVENT_SHIFT)} || ' 09:00:00' AS send_date, {_day('ts', EVENT_SHIFT, 'd - 1')} AS process_date,
          CASE WHEN value > 50 THEN ' Email' ELSE 'SMS ' END AS send_channel, 'T1' AS template_used,
          'Hello ' || {_text('user_id')} AS subject,
          CASE WHEN event_type = 'error' THEN ' Failed ' ELSE 'Sent' END AS send_status,
          {_flag("event_type <> 'error'")} AS was_delivered, {_flag("event_type IN ('click', 'purchase')")} AS was_opened,
          CASE WHEN event_type IN ('click', 'purchase') THEN {_day('ts', EVENT_SHIFT, '1')} || ' 10:00:00' END AS open_date,
          {_flag("event_type = 'click'")} AS was_clicked,
          CASE WHEN event_type = 'click' THEN {_day('ts', EVENT_SHIFT, '1')} || ' 10:05:00' END AS click_date,
          CASE WHEN event_type = 'click' THEN {_text('event_id % 4')} || '.0' END AS click_count,
          {_flag("event_type = 'purchase'")} AS had_conversion,
          CASE WHEN event_type = 'purchase' THEN {_day('ts', EVENT_SHIFT, '2')} || ' 11:00:00' END AS conversion_date,
          CASE WHEN event_type = 'purchase' THEN {_text('value')} END AS conversion_value,
          'Phone' AS open_device, {_pick('user_id', 'México', 'Colombia', 'Argentina')} AS open_country,
          CASE WHEN event_type = 'error' THEN 'bounce' END AS failure_reason,
          {_text('value / 1009')} AS send_cost, {_CLEAN}
        FROM events CROSS JOIN {_TWICE} WHERE d = 1 OR value > 100""",
    "raw_complaints": f"""
        SELECT 'Q' || {_text('event_id')} AS complaint_id,
          {_day('ts', EVENT_SHIFT)} || substr({_text('ts')}, 11) AS creation_date,
          {_day('ts', EVENT_SHIFT, '(d - 1) * 5')} AS process_date,
          CASE WHEN value < 400 THEN 'C' || {_text('user_id')} END AS customer_id,
          {_pick('event_id', 'Claim', 'Complaint', 'Request', 'Suggestion')} AS case_type,
          'Category ' || event_type AS category, 'Sub ' || event_type AS subcategory,
          {_pick('event_id', 'Branch', 'Phone', 'App')} AS reception_channel,
          'P' || {_text('event_id')} AS affected_product_id, 'B' || {_text('event_id % 50')} AS related_branch_id,
          CASE WHEN event_type = 'error' THEN 'I' || {_text('event_id')} END AS origin_interaction_id,
          'Case, with "quotes" ' || {_text('event_id')} AS description,
          CASE WHEN event_type <> 'view' THEN {_text('value * 1.0137e1')} END AS claimed_amount,
          {_pick('event_id', 'MXN', 'COP', 'ARS', 'USD', 'MXN')} AS currency,
          {_pick('(event_id + user_id)', 'Low', 'Medium', 'High', 'Low', 'Medium', 'Low', 'Critical', 'Low', 'Medium')} AS priority,
          CASE WHEN d = 2 THEN 'Resolved' WHEN event_type = 'view' THEN 'Open' WHEN event_type = 'error' THEN 'Escalated'
               WHEN event_type = 'click' THEN 'In Process' WHEN event_type = 'signup' THEN 'Closed' ELSE 'Rejected' END AS status,
          'A' || {_text('event_id % 60')} AS assigned_agent_id,
          {_day('ts', EVENT_SHIFT)} || ' 12:00:00' AS assignment_date,
          {_day('ts', EVENT_SHIFT, '1')} || ' 12:00:00' AS first_response_date,
          CASE WHEN d = 2 THEN {_day('ts', EVENT_SHIFT, '5')} END AS resolution_date,
          CASE WHEN event_type = 'signup' THEN {_day('ts', EVENT_SHIFT, '9')} END AS closing_date,
          {_flag('value > 60')} AS sla_breached,
          CASE WHEN d = 2 THEN {_text('value / 7.3e0')} END AS resolution_days,
          CASE WHEN d = 2 THEN 'Refund' END AS resolution,
          CASE WHEN d = 2 THEN {_text('value * 3.317e0')} END AS compensation_granted,
          CASE WHEN d = 2 THEN {_text('value / 113')} END AS resolution_satisfaction,
          CASE WHEN event_type = 'purchase' THEN NULL ELSE {_flag('user_id % 9 = 0')} END AS is_repeat_complainer, {_CLEAN}
        FROM events CROSS JOIN {_TWICE} WHERE d = 1 OR value > 100""",
    "raw_call_center_interactions": f"""
        SELECT 'I' || {_text('event_id')} AS interaction_id,
          {_day('ts', 700, '(event_id * 7) % 200')} || substr({_text('ts')}, 11) AS interaction_date,
          {_day('ts', 700, '(event_id * 7) % 200 + d - 1')} AS process_date,
          CASE WHEN value < 400 THEN 'C' || {_text('user_id')} END AS customer_id,
          'A' || {_text('event_id % 60')} AS agent_id, {_pick('event_id', 'Phone', 'Chat')} AS channel,
          event_type AS interaction_type, 'Reason ' || event_type AS contact_reason,
          'Group ' || event_type AS reason_category, 'CC,PL' AS mentioned_products,
          {_text('event_id % 900')} || '.0' AS duration_seconds, {_text('event_id % 60')} || '.0' AS wait_time_seconds,
          CASE WHEN event_type = 'signup' THEN NULL ELSE {_flag("event_type IN ('purchase')")} END AS was_resolved,
          {_flag('value > 30')} AS requires_followup,
          CASE WHEN value > 200 THEN NULL ELSE {_flag("event_type = 'error'")} END AS was_escalated,
          'yes' AS has_recording, '0' AS has_transcript,
          {_pick('event_id', 'negative', 'neutral', 'positive')} AS detected_sentiment,
          {_text('value / 521')} AS sentiment_score, 'mexican' AS customer_detected_accent,
          'colombian' AS agent_used_accent, {_CLEAN}
        FROM events CROSS JOIN {_TWICE} WHERE d = 1 OR value > 100""",
    "raw_customers": f"""
        SELECT 'C' || {_text('c_custkey')} AS customer_id, 'Name ' || {_text('c_custkey % 50')} AS first_name,
          c_name AS last_name, lower(c_name) || '@mail.test' AS email, 'ID' AS document_type,
          'D' || {_text('c_custkey')} AS document_number,
          CASE WHEN c_custkey % 23 = 0 THEN NULL
               ELSE CAST(DATE '1944-01-15' + CAST((c_custkey * 101) % 22000 AS INT) AS STRING) END AS date_of_birth,
          {_pick('c_custkey', 'F', 'M', 'X')} AS gender, 'Single' AS marital_status, 'School' AS education_level,
          c_mktsegment AS occupation, '557-' || {_text('c_custkey')} AS mobile_phone,
          CAST(NULL AS STRING) AS landline_phone, 'Street ' || {_text('c_custkey')} AS address,
          'City ' || {_text('c_nationkey')} AS city, 'State' AS state, {_text('20000 + c_custkey')} AS postal_code,
          {_COUNTRY} AS country,
          CASE c_mktsegment WHEN 'FURNITURE' THEN 'Premium' WHEN 'HOUSEHOLD' THEN 'Plus'
               WHEN 'MACHINERY' THEN 'Basic' WHEN 'BUILDING' THEN 'Student' ELSE 'Basic' END AS segment,
          CASE WHEN d = 2 OR c_custkey % 19 = 0 THEN 'Inactive' ELSE 'Active' END AS customer_status,
          CASE WHEN c_custkey % 7 <> 0 THEN {_text('480 + (c_custkey * 37) % 370')} || '.0' END AS credit_score,
          CASE WHEN c_custkey % 5 <> 0
               THEN {_text(f'abs(c_acctbal) * 4 / {_usd_per(_HOME_CCY)}')} END AS estimated_monthly_income,
          CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE {_flag('c_custkey % 2 = 0')} END AS accepts_marketing,
          CAST(DATE '2015-03-04' + CAST((c_custkey * 17) % 4150 AS INT) AS STRING) AS registration_date,
          'B' || {_text('c_custkey % 50')} AS registration_branch_id,
          CASE WHEN d = 2 THEN '2026-06-20' ELSE '2026-05-20' END AS last_updated,
          'mexican' AS detected_accent, {_CLEAN}
        FROM customer CROSS JOIN {_TWICE} WHERE d = 1 OR c_acctbal < -700""",
    "raw_products": f"""
        SELECT 'P' || {_text('o_orderkey')} AS product_id, 'PN' || {_text('o_orderkey')} AS product_number,
          'C' || {_text('o_custkey')} AS customer_id,
          {_pick('o_orderkey', 'Tarjeta Crédito', 'Préstamo Personal', 'Préstamo Hipotecario', 'Cuenta Ahorro', 'Cuenta Corriente', 'Fondo')} AS product_type,
          CASE WHEN o_orderkey % 97 = 0 THEN 'Blocked' WHEN o_orderkey % 211 = 0 THEN 'Suspended'
               WHEN (o_orderkey - o_orderkey % 6) % 30 = 0 THEN 'Active' ELSE 'Closed' END AS product_status,
          {_ORDER_CCY} AS currency,
          {_text(f'o_totalprice / 7 / {_usd_per(_ORDER_CCY)}')} AS current_balance,
          CASE WHEN o_orderpriority <> '5-LOW' OR o_orderkey % 3 <> 0
               THEN {_text(f'o_totalprice / 3 / {_usd_per(_ORDER_CCY)}')} END AS credit_limit,
          CASE WHEN o_orderkey % 4 <> 1 THEN {_text('8 + ((o_orderkey * 7) % 2000) / 9.7e1')} END AS interest_rate,
          {_text('(o_orderkey * 13) % 36 + d - 1')} || '.0' AS days_past_due, {_day('o_orderdate', ORDER_SHIFT)} AS opening_date,
          CAST(NULL AS STRING) AS expiration_date, {_day('o_orderdate', ORDER_SHIFT, '(d - 1) * 30')} AS last_updated,
          {_day('o_orderdate', ORDER_SHIFT)} AS last_transaction_date, 'B' || {_text('o_orderkey % 50')} AS opening_branch_id,
          {_pick('o_orderkey', 'App', 'Branch')} AS opening_channel, {_flag("o_orderpriority = '1-URGENT'")} AS has_linked_app, {_CLEAN}
        FROM orders CROSS JOIN {_TWICE} WHERE d = 1 OR o_orderstatus = 'P'""",
    "bounds": f"""
        SELECT CAST(min(o_orderdate) AS DATE) + {ORDER_SHIFT} - 30 AS lo,
          CAST(max(o_orderdate) AS DATE) + {ORDER_SHIFT} - 10 AS hi FROM orders""",
    "days": "{days}",
    "raw_daily_exchange_rates": f"""
        SELECT ccy AS source_currency, 'USD' AS target_currency, CAST(day AS STRING) AS date,
          {_text(f'{_usd_per("ccy")} * (1 + (extract(doy FROM day) % 7) * 1.13e-2)')} AS exchange_rate,
          {_text(f'{_usd_per("ccy")} * 9.9e-1')} AS buy_rate, {_text(f'{_usd_per("ccy")} * 1.01e0')} AS sell_rate,
          'bank' AS source, {_CLEAN}
        FROM days CROSS JOIN (SELECT 'MXN' AS ccy UNION ALL SELECT 'COP' AS ccy UNION ALL SELECT 'ARS' AS ccy) codes
          CROSS JOIN (SELECT 1 AS d) once""",
    "raw_transactions": f"""
        SELECT CASE WHEN l_quantity > 1 OR l_discount > 0 THEN {_text('l_orderkey')} || '-' || {_text('l_linenumber')} END AS transaction_id,
          {_day('o_orderdate', ORDER_SHIFT)} || ' 08:30:00' AS transaction_date, {_day('l_shipdate', ORDER_SHIFT)} AS process_date,
          'P' || {_text('l_orderkey')} AS product_id,
          CASE WHEN l_tax > 0 OR l_quantity > 10 THEN 'C' || {_text('o_custkey')} END AS customer_id,
          {_pick('l_partkey', 'Deposit', 'Withdrawal', 'Payment', 'Purchase', 'Transfer', 'Adjustment')}
            || CASE WHEN l_returnflag = 'R' THEN ' ' ELSE '' END AS transaction_type,
          ' Category' AS transaction_category,
          {_text(f'l_extendedprice * 1.0137e-1 / {_usd_per(_LINE_CCY)}')} AS amount, {_LINE_CCY} AS currency,
          CASE WHEN l_suppkey % 4 <> 3 AND l_linestatus = 'F' THEN {_text('l_extendedprice * 1.0111e-1')} END AS amount_usd,
          {_pick('l_partkey', 'App', ' Branch', 'ATM ')} AS channel, 'B' || {_text('l_suppkey')} AS branch_id,
          'Shop ' || {_text('l_partkey')} AS merchant_name, 'Retail' AS merchant_category,
          CASE WHEN l_suppkey % 4 = 0 THEN ' Mexico' WHEN l_suppkey % 4 = 1 THEN 'Colombia' ELSE 'Argentina' END AS transaction_country,
          'City' AS transaction_city, CASE WHEN l_discount >= 0.1 THEN 'Declined' ELSE ' Approved' END AS transaction_status,
          '00' AS response_code, {_flag('l_quantity >= 49 AND l_tax >= 0.08')} AS is_fraud, {_text('l_discount / 3')} AS fraud_score,
          {_text('l_tax * 211')} AS latitude, {_text('l_tax * 97 - 99')} AS longitude,
          CASE WHEN l_quantity = 17 AND l_tax = 0 THEN '{{"loyalty_points":"120"}}' END AS _rescued_data,
          CAST('2026-07-01 00:00:00' AS TIMESTAMP) AS _bronze_ingested_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # change deliveries for history: one row per order, event and later correction
    "deliveries": f"""
        SELECT 'O' || {_text('o_orderkey')} AS order_id, CAST(o_orderdate AS DATE) + (d - 1) * 40 AS changed_on,
          CASE WHEN d = 2 AND o_totalprice > 250000 THEN 'shipped' ELSE o_orderstatus END AS status,
          CASE WHEN d = 2 THEN o_totalprice * 1.1e0 ELSE o_totalprice END AS price, o_orderpriority AS priority
        FROM orders CROSS JOIN {_TWICE} WHERE d = 1 OR o_orderpriority <> '5-LOW'""",
    "declarations": f"""
        SELECT 'C' || {_text('c_custkey')} AS customer_id, CAST(DATE '2026-06-01' + d AS STRING) AS declared_at,
          CASE WHEN c_nationkey % 3 <> 1 THEN abs(c_acctbal) * (3 + d) + 211 END AS new_income_usd,
          CASE WHEN c_nationkey % 2 = 0 THEN 1000e0 + c_nationkey * 7.77e0 END AS household_income_usd,
          CASE WHEN c_nationkey % 4 = 0 THEN 50e0 + c_nationkey * 3.33e0 END AS household_installments_usd,
          CASE WHEN c_nationkey % 5 = 0 THEN 150e0 END AS external_installments_usd
        FROM customer CROSS JOIN {_TWICE} WHERE d = 1 OR c_acctbal > 5000""",
}
# views that a view reads
_NEEDS = {"days": ["bounds"], "raw_daily_exchange_rates": ["days"]}


def view_list(*names: str) -> list[str]:
    """``names`` and what they read, in an order in which each can be defined."""
    done: list[str] = []
    for name in names:
        for item in (*view_list(*_NEEDS.get(name, [])), name):
            if item not in done:
                done.append(item)
    return done


def ctes(dialect: str, *names: str) -> list[str]:
    return [f"{n} AS ({RAW[n].replace('{days}', _DAYS[dialect])})" for n in view_list(*names)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; a small one of fewer files than cores is spread, since one small file is one task.

    Large files are read in splits; to spread them would shuffle the whole table, into no more parts than there are cores.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("lineitem", "orders", "events") and len(df.inputFiles()) < cores and df.count() <= SPREAD_ROWS:
        return df.repartition(cores)
    return df


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A recast table in Spark."""
    for table in TABLES:
        if table in RAW[name] or any(table in RAW[n] for n in view_list(name)):
            _table(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(f"WITH {', '.join(ctes('spark', name))} SELECT * FROM {name}")
