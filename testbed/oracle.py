"""What DuckDB should answer for every registered query, as plain SQL over the same tables."""

from __future__ import annotations

import re

from caudal.contracts import ENTITIES
from caudal.plans import policy as pol
from testbed import recast

AS_OF = "DATE '2026-06-30'"
OPEN_STATUSES = "('Open', 'In Process', 'Escalated')"  # fixed values: complaints with one of these are open


# --- helpers ---------------------------------------------------------------

def rnd(x: str, digits: int) -> str:
    """Half-up on the decimal value, which is what Spark's round does."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def n_if(cond: str) -> str:
    return big(f"count(*) FILTER (WHERE {cond})")


def installment(p: str, rate: str, n: str) -> str:
    return (f"CASE WHEN coalesce({p}, 0) <= 0 OR coalesce({n}, 0) <= 0 THEN 0e0 "
            f"WHEN coalesce({rate}, 0e0) = 0 THEN {p} / {n} "
            f"ELSE {p} * ({rate} / 1200) / (1 - power(1 + {rate} / 1200, -{n})) END")


def principal(i: str, rate: str, n: str) -> str:
    return (f"CASE WHEN coalesce({i}, 0) <= 0 OR coalesce({n}, 0) <= 0 THEN 0e0 "
            f"WHEN coalesce({rate}, 0e0) = 0 THEN {i} * {n} "
            f"ELSE {i} * (1 - power(1 + {rate} / 1200, -{n})) / ({rate} / 1200) END")


def full_months(to: str, since: str) -> str:
    return (f"CAST((year({to}) - year({since})) * 12 + month({to}) - month({since}) "
            f"- CASE WHEN day({to}) < day({since}) AND NOT ({to} = last_day({to}) AND {since} = last_day({since})) "
            f"THEN 1 ELSE 0 END AS INTEGER)")


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if kind == "STRING":
        return "'" + str(value) + "'"
    return f"CAST({value} AS {kind})"


def _values(name: str, schema: str, rows: list[tuple]) -> str:
    fields = [f.split() for f in schema.split(",")]
    kinds = [k.upper() for _, k in fields]
    body = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}_v({', '.join(f for f, _ in fields)})"


def _cast(entity: str, column: str, kind: str) -> str:
    x = column
    if column in ENTITIES[entity].trim:
        x = f"trim({column})"
    if entity == "transactions" and column == "transaction_country":
        return "CASE WHEN trim(transaction_country) = 'Mexico' THEN 'México' ELSE transaction_country END"
    if entity == "transactions" and column == "amount_usd":
        return "CAST(CASE WHEN amount_usd IS NULL AND currency = 'USD' THEN amount ELSE amount_usd END AS DOUBLE)"
    if kind == "int":
        return f"CAST(trunc(CAST({x} AS DOUBLE)) AS INTEGER)"
    return x if kind == "string" else f"CAST({x} AS {kind.upper()})"


def typed_sql(entity: str) -> str:
    spec = ENTITIES[entity]
    columns = ", ".join(f"{_cast(entity, c, t)} AS {c}" for c, t in spec.types.items())
    have_key = " AND ".join(f"{k} IS NOT NULL" for k in spec.key)
    return f"SELECT {columns}, _bronze_ingested_at FROM raw_{entity} WHERE {have_key}"


def silver_sql(entity: str) -> str:
    spec = ENTITIES[entity]
    rest = [c for c in [*spec.names, "_bronze_ingested_at"] if c not in spec.key and c not in spec.latest_by]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in [*spec.latest_by, *rest])
    return (f"SELECT * FROM ({typed_sql(entity)}) QUALIFY row_number() OVER "
            f"(PARTITION BY {', '.join(spec.key)} ORDER BY {order}) = 1")


def shown(entity: str) -> str:
    """Columns of a clean table, timestamps as text."""
    types = {**ENTITIES[entity].types, "_bronze_ingested_at": "timestamp"}
    return ", ".join(f"{stamp(c)} AS {c}" if t == "timestamp" else c for c, t in types.items())


# --- common table expressions ------------------------------------------------

CTE: dict[str, str] = {n: s.replace("{days}", recast._DAYS["duckdb"]) for n, s in recast.RAW.items()}
CTE |= {f"silver_{e}": silver_sql(e) for e in ENTITIES}
CTE |= {f"typed_{e}": typed_sql(e) for e in ENTITIES}
CTE |= {n: _values(n, s, pol.ROWS[n]) for n, s in pol.SCHEMAS.items()}
CTE["card_tiers"] = _values("card_tiers", pol.CARD_TIERS_SCHEMA, pol.CARD_TIERS)
CTE["homes"] = "SELECT * FROM (VALUES ('México', 'MXN'), ('Colombia', 'COP'), ('Argentina', 'ARS')) AS h(country, ccy)"


def fx_at(cutoff: str) -> str:
    return f"""
        SELECT source_currency AS ccy, exchange_rate AS to_usd, date AS fx_date
        FROM silver_daily_exchange_rates f
        WHERE target_currency = 'USD' AND date = (
          SELECT max(date) FROM silver_daily_exchange_rates g
          WHERE g.source_currency = f.source_currency AND g.target_currency = 'USD' AND g.date <= {cutoff})
        UNION ALL SELECT 'USD', 1e0, CAST(NULL AS DATE)"""


CTE["fx_now"] = fx_at("{as_of}")
CTE["fx_end"] = fx_at("DATE '9999-12-31'")
CTE["fx_day"] = "SELECT source_currency AS ccy, date AS on_day, exchange_rate AS rate FROM silver_daily_exchange_rates WHERE target_currency = 'USD'"
CTE["fx_last"] = "SELECT max(date) AS last_day FROM silver_daily_exchange_rates"
CTE["coded"] = """
    SELECT p.*, c.product_code, c.max_amount_usd AS cat_max, (c.min_rate_pct + c.max_rate_pct) / 2 AS mid_rate,
      p.credit_limit * x.to_usd AS limit_usd, p.current_balance * x.to_usd AS balance_usd
    FROM silver_products p LEFT JOIN ref_product_catalog c ON p.product_type = c.source_product_type
    LEFT JOIN fx_now x ON x.ccy = p.currency"""
CTE["owed"] = f"""
    SELECT k.*, CASE
        WHEN product_status = 'Active' AND k.product_code = 'CC'
          THEN {installment('greatest(coalesce(balance_usd, 0e0), 0e0)', 'coalesce(interest_rate, mid_rate)', '60')}
        WHEN product_status = 'Active' AND k.product_code IN ('PL', 'MG') AND g.term_months IS NOT NULL
          THEN {installment('coalesce(limit_usd, balance_usd)', 'coalesce(interest_rate, g.reference_rate_pct)', 'g.term_months')}
      END AS owed_usd
    FROM coded k LEFT JOIN ref_term_grid g ON g.product_code = k.product_code AND g.term_months = (
      SELECT min(h.term_months) FROM ref_term_grid h
      WHERE h.product_code = k.product_code AND h.max_amount_usd >= least(coalesce(k.limit_usd, k.balance_usd), k.cat_max))"""
CTE["held"] = f"""
    SELECT customer_id, sum(owed_usd) AS current_installments_usd,
      {n_if('owed_usd IS NOT NULL')} AS active_credit_products,
      {n_if("owed_usd IS NOT NULL AND product_code = 'CC'")} AS active_credit_cards,
      {n_if("owed_usd IS NOT NULL AND product_code = 'PL'")} AS active_personal_loans,
      {n_if("owed_usd IS NOT NULL AND product_code = 'MG'")} AS active_mortgages,
      max(days_past_due) FILTER (WHERE product_status = 'Active' AND product_code IS NOT NULL) AS max_days_past_due,
      bool_or(product_status IN ('Blocked', 'Suspended')) AS has_blocked_or_suspended_product,
      sum(limit_usd) FILTER (WHERE product_status = 'Active' AND product_code = 'CC') AS card_limit_usd,
      sum(balance_usd) FILTER (WHERE product_status = 'Active' AND product_code = 'CC') AS card_balance_usd,
      {n_if("product_status = 'Active'")} AS active_products
    FROM owed WHERE customer_id IS NOT NULL GROUP BY customer_id"""
CTE["flows"] = f"""
    SELECT customer_id,
      sum(coalesce(amount_usd, amount * to_usd)) FILTER (WHERE dep) / 6 AS avg_monthly_deposits_usd_6m,
      {big("count(DISTINCT date_trunc('month', process_date)) FILTER (WHERE dep)")} AS deposit_months_6m,
      {n_if('fr')} AS confirmed_fraud_tx_recent
    FROM (SELECT *, coalesce(transaction_type = 'Deposit' AND transaction_status = 'Approved'
              AND process_date > CAST({{as_of}} - INTERVAL 6 MONTH AS DATE), false) AS dep,
            coalesce(is_fraud AND process_date > {{as_of}} - 90, false) AS fr FROM silver_transactions) t
    LEFT JOIN fx_now ON ccy = currency
    WHERE customer_id IS NOT NULL AND (dep OR fr) GROUP BY customer_id"""
CTE["gripes"] = f"""
    SELECT customer_id, {n_if(f'status IN {OPEN_STATUSES}')} AS open_complaints,
      {n_if(f"status IN {OPEN_STATUSES} AND priority IN ('High', 'Critical')")} AS open_priority_complaints,
      {n_if(f"status IN {OPEN_STATUSES} AND priority = 'Critical'")} AS open_critical_complaints
    FROM silver_complaints WHERE customer_id IS NOT NULL GROUP BY customer_id"""
CTE["limits"] = f"""
    SELECT c.customer_id, b.band AS risk_band, coalesce(b.offer_allowed, false) AS band_ok,
      coalesce(b.rate_adjustment_pp, 0e0) AS band_rate_adjustment_pp, age_cap AS max_term_by_age_months,
      least(coalesce(b.max_term_personal_loan_months, 0), age_cap) AS max_term_personal_loan_months,
      least(coalesce(b.max_term_mortgage_months, 0), age_cap) AS max_term_mortgage_months
    FROM (SELECT *, CASE WHEN date_of_birth IS NOT NULL
            THEN greatest(900 - {full_months('{as_of}', 'date_of_birth')}, 0) END AS age_cap FROM silver_customers) c
    LEFT JOIN ref_policy_bands b ON b.min_credit_score = (
      SELECT max(min_credit_score) FROM ref_policy_bands WHERE min_credit_score <= c.credit_score)"""
CTE["facts"] = f"""
    SELECT c.customer_id, c.country, h.ccy AS local_currency, c.segment, c.customer_status, c.registration_date,
      {full_months('{as_of}', 'c.registration_date')} AS tenure_months, coalesce(c.accepts_marketing, false) AS consent,
      c.credit_score, c.estimated_monthly_income AS declared_income_local,
      c.estimated_monthly_income * x.to_usd AS income, x.to_usd AS fx_to_usd, x.fx_date,
      f.avg_monthly_deposits_usd_6m, coalesce(f.deposit_months_6m, 0) AS deposit_months_6m,
      coalesce(f.confirmed_fraud_tx_recent, 0) AS confirmed_fraud_tx_recent,
      coalesce(p.current_installments_usd, 0e0) AS debt, coalesce(p.active_products, 0) AS active_products,
      coalesce(p.active_credit_products, 0) AS active_credit_products, coalesce(p.active_credit_cards, 0) AS active_credit_cards,
      coalesce(p.active_personal_loans, 0) AS active_personal_loans, coalesce(p.active_mortgages, 0) AS active_mortgages,
      p.card_limit_usd, p.card_balance_usd, coalesce(p.max_days_past_due, 0) AS max_days_past_due,
      coalesce(p.has_blocked_or_suspended_product, false) AS blocked,
      coalesce(g.open_complaints, 0) AS open_complaints, coalesce(g.open_priority_complaints, 0) AS open_priority_complaints,
      coalesce(g.open_critical_complaints, 0) AS open_critical_complaints,
      l.risk_band, l.band_ok, l.band_rate_adjustment_pp, l.max_term_by_age_months, l.max_term_personal_loan_months,
      l.max_term_mortgage_months, coalesce(s.rate_adjustment_pp, 0e0) AS segment_rate_adjustment_pp
    FROM silver_customers c LEFT JOIN homes h USING (country) LEFT JOIN fx_now x ON x.ccy = h.ccy
    LEFT JOIN held p USING (customer_id) LEFT JOIN flows f USING (customer_id) LEFT JOIN gripes g USING (customer_id)
    LEFT JOIN limits l USING (customer_id) LEFT JOIN ref_segment_adjustments s ON s.segment = c.segment"""
CTE["judged"] = """
    SELECT *, concat_ws(',',
      CASE WHEN coalesce(customer_status, '') <> 'Active' THEN 'R01_INACTIVE_CUSTOMER' END,
      CASE WHEN coalesce(tenure_months, 0) < 6 THEN 'R02_SHORT_TENURE' END,
      CASE WHEN max_days_past_due > 30 THEN 'R03_DELINQUENCY' END,
      CASE WHEN blocked THEN 'R04_BLOCKED_PRODUCT' END,
      CASE WHEN income IS NULL THEN 'R05_INCOME_MISSING' WHEN income < 300 THEN 'R05_INCOME_BELOW_MIN' END,
      CASE WHEN risk_band IS NULL THEN 'R06_SCORE_MISSING' WHEN NOT band_ok THEN 'R06_SCORE_BELOW_MIN' END,
      CASE WHEN confirmed_fraud_tx_recent > 0 THEN 'R07_RECENT_FRAUD' END,
      CASE WHEN 2e-1 * income - debt <= 0 THEN 'R08_NO_CAPACITY' END) AS codes
    FROM facts"""
CTE["verdict"] = """
    SELECT *, codes = '' AS ok, CASE WHEN codes <> '' THEN 'none' WHEN consent AND open_critical_complaints = 0
      THEN 'proactive' ELSE 'on_customer_interest' END AS mode FROM judged"""
CTE["profile"] = f"""
    SELECT customer_id, country, local_currency, segment, customer_status, registration_date, tenure_months,
      consent AS accepts_marketing, credit_score, risk_band, declared_income_local,
      {rnd('income', 2)} AS declared_income_usd, {rnd('avg_monthly_deposits_usd_6m', 2)} AS avg_monthly_deposits_usd_6m,
      deposit_months_6m, {rnd('income', 2)} AS income_used_usd,
      CASE WHEN income IS NULL THEN 'missing' ELSE 'declared_profile' END AS income_source,
      active_products, active_credit_products, active_credit_cards, active_personal_loans, active_mortgages,
      {rnd('card_limit_usd', 2)} AS card_limit_usd, {rnd('card_balance_usd', 2)} AS card_balance_usd,
      {rnd('card_balance_usd / nullif(card_limit_usd, 0)', 4)} AS card_utilization,
      {rnd('debt', 2)} AS current_installments_usd, {rnd('debt / nullif(income, 0)', 4)} AS current_debt_to_income,
      2e-1 AS max_debt_to_income, {rnd('2e-1 * income', 2)} AS max_total_installment_usd,
      {rnd('2e-1 * income - debt', 2)} AS available_installment_usd, max_days_past_due,
      blocked AS has_blocked_or_suspended_product, confirmed_fraud_tx_recent, open_complaints,
      open_priority_complaints, open_critical_complaints, band_rate_adjustment_pp, segment_rate_adjustment_pp,
      max_term_personal_loan_months, max_term_mortgage_months, max_term_by_age_months,
      band_rate_adjustment_pp + segment_rate_adjustment_pp AS total_rate_adjustment_pp, codes AS reason_codes,
      ok AS is_eligible, mode AS offer_mode,
      CASE WHEN ok AND NOT consent THEN 'no_marketing_consent'
           WHEN ok AND open_critical_complaints > 0 THEN 'open_critical_complaint' END AS not_proactive_reason,
      income IS NULL AS can_become_eligible_with_declared_income,
      confirmed_fraud_tx_recent > 0 OR open_priority_complaints > 0 AS requires_advisor_review,
      fx_to_usd, fx_date, {{as_of}} AS as_of_date, '0.4' AS policy_version
    FROM verdict"""
_PRICED = """
    SELECT p.*, g.product_code AS option_code, c.product_code, g.product_type, g.tier, g.term_months, g.reference_rate_pct,
      CASE WHEN c.product_code = 'CC' THEN g.min_amount_usd ELSE c.min_amount_usd END AS low,
      CASE WHEN c.product_code = 'CC' THEN g.max_amount_usd ELSE c.max_amount_usd END AS high,
      CASE c.product_code WHEN 'CC' THEN true WHEN 'PL' THEN g.term_months <= p.max_term_personal_loan_months
        ELSE g.term_months <= p.max_term_mortgage_months END AS fits,
      least(greatest(g.reference_rate_pct + p.total_rate_adjustment_pp, c.min_rate_pct), c.max_rate_pct) AS rate
    FROM {src} p, ref_term_grid g, ref_product_catalog c WHERE c.product_code = left(g.product_code, 2)"""
_SIZED = f"""
    SELECT *, is_eligible AND fits AND amount >= low AS avail FROM (
      SELECT *, {big('floor(least(cap, high) / 100)')} * 100 AS amount FROM (
        SELECT *, {principal('greatest(coalesce(available_installment_usd, 0e0), 0e0)', 'rate', 'term_months')} AS cap FROM {{src}}))"""
_FULL = f"""
    SELECT *, avail AND row_number() OVER (PARTITION BY customer_id, product_code
        ORDER BY avail DESC, high DESC, amount DESC, term_months) = 1 AS feat,
      CASE WHEN avail THEN {installment('amount', 'rate', 'term_months')} END AS inst FROM {{src}}"""
for _tag, _src in (("", "profile"), ("re_", "redeclared")):
    CTE[f"{_tag}priced"] = _PRICED.format(src=_src)
    CTE[f"{_tag}sized"] = _SIZED.replace("{src}", f"{_tag}priced")
    CTE[f"{_tag}full"] = _FULL.replace("{src}", f"{_tag}sized")
_OPTION_COLUMNS = f"""
    customer_id, option_code, product_code, product_type, tier, term_months, reference_rate_pct, total_rate_adjustment_pp,
    {rnd('rate', 2)} AS offer_rate_pct, low AS option_min_amount_usd, high AS option_max_amount_usd, fits AS term_allowed,
    {rnd('cap', 2)} AS max_amount_by_capacity_usd, avail AS is_available, feat AS is_featured, offer_mode,
    CASE WHEN NOT is_eligible THEN 'customer_not_eligible' WHEN NOT fits THEN 'term_above_band_maximum'
         WHEN amount < low THEN 'capacity_below_option_minimum' END AS unavailable_reason,
    CASE WHEN avail THEN amount END AS offer_max_amount_usd, {rnd('inst', 2)} AS offer_monthly_installment_usd,
    local_currency, fx_to_usd, CASE WHEN avail THEN round(amount / fx_to_usd) END AS offer_max_amount_local,
    round(inst / fx_to_usd) AS offer_monthly_installment_local, risk_band, segment, as_of_date, policy_version"""
CTE["full_options"] = CTE.pop("full")
CTE["options"] = f"SELECT {_OPTION_COLUMNS} FROM full_options"
CTE["re_full_options"] = CTE.pop("re_full")
CTE["redeclared"] = f"""
    SELECT * REPLACE (
        {rnd('inc', 2)} AS income_used_usd, CASE WHEN newinc THEN 'declared_in_chat' ELSE income_source END AS income_source,
        {rnd('dbt', 2)} AS current_installments_usd, {rnd('inc * 2e-1', 2)} AS max_total_installment_usd,
        {rnd('inc * 2e-1 - dbt', 2)} AS available_installment_usd, new_codes = '' AS is_eligible,
        CASE WHEN new_codes <> '' THEN 'none' WHEN accepts_marketing AND open_critical_complaints = 0 THEN 'proactive'
             ELSE 'on_customer_interest' END AS offer_mode, new_codes AS reason_codes)
    FROM (SELECT *, array_to_string(list_sort(list_filter(list_concat(
          string_split(regexp_replace(reason_codes, '(R05|R08)[A-Z0-9_]*', '', 'g'), ','),
          [CASE WHEN inc IS NULL THEN 'R05_INCOME_MISSING' WHEN {rnd('inc', 2)} < 300 THEN 'R05_INCOME_BELOW_MIN' END,
           CASE WHEN {rnd('inc * 2e-1 - dbt', 2)} <= 0 THEN 'R08_NO_CAPACITY' END]),
        lambda r: r IS NOT NULL AND r <> '')), ',') AS new_codes
      FROM (SELECT p.*, (new_income_usd IS NOT NULL OR hh) AS newinc,
          (new_income_usd IS NOT NULL OR hh OR external_installments_usd IS NOT NULL) AS declared,
          CASE WHEN hh THEN coalesce(new_income_usd, income_used_usd, 0e0) + household_income_usd
               ELSE coalesce(new_income_usd, income_used_usd) END AS inc,
          current_installments_usd + coalesce(external_installments_usd, 0e0)
            + CASE WHEN hh THEN household_installments_usd ELSE 0e0 END AS dbt,
          new_income_usd, household_income_usd, household_installments_usd, external_installments_usd
        FROM profile p JOIN (SELECT *, household_income_usd IS NOT NULL AND household_installments_usd IS NOT NULL AS hh
          FROM declarations QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY declared_at DESC) = 1) USING (customer_id)))"""
CTE["re_options"] = f"""
    SELECT {_OPTION_COLUMNS}, income_used_usd, income_source, current_installments_usd, max_total_installment_usd,
      newinc AS uses_declared_income, declared AS uses_declared_data, fx_date,
      open_complaints, open_priority_complaints, open_critical_complaints,
      new_income_usd, household_income_usd, household_installments_usd, external_installments_usd,
      {rnd('(current_installments_usd + ' + rnd('inst', 2) + ') / nullif(income_used_usd, 0)', 4)} AS debt_to_income_after,
      CASE WHEN avail THEN concat_ws(',',
        CASE WHEN newinc AND (current_installments_usd + {rnd('inst', 2)}) / nullif(income_used_usd, 0) >= 19e-2 THEN 'F02_NEAR_LIMIT_DECLARED_INCOME' END,
        CASE WHEN declared THEN 'F03_DECLARED_DATA' END,
        CASE WHEN open_complaints > 0 THEN 'F04_OPEN_COMPLAINTS' END) END AS flags
    FROM re_full_options"""
CTE["products_sum"] = f"""
    SELECT customer_id, {big('count(*)')} AS total_products, {n_if("product_status = 'Active'")} AS active_products,
      array_to_string(list_sort(list_distinct(list(product_type))), ', ') AS product_types,
      sum(lim) FILTER (WHERE product_status = 'Active') AS total_credit_limit_usd,
      sum(bal) FILTER (WHERE product_status = 'Active') AS total_current_balance_usd,
      avg(interest_rate) FILTER (WHERE label IS NOT NULL) AS avg_credit_interest_rate,
      max(days_past_due) AS max_days_past_due, avg(days_past_due) AS avg_days_past_due,
      max(CAST(days_past_due > 30 AS INTEGER)) AS has_delinquent_product, max(CAST(label IS NOT NULL AS INTEGER)) AS has_credit_product
    FROM (SELECT p.*, c.product_type AS label, CASE WHEN p.currency = 'USD' THEN 1e0 ELSE rate END * current_balance AS bal,
        CASE WHEN p.currency = 'USD' THEN 1e0 ELSE rate END * credit_limit AS lim
      FROM silver_products p CROSS JOIN fx_last LEFT JOIN fx_day ON ccy = p.currency AND on_day = least(p.last_updated, last_day)
      LEFT JOIN ref_product_catalog c ON c.source_product_type = p.product_type)
    WHERE customer_id IS NOT NULL GROUP BY customer_id"""
CTE["cashflow_sum"] = f"""
    SELECT customer_id, {big('count(*)')} AS total_transactions_90d,
      {rnd("coalesce(sum(usd) FILTER (WHERE transaction_type = 'Deposit'), 0e0)", 2)} AS total_income_usd_90d,
      {rnd("coalesce(sum(usd) FILTER (WHERE transaction_type IN ('Withdrawal', 'Payment', 'Purchase')), 0e0)", 2)} AS total_expense_usd_90d,
      {rnd("coalesce(sum(usd) FILTER (WHERE transaction_type = 'Transfer'), 0e0)", 2)} AS total_transfer_usd_90d,
      {rnd("coalesce(sum(usd) FILTER (WHERE transaction_type = 'Adjustment'), 0e0)", 2)} AS total_adjustment_usd_90d,
      {rnd('avg(usd)', 2)} AS avg_transaction_amount_usd, {n_if('is_fraud')} AS fraud_flags_90d,
      count(*) FILTER (WHERE is_fraud) > 0 AS has_recent_fraud
    FROM (SELECT t.*, CASE WHEN currency = 'USD' THEN amount ELSE coalesce(amount_usd, amount * rate) END AS usd
      FROM silver_transactions t CROSS JOIN fx_last
      LEFT JOIN fx_day ON ccy = currency AND on_day = least(CAST(transaction_date AS DATE), last_day)
      WHERE transaction_status = 'Approved' AND process_date > (SELECT max(process_date) - 90 FROM silver_transactions))
    WHERE customer_id IS NOT NULL GROUP BY customer_id"""
CTE["complaints_sum"] = f"""
    SELECT customer_id, {big('count(*)')} AS total_complaints, {n_if("case_type = 'Claim'")} AS total_claims,
      {n_if("case_type = 'Complaint'")} AS total_complaints_only, {n_if("case_type = 'Request'")} AS total_requests,
      {n_if("case_type = 'Suggestion'")} AS total_suggestions, {n_if(f'status IN {OPEN_STATUSES}')} AS open_cases,
      {n_if("status IN ('Resolved', 'Closed')")} AS resolved_cases, {n_if("status = 'Rejected'")} AS rejected_cases,
      {n_if("priority = 'Critical'")} AS critical_cases,
      {n_if(f"status IN {OPEN_STATUSES} AND priority IN ('High', 'Critical')")} AS open_priority_cases,
      {n_if('sla_breached')} AS sla_breaches, {n_if('is_repeat_complainer')} AS repeat_complaint_flags,
      {rnd('sum(claim)', 2)} AS total_claimed_amount_usd, {rnd('sum(comp)', 2)} AS total_compensation_granted_usd,
      {rnd('avg(resolution_days)', 4)} AS avg_resolution_days, max(resolution_days) AS max_resolution_days,
      {rnd('avg(resolution_satisfaction)', 4)} AS avg_resolution_satisfaction,
      bool_or(coalesce(sla_breached, false)) AS has_sla_breach, bool_or(priority = 'Critical') AS has_critical_complaint,
      bool_or(status IN {OPEN_STATUSES} AND priority IN ('High', 'Critical')) AS has_open_priority_complaint
    FROM (SELECT c.*, claimed_amount * CASE WHEN currency = 'USD' THEN 1e0 ELSE a.rate END AS claim,
        compensation_granted * CASE WHEN currency = 'USD' THEN 1e0 ELSE b.rate END AS comp
      FROM silver_complaints c CROSS JOIN fx_last
      LEFT JOIN fx_day a ON a.ccy = currency AND a.on_day = least(CAST(creation_date AS DATE), last_day)
      LEFT JOIN fx_day b ON b.ccy = currency AND b.on_day = least(coalesce(resolution_date, CAST(creation_date AS DATE)), last_day))
    WHERE customer_id IS NOT NULL GROUP BY customer_id"""


def query(body: str, as_of: str = AS_OF) -> str:
    """``body`` with every CTE it needs, directly or not, in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"(?<![\w.'])\b{name}\b(?!\s*\()", text) and name not in open_:
                open_.add(name)
                visit(CTE[name])
                order.append(name)

    open_: set[str] = set()
    visit(body)
    ctes = ", ".join(f"{n} AS ({CTE[n].strip()})" for n in order)
    return (f"WITH {ctes} " if ctes else "").replace("{as_of}", as_of) + body.replace("{as_of}", as_of)
