"""Customer credit profile: income, debt, capacity, risk and eligibility per customer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions.finance import monthly_installment
from caudal.operators.fx import rates_as_of
from caudal.operators.lookup import band_of, first_covering
from caudal.operators.small import fits_broadcast, join_small
from caudal.plans.policy import LOCAL_CURRENCY, Policy

OPEN_STATUSES = ("Open", "In Process", "Escalated")
PRIORITY = ("High", "Critical")
CARD, LOANS = "CC", ("PL", "MG")

CONTEXT_COLUMNS = [
    "customer_id", "is_eligible", "offer_mode", "not_proactive_reason", "reason_codes",
    "requires_advisor_review", "can_become_eligible_with_declared_income", "risk_band", "segment",
    "local_currency", "fx_to_usd", "fx_date", "income_used_usd", "income_source",
    "current_installments_usd", "max_total_installment_usd", "available_installment_usd",
    "total_rate_adjustment_pp", "max_term_personal_loan_months", "max_term_mortgage_months",
    "open_complaints", "open_priority_complaints", "open_critical_complaints", "as_of_date",
    "policy_version",
]

#: the columns of the clean tables that a profile reads
PROFILE_READS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id", "country", "segment", "customer_status", "credit_score", "estimated_monthly_income",
                  "registration_date", "date_of_birth", "accepts_marketing"),
    "products": ("customer_id", "product_type", "product_status", "currency", "current_balance", "credit_limit",
                 "interest_rate", "days_past_due"),
    "transactions": ("customer_id", "process_date", "transaction_type", "transaction_status", "amount", "currency",
                     "amount_usd", "is_fraud"),
    "complaints": ("customer_id", "status", "priority"),
    "daily_exchange_rates": ("source_currency", "target_currency", "date", "exchange_rate"),
}


def local_currency(country: Column) -> Column:
    currency = F.lit(None).cast("string")
    for name, code in LOCAL_CURRENCY.items():
        currency = F.when(country == name, F.lit(code)).otherwise(currency)
    return currency


def months_before(cutoff: Column, day: Column) -> Column:
    """Complete months from ``day`` to ``cutoff``."""
    return F.floor(F.months_between(cutoff, day)).cast("int")


def credit_products(
    products: DataFrame, rates: DataFrame, catalog: DataFrame, small: bool | None = None
) -> DataFrame:
    """Products with their credit product code and amounts in USD."""
    codes = catalog.select(
        F.col("source_product_type").alias("product_type"), "product_code",
        F.col("max_amount_usd").alias("_catalog_max"),
        ((F.col("min_rate_pct") + F.col("max_rate_pct")) / 2).alias("_middle_rate"),
    )
    usd = rates.select("currency", F.col("to_usd").alias("_to_usd"))
    coded = products.join(F.broadcast(codes), "product_type", "left")
    priced = join_small(coded, usd, ["currency"], small=small)
    return priced.withColumns({
        "credit_limit_usd": F.col("credit_limit") * F.col("_to_usd"),
        "current_balance_usd": F.col("current_balance") * F.col("_to_usd"),
    })


def existing_installments(products_usd: DataFrame, grid: DataFrame) -> DataFrame:
    """Add ``installment_usd`` to active credit products, NULL elsewhere.

    Loans: the original amount over the shortest grid term whose range covers
    it, at most the catalog maximum (LEAST skips NULLs: a loan without amount
    takes the longest term and costs nothing).  Cards: the balance over the
    card term of the grid.
    """
    principal = F.coalesce("credit_limit_usd", "current_balance_usd")
    terms = grid.select("product_code", "term_months", "reference_rate_pct", "max_amount_usd")
    matched = first_covering(
        products_usd, terms, F.least(principal, F.col("_catalog_max")),
        upper="max_amount_usd", order="term_months", take=["reference_rate_pct"],
        group="product_code", out="_term", checked=True,
    )
    card_term = grid.filter(F.col("product_code").startswith("CC-")).agg(
        F.max("term_months").alias("_card_term")  # one row
    )
    active = F.col("product_status") == "Active"
    loan = monthly_installment(
        principal, F.coalesce("interest_rate", "_term.reference_rate_pct"), F.col("_term.term_months")
    )
    card = monthly_installment(
        F.greatest(F.coalesce("current_balance_usd", F.lit(0.0)), F.lit(0.0)),
        F.coalesce("interest_rate", "_middle_rate"), F.col("_card_term"),
    )
    is_loan = F.col("product_code").isin(*LOANS) & F.col("_term").isNotNull()
    return matched.crossJoin(F.broadcast(card_term)).withColumn(
        "installment_usd",
        F.when(active & is_loan, loan).when(active & (F.col("product_code") == CARD), card),
    ).drop("_term", "_card_term")


def product_facts(with_installments: DataFrame) -> DataFrame:
    """Debt and product risk per customer, in one pass."""
    active = F.col("product_status") == "Active"
    counted = F.col("installment_usd").isNotNull()

    def active_code(code: str) -> Column:
        return counted & (F.col("product_code") == code)

    active_card = active & (F.col("product_code") == CARD)
    return (
        with_installments.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.sum("installment_usd").alias("current_installments_usd"),
            F.count_if(counted).alias("active_credit_products"),
            F.count_if(active_code("CC")).alias("active_credit_cards"),
            F.count_if(active_code("PL")).alias("active_personal_loans"),
            F.count_if(active_code("MG")).alias("active_mortgages"),
            F.max(F.when(active & F.col("product_code").isNotNull(), F.col("days_past_due")))
            .alias("max_days_past_due"),
            F.bool_or(F.col("product_status").isin("Blocked", "Suspended"))
            .alias("has_blocked_or_suspended_product"),
            F.sum(F.when(active_card, F.col("credit_limit_usd"))).alias("card_limit_usd"),
            F.sum(F.when(active_card, F.col("current_balance_usd"))).alias("card_balance_usd"),
            F.count_if(active).alias("active_products"),
        )
    )


def transaction_facts(
    transactions: DataFrame, rates: DataFrame, policy: Policy, bounded: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """Deposits of six months and recent fraud per customer, in one pass.

    The windows have no upper bound unless ``bounded``; the lower bounds are
    literals and reach the scan.
    """
    cutoff = policy.cutoff
    day = F.col("process_date")
    deposit = (
        (F.col("transaction_type") == "Deposit") & (F.col("transaction_status") == "Approved")
        & (day > F.add_months(cutoff, -6))
    )
    fraud = F.col("is_fraud") & (day > F.date_sub(cutoff, policy.fraud_lookback_days))
    recent = transactions.filter(deposit | fraud).filter(F.col("customer_id").isNotNull())
    if bounded:
        recent = recent.filter(day <= cutoff)
    usd = rates.select("currency", F.col("to_usd").alias("_to_usd"))
    amount = F.coalesce("amount_usd", F.col("amount") * F.col("_to_usd"))
    return (
        join_small(recent, usd, ["currency"], small=small)
        .groupBy("customer_id")
        .agg(
            (F.sum(F.when(deposit, amount)) / 6).alias("avg_monthly_deposits_usd_6m"),
            F.count_distinct(F.when(deposit, F.date_trunc("month", day))).alias("deposit_months_6m"),
            F.count_if(fraud).alias("confirmed_fraud_tx_recent"),
        )
    )


def complaint_facts(complaints: DataFrame) -> DataFrame:
    """Open complaints per customer: all, high or critical, critical."""
    is_open = F.col("status").isin(*OPEN_STATUSES)
    return (
        complaints.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count_if(is_open).alias("open_complaints"),
            F.count_if(is_open & F.col("priority").isin(*PRIORITY)).alias("open_priority_complaints"),
            F.count_if(is_open & (F.col("priority") == "Critical")).alias("open_critical_complaints"),
        )
    )


def with_term_limits(customers: DataFrame, policy: Policy) -> DataFrame:
    """Add risk band columns and the loan terms left until the age limit."""
    banded = band_of(customers, policy.tables["ref_policy_bands"].select(
        "band", "min_credit_score", "rate_adjustment_pp", "offer_allowed",
        "max_term_personal_loan_months", "max_term_mortgage_months",
    ), F.col("credit_score"), floor="min_credit_score", checked=True)
    age = months_before(policy.cutoff, F.col("date_of_birth"))
    by_age = F.greatest(F.lit(policy.max_age_at_maturity_years * 12) - age, F.lit(0))
    result = banded.withColumns({
        "risk_band": F.col("_band.band"),
        "_band_allowed": F.coalesce("_band.offer_allowed", F.lit(False)),
        "band_rate_adjustment_pp": F.coalesce("_band.rate_adjustment_pp", F.lit(0.0)),
        # a missing birth date sets no limit, and GREATEST would turn it into 0
        "max_term_by_age_months": F.when(F.col("date_of_birth").isNotNull(), by_age),
    })
    for term in ("max_term_personal_loan_months", "max_term_mortgage_months"):
        by_band = F.coalesce(F.col(f"_band.{term}"), F.lit(0))
        result = result.withColumn(term, F.least(by_band, F.col("max_term_by_age_months")))
    return result.drop("_band")


def assess(base: DataFrame, policy: Policy) -> DataFrame:
    """Add capacity, reason codes and eligibility to indicators already joined per customer."""
    p = policy
    limit = F.lit(p.max_debt_to_income)
    base = base.withColumns({
        "_limit_usd": limit * F.col("income_used_usd"),
        "_available_usd": limit * F.col("income_used_usd") - F.col("current_installments_usd"),
    })
    income, available = F.col("income_used_usd"), F.col("_available_usd")
    tenure = F.coalesce("tenure_months", F.lit(0))
    # in the order of the codes; NULL means the rule is kept
    failed = [
        F.when(F.coalesce("customer_status", F.lit("")) != "Active", F.lit("R01_INACTIVE_CUSTOMER")),
        F.when(tenure < p.min_tenure_months, F.lit("R02_SHORT_TENURE")),
        F.when(F.col("max_days_past_due") > p.max_days_past_due, F.lit("R03_DELINQUENCY")),
        F.when(F.col("has_blocked_or_suspended_product"), F.lit("R04_BLOCKED_PRODUCT")),
        F.when(income.isNull(), F.lit("R05_INCOME_MISSING"))
        .when(income < p.min_income_usd, F.lit("R05_INCOME_BELOW_MIN")),
        F.when(F.col("risk_band").isNull(), F.lit("R06_SCORE_MISSING"))
        .when(~F.col("_band_allowed"), F.lit("R06_SCORE_BELOW_MIN")),
        F.when(F.col("confirmed_fraud_tx_recent") > 0, F.lit("R07_RECENT_FRAUD")),
        F.when(income.isNotNull() & (available <= 0), F.lit("R08_NO_CAPACITY")),
    ]
    eligible = F.col("is_eligible")
    consents = F.coalesce("accepts_marketing", F.lit(False))
    critical = F.col("open_critical_complaints") > 0
    return (
        base.withColumn("reason_codes", F.array_compact(F.array(*failed)))
        .withColumn("is_eligible", F.size("reason_codes") == 0)
        .withColumns({
            "offer_mode": F.when(~eligible, F.lit("none"))
            .when(consents & ~critical, F.lit("proactive"))
            .otherwise(F.lit("on_customer_interest")),
            "not_proactive_reason": F.when(eligible & ~consents, F.lit("no_marketing_consent"))
            .when(eligible & critical, F.lit("open_critical_complaint")),
            "can_become_eligible_with_declared_income": income.isNull(),
            "requires_advisor_review": (F.col("confirmed_fraud_tx_recent") > 0)
            | (F.col("open_priority_complaints") > 0),
        })
    )


def indicators(tables: Mapping[str, DataFrame], policy: Policy, bounded: bool = False) -> DataFrame:
    """One row per customer with everything ``assess`` needs, unrounded.

    Every fact is aggregated to one row per customer before it is joined, so
    no join multiplies rows and none depends on how rows spread over customers.
    """
    ref = policy.tables
    rates = rates_as_of(tables["daily_exchange_rates"], policy.cutoff)
    small = fits_broadcast(rates)
    products = credit_products(tables["products"], rates, ref["ref_product_catalog"], small)
    debt = product_facts(existing_installments(products, ref["ref_term_grid"]))
    flows = transaction_facts(tables["transactions"], rates, policy, bounded, small)
    cases = complaint_facts(tables["complaints"])

    customers = tables["customers"].select(
        "customer_id", "country", "segment", "customer_status", "credit_score",
        F.col("estimated_monthly_income").alias("declared_income_local"), "registration_date",
        "date_of_birth", F.coalesce("accepts_marketing", F.lit(False)).alias("accepts_marketing"),
        local_currency(F.col("country")).alias("local_currency"),
    )
    own_rate = rates.select(F.col("currency").alias("local_currency"),
                            F.col("to_usd").alias("fx_to_usd"), "fx_date")
    segments = ref["ref_segment_adjustments"].select(
        "segment", F.col("rate_adjustment_pp").alias("segment_rate_adjustment_pp")
    )
    spine = with_term_limits(customers, policy)
    spine = join_small(spine, own_rate, ["local_currency"], small=small)
    spine = spine.join(F.broadcast(segments), "segment", "left")
    joined = spine.join(debt, "customer_id", "left").join(flows, "customer_id", "left")
    joined = joined.join(cases, "customer_id", "left")
    zero = [
        "segment_rate_adjustment_pp", "deposit_months_6m", "current_installments_usd",
        "active_credit_products", "active_credit_cards", "active_personal_loans",
        "active_mortgages", "active_products", "max_days_past_due", "confirmed_fraud_tx_recent",
        "open_complaints", "open_priority_complaints", "open_critical_complaints",
    ]
    return joined.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in zero},
        "has_blocked_or_suspended_product": F.coalesce(
            "has_blocked_or_suspended_product", F.lit(False)),
        "tenure_months": months_before(policy.cutoff, F.col("registration_date")),
        "income_used_usd": F.col("declared_income_local") * F.col("fx_to_usd"),
        "as_of_date": policy.cutoff,
        "policy_version": F.lit(policy.policy_version),
    })


def credit_profile(
    tables: Mapping[str, DataFrame], policy: Policy, bounded: bool = False
) -> DataFrame:
    """The published profile: 52 columns, money rounded to cents and ratios to 4 digits.

    ``tables`` holds the clean customers, products, transactions, complaints and
    daily_exchange_rates.
    """
    return shape_profile(assess(indicators(tables, policy, bounded), policy), policy)


def shape_profile(assessed: DataFrame, policy: Policy) -> DataFrame:
    def money(name: str, source: str | None = None) -> Column:
        return F.round(F.col(source or name), 2).alias(name)

    def ratio(amount: str, of: str, name: str) -> Column:
        return F.round(F.col(amount) / F.nullif(F.col(of), F.lit(0.0)), 4).alias(name)

    adjustment = F.col("band_rate_adjustment_pp") + F.col("segment_rate_adjustment_pp")
    source = F.when(F.col("income_used_usd").isNull(), "missing").otherwise("declared_profile")
    return assessed.select(
        "customer_id", "country", "local_currency", "segment", "customer_status",
        "registration_date", "tenure_months", "accepts_marketing", "credit_score", "risk_band",
        "declared_income_local",
        money("declared_income_usd", "income_used_usd"), money("avg_monthly_deposits_usd_6m"),
        "deposit_months_6m", money("income_used_usd"), source.alias("income_source"),
        "active_products", "active_credit_products", "active_credit_cards",
        "active_personal_loans", "active_mortgages",
        money("card_limit_usd"), money("card_balance_usd"),
        ratio("card_balance_usd", "card_limit_usd", "card_utilization"),
        money("current_installments_usd"),
        ratio("current_installments_usd", "income_used_usd", "current_debt_to_income"),
        F.lit(policy.max_debt_to_income).alias("max_debt_to_income"),
        money("max_total_installment_usd", "_limit_usd"),
        money("available_installment_usd", "_available_usd"),
        "max_days_past_due", "has_blocked_or_suspended_product", "confirmed_fraud_tx_recent",
        "open_complaints", "open_priority_complaints", "open_critical_complaints",
        "band_rate_adjustment_pp", "segment_rate_adjustment_pp",
        "max_term_personal_loan_months", "max_term_mortgage_months", "max_term_by_age_months",
        adjustment.alias("total_rate_adjustment_pp"),
        "reason_codes", "is_eligible", "offer_mode", "not_proactive_reason",
        "can_become_eligible_with_declared_income", "requires_advisor_review",
        "fx_to_usd", "fx_date", "as_of_date", "policy_version",
        F.current_timestamp().alias("computed_at"),
    )


def agent_context(profile: DataFrame) -> DataFrame:
    """The 25 profile columns an agent may read."""
    return profile.select(*CONTEXT_COLUMNS)
