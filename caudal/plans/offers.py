"""Offers recalculated with what a customer declares, and the record of accepted offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.contracts import CREDIT_OFFER_COLUMNS
from caudal.functions.finance import monthly_installment
from caudal.operators.dedup import latest_by_key
from caudal.operators.small import unique_join
from caudal.plans.options import offer_options
from caudal.plans.policy import DEBT_TO_INCOME_NEAR_LIMIT, Policy

AMOUNTS = ("new_income_usd", "household_income_usd", "household_installments_usd",
           "external_installments_usd")
CARRY = (
    "income_used_usd", "income_source", "current_installments_usd", "max_total_installment_usd",
    "fx_date", "open_complaints", "open_priority_complaints", "open_critical_complaints",
    "uses_declared_income", "uses_declared_data", "customer_declared_data",
)


def declared_profile(profile: DataFrame, declarations: DataFrame, policy: Policy) -> DataFrame:
    """The profile of every customer who declared something, income, debt and eligibility redone.

    ``declarations`` has customer_id, declared_at and the ``AMOUNTS``; the latest
    declaration of a customer counts.  Income of the household is added only
    together with the installments of that person.
    """
    latest = latest_by_key(
        declarations.select("customer_id", "declared_at", *AMOUNTS), ["customer_id"], ["declared_at"]
    ).drop("declared_at")
    zero = F.lit(0.0)
    household = F.col("household_income_usd").isNotNull() & F.col("household_installments_usd").isNotNull()
    new_income = F.col("new_income_usd").isNotNull() | household
    own = F.coalesce("new_income_usd", "income_used_usd")
    extra_debt = F.coalesce("external_installments_usd", zero) + F.when(
        household, F.col("household_installments_usd")).otherwise(zero)
    income = F.when(household, F.coalesce(own, zero) + F.col("household_income_usd")).otherwise(own)
    limit = policy.max_debt_to_income
    changed = (
        profile.join(latest, "customer_id")
        .withColumns({
            "uses_declared_income": new_income,
            "uses_declared_data": new_income | F.col("external_installments_usd").isNotNull(),
            "customer_declared_data": F.to_json(F.struct(*AMOUNTS)),
            "_income": income,
            "_debt": F.col("current_installments_usd") + extra_debt,
        })
        .withColumns({
            "income_used_usd": F.round("_income", 2),
            "income_source": F.when(new_income, F.lit("declared_in_chat")).otherwise(F.col("income_source")),
            "current_installments_usd": F.round("_debt", 2),
            "max_total_installment_usd": F.round(F.col("_income") * limit, 2),
            "available_installment_usd": F.round(F.col("_income") * limit - F.col("_debt"), 2),
        })
    )
    return _judge_again(changed, policy).drop("_income", "_debt", *AMOUNTS)


def _judge_again(df: DataFrame, policy: Policy) -> DataFrame:
    """Replace the reason codes that depend on income, keep the others."""
    income, available = F.col("income_used_usd"), F.col("available_installment_usd")
    kept = F.filter("reason_codes", lambda r: ~(r.startswith("R05") | r.startswith("R08")))
    redone = F.array_compact(F.array(
        F.when(income.isNull(), F.lit("R05_INCOME_MISSING"))
        .when(income < policy.min_income_usd, F.lit("R05_INCOME_BELOW_MIN")),
        F.when(available <= 0, F.lit("R08_NO_CAPACITY")),
    ))
    eligible = F.col("is_eligible")
    critical = F.col("open_critical_complaints") > 0
    return (
        df.withColumn("reason_codes", F.array_sort(F.concat(kept, redone)))
        .withColumn("is_eligible", F.size("reason_codes") == 0)
        .withColumns({
            "offer_mode": F.when(~eligible, "none")
            .when(F.col("accepts_marketing") & ~critical, "proactive")
            .otherwise("on_customer_interest"),
            "not_proactive_reason": F.when(eligible & ~F.col("accepts_marketing"), "no_marketing_consent")
            .when(eligible & critical, "open_critical_complaint"),
        })
    )


def undeclared(profile: DataFrame) -> DataFrame:
    """A plain profile in the shape of ``declared_profile``."""
    return profile.withColumns({
        "uses_declared_income": F.lit(False),
        "uses_declared_data": F.lit(False),
        "customer_declared_data": F.lit(None).cast("string"),
    })


def _debt_share(installment: Column) -> Column:
    return (F.col("current_installments_usd") + installment) / F.nullif("income_used_usd", F.lit(0.0))


def _flags(debt_share: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.col("uses_declared_income") & (debt_share >= DEBT_TO_INCOME_NEAR_LIMIT),
               F.lit("F02_NEAR_LIMIT_DECLARED_INCOME")),
        F.when(F.col("uses_declared_data"), F.lit("F03_DECLARED_DATA")),
        F.when(F.col("open_complaints") > 0, F.lit("F04_OPEN_COMPLAINTS")),
    ))


def recalculate(profile: DataFrame, declarations: DataFrame, policy: Policy) -> DataFrame:
    """Offer options of the customers who declared something, with the advisor flags of each."""
    redone = offer_options(declared_profile(profile, declarations, policy), policy, CARRY)
    share = _debt_share(F.col("offer_monthly_installment_usd"))
    return redone.withColumns({
        "debt_to_income_after": F.round(share, 4),
        "flags": F.when(F.col("is_available"), _flags(share)),
    })


def accepted_offers(offers: DataFrame, acceptances: DataFrame, policy: Policy) -> DataFrame:
    """One record per acceptance, none left out: 42 columns and ``refusal_reasons``.

    An acceptance of an unknown, unavailable or no longer valid option has reasons and mostly
    NULLs; ``offer_rules`` refuses it.

    ``offers`` are options with the ``CARRY`` columns; ``acceptances`` has offer_id,
    customer_id, option_code, term_months, accepted_amount_usd, session_id,
    channel, language and accepted_at.
    """
    key = ["customer_id", "option_code", "term_months"]
    joined = unique_join(acceptances, offers, key, "left")
    amount = F.col("accepted_amount_usd")
    installment = monthly_installment(amount, F.col("offer_rate_pct"), F.col("term_months"))
    share = _debt_share(installment)
    documents = F.array_compact(F.array(
        F.lit("identity_document"),
        F.when(F.col("uses_declared_income"), F.lit("proof_of_declared_income")),
        F.when(F.get_json_object("customer_declared_data", "$.household_income_usd").isNotNull(),
               F.lit("household_member_documents")),
    ))
    record = joined.withColumns({
        "offer_origin": F.when(F.col("offer_mode") == "proactive", "proactive")
        .otherwise("customer_interest"),
        "amount_usd": amount,
        "annual_rate_pct": F.col("offer_rate_pct"),
        "monthly_installment_usd": F.round(installment, 2),
        "amount_local": F.round(amount / F.col("fx_to_usd"), 0),
        "monthly_installment_local": F.round(installment / F.col("fx_to_usd"), 0),
        "debt_to_income_after": share,
        "rate_adjustment_pp": F.col("total_rate_adjustment_pp"),
        "is_conditional": F.col("uses_declared_data"),
        "flags": _flags(share),
        "required_documents": documents,
        "status": F.lit("accepted"),
        "handoff_ticket_id": F.lit(None),
        "advisor_summary": F.lit(None),
        "valid_until": F.date_add(F.to_date("accepted_at"), policy.offer_validity_days),
        "profile_as_of_date": F.col("as_of_date"),
        "created_at": F.col("accepted_at"),
        "updated_at": F.lit(None),
    })
    known = F.col("product_code").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(~known, F.lit("unknown_option")),
        F.when(known & ~F.coalesce("is_available", F.lit(False)), F.lit("unavailable_option")),
        F.when(amount < F.col("option_min_amount_usd"), F.lit("below_minimum")),
        F.when(amount > F.col("option_max_amount_usd"), F.lit("above_maximum")),
    ))
    return record.select(
        *[F.col(n).cast(t).alias(n) for n, t, _ in offer_columns()], reasons.alias("refusal_reasons")
    )


def offer_columns() -> list[tuple[str, str, bool]]:
    """(name, type, required) of the accepted-offer record."""
    parts = [item.split() for item in CREDIT_OFFER_COLUMNS.split(",")]
    return [(p[0], p[1], p[-1] == "!") for p in parts]


def offer_rules(policy: Policy) -> dict:
    """Key, required columns and checks of the accepted-offer table, for a validated append."""
    return dict(
        pk=["offer_id"],
        required=[name for name, _, required in offer_columns() if required],
        checks={
            "unknown_option": "NOT array_contains(refusal_reasons, 'unknown_option')",
            "unavailable_option": "NOT array_contains(refusal_reasons, 'unavailable_option')",
            "below_minimum": "NOT array_contains(refusal_reasons, 'below_minimum')",
            "above_maximum": "NOT array_contains(refusal_reasons, 'above_maximum')",
            "valid_status": "status IN ('accepted', 'handed_off', 'expired', 'cancelled')",
            "valid_offer_origin": "offer_origin IN ('proactive', 'customer_interest')",
            "positive_amounts":
                "amount_usd > 0 AND monthly_installment_usd > 0 AND income_used_usd > 0",
            "within_debt_limit": f"debt_to_income_after <= {policy.max_debt_to_income} + 1e-9",
        },
    )
