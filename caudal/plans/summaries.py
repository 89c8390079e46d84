"""Descriptive summaries per customer, and open cases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.operators.fx import convert_on_date
from caudal.plans.policy import Policy
from caudal.plans.profile import OPEN_STATUSES, PRIORITY

CREDIT_TYPES = ("Credit Card", "Personal Loan", "Mortgage")
CASE_WINDOW_DAYS = CASHFLOW_WINDOW_DAYS = 90

#: the columns of the clean tables that the three summaries read
SUMMARY_READS: dict[str, tuple[str, ...]] = {
    "products": ("customer_id", "product_type", "product_status", "currency", "current_balance", "credit_limit",
                 "interest_rate", "days_past_due", "last_updated"),
    "complaints": ("customer_id", "creation_date", "case_type", "claimed_amount", "currency", "priority", "status",
                   "resolution_date", "sla_breached", "resolution_days", "compensation_granted",
                   "resolution_satisfaction", "is_repeat_complainer"),
    "transactions": ("customer_id", "transaction_date", "process_date", "transaction_type", "transaction_status",
                     "amount", "currency", "amount_usd", "is_fraud"),
    "daily_exchange_rates": ("source_currency", "target_currency", "date", "exchange_rate"),
}

#: the columns of the clean tables that the open cases read
CASE_READS: dict[str, tuple[str, ...]] = {
    "complaints": ("complaint_id", "customer_id", "creation_date", "reception_channel", "category", "case_type", "priority",
                   "status", "sla_breached", "origin_interaction_id", "is_repeat_complainer"),
    "call_center_interactions": ("interaction_id", "customer_id", "interaction_date", "channel", "reason_category",
                                 "was_resolved", "requires_followup", "was_escalated", "detected_sentiment"),
}


def _per_customer(df: DataFrame, keep_null_key: bool):
    """Group by customer; rows without one form no group unless asked for."""
    return (df if keep_null_key else df.filter(F.col("customer_id").isNotNull())).groupBy("customer_id")


def products_summary(
    products: DataFrame, fx: DataFrame, policy: Policy, keep_null_key: bool = False
) -> DataFrame:
    """Counts, product list, active limit and balance in USD, rates and delinquency."""
    labels = policy.tables["ref_product_catalog"].select(
        F.col("source_product_type").alias("product_type"), F.col("product_type").alias("_label")
    )
    usd = convert_on_date(
        products.join(F.broadcast(labels), "product_type", "left"), fx,
        {"current_balance": "_balance_usd", "credit_limit": "_limit_usd"},
        "currency", F.col("last_updated"),
    )
    active = F.col("product_status") == "Active"
    credit = F.col("_label").isin(*CREDIT_TYPES)
    late = F.col("days_past_due")
    return _per_customer(usd, keep_null_key).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(active).alias("active_products"),
        F.array_join(F.array_sort(F.collect_set("product_type")), ", ").alias("product_types"),
        F.sum(F.when(active, F.col("_limit_usd"))).alias("total_credit_limit_usd"),
        F.sum(F.when(active, F.col("_balance_usd"))).alias("total_current_balance_usd"),
        F.round(F.avg(F.when(credit, F.col("interest_rate"))), 2).alias("avg_credit_interest_rate"),
        F.max(late).alias("max_days_past_due"),
        F.round(F.avg(late), 1).alias("avg_days_past_due"),
        F.max(F.when(late > 30, 1).otherwise(0)).alias("has_delinquent_product"),
        F.max(F.when(credit, 1).otherwise(0)).alias("has_credit_product"),
    )


def complaints_summary(complaints: DataFrame, fx: DataFrame, keep_null_key: bool = False) -> DataFrame:
    """Counts by type, status and priority, SLA breaches, amounts in USD at their own dates."""
    created = F.to_date("creation_date")
    usd = convert_on_date(complaints, fx, {"claimed_amount": "_claimed_usd"}, "currency", created)
    usd = convert_on_date(usd, fx, {"compensation_granted": "_granted_usd"}, "currency",
                          F.coalesce("resolution_date", created))
    is_open = F.col("status").isin(*OPEN_STATUSES)
    critical = F.col("priority") == "Critical"
    urgent = is_open & F.col("priority").isin(*PRIORITY)

    def case(name: str) -> Column:
        return F.count_if(F.col("case_type") == name)

    return _per_customer(usd, keep_null_key).agg(
        F.count(F.lit(1)).alias("total_complaints"),
        case("Claim").alias("total_claims"),
        case("Complaint").alias("total_complaints_only"),
        case("Request").alias("total_requests"),
        case("Suggestion").alias("total_suggestions"),
        F.count_if(is_open).alias("open_cases"),
        F.count_if(F.col("status").isin("Resolved", "Closed")).alias("resolved_cases"),
        F.count_if(F.col("status") == "Rejected").alias("rejected_cases"),
        F.count_if(critical).alias("critical_cases"),
        F.count_if(urgent).alias("open_priority_cases"),
        F.count_if("sla_breached").alias("sla_breaches"),
        F.count_if("is_repeat_complainer").alias("repeat_complaint_flags"),
        F.sum("_claimed_usd").alias("total_claimed_amount_usd"),
        F.sum("_granted_usd").alias("total_compensation_granted_usd"),
        F.avg("resolution_days").alias("avg_resolution_days"),
        F.max("resolution_days").alias("max_resolution_days"),
        F.avg("resolution_satisfaction").alias("avg_resolution_satisfaction"),
        (F.count_if("sla_breached") > 0).alias("has_sla_breach"),
        (F.count_if(critical) > 0).alias("has_critical_complaint"),
        (F.count_if(urgent) > 0).alias("has_open_priority_complaint"),
    )


def cashflow_summary(
    transactions: DataFrame, fx: DataFrame, as_of: date | None = None, keep_null_key: bool = False
) -> DataFrame:
    """Approved transactions of the last 90 days of data: income, expense, transfers, fraud.

    The window ends at ``as_of`` or, without it, at the last process date of
    the table, which a scalar subquery finds before the scan starts.
    """
    end = F.lit(as_of).cast("date") if as_of else transactions.agg(F.max("process_date")).scalar()
    recent = transactions.filter(
        (F.col("transaction_status") == "Approved")
        & (F.col("process_date") > F.date_sub(end, CASHFLOW_WINDOW_DAYS))
        & (F.col("process_date") <= end)
    )
    at_rate = convert_on_date(recent, fx, {"amount": "_converted"}, "currency", F.to_date("transaction_date"))
    amount = F.when(F.col("currency") == "USD", F.col("amount")).otherwise(
        F.coalesce("amount_usd", "_converted"))

    def total(*types: str) -> Column:
        return F.sum(F.when(F.col("transaction_type").isin(*types), F.col("_usd")).otherwise(0.0))

    return _per_customer(at_rate.withColumn("_usd", amount), keep_null_key).agg(
        F.count(F.lit(1)).alias("total_transactions_90d"),
        total("Deposit").alias("total_income_usd_90d"),
        total("Withdrawal", "Payment", "Purchase").alias("total_expense_usd_90d"),
        total("Transfer").alias("total_transfer_usd_90d"),
        total("Adjustment").alias("total_adjustment_usd_90d"),
        F.round(F.avg("_usd"), 2).alias("avg_transaction_amount_usd"),
        F.count_if("is_fraud").alias("fraud_flags_90d"),
        (F.count_if("is_fraud") > 0).alias("has_recent_fraud"),
    )


def unlinked_interactions(interactions: DataFrame, complaints: DataFrame) -> DataFrame:
    """Interactions from which no complaint was opened."""
    origins = (
        complaints.filter(F.col("origin_interaction_id").isNotNull())
        .select(F.col("origin_interaction_id").alias("interaction_id")).distinct()
    )
    return interactions.join(origins, "interaction_id", "left_anti")


def case_context(complaints: DataFrame, interactions: DataFrame, policy: Policy) -> DataFrame:
    """One row per open case: complaints of any age, and recent unresolved interactions
    that did not become a complaint."""
    cutoff = policy.cutoff
    opened = F.to_date("creation_date")
    no, text = F.lit(False), F.lit(None).cast("string")
    open_complaints = complaints.filter(
        F.col("status").isin(*OPEN_STATUSES) & (opened <= cutoff)
    ).select(
        "customer_id", F.lit("complaint").alias("case_source"),
        F.col("complaint_id").alias("case_id"), opened.alias("opened_on"),
        F.col("reception_channel").alias("channel"), "category", "case_type", "priority", "status",
        (F.col("status") == "Escalated").alias("is_escalated"),
        F.coalesce("sla_breached", no).alias("sla_breached"), text.alias("sentiment"),
        F.coalesce("is_repeat_complainer", no).alias("is_repeat_complainer"),
    )
    day = F.to_date("interaction_date")
    unresolved = unlinked_interactions(
        interactions.filter(
            ~F.col("was_resolved") & (F.col("requires_followup") | F.col("was_escalated"))
            & (day > F.date_sub(cutoff, CASE_WINDOW_DAYS)) & (day <= cutoff)
        ),
        complaints,
    ).select(
        "customer_id", F.lit("interaction").alias("case_source"),
        F.col("interaction_id").alias("case_id"), day.alias("opened_on"), "channel",
        F.col("reason_category").alias("category"), text.alias("case_type"), text.alias("priority"),
        F.lit("Unresolved").alias("status"), F.coalesce("was_escalated", no).alias("is_escalated"),
        no.alias("sla_breached"), F.col("detected_sentiment").alias("sentiment"),
        no.alias("is_repeat_complainer"),
    )
    return open_complaints.unionByName(unresolved).withColumns({
        "days_open": F.datediff(cutoff, F.col("opened_on")),
        "as_of_date": cutoff,
    })
