"""Deriving the credit catalog and the term grid from what customers hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.operators.fx import rates_as_of
from caudal.operators.quantiles import exact_quantiles
from caudal.operators.small import join_small, unique_join
from caudal.plans.policy import CARD_TIERS, CARD_TIERS_SCHEMA, Policy, constant_table
from caudal.plans.profile import local_currency
from caudal.session import checkpointed


def _active_credit(products: DataFrame, fx: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Active credit products with their limit in USD at the latest rate, and those rates."""
    rates = rates_as_of(fx)
    types = policy.tables["ref_product_catalog"].select(F.col("source_product_type").alias("product_type"))
    active = products.filter(F.col("product_status") == "Active").join(
        F.broadcast(types), "product_type", "left_semi"
    )
    usd = join_small(active, rates, ["currency"], "inner")
    return usd.withColumn("amount_usd", F.col("credit_limit") * F.col("to_usd")), rates


def observed_catalog(
    customers: DataFrame, products: DataFrame, fx: DataFrame, policy: Policy
) -> DataFrame:
    """Per country and product type: holders, share in USD, rates and amounts in both currencies."""
    active, rates = _active_credit(products, fx, policy)
    home = customers.groupBy("customer_id").agg(F.min("country").alias("country"))
    held = unique_join(
        active.select("customer_id", "product_type", "currency", "interest_rate", "amount_usd"),
        home, ["customer_id"],
    ).withColumn("local_currency", local_currency(F.col("country"))).filter("local_currency IS NOT NULL")
    held = checkpointed(held)  # read by several aggregates below
    group = ["country", "product_type"]
    counts = held.groupBy(*group, "local_currency").agg(
        F.count(F.lit(1)).alias("active_products"),
        F.count_distinct("customer_id").alias("customers"),
        F.round(100.0 * F.avg((F.col("currency") == "USD").cast("int")), 1).alias("pct_usd_denominated"),
        F.round(F.min("interest_rate"), 2).alias("rate_min"),
        F.round(F.max("interest_rate"), 2).alias("rate_max"),
        F.min("amount_usd").alias("_low"), F.max("amount_usd").alias("_high"),
    )
    rate = exact_quantiles(held, group, "interest_rate", [0.5], "_rate")
    amount = exact_quantiles(held, group, "amount_usd", [0.5], "_amount")
    local = rates.select(F.col("currency").alias("local_currency"), F.col("to_usd").alias("_to_usd"))
    # one row per country and product type from here on
    rows = join_small(counts.join(rate, group, "left").join(amount, group, "left"),
                      local, ["local_currency"], "inner")
    middle = F.col("_amount")[0]
    return rows.select(
        *group, "local_currency", "active_products", "customers", "pct_usd_denominated",
        "rate_min", F.round(F.col("_rate")[0], 2).alias("rate_p50"), "rate_max",
        F.round("_low").alias("amount_usd_min"), F.round(middle).alias("amount_usd_p50"),
        F.round("_high").alias("amount_usd_max"),
        F.round(F.col("_low") / F.col("_to_usd")).alias("amount_local_min"),
        F.round(middle / F.col("_to_usd")).alias("amount_local_p50"),
        F.round(F.col("_high") / F.col("_to_usd")).alias("amount_local_max"),
    ).orderBy("product_type", "country")


def term_grid(products: DataFrame, fx: DataFrame, policy: Policy) -> DataFrame:
    """Reference rate and amount range per product and term (loans) or tier (cards).

    Term k of n takes the rate at quantile k/(n+1) and the k-th of n equal
    slices of the observed amounts; a tier takes its slice of the limits.
    """
    active, _ = _active_credit(products, fx, policy)
    active = checkpointed(active.select("product_type", "interest_rate", "amount_usd"))
    percentiles = [i / 100 for i in range(101)]
    observed = exact_quantiles(active, ["product_type"], "interest_rate", percentiles, "_rates").join(
        exact_quantiles(active, ["product_type"], "amount_usd", percentiles, "_amounts"), "product_type"
    ).withColumnRenamed("product_type", "source_product_type")

    terms = policy.tables["ref_product_catalog"].select(
        "product_code", "product_type", "source_product_type", "min_amount_usd", "max_amount_usd",
        F.explode("allowed_terms_months").alias("term_months"),
        F.size("allowed_terms_months").alias("_n"),
    ).withColumn("_k", F.row_number().over(Window.partitionBy("product_code").orderBy("term_months")))

    def place(share):
        return F.round(100 * share).cast("int")

    card = F.col("product_type") == "Credit Card"
    tiers = constant_table(products.sparkSession, CARD_TIERS, CARD_TIERS_SCHEMA)
    loans = terms.filter(~card).select(
        "*", F.lit(None).cast("string").alias("tier"), F.lit(None).cast("int").alias("tier_rank"),
        F.col("product_code").alias("_code"),
        place(F.col("_k") / (F.col("_n") + 1)).alias("_rate_at"),
        place((F.col("_k") - 1) / F.col("_n")).alias("_low_at"),
        place(F.col("_k") / F.col("_n")).alias("_high_at"),
    )
    cards = terms.filter(card).crossJoin(F.broadcast(tiers)).select(
        *terms.columns, "tier", "tier_rank", F.concat_ws("-", "product_code", "tier_code").alias("_code"),
        F.col("rate_pct").alias("_rate_at"), F.col("limit_from_pct").alias("_low_at"),
        F.col("limit_to_pct").alias("_high_at"),
    )
    thousands = F.round(F.col("_amounts")[F.col("_low_at")], -3), F.round(F.col("_amounts")[F.col("_high_at")], -3)
    return (
        loans.unionByName(cards).join(F.broadcast(observed), "source_product_type")
        .orderBy("product_type", "tier_rank", "term_months")
        .select(
            F.col("_code").alias("product_code"), "product_type", "tier", "term_months",
            F.expr("term_months div 12").cast("int").alias("term_years"),
            F.round(F.col("_rates")[F.col("_rate_at")], 1).alias("reference_rate_pct"),
            F.greatest(thousands[0].cast("int"), "min_amount_usd").alias("min_amount_usd"),
            F.least(thousands[1].cast("int"), "max_amount_usd").alias("max_amount_usd"),
            F.lit(True).alias("is_synthetic"),
        )
    )
