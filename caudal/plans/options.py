"""Offer options: every customer against every row of the term grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.finance import max_principal, monthly_installment
from caudal.plans.policy import Policy


def option_grid(policy: Policy) -> DataFrame:
    """The term grid with the amount and rate limits of its product; as many rows as the grid.

    Cards keep the limits of their tier, loans may take any amount of the product.
    """
    catalog = policy.tables["ref_product_catalog"].select(
        "product_code", "min_rate_pct", "max_rate_pct",
        F.col("min_amount_usd").alias("_product_min"), F.col("max_amount_usd").alias("_product_max"),
    )
    grid = policy.tables["ref_term_grid"].select(
        F.col("product_code").alias("option_code"),
        F.split("product_code", "-").getItem(0).alias("product_code"),
        "product_type", "tier", "term_months", "reference_rate_pct",
        F.col("min_amount_usd").alias("_tier_min"), F.col("max_amount_usd").alias("_tier_max"),
    )
    card = F.col("product_code") == "CC"
    return grid.join(F.broadcast(catalog), "product_code").select(
        "option_code", "product_code", "product_type", "tier", "term_months", "reference_rate_pct",
        "min_rate_pct", "max_rate_pct",
        F.when(card, F.col("_tier_min")).otherwise(F.col("_product_min")).alias("option_min_amount_usd"),
        F.when(card, F.col("_tier_max")).otherwise(F.col("_product_max")).alias("option_max_amount_usd"),
    )


def price_options(profile: DataFrame, policy: Policy) -> DataFrame:
    """Rate, size and availability of every option; profile columns stay available."""
    p = F.col
    offer_rate = F.least(
        F.greatest(p("reference_rate_pct") + p("total_rate_adjustment_pp"), p("min_rate_pct")),
        p("max_rate_pct"),
    )
    term_limit = F.when(p("product_code") == "PL", p("max_term_personal_loan_months")).when(
        p("product_code") == "MG", p("max_term_mortgage_months")
    )
    capacity = F.greatest(F.coalesce("available_installment_usd", F.lit(0.0)), F.lit(0.0))
    capped = F.floor(F.least(p("_capacity_amount"), p("option_max_amount_usd")) / 100) * 100
    return (
        profile.crossJoin(F.broadcast(option_grid(policy)))
        .withColumns({
            "_rate": offer_rate,
            "term_allowed": F.when(p("product_code") == "CC", F.lit(True))
            .otherwise(p("term_months") <= term_limit),
        })
        .withColumn("_capacity_amount", max_principal(capacity, p("_rate"), p("term_months")))
        .withColumn("_amount", capped)
        .withColumn("is_available", F.coalesce(
            p("is_eligible") & p("term_allowed") & (p("_amount") >= p("option_min_amount_usd")),
            F.lit(False),
        ))
    )


def offer_options(profile: DataFrame, policy: Policy, carry: Sequence[str] = ()) -> DataFrame:
    """The published options, 28 columns, plus the profile columns named in ``carry``.

    The profile is spread by customer before the grid multiplies it, so the
    ranking within a customer needs no shuffle of the options.
    """
    options = price_options(profile.repartition("customer_id"), policy)
    # cards: highest tier; loans: highest amount; then the shortest term
    rank = F.row_number().over(
        Window.partitionBy("customer_id", "product_code").orderBy(
            F.col("is_available").desc(), F.col("option_max_amount_usd").desc(),
            F.col("_amount").desc(), F.col("term_months").asc(), F.col("option_code").asc(),
        )
    )
    available, fx = F.col("is_available"), F.col("fx_to_usd")
    installment = monthly_installment(F.col("_amount").cast("double"), F.col("_rate"), F.col("term_months"))
    featured = options.withColumn("is_featured", available & (rank == 1)).withColumn(
        "_installment", F.when(available, installment)
    )
    return featured.select(
        "customer_id", "option_code", "product_code", "product_type", "tier", "term_months",
        "reference_rate_pct", "total_rate_adjustment_pp",
        F.round("_rate", 2).alias("offer_rate_pct"),
        "option_min_amount_usd", "option_max_amount_usd", "term_allowed",
        F.round("_capacity_amount", 2).alias("max_amount_by_capacity_usd"),
        "is_available", "is_featured", "offer_mode",
        F.when(~F.col("is_eligible"), "customer_not_eligible")
        .when(~F.col("term_allowed"), "term_above_band_maximum")
        .when(F.col("_amount") < F.col("option_min_amount_usd"), "capacity_below_option_minimum")
        .alias("unavailable_reason"),
        F.when(available, F.col("_amount")).cast("bigint").alias("offer_max_amount_usd"),
        F.round("_installment", 2).alias("offer_monthly_installment_usd"),
        "local_currency", "fx_to_usd",
        F.when(available, F.round(F.col("_amount") / fx, 0)).alias("offer_max_amount_local"),
        F.round(F.col("_installment") / fx, 0).alias("offer_monthly_installment_local"),
        "risk_band", "segment", "as_of_date", "policy_version",
        F.current_timestamp().alias("computed_at"),
        *carry,
    )


def featured_options(options: DataFrame) -> DataFrame:
    """The one option per customer and product to present first."""
    return options.filter("is_featured")
