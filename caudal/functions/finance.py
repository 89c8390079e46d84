"""Annuity formulas as Column expressions, and the same two as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _discount(rate: Column, months: Column) -> Column:
    """Share of a principal repaid by the annuity: 1 - (1 + r)^-n."""
    return 1 - F.pow(1 + rate / 1200, -months)


def _unusable(amount: Column, months: Column) -> Column:
    return amount.isNull() | (amount <= 0) | months.isNull() | (months <= 0)


def monthly_installment(principal: Column, annual_rate_pct: Column, term_months: Column) -> Column:
    """Fixed installment that repays ``principal``; 0 for a missing principal or term."""
    rate = F.coalesce(annual_rate_pct, F.lit(0.0))
    return (
        F.when(_unusable(principal, term_months), F.lit(0.0))
        .when(rate == 0, principal / term_months)
        .otherwise(principal * (rate / 1200) / _discount(rate, term_months))
    )


def max_principal(installment: Column, annual_rate_pct: Column, term_months: Column) -> Column:
    """Largest principal that ``installment`` repays; the inverse of the above."""
    rate = F.coalesce(annual_rate_pct, F.lit(0.0))
    return (
        F.when(_unusable(installment, term_months), F.lit(0.0))
        .when(rate == 0, installment * term_months)
        .otherwise(installment * _discount(rate, term_months) / (rate / 1200))
    )


def register_sql(spark: SparkSession) -> None:
    """Expose both formulas to SQL text as temporary functions."""
    guard = "{x} IS NULL OR {x} <= 0 OR months IS NULL OR months <= 0"
    for name, arg, flat, annuity in (
        ("monthly_installment", "principal", "principal / months",
         "principal * (rate / 1200) / (1 - power(1 + rate / 1200, -months))"),
        ("max_principal", "installment", "installment * months",
         "installment * (1 - power(1 + rate / 1200, -months)) / (rate / 1200)"),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}"
            f"({arg} DOUBLE, rate DOUBLE, months INT) RETURNS DOUBLE RETURN "
            f"CASE WHEN {guard.format(x=arg)} THEN 0D "
            f"WHEN coalesce(rate, 0) = 0 THEN {flat} ELSE {annuity} END"
        )
