"""Credit policy: the five reference tables and the parameters a run uses."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.operators.cleanse import params_row
from caudal.operators.lookup import POLICY_ROWS

# The policy tables, version 0.4.
SCHEMAS: dict[str, str] = {
    "ref_product_catalog": (
        "product_code string, product_type string, source_product_type string, "
        "min_amount_usd int, max_amount_usd int, min_rate_pct double, max_rate_pct double, "
        "allowed_terms_months string, is_synthetic boolean"
    ),
    "ref_term_grid": (
        "product_code string, product_type string, tier string, term_months int, "
        "term_years int, reference_rate_pct double, min_amount_usd int, max_amount_usd int, "
        "is_synthetic boolean"
    ),
    "ref_policy_bands": (
        "band string, min_credit_score int, rate_adjustment_pp double, offer_allowed boolean, "
        "max_term_personal_loan_months int, max_term_mortgage_months int"
    ),
    "ref_segment_adjustments": "segment string, rate_adjustment_pp double",
    "ref_policy_params": "param_name string, param_value string, unit string, description string",
}
ROWS: dict[str, list[tuple]] = {
    "ref_product_catalog": [
        ("CC", "Credit Card", "Tarjeta Crédito", 1000, 50000, 18.0, 45.0, "60", True),
        ("PL", "Personal Loan", "Préstamo Personal", 5000, 150000, 12.0, 28.0, "24|36|48|60", True),
        ("MG", "Mortgage", "Préstamo Hipotecario", 5000, 150000, 6.0, 12.0, "180|240|300|360", True),
    ],
    "ref_term_grid": [
        ("CC-CLA", "Credit Card", "Classic", 60, 5, 39.6, 1000, 21000, True),
        ("CC-GLD", "Credit Card", "Gold", 60, 5, 34.2, 21000, 35000, True),
        ("CC-PLT", "Credit Card", "Platinum", 60, 5, 28.8, 35000, 45000, True),
        ("CC-BLK", "Credit Card", "Black", 60, 5, 23.4, 45000, 50000, True),
        ("MG", "Mortgage", None, 180, 15, 7.2, 5000, 40000, True),
        ("MG", "Mortgage", None, 240, 20, 8.4, 40000, 77000, True),
        ("MG", "Mortgage", None, 300, 25, 9.6, 77000, 114000, True),
        ("MG", "Mortgage", None, 360, 30, 10.8, 114000, 150000, True),
        ("PL", "Personal Loan", None, 24, 2, 15.2, 5000, 41000, True),
        ("PL", "Personal Loan", None, 36, 3, 18.4, 41000, 78000, True),
        ("PL", "Personal Loan", None, 48, 4, 21.7, 78000, 113000, True),
        ("PL", "Personal Loan", None, 60, 5, 24.8, 113000, 150000, True),
    ],
    "ref_policy_bands": [
        ("A", 740, -2.0, True, 60, 360),
        ("B", 680, -1.0, True, 60, 360),
        ("C", 620, 0.0, True, 48, 300),
        ("D", 560, 2.0, True, 36, 240),
        ("E", 0, 0.0, False, 0, 0),
    ],
    "ref_segment_adjustments": [
        ("Premium", -1.0), ("Plus", -0.5), ("Basic", 0.0), ("Student", 1.0),
    ],
    "ref_policy_params": [
        ("max_debt_to_income", "0.20", "ratio", None),
        ("min_tenure_months", "6", "months", None),
        ("max_days_past_due", "30", "days", None),
        ("min_income_usd", "300", "USD", None),
        ("fraud_lookback_days", "90", "days", None),
        ("offer_validity_days", "30", "days", None),
        ("max_age_at_maturity_years", "75", "years", None),
        ("as_of_date", "2026-06-30", "date", None),
        ("policy_version", "0.4", "version", None),
    ],
}
# Card tiers for deriving the grid (position in the observed limits and rates, percent).
CARD_TIERS_SCHEMA = (
    "tier string, tier_code string, tier_rank int, limit_from_pct int, limit_to_pct int, rate_pct int"
)
CARD_TIERS = [
    ("Classic", "CLA", 1, 0, 40, 80), ("Gold", "GLD", 2, 40, 70, 60),
    ("Platinum", "PLT", 3, 70, 90, 40), ("Black", "BLK", 4, 90, 100, 20),
]
PARAM_TYPES = {
    "max_debt_to_income": "double", "min_tenure_months": "int", "max_days_past_due": "int",
    "min_income_usd": "double", "fraud_lookback_days": "int", "offer_validity_days": "int",
    "max_age_at_maturity_years": "int", "as_of_date": "date", "policy_version": "string",
}
LOCAL_CURRENCY = {"México": "MXN", "Colombia": "COP", "Argentina": "ARS"}
DEBT_TO_INCOME_NEAR_LIMIT = 0.19


def _finish(tables: dict[str, DataFrame], version: str | None) -> dict[str, DataFrame]:
    """Split the term list and stamp version and load time on every table."""
    terms = F.transform(F.split("allowed_terms_months", r"\|"), lambda t: t.cast("int"))
    catalog = tables["ref_product_catalog"].withColumn("allowed_terms_months", terms)
    return {
        name: df.withColumns({
            **({} if name == "ref_policy_params" else {"policy_version": F.lit(version)}),
            "_loaded_at": F.current_timestamp(),
        })
        for name, df in {**tables, "ref_product_catalog": catalog}.items()
    }


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a constant of the plan."""
    columns = {f.split()[0]: list(v) for f, v in zip(schema.split(","), zip(*rows))}
    return spark.createDataFrame(pa.table(columns), schema=schema)


def policy_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in policy tables."""
    tables = {n: constant_table(spark, ROWS[n], s).withColumn("_source_file", F.lit(None).cast("string"))
              for n, s in SCHEMAS.items()}
    return _finish(tables, {r[0]: r[1] for r in ROWS["ref_policy_params"]}["policy_version"])


def load_policy(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The policy tables from ``<folder>/<table>.csv`` with declared types."""
    tables = {
        name: spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv")
        .select("*", F.col("_metadata.file_path").alias("_source_file"))
        for name, schema in SCHEMAS.items()
    }
    return _finish(tables, params_row(tables["ref_policy_params"], PARAM_TYPES).first()["policy_version"])


@dataclass(frozen=True)
class Policy:
    """The policy of one run: its tables, and its parameters as plain values.

    With the cutoff as a literal in the plans, scans of date-partitioned
    tables skip the partitions outside the windows.
    """

    tables: dict[str, DataFrame]
    max_debt_to_income: float
    min_tenure_months: int
    max_days_past_due: int
    min_income_usd: float
    fraud_lookback_days: int
    offer_validity_days: int
    max_age_at_maturity_years: int
    as_of_date: date
    policy_version: str

    @property
    def cutoff(self):
        return F.lit(self.as_of_date)


def _pinned(name: str, table: DataFrame) -> DataFrame:
    """The table as a constant of the plan; one with more rows than a policy can have is refused."""
    rows = table.drop("_loaded_at").limit(POLICY_ROWS + 1).toArrow()
    if rows.num_rows > POLICY_ROWS:
        raise ValueError(f"{name} has more than {POLICY_ROWS} rows")
    pinned = table.sparkSession.createDataFrame(rows, schema=table.drop("_loaded_at").schema)
    return pinned.withColumn("_loaded_at", F.current_timestamp())


def resolve_policy(tables: dict[str, DataFrame], as_of: str = "") -> Policy:
    """Pin the policy tables of a run and read the parameters (one row).

    A valid ``as_of`` replaces the policy's cutoff date.
    """
    pinned = {name: _pinned(name, table) for name, table in tables.items()}
    wanted = F.lit(as_of or None).cast("string").try_cast("date")
    row = (
        params_row(pinned["ref_policy_params"], PARAM_TYPES)
        .withColumn("as_of_date", F.coalesce(wanted, "as_of_date"))
        .first()
    )
    return Policy(tables=pinned, **row.asDict())
