"""Quality metrics of a run: one row per layer, table and metric."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.contracts import ENTITIES, METRIC_SCHEMA, Entity
from caudal.operators.dedup import content_duplicates
from caudal.plans.policy import Policy
from caudal.quality.contract import contract_metrics

MAX_DUPLICATE_SHARE = 0.05
ELIGIBLE_SHARE = (0.20, 0.50)


def _metric(layer: str, table: str | Column, name: str, value: Column, threshold, good: Column, bad="fail"):
    """One metric row; a missing value counts as bad."""
    return F.struct(
        F.lit(layer).alias("layer"),
        (F.lit(table) if isinstance(table, str) else table).alias("table_name"),
        F.lit(name).alias("metric"),
        value.cast("double").alias("value"),
        (F.lit(threshold) if isinstance(threshold, str) else threshold).alias("threshold"),
        F.when(good, F.lit("ok")).otherwise(F.lit(bad)).alias("status"),
    )


def _rows(one_row: DataFrame, metrics: Sequence[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*metrics)))


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def table_metrics(bronze: DataFrame, silver: DataFrame, name: str, spec: Entity | None = None) -> DataFrame:
    """All metrics of one source table.

    Bronze is read once.  Silver is read once for counts, NULL shares and key
    duplicates together, grouped by key so that the duplicates fall out of the
    group sizes, and once more for the content key.
    """
    spec = spec or ENTITIES[name]
    raw = bronze.agg(*raw_counts(spec))
    shares = list(spec.max_null_share)
    per_key = silver.groupBy(*spec.key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in shares],
    )
    clean = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("clean_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("key_duplicates"),
        *[F.sum(f"_null_{c}").alias(f"_null_{c}") for c in shares],
    )
    # every part is one row
    return _source_rows(raw.crossJoin(clean), silver, name, spec)


def raw_counts(spec: Entity) -> list[Column]:
    """What is counted of a raw table."""
    return [
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("_rescued_data").isNotNull()).alias("rescued"),
        F.count_if(_any_null(spec.key)).alias("null_keys"),
    ]


def clean_counts(spec: Entity) -> list[Column]:
    """What is counted of a clean table besides duplicates."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in spec.max_null_share]
    return [F.count(F.lit(1)).alias("clean_rows"), *nulls]


def written_metrics(raw: Mapping, clean: Mapping, silver: DataFrame, name: str, spec: Entity | None = None) -> DataFrame:
    """The metrics of ``table_metrics`` from counts taken while both tables were written; only duplicates are counted now,
    from the key columns and the content key of ``silver``."""
    spec = spec or ENTITIES[name]
    known = {**raw, **clean}
    shape = ", ".join(f"`{column}` long" for column in known)
    counted = silver.sparkSession.createDataFrame([tuple(known.values())], shape)
    per_key = silver.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_n"))
    copies = per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("key_duplicates"))
    return _source_rows(counted.crossJoin(copies), silver, name, spec)


def _source_rows(one: DataFrame, silver: DataFrame, name: str, spec: Entity) -> DataFrame:
    rows, missing = F.col("raw_rows"), F.col("null_keys")
    removed = (rows - missing - F.col("clean_rows")) / F.nullif(rows, F.lit(0))
    metrics = [
        _metric("bronze", name, "rows", rows, "> 0", rows > 0),
        _metric("bronze", name, "rescued_rows", F.col("rescued"),
                "= 0 (warn: schema change or malformed rows)", F.col("rescued") == 0, "warn"),
        _metric("bronze", name, "null_key_rows", missing,
                "= 0 (warn: dropped in silver)", missing == 0, "warn"),
        _metric("silver", name, "rows", F.col("clean_rows"), "> 0", F.col("clean_rows") > 0),
        _metric("silver", name, "key_duplicates_removed_share", F.round(removed, 4),
                "<= 0.05", removed <= MAX_DUPLICATE_SHARE),
        _metric("silver", name, "key_duplicate_rows_left", F.col("key_duplicates"),
                "= 0", F.col("key_duplicates") == 0),
    ]
    if spec.content_key:
        copies = content_duplicates(silver, spec.content_key).agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("content_duplicates")
        )
        one = one.crossJoin(copies)
        metrics.append(_metric(
            "silver", name, "content_duplicate_rows", F.col("content_duplicates"),
            "= 0 (warn: same record under another id)", F.col("content_duplicates") == 0, "warn"))
    for column, limit in spec.max_null_share.items():
        share = F.col(f"_null_{column}") / F.nullif(F.col("clean_rows"), F.lit(0))
        metrics.append(_metric("silver", name, f"null_share_{column}", F.round(share, 4),
                               f"<= {limit:.2f}", share <= limit))
    return _rows(one, metrics)


def source_metrics(bronze: Mapping[str, DataFrame], silver: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics of every table in ``silver``."""
    return reduce(DataFrame.unionByName, (table_metrics(bronze[n], silver[n], n) for n in silver))


def load_report(bronze: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and rescued rows of each raw table."""
    return reduce(DataFrame.unionByName, (
        df.agg(F.count(F.lit(1)).alias("n_rows"),
               F.count_if(F.col("_rescued_data").isNotNull()).alias("rescued_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows", "rescued_rows")
        for name, df in bronze.items()
    ))


def profile_metrics(profile: DataFrame, customers: DataFrame, policy: Policy) -> DataFrame:
    """Row parity with the customers, complete lineage, one policy version, plausible share."""
    name = "customer_credit_profile"
    n = F.count(F.lit(1))
    found = profile.agg(
        n.alias("n"), F.count_distinct("customer_id").alias("ids"),
        F.count_if(_any_null(["as_of_date", "policy_version", "fx_to_usd"])).alias("incomplete"),
        F.count_distinct("policy_version").alias("versions"),
        F.max("policy_version").alias("version"),
        F.avg(F.col("is_eligible").cast("int")).alias("share"),
    )
    params = policy.tables["ref_policy_params"].filter("param_name = 'policy_version'")
    one = found.crossJoin(customers.agg(n.alias("customers"))).crossJoin(
        params.agg(F.max("param_value").alias("loaded")))
    c = F.col
    return _rows(one, [
        _metric("gold", name, "rows_vs_silver_customers", c("n"),
                F.concat(F.lit("= silver customers ("), c("customers"),
                         F.lit(") and = distinct ids ("), c("ids"), F.lit(")")),
                (c("n") == c("ids")) & (c("n") == c("customers"))),
        _metric("gold", name, "rows_missing_cutoff_policy_or_fx", c("incomplete"), "= 0",
                c("incomplete") == 0),
        _metric("gold", name, "policy_versions_in_profile", c("versions"),
                F.concat(F.lit("= 1 and = silver policy_version "), F.coalesce("loaded", F.lit("null")),
                         F.lit(" (profile: "), F.coalesce("version", F.lit("null")), F.lit(")")),
                (c("versions") == 1) & (c("version") == c("loaded"))),
        _metric("gold", name, "eligible_share", F.round("share", 4), "0.20-0.50",
                c("share").between(*ELIGIBLE_SHARE)),
    ])


def option_metrics(options: DataFrame, profile: DataFrame, policy: Policy) -> DataFrame:
    """Completeness, capacity, term, range and featured checks, from one pass over the options."""
    name = "customer_credit_offer_options"
    # unique by customer, so that a doubled profile row does not double its options
    limits = profile.groupBy("customer_id").agg(
        F.min("available_installment_usd").alias("_capacity"),
        F.min("max_term_personal_loan_months").alias("_pl"),
        F.min("max_term_mortgage_months").alias("_mg"),
    )
    c, available = F.col, F.col("is_available")
    too_long = ((c("product_code") == "PL") & (c("term_months") > c("_pl"))) | (
        (c("product_code") == "MG") & (c("term_months") > c("_mg")))
    wrong = (
        (c("offer_max_amount_usd") < c("option_min_amount_usd"))
        | (c("offer_max_amount_usd") > c("option_max_amount_usd"))
        | c("unavailable_reason").isNotNull() | (c("offer_mode") == "none")
    )
    # a customer has as many options as the grid has rows, so these groups stay small
    per_product = options.join(limits, "customer_id", "left").groupBy("customer_id", "product_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(available & (c("offer_monthly_installment_usd") > c("_capacity") + 0.01)).alias("above"),
        F.count_if(available & too_long).alias("long"),
        F.count_if(available & wrong).alias("wrong"),
        F.count_if("is_featured").alias("featured"),
        F.count_if(c("is_featured") & ~available).alias("featured_unavailable"),
        F.bool_or("is_available").alias("some"),
    )
    bad_feature = (c("featured") != c("some").cast("int")) | (c("featured_unavailable") > 0)
    found = per_product.agg(
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "above", "long", "wrong")],
        F.count_if(bad_feature).alias("bad_feature"),
    )
    n = F.count(F.lit(1))
    one = found.crossJoin(profile.agg(n.alias("customers"))).crossJoin(
        policy.tables["ref_term_grid"].agg(n.alias("grid")))
    expected = c("customers") * c("grid")
    return _rows(one, [
        _metric("gold", name, "rows_vs_customers_x_grid", c("n"),
                F.concat(F.lit("= "), expected), c("n") == expected),
        _metric("gold", name, "available_above_capacity", c("above"), "= 0", c("above") == 0),
        _metric("gold", name, "available_above_band_max_term", c("long"), "= 0", c("long") == 0),
        _metric("gold", name, "available_out_of_range_or_not_eligible", c("wrong"), "= 0", c("wrong") == 0),
        _metric("gold", name, "featured_option_violations", c("bad_feature"), "= 0", c("bad_feature") == 0),
    ])


# metric names and threshold texts are fixed values, as published
def duplicate_customers(summary: DataFrame, name: str) -> DataFrame:
    found = summary.agg((F.count(F.lit(1)) - F.count_distinct("customer_id")).alias("extra"))
    return _rows(found, [_metric("gold", name, "duplicate_customer_rows", F.col("extra"), "= 0",
                                 F.col("extra") == 0)])


def case_metrics(cases: DataFrame, policy: Policy) -> DataFrame:
    """Each case once, none opened after the cutoff."""
    name = "customer_case_context"
    found = cases.agg(
        (F.count(F.lit(1)) - F.count_distinct("case_source", "case_id")).alias("extra"),
        F.count_if(F.col("opened_on") > policy.cutoff).alias("late"),
    )
    return _rows(found, [
        _metric("gold", name, "duplicate_case_rows", F.col("extra"), "= 0", F.col("extra") == 0),
        _metric("gold", name, "cases_after_cutoff", F.col("late"), "= 0", F.col("late") == 0),
    ])


def gold_metrics(
    profile: DataFrame,
    options: DataFrame,
    summaries: Mapping[str, DataFrame],
    customers: DataFrame,
    policy: Policy,
) -> DataFrame:
    """All checks of the gold tables."""
    parts = [
        profile_metrics(profile, customers, policy),
        option_metrics(options, profile, policy),
        *[duplicate_customers(df, name) for name, df in summaries.items()],
        contract_metrics({
            "customer_credit_profile": profile, "customer_credit_offer_options": options,
        }),
    ]
    return reduce(DataFrame.unionByName, parts)


def stamp(metrics: DataFrame, run_id: str = "") -> DataFrame:
    """Add run id and time, in the shape of the metrics history."""
    names = [item.split()[0] for item in METRIC_SCHEMA.split(",")]
    return metrics.withColumns({
        "run_id": F.lit(run_id or f"manual-{uuid.uuid4()}"),
        "run_at": F.current_timestamp(),
    }).select(*names)
