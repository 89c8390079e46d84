"""Source contracts: columns and types, business keys, winners, thresholds.

Everything here is data.  The code that applies it lives in ``operators``,
``plans`` and ``quality``.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Entity:
    """One source table: raw columns arrive as STRING, ``columns`` gives the clean type."""

    columns: str
    key: tuple[str, ...]
    latest_by: tuple[str, ...]
    content_key: tuple[str, ...] = ()
    partition_by: str | None = None
    trim: tuple[str, ...] = ()
    max_null_share: dict[str, float] = field(default_factory=dict)

    @property
    def types(self) -> dict[str, str]:
        return dict(item.split() for item in self.columns.replace("\n", " ").split(","))

    @property
    def names(self) -> list[str]:
        return list(self.types)


# Column lists, clean types, keys and thresholds of the ten sources.
ENTITIES: dict[str, Entity] = {
    "branches": Entity(
        """branch_id string, branch_code string, branch_name string, branch_type string,
           branch_status string, address string, city string, state string, country string,
           postal_code string, latitude double, longitude double, phone string, email string,
           opening_time string, closing_time string, branch_opening_date date, has_atms boolean,
           atm_count int, has_teller_windows boolean, teller_window_count int,
           geographic_zone string""",
        key=("branch_id",),
        latest_by=("_bronze_ingested_at",),
        content_key=("branch_code",),
    ),
    "call_center_interactions": Entity(
        """interaction_id string, interaction_date timestamp, process_date date,
           customer_id string, agent_id string, channel string, interaction_type string,
           contact_reason string, reason_category string, mentioned_products string,
           duration_seconds int, wait_time_seconds int, was_resolved boolean,
           requires_followup boolean, was_escalated boolean, has_recording boolean,
           has_transcript boolean, detected_sentiment string, sentiment_score double,
           customer_detected_accent string, agent_used_accent string""",
        key=("interaction_id",),
        latest_by=("process_date",),
        content_key=("customer_id", "agent_id", "interaction_date"),
        partition_by="process_date",
        max_null_share={"customer_id": 0.10},
    ),
    "campaign_sends": Entity(
        """send_id string, campaign_id string, customer_id string, send_date timestamp,
           process_date date, send_channel string, template_used string, subject string,
           send_status string, was_delivered boolean, was_opened boolean, open_date timestamp,
           was_clicked boolean, click_date timestamp, click_count int, had_conversion boolean,
           conversion_date timestamp, conversion_value double, open_device string,
           open_country string, failure_reason string, send_cost double""",
        key=("send_id",),
        latest_by=("process_date", "send_date"),
        content_key=("campaign_id", "customer_id", "send_date"),
        partition_by="process_date",
        trim=("send_channel", "send_status"),
        max_null_share={"customer_id": 0.10},
    ),
    "complaints": Entity(
        """complaint_id string, creation_date timestamp, process_date date, customer_id string,
           case_type string, category string, subcategory string, reception_channel string,
           affected_product_id string, related_branch_id string, origin_interaction_id string,
           description string, claimed_amount double, currency string, priority string,
           status string, assigned_agent_id string, assignment_date timestamp,
           first_response_date timestamp, resolution_date date, closing_date date,
           sla_breached boolean, resolution_days double, resolution string,
           compensation_granted double, resolution_satisfaction double,
           is_repeat_complainer boolean""",
        key=("complaint_id",),
        latest_by=("process_date", "creation_date"),
        content_key=("customer_id", "creation_date", "case_type", "category"),
        partition_by="process_date",
        max_null_share={"customer_id": 0.10},
    ),
    "customers": Entity(
        """customer_id string, first_name string, last_name string, email string,
           document_type string, document_number string, date_of_birth date, gender string,
           marital_status string, education_level string, occupation string,
           mobile_phone string, landline_phone string, address string, city string,
           state string, postal_code string, country string, segment string,
           customer_status string, credit_score int, estimated_monthly_income double,
           accepts_marketing boolean, registration_date date, registration_branch_id string,
           last_updated date, detected_accent string""",
        key=("customer_id",),
        latest_by=("last_updated",),
        content_key=("document_number",),
        max_null_share={"credit_score": 0.20, "estimated_monthly_income": 0.25},
    ),
    "daily_exchange_rates": Entity(
        """source_currency string, target_currency string, date date, exchange_rate double,
           buy_rate double, sell_rate double, source string""",
        key=("source_currency", "target_currency", "date"),
        latest_by=("_bronze_ingested_at",),
        max_null_share={"exchange_rate": 0.0},
    ),
    "marketing_campaigns": Entity(
        """campaign_id string, campaign_name string, campaign_type string,
           campaign_objective string, campaign_status string, description string,
           start_date date, end_date date, budget double, expected_conversion_rate double,
           target_segment string, target_country string, promoted_product string""",
        key=("campaign_id",),
        latest_by=("_bronze_ingested_at",),
        content_key=("campaign_name", "start_date"),
    ),
    "products": Entity(
        """product_id string, product_number string, customer_id string, product_type string,
           product_status string, currency string, current_balance double, credit_limit double,
           interest_rate double, days_past_due int, opening_date date, expiration_date date,
           last_updated date, last_transaction_date date, opening_branch_id string,
           opening_channel string, has_linked_app boolean""",
        key=("product_id",),
        latest_by=("last_updated",),
        content_key=("product_number",),
        max_null_share={"customer_id": 0.10, "currency": 0.10},
    ),
    "service_agents": Entity(
        """agent_id string, employee_code string, first_name string, last_name string,
           email string, phone string, agent_type string, agent_status string,
           assigned_branch_id string, hire_date date, experience_level string,
           specialty string, languages string, native_accent string, country_of_origin string,
           work_shift string, avg_csat double, total_monthly_interactions int""",
        key=("agent_id",),
        latest_by=("_bronze_ingested_at",),
        content_key=("employee_code",),
    ),
    "transactions": Entity(
        """transaction_id string, transaction_date timestamp, process_date date,
           product_id string, customer_id string, transaction_type string,
           transaction_category string, amount double, currency string, amount_usd double,
           channel string, branch_id string, merchant_name string, merchant_category string,
           transaction_country string, transaction_city string, transaction_status string,
           response_code string, is_fraud boolean, fraud_score double, latitude double,
           longitude double""",
        key=("transaction_id",),
        latest_by=("process_date", "transaction_date"),
        content_key=(
            "customer_id", "product_id", "transaction_date", "amount", "transaction_type",
        ),
        partition_by="process_date",
        trim=("transaction_type", "transaction_category", "channel", "transaction_status"),
        max_null_share={"customer_id": 0.10, "amount": 0.10},
    ),
}

# History settings of the incremental path (keys, sequence, format, untracked).
HISTORY: dict[str, dict] = {
    "customers": dict(sequence="last_updated", fmt="yyyy-MM-dd HH:mm:ss", untracked=["last_updated"]),
    "products": dict(sequence="last_updated", fmt="yyyy-MM-dd HH:mm:ss", untracked=["last_updated"]),
    "daily_exchange_rates": dict(sequence="date", fmt="yyyy-MM-dd", untracked=[]),
    "transactions": dict(sequence="transaction_date", fmt="yyyy-MM-dd HH:mm:ss", untracked=[]),
    "call_center_interactions": dict(
        sequence="interaction_date", fmt="yyyy-MM-dd HH:mm:ss", untracked=[]
    ),
    "complaints": dict(sequence="creation_date", fmt="yyyy-MM-dd HH:mm:ss", untracked=[]),
    "branches": dict(sequence=None, fmt=None, untracked=[]),
    "marketing_campaigns": dict(sequence=None, fmt=None, untracked=[]),
    "service_agents": dict(sequence=None, fmt=None, untracked=[]),
}

# Audit columns and their types.
AUDIT_COLUMNS: dict[str, str] = {
    "_staging_ingested_at": "timestamp",
    "_source_file_path": "string",
    "_source_file_name": "string",
    "_source_file_size": "bigint",
    "_source_file_modified": "timestamp",
}

# Database type names of declared source schemas.
DECLARED_TYPES: dict[str, str] = {
    "bigint": "bigint", "int": "int", "smallint": "smallint", "tinyint": "tinyint",
    "bit": "smallint", "float": "double", "real": "float", "date": "date",
    "datetime": "timestamp", "datetime2": "timestamp", "smalldatetime": "timestamp",
    "time": "string", "uniqueidentifier": "string", "xml": "string", "text": "string",
    "ntext": "string", "image": "binary", "binary": "binary", "varbinary": "binary",
    "money": "decimal(19,4)", "smallmoney": "decimal(10,4)",
    "decimal": "decimal(38,0)", "numeric": "decimal(38,0)",
}

# Row shape of the quality metrics history.
METRIC_SCHEMA = (
    "run_id string not null, run_at timestamp not null, layer string not null, "
    "table_name string not null, metric string not null, value double, threshold string, "
    "status string not null"
)

# Columns and types the published gold tables promise.
GOLD_CONTRACT: dict[str, str] = {
    "customer_credit_profile": """
        customer_id string, is_eligible boolean, offer_mode string, not_proactive_reason string,
        reason_codes array<string>, requires_advisor_review boolean,
        can_become_eligible_with_declared_income boolean, risk_band string, segment string,
        local_currency string, fx_to_usd double, fx_date date, income_used_usd double,
        income_source string, current_installments_usd double, max_total_installment_usd double,
        available_installment_usd double, total_rate_adjustment_pp double,
        max_term_personal_loan_months int, max_term_mortgage_months int, open_complaints bigint,
        open_priority_complaints bigint, open_critical_complaints bigint, as_of_date date,
        policy_version string""",
    "customer_credit_offer_options": """
        customer_id string, option_code string, product_code string, product_type string,
        tier string, term_months int, offer_rate_pct double, option_min_amount_usd int,
        option_max_amount_usd int, is_available boolean, is_featured boolean,
        unavailable_reason string, offer_mode string, offer_max_amount_usd bigint,
        offer_monthly_installment_usd double, offer_max_amount_local double,
        offer_monthly_installment_local double, local_currency string, fx_to_usd double""",
}

# The accepted-offer record; "!" marks a column that may not be null.
CREDIT_OFFER_COLUMNS = """
    offer_id string !, customer_id string !, session_id string, channel string,
    language string, offer_origin string !, option_code string !, product_code string !,
    product_type string !, tier string, term_months int !, amount_usd double !,
    annual_rate_pct double !, monthly_installment_usd double !, local_currency string !,
    fx_to_usd double !, fx_date date, amount_local double !, monthly_installment_local double !,
    income_used_usd double !, income_source string !, current_installments_usd double !,
    max_total_installment_usd double !, debt_to_income_after double !, risk_band string !,
    segment string, rate_adjustment_pp double !, customer_declared_data string,
    open_complaints int !, open_priority_complaints int !, open_critical_complaints int !,
    is_conditional boolean !, flags array<string>, required_documents array<string>,
    status string !, handoff_ticket_id string, advisor_summary string, valid_until date !,
    profile_as_of_date date !, policy_version string !, created_at timestamp !,
    updated_at timestamp"""
