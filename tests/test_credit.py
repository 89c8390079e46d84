"""The worked examples of the credit rules, and the gate."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from caudal.contracts import ENTITIES
from caudal.plans import offers
from caudal.plans.options import offer_options
from caudal.plans.policy import policy_tables, resolve_policy
from caudal.plans.profile import credit_profile
from caudal.plans.silver import silver
from caudal.quality.contract import contract_columns, contract_violations
from caudal.quality.gate import QualityGateError, latest_run, raise_on_failure, record_and_gate
from caudal.quality.metrics import gold_metrics, table_metrics

CUTOFF = date(2026, 6, 30)


@pytest.fixture(scope="module")
def policy(spark):
    return resolve_policy(policy_tables(spark))


def frame(spark, entity, data):
    types = ENTITIES[entity].types
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    return spark.createDataFrame([tuple(row.get(c) for c in types) for row in data], schema)


def person(i, **changes):
    row = dict(customer_id=i, country="México", segment="Basic", customer_status="Active", credit_score=650,
               estimated_monthly_income=50000.0, accepts_marketing=True, registration_date=date(2020, 1, 1),
               date_of_birth=date(1990, 1, 1))
    return {**row, **changes}


@pytest.fixture(scope="module")
def bank(spark):
    customers = [
        person("example"),
        person("age58", credit_score=800, date_of_birth=date(1968, 6, 30)),
        person("age72", credit_score=800, date_of_birth=date(1954, 6, 30)),
        person("no-birth-date", date_of_birth=None),
        person("inactive", customer_status="Closed"),
        person("no-income", estimated_monthly_income=None),
        person("no-score", credit_score=None),
        person("low-score", credit_score=500),
        person("silent", accepts_marketing=None),
        person("critical"),
        person("blocked"),
        person("late"),
        person("fraud"),
        person("new", registration_date=date(2026, 1, 1)),
        person("poor", estimated_monthly_income=100.0),
        person("argentine", country="Argentina", estimated_monthly_income=2_500_000.0),
    ]
    card = dict(product_type="Tarjeta Crédito", product_status="Active", currency="USD", days_past_due=0)
    products = [
        # one loan whose installment is about 100 USD
        dict(card, product_id="p1", customer_id="example", product_type="Préstamo Personal",
             credit_limit=100 / 0.048582, interest_rate=15.2),
        dict(card, product_id="p2", customer_id="blocked", product_status="Suspended", product_type="Fondo"),
        dict(card, product_id="p3", customer_id="late", current_balance=10.0, days_past_due=31),
        dict(card, product_id="p4", customer_id="argentine", product_type="Préstamo Hipotecario", credit_limit=None,
             current_balance=None, currency="ARS"),
        dict(card, product_id="p5", customer_id="argentine", current_balance=-50.0, credit_limit=1000.0),
    ]
    transactions = [
        dict(transaction_id="t1", customer_id="fraud", is_fraud=True, process_date=date(2026, 4, 2), currency="USD"),
        dict(transaction_id="t2", customer_id="example", is_fraud=True, process_date=date(2026, 4, 1), currency="USD"),
        dict(transaction_id="t3", customer_id="example", transaction_type="Deposit", transaction_status="Approved",
             process_date=date(2026, 3, 1), currency="MXN", amount=1200.0),
    ]
    complaints = [
        dict(complaint_id="c1", customer_id="critical", status="Open", priority="Critical", creation_date=datetime(2026, 6, 1)),
        dict(complaint_id="c2", customer_id="example", status="Closed", priority="Critical", creation_date=datetime(2026, 6, 1)),
    ]
    fx = [dict(source_currency=c, target_currency="USD", date=date(2026, 6, 17), exchange_rate=r)
          for c, r in (("MXN", 0.05), ("ARS", 0.001))]
    data = dict(customers=customers, products=products, transactions=transactions, complaints=complaints,
                daily_exchange_rates=fx)
    return {e: frame(spark, e, d) for e, d in data.items()}


@pytest.fixture(scope="module")
def profile(bank, policy):
    return credit_profile(bank, policy)


def keyed(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_profile(profile):
    p = keyed(profile, "customer_id")
    assert {k: r["reason_codes"] for k, r in p.items() if r["reason_codes"]} == {
        "inactive": ["R01_INACTIVE_CUSTOMER"], "new": ["R02_SHORT_TENURE"], "late": ["R03_DELINQUENCY"],
        "blocked": ["R04_BLOCKED_PRODUCT"], "no-income": ["R05_INCOME_MISSING"], "poor": ["R05_INCOME_BELOW_MIN"],
        "no-score": ["R06_SCORE_MISSING"], "low-score": ["R06_SCORE_BELOW_MIN"], "fraud": ["R07_RECENT_FRAUD"],
    }
    assert p["example"]["max_total_installment_usd"] == 500.0
    assert p["silent"]["offer_mode"] == "on_customer_interest"
    assert p["silent"]["not_proactive_reason"] == "no_marketing_consent"
    assert p["critical"]["not_proactive_reason"] == "open_critical_complaint" and p["critical"]["requires_advisor_review"]
    assert p["example"]["offer_mode"] == "proactive" and p["example"]["risk_band"] == "C"
    assert p["example"]["avg_monthly_deposits_usd_6m"] == 10.0 and p["example"]["confirmed_fraud_tx_recent"] == 0
    assert (p["age58"]["max_term_mortgage_months"], p["age58"]["max_term_personal_loan_months"]) == (204, 60)
    assert (p["age72"]["max_term_mortgage_months"], p["age72"]["max_term_personal_loan_months"]) == (36, 36)
    assert p["no-birth-date"]["max_term_by_age_months"] is None and p["no-birth-date"]["max_term_mortgage_months"] == 300
    # a loan without any amount counts, and costs nothing
    assert p["argentine"]["active_mortgages"] == 1 and p["argentine"]["active_credit_cards"] == 1
    assert p["argentine"]["current_installments_usd"] == 0.0 and p["argentine"]["local_currency"] == "ARS"


@pytest.fixture(scope="module")
def example(profile):
    """Exactly 100 USD of installments, as in the worked example."""
    return profile.filter("customer_id = 'example'").withColumns({
        "current_installments_usd": F.lit(100.0), "available_installment_usd": F.lit(400.0)})


def test_worked_example(example, policy):
    o = keyed(offer_options(example, policy), "product_code", "term_months", "tier")
    short, long = o[("PL", 24, None)], o[("PL", 48, None)]
    assert (short["offer_max_amount_usd"], short["offer_monthly_installment_usd"]) == (8200, 398.37)
    assert (long["offer_max_amount_usd"], long["offer_monthly_installment_usd"]) == (12700, 398.06)
    assert o[("PL", 60, None)]["unavailable_reason"] == "term_above_band_maximum"
    assert short["max_amount_by_capacity_usd"] == 8233.55 and short["offer_max_amount_local"] == 164000
    featured = {k for k, r in o.items() if r["is_featured"]}
    # 46,400 USD over 240 months at 8.4% beat 45,400 over 300 at 9.6%
    assert featured == {("PL", 48, None), ("MG", 240, None), ("CC", 60, "Classic")}
    assert o[("CC", 60, "Black")]["unavailable_reason"] == "capacity_below_option_minimum"


@pytest.mark.parametrize("declared, offer, flags", [
    ((None, 1000.0, 0.0, None), 12300, ["F02_NEAR_LIMIT_DECLARED_INCOME", "F03_DECLARED_DATA"]),
    ((None, None, None, 150.0), 5100, ["F03_DECLARED_DATA"]),
    ((None, 1000.0, None, None), 8200, []),  # household income without that person's installments
    ((3500.0, None, None, None), 12300, ["F02_NEAR_LIMIT_DECLARED_INCOME", "F03_DECLARED_DATA"]),
])
def test_recalculation(spark, example, policy, declared, offer, flags):
    old = ("example", "2026-06-01", 9e6, None, None, None)
    schema = "customer_id string, declared_at string, " + ", ".join(f"{a} double" for a in offers.AMOUNTS)
    declarations = spark.createDataFrame([old, ("example", "2026-06-02", *declared)], schema)
    found = keyed(offers.recalculate(example, declarations, policy), "product_code", "term_months", "tier")[("PL", 24, None)]
    assert (found["offer_max_amount_usd"], found["flags"]) == (offer, flags)


def test_missing_income_is_recoverable(spark, profile, policy):
    schema = "customer_id string, declared_at string, " + ", ".join(f"{a} double" for a in offers.AMOUNTS)
    said = spark.createDataFrame([("no-income", "2026-06-02", 2500.0, None, None, None)], schema)
    row = offers.declared_profile(profile, said, policy).first()
    assert row["is_eligible"] and row["income_source"] == "declared_in_chat"


def test_accepted_offer_record(spark, example, policy):
    options = offer_options(offers.undeclared(example), policy, offers.CARRY)
    taken = spark.createDataFrame(
        [("f1", "example", "PL", 24, 8200.0, "s", "chat", "es", datetime(2026, 7, 1, 9))],
        "offer_id string, customer_id string, option_code string, term_months int, accepted_amount_usd double, "
        "session_id string, channel string, language string, accepted_at timestamp")
    record = offers.accepted_offers(options, taken, policy)
    assert len(record.columns) == 43 and record.first()["refusal_reasons"] == []
    row = record.first()
    assert row["monthly_installment_usd"] == 398.37 and row["debt_to_income_after"] == pytest.approx(0.19935, abs=1e-5)
    assert row["flags"] == [] and row["valid_until"] == date(2026, 7, 31) and row["offer_origin"] == "proactive"


def test_contract(profile):
    promised = contract_columns("customer_credit_profile")
    assert len(promised) + len(contract_columns("customer_credit_offer_options")) == 44
    assert contract_violations(profile.withColumn("new", F.lit(1)), promised) == []
    broken = profile.drop("segment").withColumn("open_complaints", F.col("open_complaints").cast("int"))
    assert contract_violations(broken, promised) == [("segment", "string"), ("open_complaints", "bigint")]
    assert len(profile.columns) == 52


def test_gold_metrics_find_faults(bank, profile, policy):
    options = offer_options(profile, policy).withColumn(
        "offer_monthly_installment_usd", F.col("offer_monthly_installment_usd") + 1e6)
    doubled = profile.unionByName(profile.limit(1))
    found = keyed(gold_metrics(doubled, options, {"s": profile}, bank["customers"], policy), "table_name", "metric")
    status = {k[1]: r["status"] for k, r in found.items()}
    assert status["rows_vs_silver_customers"] == "fail" and status["available_above_capacity"] == "fail"
    assert status["rows_vs_customers_x_grid"] == "fail" and status["featured_option_violations"] == "ok"
    assert found[("s", "duplicate_customer_rows")]["status"] == "ok"


def test_gate_stores_metrics_before_it_stops(spark, tmp_path):
    stamp = F.lit("2026-07-01").cast("timestamp").alias("_bronze_ingested_at")
    raw = spark.range(3).select(*[F.col("id").cast("string").alias("branch_id") if c == "branch_id"
                                  else F.lit(None).cast("string").alias(c) for c in ENTITIES["branches"].names],
                                F.lit(None).cast("string").alias("_rescued_data"), stamp)
    clean = silver(raw, "branches")
    history = str(tmp_path / "m")
    record_and_gate(spark, table_metrics(raw, clean, "branches"), history, ("bronze", "silver"), "good")
    empty = table_metrics(raw.limit(0), clean.limit(0), "branches")
    assert {r["metric"]: r["value"] for r in empty.collect()}["key_duplicates_removed_share"] is None
    with pytest.raises(QualityGateError, match="branches.rows = 0.0"):
        record_and_gate(spark, empty, history, ("bronze", "silver"), "bad")
    stored = spark.read.parquet(history)
    assert stored.filter("run_id = 'bad'").count() == 7 and latest_run(stored, ["silver"]).first()["run_id"] == "bad"
    with pytest.raises(Exception, match="quality gate failed"):
        raise_on_failure(stored).collect()


def test_gold_inputs_are_worked_out_once(spark, monkeypatch):
    """Profile and summaries read stored tables; each raw table is cleaned once, and only what they read is stored."""
    from testbed import queries

    asked = []
    plain = queries.bronze
    monkeypatch.setattr(queries, "bronze", lambda s, sf, name: (asked.append(name), plain(s, sf, name))[1])
    stored = queries.stored_inputs(spark, "/root/testdata/sf0.001")
    assert sorted(asked) == sorted(queries.GOLD_INPUTS)
    for name, df in stored.items():
        assert "transactions" not in name or "latitude" not in df.columns
        whole = queries.clean(spark, "/root/testdata/sf0.001", name).select(*df.columns)
        assert df.count() == whole.count() and df.exceptAll(whole).isEmpty()
        assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_a_refresh_stores_what_open_cases_read(spark, tmp_path, rows):
    from caudal.plans import summaries
    from testbed import queries

    sf, base, calls = "/root/testdata/sf0.001", str(tmp_path / "silver"), "call_center_interactions"
    stored = queries.stored_inputs(spark, sf, base, cases=True)
    assert "fraud_score" not in spark.read.parquet(f"{base}/transactions").columns
    policy, whole = queries.policy_of(spark), queries.clean(spark, sf, calls)
    narrow = queries.silver(queries.bronze(spark, sf, calls), calls, summaries.CASE_READS[calls])
    found = rows(summaries.case_context(stored["complaints"], narrow, policy))
    assert found and found == rows(summaries.case_context(queries.clean(spark, sf, "complaints"), whole, policy))
