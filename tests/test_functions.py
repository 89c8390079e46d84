import pytest
from pyspark.sql import functions as F

from caudal.functions.finance import max_principal, monthly_installment, register_sql
from caudal.functions.keys import identity_hash, sequence_expr
from caudal.operators import cleanse


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("amount, rate, term, expected", [
    (40000.0, 6.2, 180, 341.88), (8200.0, 15.2, 24, 398.37), (12700.0, 21.7, 48, 398.06),
    (1200.0, 0.0, 12, 100.0), (None, 5.0, 12, 0.0), (1000.0, 5.0, 0, 0.0), (-5.0, 5.0, 12, 0.0),
    (1200.0, None, 12, 100.0),
])
def test_installment_in_both_forms(spark, amount, rate, term, expected):
    lit = [F.lit(amount).cast("double"), F.lit(rate).cast("double"), F.lit(term)]
    assert one(spark, monthly_installment(*lit)) == pytest.approx(expected, abs=0.005)
    register_sql(spark)
    sql = [("NULL" if v is None else f"{v}D" if isinstance(v, float) else str(v)) for v in (amount, rate, term)]
    assert spark.sql(f"SELECT monthly_installment({', '.join(sql)}) AS x").first()["x"] == pytest.approx(expected, abs=0.005)


def test_principal_is_the_inverse(spark):
    assert one(spark, max_principal(F.lit(400.0), F.lit(15.2), F.lit(24))) == pytest.approx(8233.549, abs=1e-3)
    again = monthly_installment(max_principal(F.lit(321.0), F.lit(7.7), F.lit(240)), F.lit(7.7), F.lit(240))
    assert one(spark, again) == pytest.approx(321.0)


def test_sequence_of_one_and_of_several_columns(spark):
    df = spark.createDataFrame([("2026-01-02", "03:04:05")], "d string, t string")
    both = df.select(sequence_expr(["d", "t"], "yyyy-MM-dd HH:mm:ss").cast("string").alias("x"))
    assert both.first()["x"] == "2026-01-02 03:04:05"
    assert df.select(sequence_expr("d", "yyyy-MM-dd").cast("string").alias("x")).first()["x"] == "2026-01-02 00:00:00"
    with pytest.raises(ValueError):
        sequence_expr(["d", "t"])


def test_identity_hash_ignores_audit_columns_and_column_order(spark):
    a = spark.createDataFrame([("x", None, "f1")], "b string, a string, _f string")
    b = spark.createDataFrame([(None, "x", "f2")], "a string, b string, _f string")
    assert a.select(identity_hash(a)).first()[0] == b.select(identity_hash(b)).first()[0]


def test_cleaning(spark, rows):
    df = spark.createDataFrame([("805.0", None, "m"), (None, None, "n")], "`a b` string, `c;(d)` string, _m string")
    clean = cleanse.drop_empty_rows(cleanse.sanitize_names(df))
    assert clean.columns == ["a_b", "c_d_", "_m"]
    assert rows(clean.select(cleanse.int_via_double(F.col("a_b")))) == [(805,)]
    full = cleanse.ensure_columns(clean, {"_m": "string", "_n": "bigint"})
    assert full.dtypes[-1] == ("_n", "bigint") and full.columns.count("_m") == 1


def test_projection_and_declared_types(spark):
    df = spark.createDataFrame([(1, "1")], "a int, flag string")
    assert cleanse.project(df, {"a": "x", "gone": "y"}, allow_missing=True).columns == ["x", "y"]
    with pytest.raises(ValueError):
        cleanse.project(df, {"gone": "y"})
    assert cleanse.flags_to_boolean(df, {"flag": "BIT", "a": "int"}).dtypes == [("a", "int"), ("flag", "boolean")]
    kinds = {"Money": "decimal(19,4)", "decimal(10, 2)": "decimal(10,2)", "datetime2(7)": "timestamp",
             "nvarchar(20)": "string", "geometry": "string", "numeric": "decimal(38,0)"}
    assert {k: cleanse.declared_type(k) for k in kinds} == kinds
