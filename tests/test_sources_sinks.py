import json

import pytest
from pyspark.sql import functions as F

from caudal.plans import policy as pol
from caudal.sinks.constrained import validate, validated_append
from caudal.sinks.publish import publish, read_export, read_manifest
from caudal.sinks.tables import add_by_name, rebuild
from caudal.sources.files import read_files, read_strings
from caudal.sources.ledger import list_files, new_files
from caudal.streaming.ingest import append_stream, stream_files, stream_strings, to_bronze


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_csv_by_name_with_rescued_columns_and_malformed_rows(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", 'id,name,amount\n1,"x, ""y""\nz",5\n2,b\n3,c,7,8\n')
    write(folder, "b.csv", "amount,extra,id,name,more\n9,e,4,d,\n,,5,,\n")
    path = write(folder, "c.csv", "﻿id,amount\n6,1\n7,2,3\n")
    found = by_id(read_strings(spark, path, ["id", "name", "amount"]))
    assert found["1"]["name"] == 'x, "y"\nz' and found["1"]["_rescued_data"] is None
    assert found["4"]["amount"] == "9" and json.loads(found["4"]["_rescued_data"])["extra"] == "e"
    assert found["5"]["_rescued_data"] is None and found["6"]["name"] is None
    for broken, text in (("2", "2,b"), ("3", "3,c,7,8"), ("7", "7,2,3")):
        assert json.loads(found[broken]["_rescued_data"])["_malformed"] == text
    assert len(found) == 7 and all(r["_source_file_path"].startswith("file:") for r in found.values())


def test_dropping_empty_rows_does_not_repeat_the_values(spark, tmp_path):
    """Spark moves the filter below the projection; the array of all fields must not be made there for each column."""
    path = write(tmp_path / "in", "a.csv", "id,name,amount\n1,x,5\n,,\n,y,\n")
    kept = to_bronze(read_strings(spark, path, ["id", "name", "amount"]))
    assert {(r["id"], r["name"]) for r in kept.collect()} == {("1", "x"), (None, "y")}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("array(_c0") == 1


def test_csv_of_one_layout(spark, tmp_path):
    path = write(tmp_path / "in", "a.csv", "extra,id\nq,1\n,2\n")
    found = by_id(read_strings(spark, path, ["id", "gone"], multiline=False))
    assert json.loads(found["1"]["_rescued_data"])["extra"] == "q"
    assert found["2"]["_rescued_data"] is None and found["2"]["gone"] is None


def test_formats(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "j"))
    spark.range(3).write.orc(str(tmp_path / "o"))
    assert read_files(spark, str(tmp_path / "j"), "json", "id bigint").count() == 3
    assert read_files(spark, str(tmp_path / "o"), "orc").count() == 3
    path = write(tmp_path / "x", "a.xml", "<rows><row><a>1</a></row><row><a>2</a></row></rows>")
    assert read_files(spark, path, "xml", rowTag="row").count() == 2
    for unsupported in ("xls", "excel"):
        with pytest.raises(ValueError):
            read_files(spark, path, unsupported)


def test_stream_takes_each_file_once(spark, tmp_path):
    path = write(tmp_path / "in", "a.csv", "id,my col\n1,x\n,\n")

    def run():
        files = stream_files(spark, path, "id string, `my col` string", header=True)
        append_stream(to_bronze(files), str(tmp_path / "out"), str(tmp_path / "ck"))
        return spark.read.parquet(str(tmp_path / "out"))

    first = run()
    assert first.count() == 1 and "my_col" in first.columns and "_source_file_size" in first.columns
    write(tmp_path / "in", "b.csv", "id,my col\n2,y\n")
    assert run().count() == 2 and run().count() == 2


def test_ledger(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", "1")
    path = write(folder, "b.txt", "2")
    ledger = list_files(spark, path, "*.csv")
    assert ledger.count() == 1 and new_files(list_files(spark, path, "*.csv"), ledger).count() == 0
    grown = ledger.withColumn("length", F.col("length") - 1)
    assert new_files(list_files(spark, path, "*.csv"), grown).count() == 1


def test_rebuild_splits_a_hot_partition_and_keeps_the_others_small(spark, tmp_path):
    df = spark.range(200_000).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.when(F.col("id") % 3 == 0, "2026-01-01").otherwise(F.concat(F.lit("2026-02-"), F.col("id") % 28)).alias("d"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        rebuild(df.repartition(8), str(tmp_path / "t"), "d")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000
    hot = list((tmp_path / "t" / "d=2026-01-01").glob("*.parquet"))
    cold = list((tmp_path / "t" / "d=2026-02-1").glob("*.parquet"))
    assert len(hot) > 1 and len(cold) <= 2


def test_rebuild_leaves_no_shuffle_files(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    kept = lambda: sum(f.getName().startswith("shuffle_") for f in listed(disk.getAllFiles()))
    before, free = kept(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rebuild(spark.range(1000).selectExpr("id", "id % 9 AS d").repartition(5), str(tmp_path / "t"), "d")
    assert kept() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == free
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_rebuild_clusters(spark, tmp_path, rows):
    rebuild(spark.range(1000).select("id", (-F.col("id")).alias("x")), str(tmp_path / "t"), cluster_by=["x"])
    back = spark.read.parquet(str(tmp_path / "t")).groupBy(F.spark_partition_id()).agg(F.min("x"), F.max("x"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000 and back.count() >= 1


def test_add_by_name(spark, rows):
    table = spark.createDataFrame([(1, "a")], "x int, y string")
    assert rows(add_by_name(table, spark.createDataFrame([("b",)], "y string")), "x", "y") == [(1, "a"), (None, "b")]
    with pytest.raises(ValueError):
        add_by_name(table, spark.createDataFrame([("b",)], "z string"))


def test_validated_append(spark, tmp_path):
    target, rules = str(tmp_path / "t"), dict(pk=["id"], checks={"positive": "x > 0"}, required=["y"])
    data = [(1, 5, "a"), (1, 5, "a"), (1, 4, "a"), (2, -1, "a"), (3, None, "a"), (None, 1, "a"), (4, 1, None)]
    df = spark.createDataFrame(data, "id int, x int, y string")
    refused = validated_append(df, target, **rules)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 3]
    assert sum(r["_copies"] for r in refused.collect()) + 2 == len(data)
    found = {(r["id"], r["x"]): r["_violations"] for r in refused.collect()}
    assert found == {(1, 5): ["duplicate key"], (1, 4): ["duplicate key"], (2, -1): ["positive"],
                     (None, 1): ["id is null"], (4, 1): ["y is null"]}
    again = validated_append(df.limit(1), target, **rules)
    assert again.first()["_violations"] == ["duplicate key"] and spark.read.parquet(target).count() == 2


def test_validate_keeps_every_row(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("id"), (F.col("id") % 3 - 1).alias("x"))
    accepted, refused = validate(df, None, ["id"], {"positive": "x > 0"})
    assert accepted.count() + refused.agg(F.sum("_copies")).first()[0] == 1000


FIELDS = {"run_id": "r1", "as_of_date": "2026-06-30", "policy_version": "0.4"}


def test_publish(spark, tmp_path):
    tables = {"big": spark.range(25), "small": spark.range(2)}
    manifest = publish(spark, tables, str(tmp_path), FIELDS, {"big": 3, "small": 1})
    folder = tmp_path / manifest["folder"]
    assert manifest["rows"] == {"big": 25, "small": 2}
    assert len(list((folder / "big").glob("*.parquet"))) == 3 and len(list((folder / "small").glob("*.parquet"))) == 1
    assert {(r["table_name"], r["n_rows"], r["run_id"]) for r in read_manifest(spark, str(tmp_path)).collect()} == {
        ("big", 25, "r1"), ("small", 2, "r1")}
    assert read_export(spark, str(tmp_path), "big").count() == 25


def test_publish_that_fails_leaves_the_last_export(spark, tmp_path):
    publish(spark, {"t": spark.range(3)}, str(tmp_path), FIELDS)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        publish(spark, {"t": spark.range(9), "u": broken}, str(tmp_path), FIELDS)
    assert read_export(spark, str(tmp_path), "t").count() == 3


def test_repeated_header_names(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", "id,,\n1,p,q\n")
    write(folder, "b.csv", "id,x,x,x#2\n2,r,s,t\n")
    path = write(folder, "c.csv", "x,id,id\nu,3,v\n")
    found = by_id(read_strings(spark, path, ["id"]))
    shown = {i: {k: v for k, v in json.loads(r["_rescued_data"]).items() if k != "_file_path"} for i, r in found.items()}
    assert shown == {"1": {"#2": "p", "#3": "q"}, "2": {"x#2": "r", "x#3": "s", "x#2#4": "t"}, "3": {"x": "u", "id#3": "v"}}


def test_stream_of_files_by_column_name(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    path = write(folder, "a.csv", "id,name\n1,x\n")

    def run():
        stream_strings(spark, path, ["id", "name"], lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"),
                       str(tmp_path / "ck"))
        return by_id(spark.read.parquet(out))

    assert run()["1"]["name"] == "x"
    write(folder, "b.csv", "name,id,extra\ny,2,e\nz,3,f,g\n")
    again = run()
    assert again["2"]["name"] == "y" and json.loads(again["2"]["_rescued_data"])["extra"] == "e"
    assert json.loads(again["3"]["_rescued_data"])["_malformed"] == "z,3,f,g" and len(run()) == 3


def test_policy_from_files_equals_the_built_in_one(spark, tmp_path, rows):
    for name, schema in pol.SCHEMAS.items():
        spark.createDataFrame(pol.ROWS[name], schema).coalesce(1).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    loaded, built = pol.load_policy(spark, str(tmp_path)), pol.policy_tables(spark)
    for name in pol.SCHEMAS:
        columns = [c for c in built[name].columns if not c.startswith("_")]
        assert loaded[name].dtypes == built[name].dtypes
        assert rows(loaded[name], *columns) == rows(built[name], *columns)
    policy = pol.resolve_policy(loaded, "2026-05-31")
    assert str(policy.as_of_date) == "2026-05-31" and policy.max_debt_to_income == 0.2
    assert str(pol.resolve_policy(loaded, "nonsense").as_of_date) == "2026-06-30"
