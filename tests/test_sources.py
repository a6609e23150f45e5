"""Files in and out."""

from pyspark.sql import functions as F

from valprint.functions import codec
from valprint.operators import cells
from valprint.sources import tables


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("id,name\n007,a\nx,b\n9,\n")
    assert [tuple(r) for r in tables.csv_text(spark, str(p)).collect()] == [("007", "a"), ("x", "b"), ("9", None)]
    assert [r["id"] for r in tables.csv_lenient(spark, str(p), "id int, name string").select("id", "name").collect() if r["id"]] == [7, 9]
    assert tables.csv_typed(spark, str(p)).dtypes == [("id", "string"), ("name", "string")]


def test_json_rows(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"results": [{"code": "1", "label": "one"}, {"code": "2", "label": null}]}')
    assert [tuple(r) for r in tables.json_rows(spark, str(p), "results", "code: string, label: string").collect()] == [("1", "one"), ("2", None)]


def test_captures(spark, tmp_path):
    df = spark.createDataFrame([("s", "d", "t.a", "2024-01-01", 1), ("s", "d", "t.a", "2024-02-01", 2), ("s", "d", "t.a", "2024-03-01", 3)], "dataserver string, database string, cid string, at string, n int")
    tables.write_captures(df.withColumn("sample_time", F.to_timestamp("at")).drop("at"), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert [r["n"] for r in tables.captures_as_of(back, ["cid"], "2024-02-15").collect()] == [2]


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([("x", 1), ("y", 2)], "domain string, n int").write.partitionBy("domain").parquet(path)
    tables.replace_partitions(spark.createDataFrame([(3, "y")], "n int, domain string"), path, "domain")
    assert sorted((r["domain"], r["n"]) for r in spark.read.parquet(path).collect()) == [("x", 1), ("y", 3)]


def test_csv_out(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("a",)], "v string"), str(tmp_path / "o"))
    assert tables.csv_text(spark, str(tmp_path / "o")).collect()[0]["v"] == "a"


def test_stored_fingerprints(spark):
    df = spark.createDataFrame([("t.a", "CA"), ("t.a", "ca"), ("t.a", "CA"), ("t.a", "NY")], "cid string, val string")
    row = cells.fingerprints(df).select("n_sampled", "n_distinct", F.size(codec.from_portable("raw")), F.size(codec.from_portable("folded"))).first()
    assert list(row) == [4, 3, 3, 2]
    assert cells.sample_distinct(df, 2).count() == 2 and cells.sampled(df, 100.0).count() == 4
