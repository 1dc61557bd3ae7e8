from datetime import date

import pytest
from pyspark.sql import types as T

from ledgerlake.operators.expect import CheckFailed
from ledgerlake.sources import catalog, files

SCHEMA = T.StructType([T.StructField("day", T.DateType()), T.StructField("n", T.LongType()), T.StructField("v", T.StringType())])
DAY = date(2026, 1, 1)


@pytest.fixture
def table(spark, tmp_path):
    name = f"made_{tmp_path.name}".replace("-", "_").lower()
    catalog.ensure_namespace(spark, name, str(tmp_path / "space"))
    catalog.ensure_namespace(spark, name)
    assert catalog.ensure_table(spark, f"{name}.t", SCHEMA, ["day"], {"keeper": "it's mine"}, str(tmp_path / "t"))
    yield f"{name}.t"
    spark.sql(f"DROP NAMESPACE {name} CASCADE")


def test_created_once_and_checked_after(spark, table):
    assert not catalog.ensure_table(spark, table, SCHEMA, ["day"], {"keeper": "other"})
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    assert properties["keeper"] == "it's mine"
    assert [(c.name, c.isPartition) for c in spark.catalog.listColumns(table)] == [("n", False), ("v", False), ("day", True)]
    wider = T.StructType([*SCHEMA.fields[:1], T.StructField("n", T.IntegerType()), *SCHEMA.fields[2:]])
    with pytest.raises(CheckFailed, match=r"missing \['n int'\], unexpected \['n bigint'\]"):
        catalog.ensure_table(spark, table, wider, ["day"])
    with pytest.raises(CheckFailed, match="another schema"):
        catalog.ensure_table(spark, table, SCHEMA)


def test_append_goes_by_name_and_never_narrows(spark, table):
    catalog.append(spark.createDataFrame([(1, "a", DAY)], "n int, v string, day date"), table)
    catalog.append(spark.createDataFrame([("b", DAY, 2)], "v string, day date, n bigint"), table)
    rows = spark.table(table)
    assert {(r.n, r.v, r.day) for r in rows.collect()} == {(1, "a", DAY), (2, "b", DAY)}
    for wrong, reason in (
        ("v string, day date, n double", "n double to bigint"),
        ("v int, day date, n bigint", "v int to string"),
        ("v string, day date", "do not fit"),
        ("v string, day date, n bigint, x int", "do not fit"),
    ):
        with pytest.raises(CheckFailed, match=reason):
            catalog.append(spark.createDataFrame([], wrong), table)
    assert rows.count() == 2


@pytest.mark.parametrize(
    ("source", "target", "fits"),
    [
        ("int", "bigint", True),
        ("bigint", "int", False),
        ("float", "double", True),
        ("int", "double", True),
        ("bigint", "double", False),
        ("decimal(5,2)", "decimal(10,2)", True),
        ("decimal(10,2)", "decimal(10,4)", False),
        ("date", "timestamp", True),
        ("timestamp", "date", False),
        ("void", "int", True),
        ("array<int>", "array<bigint>", False),
    ],
)
def test_widening(source, target, fits):
    assert catalog.widens(*map(T._parse_datatype_string, (source, target))) == fits


def test_files_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 2 AS half", "'x' AS unread").repartition(3).write.partitionBy("half").parquet(path)
    rows = spark.read.parquet(path)
    found = files.data_files(rows, "half").collect()
    assert len(found) == 6 and sum(r.rows for r in found) == 100 and all(r.file_size > 0 and r.blocks == 1 for r in found)
    summary = {r.half: (r.files, r.rows) for r in files.file_summary(rows, "half").collect()}
    assert summary == {0: (3, 50), 1: (3, 50)}
    total = files.file_summary(rows).first()
    assert (total.files, total.rows, total.bytes) == (6, 100, sum(r.file_size for r in found))
    assert "ReadSchema: struct<>" in files.file_summary(rows, "half")._jdf.queryExecution().executedPlan().toString()
