import pytest

from ledgerlake.operators.expect import CheckFailed
from ledgerlake.sources import readers, scratch, versions


def test_publish_and_pin(spark, tmp_path):
    table = str(tmp_path / "t")
    assert versions.pin(spark, table) is None and versions.current(spark, table) is None
    first = versions.publish(spark.range(3), table)
    pinned = first.read(spark)
    second = versions.publish(spark.range(5), table)
    assert (first.id, second.id) == (1, 2)
    assert pinned.count() == 3 and versions.current(spark, table).count() == 5
    declared = spark.range(1).selectExpr("id", "'x' AS later").limit(0).schema
    assert {r.later for r in versions.pin(spark, table, declared).read(spark).collect()} == {None}


def test_a_catalog_merge_takes_all_but_the_preserved_columns():
    taken = versions.merge_assignments(["k", "first", "v"], "k", ["first"])
    assert list(taken) == ["v"] and "source.v" in str(taken["v"])


def test_intermediate_tables_are_never_local_on_a_cluster(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch(spark, "x").startswith(base)
    scratch.refuse_local("local[4]", "file:/data")
    scratch.refuse_local("spark://host:7077", "hdfs://host/data")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.refuse_local(master, "file:/data")


def test_a_table_may_feed_its_own_next_version(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.publish(spark.range(3), table)
    versions.publish(versions.current(spark, table).filter("id > 0"), table)
    assert versions.current(spark, table).count() == 2


def test_refused_publish_keeps_the_old_version(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.publish(spark.range(3), table)

    def refuse(written):
        assert written.count() == 9
        raise CheckFailed("no")

    with pytest.raises(CheckFailed):
        versions.publish(spark.range(9), table, guard=refuse)
    assert versions.pin(spark, table).id == 1 and versions.current(spark, table).count() == 3
    assert versions.publish(spark.range(4), table).id == 2
    assert versions.current(spark, table).count() == 4


def test_an_entry_is_never_overwritten(spark, tmp_path):
    table = str(tmp_path / "t")
    new = versions.publish(spark.range(3), table)
    with pytest.raises(Exception, match="already exists"):
        versions._commit(spark, table, new, "replace", 3)


def test_reader_options():
    options = readers.topic_options("b:9092")
    assert options["startingOffsets"] == "earliest" and options["failOnDataLoss"] == "true"
    assert options["includeHeaders"] == "true"
    jdbc = readers.jdbc_options("jdbc:x", "shops", "u", "p", partition=("id", 1, 100, 8))
    assert jdbc["preferTimestampNTZ"] == "true" and jdbc["numPartitions"] == "8"
