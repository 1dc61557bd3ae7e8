"""Repeated keys told apart from single ones: same rows, and single ones are not shuffled."""

import re

import pytest
from fixtures import bronze, golden_events
from pyspark.sql import functions as F
from test_plans import plan, shuffles
from test_running import ORDER, buckets, mixed

from ledgerlake.functions import repeats
from ledgerlake.functions.running import running_sums
from ledgerlake.operators import envelope, payments
from ledgerlake.plans import derived
from ledgerlake.sources.scratch import stored


@pytest.fixture(scope="module")
def parsed(spark):
    """Golden events, some delivered again later, and a record without an id."""
    rows = bronze(spark, golden_events())
    again = rows.limit(4).withColumn("kafka_offset", F.col("kafka_offset") + 1000)
    broken = rows.limit(2).withColumn("payload", F.lit('{"event_id":'))
    return stored(envelope.parse(rows.unionByName(again).unionByName(broken)), "parsed")


def as_rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("many", [0, 2, 1000])
def test_sparse_forms_equal_the_aggregates(parsed, many, monkeypatch):
    monkeypatch.setattr(repeats.parted, "__kwdefaults__", {"many": many})
    for audit in (False, True):
        assert as_rows(envelope.dedupe(parsed, audit, sparse=True)) == as_rows(envelope.dedupe(parsed, audit))
    assert as_rows(envelope.settle(parsed, sparse=True)) == as_rows(envelope.settle(parsed))


def test_single_ids_are_not_shuffled(parsed):
    single = stored(envelope.dedupe(parsed), "single").withColumn("validation_error", F.lit(None).cast("string"))
    assert shuffles(envelope.dedupe(single)) == 1
    assert shuffles(envelope.dedupe(single, sparse=True)) == 0
    assert shuffles(envelope.settle(single, sparse=True)) == 0


def test_small_keys_are_scanned_whole_and_large_ones_cut(spark):
    df = spark.createDataFrame(mixed(), "k string, t long, n long, v long")
    sums, totals = {"s": F.col("v"), "c": F.lit(1)}, {"total": "s"}
    whole = running_sums(df, "k", buckets(7), ORDER, sums, totals)
    cut = running_sums(df, "k", buckets(7), ORDER, sums, totals, whole=10)
    assert shuffles(whole) == 1 and shuffles(cut) > 1
    assert as_rows(whole) == as_rows(cut)


def test_payment_lines_are_shuffled_once(spark):
    """One exchange for the lines and one for the orders; lines without an order key have none."""
    orders = spark.createDataFrame(
        [(1, 5, 0), (2, 6, 0), (None, 7, 0)], "o_orderkey long, o_custkey long, d long"
    ).selectExpr("o_orderkey", "o_custkey", "timestamp_ntz'2024-01-01' AS o_orderdate")
    lines = spark.createDataFrame(
        [(1, 1, 10, 3, 100.5, "R"), (1, 2, 11, 3, 50.0, "N"), (2, 1, 10, 3, 7.0, "N"), (None, 1, 1, 1, 1.0, "N")],
        "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string",
    ).withColumn("l_shipdate", F.expr("timestamp_ntz'2024-01-01'"))
    records = derived.payment_records(orders, lines)
    assert plan(records).count("Exchange hashpartitioning") <= 2
    kinds = records.select(F.get_json_object(F.col("value").cast("string"), "$.event_id").alias("id"))
    assert sorted(r.id for r in kinds.collect()) == ["p-1-0", "p-1-1", "p-1-2", "p-1-r1", "p-2-0", "p-2-1"]


@pytest.mark.parametrize("places", [repeats.PLACES, 2**15])
def test_only_rows_near_repeated_keys_move_when_many_repeat(spark, monkeypatch, places):
    """Beyond the bound rows used to count as repeated all together."""
    monkeypatch.setattr(repeats, "PLACES", places)
    rows = spark.range(4000).selectExpr("if(id < 1000, id div 2, id) AS k", "id AS n").unionAll(
        spark.createDataFrame([(None, -1), (None, -2)], "k long, n long")
    )
    once, again = repeats.parted(rows, "k", many=10)
    moved = {r.n for r in again.collect()}
    kept = [r.n for r in once.collect()]
    assert moved >= {-1, -2, *range(1000)}
    assert sorted([*moved, *kept]) == sorted(r.n for r in rows.collect())
    assert len(kept) > 2500
    assert once.columns == again.columns == rows.columns


def test_code_of_all_typed_fields_is_small_enough_to_be_compiled(parsed, spark, capsys):
    """The virtual machine leaves methods of more than 8000 bytes uncompiled."""
    events = envelope.accepted(parsed)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        payments.candidates(events).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
