"""What a domain run leaves and moves on disk."""

import os
import re
import time
from datetime import datetime

import pytest
from fixtures import NOON
from pyspark.sql import functions as F
from test_plans import plan

from ledgerlake.operators import payments
from ledgerlake.plans import derived, domains
from ledgerlake.sources import packing, readers
from ledgerlake.sources.packing import LEAN, lean
from ledgerlake.sources.scratch import stored
from ledgerlake.streaming import ingest


def payment_inputs(spark, n):
    orders = spark.range(n).selectExpr(
        "id * 7 + 1 AS o_orderkey", "id * 31 % 97 AS o_custkey", "timestamp_ntz'2024-01-01' AS o_orderdate"
    )
    lines = spark.range(n * 4).selectExpr(
        "id div 4 * 7 + 1 AS l_orderkey", "id % 4 + 1 AS l_linenumber", "id * 131 % 2003 AS l_partkey",
        "id * 17 % 101 AS l_suppkey", "timestamp_ntz'2024-02-01' AS l_shipdate",
        "1000 + id * 7919 % 90001 / 100 AS l_extendedprice", "if(id % 5 = 0, 'R', 'N') AS l_returnflag",
    )
    return orders, lines


def size(folder):
    return sum(
        os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet")
    )


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def executions(spark):
    """Executions by their number; the session forgets old ones."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i) for i in range(found.size())}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """A payment run over records of its own: its folder, its plans and the shuffle files that it left."""
    root = str(tmp_path_factory.mktemp("lake"))
    records = derived.payment_records(*payment_inputs(spark, 1500)).coalesce(1)
    topic = stored(records, "topic")
    stream = readers.record_files_stream(spark, topic._scratch)
    ingest.ingest_available(stream, f"{root}/bronze/booking_events", f"{root}/ckpt", ingested_at=F.lit(datetime(2024, 2, 1)))
    before, last = shuffle_files(spark), max(executions(spark))
    reports = domains.run(spark, root, "payment")
    assert [r.stored_rows for r in reports][:1] == [topic.count()]
    plans = [found.physicalPlanDescription() for number, found in executions(spark).items() if number > last]
    for _ in range(40):  # files go a little after their job
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    return root, plans, left


def test_payloads_take_little_room_in_every_table(spark, lake, tmp_path):
    root, _, _ = lake
    tables = [
        f"{root}/bronze/booking_events",
        f"{root}/silver/events_clean/v1/rejected=false",
        f"{root}/silver/payment_events_clean/v1/rejected=false",
    ]
    for i, table in enumerate(tables):
        rows = spark.read.parquet(table)
        rows.write.parquet(f"{tmp_path}/{i}")
        assert size(table) < 0.6 * size(f"{tmp_path}/{i}"), table
        assert rows.exceptAll(spark.read.parquet(f"{tmp_path}/{i}")).isEmpty()


def test_rows_are_not_sorted_into_accepted_and_rejected(lake):
    _, plans, _ = lake
    assert sum("rejected" in p and "InsertIntoHadoopFsRelationCommand" in p for p in plans) >= 2
    assert not [p for p in plans if re.search(r"\[rejected#\d+ ASC", p)]


def test_a_run_leaves_hardly_any_shuffle_files(lake):
    """Shuffles that adaptive execution drops from a plan wait for the driver's garbage collection."""
    _, _, left = lake
    assert len([f for f in left if f.endswith(".data")]) <= 1, [(f, os.path.getsize(f)) for f in left]


def test_ingest_takes_rows_unsorted(spark, tmp_path, monkeypatch):
    """A stream's writer takes its options from the session, from start to end."""
    seen = {}
    start = ingest.start

    def started(*args, **options):
        seen.update({name: spark.conf.get(name, None) for name in LEAN})
        return start(*args, **options)

    monkeypatch.setattr(ingest, "start", started)
    topic = stored(derived.payment_records(*payment_inputs(spark, 5)), "topic")
    ingest.ingest_available(readers.record_files_stream(spark, topic._scratch), f"{tmp_path}/bronze", f"{tmp_path}/ckpt")
    assert seen == LEAN and ingest.read_bronze(spark, f"{tmp_path}/bronze").count() == topic.count()


def test_options_hold_in_the_block_only_and_never_replace_given_ones(spark):
    given, *others = LEAN
    spark.conf.set(given, "7")
    try:
        with pytest.raises(ZeroDivisionError), lean(spark):
            with packing.lean(spark):
                pass
            assert [spark.conf.get(n) for n in LEAN] == ["7", *(LEAN[n] for n in others)]
            1 / 0
        assert spark.conf.get(given) == "7" and {spark.conf.get(n, None) for n in others} == {None}
    finally:
        spark.conf.unset(given)


def test_lines_are_shuffled_without_what_is_made_of_them(spark):
    text = plan(derived.payment_records(*payment_inputs(spark, 3)))
    below = text[text.index("Exchange hashpartitioning(l_orderkey") :]
    moved = below[below.index("Project [") :].split("\n")[0]
    assert "l_extendedprice" in moved
    assert not [name for name in ("collected", "refunded", "amount", "l_returnflag,") if name in moved]


def test_first_request_of_a_payment(spark):
    """The first request may have no time; NULL comes first, as in the creation order."""
    names = (
        "payment_id long, event_id string, event_type string, event_time timestamp, bronze_ingested_at timestamp, "
        "kafka_topic string, kafka_partition int, kafka_offset long"
    )
    rows = [
        (1, "a", "payment_requested", NOON, NOON, "t", 0, 1),
        (1, "b", "payment_requested", None, NOON, "t", 0, 2),
        (2, "c", "payment_requested", NOON, NOON, "t", 0, 3),
        (3, "d", "payment_completed", NOON, NOON, "t", 0, 4),
    ]
    events = spark.createDataFrame(rows, names)
    for column in ("booking_id", "shop_id", "request_amount_krw", *payments.SUMMARY_AMOUNTS, "payment_status",
                   "needs_repayment", "payment_transaction_id", "transaction_type", "amount_krw"):
        events = events.withColumn(column, F.lit(0))
    found = {r.payment_id: (r.requested_event_time, r.is_orphan) for r in payments.current(events).collect()}
    assert found == {1: (None, False), 2: (NOON, False), 3: (None, True)}
