"""Positions of derived records at any event id."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerlake.plans import catalogue, derived

IDS = [50, 7 * 50, 9_999_999, 10_000_000, 10_000_050, 20_000_000, 30_000_007]


def test_positions_and_redeliveries_hold_at_large_ids(spark, tmp_path):
    at = datetime(2024, 1, 3, 4, 5)
    rows = [(i, at, i % 11, "signup", 3.0) for i in IDS]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    again = [i for i in IDS if i % derived.REDELIVERED_EVERY == 0]
    records = derived.booking_records(events)
    assert records.count() == len(IDS) + len(again)
    assert records.select("partition", "offset").distinct().count() == records.count()
    assert records.filter(derived.redelivered("offset")).count() == len(again)
    sent = derived.outbox(spark, str(tmp_path))
    assert sorted(r[0] for r in sent.select("event_id").collect()) == sorted(f"b-{i}" for i in IDS)
    assert catalogue._partial_bronze(spark, str(tmp_path)).select("kafka_offset").distinct().count() == len(IDS)
    repeated = catalogue.duplicate_positions(spark, str(tmp_path))
    assert sorted(r.kafka_offset for r in repeated.collect()) == sorted(2 * i + 1 for i in again)
    assert repeated.filter(F.col("n") != 2).isEmpty()
    altered = catalogue.payload_conflicts(spark, str(tmp_path)).collect()
    assert sorted(r.event_id for r in altered) == sorted(f"b-{i}" for i in again if i % 7 == 0)
