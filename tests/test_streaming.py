import json
from datetime import timedelta

import pytest
from fixtures import NOON, event, records
from pyspark.sql import functions as F

from ledgerlake.operators import offsets, reconcile
from ledgerlake.operators.expect import CheckFailed
from ledgerlake.sources import readers
from ledgerlake.sources.files import data_files
from ledgerlake.streaming import fanout, ingest, progress, recover


def publish(spark, folder, n, first_offset):
    payloads = [event(f"e{first_offset + i}", "checked_in", NOON) for i in range(n)]
    records(spark, payloads, first_offset=first_offset).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **options):
    stream = readers.record_files_stream(spark, str(tmp_path / "topic"), max_files=1)
    return ingest.ingest_available(stream, str(tmp_path / "bronze"), str(tmp_path / "ckpt"), **options)


def test_ingest_resumes_without_repeats(spark, tmp_path):
    topic = str(tmp_path / "topic")
    publish(spark, topic, 3, 0)
    publish(spark, topic, 2, 3)
    progress = run(spark, tmp_path)
    assert progress is not None
    first = ingest.read_bronze(spark, str(tmp_path / "bronze"))
    assert first.count() == 5
    assert first.select("bronze_ingested_at").distinct().count() == 2  # one clock per micro-batch
    run(spark, tmp_path)
    assert ingest.read_bronze(spark, str(tmp_path / "bronze")).count() == 5
    publish(spark, topic, 4, 5)
    run(spark, tmp_path)
    stored = ingest.read_bronze(spark, str(tmp_path / "bronze"))
    assert stored.count() == 9 and "ingest_date" in stored.columns
    today = stored.first().ingest_date
    later = ingest.read_bronze(spark, str(tmp_path / "bronze"), since=today + timedelta(days=1))
    assert later.isEmpty() and "PartitionFilters: [isnotnull(ingest_date" in later._jdf.queryExecution().executedPlan().toString()
    assert ingest.read_bronze(spark, str(tmp_path / "bronze"), today, today).count() == 9
    report = reconcile.bronze_vs_topic(readers.record_files(spark, topic), stored).first()
    assert tuple(report) == (9, 9, 0, 0, 0)


def test_checkpoint_without_table_is_refused(spark, tmp_path):
    publish(spark, str(tmp_path / "topic"), 1, 0)
    run(spark, tmp_path)
    stream = readers.record_files_stream(spark, str(tmp_path / "topic"))
    with pytest.raises(CheckFailed, match="missing"):
        ingest.start(stream, str(tmp_path / "other"), str(tmp_path / "ckpt"), available_now=True)


def test_continuous_trigger(spark, tmp_path):
    publish(spark, str(tmp_path / "topic"), 2, 0)
    stream = readers.record_files_stream(spark, str(tmp_path / "topic"))
    query = ingest.start(
        stream, str(tmp_path / "bronze"), str(tmp_path / "ckpt"), interval="1 second", name="bronze"
    )
    try:
        query.processAllAvailable()
        assert ingest.read_bronze(spark, str(tmp_path / "bronze")).count() == 2
    finally:
        query.stop()


def test_progress_of_every_batch_is_a_row(spark, tmp_path):
    topic, folder = str(tmp_path / "topic"), str(tmp_path / "progress")
    with progress.logged(spark, folder) as log:
        publish(spark, topic, 3, 0)
        publish(spark, topic, 2, 3)
        run(spark, tmp_path, log=log, name="bookings")
        run(spark, tmp_path, log=log)  # nothing new, no batch
        publish(spark, topic, 4, 5)
        run(spark, tmp_path, log=log)
    publish(spark, topic, 1, 9)
    run(spark, tmp_path)  # no longer logged
    rows = progress.read_progress(spark, folder).orderBy("batch_id").collect()
    assert [(r.batch_id, r.input_rows) for r in rows] == [(0, 3), (1, 2), (2, 4)]
    assert rows[0].query == "bookings" and rows[2].query is None and len({r.query_id for r in rows}) == 1
    assert all(r.durations_ms["addBatch"] >= 0 and r.sources[0].input_rows == r.input_rows for r in rows)


def test_lost_events_are_sent_again_once(spark, tmp_path):
    topic, target, checkpoint = (str(tmp_path / n) for n in ("topic", "bronze", "ckpt"))
    publish(spark, topic, 3, 0)
    payloads = [(f"e{i}", event(f"e{i}", "checked_in", NOON)) for i in range(6)] + [("e9", {"other": 1}), ("e8", {"event_id": "x"})]
    rows = [(i, "shop", json.dumps(p, default=str), 1) for i, p in payloads]
    sent = spark.createDataFrame(rows, "event_id string, partition_key string, payload string, schema_version int")
    first = recover.recover(spark, sent, topic, target, checkpoint, 1)
    assert first == recover.Recovery(missing=5, sent=3, unreadable=2, left=2)
    again = recover.recover(spark, sent, topic, target, checkpoint, 1)
    assert again == recover.Recovery(missing=2, sent=0, unreadable=2, left=2)
    bronze = ingest.read_bronze(spark, target)
    assert sorted(r.kafka_offset for r in bronze.collect()) == list(range(6))
    offsets.require_offsets(bronze)


def test_an_interrupted_recovery_sends_nothing_twice(spark, tmp_path):
    """Records that were sent, but not ingested, are found by the next run before it looks for losses."""
    topic, target, checkpoint = (str(tmp_path / n) for n in ("topic", "bronze", "ckpt"))
    publish(spark, topic, 2, 0)
    sent = spark.createDataFrame(
        [(f"e{i}", "shop", json.dumps(event(f"e{i}", "checked_in", NOON), default=str), 1) for i in range(4)],
        "event_id string, partition_key string, payload string, schema_version int",
    )
    run(spark, tmp_path)
    publish(spark, topic, 2, 2)  # what the interrupted run had sent
    assert recover.recover(spark, sent, topic, target, checkpoint, 1).missing == 0
    assert ingest.read_bronze(spark, target).count() == 4


def test_fanned_out_batches_are_stored_once(spark, tmp_path):
    topic, target, checkpoint = (str(tmp_path / n) for n in ("topic", "bronze", "ckpt"))

    def catch_up(day):
        stream = readers.record_files_stream(spark, topic)
        at = F.lit(f"2026-01-0{day} 12:00:00").cast("timestamp")
        fanout.start(stream, target, checkpoint, files_per_day=3, ingested_at=at).awaitTermination()

    for batch in range(3):
        publish(spark, topic, 40, 40 * batch)
        catch_up(1 + batch)
    assert fanout.committed_batch(spark, checkpoint) == 2
    # the last batch was written but not marked as done: the stream repeats it, now on another day
    for name in ("2", ".2.crc"):
        (tmp_path / "ckpt" / "commits" / name).unlink()
    assert fanout.committed_batch(spark, checkpoint) == 1
    catch_up(9)
    rows = fanout.read_batches(spark, target, 2)
    assert sorted(r.kafka_offset for r in rows.collect()) == list(range(120))
    assert {r.ingest_date.day for r in rows.filter("ingest_batch = 2").collect()} == {9}
    assert fanout.read_batches(spark, target, 0).count() == 40
    plan = fanout.read_batches(spark, target, 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_batch" in plan
    per_day = data_files(rows, "ingest_batch", "ingest_date").groupBy("ingest_batch", "ingest_date").count().collect()
    assert len(per_day) == 3 and all(1 <= r["count"] <= 3 for r in per_day)
