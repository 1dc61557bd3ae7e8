from datetime import datetime

from fixtures import CREATED, NOON, bronze, event
from pyspark.sql import functions as F

from ledgerlake.operators import bookings, dq, envelope
from ledgerlake.schemas import EVENT_DQ

T1, T2 = datetime(2026, 9, 11), datetime(2026, 9, 12)
BAD_PRICE = event("bad", "booking_created", NOON, **CREATED | {"booked_price_krw": -1})


def rejects(spark, payloads, at, version=1, first_offset=0):
    parsed = envelope.parse(bronze(spark, payloads, first_offset=first_offset))
    typed = bookings.candidates(envelope.dedupe(parsed))
    seen = F.lit(at)
    return dq.dq_rows(parsed, "events_clean", seen, version).unionByName(
        dq.dq_rows(typed, "booking_events_clean", seen, version)
    )


def table(df):
    return {
        r.dq_key: (r.validation_error, r.source_snapshot_id, r.first_detected_at, r.last_detected_at)
        for r in df.collect()
    }


def test_keys(spark):
    rows = rejects(spark, [BAD_PRICE, "{}", '{"event_id": " "}', '{"event_id": "x"}'], T1)
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in EVENT_DQ]
    assert {r.dq_key: r.validation_error for r in rows.collect()} == {
        "event:bad": "invalid_booking_created_fields",
        "kafka:booking.events.v1:0:1": "missing_event_id",
        "kafka:booking.events.v1:0:2": "missing_event_id",
        "event:x": "missing_event_type",
    }


def test_unknown_position_parts(spark):
    position = "cast(null as string) event_id", "cast(null as string) kafka_topic", "cast(null as int) kafka_partition", "5L kafka_offset"
    from ledgerlake.functions.keys import dq_key

    assert spark.range(1).selectExpr(*position).select(dq_key()).first()[0] == "kafka:unknown:unknown:5"


def test_latest_record_represents_the_key(spark):
    once = rejects(spark, ['{"event_id": "x"}'], T1)
    again = rejects(spark, ['{"event_id": "x", "event_type": "t"}'], T1, first_offset=9)
    (row,) = dq.latest_per_key(once.unionByName(again)).collect()
    assert (row.kafka_offset, row.validation_error) == (9, "unsupported_schema_version")


def test_merge_is_idempotent_and_keeps_the_first_detection(spark):
    first = dq.merge_dq(None, rejects(spark, [BAD_PRICE, "{}"], T1))
    assert table(first) == {
        "event:bad": ("invalid_booking_created_fields", 1, T1, T1),
        "kafka:booking.events.v1:0:1": ("missing_event_id", 1, T1, T1),
    }
    again = dq.merge_dq(first, rejects(spark, [BAD_PRICE], T2, version=2))
    assert table(again) == {
        "event:bad": ("invalid_booking_created_fields", 2, T1, T2),
        "kafka:booking.events.v1:0:1": ("missing_event_id", 1, T1, T1),  # resolved rows stay
    }
    fresh = dq.merge_dq(again, rejects(spark, ["[]"], T2, version=2, first_offset=50))
    assert table(fresh)["kafka:booking.events.v1:0:50"] == ("malformed_json", 2, T2, T2)


def test_merge_overwrites_with_nulls(spark):
    target = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, first string, v string")
    source = spark.createDataFrame([(1, "z", None), (3, "c", "new")], "k int, first string, v string")
    merged = dq.merge_upsert(target, source, "k", preserve=["first"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a", None), (2, "b", "old"), (3, "c", "new")}
