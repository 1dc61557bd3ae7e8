"""Whole runs on the golden data: stored tables, refusals, reruns, input order."""

import random
from datetime import date, datetime

import pytest
from fixtures import CREATED, NOON, event, golden_events, records

from ledgerlake import schemas
from ledgerlake.operators import reconcile
from ledgerlake.operators.expect import CheckFailed
from ledgerlake.plans import domains, stages
from ledgerlake.sources import buckets, readers, versions
from ledgerlake.streaming import ingest

AS_OF, T1, T2 = date(2026, 9, 7), datetime(2026, 9, 11), datetime(2026, 9, 12)
BAD = event("bad", "booking_created", NOON, 99, **CREATED | {"booked_price_krw": -1})


def load(spark, root, payloads, first_offset=0, files=1):
    size = -(-len(payloads) // files)
    for i in range(files):
        part = payloads[i * size : (i + 1) * size]
        rows = records(spark, part, first_offset=first_offset + i * size)
        rows.coalesce(1).write.mode("append").parquet(f"{root}/topic")
    stream = readers.record_files_stream(spark, f"{root}/topic", max_files=1)
    ingest.ingest_available(stream, f"{root}/bronze/booking_events", f"{root}/ckpt")


def stored(spark, root, name):
    return versions.current(spark, f"{root}/silver/{name}")


def rejects(spark, root, name, schema=schemas.EVENT_DQ):
    return buckets.current(spark, f"{root}/silver/{name}", schema)


def by_stage(reports):
    assert all(r.violations == 0 for r in reports)
    return {r.stage: (r.input_rows, r.rejected_rows, r.duplicate_rows, r.stored_rows, r.orphan_rows) for r in reports}


def test_golden_runs(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, golden_events())
    assert by_stage(domains.run(spark, root, "booking")) == {
        "events_clean": (40, 0, 0, 40, 0),
        "booking_events_clean": (20, 0, 0, 20, 0),
        "bookings_current": (20, 0, 0, 10, 0),
    }
    assert by_stage(domains.run(spark, root, "payment")) == {
        "events_clean": (40, 0, 0, 40, 0),
        "payment_events_clean": (20, 0, 0, 20, 0),
        "payments_current": (20, 0, 0, 7, 0),
    }
    assert by_stage(domains.run(spark, root, "payment_transactions"))["payment_transactions_clean"] == (13, 4, 0, 9, 0)
    assert rejects(spark, root, "event_dq") is None
    shops = spark.createDataFrame(
        [(s, f"shop {s}", "seoul", True, date(2026, 9, s), None, NOON, NOON) for s in (1, 2, 3)],
        "id long, shop_name string, region string, is_active boolean, opened_on date, "
        "closed_on date, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    context = stages.Run(spark, stages.Layout(root), AS_OF, T1)
    for _ in range(2):
        assert stages.bronze_shops(context, shops).stored_rows == 3
    assert [r.stored_rows for r in domains.run(spark, root, "gold", AS_OF)] == [3, 15]


def test_rejects_duplicates_and_rerun(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, [*golden_events(), BAD, BAD, '{"event_id":'])
    first = by_stage(domains.run(spark, root, "booking", AS_OF, T1))
    assert first["events_clean"] == (43, 1, 1, 41, 0)
    assert first["booking_events_clean"] == (21, 1, 0, 20, 0)
    again = by_stage(domains.run(spark, root, "booking", AS_OF, T2))
    assert again == first
    rows = rejects(spark, root, "event_dq").orderBy("dq_key").collect()
    assert [(r.dq_key, r.validation_stage, r.first_detected_at, r.last_detected_at) for r in rows] == [
        ("event:bad", "booking_events_clean", T1, T2),
        ("kafka:booking.events.v1:0:42", "events_clean", T1, T2),
    ]
    chain = by_stage(domains.run(spark, root, "booking_chain", AS_OF, T2))
    assert chain["booking_chain"] == (21, 1, 0, 20, 0)
    twins = [stored(spark, root, n).drop("source_snapshot_id") for n in ("booking_events_clean", "booking_events_chain_clean")]
    assert reconcile.table_diff(*twins, "a", "b").isEmpty()
    recorded = rejects(spark, root, "booking_event_dq", stages.DQ_CHAIN).collect()
    assert [(r.dq_key, r.last_detected_at) for r in recorded] == [("event:bad", T2)]


@pytest.mark.parametrize(
    ("payloads", "domain", "reason"),
    [
        (["{}", ""], "events", "no valid event"),
        ([BAD, BAD | {"shop_id": 2}], "events", "different payloads"),
        ([event("p", "other_kind", NOON)], "booking", "no candidate"),
        ([BAD], "booking", "no valid event"),
    ],
)
def test_refused_runs_change_nothing(spark, tmp_path, payloads, domain, reason):
    root = str(tmp_path)
    load(spark, root, payloads)
    with pytest.raises(CheckFailed, match=reason):
        domains.run(spark, root, domain)
    table = "events_clean" if domain == "events" else "booking_events_clean"
    assert stored(spark, root, table) is None


def test_missing_sources_are_refused(spark, tmp_path):
    with pytest.raises(CheckFailed, match="no committed batch"):
        domains.run(spark, str(tmp_path), "events")
    with pytest.raises(CheckFailed, match="no committed version"):
        domains.run(spark, str(tmp_path), "gold")


def test_movement_guards(spark, tmp_path):
    root = str(tmp_path)
    twice = [e for e in golden_events() if e["event_id"] == "m1-0"]
    load(spark, root, [*golden_events(), twice[0] | {"event_id": "other"}])
    with pytest.raises(CheckFailed, match="payment_transaction_id repeats"):
        domains.run(spark, root, "payment")
    assert stored(spark, root, "payment_events_clean") is None


def test_order_and_batches_do_not_matter(spark, tmp_path):
    shuffled = golden_events()
    random.Random(3).shuffle(shuffled)
    tables = []
    for name, payloads, files in (("a", golden_events(), 1), ("b", shuffled, 3)):
        root = str(tmp_path / name)
        load(spark, root, payloads + payloads[:5], files=files)
        domains.run(spark, root, "booking")
        domains.run(spark, root, "payment")
        tables.append([stored(spark, root, t) for t in ("bookings_current", "payments_current")])
    for left, right in zip(*tables):
        assert reconcile.table_diff(left, right, "a", "b").isEmpty()


def test_data_tests_are_reported_and_stored(spark, tmp_path):
    """A shop without region is fine; one closing before it opens is counted; both are stored."""
    shops = spark.createDataFrame(
        [
            (1, "a", None, None, date(2026, 9, 1), None, NOON, NOON),
            (2, "b", "seoul", True, date(2026, 9, 5), date(2026, 9, 1), NOON, NOON),
            (3, None, "seoul", True, date(2026, 9, 1), None, NOON, NOON),
        ],
        "id long, shop_name string, region string, is_active boolean, opened_on date, "
        "closed_on date, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    context = stages.Run(spark, stages.Layout(str(tmp_path)), AS_OF, T1)
    stages.bronze_shops(context, shops)
    report = stages.dim_shops(context)
    assert (report.stored_rows, report.violations) == (3, 2)
    assert stored(spark, str(tmp_path), "dim_shops").count() == 3


def test_bronze_is_read_as_of_a_batch(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, golden_events()[:10])
    bronze_path = f"{root}/bronze/booking_events"
    seen = ingest.read_bronze(spark, bronze_path)
    until, n = seen.agg({"bronze_ingested_at": "max"}).first()[0], seen.count()
    load(spark, root, golden_events()[10:], first_offset=10)
    assert n == 10 and ingest.read_bronze(spark, bronze_path).count() == 40
    assert ingest.read_bronze(spark, bronze_path, as_of=until).count() == 10
