from datetime import datetime

import pytest
from fixtures import (
    CANCELLED,
    COMPLETED,
    CREATED,
    NOON,
    REFUNDED,
    REQUESTED,
    RESCHEDULED,
    bronze,
    event,
)

from ledgerlake.operators import bookings, envelope, payments
from ledgerlake.schemas import BOOKING_EVENTS_CLEAN, EVENTS_CLEAN, PAYMENT_EVENTS_CLEAN


def without(fields, *names):
    return {k: v for k, v in fields.items() if k not in names}


def codes(validated):
    return [r[0] for r in validated.orderBy("kafka_offset").select("validation_error").collect()]


GOOD = event("e", "checked_in", NOON, status="checked_in")

ENVELOPE_CASES = [
    ("", "malformed_json"),
    ("   ", "malformed_json"),
    (None, "malformed_json"),
    ('{"event_id": "e"', "malformed_json"),
    ("[1, 2]", "malformed_json"),
    ("7", "malformed_json"),
    ("null", "malformed_json"),
    ("{}", "missing_event_id"),
    (GOOD | {"event_id": "  "}, "missing_event_id"),
    (without(GOOD, "event_type"), "missing_event_type"),
    (GOOD | {"event_type": ""}, "missing_event_type"),
    (without(GOOD, "schema_version"), "unsupported_schema_version"),
    (GOOD | {"schema_version": 2}, "unsupported_schema_version"),
    (GOOD | {"schema_version": "one"}, "unsupported_schema_version"),
    (GOOD | {"booking_id": 0}, "invalid_required_id"),
    (GOOD | {"shop_id": "1.0"}, "invalid_required_id"),
    (without(GOOD, "shop_id"), "invalid_required_id"),
    (GOOD | {"event_time": "2026-02-30T00:00:00"}, "invalid_required_time"),
    (without(GOOD, "ingest_time"), "invalid_required_time"),
    (GOOD | {"event_id": "", "schema_version": 9}, "missing_event_id"),
    (GOOD | {"booking_id": " 12 ", "_corrupt_record": "x"}, None),
    (GOOD | {"schema_version": "1"}, None),
    ('{"EVENT_ID": "e"}', "missing_event_id"),
    (GOOD, None),
]


def test_envelope_codes(spark):
    parsed = envelope.parse(bronze(spark, [p for p, _ in ENVELOPE_CASES]))
    assert codes(parsed) == [code for _, code in ENVELOPE_CASES]


BOOKING_CASES = [
    ("booking_created", CREATED, None),
    ("booking_created", CREATED | {"customer_id": "abc"}, "invalid_booking_type"),
    ("booking_created", CREATED | {"start_at": "soon"}, "invalid_booking_type"),
    ("booking_created", CREATED | {"booked_price_krw": -1}, "invalid_booking_created_fields"),
    ("booking_created", CREATED | {"booked_price_krw": 0}, None),
    ("booking_created", CREATED | {"staff_id": 0}, "invalid_booking_created_fields"),
    ("booking_created", without(CREATED, "service_id"), "invalid_booking_created_fields"),
    ("booking_created", without(CREATED, "start_at"), "invalid_booking_created_fields"),
    ("booking_created", without(CREATED, "status"), "invalid_booking_created_fields"),
    ("booking_created", CREATED | {"status": "cancelled"}, "invalid_booking_created_fields"),
    ("booking_rescheduled", RESCHEDULED, None),
    ("booking_rescheduled", without(RESCHEDULED, "old_start_at"), "invalid_booking_rescheduled_fields"),
    ("booking_rescheduled", without(RESCHEDULED, "status"), "invalid_booking_rescheduled_fields"),
    ("booking_cancelled", CANCELLED, None),
    ("booking_cancelled", without(CANCELLED, "cancelled_at"), "invalid_booking_cancelled_fields"),
    ("booking_cancelled", CANCELLED | {"staff_id": "x"}, "invalid_booking_type"),
    ("checked_in", {"status": "checked_in"}, None),
    ("checked_in", {}, "invalid_checked_in_fields"),
    ("no_show_marked", {"status": "no_show"}, None),
    ("no_show_marked", {"status": "checked_in"}, "invalid_no_show_fields"),
]


def typed_events(spark, cases):
    payloads = [event(f"e{i}", kind, NOON, **extra) for i, (kind, extra, _) in enumerate(cases)]
    return envelope.parse(bronze(spark, payloads))


def test_booking_codes(spark):
    validated = bookings.candidates(typed_events(spark, BOOKING_CASES))
    assert codes(validated) == [code for *_, code in BOOKING_CASES]
    assert bookings.clean(validated).columns == BOOKING_EVENTS_CLEAN


UNPAID_30 = {"payout_amount_krw": 30, "paid_amount_krw": 30, "unpaid_amount_krw": 70, "payment_status": "unpaid"}
PAYMENT_CASES = [
    ("payment_requested", REQUESTED, None),
    ("payment_requested", REQUESTED | {"payment_id": "x"}, "invalid_payment_type"),
    ("payment_requested", REQUESTED | {"payment_id": 0}, "invalid_payment_id"),
    ("payment_requested", without(REQUESTED, "payment_id"), "invalid_payment_id"),
    ("payment_requested", REQUESTED | {"request_amount_krw": 0}, "invalid_payment_request_amount"),
    ("payment_requested", without(REQUESTED, "paid_amount_krw"), "invalid_payment_summary"),
    ("payment_requested", REQUESTED | {"refund_amount_krw": -1}, "invalid_payment_summary"),
    ("payment_requested", REQUESTED | {"needs_repayment": "true"}, "invalid_payment_summary"),
    ("payment_requested", REQUESTED | {"payout_amount_krw": 5}, "inconsistent_payment_amounts"),
    (
        "payment_completed",
        COMPLETED | {"payout_amount_krw": 101, "paid_amount_krw": 101},
        "inconsistent_payment_amounts",
    ),
    ("payment_requested", REQUESTED | {"amount_krw": 1}, "invalid_payment_requested_fields"),
    ("payment_requested", REQUESTED | {"unpaid_amount_krw": 1}, "invalid_payment_requested_fields"),
    ("payment_requested", REQUESTED | {"needs_repayment": True}, "invalid_payment_requested_fields"),
    ("payment_completed", COMPLETED, None),
    ("payment_completed", COMPLETED | UNPAID_30 | {"amount_krw": 30}, None),
    ("payment_completed", COMPLETED | {"amount_krw": 101}, "invalid_payment_transaction_fields"),
    (
        "payment_completed",
        without(COMPLETED, "payment_transaction_id"),
        "invalid_payment_transaction_fields",
    ),
    ("payment_completed", COMPLETED | {"refund_type": "full"}, "invalid_payment_completed_fields"),
    ("payment_refunded", REFUNDED, None),
    ("payment_refunded", REFUNDED | {"refund_type": "partial"}, "invalid_payment_refunded_fields"),
    ("payment_refunded", without(REFUNDED, "refund_type"), "invalid_payment_refunded_fields"),
    ("payment_completed", COMPLETED | {"payment_status": "weird"}, "inconsistent_payment_status"),
    ("payment_completed", COMPLETED | {"unpaid_amount_krw": 1}, "inconsistent_payment_status"),
    ("payment_completed", COMPLETED | {"needs_repayment": True}, "inconsistent_payment_status"),
    ("payment_completed", without(COMPLETED, "payment_status") | {"unpaid_amount_krw": 3}, "inconsistent_payment_status"),
]
NULL_STATUS = [
    ("payment_requested", without(REQUESTED, "payment_status"), "invalid_payment_requested_fields"),
    ("payment_completed", without(COMPLETED, "payment_status"), "inconsistent_payment_status"),
]


def test_payment_codes(spark):
    validated = payments.candidates(typed_events(spark, PAYMENT_CASES))
    assert codes(validated) == [code for *_, code in PAYMENT_CASES]
    assert "invalid_repayment_status" not in codes(validated)
    assert payments.clean(validated).columns == PAYMENT_EVENTS_CLEAN


def test_missing_payment_status_depends_on_strictness(spark):
    events = typed_events(spark, NULL_STATUS)
    assert codes(payments.candidates(events)) == [None, None]
    assert codes(payments.candidates(events, strict=True)) == [code for *_, code in NULL_STATUS]


LEGACY_CASES = [
    ("payment_completed", COMPLETED, None),
    ("payment_completed", COMPLETED | {"amount_krw": "x"}, "invalid_payment_type"),
    ("payment_completed", without(COMPLETED, "payment_id"), "invalid_payment_id"),
    ("payment_completed", COMPLETED | {"payment_transaction_id": -1}, "invalid_payment_transaction_id"),
    ("payment_completed", without(COMPLETED, "request_amount_krw"), "invalid_payment_request_amount"),
    ("payment_completed", COMPLETED | {"amount_krw": 0}, "invalid_payment_amount"),
    ("payment_completed", COMPLETED | {"amount_krw": 101}, "payment_amount_exceeds_request"),
    ("payment_completed", COMPLETED | {"payment_status": "unpaid"}, "invalid_payment_completed_fields"),
    ("payment_completed", without(COMPLETED, "payment_status"), "invalid_payment_completed_fields"),
    ("payment_refunded", REFUNDED, None),
    ("payment_refunded", REFUNDED | {"refund_type": "partial"}, "invalid_payment_refunded_fields"),
    ("payment_refunded", without(REFUNDED, "payment_status"), "invalid_payment_refunded_fields"),
]


def test_legacy_transaction_codes(spark):
    validated = payments.transaction_candidates(typed_events(spark, LEGACY_CASES))
    assert codes(validated) == [code for *_, code in LEGACY_CASES]


def test_times_with_offset_are_read_as_instants(spark):
    payload = event("e", "checked_in", "2026-09-04T03:00:00+00:00", status="checked_in")
    row = envelope.parse(bronze(spark, [payload])).first()
    assert row.event_time == datetime(2026, 9, 4, 12)


@pytest.mark.parametrize("order", [1, -1])
def test_dedupe_keeps_the_earliest_delivery(spark, order):
    rows = bronze(spark, [GOOD, GOOD, GOOD | {"event_id": "f"}, "{}"][::order])
    kept = envelope.dedupe(envelope.parse(rows))
    assert kept.columns == EVENTS_CLEAN
    found = {r.event_id: r.kafka_offset for r in kept.collect()}
    assert found == ({"e": 0, "f": 2} if order == 1 else {"f": 1, "e": 2})


def test_conflicting_payloads_are_found(spark):
    parsed = envelope.parse(bronze(spark, [GOOD, GOOD, GOOD | {"event_id": "f"}, GOOD | {"event_id": "f", "shop_id": 2}]))
    assert [r.event_id for r in envelope.conflicts(parsed).collect()] == ["f"]
    audited = envelope.dedupe(parsed, audit=True).orderBy("event_id").collect()
    assert [(r.deliveries, r.payload_conflict) for r in audited] == [(2, False), (2, True)]
