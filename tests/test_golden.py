"""The ten-booking data set against its known states."""

from datetime import date, datetime

import pytest
from fixtures import bronze, event, golden_events

from ledgerlake.plans import joined
from ledgerlake.operators import bookings, envelope, expect, gold, payments, reconcile, reports


@pytest.fixture(scope="module")
def events(spark):
    return envelope.dedupe(envelope.parse(bronze(spark, golden_events()))).cache()


@pytest.fixture(scope="module")
def booking_events(events):
    return bookings.clean(bookings.candidates(events)).cache()


@pytest.fixture(scope="module")
def payment_events(events):
    return payments.clean(payments.candidates(events)).cache()


COUNTS = {
    "booking_created": 10,
    "booking_rescheduled": 1,
    "booking_cancelled": 1,
    "checked_in": 7,
    "no_show_marked": 1,
    "payment_requested": 7,
    "payment_completed": 9,
    "payment_refunded": 4,
}


def test_event_counts(events):
    assert expect.counts(events, "event_type", COUNTS).isEmpty()
    off = expect.counts(events, "event_type", COUNTS | {"checked_in": 6, "lost": 1}).collect()
    assert {r.event_type: (r.expected, r.actual) for r in off} == {"checked_in": (6, 7), "lost": (1, 0)}


def test_reports(events, booking_events):
    counted = reports.counts_by(events, "event_type").collect()
    assert [r.event_type for r in counted] == sorted(COUNTS)
    assert {r.event_type: r.n for r in counted} == COUNTS
    assert reports.reject_reasons(bookings.candidates(events)).isEmpty()
    rejected = reports.reject_reasons(payments.transaction_candidates(events)).collect()
    assert [tuple(r) for r in rejected] == [
        ("invalid_payment_completed_fields", 2),
        ("invalid_payment_refunded_fields", 2),
    ]
    current = bookings.current(booking_events.filter("event_id <> 'c1'"))
    assert tuple(reports.orphan_share(current).first()) == (10, 1)


def d(day, hour, minute=0):
    return datetime(2026, 9, day, hour, minute)


BOOKINGS = {
    1: (1, 1, "checked_in", d(5, 9), None, d(5, 8, 55)),
    2: (2, 4, "checked_in", d(5, 10), None, d(5, 9, 55)),
    3: (3, 5, "checked_in", d(5, 11), None, d(5, 10, 55)),
    4: (1, 2, "checked_in", d(5, 12), None, d(5, 11, 55)),
    5: (2, 3, "checked_in", d(5, 13), None, d(5, 12, 55)),
    6: (3, 6, "checked_in", d(5, 14), None, d(5, 13, 55)),
    7: (1, 1, "cancelled", d(5, 15), d(4, 12, 7), d(4, 12, 7)),
    8: (2, 4, "no_show", d(5, 16), None, d(5, 16, 15)),
    9: (3, 5, "checked_in", d(7, 9), None, d(7, 8, 55)),
    10: (1, 2, "scheduled", d(6, 10), None, d(4, 9, 10)),
}


@pytest.mark.parametrize("build", [bookings.current, joined.bookings_current])
def test_bookings_current(booking_events, build):
    rows = build(booking_events).collect()
    assert {
        r.booking_id: (r.shop_id, r.staff_id, r.status, r.start_at, r.cancelled_at, r.status_event_time)
        for r in rows
    } == BOOKINGS
    assert not any(r.is_orphan for r in rows)
    assert {r.booked_price_krw for r in rows} == {55_000}


PAYMENTS = {
    1: (55000, 0, 55000, 0, "paid", False, 1, "payment", 55000),
    2: (30000, 0, 30000, 25000, "unpaid", False, 2, "payment", 30000),
    3: (55000, 20000, 35000, 0, "partially_refunded", False, 13, "refund", 20000),
    4: (75000, 20000, 55000, 0, "paid", False, 24, "payment", 20000),
    5: (55000, 55000, 0, 0, "refunded", False, 15, "refund", 55000),
    6: (85000, 55000, 30000, 25000, "unpaid", True, 26, "payment", 30000),
    9: (55000, 0, 55000, 0, "paid", False, 9, "payment", 55000),
}


@pytest.mark.parametrize("build", [payments.current, joined.payments_current])
def test_payments_current(payment_events, build):
    rows = build(payment_events).collect()
    assert {
        r.payment_id: (
            r.payout_amount_krw, r.refund_amount_krw, r.paid_amount_krw, r.unpaid_amount_krw,
            r.payment_status, r.needs_repayment,
            r.latest_transaction_id, r.latest_transaction_type, r.latest_transaction_amount_krw,
        )
        for r in rows
    } == PAYMENTS
    assert not any(r.is_orphan for r in rows)


def test_ledger_agrees_everywhere(payment_events):
    current, moves = payments.current(payment_events), payments.transactions(payment_events)
    assert moves.count() == 13
    assert reconcile.payment_ledger(current, moves).isEmpty()
    assert reconcile.payment_ledger(current, moves.filter("payment_id <> 3")).count() == 1
    replay = payments.ledger_replay(payment_events)
    assert replay.count() == 20 and replay.filter("NOT agrees").isEmpty()
    assert payments.summary_violations(current).isEmpty()


def test_legacy_contract_rejects_recollections(events):
    validated = payments.transaction_candidates(events)
    rejected = envelope.rejected(validated).groupBy("validation_error").count().collect()
    assert {r[0]: r[1] for r in rejected} == {
        "invalid_payment_completed_fields": 2,
        "invalid_payment_refunded_fields": 2,
    }
    assert payments.transactions_legacy(validated).count() == 9


def test_transitions(spark, booking_events):
    assert bookings.transition_violations(booking_events).isEmpty()
    extra = [
        event("z1", "checked_in", datetime(2026, 9, 8), 7, status="checked_in"),
        event("z2", "no_show_marked", datetime(2026, 9, 8), 77, status="no_show"),
    ]
    more = bookings.clean(
        bookings.candidates(envelope.parse(bronze(spark, extra, first_offset=900)))
    )
    found = bookings.transition_violations(booking_events.unionByName(more)).collect()
    assert {(r.event_id, r.previous_status) for r in found} == {("z1", "cancelled"), ("z2", None)}


def test_daily_metrics(spark, booking_events):
    shops = spark.createDataFrame(
        [(s, f"shop {s}", date(2026, 9, s), None) for s in (1, 2, 3)],
        "shop_id long, shop_name string, opened_on date, closed_on date",
    )
    rows = gold.shop_daily_metrics(booking_events, shops, date(2026, 9, 7)).collect()
    assert len(rows) == 15
    busy = {(r.shop_id, r.report_date.day): (r.created_count, r.cancelled_count) for r in rows if r.created_count}
    assert busy == {(1, 4): (4, 1), (2, 4): (3, 0), (3, 4): (3, 0)}


def test_orphans_and_ties(spark):
    tie = datetime(2026, 9, 4, 12)
    payloads = [
        event("a", "no_show_marked", tie, 5, status="no_show"),
        event("b", "checked_in", tie, 5, status="checked_in"),
    ]
    clean = bookings.clean(bookings.candidates(envelope.parse(bronze(spark, payloads))))
    for build in (bookings.current, joined.bookings_current):
        (row,) = build(clean).collect()
        assert (row.status, row.is_orphan, row.customer_id, row.start_at) == ("no_show", True, None, None)
