"""Hand-made inputs: Bronze rows from payloads, and the ten-booking golden data set."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlake.operators.bronze import bronze_rows
from ledgerlake.schemas import KAFKA, TOPIC

INGESTED = datetime(2026, 9, 10)


def records(spark, payloads, topic=TOPIC, first_offset=0):
    """Topic records on one partition, one per payload (text, bytes, dict or None)."""
    rows = []
    for i, payload in enumerate(payloads):
        if isinstance(payload, dict):
            payload = json.dumps(payload)
        if isinstance(payload, str):
            payload = payload.encode()
        value = None if payload is None else bytearray(payload)
        headers = [(f"id", bytearray(b"h"))]
        rows.append(
            (bytearray(b"1"), value, topic, 0, first_offset + i, INGESTED, 0, headers)
        )
    return spark.createDataFrame(rows, KAFKA)


def bronze(spark, payloads, **options):
    return bronze_rows(records(spark, payloads, **options), F.col("timestamp"))


def event(event_id, event_type, at, booking=1, shop=1, **extra):
    stamp = at if isinstance(at, str) else at.isoformat() + "+09:00"
    return {
        "event_id": event_id,
        "event_type": event_type,
        "event_time": stamp,
        "ingest_time": stamp,
        "schema_version": 1,
        "booking_id": booking,
        "shop_id": shop,
        **extra,
    }


NOON = datetime(2026, 9, 4, 12)
CREATED = {
    "staff_id": 1,
    "customer_id": 2,
    "service_id": 3,
    "start_at": "2026-09-05T09:00:00+09:00",
    "booked_price_krw": 100,
    "status": "scheduled",
}
RESCHEDULED = {
    "old_start_at": "2026-09-05T09:00:00+09:00",
    "start_at": "2026-09-06T09:00:00+09:00",
    "status": "rescheduled",
}
CANCELLED = {"cancelled_at": "2026-09-04T12:00:00+09:00", "status": "cancelled"}
REQUESTED = {
    "payment_id": 7,
    "request_amount_krw": 100,
    "payout_amount_krw": 0,
    "refund_amount_krw": 0,
    "paid_amount_krw": 0,
    "unpaid_amount_krw": 100,
    "payment_status": "unpaid",
    "needs_repayment": False,
}
COMPLETED = {
    **REQUESTED,
    "payment_transaction_id": 70,
    "amount_krw": 100,
    "payout_amount_krw": 100,
    "paid_amount_krw": 100,
    "unpaid_amount_krw": 0,
    "payment_status": "paid",
}
REFUNDED = {
    **COMPLETED,
    "payment_transaction_id": 71,
    "refund_amount_krw": 100,
    "paid_amount_krw": 0,
    "payment_status": "refunded",
    "refund_type": "full",
}


# --- golden data set: 10 bookings, 7 payments, 13 movements, 40 events ---------------
BASE, PRICE = datetime(2026, 9, 4, 9), 55_000


def _booking(i):
    shop = (i - 1) % 3 + 1
    start = datetime(2026, 9, 4) + timedelta(days=1 + (i - 1) // 8, hours=9 + (i - 1) % 8)
    return {
        "shop": shop,
        "staff": (shop - 1) * 2 + (i - 1) % 2 + 1,
        "created": BASE + timedelta(minutes=i),
        "start": start,
    }


def _at(moment):
    return moment.isoformat() + "+09:00"


def _movements(i):
    """(kind, amount, hours after start, repayment flag raised) of payment ``i``."""
    first = {2: 30_000}.get(i, PRICE)
    moves = [("payment", first, 1, False)]
    refund = {3: (20_000, False), 4: (20_000, True), 5: (PRICE, False), 6: (PRICE, True)}.get(i)
    if refund:
        moves.append(("refund", refund[0], 26, refund[1]))
    again = {4: 20_000, 6: 30_000}.get(i)
    if again:
        moves.append(("payment", again, 27, False))
    return moves


def golden_events():
    events = []

    def add(event_id, kind, at, i, **extra):
        events.append(event(event_id, kind, at, i, _booking(i)["shop"], **extra))

    for i in range(1, 11):
        b = _booking(i)
        add(
            f"c{i}", "booking_created", b["created"], i,
            staff_id=b["staff"], customer_id=i, service_id=b["shop"],
            start_at=_at(b["start"]), booked_price_krw=PRICE, status="scheduled",
        )
    moved = _booking(9)["start"]
    add(
        "r9", "booking_rescheduled", _booking(9)["created"] + timedelta(hours=1), 9,
        old_start_at=_at(moved), start_at=_at(moved + timedelta(days=1)), status="rescheduled",
    )
    gone = _booking(7)["created"] + timedelta(hours=3)
    add("x7", "booking_cancelled", gone, 7, status="cancelled", cancelled_at=_at(gone))
    add("n8", "no_show_marked", _booking(8)["start"] + timedelta(minutes=15), 8, status="no_show")
    for i in (1, 2, 3, 4, 5, 6, 9):
        start = _booking(i)["start"] + timedelta(days=1 if i == 9 else 0)
        add(f"i{i}", "checked_in", start - timedelta(minutes=5), i, status="checked_in")
        common = {"payment_id": i, "request_amount_krw": PRICE}
        add(
            f"q{i}", "payment_requested", start + timedelta(minutes=45), i, **common,
            payout_amount_krw=0, refund_amount_krw=0, paid_amount_krw=0, unpaid_amount_krw=PRICE,
            payment_status="unpaid", needs_repayment=False,
        )
        payout = refund = 0
        again = False
        for n, (kind, amount, hours, raised) in enumerate(_movements(i)):
            if kind == "payment":
                payout += amount
            else:
                refund += amount
            paid = payout - refund
            again = (again or raised) and paid < PRICE
            if paid == PRICE:
                status, unpaid = "paid", 0
            elif again or refund == 0:
                status, unpaid = "unpaid", PRICE - paid
            else:
                status, unpaid = ("refunded" if paid == 0 else "partially_refunded"), 0
            extra = {"refund_type": "full" if paid == 0 else "partial"} if kind == "refund" else {}
            name = "payment_completed" if kind == "payment" else "payment_refunded"
            add(
                f"m{i}-{n}", name, start + timedelta(hours=hours), i, **common,
                payment_transaction_id=i + 10 * n, amount_krw=amount, payout_amount_krw=payout,
                refund_amount_krw=refund, paid_amount_krw=paid, unpaid_amount_krw=unpaid,
                payment_status=status, needs_repayment=again, **extra,
            )
    return events
