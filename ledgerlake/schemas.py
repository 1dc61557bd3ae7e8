"""Declared schemas and column lists of every table in the lakehouse."""

from pyspark.sql import types as T

# --- fixed values: names shared with producers and consumers -------------------
TOPIC = "booking.events.v1"
SCHEMA_VERSION = 1

BOOKING_EVENT_TYPES = (
    "booking_created",
    "booking_rescheduled",
    "booking_cancelled",
    "checked_in",
    "no_show_marked",
)
PAYMENT_EVENT_TYPES = ("payment_requested", "payment_completed", "payment_refunded")
TRANSACTION_EVENT_TYPES = ("payment_completed", "payment_refunded")

# keys of the data-quality table: by event id, or by position with a word for missing parts
DQ_EVENT, DQ_POSITION, DQ_UNKNOWN = "event", "kafka", "unknown"

EVENTS_STAGE = "events_clean"
BOOKINGS_STAGE = "booking_events_clean"
PAYMENTS_STAGE = "payment_events_clean"
# -------------------------------------------------------------------------------

HEADERS = T.ArrayType(
    T.StructType().add("key", T.StringType()).add("value", T.BinaryType())
)


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_BINARY, _STRING, _INT, _LONG, _TIME = (
    T.BinaryType(),
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.TimestampType(),
)

KAFKA = schema(
    key=_BINARY,
    value=_BINARY,
    topic=_STRING,
    partition=_INT,
    offset=_LONG,
    timestamp=_TIME,
    timestampType=_INT,
    headers=HEADERS,
)

BRONZE = schema(
    payload=_STRING,
    kafka_value=_BINARY,
    kafka_key=_BINARY,
    kafka_topic=_STRING,
    kafka_partition=_INT,
    kafka_offset=_LONG,
    kafka_timestamp=_TIME,
    kafka_timestamp_type=_INT,
    kafka_headers=HEADERS,
    bronze_ingested_at=_TIME,
)

POSITION = ["kafka_topic", "kafka_partition", "kafka_offset"]

LINEAGE = [
    "payload",
    "kafka_key",
    *POSITION,
    "kafka_timestamp",
    "kafka_headers",
    "bronze_ingested_at",
]

ENVELOPE_FIELDS = {
    "event_id": "string",
    "event_type": "string",
    "schema_version": "int",
    "event_time": "timestamp",
    "ingest_time": "timestamp",
    "booking_id": "bigint",
    "shop_id": "bigint",
}

BOOKING_FIELDS = {
    "customer_id": "bigint",
    "service_id": "bigint",
    "staff_id": "bigint",
    "start_at": "timestamp",
    "old_start_at": "timestamp",
    "cancelled_at": "timestamp",
    "booked_price_krw": "bigint",
    "status": "string",
}

PAYMENT_FIELDS = {
    "payment_id": "bigint",
    "payment_transaction_id": "bigint",
    "request_amount_krw": "bigint",
    "amount_krw": "bigint",
    "payout_amount_krw": "bigint",
    "refund_amount_krw": "bigint",
    "paid_amount_krw": "bigint",
    "unpaid_amount_krw": "bigint",
    "payment_status": "string",
    "needs_repayment": "boolean",
    "refund_type": "string",
}

TRANSACTION_FIELDS = {
    "payment_id": "bigint",
    "payment_transaction_id": "bigint",
    "request_amount_krw": "bigint",
    "amount_krw": "bigint",
    "payment_status": "string",
    "refund_type": "string",
}

ENVELOPE = list(ENVELOPE_FIELDS)
EVENTS_CLEAN = [*ENVELOPE, *LINEAGE]
BOOKING_EVENTS_CLEAN = [*ENVELOPE, *BOOKING_FIELDS, *LINEAGE]

PAYMENT_EVENTS_CLEAN = [
    "event_id", "event_type", "schema_version", "event_time", "ingest_time",
    "payment_id", "payment_transaction_id", "booking_id", "shop_id",
    "request_amount_krw", "transaction_type", "amount_krw",
    "payout_amount_krw", "refund_amount_krw", "paid_amount_krw", "unpaid_amount_krw",
    "payment_status", "needs_repayment", "refund_type",
    *LINEAGE,
]

PAYMENT_TRANSACTIONS_CLEAN = [
    "payment_transaction_id", "payment_id", "booking_id", "shop_id",
    "request_amount_krw", "transaction_type", "amount_krw", "payment_status", "refund_type",
    "event_id", "event_type", "schema_version", "occurred_at", "ingest_time",
    *LINEAGE,
]

BOOKINGS_CURRENT = [
    "booking_id", "shop_id", "status", "start_at", "cancelled_at",
    "customer_id", "service_id", "staff_id", "booked_price_krw", "is_orphan",
    "status_event_id", "status_event_type", "status_event_time", "created_event_time",
]

PAYMENTS_CURRENT = [
    "payment_id", "booking_id", "shop_id", "request_amount_krw",
    "payout_amount_krw", "refund_amount_krw", "paid_amount_krw", "unpaid_amount_krw",
    "payment_status", "needs_repayment",
    "latest_transaction_id", "latest_transaction_type", "latest_transaction_amount_krw",
    "is_orphan", "state_event_id", "state_event_type", "state_event_time",
    "requested_event_time",
]

EVENT_DQ = schema(
    dq_key=_STRING,
    event_id=_STRING,
    event_type=_STRING,
    validation_stage=_STRING,
    validation_error=_STRING,
    payload=_STRING,
    kafka_topic=_STRING,
    kafka_partition=_INT,
    kafka_offset=_LONG,
    kafka_timestamp=_TIME,
    bronze_ingested_at=_TIME,
    source_snapshot_id=_LONG,
    first_detected_at=_TIME,
    last_detected_at=_TIME,
)

DIM_SHOPS = [
    "shop_id", "shop_name", "region", "is_active", "created_at", "updated_at",
    "opened_on", "closed_on", "bronze_ingested_at",
]
