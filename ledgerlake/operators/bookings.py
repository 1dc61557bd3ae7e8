"""Booking domain: typed lifecycle events, current state, transition audit."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import fields
from ledgerlake.functions.ordering import CREATION, LATEST_STATE, leading
from ledgerlake.functions.rules import (
    Rule,
    any_of,
    first_broken,
    missing,
    negative,
    not_equal,
    not_positive,
)
from ledgerlake.functions.running import creation_buckets, previous_value
from ledgerlake.operators.envelope import accepted
from ledgerlake.schemas import (
    BOOKING_EVENT_TYPES,
    BOOKING_EVENTS_CLEAN,
    BOOKING_FIELDS,
    BOOKINGS_CURRENT,
    ENVELOPE,
    LINEAGE,
)

# --- fixed values: status written by each event type, and who may follow whom ---
STATUS_OF = {
    "booking_created": "scheduled",
    "booking_rescheduled": "rescheduled",
    "booking_cancelled": "cancelled",
    "checked_in": "checked_in",
    "no_show_marked": "no_show",
}
ALLOWED_AFTER = {
    "scheduled": ("rescheduled", "cancelled", "no_show", "checked_in"),
    "rescheduled": ("checked_in",),
}
# -------------------------------------------------------------------------------


def candidates(events: DataFrame) -> DataFrame:
    """Booking events with typed fields and ``validation_error``."""
    kept = events.filter(F.col("event_type").isin(*BOOKING_EVENT_TYPES))
    shaped = fields.with_json(kept, ENVELOPE, F.col("payload"), BOOKING_FIELDS, "invalid_booking_type", LINEAGE)
    rules = [Rule("invalid_booking_type", F.col("invalid_booking_type")), *contract()]
    return shaped.withColumn("validation_error", first_broken(rules))


def contract() -> list[Rule]:
    """Required fields and status of each event type."""

    def rule(code, event_type, *defects):
        wrong_status = not_equal("status", STATUS_OF[event_type])
        return Rule(code, (F.col("event_type") == event_type) & any_of(*defects, wrong_status))

    return [
        rule(
            "invalid_booking_created_fields",
            "booking_created",
            not_positive("customer_id", "service_id", "staff_id"),
            missing("start_at"),
            negative("booked_price_krw"),
        ),
        rule(
            "invalid_booking_rescheduled_fields",
            "booking_rescheduled",
            missing("old_start_at", "start_at"),
        ),
        rule("invalid_booking_cancelled_fields", "booking_cancelled", missing("cancelled_at")),
        rule("invalid_checked_in_fields", "checked_in"),
        rule("invalid_no_show_fields", "no_show_marked"),
    ]


def clean(validated: DataFrame) -> DataFrame:
    return accepted(validated).select(*BOOKING_EVENTS_CLEAN)


def current(events: DataFrame) -> DataFrame:
    """One row per booking: latest status, first creation, latest known start.

    One aggregation and one shuffle.
    """
    state = ["shop_id", "status", "cancelled_at", "event_id", "event_type", "event_time"]
    created = ["customer_id", "service_id", "staff_id", "booked_price_krw", "event_time"]
    return (
        events.groupBy("booking_id")
        .agg(
            leading(LATEST_STATE, state).alias("s"),
            leading(CREATION, created, F.col("event_type") == "booking_created").alias("c"),
            leading(LATEST_STATE, ["start_at"], F.col("start_at").isNotNull()).alias("t"),
        )
        .select(
            "booking_id",
            *(f"s.row.{c}" for c in ("shop_id", "status", "cancelled_at")),
            "t.row.start_at",
            *(f"c.row.{c}" for c in created if c != "event_time"),
            F.col("c").isNull().alias("is_orphan"),
            F.col("s.row.event_id").alias("status_event_id"),
            F.col("s.row.event_type").alias("status_event_type"),
            F.col("s.row.event_time").alias("status_event_time"),
            F.col("c.row.event_time").alias("created_event_time"),
        )
        .select(*BOOKINGS_CURRENT)
    )


def transition_violations(events: DataFrame) -> DataFrame:
    """Events whose status may not follow the previous status of the booking."""
    traced = previous_value(
        events.select("booking_id", "event_id", "event_type", "status", *(c for c, _ in CREATION)),
        "booking_id",
        creation_buckets(),
        CREATION,
        "status",
        "previous_status",
    )
    opening = F.col("previous_status").isNull() & (F.col("status") == "scheduled")
    allowed = any_of(
        opening,
        *(
            (F.col("previous_status") == before) & F.col("status").isin(*after)
            for before, after in ALLOWED_AFTER.items()
        ),
    )
    return traced.filter(~F.coalesce(allowed, F.lit(False))).select(
        "booking_id", "event_id", "event_type", "event_time", "previous_status", "status"
    )
