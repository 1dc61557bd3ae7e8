"""Window and join forms of the aggregated operators, kept for comparison only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.ordering import CREATION, LATEST_STATE, Order, sort_columns
from ledgerlake.schemas import BOOKINGS_CURRENT, PAYMENTS_CURRENT


def first_per_key_ranked(df: DataFrame, key: str, order: Order) -> DataFrame:
    """Window form of ``first_per_key``; Spark limits groups before the shuffle."""
    ranked = Window.partitionBy(key).orderBy(*sort_columns(order))
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def bookings_current(events: DataFrame) -> DataFrame:
    """``bookings.current`` from three ranked selections and two left joins."""

    def top(rows, order, **columns):
        w = Window.partitionBy("booking_id").orderBy(*sort_columns(order))
        return (
            rows.withColumn("_rank", F.row_number().over(w))
            .filter("_rank = 1")
            .select("booking_id", *(F.col(src).alias(out) for out, src in columns.items()))
        )

    status = top(
        events,
        LATEST_STATE,
        shop_id="shop_id",
        status="status",
        cancelled_at="cancelled_at",
        status_event_id="event_id",
        status_event_type="event_type",
        status_event_time="event_time",
    )
    creation = top(
        events.filter(F.col("event_type") == "booking_created"),
        CREATION,
        created_booking="booking_id",
        customer_id="customer_id",
        service_id="service_id",
        staff_id="staff_id",
        booked_price_krw="booked_price_krw",
        created_event_time="event_time",
    )
    start = top(events.filter(F.col("start_at").isNotNull()), LATEST_STATE, start_at="start_at")
    return (
        status.join(creation, "booking_id", "left")
        .join(start, "booking_id", "left")
        .withColumn("is_orphan", F.col("created_booking").isNull())
        .select(*BOOKINGS_CURRENT)
    )


def payments_current(events: DataFrame) -> DataFrame:
    """``payments.current`` from two ranked selections and a left join."""

    def top(rows, order):
        w = Window.partitionBy("payment_id").orderBy(*sort_columns(order))
        return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1")

    state = top(events, LATEST_STATE).withColumnsRenamed(
        {
            "payment_transaction_id": "latest_transaction_id",
            "transaction_type": "latest_transaction_type",
            "amount_krw": "latest_transaction_amount_krw",
            "event_id": "state_event_id",
            "event_type": "state_event_type",
            "event_time": "state_event_time",
        }
    )
    request = top(events.filter(F.col("event_type") == "payment_requested"), CREATION).select(
        "payment_id",
        F.lit(True).alias("_requested"),
        F.col("event_time").alias("requested_event_time"),
    )
    return (
        state.join(request, "payment_id", "left")
        .withColumn("is_orphan", F.col("_requested").isNull())
        .select(*PAYMENTS_CURRENT)
    )
