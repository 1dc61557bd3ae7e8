"""Topic records, shops, services, staff and outbox rows derived from the given tables.

The given tables hold no bookings, so fixed formulas map ``events`` to booking records,
``orders``/``lineitem`` to payment records and ``supplier`` to shops, with defects spread
by id. Only the inputs are derived here; nothing in the operators depends on it.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.running import running_sums
from ledgerlake.operators.bronze import bronze_rows
from ledgerlake.schemas import KAFKA, TOPIC

# --- fixed values of the derivation ---------------------------------------------
AS_OF = date(2024, 1, 31)
BOOKING_KINDS = {
    "signup": "booking_created",
    "view": "booking_rescheduled",
    "error": "booking_cancelled",
    "click": "checked_in",
    "purchase": "no_show_marked",
}
STATUS_OF_KIND = {
    "signup": "scheduled",
    "view": "rescheduled",
    "error": "cancelled",
    "click": "checked_in",
    "purchase": "no_show",
}
REDELIVERED_EVERY = 50
PAYMENT_OFFSET = 20_000_000
REFUND_ROW = 500
PART_RANGE = 65_536
# -------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def json_object(members: dict[str, Column]) -> Column:
    """JSON text of the members that are not NULL; values are JSON text already."""
    pairs = [F.concat(F.lit(f'"{name}":'), value.cast("string")) for name, value in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def hours(count) -> Column:
    return F.make_dt_interval(hours=count if isinstance(count, Column) else F.lit(count))


def days(count: int) -> Column:
    return F.make_dt_interval(days=F.lit(count))


def chosen(by: Column, values: dict) -> Column:
    first, *rest = values.items()
    picked = F.when(by == first[0], first[1])
    for key, value in rest:
        picked = picked.when(by == key, value)
    return picked


def first_multiple(number: Column, names: dict[int, str]) -> Column:
    """Name of the first divisor of ``number`` in the given order."""
    first, *rest = names.items()
    picked = F.when(number % first[0] == 0, first[1])
    for divisor, name in rest:
        picked = picked.when(number % divisor == 0, name)
    return picked


def booking_records(events: DataFrame) -> DataFrame:
    """``events`` as topic records; a narrow map, so it also runs on a stream."""
    event_id, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ts = F.col("ts")
    defect = (
        F.when(event_id % 101 == 0, "malformed")
        .when(event_id % 103 == 0, "no_id")
        .when(event_id % 107 == 0, "version")
        .when(event_id % 109 == 0, "booking")
        .when(event_id % 113 == 0, "time")
        .when(event_id % 127 == 0, "customer")
        .when((kind == "signup") & (event_id % 131 == 0), "price")
        .when(event_id % 137 == 0, "status")
    )
    bad = lambda name: F.coalesce(F.col("defect") == name, F.lit(False))
    created, moved = kind == "signup", kind == "view"
    when_ = iso(F.date_trunc("hour", ts))
    members = {
        "event_id": F.when(~bad("no_id"), quoted(F.concat(F.lit("b-"), event_id))),
        "event_type": quoted(chosen(kind, BOOKING_KINDS)),
        "event_time": quoted(F.when(bad("time"), "not-a-time").otherwise(when_)),
        "ingest_time": quoted(when_),
        "schema_version": F.when(bad("version"), 2).otherwise(1),
        "booking_id": F.when(bad("booking"), 0).otherwise(user + 1),
        "shop_id": user % 10 + 1,
        "customer_id": F.when(bad("customer"), quoted(F.lit("abc"))).when(
            created, (user % 7 + 1).cast("string")
        ),
        "service_id": F.when(created, event_id % 5 + 1),
        "staff_id": F.when(created, event_id % 4 + 1),
        "booked_price_krw": F.when(bad("price"), -1).when(
            created, F.floor("value").cast("bigint") * 100
        ),
        "old_start_at": F.when(moved, quoted(iso(ts + hours(12)))),
        "start_at": F.when(created, quoted(iso(ts + days(1)))).when(
            moved, quoted(iso(ts + days(2)))
        ),
        "cancelled_at": F.when(kind == "error", quoted(iso(ts))),
        "status": F.when(~bad("status"), quoted(chosen(kind, STATUS_OF_KIND))),
    }
    payload = F.when(bad("malformed"), F.lit('{"event_id":')).otherwise(json_object(members))
    copies = F.when(event_id % REDELIVERED_EVERY == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return (
        events.withColumn("defect", defect)
        .select(
            payload.cast("binary").alias("value"),
            (user % 10 + 1).cast("string").cast("binary").alias("key"),
            (user % 3).alias("partition"),
            "event_id",
            (F.date_trunc("day", ts).cast("timestamp_ntz") + days(1)).alias("day"),
            F.explode(copies).alias("copy"),
        )
        .select(
            "key",
            "value",
            "partition",
            (F.col("event_id") * 2 + F.col("copy")).alias("offset"),
            (F.col("day") + F.make_dt_interval(days="copy")).cast("timestamp").alias("timestamp"),
        )
        .transform(_as_records)
    )


def _as_records(rows: DataFrame) -> DataFrame:
    constants = {
        "topic": F.lit(TOPIC),
        "timestampType": F.lit(0),
        "headers": F.array().cast(KAFKA["headers"].dataType),
    }
    return rows.select(
        *(constants.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in KAFKA)
    )


def payment_records(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One request per order with lines, one collection per line, one refund per returned line."""
    amount = F.floor("l_extendedprice").cast("bigint")  # made again where needed, not shuffled
    returned = F.col("returned")
    order = (
        ("l_linenumber", "asc"),
        ("l_partkey", "asc"),
        ("l_suppkey", "asc"),
        ("l_shipdate", "asc"),
        ("l_extendedprice", "asc"),
    )
    lines = running_sums(
        lineitem.filter("l_orderkey IS NOT NULL")  # such lines have no order
        .select("l_orderkey", *(c for c, _ in order), (F.col("l_returnflag") == "R").alias("returned")),
        "l_orderkey",
        [F.struct("l_linenumber", F.floor(F.col("l_partkey") / PART_RANGE).alias("part_range"))],
        order,
        {
            "k": F.lit(1),
            "collected": amount,
            "j": F.when(returned, 1),
            "refunded": F.when(returned, amount),
        },
        totals={"request": "collected"},
    )
    requested = F.when(F.col("k") == 1, _move("requested", F.lit(0), F.lit(0)))
    completed = _move("completed", F.col("k"), F.col("collected"))
    refunded = F.when(returned, _move("refunded", F.col("j"), F.col("refunded")))
    keys = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    # lines lie by order already, so they are joined before each becomes up to three moves
    met = lines.select(
        "l_orderkey", "request", amount.alias("amount"), F.array_compact(F.array(requested, completed, refunded)).alias("moves")
    ).join(keys, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = met.select(*keys.columns, "request", "amount", F.explode("moves").alias("move"))
    return _payment_payload(rows.select(*keys.columns, "request", "amount", "move.*"))


def _move(kind: str, n: Column, running: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        n.cast("bigint").alias("n"),
        running.cast("bigint").alias("running"),
    )


def _payment_payload(rows: DataFrame) -> DataFrame:
    key, kind, n, request = (F.col(c) for c in ("o_orderkey", "kind", "n", "request"))
    requested, completed, refunded = (kind == k for k in ("requested", "completed", "refunded"))
    bad_line = F.when(
        completed & (n == 1),
        first_multiple(
            key,
            {
                97: "amount",
                101: "payment",
                103: "payout",
                107: "weird",
                109: "repayment",
                113: "refund_type",
                127: "status",
            },
        ),
    )
    row_id = key * 1000 + F.when(refunded, n + REFUND_ROW).otherwise(n)
    shaped = rows.select(
        "*",
        bad_line.alias("defect"),
        row_id.alias("row_id"),
        (
            F.col("o_orderdate") + hours(F.when(refunded, n + REFUND_ROW).otherwise(n).cast("int"))
        ).alias("at"),
        F.when(requested, 0).when(completed, F.col("running")).otherwise(request).alias("payout"),
        F.when(refunded, F.col("running")).otherwise(0).alias("refund"),
    ).withColumn("paid", F.col("payout") - F.col("refund"))
    bad = lambda name: F.coalesce(F.col("defect") == name, F.lit(False))
    paid, payout = F.col("paid"), F.col("payout")
    status = (
        F.when(bad("weird"), "weird")
        .when(refunded & (paid > 0), "partially_refunded")
        .when(refunded, "refunded")
        .when(paid == request, "paid")
        .otherwise("unpaid")
    )
    suffix = F.concat(F.when(refunded, "r").otherwise(""), n)
    when_ = quoted(iso(F.col("at")))
    members = {
        "event_id": quoted(F.concat(F.lit("p-"), key, F.lit("-"), suffix)),
        "event_type": quoted(F.concat(F.lit("payment_"), kind)),
        "event_time": when_,
        "ingest_time": when_,
        "schema_version": F.lit(1),
        "booking_id": F.col("o_custkey") + 1,
        "shop_id": F.col("o_custkey") % 10 + 1,
        "payment_id": F.when(bad("payment"), quoted(F.lit("x"))).otherwise(
            (key + 1).cast("string")
        ),
        "payment_transaction_id": F.when(~requested, F.col("row_id")),
        "request_amount_krw": request,
        "amount_krw": F.when(bad("amount"), request + 1).when(~requested, F.col("amount")),
        "payout_amount_krw": F.when(bad("payout"), payout + 1).otherwise(payout),
        "refund_amount_krw": F.col("refund"),
        "paid_amount_krw": paid,
        "unpaid_amount_krw": F.when(refunded, 0).otherwise(request - paid),
        "payment_status": F.when(~bad("status"), quoted(status)),
        "needs_repayment": F.when(~bad("repayment"), F.lit("false")),
        "refund_type": F.when(bad("refund_type"), quoted(F.lit("full"))).when(
            refunded, quoted(F.when(paid > 0, "partial").otherwise("full"))
        ),
    }
    return shaped.select(
        json_object(members).cast("binary").alias("value"),
        (F.col("o_custkey") % 10 + 1).cast("string").cast("binary").alias("key"),
        (key % 3).alias("partition"),
        (F.col("row_id") + PAYMENT_OFFSET).alias("offset"),
        (F.date_trunc("day", "at").cast("timestamp_ntz") + days(1)).cast("timestamp").alias("timestamp"),
    ).transform(_as_records)


def dense_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as positions of a topic without gaps; partition 0 holds three quarters of it."""
    event_id = F.col("event_id")
    hot = event_id % 4 != 3
    group = F.expr("event_id div 4")
    return table(spark, sf_dir, "events").select(
        F.lit(TOPIC).alias("kafka_topic"),
        F.when(hot, 0).otherwise(1).alias("kafka_partition"),
        F.when(hot, group * 3 + event_id % 4).otherwise(group).cast("bigint").alias("kafka_offset"),
    )


def withheld(offset: str) -> Column:
    """Ranges of offsets, and single ones, that never arrive."""
    at = F.col(offset)
    return (F.floor(at / 40) % 9 == 0) | (at % 97 == 5)


def redelivered(offset: str) -> Column:
    """Whether a booking record is the second copy of its event; copies share no position."""
    return F.col(offset) % 2 == 1


def booking_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_rows(booking_records(table(spark, sf_dir, "events")), F.col("timestamp"))


def payment_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = payment_records(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    return bronze_rows(records, F.col("timestamp"))


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational shop rows from ``supplier``."""
    key = F.col("s_suppkey")
    opened = F.when(key % 7 != 3, F.date_add(F.lit(date(2024, 1, 1)), (key % 10).cast("int")))
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "supplier").select(
        (key + 1).alias("id"),
        F.col("s_name").alias("shop_name"),
        F.concat(F.lit("r"), F.col("s_nationkey") % 5).alias("region"),
        (key % 11 != 0).alias("is_active"),
        opened.alias("opened_on"),
        F.when(key % 3 == 0, F.date_add(opened, 15)).alias("closed_on"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service catalogue rows from ``part``."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key + 1).alias("id"),
        (key % 97 + 1).alias("shop_id"),
        F.floor("p_retailprice").cast("bigint").alias("list_price_krw"),
        (key % 4 * 30).alias("duration_minutes"),
        (key % 5 != 0).alias("is_active"),
    )


def staffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff rows from ``customer``."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        (key + 1).alias("id"),
        (key % 89 + 1).alias("shop_id"),
        (key % 3 != 0).alias("is_active"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows whose publication yields the booking records of ``events``."""
    sent = booking_records(table(spark, sf_dir, "events")).filter(~redelivered("offset"))
    event_id = F.expr("offset div 2")
    return sent.select(
        F.concat(F.lit("b-"), event_id).alias("event_id"),
        F.lit("booking").alias("aggregate_type"),
        F.col("key").cast("string").alias("partition_key"),
        F.col("value").cast("string").alias("payload"),
        (event_id % 3).cast("int").alias("schema_version"),
        F.col("timestamp").alias("event_time"),
    )
