"""Reconciliation: table diffs, id sets, ledger against summary, references, lookups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.ordering import LATEST_STATE, leading
from ledgerlake.functions.rules import any_of
from ledgerlake.operators.bronze import bronze_rows
from ledgerlake.operators.expect import CheckFailed, duplicates
from ledgerlake.schemas import BRONZE, POSITION

_CHUNK = 1_000_000


def table_diff(a: DataFrame, b: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """Two-way multiset difference, each surplus row labelled with the side that has it.

    Both sides meet in one signed count, so each is read and shuffled once, and equal
    rows collapse before the shuffle.
    """
    counted = _signed_counts(a, b)
    labelled = counted.withColumn("difference", F.when(F.col("_n") > 0, label_a).otherwise(label_b))
    return _copies(labelled.withColumn("_n", F.abs("_n"))).select("difference", *a.columns)


def _copies(rows: DataFrame) -> DataFrame:
    """Every row ``_n`` times; in two steps, so that no array grows with the surplus."""
    copies = rows.withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(_CHUNK).cast("bigint")))
    )
    upto = F.least(F.col("_from") + (_CHUNK - 1), F.col("_n") - 1)
    return copies.withColumn("_i", F.explode(F.sequence(F.col("_from"), upto)))


def _signed_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    one = F.lit(1).cast("bigint")
    return (
        a.withColumn("_n", one)
        .unionAll(b.select(*a.columns).withColumn("_n", -one))
        .groupBy(*a.columns)
        .agg(F.sum("_n").alias("_n"))
        .filter("_n <> 0")
    )


DIGEST = "_digest"
#: Timestamps in a digest keep their microseconds.
_EXACT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over a JSON text of the columns, in which NULL, empty and quoted values differ."""
    return F.sha2(F.to_json(F.struct(*columns), _EXACT), 256)


def _recorded(records: DataFrame, bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic and Bronze in the same columns."""
    columns = [f.name for f in BRONZE if f.name != "bronze_ingested_at"]
    return bronze_rows(records).select(*columns), bronze.select(*columns)


def _per_record(topic: DataFrame, stored: DataFrame) -> DataFrame:
    """How often each record is in the topic and in Bronze: one shuffle of positions and digests."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    digest = row_digest(topic.columns).alias(DIGEST)
    sides = topic.select(*POSITION, digest, one.alias("t"), zero.alias("b")).unionAll(
        stored.select(*POSITION, digest, zero.alias("t"), one.alias("b"))
    )
    grouped = sides.repartition(*POSITION).groupBy(*POSITION, DIGEST)
    return grouped.agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def record_diff(records: DataFrame, bronze: DataFrame) -> DataFrame:
    """Records that only the topic (``topic_only``) or only Bronze (``bronze_only``) holds, as a multiset.

    Positions and digests are compared first; whole records are fetched for differing ones only.
    """
    topic, stored = _recorded(records, bronze)
    differing = _per_record(topic, stored).withColumn("_n", F.col("t") - F.col("b")).filter("_n <> 0")

    def surplus(rows: DataFrame, sign: int, label: str) -> DataFrame:
        wanted = differing.select(*(F.col(c).alias(f"_{c}") for c in POSITION), F.col(DIGEST).alias("_d"), (F.col("_n") * sign).alias("_n"))
        wanted = wanted.filter("_n > 0")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in POSITION]
        met = rows.withColumn(DIGEST, row_digest(rows.columns)).join(wanted, [*same, F.col(DIGEST) == F.col("_d")])
        first = met.groupBy(*POSITION, DIGEST).agg(F.first(F.struct(*rows.columns)).alias("row"), F.first("_n").alias("_n"))
        return _copies(first.select("row.*", "_n")).select(F.lit(label).alias("difference"), *rows.columns)

    return surplus(topic, 1, "topic_only").unionAll(surplus(stored, -1, "bronze_only"))


def bronze_vs_topic(records: DataFrame, bronze: DataFrame) -> DataFrame:
    """One row: topic and Bronze sizes, missing and extra records, repeated positions."""
    zero = F.lit(0).cast("bigint")
    surplus = F.col("t") - F.col("b")
    per_position = (
        _per_record(*_recorded(records, bronze))
        .groupBy(*POSITION)
        .agg(
            F.sum("t").alias("t"),
            F.sum("b").alias("b"),
            F.sum(F.greatest(surplus, zero)).alias("missing"),
            F.sum(F.greatest(-surplus, zero)).alias("extra"),
        )
    )
    return per_position.agg(
        _total("t", "topic_rows"),
        _total("b", "bronze_rows"),
        _total("missing", "missing"),
        _total("extra", "extra"),
        F.count_if(F.col("b") > 1).alias("duplicate_positions"),
    )


def bronze_reconciliation(
    records: DataFrame, bronze: DataFrame, expected_ids: DataFrame | None = None
) -> DataFrame:
    """The figures of :func:`bronze_vs_topic`, and of the ids in both directions if a list is given."""
    figures = bronze_vs_topic(records, bronze)
    if expected_ids is None:
        return figures
    ids = id_diff(expected_ids, event_ids(bronze)).agg(
        F.count_if(F.col("difference") == "missing").alias("ids_missing"),
        F.count_if(F.col("difference") == "unexpected").alias("ids_unexpected"),
    )
    return figures.crossJoin(ids)  # one row each


def verify_bronze(
    records: DataFrame, bronze: DataFrame, expected_ids: DataFrame | None = None
) -> DataFrame:
    """Records per event type of a Bronze table that reconciles; refused with the figures otherwise."""
    if expected_ids is not None and expected_ids.isEmpty():
        raise CheckFailed("the list of expected ids is empty; nothing can be reconciled")
    figures = bronze_reconciliation(records, bronze, expected_ids).first().asDict()
    if not figures["topic_rows"]:
        raise CheckFailed("the topic has no records; no ingestion was verified")
    bad = {k: v for k, v in figures.items() if k not in ("topic_rows", "bronze_rows") and v}
    if bad:
        raise CheckFailed("Bronze does not reconcile: " + ", ".join(f"{k}={v}" for k, v in bad.items()))
    return event_type_counts(bronze)


def _total(column: str, name: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).alias(name)


def duplicate_positions(bronze: DataFrame) -> DataFrame:
    return duplicates(bronze, *POSITION)


def event_ids(bronze: DataFrame) -> DataFrame:
    """Distinct event ids found in raw payloads, valid or not."""
    return bronze.select(F.get_json_object("payload", "$.event_id").alias("event_id")).distinct()


def event_type_counts(bronze: DataFrame) -> DataFrame:
    """Records per event type, read straight from the raw payload."""
    kind = F.get_json_object("payload", "$.event_type").alias("event_type")
    return bronze.groupBy(kind).count()


def ids_missing(expected: DataFrame, found: DataFrame, key: str = "event_id") -> DataFrame:
    """Ids of ``expected`` that ``found`` lacks."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def id_diff(expected: DataFrame, found: DataFrame, key: str = "event_id") -> DataFrame:
    """Both directions at once, one shuffle: ids with ``missing`` or ``unexpected``.

    A record without a readable id is unexpected (as the id NULL); a NULL in the list is no id.
    """
    sides = expected.filter(F.col(key).isNotNull()).select(key, F.lit(True).alias("e"))
    return (
        sides.unionAll(found.select(key, F.lit(False).alias("e")))
        .groupBy(key)
        .agg(F.bool_and("e").alias("only_expected"), F.bool_or("e").alias("expected"))
        .filter("only_expected OR NOT expected")
        .select(key, F.when(F.col("expected"), "missing").otherwise("unexpected").alias("difference"))
    )


def ledger_sums(movements: DataFrame) -> DataFrame:
    """Collected, refunded and net amounts per payment."""
    kind, amount = F.col("transaction_type"), F.col("amount_krw")
    zero = F.lit(0)
    return movements.groupBy("payment_id").agg(
        F.coalesce(F.sum(F.when(kind == "payment", amount)), zero).alias("ledger_payout"),
        F.coalesce(F.sum(F.when(kind == "refund", amount)), zero).alias("ledger_refund"),
        F.coalesce(
            F.sum(F.when(kind == "payment", amount).when(kind == "refund", -amount)), zero
        ).alias("ledger_paid"),
    )


def payment_ledger_of_events(events: DataFrame) -> DataFrame:
    """:func:`payment_ledger` straight from clean payment events: one scan, one shuffle.

    The latest summary and the signed sums of a payment come from the same aggregate.
    """
    kind = F.when(F.col("payment_transaction_id").isNotNull(), F.col("transaction_type"))
    amount, zero = F.col("amount_krw"), F.lit(0)
    stated = ["payout_amount_krw", "refund_amount_krw", "paid_amount_krw"]
    per_payment = events.groupBy("payment_id").agg(
        leading(LATEST_STATE, stated).alias("s"),
        F.coalesce(F.sum(F.when(kind == "payment", amount)), zero).alias("ledger_payout"),
        F.coalesce(F.sum(F.when(kind == "refund", amount)), zero).alias("ledger_refund"),
    )
    flat = per_payment.select(
        "payment_id",
        *(F.col(f"s.row.{c}") for c in stated),
        "ledger_payout",
        "ledger_refund",
        (F.col("ledger_payout") - F.col("ledger_refund")).alias("ledger_paid"),
    )
    broken = any_of(
        F.col("payout_amount_krw") != F.col("paid_amount_krw") + F.col("refund_amount_krw"),
        *(F.col(c) != F.col(f"ledger_{c.removesuffix('_amount_krw')}") for c in stated),
    )
    return flat.filter(broken)


def payment_ledger(summaries: DataFrame, movements: DataFrame) -> DataFrame:
    """Summaries that disagree with the movements recorded for the payment."""
    pairs = {"payout": "payout_amount_krw", "refund": "refund_amount_krw", "paid": "paid_amount_krw"}
    joined = summaries.join(ledger_sums(movements), "payment_id", "left").withColumns(
        {f"ledger_{s}": F.coalesce(f"ledger_{s}", F.lit(0)) for s in pairs}
    )
    broken = any_of(
        F.col("payout_amount_krw") != F.col("paid_amount_krw") + F.col("refund_amount_krw"),
        *(F.col(c) != F.col(f"ledger_{s}") for s, c in pairs.items()),
    )
    return joined.filter(broken).select(
        "payment_id", *pairs.values(), *(f"ledger_{s}" for s in pairs)
    )


def fk_violations(
    child: DataFrame, parent: DataFrame, columns: Sequence[str], parent_columns: Sequence[str]
) -> DataFrame:
    """Child keys without a parent, with the number of child rows; NULL keys are exempt.

    Children are counted per key first, so a hot key costs one row in the join.
    """
    keys = child.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("child_rows"))
    parents = parent.select(*(F.col(p).alias(c) for c, p in zip(columns, parent_columns))).distinct()
    return keys.join(parents, list(columns), "left_anti")


def bookable_slots(shops: DataFrame, services: DataFrame, staffs: DataFrame) -> DataFrame:
    """Per active shop, its first active service and first active staff member, by id.

    Each side is cut to one row per shop before joining, so no pairs are built.
    """
    first_service = (
        services.filter("is_active")
        .groupBy("shop_id")
        .agg(F.min(F.struct("id", "list_price_krw")).alias("service"))
    )
    first_staff = (
        staffs.filter("is_active").groupBy("shop_id").agg(F.min("id").alias("staff_id"))
    )
    return (
        shops.filter("is_active")
        .select(F.col("id").alias("shop_id"))
        .join(first_service, "shop_id")
        .join(first_staff, "shop_id")
        .select(
            "shop_id",
            F.col("service.id").alias("service_id"),
            "staff_id",
            F.col("service.list_price_krw").alias("list_price_krw"),
        )
    )


def first_bookable_slot(shops: DataFrame, services: DataFrame, staffs: DataFrame) -> DataFrame:
    slots = bookable_slots(shops, services, staffs)
    return slots.orderBy("shop_id", "service_id", "staff_id").limit(1)


def payments_with_booking(payments: DataFrame, bookings: DataFrame, status: str) -> DataFrame:
    """Payments in a status together with the shop and state of their booking."""
    known = bookings.select(
        "booking_id",
        F.col("shop_id").alias("booking_shop_id"),
        F.col("status").alias("booking_status"),
    )
    return (
        payments.filter(F.col("payment_status") == status)
        .drop("shop_id")
        .join(known, "booking_id")
        .withColumnRenamed("booking_shop_id", "shop_id")
    )
