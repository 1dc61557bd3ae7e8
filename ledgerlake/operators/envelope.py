"""The event envelope: parse and validate Bronze payloads, drop redeliveries."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import fields
from ledgerlake.functions.keys import dq_key
from ledgerlake.functions.ordering import DQ_LATEST, EARLIEST_DELIVERY, leading
from ledgerlake.functions.repeats import parted
from ledgerlake.functions.rules import Rule, blank, first_broken, missing, not_equal, not_positive
from ledgerlake.schemas import ENVELOPE_FIELDS, EVENTS_CLEAN, LINEAGE, SCHEMA_VERSION

CONFLICT, DELIVERIES, REJECTED = "payload_conflict", "deliveries", "rejected"


def parse(bronze: DataFrame) -> DataFrame:
    """Bronze rows -> envelope columns, lineage, ``malformed_json``, ``validation_error``."""
    shaped = fields.with_json(bronze, [], F.col("payload"), ENVELOPE_FIELDS, "malformed_json", LINEAGE, corrupt=True)
    return shaped.withColumn("validation_error", first_broken(_contract()))


def _contract() -> list[Rule]:
    return [
        Rule("malformed_json", F.col("malformed_json")),
        Rule("missing_event_id", blank("event_id")),
        Rule("missing_event_type", blank("event_type")),
        Rule("unsupported_schema_version", not_equal("schema_version", SCHEMA_VERSION)),
        Rule("invalid_required_id", not_positive("booking_id", "shop_id")),
        Rule("invalid_required_time", missing("event_time", "ingest_time")),
    ]


def dedupe(parsed: DataFrame, audit: bool = False, sparse: bool = False) -> DataFrame:
    """Valid rows, one per ``event_id``: the earliest delivery.

    ``audit`` adds, from the same shuffle, how often the id was delivered and whether its
    payloads differ (compared by SHA-256, so that the payload itself travels once).
    ``sparse`` counts the ids first, by a job of its own, and shuffles only the rows of ids that
    repeat; all others stay where they are. Use it for large inputs that are stored.
    """
    if sparse:
        once, again = parted(accepted(parsed), "event_id")
        extra = {DELIVERIES: F.lit(1).cast("bigint"), CONFLICT: F.lit(False)} if audit else {}
        return _either(once, EVENTS_CLEAN, extra, None if again is None else dedupe(again, audit))
    rest = [c for c in EVENTS_CLEAN if c != "event_id"]
    aggregates = [leading(EARLIEST_DELIVERY, rest).alias("kept")]
    extra = []
    if audit:
        digest = F.sha2("payload", 256)
        aggregates.append(F.count("*").alias(DELIVERIES))
        aggregates.append((F.min(digest) != F.max(digest)).alias(CONFLICT))
        extra = [DELIVERIES, CONFLICT]
    return (
        accepted(parsed)
        .groupBy("event_id")
        .agg(*aggregates)
        .select("event_id", *(F.col(f"kept.row.{c}") for c in rest), *extra)
    )


def _either(
    once: DataFrame | None, columns: Sequence[str], extra: dict[str, Column], settled: DataFrame | None
) -> DataFrame:
    """Rows of single keys with what their aggregate would say, and the settled rest; one may be None."""
    if once is None:
        return settled
    single = once.select(*columns, *(value.alias(name) for name, value in extra.items()))
    return single if settled is None else single.unionByName(settled)


def settle(parsed: DataFrame, sparse: bool = False) -> DataFrame:
    """Valid and rejected rows side by side from one pass and one shuffle.

    Valid rows are reduced to the earliest delivery per ``event_id``, rejected ones to the
    latest per ``dq_key``. ``rejected`` tells them apart; the audit columns are those of
    :func:`dedupe`, and so is ``sparse``.
    """
    bad = F.col("validation_error").isNotNull()
    columns = [*EVENTS_CLEAN, "validation_error"]
    key = F.when(bad, dq_key()).otherwise(F.col("event_id"))
    if sparse:
        once, again = parted(parsed, bad, key)
        extra = {DELIVERIES: F.lit(1).cast("bigint"), CONFLICT: F.when(~bad, False), REJECTED: bad}
        return _either(once, columns, extra, None if again is None else settle(again))
    digest = F.when(~bad, F.sha2("payload", 256))
    return (
        parsed.groupBy(bad.alias(REJECTED), key.alias("_key"))
        .agg(
            leading(EARLIEST_DELIVERY, columns, ~bad).alias("first"),
            leading(DQ_LATEST, columns, bad).alias("last"),
            F.count("*").alias(DELIVERIES),
            (F.min(digest) != F.max(digest)).alias(CONFLICT),
        )
        .select(REJECTED, F.coalesce("first.row", "last.row").alias("row"), DELIVERIES, CONFLICT)
        .select("row.*", DELIVERIES, CONFLICT, REJECTED)
    )


def conflicts(parsed: DataFrame) -> DataFrame:
    """Event ids whose valid deliveries do not all carry the same payload text."""
    return (
        accepted(parsed)
        .groupBy("event_id")
        .agg(F.min("payload").alias("low"), F.max("payload").alias("high"))
        .filter("low <> high")
        .select("event_id")
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("validation_error").isNull())


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("validation_error").isNotNull())
