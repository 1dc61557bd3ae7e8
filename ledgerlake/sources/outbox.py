"""Outbox rows as topic records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.reconcile import event_ids, ids_missing
from ledgerlake.schemas import HEADERS, TOPIC


def outbox_to_records(outbox: DataFrame, topic: str = TOPIC) -> DataFrame:
    """Publishable records: key = partition key, value = payload, ``id`` header = event id."""
    header = F.struct(F.lit("id").alias("key"), F.col("event_id").cast("binary").alias("value"))
    return outbox.select(
        F.col("partition_key").cast("binary").alias("key"),
        F.col("payload").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.array(header).cast(HEADERS).alias("headers"),
    )


def lost_records(outbox: DataFrame, bronze: DataFrame, topic: str = TOPIC) -> DataFrame:
    """Outbox events that never reached Bronze, ready to be published again."""
    return outbox_to_records(lost_rows(outbox, bronze), topic)


def lost_rows(outbox: DataFrame, bronze: DataFrame) -> DataFrame:
    """Outbox rows whose event never reached Bronze."""
    lost = ids_missing(outbox, event_ids(bronze))
    return outbox.join(lost, "event_id", "left_semi")
