"""Bring back outbox events that never reached Bronze: send them again and ingest them.

The loop is safe to repeat. It first ingests what already waits in the topic, so an event that an
interrupted run sent is not sent twice, and it sends only what Bronze lacks after that. A resent
record takes the next offsets of its partition, so the topic stays without gaps or repeats.

An event is looked for in Bronze by the id in its payload. One whose payload carries no id, or
another one, could never be found there; it is counted as ``unreadable`` and never sent again.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.running import running_sums
from ledgerlake.schemas import KAFKA
from ledgerlake.sources import outbox, readers
from ledgerlake.sources.scratch import discard, stored
from ledgerlake.streaming.ingest import ingest_available, read_bronze


@dataclass(frozen=True)
class Recovery:
    """Events that were missing, those of them sent again, and those still missing afterwards."""

    missing: int
    sent: int
    unreadable: int
    left: int


def positioned(records: DataFrame, topic: DataFrame, partitions: int) -> DataFrame:
    """Records with a partition by their key and the next free offsets of a topic kept as files.

    A message broker does this itself. Offsets are counted within ranges of a hash, so records that
    all go to one partition are numbered by many tasks.
    """
    ends = topic.groupBy("partition").agg((F.max("offset") + 1).alias("next"))
    spread = records.withColumns(
        {"partition": F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"), "_hash": F.xxhash64("value")}
    )
    order = (("_hash", "asc"), ("value", "asc"))
    counted = running_sums(spread, "partition", [F.shiftright("_hash", 44)], order, {"_number": F.lit(1)})
    constants = {"timestamp": F.current_timestamp(), "timestampType": F.lit(0)}
    return (
        counted.join(ends, "partition", "left")
        .withColumn("offset", F.coalesce("next", F.lit(0)) + F.col("_number") - 1)
        .select(*(constants.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in KAFKA))
    )


def recover(
    spark: SparkSession, sent: DataFrame, topic: str, target: str, checkpoint: str, partitions: int, **options
) -> Recovery:
    """Send outbox rows again that Bronze lacks, and ingest them on the checkpoint of the stream.

    ``topic`` is a folder of record files; ``options`` go to the ingest.
    """

    def catch_up() -> None:
        ingest_available(readers.record_files_stream(spark, topic), target, checkpoint, **options)

    catch_up()
    has_id = F.coalesce(F.get_json_object("payload", "$.event_id") == F.col("event_id"), F.lit(False))
    missing = stored(outbox.lost_rows(sent, read_bronze(spark, target)).withColumn("_readable", has_id), "lost")
    n = missing.agg(F.count("*").alias("all"), F.count_if("_readable").alias("readable")).first()
    left = n["all"]
    if n["readable"]:
        lost = outbox.outbox_to_records(missing.filter("_readable").drop("_readable"))
        records = stored(positioned(lost, readers.record_files(spark, topic), partitions), "resent")
        records.write.mode("append").parquet(topic)
        catch_up()
        left = outbox.lost_rows(sent, read_bronze(spark, target)).count()
        discard(records)
    discard(missing)
    return Recovery(n["all"], n["readable"], n["all"] - n["readable"], left)
