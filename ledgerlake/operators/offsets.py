"""Offsets that a topic had and Bronze does not: missing ranges per topic partition.

Consecutive offsets of a partition that are further apart than one enclose a missing range. The
preceding offset comes from :func:`ledgerlake.functions.running.previous_value`, which cuts every
partition into ranges of offsets, so a partition that holds most records is scanned by many tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.running import OFFSETS, previous_value
from ledgerlake.operators.expect import CheckFailed

STREAM = ["kafka_topic", "kafka_partition"]


def offset_gaps(records: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """kafka_topic, kafka_partition, first_missing, last_missing and missing, a row per range.

    ``bounds`` (kafka_topic, kafka_partition, first_offset, last_offset) says what the topic holds,
    so that records lost at its ends, or a partition lost as a whole, are found as well. Without it
    only ranges between records are. Repeated offsets are no gap; records without a position take
    no part. Topics that were compacted or written in transactions have gaps of their own.
    """
    positions = records.select(*STREAM, "kafka_offset").dropna()
    if bounds is not None:
        ends = F.array(F.col("first_offset") - 1, F.col("last_offset") + 1).cast("array<bigint>")
        positions = positions.unionByName(bounds.select(*STREAM, F.explode(ends).alias("kafka_offset")))
    ranges = [F.floor(F.col("kafka_offset") / size) for size in (OFFSETS * OFFSETS, OFFSETS)]
    positions = positions.select(F.struct(*STREAM).alias("stream"), "kafka_offset")
    order = (("kafka_offset", "asc"),)
    known = previous_value(positions, "stream", ranges, order, "kafka_offset", "before")
    return known.filter(F.col("kafka_offset") - F.col("before") > 1).select(
        "stream.*",
        (F.col("before") + 1).alias("first_missing"),
        (F.col("kafka_offset") - 1).alias("last_missing"),
        (F.col("kafka_offset") - F.col("before") - 1).alias("missing"),
    )


def require_offsets(records: DataFrame, bounds: DataFrame | None = None) -> None:
    """Refuse when offsets were lost, with the number of ranges and records."""
    found = offset_gaps(records, bounds).agg(F.count("*").alias("ranges"), F.sum("missing").alias("lost")).first()
    if found["ranges"]:
        raise CheckFailed(f"{found['lost']} offsets are missing in {found['ranges']} ranges")
