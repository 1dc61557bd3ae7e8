"""Bronze: raw records kept byte for byte, plus a text view and the ingest time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.schemas import BRONZE

# Bronze column -> record column (fixed names)
_FROM_RECORD = {
    "kafka_value": "value",
    "kafka_key": "key",
    "kafka_topic": "topic",
    "kafka_partition": "partition",
    "kafka_offset": "offset",
    "kafka_timestamp": "timestamp",
    "kafka_timestamp_type": "timestampType",
    "kafka_headers": "headers",
}


def bronze_rows(records: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Records to Bronze rows; nothing is filtered or deduplicated."""
    columns = {name: F.col(source) for name, source in _FROM_RECORD.items()}
    columns["payload"] = F.col("value").cast("string")
    columns["bronze_ingested_at"] = F.current_timestamp() if ingested_at is None else ingested_at
    return records.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in BRONZE))


def copy_table(rows: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Full copy of an operational table with its ingest time."""
    return rows.withColumn(
        "bronze_ingested_at", F.current_timestamp() if ingested_at is None else ingested_at
    )
