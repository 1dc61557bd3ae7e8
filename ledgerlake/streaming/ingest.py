"""Topic to Bronze as a streaming append with a durable checkpoint."""

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.bronze import bronze_rows
from ledgerlake.operators.expect import CheckFailed
from ledgerlake.schemas import BRONZE
from ledgerlake.sources.packing import PACKED, lean
from ledgerlake.sources.versions import exists
from ledgerlake.streaming.progress import ProgressLog

INGEST_DATE = "ingest_date"
STORED = T.StructType([*BRONZE, T.StructField(INGEST_DATE, T.DateType())])


def guard_checkpoint(spark: SparkSession, target: str, checkpoint: str) -> None:
    """A kept checkpoint must not write into a table that has been lost or recreated empty."""
    if exists(spark, f"{checkpoint}/metadata") and not exists(spark, target):
        raise CheckFailed(f"checkpoint {checkpoint} exists but {target} is missing; restore both")


def start(
    records: DataFrame,
    target: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "1 minute",
    ingested_at: Column | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Append the records of a stream to Bronze, partitioned by ingest day.

    ``available_now`` processes what exists at start and stops; otherwise a micro-batch
    runs every ``interval``. A rerun on the same checkpoint adds nothing twice.
    """
    guard_checkpoint(records.sparkSession, target, checkpoint)
    rows = bronze_rows(records, ingested_at).withColumn(
        INGEST_DATE, F.to_date("bronze_ingested_at")
    )
    writer = (
        rows.writeStream.format("parquet")
        .partitionBy(INGEST_DATE)
        .outputMode("append")
        .options(**PACKED)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )
    if name is not None:
        writer = writer.queryName(name)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def ingest_available(
    records: DataFrame, target: str, checkpoint: str, log: ProgressLog | None = None, **options
) -> dict | None:
    """Bounded catch-up run; returns the last progress report, None when nothing was new.

    With a ``log`` it returns only when every batch of the run is a row of it.
    """
    with lean(records.sparkSession):
        query = start(records, target, checkpoint, available_now=True, **options)
        query.awaitTermination()
    if log is not None:
        log.wait(query.runId)
    return query.lastProgress


def read_bronze(
    spark: SparkSession,
    target: str,
    since: date | None = None,
    until: date | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Bronze rows of the committed batches; ingest days outside the range are not listed.

    ``as_of`` reads Bronze as it was at an ingest time: a batch gets one time for all its rows,
    so the largest time of an earlier read gives exactly the batches that it saw.
    """
    rows = spark.read.schema(STORED).parquet(target)
    if since is not None:
        rows = rows.filter(F.col(INGEST_DATE) >= since)
    if until is not None:
        rows = rows.filter(F.col(INGEST_DATE) <= until)
    if as_of is not None:
        at = F.lit(as_of)
        rows = rows.filter((F.col(INGEST_DATE) <= F.to_date(at)) & (F.col("bronze_ingested_at") <= at))
    return rows
