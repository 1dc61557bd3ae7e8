"""Topic to Bronze by batches: rows spread over files by day and salt, each batch stored once.

A batch is a folder of its own, named by its number and replaced as a whole. A batch that the
stream repeats after a failure therefore never adds a row twice, even when its rows fall on another
ingest day than before. The number is a column of the table, so Bronze as of a batch is read by
pruning folders, without comparing clocks.

Within a batch, rows go by ingest day and a salt from their position to at most ``files_per_day``
tasks a day, so one day is written by several tasks and leaves a bounded number of files;
``rows_per_file`` bounds their size.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.bronze import bronze_rows
from ledgerlake.schemas import POSITION
from ledgerlake.sources.versions import exists, folders
from ledgerlake.streaming.ingest import INGEST_DATE, STORED, guard_checkpoint

INGEST_BATCH = "ingest_batch"
SCHEMA = T.StructType([*STORED, T.StructField(INGEST_BATCH, T.LongType())])


def store_batch(
    records: DataFrame,
    batch: int,
    target: str,
    files_per_day: int,
    rows_per_file: int = 0,
    ingested_at: Column | None = None,
) -> None:
    """Write the records of a batch in place of whatever it wrote before."""
    day = F.to_date("bronze_ingested_at")
    salt = F.pmod(F.xxhash64(*POSITION), F.lit(files_per_day))
    rows = bronze_rows(records, ingested_at).withColumn(INGEST_DATE, day).repartition(INGEST_DATE, salt)
    writer = rows.write.mode("overwrite").partitionBy(INGEST_DATE).option("maxRecordsPerFile", rows_per_file)
    writer.parquet(f"{target}/{INGEST_BATCH}={batch}")


def start(
    records: DataFrame,
    target: str,
    checkpoint: str,
    files_per_day: int = 4,
    rows_per_file: int = 0,
    available_now: bool = True,
    interval: str = "1 minute",
    ingested_at: Column | None = None,
) -> StreamingQuery:
    """Append the records of a stream to Bronze, batch by batch."""
    guard_checkpoint(records.sparkSession, target, checkpoint)

    def store(rows: DataFrame, batch: int) -> None:
        store_batch(rows, batch, target, files_per_day, rows_per_file, ingested_at)

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    writer = records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def committed_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """The last batch that the stream has finished; a later one may still be under way."""
    if not exists(spark, f"{checkpoint}/commits"):
        return None
    return max((int(n) for n in folders(spark, f"{checkpoint}/commits") if n.isdigit()), default=None)


def read_batches(spark: SparkSession, target: str, until: int) -> DataFrame:
    """Bronze as it was after batch ``until``; folders of later batches are pruned."""
    rows = spark.read.schema(SCHEMA).parquet(target)
    return rows.filter(F.col(INGEST_BATCH) <= until)
