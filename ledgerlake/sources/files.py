"""The data files of a table, from the columns that the reader hides in ``_metadata``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def data_files(rows: DataFrame, *columns: str) -> DataFrame:
    """file_path, file_size, modified_at, blocks and rows of every file with rows.

    ``columns``, such as the partition of a table, must have one value per file. No data column is
    read besides them: rows are counted from the blocks that the scan is cut into.
    """
    at = F.col("_metadata")
    parts = rows.select(
        at["file_path"].alias("file_path"),
        at["file_size"].alias("file_size"),
        at["file_modification_time"].alias("modified_at"),
        at["file_block_start"].alias("block"),
        *columns,
    )
    per_block = parts.groupBy("file_path", "block", *columns).agg(
        F.first("file_size").alias("file_size"), F.first("modified_at").alias("modified_at"), F.count("*").alias("rows")
    )
    return per_block.groupBy("file_path", *columns).agg(
        F.first("file_size").alias("file_size"),
        F.first("modified_at").alias("modified_at"),
        F.count("*").alias("blocks"),
        F.sum("rows").alias("rows"),
    )


def file_summary(rows: DataFrame, *columns: str) -> DataFrame:
    """files, bytes, smallest and largest file, blocks and rows, for all or per value of ``columns``."""
    return (
        data_files(rows, *columns)
        .groupBy(*columns)
        .agg(
            F.count("*").alias("files"),
            F.sum("file_size").alias("bytes"),
            F.min("file_size").alias("smallest"),
            F.max("file_size").alias("largest"),
            F.sum("blocks").alias("blocks"),
            F.sum("rows").alias("rows"),
        )
    )
