"""Small ordered reports over any table: counts per key, reject reasons, orphans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key combination, ordered by the keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def reject_reasons(validated: DataFrame) -> DataFrame:
    """Rejected rows per error code, most frequent first."""
    return (
        validated.filter(F.col("validation_error").isNotNull())
        .groupBy("validation_error")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "validation_error")
    )


def orphan_share(current: DataFrame) -> DataFrame:
    """One row: keys in a current-state table and how many lack their opening event."""
    return current.agg(
        F.count("*").alias("keys"),
        F.count_if("is_orphan").alias("orphans"),
    )
