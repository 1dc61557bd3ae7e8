"""Rejected rows as a data-quality table, upserted by key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.keys import dq_key
from ledgerlake.functions.ordering import DQ_LATEST, first_per_key
from ledgerlake.operators.envelope import rejected
from ledgerlake.schemas import EVENT_DQ


def dq_rows(
    validated: DataFrame,
    stage: str,
    detected_at: Column | None = None,
    source_snapshot_id: int | None = None,
) -> DataFrame:
    """One row per rejected record, in the layout of the DQ table."""
    seen = F.current_timestamp() if detected_at is None else detected_at
    columns = {
        "dq_key": dq_key(),
        "validation_stage": F.lit(stage),
        "source_snapshot_id": F.lit(source_snapshot_id),
        "first_detected_at": seen,
        "last_detected_at": seen,
    }
    return rejected(validated).select(
        *(
            (columns[f.name] if f.name in columns else F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in EVENT_DQ
        )
    )


def latest_per_key(rows: DataFrame) -> DataFrame:
    """One row per ``dq_key``: the most recently ingested record."""
    return first_per_key(rows, "dq_key", DQ_LATEST)


def merge_upsert(
    target: DataFrame, source: DataFrame, key: str, preserve: Sequence[str] = ()
) -> DataFrame:
    """Target after an upsert: matched rows take the source except ``preserve``.

    ``source`` must hold one row per key. Target rows without a match are kept.
    """
    old, new = target.alias("old"), source.withColumn("_new", F.lit(True)).alias("new")
    arrived = F.col("new._new").isNotNull()

    def merged(name: str) -> Column:
        before, after = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name == key:
            return F.coalesce(before, after)
        if name in preserve:
            return F.when(F.col(f"old.{key}").isNotNull(), before).otherwise(after)
        return F.when(arrived, after).otherwise(before)

    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    return joined.select(*(merged(c).alias(c) for c in target.columns))


def merge_dq(target: DataFrame | None, rows: DataFrame) -> DataFrame:
    """DQ table after recording ``rows``; the first detection time of a key never moves."""
    latest = latest_per_key(rows)
    if target is None:
        return latest
    return merge_upsert(target, latest, "dq_key", preserve=["first_detected_at"])
