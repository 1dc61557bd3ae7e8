"""Keys of the data-quality table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.rules import blank
from ledgerlake.schemas import DQ_EVENT, DQ_POSITION, DQ_UNKNOWN, POSITION


def dq_key() -> Column:
    """``event:<id>``, or the record position when there is no usable event id."""
    position = F.concat_ws(
        ":",
        F.lit(DQ_POSITION),
        *(F.coalesce(F.col(c).cast("string"), F.lit(DQ_UNKNOWN)) for c in POSITION),
    )
    return F.when(blank("event_id"), position).otherwise(F.concat(F.lit(f"{DQ_EVENT}:"), "event_id"))
