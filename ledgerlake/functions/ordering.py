"""The total orders of the data model and the top-1-per-key operators built on them.

Business time always comes first; the record position only breaks ties and is never
read as business order across partitions.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.schemas import POSITION

Order = Sequence[tuple[str, str]]

EARLIEST_DELIVERY: Order = (("bronze_ingested_at", "asc"), *((c, "asc") for c in POSITION))
CREATION: Order = (("event_time", "asc"), *EARLIEST_DELIVERY)
# A full time tie goes to the lowest position.
LATEST_STATE: Order = (
    ("event_time", "desc"),
    ("bronze_ingested_at", "desc"),
    *((c, "asc") for c in POSITION),
)
DQ_LATEST: Order = (("bronze_ingested_at", "desc"), *((c, "desc") for c in POSITION))

_LAST = 2**63 - 1


def sort_columns(order: Order) -> list[Column]:
    """Window/sort form of an order, null placement spelled out."""
    return [
        F.col(c).asc_nulls_first() if way == "asc" else F.col(c).desc_nulls_last()
        for c, way in order
    ]


def leading(order: Order, carried: Sequence[str | Column], where: Column | None = None) -> Column:
    """Aggregate returning a struct of the first row of a group under ``order``.

    ``min``/``max`` over a struct compares field by field with NULL lowest, and combines
    map-side: a key that owns a third of the input still sends one row per task. The
    carried columns are under ``.row`` of the result; ``where`` limits the candidates.
    """
    ways = {way for _, way in order}
    if ways == {"desc"}:
        pick, rank = F.max, [F.col(c).alias(f"_{i}") for i, (c, _) in enumerate(order)]
    else:
        # descending members of a mixed order are timestamps: negate, NULL last
        pick, rank = F.min, [
            (F.col(c) if way == "asc" else F.coalesce(-F.unix_micros(c), F.lit(_LAST))).alias(f"_{i}")
            for i, (c, way) in enumerate(order)
        ]
    row = F.struct(*rank, F.struct(*carried).alias("row"))
    return pick(row if where is None else F.when(where, row))


def first_per_key(df: DataFrame, key: str, order: Order) -> DataFrame:
    """One whole row per key, the first under ``order``; a single shuffle on the key."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(leading(order, rest).alias("_first"))
        .select(*(F.col(c) if c == key else F.col(f"_first.row.{c}") for c in df.columns))
    )
