"""Rows whose key may occur more than once, told apart from the rest without moving the rows.

Keys are counted as 64-bit hashes, so only hashes are shuffled. A hash that occurs once belongs to a
key that occurs once; hashes that meet by chance only send a few more rows to whoever settles
repeated keys. The rows are read twice: they should be stored, or cheap to make again.

Up to ``MANY`` repeated hashes are sent to all tasks as they are, more of them as bitmaps: a hash
takes one of ``SPARSE`` times as many places, up to ``PLACES``, and rows that share a place with a
repeated hash count as repeated. So the rows to be moved grow with the repeated ones, and what is
sent stays below 128 MB.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.sources.scratch import stored

_HASH, _MAP = "_hash", "_map"
#: Hashes that are sent to all tasks one by one.
MANY = 2_000_000
#: Places of a bitmap for each repeated hash, and at most.
SPARSE, PLACES = 64, 2**30


def parted(rows: DataFrame, *keys: str | Column, many: int = MANY) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows whose keys occur once, and all others; None for a side that needs no reading."""
    hashed = F.xxhash64(*keys)
    counted = rows.groupBy(hashed.alias(_HASH)).agg(F.count("*").alias("n"))
    repeated = stored(counted.filter("n > 1").select(_HASH), "repeats")
    found = repeated.count()
    if not found:
        return rows, None
    if found > many:
        return _parted_by_bitmap(rows, hashed, repeated, found)
    keyed = rows.withColumn(_HASH, hashed)
    once, again = (keyed.join(F.broadcast(repeated), _HASH, way).drop(_HASH) for way in ("left_anti", "left_semi"))
    return once, again


def _parted_by_bitmap(
    rows: DataFrame, hashed: Column, repeated: DataFrame, found: int
) -> tuple[DataFrame, DataFrame]:
    places = min(PLACES, 1 << (found * SPARSE - 1).bit_length())
    place = F.pmod(F.col(_HASH), F.lit(places)) + 1  # the functions count places from 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = repeated.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias(_MAP))
    placed = rows.withColumn(_HASH, hashed).select(*rows.columns, bucket.alias("_bucket"), bit.alias("_bit"))
    met = placed.join(F.broadcast(maps), "_bucket", "left")
    eight = F.conv(F.hex(F.substring(_MAP, F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    marked = F.coalesce(F.getbit(eight.cast("int"), (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return met.filter(~marked).select(*rows.columns), met.filter(marked).select(*rows.columns)
