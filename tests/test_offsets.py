import random

import pytest

from ledgerlake.functions import running
from ledgerlake.operators import offsets
from ledgerlake.operators.expect import CheckFailed

POSITIONS = "kafka_topic string, kafka_partition int, kafka_offset bigint"


def gaps(df, bounds=None):
    return {tuple(r) for r in offsets.offset_gaps(df, bounds).collect()}


def plain(rows):
    kept = {}
    for topic, partition, offset in rows:
        kept.setdefault((topic, partition), set()).add(offset)
    out = set()
    for stream, known in kept.items():
        line = sorted(known)
        out |= {(*stream, a + 1, b - 1, b - a - 1) for a, b in zip(line, line[1:]) if b - a > 1}
    return out


@pytest.mark.parametrize("size", [3, 65_536])
def test_ranges_of_all_sizes(spark, monkeypatch, size):
    """Gaps inside and across the ranges that cut a partition, one partition hot, offsets repeated."""
    monkeypatch.setattr(offsets, "OFFSETS", size)
    rng = random.Random(size)
    rows = [("t", 0, o) for o in range(400) if rng.random() < 0.6] + [("t", 1, 5), ("t", 1, 5), ("u", 0, 10**12), ("u", 0, 7)]
    df = spark.createDataFrame(rows + [("t", 0, None), (None, 0, 3)], POSITIONS).repartition(3)
    assert gaps(df) == plain(rows)


def test_ends_and_lost_partitions_come_from_the_bounds(spark):
    df = spark.createDataFrame([("t", 0, 4), ("t", 0, 5)], POSITIONS)
    bounds = spark.createDataFrame([("t", 0, 2, 9), ("t", 1, 0, 3)], "kafka_topic string, kafka_partition int, first_offset bigint, last_offset bigint")
    assert gaps(df) == set()
    assert gaps(df, bounds) == {("t", 0, 2, 3, 2), ("t", 0, 6, 9, 4), ("t", 1, 0, 3, 4)}
    with pytest.raises(CheckFailed, match="10 offsets are missing in 3 ranges"):
        offsets.require_offsets(df, bounds)
    offsets.require_offsets(df)
    assert running.OFFSETS == 65_536
