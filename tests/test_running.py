"""Bucketed scans against plain loops, with one key that owns most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.running import previous_value, running_sums

ORDER = (("t", "asc"), ("n", "asc"))


def mixed():
    """One key has two thirds of the rows; some orders are NULL."""
    rng = random.Random(7)
    return [
        (rng.choice(["hot", "hot", "hot", *"abcdef", None]), rng.choice([None, *range(40)]), n, rng.choice([None, 1, 2, 5]))
        for n in range(600)
    ]


def one_time():
    """A single order value: only the position tells rows apart."""
    return [("hot", 3, n, n % 5) for n in range(300)]


def buckets(width):
    return [F.floor(F.col("t") / width), F.struct("t", F.floor(F.col("n") / 16).alias("range"))]


def in_order(rows):
    low = lambda v: (v is not None, v or 0)
    return sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), low(r[1]), r[2]))


@pytest.mark.parametrize("made", [mixed, one_time])
@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("levels", [1, 2])
def test_running_sums(spark, made, width, levels):
    rows = made()
    df = spark.createDataFrame(rows, "k string, t long, n long, v long")
    got = running_sums(df, "k", buckets(width)[:levels], ORDER, {"s": F.col("v"), "c": F.lit(1)}, {"total": "s"})
    totals, state, expected = {}, {}, {}
    for k, _, _, v in rows:
        totals[k] = totals.get(k, 0) + (v or 0)
    for k, t, n, v in in_order(rows):
        s, c = state.get(k, (0, 0))
        state[k] = (s + (v or 0), c + 1)
        expected[n] = (k, t, v, *state[k], totals[k])
    assert {r.n: (r.k, r.t, r.v, r.s, r.c, r.total) for r in got.collect()} == expected


@pytest.mark.parametrize("made", [mixed, one_time])
@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("levels", [1, 2])
def test_previous_value(spark, made, width, levels):
    rows = made()
    df = spark.createDataFrame(rows, "k string, t long, n long, v long")
    got = previous_value(df, "k", buckets(width)[:levels], ORDER, "v", "before")
    last, expected = {}, {}
    for k, _, n, v in in_order(rows):
        expected[n] = (v, last.get(k))
        last[k] = v
    assert {r.n: (r.v, r.before) for r in got.collect()} == expected


def test_orders_that_are_null_come_first(spark):
    df = spark.createDataFrame([("a", None, 1, 10), ("a", 5, 2, 1), ("a", 9, 3, 1)], "k string, t long, n long, v long")
    got = running_sums(df, "k", buckets(1), ORDER, {"s": F.col("v")}).orderBy("n").collect()
    assert [r.s for r in got] == [10, 11, 12]
