"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import negatives, queries

SF = "/root/testdata/sf0.001"


def plain(rows, is_anchor, k=5, low=80, high=100):
    """rows: (vec_id, label, whole vector)"""
    out = set()
    by_id = {i: (label, np.array(v, object)) for i, label, v in rows}
    for a, (label, q) in by_id.items():
        if not is_anchor(a):
            continue
        score = {i: int((q * v).sum()) for i, (_, v) in by_id.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if by_id[i][0] == label][:k]:
            fits = [
                i for i in order if by_id[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]
            ]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits[:k])}
    return out


def found(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_embeddings(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], label, [math.floor(256 * x) for x in r["embedding"]]))
    assert found(queries.op11_hard_negatives(spark, SF)) == plain(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("cells,group", [(2**20, 4096), (0, 3)])
def test_ties_copies_and_odd_rows(spark, monkeypatch, cells, group):
    monkeypatch.setattr(negatives, "CELLS", cells)
    monkeypatch.setattr(negatives, "ANCHORS", group)
    monkeypatch.setattr(negatives, "STEP", 2)
    rng = random.Random(3)
    base = [[rng.randint(-3, 5) / 256 for _ in range(7)] for _ in range(12)]
    rows = [(k, rng.choice((0, 1, 1, 1, 9)), rng.choice(base)) for k in range(700)]
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    odd = [
        (None, 1, base[0]),
        (1000, None, base[0]),
        (1001, 1, None),
        (1002, 1, [None] * 7),
        (1003, 1, [float("nan")] * 7),
        (1004, 1, [float("inf")] * 7),
        (1005, 1, base[0][:3]),
        (1006, 1, []),
        (1007, 1, [1e30] * 7),
        rows[10],
        rows[10],
    ]
    schema = "vec_id long, label int, embedding array<float>, part string, group string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], schema).repartition(3)
    got = found(negatives.hard_negatives(df, F.col("vec_id") % 50 == 0))
    assert got == plain(kept, lambda i: i % 50 == 0)


def test_large_components_and_other_windows(spark):
    rng = random.Random(4)
    rows = [(k, k % 3, [rng.uniform(-3e6, 3e6) for _ in range(5)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = negatives.hard_negatives(df, F.col("vec_id") < 20, 3, 3, (10, 90))
    assert found(out) == plain(kept, lambda i: i < 20, 3, 10, 90)


def test_bounds_spare_columns():
    """Rows far from the anchor leave the bitmap before their columns are read."""
    import pandas as pd

    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (2000, 64))
    v[:20, :8] += 100
    rows = pd.DataFrame({"part": 0, "vec_id": range(2000), "label": 1, "v": list(v)})
    block = negatives.Block(negatives.pack(rows).iloc[0])
    scan = negatives.Scan(block, v[0], np.ones(2000, bool))
    for least, most in scan.steps():
        scan.keep(most >= negatives._kth(least, 5))
    assert scan.read < 0.25 * v.size


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([(100, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert found(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)) == set()
    assert found(negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0)) == set()
