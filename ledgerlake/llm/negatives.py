"""Hard negatives by a vertical scan: columns read in each anchor's order, candidates dropped by bounds.

Rows are packed into blocks of columns: one array per dimension, with its least and largest value.
An anchor meets a block with a bitmap of the rows that may count for it, reads the columns in
falling order of its own components' magnitude and adds up partial scores. What the unread columns
can still add lies between two sums, taken from their least and largest values; after every
``STEP`` columns, rows leave the bitmap whose bounds exclude them:

* positives (rows of the anchor's label): below the k-th best lower bound;
* negatives (rows of other labels): outside every window that the positives' scores open, or below
  the k-th best lower bound among rows that are certain to lie in it.

Rows that stay to the last column have exact scores, and the windows take theirs from these. Scores
are whole numbers throughout, so bounds never drop a tie.

Anchors are a stated set of rows. They meet blocks of at most ``CELLS`` numbers in blocks of
``ANCHORS``, so a task holds one of each, however many rows share a label or a vector. Every block
returns its best rows only, and those of an anchor, or of an anchor and a positive, are ranked
after a partial ranking in each task.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no
part, nor do vectors whose products could leave the range of a long; only vectors of the length
most rows have (ties: the longer) take part; of rows equal in id the smallest label, then vector,
counts; an anchor without another row of its label, and a positive without a row in its window,
have no result; fewer rows than asked for give all; extra columns are left out.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.sources.scratch import stored

POSITIVES, NEGATIVES = 5, 5
#: Share of a positive's score, in percent, that a negative's score must lie between.
LEAST, MOST = 80, 100
STEP = 8
#: Numbers in a block of rows, and anchors in a block of anchors.
CELLS, ANCHORS = 2**20, 4096
#: Width times the largest squared component is below this, so that no product leaves 64 bits.
LARGEST = 2**62
BLOCK = "part int, ids binary, labels binary, wide boolean, dims array<binary>, low array<long>, high array<long>"


def whole_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and ``v``, the components as floor(scale * x); only rows that take part."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.dropna(subset=["vec_id", "label", "embedding"]).filter(finite)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), scaled.alias("v"))
    largest = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    rows = rows.filter(largest * largest * F.size("v") < LARGEST)  # bounds every product and partial sum
    rows = rows.withColumn("v", F.transform("v", lambda x: x.cast("long")))
    usual = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.filter(F.size("v") == (usual["width"] if usual else 0))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")


def pack(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one block as columns."""
    rows = rows.sort_values("vec_id", kind="stable")
    v = np.stack(rows["v"].to_numpy()).astype(np.int64)
    low, high = v.min(0), v.max(0)
    wide = bool(max(-low.min(), high.max()) >= 2**31) if v.size else False
    columns = [np.ascontiguousarray(c).tobytes() for c in v.astype(np.int64 if wide else np.int32).T]
    ids, labels = (rows[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
    return pd.DataFrame(
        [(int(rows["part"].iat[0]), ids, labels, wide, columns, low.tolist(), high.tolist())],
        columns=["part", "ids", "labels", "wide", "dims", "low", "high"],
    )


class Block:
    """Columns of a block of rows; positions rise with ids."""

    def __init__(self, row: pd.Series):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.columns = [np.frombuffer(c, np.int64 if row["wide"] else np.int32) for c in row["dims"]]
        self.low, self.high = np.array(row["low"], np.int64), np.array(row["high"], np.int64)


class Scan:
    """One anchor's way through the columns of a block."""

    def __init__(self, block: Block, q: np.ndarray, bitmap: np.ndarray):
        self.block, self.q = block, q
        self.order = np.argsort(-np.abs(q), kind="stable")
        ends = np.sort(np.stack((q * block.low, q * block.high)), 0)[:, self.order]
        # what the columns from a step on can add, at least and at most
        self.least, self.most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in ends)
        self.rows = np.flatnonzero(bitmap)
        self.score = np.zeros(len(self.rows), np.int64)
        self.read = 0

    def steps(self):
        """Read ``STEP`` columns at a time; yields the bounds of every row still in the bitmap."""
        yield self.score + self.least[0], self.score + self.most[0]
        for at in range(0, len(self.order), STEP):
            if not len(self.rows):
                return
            everything = len(self.rows) == len(self.block.ids)
            for d in self.order[at : at + STEP].tolist():
                if self.q[d]:
                    column = self.block.columns[d]
                    self.score += (column if everything else column[self.rows]) * self.q[d]
                    self.read += len(self.rows)
            done = min(at + STEP, len(self.order))
            if done < len(self.order):
                yield self.score + self.least[done], self.score + self.most[done]

    def keep(self, which: np.ndarray) -> None:
        if not which.all():
            self.rows, self.score = self.rows[which], self.score[which]


def _kth(values: np.ndarray, k: int) -> int | None:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _best(scan: Scan, which: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest of these rows; ties to the smaller id."""
    at = np.flatnonzero(which)
    least = _kth(scan.score[at], k)
    if least is not None:
        at = at[scan.score[at] >= least]
    return at[np.argsort(-scan.score[at], kind="stable")][:k]


def positives_in(block: Block, own: int, label: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) of the anchor's label in a block."""
    scan = Scan(block, q, (block.labels == label) & (block.ids != own))
    for least, most in scan.steps():
        bound = _kth(least, k)
        if bound is not None:
            scan.keep(most >= bound)
    best = _best(scan, np.ones(len(scan.rows), bool), k)
    return list(zip(block.ids[scan.rows[best]].tolist(), scan.score[best].tolist(), strict=True))


def negatives_in(
    block: Block, label: int, q: np.ndarray, windows: Sequence[tuple[int, int]], k: int
) -> list[list[tuple[int, int]]]:
    """For every window of scores the k best (id, score) of other labels in a block."""
    scan = Scan(block, q, block.labels != label)
    for least, most in scan.steps():
        may = np.zeros(len(least), bool)
        for low, high in windows:
            bound = _kth(least[(least >= low) & (most <= high)], k)
            may |= (most >= (low if bound is None else max(low, bound))) & (least <= high)
        scan.keep(may)
    found = []
    for low, high in windows:
        best = _best(scan, (scan.score >= low) & (scan.score <= high), k)
        found.append(list(zip(block.ids[scan.rows[best]].tolist(), scan.score[best].tolist(), strict=True)))
    return found


def _find_positives(k: int):
    def find(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for _, row in blocks.iterrows():
            block = Block(row)
            for own, label, v in zip(asked["anchor_id"].tolist(), asked["label"].tolist(), asked["v"], strict=True):
                found = positives_in(block, own, label, np.asarray(v, np.int64), k)
                out += [(own, vec_id, score) for vec_id, score in found]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"], dtype="int64")

    return find


def _find_negatives(k: int, lowest: int, highest: int):
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def find(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int]] = []
        for _, row in blocks.iterrows():
            block = Block(row)
            columns = (asked["anchor_id"].tolist(), asked["label"].tolist(), asked["v"], asked["positives"])
            for own, label, v, positives in zip(*columns, strict=True):
                pairs = [(int(p["positive_id"]), int(p["positive_score"])) for p in positives]
                windows = [(-(-lowest * score // 100), highest * score // 100) for _, score in pairs]
                found = negatives_in(block, label, np.asarray(v, np.int64), windows, k)
                for pair, hits in zip(pairs, found, strict=True):
                    out += [(own, *pair, vec_id, score) for vec_id, score in hits]
        return pd.DataFrame(out, columns=names, dtype="int64")

    return find


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    window: tuple[int, int] = (LEAST, MOST),
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For every row for which ``anchors`` holds, its ``n_positives`` best rows of the same label, and
    for each of these the ``n_negatives`` best rows of other labels with a score inside ``window``,
    in percent of the positive's score.
    """
    rows = stored(whole_rows(vectors, scale), "negative-rows")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    per_block = max(256, CELLS // max(1, shape["width"] or 1))
    n_blocks = max(1, -(-shape["n"] // per_block))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("part")
    blocks = stored(rows.select("*", part).groupBy("part").applyInPandas(pack, BLOCK), "negative-blocks")

    asked = rows.filter(anchors).withColumnRenamed("vec_id", "anchor_id")
    n_groups = max(1, -(-asked.count() // ANCHORS))
    group = F.pmod(F.xxhash64(F.col("anchor_id"), F.lit(1)), F.lit(n_groups)).cast("int").alias("group")
    asked = stored(asked.select("*", group), "negative-anchors")

    def meet(anchors: DataFrame, find, schema: str) -> DataFrame:
        left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        right = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        sides = (side.groupBy("part", "group") for side in (left, right))
        return next(sides).cogroup(next(sides)).applyInPandas(find, schema)

    found = meet(asked, _find_positives(n_positives), "anchor_id long, positive_id long, positive_score long")
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= n_positives)
    pairs = F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")
    positives = stored(found.groupBy("anchor_id").agg(pairs), "negative-positives")

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = meet(asked.join(positives, "anchor_id"), _find_negatives(n_negatives, *window), schema)
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n_negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
