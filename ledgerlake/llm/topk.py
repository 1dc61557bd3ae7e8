"""Exact top-k search by inner product over M-trees.

Vectors are whole numbers. With ``R`` the largest squared norm of all rows, a row x stands in a
metric space as ``(x, sqrt(R - |x|^2))`` and a query q as ``(q, 0)``: their squared distance is
``R + |q|^2 - 2 <x, q>``, so the nearest rows have the largest inner products.

Rows go to the nearest of at most ``PIVOTS`` pivots and, split evenly, to shards of about
``SHARD_ROWS`` rows, however many equal vectors there are. In its task a shard is loaded into an
M-tree: leaf pages of up to ``PAGE`` rows around a routing vector, and inner nodes of up to
``FANOUT`` children, each with its covering radius and its distance to the parent's routing vector.
A query visits nodes best first. A node is left out, without computing its distance, where
``|d(q, parent) - d(node, parent)| - radius`` is already beyond the k-th best; rows of a page
likewise by their stored distance to its routing vector. Scores are exact integer products; bounds
are loosened by ``SLACK``, so rounding never drops a row and ties are kept.

Queries are a stated set. They meet the shards in blocks of ``QUERY_BLOCK``; first every query
searches one shard of its nearest pivot, then the others with the bound it has from there.

Defined cases: rows with a null id, a null vector or a null or non-finite component take no part,
nor do vectors whose squared norm leaves the range of a long, as no score could be stated for them;
only vectors of the length most rows have (ties: the longer) take part; of rows equal in id the
smallest vector counts; fewer candidates than k give all.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.sources.scratch import stored

K = 20
PIVOTS = 8
SHARD_ROWS = 16_384
PAGE, FANOUT = 256, 16
QUERY_BLOCK = 4096
SLACK = 1e-6
#: Squared norms stay below this, so that no product of two rows leaves 64 bits.
LARGEST = 2.0**61


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and ``v``, the components as floor(scale * x); only rows that take part."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    scaled = F.transform(parts, lambda x: F.floor(x * scale).cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    # the sum of squares bounds every product of two such rows
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.filter(squares < LARGEST).withColumn("v", F.transform("v", lambda x: x.cast("long")))
    usual = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("v") == (usual["width"] if usual else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


class Node:
    """A routing vector with its children: nodes, or the rows of a page."""

    __slots__ = ("center", "radius", "to_parent", "children", "rows", "row_distance")

    def __init__(self, center: np.ndarray, rows: np.ndarray):
        self.center, self.rows = center, rows
        self.radius, self.to_parent = 0.0, 0.0
        self.children: list[Node] = []
        self.row_distance = np.zeros(0)


class MTree:
    """An M-tree over the points of one shard, loaded in bulk."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.computed = 0
        self.root = self._load(np.arange(len(points)), points.mean(0)) if len(points) else None

    def _load(self, rows: np.ndarray, center: np.ndarray) -> Node:
        node = Node(center, rows)
        distance = np.sqrt(((self.points[rows] - center) ** 2).sum(1))
        node.radius = float(distance.max())
        if len(rows) <= PAGE:
            order = np.argsort(distance, kind="stable")
            node.rows, node.row_distance = rows[order], distance[order]
            return node
        # routing vectors far from each other; rows go to the nearest, in groups of bounded size
        chosen = [int(distance.argmax())]
        gap = np.full(len(rows), np.inf)
        for _ in range(min(FANOUT, -(-len(rows) // PAGE)) - 1):
            gap = np.minimum(gap, ((self.points[rows] - self.points[rows[chosen[-1]]]) ** 2).sum(1))
            chosen.append(int(gap.argmax()))
        centers = self.points[rows[chosen]]
        nearest = ((centers**2).sum(1)[None] - 2 * self.points[rows] @ centers.T).argmin(1)
        groups = [rows[nearest == g] for g in range(len(centers))]
        if max(map(len, groups)) > 0.9 * len(rows):  # (nearly) all alike: split by position
            groups = np.array_split(rows, len(centers))
        node.rows = rows[:0]
        for group in groups:
            if len(group):
                child = self._load(group, self.points[group].mean(0))
                child.to_parent = float(np.sqrt(((child.center - center) ** 2).sum()))
                node.children.append(child)
        return node

    def search(self, query: np.ndarray, score, ids: np.ndarray, own: int, k: int, floor: tuple[int, int] | None):
        """The k best (score, -id) of this tree, best first; none below ``floor`` if it is given."""
        limit = score.bound(floor[0]) if floor else np.inf
        best: list[tuple[int, int]] = []  # a heap, worst first
        distance = float(np.sqrt(((query - self.root.center) ** 2).sum()))
        queue = [(max(0.0, distance - self.root.radius), 0, distance, self.root)]
        pushed = 1
        while queue:
            bound, _, distance, node = heapq.heappop(queue)
            if bound > limit:
                break
            for child in node.children:
                if abs(distance - child.to_parent) - child.radius > limit:
                    continue
                away = float(np.sqrt(((query - child.center) ** 2).sum()))
                self.computed += 1
                if away - child.radius <= limit:
                    heapq.heappush(queue, (max(0.0, away - child.radius), pushed, away, child))
                    pushed += 1
            if len(node.rows):
                # rows are sorted by their stored distance, so those within reach are one stretch
                lo = np.searchsorted(node.row_distance, distance - limit, "left")
                hi = np.searchsorted(node.row_distance, distance + limit, "right")
                rows = node.rows[lo:hi]
                if not len(rows):
                    continue
                products = score.products(rows)
                self.computed += len(rows)
                other = ids[rows] != own
                rows, products = rows[other], products[other]
                least = max(best[0][0] if len(best) == k else -(2**62), floor[0] if floor else -(2**62))
                if len(rows) > k:
                    least = max(least, np.partition(products, len(rows) - k)[len(rows) - k])
                near = products >= least
                for product, vec_id in zip(products[near].tolist(), ids[rows[near]].tolist(), strict=True):
                    entry = (product, -vec_id)
                    if floor and entry < floor:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    limit = min(limit, score.bound(best[0][0]))
        return sorted(best, reverse=True)


class Score:
    """Exact products of one query with the rows of a shard, and the distance a product stands for.

    No partial sum of a product exceeds the largest squared norm, so doubles are exact below 2**53.
    """

    def __init__(self, query: np.ndarray, rows: np.ndarray, largest: int):
        kind = np.float64 if largest < 2**53 else np.int64
        self.query, self.rows = query.astype(kind), rows.astype(kind, copy=False)
        self.base = float(largest + int((query * query).sum()))

    def products(self, which: np.ndarray) -> np.ndarray:
        return (self.rows[which] @ self.query).astype(np.int64)

    def bound(self, product: int) -> float:
        return float(np.sqrt(max(0.0, self.base - 2.0 * product))) * (1 + SLACK) + SLACK


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def away(rows: DataFrame, pivots: list[list[int]], largest: int, as_query: bool) -> DataFrame:
    """Rows with ``away``, their distances to the pivots, as rows of the metric space or as queries."""
    table = np.array(pivots, np.float64)
    table = np.concatenate((table, np.sqrt(np.maximum(0, largest - (table**2).sum(1)))[:, None]), 1)

    @F.pandas_udf("array<double>")
    def distances(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            if not len(v):
                yield pd.Series([], dtype="object")
                continue
            x = _matrix(v).astype(np.float64)
            last = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0, largest - (x**2).sum(1)))
            x = np.concatenate((x, last[:, None]), 1)
            squared = (x**2).sum(1)[:, None] + (table**2).sum(1)[None] - 2 * x @ table.T
            yield pd.Series(list(np.sqrt(np.maximum(0, squared))))

    return rows.withColumn("away", distances("v"))


def top_k(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of every row for which ``queries`` holds."""
    rows = stored(whole_vectors(vectors), "search-rows")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    largest = rows.agg(F.max(norm)).first()[0] or 0
    pivots = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]  # bounded
    if not pivots:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    least = F.array_min("away")
    placed = away(rows, pivots, largest, False).select(
        "vec_id", "v", (F.array_position("away", least) - 1).cast("int").alias("pivot"), least.alias("reach")
    )
    placed = stored(placed, "search-placed")
    # one row per pivot: its covering radius and its shards
    tops = {
        r["pivot"]: (r["radius"], -(-r["n"] // SHARD_ROWS))
        for r in placed.groupBy("pivot").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).collect()
    }
    shards = F.create_map(*[F.lit(x) for p, (_, n) in tops.items() for x in (p, n)])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), shards[F.col("pivot")]).cast("int")).drop("reach")
    asked = placed.filter(queries).withColumnsRenamed({"pivot": "own_pivot", "part": "own_part"})
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(n_blocks)).cast("int").alias("block")
    asked = away(asked, pivots, largest, True)
    asked = stored(asked.select("vec_id", "v", "away", "own_pivot", "own_part", block, norm.alias("norm")), "search-asked")
    asked = asked.withColumnsRenamed({"vec_id": "query_id", "v": "q"})
    searched = _search(k, largest)

    def search(visits: DataFrame) -> DataFrame:
        """Queries with the shards they visit; only shards that a block visits are sent to it."""
        met = stored(visits.select("pivot", "part", "block").distinct(), "search-met")
        sides = (visits, placed.join(met, ["pivot", "part"]))
        left, right = (side.groupBy("pivot", "part", "block") for side in sides)
        return left.cogroup(right).applyInPandas(searched, "query_id long, vec_id long, score long")

    # 1. one shard of the nearest pivot: a first bound for every query
    unbounded = {"floor_score": F.lit(None).cast("long"), "floor_id": F.lit(None).cast("long")}
    nearest = asked.withColumnsRenamed({"own_pivot": "pivot", "own_part": "part"}).withColumns(unbounded)
    found = stored(search(nearest.drop("away", "norm")), "search-first")
    worst = F.min(F.struct("score", (-F.col("vec_id")).alias("neg")))
    bounds = found.groupBy("query_id").agg(F.count("*").alias("n"), worst.alias("w")).filter(F.col("n") >= k)
    bounds = bounds.select("query_id", F.col("w.score").alias("floor_score"), F.col("w.neg").alias("floor_id"))

    # 2. all other shards that the bound and the pivots' covering radii leave
    every = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("pivot"), F.lit(radius).alias("radius"), F.lit(n).alias("shards"))
                for p, (radius, n) in tops.items()
            ]
        )
    )
    limit = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(largest)) + F.col("norm") - F.col("floor_score") * 2.0))
    near = F.get("away", F.col("to.pivot")) - F.col("to.radius") <= limit * (1 + SLACK) + SLACK
    others = asked.join(bounds, "query_id", "left").withColumn("to", every)
    others = others.filter(F.col("floor_score").isNull() | near)
    others = others.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("to.shards") - 1)))
    others = others.filter((F.col("to.pivot") != F.col("own_pivot")) | (F.col("part") != F.col("own_part")))
    others = others.select("query_id", "q", "block", "to.pivot", "part", "floor_score", "floor_id")
    everything = found.unionByName(search(others))
    # at most k rows per query and shard meet here
    listed = F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("neg"))), asc=False)
    ranked = everything.groupBy("query_id").agg(F.slice(listed, 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        (-F.col("hit.neg")).alias("vec_id"),
        F.col("hit.score").alias("score"),
    )


def _search(k: int, largest: int):
    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(asked) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, v = rows["vec_id"].to_numpy(), _matrix(rows["v"])
            points = v.astype(np.float64)
            points = np.concatenate((points, np.sqrt(np.maximum(0, largest - (points**2).sum(1)))[:, None]), 1)
            tree = MTree(points)
            v = v.astype(np.float64) if largest < 2**53 else v
            floors = asked["floor_score"].isna().to_numpy()
            for at, (query_id, q) in enumerate(zip(asked["query_id"].tolist(), asked["q"], strict=True)):
                q = np.asarray(q, np.int64)
                floor = None if floors[at] else (int(asked["floor_score"].iat[at]), int(asked["floor_id"].iat[at]))
                point = np.append(q.astype(np.float64), 0.0)
                score = Score(q, v, largest)
                found = tree.search(point, score, ids, query_id, k, floor)
                out += [(query_id, -neg, product) for product, neg in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return search
