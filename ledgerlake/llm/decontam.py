"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item's MinHash coordinate is the shingle of the item with the smallest hash under that
coordinate's function, so it lies in a document with a chance equal to the item's containment in
it, however long the document is. Items are partitioned by their number of shingles: those of at
most ``COORDINATES`` shingles use all of them, larger ones ``COORDINATES`` coordinates. A document
that holds ``LEAST_HITS`` coordinates of an item (small items: the full share of their shingles) is
a candidate; at a containment of 0.75 a large item is missed with a chance of about 1e-8. Candidate
pairs are then verified: distinct shingles of the item found in the document, by their words.

Only DataFrame functions are used. Documents are scanned once for hits and only candidates are
joined to their texts. The probes are sent to every task only while their counted number is small.

Defined cases: words are folded A-Z; an item of fewer than five words is one shingle of them all,
which a document holds anywhere; empty and null texts match nothing; every different text of an item
is searched on its own, whatever ids it shares, and the one held most is reported under the item's
id; equal doc ids are one document with the shingles of all its rows; null ids match like any other;
a document may hold several items.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.words import SHINGLE, fold, free_name, word_array
from ledgerlake.sources.scratch import stored

CONTAINED = 0.75
COORDINATES = 16
LEAST_HITS = 2
#: Tables of at most this many narrow rows, or shingles in all rows, are sent to every task.
SENT_ROWS = 100_000


def _sent(df: DataFrame, weight: str | None = None) -> DataFrame:
    """``df``, marked to be sent if its rows (or the sum of ``weight``) are few; they are counted."""
    if weight is None:
        size = df.limit(SENT_ROWS + 1).count()
    else:
        size = df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= SENT_ROWS else df


def _run(at: Column, size: int) -> Column:
    """The ``size`` words from place ``at`` on, as one text."""
    return F.concat_ws(" ", *[F.element_at("words", at.cast("int") + k) for k in range(size)])


def shingle_rows(texts: DataFrame, key: str, size: int = SHINGLE, whole: bool = False) -> DataFrame:
    """``key``, ``size`` words as text and their 64-bit hash, one row per shingle; ``whole``: of texts of that size."""
    words = texts.select(key, word_array(fold(F.col("text"))).alias("words"))
    words = words.filter(F.size("words") == size if whole else F.size("words") >= size)
    at = words.select(key, "words", F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    run = [F.element_at("words", F.col("at") + k) for k in range(size)]
    return at.select(key, _run(F.col("at"), size).alias("shingle"), F.xxhash64(*run).alias("hash"))


def item_texts(benchmark: DataFrame) -> DataFrame:
    """``_item``, item_id and text of every different row, written once so that the numbers stay."""
    rows = benchmark.select("item_id", "text").distinct()
    return stored(rows.withColumn("_item", F.monotonically_increasing_id()), "leak-texts")


def item_shingles(texts: DataFrame) -> DataFrame:
    """_item, its distinct shingles as text, their hashes, their number, and the words of one."""
    rows = shingle_rows(texts, "_item").withColumn("size", F.lit(SHINGLE))
    for size in range(1, SHINGLE):
        rows = rows.unionByName(shingle_rows(texts, "_item", size, whole=True).withColumn("size", F.lit(size)))
    return rows.distinct().groupBy("_item").agg(
        F.count("*").alias("n"),
        F.max("size").alias("size"),
        F.collect_list(F.struct("hash", "shingle")).alias("shingles"),
    )


def sizes_of(items: DataFrame) -> list[int]:
    """The words of a shingle that items have, at most ``SHINGLE`` numbers."""
    return sorted(r["size"] for r in items.select("size").distinct().collect())


def probes(items: DataFrame) -> DataFrame:
    """_item, shingle hash, number of its coordinates that hash stands for, and the hits asked for.

    An item's shingles are at most those of one text, so they are compared within its row.
    """

    def coordinate(k: int) -> Column:
        ranked = F.transform("shingles", lambda s: F.struct(F.xxhash64(F.lit(k), s["shingle"]), s["hash"]))
        return F.array_min(ranked)["hash"]

    all_of = F.transform("shingles", lambda s: s["hash"])
    few = F.col("n") <= COORDINATES
    chosen = F.when(few, all_of).otherwise(F.array(*[coordinate(k) for k in range(COORDINATES)]))
    asked = F.when(few, F.ceil(F.col("n") * CONTAINED)).otherwise(F.lit(LEAST_HITS))
    return (
        items.select("_item", asked.alias("asked"), F.explode(chosen).alias("hash"))
        .groupBy("_item", "hash")
        .agg(F.count("*").alias("weight"), F.max("asked").alias("asked"))
    )


def candidates(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of doc_id and _item with enough hits. A hit counts once however often it occurs."""
    rows = [shingle_rows(documents, "doc_id", size).select("doc_id", "hash") for size in sizes_of(items) or [SHINGLE]]
    found = reduce(DataFrame.unionByName, rows)
    hits = found.join(_sent(probes(items)), "hash").groupBy("doc_id", "_item", "hash")
    return (
        hits.agg(F.max("weight").alias("weight"), F.max("asked").alias("asked"))
        .groupBy("doc_id", "_item")
        .agg(F.sum("weight").alias("hits"), F.max("asked").alias("asked"))
        .filter(F.col("hits") >= F.col("asked"))
        .select("doc_id", "_item")
    )


def leaks(documents: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, shared and item shingles and containment of every verified pair."""
    named = item_texts(benchmark)
    items = stored(item_shingles(named), "leak-items")
    pairs = stored(candidates(documents, items), "leak-pairs")
    wanted = pairs.select(F.col("doc_id").alias("id")).distinct()
    texts = documents.select("doc_id", "text").join(
        _sent(wanted), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"
    )
    sizes = sizes_of(items) or [SHINGLE]
    words = texts.select("doc_id", word_array(fold(F.col("text"))).alias("words")).filter(F.size("words") >= sizes[0])

    def runs(size: int) -> Column:
        # the bound is there for texts that are too short, whose runs are not taken
        last = F.greatest(F.size("words") - size + 1, F.lit(1))
        found = F.transform(F.sequence(F.lit(1), last), lambda at: _run(at, size))
        return F.when(F.size("words") >= size, found).otherwise(F.array().cast("array<string>"))

    own = words.select("doc_id", F.concat(*[runs(size) for size in sizes]).alias("runs"))
    with_items = pairs.withColumnRenamed("doc_id", "id").join(_sent(items, "n"), "_item").select(
        "id", "_item", "n", F.transform("shingles", lambda s: s["shingle"]).alias("asked")
    )
    met = own.join(with_items, F.col("doc_id").eqNullSafe(F.col("id"))).select(
        "doc_id", "_item", "n", F.explode(F.array_intersect("asked", "runs")).alias("met")
    )
    # rows of one doc_id count together, each shingle once; equal ones combine in their tasks
    per_text = met.distinct().groupBy("doc_id", "_item", "n").agg(F.count("*").alias("shared"))
    share = (F.col("shared") / F.col("n")).alias("containment")
    held = per_text.select("doc_id", "_item", "shared", F.col("n").cast("long").alias("item_shingles"), share)
    held = held.filter(F.col("containment") >= contained).join(named.select("_item", "item_id"), "_item")
    # of several texts of an item, the one that is held most
    best = F.max(F.struct("containment", "shared", "item_shingles")).alias("best")
    return held.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.shared", "best.item_shingles", "best.containment"
    )


def remove_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were.

    Every row is judged by its own text, whatever its doc_id: texts are named by their 64-bit hash.
    """
    name, leaking = (free_name(c, documents) for c in ("_text_hash", "_leaking"))
    texts = documents.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = stored(leaks(texts, benchmark).select(F.col("doc_id").alias(leaking)).distinct(), "leak-documents")
    rows = documents.withColumn(name, F.xxhash64("text"))
    return rows.join(_sent(bad), F.col(name) == F.col(leaking), "left_anti").drop(name)
