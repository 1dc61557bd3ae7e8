"""Mixing sources to target weights with a low-discrepancy schedule.

Every slot of the mix is one block of equally many words. Slot ``k`` stands at the golden-ratio
point ``frac(k * phi)``; the source whose share of the cumulative targets holds that point owns
the slot, so any stretch of the schedule is close to the targets. A source's documents are
shuffled by a keyed digest, laid end to end and cut into blocks; its r-th slot takes block
``r mod blocks`` of pass ``r div blocks``. Slots beyond a source's target are left out, the few it
lacks are appended, and the last block ends at the target, so that every source is met to the word.

Only DataFrame functions are used. No window sees more than one bucket of a source or one stretch
of the schedule: positions are counted per bucket first and carried by a running sum over buckets.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source
of its own, last in order; repeated doc ids are separate rows with equal shuffle keys and are laid
in an arbitrary but complete order; an empty table gives an empty mix.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.words import word_count
from ledgerlake.sources.scratch import stored

WEIGHTS = (5, 2, 1)
#: The mix holds this many halves of all words.
SHARE_HALVES = 3
#: No document is used more often than this.
PASSES = 2
SEED = "mix"
PHI = 0.6180339887498949
#: Words of one slot: at most this many, less where the mix has fewer slots than ``FINE``.
BLOCK = 512
FINE = 65_536
#: Rows of a source's shuffle bucket, on average, and slots of one stretch of the schedule.
BUCKET_ROWS = 1_000
STRETCH = 16_384


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """Where a document stands in its source's shuffled order; equal on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source and number of words of every document."""
    return documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: its size, weight and target (one row per source is all that meets here).

    Sources reach their cap of ``PASSES`` sizes in ascending order of cap by weight; those before
    the first that stays below its cap are capped, the others share the rest by weight. All terms
    are whole numbers until one last division, so the result does not depend on the order of sums.
    """
    one = F.lit(1)
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    cycle = F.array(*[F.lit(w) for w in weights])
    order = Window.partitionBy(one).orderBy(F.col("source").isNull(), "source")
    ranked = source.withColumn("place", F.row_number().over(order) - 1)
    weighed = ranked.withColumn("weight", F.get(cycle, F.col("place") % len(weights)).cast("long"))
    everything = Window.partitionBy(one)
    by_cap = Window.partitionBy(one).orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * PASSES)
        .withColumn(
            "open_weight",
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        )
        .withColumn("rest", F.col("total") * SHARE_HALVES - F.col("capped") * 2)
        # its share, were it and all later ones open, against its cap; both times 2 * open_weight
        .withColumn(
            "fits",
            F.col("weight") * F.col("rest") <= F.col("source_size") * PASSES * 2 * F.col("open_weight"),
        )
    )
    ratio = F.col("source_size") / F.col("weight")
    first_open = F.min(F.when(F.col("fits"), F.struct(ratio.alias("ratio"), "place", "rest", "open_weight")))
    level = filled.withColumn("level", first_open.over(everything))
    is_open = F.struct(ratio.alias("ratio"), "place") >= F.struct("level.ratio", "level.place")
    top, bottom = F.col("weight") * F.col("level.rest"), F.col("level.open_weight") * 2
    share = F.when(is_open, top / bottom.cast("double")).otherwise(F.col("source_size") * float(PASSES))
    words = F.when(is_open, F.floor((top - F.pmod(top, bottom)) / bottom)).otherwise(F.col("source_size") * PASSES)
    return level.select(
        "source",
        "source_size",
        "docs",
        "place",
        F.coalesce(share, F.lit(0.0)).alias("target"),
        F.coalesce(words, F.lit(0)).cast("long").alias("target_words"),
    )


def laid_out(sized: DataFrame, goals: DataFrame, seed: str = SEED) -> DataFrame:
    """Every document with the first word it has in its source's shuffled stream (``start``)."""
    keyed = (
        sized.join(F.broadcast(goals) if small(goals) else goals, sized.source.eqNullSafe(goals.source))
        .drop(goals.source)
        .withColumn("key", shuffle_key(F.col("doc_id"), seed))
        .withColumn(
            "bucket",
            F.floor(
                F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
                * F.ceil(F.col("docs") / BUCKET_ROWS)
                / F.lit(2**32)
            ),
        )
    )
    per_bucket = keyed.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        "place", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start")
    )
    inside = Window.partitionBy("place", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["place", "bucket"])
        .withColumn("start", F.col("bucket_start") + F.col("inside"))
        .drop("inside", "bucket_start", "bucket", "docs")
    )


def small(goals: DataFrame, bound: int = 10_000) -> bool:
    """Whether the sources are few enough to be sent to every task (their number is counted)."""
    return goals.limit(bound + 1).count() <= bound


def block_words(total: int) -> int:
    return max(1, min(BLOCK, total // FINE))


def schedule(goals: DataFrame) -> DataFrame:
    """The slots of the mix in order: slot, place of the source, rank among its slots, words to take.

    ``slot`` numbers the low-discrepancy sequence; a source's missing slots follow at the end.
    """
    spark = goals.sparkSession
    total = goals.agg(F.sum("target_words")).first()[0] or 0
    block = block_words(total)
    slots = -(-total // block)
    upto = Window.partitionBy(F.lit(1)).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = goals.filter("target_words > 0").select(
        "place",
        "target_words",
        (F.sum("target_words").over(upto) / F.lit(float(total or 1))).alias("upper"),
        ((F.sum("target_words").over(upto) - F.col("target_words")) / F.lit(float(total or 1))).alias("lower"),
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (F.col("id") * F.lit(PHI) - F.floor(F.col("id") * F.lit(PHI))).alias("point")
    )
    # the sources' intervals are cut at the edges of equal bins, so that points meet them by an equal key
    bins = 1024
    cut = bounds.withColumn(
        "bin",
        F.explode(
            F.sequence(
                F.floor(F.col("lower") * bins).cast("int"),
                F.least(F.floor(F.col("upper") * bins), F.lit(bins - 1)).cast("int"),
            )
        ),
    )
    owned = (
        points.withColumn("bin", F.floor(F.col("point") * bins).cast("int"))
        .join(F.broadcast(cut) if small(goals) else cut, "bin")
        .filter((F.col("point") >= F.col("lower")) & (F.col("point") < F.col("upper")))
        .select("slot", "place", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    )
    counts = owned.groupBy("place", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("place").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("place", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("place", "stretch").orderBy("slot")
    ranked = owned.withColumn("here", F.row_number().over(here) - 1).join(carried, ["place", "stretch"])
    ranked = ranked.select("slot", "place", (F.col("before") + F.col("here")).alias("rank"))
    had = counts.groupBy("place").agg(F.sum("n").alias("had"))
    whole = F.floor(F.col("target_words") / F.col("source_size"))
    needed = (
        whole * F.ceil(F.col("source_size") / block) + F.ceil(F.col("target_words") % F.col("source_size") / block)
    ).cast("long")
    missing = (
        goals.filter("target_words > 0")
        .join(had, "place", "left")
        .withColumn("had", F.coalesce("had", F.lit(0)))
        .filter(F.col("had") < needed)
        .select("place", F.explode(F.sequence("had", needed - 1)).alias("rank"))
        .select((F.col("rank") + slots).alias("slot"), "place", "rank")
    )
    goal = goals.select("place", "target_words", "source_size")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    end = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    everything = ranked.unionByName(missing).join(F.broadcast(goal) if small(goals) else goal, "place")
    return (
        everything.withColumn("pass", F.floor(F.col("rank") / blocks))
        .withColumn("block", F.col("rank") % blocks)
        .withColumn("done", F.col("pass") * F.col("source_size") + F.col("block") * block)
        .withColumn("words", F.least(end, F.col("target_words") - F.col("done")))
        .filter("words > 0")
        .select("slot", "place", "pass", "block", "words")
    )


def mix(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and the words the mix takes of each document."""
    sized = stored(sizes(documents), "mix-sizes")
    goals = stored(targets(sized), "mix-targets")
    laid = stored(laid_out(sized, goals, seed), "mix-layout")
    block = block_words(goals.agg(F.sum("target_words")).first()[0] or 0)
    # how far into each block its slots go; a block is met once or twice, so its group is tiny
    used = schedule(goals).groupBy("place", "block").agg(F.collect_list("words").alias("uses"))
    pieces = laid.filter("size > 0").select(
        "place",
        "doc_id",
        "key",
        "start",
        "size",
        F.explode(
            F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
        ).alias("block"),
    )
    first = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    last = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    took = F.aggregate(
        "uses", F.lit(0).cast("long"), lambda sum_, w: sum_ + F.greatest(F.least(last, w) - first, F.lit(0))
    )
    taken = (
        pieces.join(used, ["place", "block"])
        .groupBy("place", "start", F.col("doc_id").alias("id"))
        .agg(F.sum(took).alias("taken"))
    )
    # a word belongs to one document, so a non-empty document is told by its place and start
    joined = laid.join(
        taken,
        (laid.place == taken.place)
        & (laid.start == taken.start)
        & laid.doc_id.eqNullSafe(taken.id)
        & (laid.size > 0),
        "left",
    )
    return joined.select(
        laid.doc_id,
        laid.source,
        laid.size,
        laid.source_size,
        laid.target,
        F.coalesce(taken.taken, F.lit(0)).cast("long").alias("taken"),
    )
