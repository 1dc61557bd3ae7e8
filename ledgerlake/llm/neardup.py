"""MinHash near-duplicates: an inverted join over signature coordinates.

1. Every text becomes its set of five-word shingles and a signature of ``COORDINATES`` minima.
   Documents with equal sets are one class from here on, named by its smallest doc_id.
2. Classes are posted under each (coordinate, value). Values that no other class has cannot
   collide; the others are ordered by rarity. Two classes that agree in at least ``MATCHES``
   coordinates meet in the rarest ``shared - MATCHES + 1`` of either, so only that prefix of the
   lists is merged and the long lists are skipped.
3. Each class is confirmed on full sets against the list head it collides with most often, which
   joins nearly every group to a few heads. For what is still apart the lists are merged again,
   in blocks: first each open class with its best partner, then every pair of different groups
   that reaches the match threshold, confirmed on full sets inside the task. Links inside a group
   that is known to be connected are not expanded, so no list is ever emitted as pairs.

At a similarity of 0.75 a pair is below the match threshold (and so missed) with a chance of about
2e-6, which falls steeply with the similarity.

Defined cases: A-Z are folded; fewer than five words are one shingle; texts without words and null
texts have an empty set and are linked with nothing; rows without doc_id are linked with nothing
and kept; of rows with equal doc_id each is placed by its own text.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.graph import components
from ledgerlake.llm.words import SIMILARITY, free_name, hashed_words, release, shielded, shingle_hashes, slices
from ledgerlake.sources.scratch import discard, stored

COORDINATES = 64
MATCHES = 32
#: Rows of an open block, of the block it is compared with (and of a short list), of a group of lists.
OPEN_ROWS, LIST_ROWS, GROUP_ROWS = 256, 512, 2048

_SEEDS = np.random.default_rng(11).integers(1, 2**32, (2, COORDINATES), dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted shingle hashes of every text."""
    hashes, text, _ = hashed_words(texts)
    return [shingle_hashes(h) for h in np.split(hashes, np.searchsorted(text, np.arange(1, len(texts))))]


def shingles_of(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()))[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum over the set of every permutation ``x * a + b`` of 32-bit numbers."""
    least = np.full(COORDINATES, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            value = _SEEDS[0][:, None] * x[None, at : at + 2048]
            value += _SEEDS[1][:, None]
            np.minimum(least, value.min(1), out=least)
    return least


def similar(a: np.ndarray, b: np.ndarray, at_least: float = SIMILARITY) -> bool:
    """Whether two sorted sets reach the similarity, in whole hundredths."""
    if not len(a) or not len(b):
        return False
    hundredths = round(at_least * 100)
    if 100 * min(len(a), len(b)) < hundredths * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= hundredths * (len(a) + len(b) - both)


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set (s1, s2) and the signature (null for empty sets)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            size, s1, s2, rows = [], [], [], []
            for found in shingle_sets(batch.column("text")):
                name = xxhash.xxh3_128_digest(found.tobytes())
                size.append(len(found))
                s1.append(int.from_bytes(name[:8], "big", signed=True))
                s2.append(int.from_bytes(name[8:], "big", signed=True))
                rows.append(signature(found).view(np.int32) if len(found) else None)
            columns = [
                batch.column("doc_id"),
                pa.array(size, pa.int64()),
                pa.array(s1, pa.int64()),
                pa.array(s2, pa.int64()),
                pa.array(rows, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "s1", "s2", "signature"])
        release()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        sketch, f"doc_id {kind}, n_shingles long, s1 long, s2 long, signature array<int>"
    )


def classes(sketched: DataFrame) -> DataFrame:
    """One row per different non-empty set: node (smallest doc_id), its size, name and signature."""
    return (
        sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("s1", "s2")
        .agg(
            F.min("doc_id").alias("node"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
    )


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """(list, node, mask): the postings of every class in its prefix of rare shared coordinates.

    ``mask`` has a bit for each coordinate in the prefix.
    """
    posted = nodes.select("node", F.posexplode("signature").alias("coordinate", "value")).select(
        "node",
        (F.shiftleft(F.col("coordinate").cast("long"), 32) + (F.col("value").cast("long") + 2**31)).alias("list"),
    )
    shared = posted.groupBy("list").agg(F.count("*").alias("length")).filter("length > 1")
    per_node = posted.join(shared, "list").groupBy("node").agg(F.collect_list(F.struct("length", "list")).alias("met"))
    prefix = F.slice(F.array_sort("met"), F.lit(1), F.size("met") - MATCHES + 1)
    chosen = per_node.filter(F.size("met") >= MATCHES).select("node", prefix["list"].alias("lists"))
    mask = F.expr("aggregate(lists, 0L, (m, l) -> m | shiftleft(1L, cast(shiftright(l, 32) AS int)))")
    return chosen.select("node", mask.alias("mask"), F.explode("lists").alias("list"))


def confirmed(pairs: DataFrame, documents: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    texts = documents.select("doc_id", "text").filter("doc_id IS NOT NULL")
    with_a = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    with_both = with_a.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sides = zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")), strict=True)
            keep = [similar(left, right, at_least) for left, right in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    kind = pairs.schema["a"].dataType.simpleString()
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {kind}, b {kind}")


def _grouped(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings of the lists that hold more than one group, with ``grp`` and whether they are open.

    A posting is open if its group is not that of the list's head.
    """
    placed = lists.join(groups.withColumnRenamed("component", "grp"), "node", "left").withColumn(
        "grp", F.coalesce("grp", "node")
    )
    mixed = (
        placed.groupBy("list")
        .agg(F.min(F.struct("node", "grp")).alias("head"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        .filter("lo <> hi")
        .select("list", F.col("head.grp").alias("main"))
    )
    return placed.join(mixed, "list").withColumn("open", F.col("grp") != F.col("main"))


def _blocks(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """The postings in the groups in which they are compared: short lists share one, long ones are cut.

    A row asks for a partner of another group (``asks``), answers, or both.
    """
    counts = postings.groupBy("list").agg(
        F.sum(F.col("open").cast("long")).alias("open_rows"), F.count("*").alias("list_rows")
    )
    rows = postings.join(counts, "list").join(nodes.select("node", "n_shingles", "signature"), "node")
    carried = ["list", "node", "grp", "mask", "n_shingles", "signature"]
    groups = postings.count() // GROUP_ROWS + 1
    short = rows.filter(F.col("list_rows") <= LIST_ROWS).select(
        F.pmod(F.xxhash64("list"), F.lit(groups)).alias("bundle"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), *carried,
        F.col("open").alias("asks"), F.lit(True).alias("answers"),
    )
    long = rows.filter(F.col("list_rows") > LIST_ROWS).withColumns(
        {
            "open_blocks": F.ceil(F.col("open_rows") / OPEN_ROWS).cast("int"),
            "list_blocks": F.ceil(F.col("list_rows") / LIST_ROWS).cast("int"),
        }
    )
    i = F.pmod(F.xxhash64("node"), F.col("open_blocks")).cast("int")
    j = F.pmod(F.xxhash64("node", F.lit(1)), F.col("list_blocks")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_open = long.filter("open").select(
        F.col("list").alias("bundle"), i.alias("i"), each("list_blocks").alias("j"), *carried,
        F.lit(True).alias("asks"), F.lit(False).alias("answers"),
    )
    as_any = long.select(
        F.col("list").alias("bundle"), each("open_blocks").alias("i"), j.alias("j"), *carried,
        F.lit(False).alias("asks"), F.lit(True).alias("answers"),
    )
    return short.unionByName(as_open).unionByName(as_any)


_BLOCK = (
    "bundle long, i int, j int, list long, node long, grp long, mask long, n_shingles long, "
    "signature array<int>, asks boolean, answers boolean"
)


def _pairs(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of asking and answering classes of different groups, and their matching coordinates.

    Every pair that reaches the match threshold comes once over all lists: in that of the first
    coordinate that the prefixes of both have in common.
    """
    if not len(frame):
        return
    node, grp, n = (frame[c].to_numpy() for c in ("node", "grp", "n_shingles"))
    asks, answers = frame["asks"].to_numpy(bool), frame["answers"].to_numpy(bool)
    signatures = np.stack(frame["signature"].to_numpy())
    prefix = (frame["mask"].to_numpy().view(np.uint64)[:, None] >> np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(1)
    prefix = prefix.astype(bool)
    lists = frame["list"].to_numpy()
    by_list = np.argsort(lists, kind="stable")
    lists = lists[by_list]
    starts = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
    sizes = np.diff(np.append(starts, len(lists)))
    hundredths = round(SIMILARITY * 100)
    for size in np.unique(sizes):
        which = starts[sizes == size]
        at_once = max(1, 250_000 // (size * size))
        for at in range(0, len(which), at_once):
            rows = by_list[which[at : at + at_once, None] + np.arange(size)]
            u, c = rows[:, :, None], rows[:, None, :]
            ok = asks[u] & answers[c] & (grp[u] != grp[c])
            ok &= np.minimum(n[u], n[c]) * 100 >= np.maximum(n[u], n[c]) * hundredths
            # two that ask each other are one pair
            ok &= ~(asks[c] & answers[u]) | (node[u] > node[c])
            of, x, y = np.nonzero(ok)
            for cut in range(0, len(of), 50_000):
                part = slice(cut, cut + 50_000)
                a, b = rows[of[part], x[part]], rows[of[part], y[part]]
                same = signatures[a] == signatures[b]
                matches = same.sum(1)
                first = (same & prefix[a] & prefix[b]).argmax(1)
                own = (lists[which[at + of[part]]] >> 32) == first
                hit = own & (matches >= MATCHES)
                yield a[hit], b[hit], matches[hit]


def best_partners(lists: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each class with the class of another group it matches best."""

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        node = frame["node"].to_numpy()
        most, partner = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for u, c, matches in _pairs(frame):
            for row, other in ((u, c), (c, u)):
                order = np.lexsort((-node[other], matches))  # the best comes last and stays
                row, other, found = row[order], other[order], matches[order]
                better = found > most[row]
                partner[row[better]], most[row[better]] = node[other[better]], found[better]
        release()
        hit = most > 0
        out = pd.DataFrame({"a": node[hit], "b": partner[hit], "matches": most[hit]})
        return out.sort_values(["a", "matches", "b"], ascending=[True, False, True]).drop_duplicates("a")

    near = _blocks(_grouped(lists, groups), nodes).groupBy("bundle", "i", "j")
    near = near.applyInPandas(best, "a long, b long, matches long")
    top = near.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("top"))
    return top.select(F.greatest("a", "top.b").alias("a"), F.least("a", "top.b").alias("b")).distinct()


def remaining_links(lists: DataFrame, groups: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b): links between groups, each pair above the match threshold confirmed on full sets.

    The first pass names the rows of a block that have such a pair at all; only they get their
    texts in the second, which returns at most one link for each two groups of a block.
    """

    def involved(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros(len(frame), bool)
        for u, c, _ in _pairs(frame):
            rows[u] = rows[c] = True
        return frame[rows]

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        texts, node, grp = (frame[c].to_numpy() for c in ("text", "node", "grp"))
        sets: dict[int, np.ndarray] = {}
        linked, out = set(), []
        for u, c, matches in _pairs(frame):
            best_first = np.argsort(-matches, kind="stable")
            for x, y in zip(u[best_first].tolist(), c[best_first].tolist(), strict=True):
                both = (grp[x], grp[y]) if grp[x] < grp[y] else (grp[y], grp[x])
                if both in linked:
                    continue
                for row in (x, y):
                    if node[row] not in sets:
                        sets[node[row]] = shingles_of(texts[row])
                if similar(sets[node[x]], sets[node[y]]):
                    linked.add(both)
                    out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = _blocks(_grouped(lists, groups), nodes)
    wanted = stored(rows.groupBy("bundle", "i", "j").applyInPandas(involved, _BLOCK), "near-open")
    texts = documents.select(F.col("doc_id").alias("node"), "text").filter("node IS NOT NULL")
    return wanted.join(texts, "node").groupBy("bundle", "i", "j").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stored(sketches(documents), "near-sketches")
    nodes = stored(classes(sketched), "near-classes")
    lists = stored(prefix_lists(nodes), "near-lists")

    heads = lists.groupBy("list").agg(F.min("node").alias("head"))
    collisions = lists.join(heads, "list").filter("head <> node").groupBy("node", "head").agg(F.count("*").alias("n"))
    first = collisions.groupBy("node").agg(F.max(F.struct("n", "head")).alias("best"))
    links = stored(confirmed(first.select(F.col("node").alias("a"), F.col("best.head").alias("b")), documents), "near-links")
    groups = stored(components(links), "near-groups")
    for find in (
        lambda: confirmed(best_partners(lists, groups, nodes), documents),
        lambda: remaining_links(lists, groups, nodes, documents),
    ):
        before = links, groups
        links = stored(links.unionByName(find()), "near-links")
        groups = stored(components(links), "near-groups")
        discard(*before)
    discard(lists, links)

    named = nodes.join(groups, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    ids = named.withColumnsRenamed({"s1": "k1", "s2": "k2"})
    placed = sketched.join(
        ids, (sketched.s1 == ids.k1) & (sketched.s2 == ids.k2) & (sketched.n_shingles > 0), "left"
    )
    component = F.coalesce("component", "doc_id")
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def file_places(documents: DataFrame) -> Column | None:
    """A number for every row, from its file and its place in it, that is the same whenever the file is read.

    None where rows do not come from such files, or where two rows have one number (rows that were
    multiplied after the scan, or files whose hashes meet).
    """
    try:
        at = documents.metadataColumn("_metadata")
        place = F.xxhash64(at["file_path"], at["row_index"])
        numbers = documents.select(place.alias("place"))
    except AnalysisException:
        return None
    shared = numbers.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1")
    return place if shared.isEmpty() else None


def keep_one(documents: DataFrame, place: Column | None = None) -> DataFrame:
    """One row of each group of near duplicates (that of the smallest doc_id), all columns as they were.

    Rows are told apart by a number of their own, so those that share a doc_id stay or go each by
    its text: by ``place`` (see :func:`file_places`) where the documents are files that may be read
    again, else by numbers under which the rows are stored once more. All columns are carried as
    they are, whatever their names.
    """
    own = free_name("_row", documents)
    number = F.monotonically_increasing_id() if place is None else place
    rows, carried = shielded(documents.withColumn(own, number), "doc_id", "text")
    row, carried = rows.columns[-1], carried[:-1]
    if place is None:
        rows = stored(rows, "near-rows")  # written once: all who read it see the same numbers
    rows = rows.withColumnRenamed(row, "_row")
    ids = rows.filter("doc_id IS NOT NULL").select("_row", F.col("doc_id").alias("_id"))
    texts = rows.filter("doc_id IS NOT NULL").select(F.col("_row").alias("doc_id"), "text")
    grouped = near_duplicates(texts).filter("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    linked = stored(grouped.join(ids, "_row"), "near-placed")
    first = linked.groupBy("component_id").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_first"))
    dropped = linked.join(first, "component_id").filter("_row <> _first").select(F.col("_row").alias("_dropped"))
    return rows.join(dropped, F.col("_row") == F.col("_dropped"), "left_anti").select(*carried)
