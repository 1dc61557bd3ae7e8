"""Spelling variants: words one edit apart, found in the sorted rotations of all words.

Every word ends in a terminator and is written in all its rotations (a permuterm list). Two words
that differ in one replaced sign have a rotation each that ends in that sign, and all before it is
the same; a word with one sign more has a rotation that is the other word's rotation plus that
sign. So every one-edit neighbourhood is a prefix range that skips the edited sign: it holds the
rotations ``prefix + sign`` and the rotation that is the prefix itself. A rotation is therefore
listed under itself and under all of it but its last sign, the list is dealt and sorted by prefix,
and a scan reads the ranges one after the other. As words are distinct, a range has one row for
each sign of the alphabet and one more at most, however many words there are: no range is hot, and
a scan holds one range. From a range every row gets the number of its neighbours there and the best
of them, never pairs. A sign deleted from a run of equal signs gives one word in several ways; only
the first of the run counts.

Words are numbered by falling frequency and, in ties, rising code points, so the smallest number is
the best neighbour. A word's form is its best neighbour, if that is ``RATIO`` times as frequent;
roots follow the forms by pointer jumping, in as many rounds as the logarithm of the longest chain,
which frequencies bound at 18 steps.

Rotations of a word longer than ``LONG`` signs are listed by place and 127-bit fingerprints of
their two sides, so a word of n signs costs n rows of bounded size.

Defined cases: a null or empty text has no words; a null doc_id is the empty text in the hash;
texts of any length are read whole; a repeated row counts again; extra columns are left out; a
table without words gives an empty result.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.words import byte_slices, release
from ledgerlake.sources.scratch import discard, stored

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One of so many occurrences loses a sign.
MISSPELT = 31
LONG = 64
_END = "$"
#: Words a task counts before it hands on what it has; runs of a text taken at a time.
COUNTED, BLOCK = 200_000, 200_000
_PRIME, _BASE = 2**127 - 1, 0x5BD1E995_9E3779B9_7F4A7C15
_WHOLE, _REPEATED, _MEMBER = 0, 1, 2


def _runs(text: str) -> Counter:
    """The lower-cased runs of a text with their counts; only A-Z are lower-cased."""
    found = re.finditer(RUN, text.encode().lower().decode())
    runs: Counter = Counter()
    while block := [m.group() for m in islice(found, BLOCK)]:
        runs.update(block)
    return runs


def word_counts(documents: DataFrame) -> DataFrame:
    """word and n of all words, some occurrences misspelt by rule."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: defaultdict[str, int] = defaultdict(int)

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
            )
            total.clear()
            return batch

        for batch in batches:
            for part in byte_slices(batch, "text"):
                for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    seed = crc32(f"{doc_id}:".encode())
                    for word, n in _runs(text).items():
                        if len(word) < LEAST_LENGTH:
                            continue
                        h = crc32(word.encode(), seed)
                        if h % MISSPELT == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        total[word] += n
                if len(total) >= COUNTED:
                    yield handed()
        yield handed()
        release()

    texts = documents.filter(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")
    )
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def numbered(words: DataFrame) -> DataFrame:
    """``place``: rises with falling n and, in ties, with the word."""
    ordered = words.orderBy(F.desc("n"), "word")
    return ordered.withColumn("place", F.monotonically_increasing_id())


def rotations(word: str) -> tuple[list[str], list[str]]:
    """All rotations, and all without the sign they end in; both by the place where they start."""
    n, ring = len(word), word + _END + word
    return [ring[k : k + n + 1] for k in range(n + 1)], [ring[k : k + n] for k in range(1, n + 1)]


def fingerprints(word: str) -> Iterator[tuple[str, str | None]]:
    """The same for a long word: place and fingerprints of what stands before and after it."""
    power, inverse = pow(_BASE, len(word), _PRIME), pow(_BASE, -1, _PRIME)
    left, right = 0, 0
    for sign in word:
        right = (right * _BASE + ord(sign)) % _PRIME
    for k, sign in enumerate(word):
        whole = f"#{k}:{left:x}:{right:x}"
        power = power * inverse % _PRIME
        right = (right - ord(sign) * power) % _PRIME
        yield whole, f"#{k}:{left:x}:{right:x}"
        left = (left * _BASE + ord(sign)) % _PRIME
    yield f"#{len(word)}:{left:x}:0", None


def _kinds(word: str) -> list[int]:
    return [_MEMBER if k == 0 or word[k - 1] != sign else _REPEATED for k, sign in enumerate(word)]


def listed(words: DataFrame) -> DataFrame:
    """prefix, place and kind of every rotation of every word."""
    fields = ["prefix", "place", "kind"]

    def batch_of(prefixes: list[str], places: list[int], kinds: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(prefixes, pa.string()), pa.array(places, pa.int64()), pa.array(kinds, pa.int8())], fields
        )

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "word", 2**14):
                prefixes, places, kinds = [], [], []
                for word, place in zip(part.column("word").to_pylist(), part.column("place").to_pylist(), strict=True):
                    if len(word) <= LONG:
                        whole, cut = rotations(word)
                        prefixes += whole + cut
                        kinds += [_WHOLE] * len(whole) + _kinds(word)
                        places += [place] * (2 * len(word) + 1)
                    if len(word) >= LONG:  # at LONG in both lists, to meet longer words
                        pairs = fingerprints(word)
                        own = iter(_kinds(word)) if len(word) > LONG else iter(())
                        while some := list(islice(pairs, BLOCK)):
                            prefixes += [w for w, _ in some]
                            kinds += [_WHOLE] * len(some)
                            cut = [c for _, c in some if c is not None and len(word) > LONG]
                            prefixes += cut
                            kinds += list(islice(own, len(cut)))
                            places += [place] * (len(some) + len(cut))
                            if len(prefixes) >= BLOCK:
                                yield batch_of(prefixes, places, kinds)
                                prefixes, places, kinds = [], [], []
                yield batch_of(prefixes, places, kinds)

    return words.select("word", "place").mapInArrow(rotate, "prefix string, place long, kind byte")


def _neighbours(place: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """place, number of neighbours and best neighbour of the rows of whole ranges, sorted by place in each."""
    sizes = np.diff(np.append(starts, len(place)))
    keep = np.repeat(sizes > 1, sizes)  # most ranges hold one rotation
    place, kind, sizes = place[keep], kind[keep], sizes[sizes > 1]
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    starts = np.append(0, np.cumsum(sizes)[:-1])
    at, n = np.arange(len(place)), len(place)
    place = np.append(place, np.iinfo(np.int64).max)  # stands for no row

    def first(which: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(which, at, n), starts)

    def spread(values: np.ndarray) -> np.ndarray:
        return np.repeat(values, sizes)

    whole, lead, member = kind == _WHOLE, kind == _MEMBER, kind != _WHOLE
    best = spread(first(member))
    second = spread(first(member & (at != best)))
    shorter = np.where(lead, spread(first(whole)), n)
    longer = spread(first(lead))
    near = np.where(whole, spread(np.add.reduceat(lead.astype(np.int64), starts)), 0)
    near += np.where(member, spread(np.add.reduceat(member.astype(np.int64), starts)) - 1 + (shorter < n), 0)
    other = np.where(at == best, second, best)
    chosen = np.where(whole, place[longer], np.minimum(place[other], place[shorter]))
    some = near > 0
    return place[:-1][some], near[some], chosen[some]


def neighbours(words: DataFrame) -> DataFrame:
    """place, n_near and ``best`` (the place of the best neighbour) of all words that have neighbours."""
    schema = pa.schema([("place", pa.int64()), ("near", pa.int64()), ("best", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the range that may go on in the next batch

        def of(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            found = _neighbours(rows.column("place").to_numpy(), rows.column("kind").to_numpy(), starts)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

        for batch in batches:
            rows = pa.Table.from_batches([*waiting, batch]).combine_chunks()
            prefix = rows.column("prefix")
            changes = pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy()
            starts = np.append(0, np.flatnonzero(changes) + 1)
            last = int(starts[-1])
            if last:
                yield of(rows.slice(0, last), starts[:-1])
            waiting = rows.slice(last).to_batches()
        if waiting:
            yield of(pa.Table.from_batches(waiting), np.zeros(1, np.int64))
        release()

    ranges = listed(words).repartition("prefix").sortWithinPartitions("prefix", "place")
    found = ranges.mapInArrow(scan, "place long, near long, best long")
    return found.groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """place and root: where the chain of ``up`` ends that starts at place."""
    links = stored(links.select("place", F.col("up").alias("root"), F.lit(True).alias("moved")), "variant-links")
    while not links.filter("moved").isEmpty():
        far = links.select(F.col("place").alias("root"), F.col("root").alias("further"))
        joined = links.join(far, "root", "left")
        further = F.coalesce("further", "root").alias("root")
        after = stored(joined.select("place", further, F.col("further").isNotNull().alias("moved")), "variant-links")
        discard(links)
        links = after
    return links.drop("moved")


def variants(documents: DataFrame) -> DataFrame:
    """word, n, form, root, n_near and form_n of all words."""
    counted = stored(word_counts(documents), "variant-counts")
    words = stored(numbered(counted), "variant-words")
    discard(counted)
    near = neighbours(words)
    best = words.select(F.col("place").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = words.join(near, "place", "left").join(best, "best", "left")
    is_form = F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False))
    known = stored(
        known.select(
            "place",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
            F.when(is_form, F.col("best")).alias("up"),
        ),
        "variant-forms",
    )
    ends = roots(known.filter(F.col("up").isNotNull()))
    named = ends.join(words.select(F.col("place").alias("root"), F.col("word").alias("last")), "root")
    return known.join(named.drop("root"), "place", "left").select(
        "word", "n", "form", F.coalesce("last", "word").alias("root"), "n_near", "form_n"
    )
