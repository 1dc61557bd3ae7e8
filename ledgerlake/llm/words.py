"""Words and shingles, as expressions and as array code that runs inside tasks."""

import ctypes
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: what separates words (space, tab, newline, vertical tab, form feed, carriage return)
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE = 5
SIMILARITY = 0.75

_WORD = re.compile(WORD)


def free_name(wanted: str, documents: DataFrame) -> str:
    """A column name that the documents do not have, whatever the case of theirs."""
    taken = {c.lower() for c in documents.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def shielded(documents: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """The documents with all columns but ``own`` under names no operator uses, and what names them back."""
    inner = [c if c in own else f"carried_{k}" for k, c in enumerate(documents.columns)]
    return documents.toDF(*inner), [F.col(i).alias(c) for i, c in zip(inner, documents.columns, strict=True)]


def fold(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words in order; an empty array for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def words_of(text: str | None) -> list[str]:
    """The words as they stand; ``WordHashes`` folds them."""
    return _WORD.findall(text) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in small parts, so that few of its texts are Python objects at a time."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 2**22, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``limit`` bytes of one column; a longer value is a part."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + limit, "right"))))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class WordHashes(dict):
    """Word to the 64-bit hash of its folded form, remembered; forgotten beyond a bound of entries."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        # of bytes, lower() folds A-Z alone
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass").lower())
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x2545F4914F6CDD1D
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_OF_BYTE = (np.random.default_rng(64).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1))[_LOWER]
#: Bytes hashed at once; a longer word is taken whole.
CHUNK = 2**16


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(n + 1, np.uint64(base))
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the folded words of all texts, their text, and the line in it they stand in.

    Works on the column's bytes: the hash of a word is a polynomial over its bytes, taken from
    running sums and scrambled, so it does not depend on where the word stands.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None or offsets[-1] == offsets[0]:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    space = _SPACE[raw]
    begins, stops = ~space, ~space
    begins[1:] &= space[:-1]
    stops[:-1] &= space[1:]
    inner = edges[(edges > 0) & (edges < len(raw))]  # texts end words, too
    begins[inner] |= ~space[inner]
    stops[inner - 1] |= ~space[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            last = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
            high = ends[last - 1]
            up, down = _powers(CHUNK if high - low <= CHUNK else int(high - low))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_OF_BYTE[raw[low:high]] * up[: high - low], out=sums[1:])
            s, e = starts[at:last] - low, ends[at:last] - low
            hashes[at:last] = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = last
    # texts and breaks are fewer than words, so they are looked up among these
    text = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(starts, edges)))
    breaks = np.flatnonzero(raw == 10)
    before = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1)[: len(starts)])
    line = before - np.searchsorted(breaks, edges[:-1])[text]
    return hashes, text, line


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence, if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    with np.errstate(over="ignore"):
        total = hashes[: n - size + 1] + np.uint64(size)
        for k in range(1, size):
            total = _mix(total) + hashes[k : n - size + 1 + k]
        return np.unique(_mix(total))
