"""Byte-level BPE: whole texts to token ids and back, with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by a pattern. A pre-token that is a token itself is that token. Any
other starts as a linked list of its bytes, and the pair of lowest rank, leftmost first, is merged
until no neighbours form a token. The pairs wait in a :class:`RankQueue`: one bucket of list
positions per merge rank, and two levels of bitmaps above the buckets, in which find-first-set
names the next rank. A merge changes the pairs beside it; their old entries stay in their buckets
and are skipped when met. A pair at one position only ever grows, so an entry is stale if and only
if its rank is no longer the one noted at its position. A pre-token of n bytes costs O(n log n)
steps, whatever n is; it takes about 100 bytes of memory for each of its bytes.

Ids are those of the ``tiktoken`` library for the same rank file and pattern, without special
tokens: their strings in a text are ordinary text. What letters, numbers and spaces are depends on
the Unicode version of the library's pattern engine, so texts with code points on which it and
Python's engine disagree are cut by classes that list its members.

Pre-tokens are remembered per worker in two generations of bounded size, which changes no result.
Texts are taken in slices of bytes, so a batch of long texts never stands in memory as a whole.

Defined cases: a null or empty text has no tokens; a text of any length is encoded whole; repeated
rows are encoded alike; extra columns are left out; an empty table gives an empty result. Decoding
a null gives null; an id that the vocabulary does not have raises ``ValueError``.
"""

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.words import byte_slices, release

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens remembered in each of two generations; longer ones than this many signs are not.
KEPT, KEPT_LENGTH = 600_000, 64
#: Texts longer than this many signs are cut into this many pre-tokens at a time.
LONG_TEXT, BLOCK = 1_000_000, 100_000
#: A bitmap word has 2**LEVEL bits; the top word has one for each of them.
LEVEL = 8
_REST = (1 << LEVEL) - 1
_ONE = [1 << k for k in range(4096)]


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that cuts texts."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


class RankQueue:
    """Pairs of one pre-token by rank; the lowest rank comes first, and in it the leftmost position.

    It is empty before and after every pre-token, so one queue serves them all. Its steps stand in
    :meth:`merge` itself, because calls would cost more than they do.
    """

    __slots__ = ("buckets", "leaves", "ranks")

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.buckets: dict[int, list[int]] = {}  # positions by rank, each list a heap
        self.leaves = [0] * ((max(ranks.values()) >> LEVEL) + 1)  # a bit per rank that has a bucket

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging its bytes in order of rank."""
        rank_of, buckets, leaves, n = self.ranks.get, self.buckets, self.leaves, len(piece)
        top = 0  # a bit per leaf that has bits
        after = list(range(1, n + 1))  # linked list of segments, named by their first byte
        before = list(range(-1, n - 1))
        noted: list[int | None] = [None] * n  # rank of the pair that starts here
        pairs = ((at, at + 2) for at in range(n - 1))
        while True:
            for at, end in pairs:
                rank = noted[at] = rank_of(piece[at:end])
                if rank is None:
                    continue
                if rank in buckets:
                    heappush(buckets[rank], at)
                    continue
                buckets[rank] = [at]
                leaf = rank >> LEVEL
                word = leaves[leaf]
                if not word:
                    top |= _ONE[leaf]
                leaves[leaf] = word | _ONE[rank & _REST]
            while top:
                leaf = (top & -top).bit_length() - 1
                word = leaves[leaf]
                rank = (leaf << LEVEL) + (word & -word).bit_length() - 1
                bucket = buckets[rank]
                at = heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    leaves[leaf] = word = word & (word - 1)
                    if not word:
                        top &= top - 1
                if noted[at] == rank:
                    break
                # else the entry is stale
            else:
                break
            middle, left = after[at], before[at]
            end = after[at] = after[middle]
            noted[at] = noted[middle] = None
            if end < n:
                before[end] = at
                pairs = ((left, end), (at, after[end])) if left >= 0 else ((at, after[end]),)
            else:
                pairs = ((left, end),) if left >= 0 else ()
        ids, at = [], 0
        while at < n:
            end = after[at]
            ids.append(self.ranks[piece[at:end]])
            at = end
        return ids


class Pieces(dict):
    """Pre-token to its ids as bytes. The older of two generations goes when the younger is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece.encode())
            if len(piece) > KEPT_LENGTH:
                return ids
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        highest = max(self.ranks.values())
        self.tokens: list[bytes | None] = [None] * (highest + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(self.ranks)
        self.known = Pieces(self.piece_ids)
        self.split = regex.compile(pattern)
        self.pattern, self.listed = pattern, None
        self.ascii = re.compile(self.pattern_for("A-Za-z", "0-9"), re.ASCII)
        self.odd = self._disagreements()

    def _disagreements(self):
        """What finds code points that Python's engine puts into other classes than the library's."""
        found: set[int] = set()
        for name in ("L", "N"):
            theirs, ours = _members(name), set(map(ord, regex.findall(rf"\p{{{name}}}", _every())))
            found |= theirs ^ ours
        return regex.compile(f"[{_ranges(found)}]") if found else None

    def pattern_for(self, letters: str, numbers: str) -> str:
        """The pattern with its classes of letters and numbers listed instead of named."""
        pattern = self.pattern
        for name, inside in (("L", letters), ("N", numbers)):
            while (listed := regex.sub(rf"(\[[^\]]*)\\p{{{name}}}", lambda m, r=inside: m[1] + r, pattern)) != pattern:
                pattern = listed
            pattern = pattern.replace(rf"\p{{{name}}}", f"[{inside}]")
        return pattern

    def splitter(self, text: str):
        """What cuts this text as the library would."""
        if text.isascii():
            return self.ascii
        if self.odd is None or not self.odd.search(text):
            return self.split
        if self.listed is None:
            self.listed = regex.compile(self.pattern_for(_ranges(_members("L")), _ranges(_members("N"))))
        return self.listed

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text in order, in lists of bounded length."""
        split = self.splitter(text)
        if len(text) <= LONG_TEXT:
            yield split.findall(text)
            return
        found = (m.group() for m in split.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def piece_ids(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        ids = self.queue.merge(piece) if rank is None else [rank]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known = self.known.__getitem__
        return b"".join([b"".join(map(known, block)) for block in self.pre_tokens(text)])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a text from its ids."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= len(self.tokens):
            raise ValueError(f"no token has the id {int(numbers.max())}")
        try:
            return b"".join(
                [
                    b"".join(map(self.tokens.__getitem__, numbers[at : at + LONG_TEXT].tolist()))
                    for at in range(0, len(numbers), LONG_TEXT)
                ]
            )
        except TypeError:
            raise ValueError("an id has no token") from None


@lru_cache(maxsize=1)
def _every() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(maxsize=4)
def _members(name: str) -> frozenset[int]:
    """Code points of a Unicode class as the library's pattern engine has it."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    engine = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
    return frozenset(map(ord, bytes(engine.encode_ordinary(_every())).decode()))


def _ranges(points: set[int]) -> str:
    """Code points as the inside of a character class."""
    array = np.array(sorted(points), np.int64)
    cuts = np.flatnonzero(np.diff(array) != 1) + 1
    return "".join(f"\\U{part[0]:08x}-\\U{part[-1]:08x}" for part in np.split(array, cuts))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (little-endian unsigned 32-bit integers) of every whole text."""
    if path is None or pattern is None:
        named, cut = default_vocabulary()
        path, pattern = path or named, pattern or cut

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids = [own.encode(text) for text in part.column("text").to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
                )
        release()

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary"
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of :func:`encode` with ``bytes``, the decoded text, added."""
    if path is None or pattern is None:
        named, cut = default_vocabulary()
        path, pattern = path or named, pattern or cut

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in byte_slices(batch, "ids"):
                texts = [None if ids is None else own.decode(ids) for ids in part.column("ids").to_pylist()]
                columns = [part.column(c) for c in ("doc_id", "n_tokens", "ids")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "bytes"]
                )
        release()

    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, bytes binary"
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decoded, schema)
