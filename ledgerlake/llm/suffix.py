"""Repeated byte strings by a distributed difference-cover algorithm.

A byte is removed if a string of ``LENGTH`` bytes over it also starts earlier: in a smaller doc_id
or earlier in the same document. The suffixes are compared to that depth and no further:

1. Names. Bytes are named by triples, triples by triples of names, and so on (3, 9, 27, 81 bytes);
   two names that overlap give the name of any other length. Names are 64-bit fingerprints, so
   equal strings have equal names everywhere and no round over the data is needed per level.
2. Sampled suffixes. Positions of a document are sampled by a difference cover modulo ``PERIOD``:
   any two positions have a shift below the period that takes both into the sample. Two equal
   strings of ``LENGTH`` bytes therefore hold two sampled positions at the same shift with equal
   names of ``LENGTH - PERIOD + 1`` bytes. The sampled names of all documents are sorted by range;
   a sample whose name has no equal neighbour proves every string over it to be unique.
3. Remaining suffixes. Only the positions that a shared sample leaves open are named in full,
   sorted by range, and compared with their neighbours: all but the first of equal names repeat.

Documents are sorted by id and packed into parts of about ``PART_BYTES``, written once, bucketed by
part, so that no later step moves texts again. A part sends each different name once, as packed
sorted differences, and gets one bit back for each; what repeats inside a part is settled there, so
a passage that every document has costs one name per part. Parts are in document order, so the
first part with a name has its first occurrence.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` lose nothing; rows without
doc_id come first; rows of equal doc_id are ordered by a hash of their text and treated as
separate documents; an empty table gives an empty result.
"""

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.words import release
from ledgerlake.sources.scratch import scratch, stored

LENGTH = 100
#: A perfect difference set and its modulus.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
TUPLE = LENGTH - PERIOD + 1
PART_BYTES = 4 * 2**20
#: Different names of one sorting range, about; bits of a sampled name beyond its range.
RANGE_NAMES, SAMPLE_BITS = 2**20, 32

_BYTES = np.random.default_rng(57).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _triples(names: np.ndarray, step: int) -> np.ndarray:
    n = max(0, len(names) - 2 * step)
    value = names[:n] * _M1 + names[step : step + n]
    value ^= value >> np.uint64(29)
    value = value * _M2 + names[2 * step : 2 * step + n]
    value ^= value >> np.uint64(32)
    value *= _M3
    return value ^ (value >> np.uint64(30))


def _overlap(names: np.ndarray, step: int) -> np.ndarray:
    n = max(0, len(names) - step)
    value = names[:n] * _M1 + names[step:]
    value ^= value >> np.uint64(29)
    value *= _M2
    return value ^ (value >> np.uint64(32))


def name_levels(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names of 27 bytes at every position, and of ``TUPLE`` bytes."""
    nine = _triples(_triples(_BYTES[np.frombuffer(raw, np.uint8)], 1), 3)
    return (level := _triples(nine, 9)), _overlap(level, TUPLE - 27)


def full_names(level: np.ndarray) -> np.ndarray:
    """Names of ``LENGTH`` bytes from names of 27."""
    return _overlap(_triples(level, 27), LENGTH - 81)


def packs(documents: DataFrame) -> tuple[DataFrame, int, str]:
    """Parts in document order, written bucketed; their total bytes; and the name of the table."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(1, math.ceil(total / PART_BYTES))
    ordered = rows.repartitionByRange(wanted, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("raw"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, raws, held = TaskContext.get().partitionId() << 32, [], [], 0

        def packed() -> pa.RecordBatch:
            columns = {
                "part": pa.array([number], pa.int64()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": pa.array([[len(r) for r in raws]], pa.list_(pa.int64())),
                "raw": pa.array([b"".join(raws)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if raws and held + len(raw) > PART_BYTES:
                    yield packed()
                    number, ids, raws, held = number + 1, [], [], 0
                ids.append(doc_id)
                raws.append(raw)
                held += len(raw)
        if raws:
            yield packed()

    name = f"repeat_parts_{uuid.uuid4().hex}"
    made = ordered.mapInArrow(pack, "part long, ids array<long>, sizes array<long>, raw binary")
    # a session allows so many buckets; with more parts a bucket holds several
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    writer = made.write.format("parquet").option("compression", "zstd").bucketBy(min(wanted, most), "part")
    writer.option("path", scratch(spark, "repeat-parts")).saveAsTable(name)
    return spark.table(name), total, name


class _Part:
    """The documents of one part and the steps on their names."""

    def __init__(self, raw: bytes, sizes: list[int], sample_shift: int):
        ends = np.cumsum(sizes)
        self.raws = [raw[e - s : e] for e, s in zip(ends.tolist(), sizes, strict=True)]
        self.levels: list[np.ndarray | None] = []
        sampled, self.at = [], []
        for text in self.raws:
            if len(text) < LENGTH:
                self.levels.append(None)
                self.at.append(np.zeros(0, np.int64))
                continue
            level, tuples = name_levels(text)
            at = np.flatnonzero(np.resize(_IN_COVER, len(tuples)))
            sampled.append(tuples[at])
            self.at.append(at)
            self.levels.append(level)
        names = np.concatenate(sampled) if sampled else np.zeros(0, np.uint64)
        self.samples, self.sample_of, counts = np.unique(
            names >> np.uint64(sample_shift), return_inverse=True, return_counts=True
        )
        self.shared_here = counts > 1

    def open_positions(self, shared: np.ndarray) -> None:
        """Names of all positions that a shared sample leaves open, in document order."""
        flags, start = (shared | self.shared_here)[self.sample_of], 0
        self.open, names = [], []
        for level, at in zip(self.levels, self.at, strict=True):
            hit = at[flags[start : start + len(at)]]
            start += len(at)
            if not len(hit):
                self.open.append(np.zeros(0, np.int64))
                continue
            n = len(level) + 27 - LENGTH
            change = np.zeros(n + 1, np.int32)
            np.add.at(change, np.clip(hit - PERIOD + 1, 0, n), 1)
            np.add.at(change, np.clip(hit + 1, 0, n), -1)
            still = np.flatnonzero(np.cumsum(change[:n]) > 0)
            self.open.append(still)
            names.append(full_names(level)[still])
        self.levels = []
        everything = np.concatenate(names) if names else np.zeros(0, np.uint64)
        self.names, first, self.name_of = np.unique(everything, return_index=True, return_inverse=True)
        self.later_here = np.ones(len(everything), bool)
        self.later_here[first] = False

    def spans(self, earlier: np.ndarray) -> list[list[tuple[int, int]]]:
        """Maximal removed runs of every document, as (start, end) in bytes."""
        repeats, start, out = self.later_here | earlier[self.name_of], 0, []
        for at in self.open:
            hit = at[repeats[start : start + len(at)]]
            start += len(at)
            if not len(hit):
                out.append([])
                continue
            gap = np.flatnonzero(np.diff(hit) > LENGTH)
            begins = hit[np.concatenate(([0], gap + 1))]
            ends = hit[np.concatenate((gap, [len(hit) - 1]))] + LENGTH
            out.append(list(zip(begins.tolist(), ends.tolist(), strict=True)))
        return out


def _emitted(part: int, names: np.ndarray, bits: int, width: int) -> pa.RecordBatch:
    """Sorted names cut into 2**bits ranges, each as the low bytes of its differences.

    ``width`` is the number of bits of a name that are in use.
    """
    rest = width - bits
    ranges = (names >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(len(names), np.int64)
    rows: dict[str, list] = {"range": [], "part": [], "n": [], "payload": []}
    low = names & np.uint64(2**rest - 1)
    edges = np.flatnonzero(np.diff(ranges)) + 1
    for begin, end in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(names)])), strict=True):
        if begin == end:
            continue
        steps = np.diff(low[begin:end], prepend=np.uint64(0))
        planes = max(1, -(-int(steps.max()).bit_length() // 8))
        cut = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :planes].T)
        rows["range"].append(int(ranges[begin]))
        rows["part"].append(part)
        rows["n"].append(int(end - begin))
        rows["payload"].append(cut.tobytes())
    kinds = {"range": pa.int64(), "part": pa.int64(), "n": pa.int32(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})


EMITTED = "range long, part long, n int, payload binary"


def compared(emitted: DataFrame, first: bool) -> DataFrame:
    """One bit per name and part: whether an earlier part (``first``), or any other, has it too.

    Returns ``part`` and its answers by range. A range holds about ``RANGE_NAMES`` names, and a
    name at most once per part.
    """

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part", kind="stable")
        names = []
        for n, payload in zip(frame["n"], frame["payload"], strict=True):
            planes = np.frombuffer(payload, np.uint8).reshape(-1, n)
            steps = np.zeros((n, 8), np.uint8)
            steps[:, : len(planes)] = planes.T
            names.append(np.cumsum(steps.view(np.uint64).ravel()))
        everything = np.concatenate(names)
        order = np.argsort(everything, kind="stable")
        same = np.diff(everything[order]) == 0
        flags = np.zeros(len(everything), bool)
        flags[order[1:]] = same
        if not first:
            flags[order[:-1]] |= same
        release()
        cuts = np.split(flags, np.cumsum(frame["n"].to_numpy())[:-1])
        bits = [np.packbits(c).tobytes() for c in cuts]
        return pd.DataFrame({"part": frame["part"].to_numpy(), "range": frame["range"].to_numpy(), "bits": bits})

    answers = emitted.groupBy("range").applyInPandas(compare, "part long, range long, bits binary")
    return answers.groupBy("part").agg(F.collect_list(F.struct("range", "bits")).alias("answers"))


def _answered(names: np.ndarray, bits: int, width: int, answers: list[dict] | None) -> np.ndarray:
    """The answers for a part's sorted names."""
    rest = width - bits
    ranges = (names >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(len(names), np.int64)
    out = np.zeros(len(names), bool)
    for answer in answers or []:
        lo, hi = np.searchsorted(ranges, (answer["range"], answer["range"] + 1))
        out[lo:hi] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


def repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the removed spans (start, end) and the bytes that are kept."""
    parts, total, name = packs(documents)
    samples = total * len(COVER) // PERIOD
    sample_bits = max(0, math.ceil(math.log2(max(1, samples) / RANGE_NAMES)))
    name_bits = max(0, math.ceil(math.log2(max(1, total) / 4 / RANGE_NAMES)))
    sample_width = min(64, sample_bits + SAMPLE_BITS)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Part]]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                yield row, _Part(row.pop("raw"), row["sizes"], 64 - sample_width)
                release()

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part in parts_of(batches):
            yield _emitted(row["part"], part.samples, sample_bits, sample_width)

    def opened(row: dict, part: _Part) -> None:
        part.open_positions(_answered(part.samples, sample_bits, sample_width, row["answers"]))

    def remain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part in parts_of(batches):
            opened(row, part)
            yield _emitted(row["part"], part.names, name_bits, 64)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part in parts_of(batches):
            opened(row, part)
            spans = part.spans(_answered(part.names, name_bits, 64, row["last"]))
            kept = []
            for raw, cut in zip(part.raws, spans, strict=True):
                edges = [0, *[e for span in cut for e in span], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = [[{"start": a, "end": b} for a, b in cut] for cut in spans]
            columns = {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "n_bytes": pa.array(row["sizes"], pa.int64()),
                "spans": pa.array(made, kind),
                "kept": pa.array(kept, pa.binary()),
            }
            whole = pa.RecordBatch.from_pydict(columns)
            yield from (whole.slice(at, 256) for at in range(0, whole.num_rows, 256))

    texts = parts.select("part", "sizes", "raw")
    shared = stored(compared(texts.mapInArrow(sample, EMITTED), first=False), "repeat-samples")
    told = texts.join(shared.hint("shuffle_hash"), "part", "left")
    later = stored(compared(told.mapInArrow(remain, EMITTED), first=True), "repeat-names")
    told = parts.join(shared.hint("shuffle_hash"), "part", "left").join(
        later.withColumnRenamed("answers", "last").hint("shuffle_hash"), "part", "left"
    )
    return told.mapInArrow(
        finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
