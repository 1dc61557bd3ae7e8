"""Line dedup: an exact set-similarity join of line tokens.

A line is the set of its distinct words; it is removed if an earlier line (smaller doc_id, or the
same document and an earlier place) has a Jaccard similarity of at least ``SIMILARITY``. Lines are
judged on the input, not on what is left of it.

1. Rarity and equal sets, in one pass. Word counts over all documents order the words of a line;
   they are kept in a table of fixed size, whose order is the same everywhere and need not be exact
   to be valid. Lines are named by a 128-bit hash of their set; all but the first of equal sets go.
2. Prefix filter. Two similar lines share a word among the rarest ``n - ceil(0.75 n) + 1`` of
   either, so each remaining line is listed under those words. Postings are packed by column and
   meet by ranges of their words; a list longer than ``LONG`` is cut into blocks, and pairs of
   blocks are compared in tasks of their own.
3. Pairs of a list must pass the length filter, the positional filter and a bound on the symmetric
   difference from bitmaps of word parities, of which longer lines have more. A line keeps its
   nearest earlier candidates.
4. The nearest candidate of a line is verified on the full sets of words, then the others that were
   kept. A line that is similar to none of them, but had more, is compared again with every
   candidate, in the lists that hold such a line; no pair is lost.

The documents are written once with a row number, bucketed by stretches of rows, so that looking
up lines and removing them does not move the texts again.

Defined cases: A-Z are folded; lines of fewer than ``least`` distinct words are kept; null
texts stay null; rows without doc_id are left alone; rows of equal doc_id are told apart as rows,
and none of them is earlier than another at the same place; a text may lose all lines and is then
empty.
"""

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.words import SIMILARITY, byte_slices, free_name, hashed_words, release, shielded, slices
from ledgerlake.sources.scratch import discard, scratch, stored

#: Lines of fewer different words are kept, unless the caller asks for others too.
LEAST_WORDS = 5
#: Lines of one or two words are similar to equal sets only, which are settled before the join.
JOINED_WORDS = 3
#: Entries of the table of word counts (as a power of two), and parts in which it is summed.
TABLE_BITS, PARTS = 22, 16
TABLE, TABLE_SHIFT = 2**TABLE_BITS, np.uint64(64 - TABLE_BITS)
#: Documents handled at once, and bytes of their texts; postings that a task packs at once.
SLICE, SLICE_BYTES, PACKED = 4096, 2**22, 2**19
#: Postings of one range; postings of a list that is cut, and of its blocks; pairs compared at once.
RANGE, LONG, BLOCK, AT_ONCE = 2**17, 8192, 2048, 2**18
#: Candidates that a line keeps before it is marked as having more.
KEPT = 4
#: Rows of a stretch, as a power of two; bits of a word's hash that name its list.
STRETCH, WORD_BITS = 12, 36
HUNDREDTHS = round(SIMILARITY * 100)

_SETS = ("h1", "id", "doc_id", "line", "h2")
_FIELDS = ("list", "id", "doc_id", "line", "n", "place")
#: The fewest words of a line that has one more bitmap of word parities, and the cell that this one
#: splits: with one bitmap of 64 bits, long lines would all look alike. ``parity`` is that of all words.
BITMAPS, SPLITS = (48, 112, 180, 250, 320, 390, 460), (0, 1, 0, 0, 1, 2, 3)
_MORE = tuple(f"parity{k}" for k in range(1, len(BITMAPS) + 1))


def numbered(documents: DataFrame) -> tuple[DataFrame, str]:
    """The documents with ``_id`` (a row number) and ``_stretch``, written bucketed; the table's name."""
    spark = documents.sparkSession
    rows = documents.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_stretch", F.shiftright("_id", STRETCH))
    name = f"line_rows_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = rows.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "_stretch")
    writer.option("path", scratch(spark, "line-rows")).saveAsTable(name)
    return spark.table(name), name


# ---- rarity


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte: exact below 128, then eighths of powers of two."""
    high = 128 + np.minimum(127, 8 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, high).astype(np.uint8)


def _sets(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of every set of distinct hashes, whatever their order."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h1 = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
        h2 = np.add.reduceat((mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F), starts)
    return h1.view(np.int64), h2.view(np.int64)


def _later_copies(f: dict[str, np.ndarray]) -> np.ndarray:
    """Which lines repeat the set of an earlier one; rows of one id at one place do not."""
    order = np.lexsort((f["line"], f["doc_id"], f["h2"], f["h1"]))
    h1, h2 = f["h1"][order], f["h2"][order]
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    later[order] = (f["doc_id"][order] != f["doc_id"][head]) | (f["line"][order] != f["line"][head])
    return later


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents in parts that are handled at once."""
    return (part for batch in batches for part in byte_slices(batch, "text", SLICE_BYTES, SLICE))


def _gathered(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    """Parts united to some ``PACKED`` entries, so that there are few cells, and long ones, at any number of ranges."""
    held: list[dict[str, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(f["id"]) for f in held) >= PACKED:
            yield {name: np.concatenate([f[name] for f in held]) for name in held[0]}
            held = []
    if held:
        yield {name: np.concatenate([f[name] for f in held]) for name in held[0]}


def first_pass(rows: DataFrame, ranges: int, least: int) -> DataFrame:
    """``kind`` and ``part`` with packed data: word counts, set names by range, copies inside a slice."""
    width = TABLE // PARTS

    def found(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        for part in _parts(batches):
            hashes, owner, of_text, line = _lines(part.column("text"))
            table += np.bincount((hashes >> TABLE_SHIFT).astype(np.int64), minlength=TABLE).astype(np.uint32)
            hashes, owner, n = _distinct(hashes, owner, len(of_text), None)
            fit = n >= least
            if fit.any():
                hashes, starts = hashes[fit[owner]], np.concatenate(([0], np.cumsum(n[fit])[:-1]))
                h1, h2 = _sets(hashes, starts)
                ids, docs = (part.column(c).to_numpy(zero_copy_only=False)[of_text[fit]] for c in ("_id", "doc_id"))
                yield {"h1": h1 >> 1 & 2**62 - 1, "id": ids, "doc_id": docs, "line": line[fit], "h2": h2}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TABLE, np.uint32)
        for f in _gathered(found(batches, table)):
            later = _later_copies(f)
            known = np.stack((f["id"][later], f["line"][later])).astype(np.int64)
            own = {k: v[~later] for k, v in f.items()}
            out = _cut(own, "h1", (own["h1"] >> 30) * ranges >> 32, _pack_sets)
            yield _rows([(1, r, payload) for r, payload in out] + [(2, 0, known.tobytes())])
        counts = []
        for part in range(PARTS):
            own = table[part * width : (part + 1) * width]
            if (used := own > 0).any():
                bits, values = np.packbits(used).tobytes(), own[used].tobytes()
                size = np.int64(len(bits) + len(values)).tobytes()
                counts.append((0, part, size + pa.compress(bits + values, "zstd", asbytes=True)))
        yield _rows(counts)
        release()

    texts = rows.filter("text IS NOT NULL").select("_id", F.col("doc_id").cast("long"), "text")
    return texts.filter("doc_id IS NOT NULL").mapInArrow(read, "kind int, part long, payload binary")


def _rows(cells: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "part": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array([c[i] for c in cells], t) for i, (k, t) in enumerate(kinds.items())})


def word_counts(first: DataFrame) -> bytes:
    """How often the words of each table entry occur in all texts; ``TABLE`` bytes at any input size."""
    width = TABLE // PARTS

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}  # of the parts that this task got
        for frame in frames:
            for part, payload in zip(frame["part"], frame["payload"], strict=True):
                size = int(np.frombuffer(payload, np.int64, 1)[0])
                raw = pa.decompress(payload[8:], size, "zstd", asbytes=True)
                at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, width // 8)))
                sums.setdefault(part, np.zeros(width, np.uint64))[at] += np.frombuffer(raw, np.uint32, len(at), width // 8)
        yield pd.DataFrame({"part": list(sums), "codes": [_coded(s).tobytes() for s in sums.values()]})

    table = bytearray(TABLE)
    parts = first.filter("kind = 0").select("part", "payload").repartition(PARTS, "part")
    for row in parts.mapInPandas(add, "part long, codes binary").collect():
        table[row["part"] * width : (row["part"] + 1) * width] = row["codes"]
    return bytes(table)


def copies(first: DataFrame) -> DataFrame:
    """id and line of the lines whose set an earlier line has: of slices, then of all by range."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                ids, lines = np.frombuffer(payload, np.int64).reshape(2, -1)
                columns = [pa.array(ids), pa.array(lines.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "line"])

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(p, _SETS) for p in frame["payload"]]
        f = {name: np.concatenate([p[name] for p in parts]) for name in _SETS}
        later = _later_copies(f)
        return pd.DataFrame({"id": f["id"][later], "line": f["line"][later]})

    inside = first.filter("kind = 2").select("payload").mapInArrow(known, "id long, line int")
    return inside.unionByName(first.filter("kind = 1").groupBy("part").applyInPandas(find, "id long, line int"))


# ---- packed postings


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length: the first, which is sorted, as differences; all by their low bytes."""
    out = [np.int64(len(columns[0])).tobytes()]
    for k, column in enumerate(columns):
        values = column.astype(np.int64).view(np.uint64)
        base = values.min()
        values = np.diff(values, prepend=base) if k == 0 else values - base
        planes = max(1, -(-int(values.max()).bit_length() // 8))
        low = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :planes].T)
        out += [bytes([planes]), base.tobytes(), low.tobytes()]
    return b"".join(out)


def _pack_sets(fields: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    return _pack([fields[name][at] for name in _SETS])


def _pack_lines(fields: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    """Postings at some positions, compressed, and the bitmaps as they are, the further ones of lines that have them."""
    own = {name: f[at] for name, f in fields.items()}
    own["doc_id"] = own["doc_id"] - own["id"]  # rows in the order of their ids need next to no room for them
    head = _pack([own[name] for name in _FIELDS])
    short = pa.compress(head, "zstd", asbytes=True)
    bits = [own["parity"].tobytes()] + [own[name][own["n"] >= least].tobytes() for name, least in zip(_MORE, BITMAPS, strict=True)]
    return b"".join([np.int64(len(head)).tobytes(), np.int64(len(short)).tobytes(), short, *bits])


def _cut(
    fields: dict[str, np.ndarray], key: str, of_range: np.ndarray, pack: Callable[[dict[str, np.ndarray], np.ndarray], bytes]
) -> Iterator[tuple[int, bytes]]:
    """The fields packed by range, sorted by ``key``, along which ranges rise."""
    order = np.argsort(fields[key], kind="stable")
    of_range = of_range[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(of_range)) + 1, [len(order)]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield int(of_range[a]), pack(fields, order[a:b])


def _unpack(payload: bytes, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(payload, np.int64, 1)[0]), 8, {}
    for k, name in enumerate(names):
        planes, base = payload[at], np.frombuffer(payload, np.uint64, 1, at + 1)[0]
        values = np.zeros((n, 8), np.uint8)
        values[:, :planes] = np.frombuffer(payload, np.uint8, n * planes, at + 9).reshape(planes, n).T
        values = values.view(np.uint64).ravel()
        out[name] = ((np.cumsum(values) if k == 0 else values) + base).view(np.int64)
        at += 9 + n * planes
    return out


def _head(payload: bytes, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The first fields of ``_pack_lines``."""
    size, short = np.frombuffer(payload, np.int64, 2).tolist()
    return _unpack(pa.decompress(payload[16 : 16 + short], size, "zstd", asbytes=True), names)


def _fields(payload: bytes) -> dict[str, np.ndarray]:
    """What ``_pack_lines`` packed; lines without a further bitmap have zeros there."""
    fields = _head(payload, _FIELDS)
    fields["doc_id"] = fields["doc_id"] + fields["id"]
    at = 16 + int(np.frombuffer(payload, np.int64, 1, 8)[0])
    for name, least in zip(("parity", *_MORE), (0, *BITMAPS), strict=True):
        own = fields["n"] >= least
        fields[name] = np.zeros(len(own), np.int64)
        fields[name][own] = np.frombuffer(payload, np.int64, n := int(own.sum()), at)
        at += 8 * n
    return fields


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """The fewest words that a line of n words shares with a similar one."""
    return -(-n * HUNDREDTHS // 100)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all lines of some texts: hashes, number of their line; and text and place of each line."""
    hashes, text, line = hashed_words(texts)
    lines = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(lines)))
    of_text = np.repeat(np.arange(len(texts)), lines)
    return hashes, before[text] + line, of_text, np.arange(len(of_text)) - before[of_text]


def _distinct(
    hashes: np.ndarray, owner: np.ndarray, lines: int, codes: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of every line, by rarity (if ``codes`` are given), then by hash; their number."""
    rarity = np.zeros(len(hashes), np.uint8) if codes is None else codes[hashes >> TABLE_SHIFT]
    if lines < 2**20:
        key = (owner.astype(np.uint64) << np.uint64(44)) | (rarity.astype(np.uint64) << np.uint64(36))
        order = np.argsort(key | (hashes >> np.uint64(28)))
    else:
        order = np.lexsort((hashes, rarity, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, owner, np.bincount(owner, minlength=lines)


def _bitmaps(hashes: np.ndarray, owner: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Parities of the words of every line: of all, and of those that each further bitmap parts from its cell."""
    bit = np.left_shift(np.uint64(1), hashes & np.uint64(63))
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    out = {"parity": np.bitwise_xor.reduceat(bit, starts).view(np.int64)}
    cell = np.zeros(len(hashes), np.uint8)
    for k, (name, least, parent) in enumerate(zip(_MORE, BITMAPS, SPLITS, strict=True), 1):
        moved = np.flatnonzero((n >= least)[owner] & (cell == parent) & ((hashes >> np.uint64(5 + k)) & np.uint64(1) > 0))
        cell[moved] = k
        out[name] = np.zeros(len(n), np.int64)
        if len(moved):
            heads = np.flatnonzero(np.diff(owner[moved], prepend=-1))
            out[name][owner[moved[heads]]] = np.bitwise_xor.reduceat(bit[moved], heads).view(np.int64)
    return out


def _listed(hashes: np.ndarray, owner: np.ndarray, n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words a line is listed under, and the places of all, of lines of different words by rarity."""
    place = np.arange(len(hashes)) - np.concatenate(([0], np.cumsum(n)[:-1]))[owner]
    # a word that all texts have once is in no other line
    return (place < (n - _least_overlap(n) + 1)[owner]) & (codes[hashes >> TABLE_SHIFT] > 1), place


def _list_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _posted(part: pa.RecordBatch, codes: np.ndarray, least: int) -> dict[str, np.ndarray] | None:
    """Postings of some documents."""
    ids, docs = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "doc_id"))
    hashes, owner, of_text, line = _lines(part.column("text"))
    hashes, owner, n = _distinct(hashes, owner, len(of_text), codes)
    fit = n >= max(least, JOINED_WORDS)
    first_line = np.searchsorted(of_text, np.arange(part.num_rows))
    for row, skip in enumerate(part.column("_copies").to_pylist()):
        if skip:
            fit[first_line[row] + np.array(skip)] = False
    if not fit.any():
        return None
    keep = fit[owner]
    hashes, owner = hashes[keep], (np.cumsum(fit) - 1)[owner[keep]]
    of_text, line, n = of_text[fit], line[fit], n[fit]
    listed, place = _listed(hashes, owner, n, codes)
    row = owner[listed]
    of_line = {"id": ids[of_text], "doc_id": docs[of_text], "line": line.astype(np.int32), "n": n.astype(np.int32)}
    return {
        "list": _list_of(hashes[listed]),
        "place": place[listed].astype(np.int32),
        **{name: f[row] for name, f in (of_line | _bitmaps(hashes, owner, n)).items()},
    }


def postings(rows: DataFrame, gone: DataFrame, shared: Broadcast, ranges: int, least: int) -> DataFrame:
    """``range`` and packed postings of all lines but those in ``gone``; ``often``: lengths of lists.

    Only words that all texts have more than ``LONG`` times can have so long a list, so few lists are counted.
    """
    often = int(_coded(np.array([LONG]))[0])

    def found(batches: Iterator[pa.RecordBatch], codes: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        for part in _parts(batches):
            own = _posted(part, codes, least)
            if own is not None and len(own["id"]):
                yield own

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(shared.value, np.uint8)
        for f in _gathered(found(batches, codes)):
            lists = f["list"]
            counted = np.unique(lists[codes[lists >> (WORD_BITS - TABLE_BITS)] >= often], return_counts=True)
            cells = list(_cut(f, "list", _range_of(lists, ranges), _pack_lines))
            columns = [pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.binary())]
            lengths = [np.stack(counted).astype(np.int64).tobytes() if len(counted[0]) else None]
            columns.append(pa.array(lengths + [None] * (len(cells) - 1), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["range", "payload", "often"])
        release()

    texts = _with_lines(rows.select("_id", "_stretch", "doc_id", "text"), gone, "_copies")
    texts = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = texts.select("_id", F.col("doc_id").cast("long"), "text", "_copies")
    return texts.mapInArrow(post, "range long, payload binary, often binary")


def _range_of(lists: np.ndarray, ranges: int) -> np.ndarray:
    return (lists >> 8) * ranges >> (WORD_BITS - 8)


def _long_lists(posted: DataFrame, ranges: int) -> DataFrame:
    """range and the lists in it that are longer than ``LONG``, with their lengths."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("often").to_pylist():
                lists, n = np.frombuffer(payload, np.int64).reshape(2, -1)
                columns = [pa.array(x) for x in (_range_of(lists, ranges), lists, n)]
                yield pa.RecordBatch.from_arrays(columns, ["range", "list", "n"])

    counted = posted.select("often").filter("often IS NOT NULL").mapInArrow(lengths, "range long, list long, n long")
    long = counted.groupBy("range", "list").agg(F.sum("n").alias("n")).filter(F.col("n") > LONG)
    return long.groupBy("range").agg(F.collect_list(F.struct("list", "n")).alias("long"))


def _grouped(posted: DataFrame, long: DataFrame) -> DataFrame:
    """Packed postings with the group in which they are compared: a range, or two blocks of a long list."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, payload, lists in zip(*(batch.column(c) for c in ("range", "payload", "long")), strict=True):
                r, payload, lists = r.as_py(), payload.as_py(), lists.as_py()
                out: list[tuple[int, int, int, int, bytes]] = []
                if not lists:
                    out.append((r, -1, 0, 0, payload))
                else:
                    fields = _fields(payload)
                    rest = np.flatnonzero(~np.isin(fields["list"], [x["list"] for x in lists]))
                    if len(rest):
                        out.append((r, -1, 0, 0, _pack_lines(fields, rest)))
                    for x in lists:
                        mine = np.flatnonzero(fields["list"] == x["list"])
                        blocks = -(-x["n"] // BLOCK)
                        block = (fields["id"][mine] * 2654435761 + fields["line"][mine] * 40503 >> 7) % blocks
                        for i in np.unique(block).tolist():
                            own = _pack_lines(fields, mine[block == i])
                            out += [(r, x["list"], min(i, j), max(i, j), own) for j in range(blocks)]
                columns = [pa.array([o[k] for o in out], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([o[4] for o in out], pa.binary())], [*_GROUP, "payload"])

    bound = 10_000
    found = long.limit(bound + 1).count()
    if not found:
        whole = {"list": F.lit(-1).cast("long"), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")}
        return posted.withColumns(whole).select(*_GROUP, "payload")
    rows = posted.join(F.broadcast(long) if found <= bound else long, "range", "left")
    return rows.mapInArrow(cut, "range long, list long, i long, j long, payload binary")


_GROUP = ("range", "list", "i", "j")


def _by_length(lists: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys that rise with the lists, and with the lengths inside a list."""
    return lists << 27 | np.minimum(n, 2**27 - 1)


def _joined(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    """All postings of a group by list and length."""
    parts = [_fields(payload) for payload in frame["payload"]]
    fields = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    order = np.argsort(_by_length(fields["list"], fields["n"]), kind="stable")
    return {name: f[order] for name, f in fields.items()}


def _ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, in their order."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)])
    return rank


def _differ(column: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((column[a] ^ column[b]).view(np.uint64))


def _apart(f: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of lines over the bitmaps that both have; at most the size of the symmetric difference."""
    both = np.searchsorted(BITMAPS, np.minimum(f["n"][a], f["n"][b]), "right")
    out = _differ(f["parity"], a, b).astype(np.int64)
    for more in np.unique(both[both > 0]).tolist():
        which = np.flatnonzero(both == more)
        x, y = a[which], b[which]
        cells = [f["parity"][x] ^ f["parity"][y]]
        for name, parent in zip(_MORE[:more], SPLITS, strict=False):
            cells.append(f[name][x] ^ f[name][y])
            cells[parent] = cells[parent] ^ cells[-1]
        out[which] = sum(np.bitwise_count(c.view(np.uint64)).astype(np.int64) for c in cells)
    return out


def _pairs(f: dict[str, np.ndarray], asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of lines and of earlier lines of the same list that pass all filters, and their distance.

    Postings must be in the order of ``_by_length``: a posting meets the stretch before it of the
    lines of its list that are long enough.
    """
    lists, n, place = f["list"], f["n"], f["place"]
    rank = _ranked(f["doc_id"], f["line"])
    room = n * (100 - HUNDREDTHS) // (100 + HUNDREDTHS)  # the two shares of the distance allowed, each less than 1 short
    here = np.arange(len(n))
    low = np.minimum(here, np.searchsorted(_by_length(lists, n), _by_length(lists, _least_overlap(n)), "left"))
    ends = np.cumsum(here - low)
    at = 0
    while at < len(n):
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        counts = (here - low)[at:end]
        a = np.repeat(here[at:end], counts)
        b = np.arange(done, int(ends[end - 1])) - np.repeat(ends[at:end] - counts - low[at:end], counts)
        at = end
        ok = _differ(f["parity"], a, b) <= room[a] + room[b] + 1
        if asks is not None:
            ok &= asks[a] | asks[b]
        a, b = a[ok], b[ok]
        both = n[a] + n[b]
        bound = np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b])
        fine = (bound * (100 + HUNDREDTHS) >= both * HUNDREDTHS) & (rank[a] != rank[b])
        a, b = a[fine], b[fine]
        first = rank[a] < rank[b]
        a, b = np.where(first, b, a), np.where(first, a, b)
        if asks is not None:
            a, b = a[asks[a]], b[asks[a]]
        apart = _apart(f, a, b)
        near = apart * (100 + HUNDREDTHS) <= (n[a] + n[b]) * (100 - HUNDREDTHS)
        yield a[near], b[near], apart[near]


_CANDIDATE = "id long, line int, c_id long, c_line int, apart int, more boolean"


def candidates(grouped: DataFrame) -> DataFrame:
    """The nearest earlier candidates of every line in each of its lists' groups, at most ``KEPT`` each."""

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        f = _joined(frame)
        who = _ranked(f["id"], f["line"])
        at = np.zeros(who.max(initial=-1) + 1, np.int64)
        at[who] = np.arange(len(who))  # some posting of each line
        kept: list[np.ndarray] = [np.zeros((4, 0), np.int64)]
        size = 0
        for a, b, apart in _pairs(f):
            found = np.stack((who[a], who[b], apart, apart * 0))
            kept.append(found)
            size += found.shape[1]
            if size > 200_000:
                kept, size = [_nearest(np.concatenate(kept, 1))], 0
        key, other, apart, more = _nearest(np.concatenate(kept, 1))
        release()
        key, other = at[key], at[other]
        columns = {"id": f["id"][key], "line": f["line"][key], "c_id": f["id"][other], "c_line": f["line"][other]}
        return pd.DataFrame(columns | {"apart": apart, "more": more > 0})

    return grouped.groupBy(*_GROUP).applyInPandas(best, _CANDIDATE)


def _nearest(pairs: np.ndarray) -> np.ndarray:
    """Of each line the ``KEPT`` nearest different candidates; the last row marks lines that had more."""
    pairs = pairs[:, np.lexsort((-pairs[3], pairs[1], pairs[2], pairs[0]))]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])
    marked = pairs[0, pairs[3] > 0]
    pairs = pairs[:, new]
    starts = np.flatnonzero(np.diff(pairs[0], prepend=-1))
    sizes = np.diff(np.append(starts, pairs.shape[1]))
    place = np.arange(pairs.shape[1]) - np.repeat(starts, sizes)
    pairs[3] = (np.repeat(sizes, sizes) > KEPT) | np.isin(pairs[0], marked)
    return pairs[:, place < KEPT]


# ---- verification and removal


def _per_stretch(keys: DataFrame, name: str) -> DataFrame:
    """``_stretch`` with, for each of its rows, the wanted lines (null: none)."""

    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[list[int] | None] = [None] * (1 << STRETCH)
        for row, lines in zip(frame["id"] & ((1 << STRETCH) - 1), frame["lines"], strict=True):
            out[row] = sorted(lines)
        return pd.DataFrame({"_stretch_of": [int(frame["id"].iat[0]) >> STRETCH], name: [out]})

    per_row = keys.groupBy("id").agg(F.collect_set("line").alias("lines"))
    grouped = per_row.groupBy(F.shiftright("id", STRETCH).alias("s"))
    return grouped.applyInPandas(spread, f"_stretch_of long, {name} array<array<int>>")


def _with_lines(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows with the wanted lines of each as ``name``; the texts stay where they are."""
    wanted = _per_stretch(keys, "_wanted").hint("shuffle_hash")
    joined = rows.join(wanted, F.col("_stretch") == F.col("_stretch_of"), "left")
    own = F.get("_wanted", F.col("_id").bitwiseAND((1 << STRETCH) - 1).cast("int"))
    return joined.select(*[F.col(c) for c in rows.columns], own.alias(name))


def line_texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """id, line and words of the wanted lines (keys: id, line)."""
    found = _with_lines(rows.select("_id", "_stretch", "text"), keys, "_lines").filter("_lines IS NOT NULL")
    lines = found.select("_id", F.split("text", "\n").alias("parts"), F.explode("_lines").alias("line"))
    return lines.select(F.col("_id").alias("id"), "line", F.get("parts", F.col("line")).alias("words"))


def _similar(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether the sets of words of two columns of lines are similar, row by row."""
    sides = []
    for side in (left, right):
        hashes, row, _ = hashed_words(side)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        sides.append((hashes[new], row[new]))
    hashes, row = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    twice = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    both = np.bincount(row[1:][twice], minlength=len(left))
    return 100 * both >= HUNDREDTHS * (np.bincount(row, minlength=len(left)) - both)


def verified(pairs: DataFrame, rows: DataFrame, shared: Broadcast) -> DataFrame:
    """id, line and ``more`` of the pairs (id, line, c_id, c_line, more) with ``similar``, on full sets.

    Lines that are not similar and have ``more`` = 2 have their ``lists``, too.
    """
    keys = pairs.select("id", "line").unionByName(pairs.select(F.col("c_id").alias("id"), F.col("c_line").alias("line")))
    texts = stored(line_texts(rows, keys), "line-texts")
    both = pairs.join(texts.withColumnRenamed("words", "left"), ["id", "line"]).join(
        texts.withColumnsRenamed({"id": "c_id", "line": "c_line", "words": "right"}), ["c_id", "c_line"]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2048)):
            similar = pa.array(_similar(batch.column("left"), batch.column("right")))
            asks = pc.and_(pc.invert(similar), pc.equal(batch.column("more"), 2))
            hashes, row, _ = hashed_words(pc.if_else(asks, batch.column("left"), ""))
            hashes, row, n = _distinct(hashes, row, batch.num_rows, codes := np.frombuffer(shared.value, np.uint8))
            listed, _ = _listed(hashes, row, n, codes)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[listed], minlength=batch.num_rows))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_list_of(hashes[listed])))
            columns = [batch.column(c) for c in ("id", "line", "more")]
            yield pa.RecordBatch.from_arrays([*columns, similar, lists], ["id", "line", "more", "similar", "lists"])
        release()

    compared = both.select("id", "line", "more", "left", "right").mapInArrow(
        compare, "id long, line int, more int, similar boolean, lists array<long>"
    )
    out = stored(compared, "line-verified")
    discard(texts)
    return out


#: Bits of a table of marks; Spark's bitmaps have 4096 bytes each.
MARKS = 2**24


def _marks(at: Column, rows: DataFrame) -> bytes:
    """A table of ``MARKS`` bits in which numbers that are not marked are surely not among those ``at`` the rows."""
    at = F.pmod(at, F.lit(MARKS)) + 1
    cells = rows.groupBy(F.bitmap_bucket_number(at)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)))
    table = bytearray(MARKS // 8)
    for bucket, bits in cells.collect():  # at most MARKS bits
        table[(bucket - 1) * 4096 : bucket * 4096] = bits
    return bytes(table)


def _marked(table: bytes, at: np.ndarray) -> np.ndarray:
    at = at % MARKS
    return (np.frombuffer(table, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


_PRIME = 1_000_003  # keeps products of row numbers, which have 33 bits per partition, below 64 bits


def _open_lists(posted: DataFrame, lists: DataFrame) -> DataFrame:
    """The postings of some lists (list), and of few others that a table of marks lets through."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for r, payload in zip(batch.column("range"), batch.column("payload"), strict=True):
                payload = payload.as_py()
                own = np.flatnonzero(_marked(wanted.value, _head(payload, _FIELDS[:1])["list"]))
                if len(own):
                    cells.append((r.as_py(), _pack_lines(_fields(payload), own)))
            columns = [pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["range", "payload"])
        release()

    wanted = posted.sparkSession.sparkContext.broadcast(_marks(F.col("list"), lists))
    return posted.mapInArrow(narrow, "range long, payload binary")


def _mark(ids: np.ndarray, line: np.ndarray) -> np.ndarray:
    return ids % _PRIME * 1009 + line * 10_007 + (ids >> 33)


def remaining(posted: DataFrame, long: DataFrame, open_lines: DataFrame, rows: DataFrame) -> DataFrame:
    """id and line of the open lines (id, line, lists) that have a similar earlier line among all candidates.

    Only their lists are compared again. A first pass keeps the postings of pairs
    that pass the filters; the second has their texts and verifies inside the group, nearest
    candidates first, so that no pairs are written. A table of marks tells which lines ask; the few
    others that it lets through are only asked once more.
    """
    at = F.pmod("id", F.lit(_PRIME)) * 1009 + F.col("line").cast("long") * 10_007 + F.shiftright("id", 33)
    maybe = rows.sparkSession.sparkContext.broadcast(_marks(at, open_lines))
    grouped = _grouped(_open_lists(posted, open_lines.select(F.explode("lists").alias("list"))), long)
    names = (*_FIELDS, "parity", *_MORE)
    fields = ", ".join(f"f_{name} long" for name in names)

    def involved(frame: pd.DataFrame) -> pd.DataFrame:
        f = _joined(frame)
        asks = _marked(maybe.value, _mark(f["id"], f["line"]))
        used = np.zeros(len(asks), bool)
        for a, b, _ in _pairs(f, asks):
            used[a] = used[b] = True
        out = {f"f_{name}": f[name][used] for name in names}
        cell = {k: np.full(int(used.sum()), frame[k].iat[0]) for k in _GROUP}
        release()
        return pd.DataFrame(cell | out | {"asks": asks[used], "id": f["id"][used], "line": f["line"][used]})

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["f_list", "f_n"], kind="stable")
        f = {name: frame[f"f_{name}"].to_numpy() for name in names}
        hashes, row, _ = hashed_words(pa.array(frame["words"], pa.string()))
        sets = [np.unique(h) for h in np.split(hashes, np.searchsorted(row, np.arange(1, len(frame))))]
        similar = np.zeros(len(frame), bool)
        for a, b, apart in _pairs(f, frame["asks"].to_numpy(bool)):
            nearest = np.argsort(apart, kind="stable")
            for x, y in zip(a[nearest].tolist(), b[nearest].tolist(), strict=True):
                if not similar[x]:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    similar[x] = 100 * both >= HUNDREDTHS * (len(sets[x]) + len(sets[y]) - both)
        return pd.DataFrame({"id": f["id"][similar], "line": f["line"][similar]})

    schema = f"range long, list long, i long, j long, {fields}, asks boolean, id long, line int"
    wanted = stored(grouped.groupBy(*_GROUP).applyInPandas(involved, schema), "line-open")
    texts = stored(line_texts(rows, wanted.select("id", "line")), "line-texts")
    found = wanted.join(texts, ["id", "line"]).groupBy(*_GROUP).applyInPandas(verify, "id long, line int")
    found = stored(found.distinct(), "line-late")
    discard(wanted, texts)
    return found


def removed_lines(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """id and line of every line to remove."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, size // 40 // RANGE)
    first = stored(first_pass(rows, max(1, size // 400 // RANGE), least), "line-first-pass")
    gone = stored(copies(first), "line-copies")
    table = rows.sparkSession.sparkContext.broadcast(word_counts(first))
    discard(first)
    posted = kept = stored(postings(rows, gone, table, ranges, least), "line-postings")
    long = stored(_long_lists(posted, ranges), "line-long-lists")
    posted = posted.select("range", "payload")
    found = candidates(_grouped(posted, long)).groupBy("id", "line", "c_id", "c_line").agg(
        F.min("apart").alias("apart"), F.max("more").alias("more")
    )
    found = stored(found, "line-candidates")
    left = F.when(F.max("more"), 2).when(F.count("*") > 1, 1).otherwise(0)  # not kept all, kept others, none
    first = found.groupBy("id", "line").agg(F.min(F.struct("apart", "c_id", "c_line")).alias("best"), left.alias("more"))
    # one candidate settles nearly every line; the others follow where it does not
    best = stored(first.select("id", "line", "best.c_id", "best.c_line", "more"), "line-best")
    checked = [verified(best, rows, table)]
    open_lines = checked[0].filter("NOT similar AND more > 0").select("id", "line", "more", "lists")
    if not open_lines.isEmpty():
        others = found.select("id", "line", "c_id", "c_line").join(best.drop("more"), ["id", "line", "c_id", "c_line"], "left_anti")
        checked.append(verified(others.join(open_lines.drop("lists"), ["id", "line"]), rows, table))
        open_lines = open_lines.filter("more = 2").join(checked[1].filter("similar"), ["id", "line"], "left_anti")
    similar = [c.filter("similar").select("id", "line") for c in checked]
    if not open_lines.isEmpty():
        similar.append(remaining(posted, long, open_lines, rows))
    all_gone = stored(reduce(DataFrame.unionByName, similar, gone), "line-gone")
    discard(gone, kept, long, found, best, *checked)
    return all_gone


def without_lines(
    documents: DataFrame, least: int = LEAST_WORDS, counts: tuple[str, str] = ("_lines", "_removed")
) -> DataFrame:
    """The documents without their later similar lines, with two more columns: lines and removed lines.

    All columns of the documents are carried as they are, whatever their names; ``counts`` names
    the two and must be none of them.
    """
    inner, carried = shielded(documents, "doc_id", "text")
    rows, name = numbered(inner)
    joined = _with_lines(rows, removed_lines(rows, least), "_gone")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, at: ~F.array_contains("_gone", at))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else back for c, back in zip(documents.columns, carried, strict=True)],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(counts[1]),
    )


def remove_lines(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """As ``without_lines``, with the counts as ``n_lines`` and ``n_removed``, in place of such columns."""
    counts = free_name("n_lines", documents), free_name("n_removed", documents)
    done = without_lines(documents, least, counts)
    return done.withColumns({"n_lines": F.col(counts[0]), "n_removed": F.col(counts[1])}).drop(
        *(set(counts) - {"n_lines", "n_removed"})
    )
