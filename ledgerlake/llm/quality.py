"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``: the last
term, the sum-of-squares identity, has all pairwise interactions in time linear in the features.

The model is fitted on labelled documents only, at most ``SAMPLE`` of them (those with the smallest
hash of their id; one row of each id, that with the smallest hash of its text), in one task that
holds no more than that sample. Every document is scored over its
whole text in Arrow batches; the model that tasks get has a fixed size.

Defined cases: null and empty texts have no words and are scored by their statistics; null labels
and labels without a document are not learnt; of several labels of one document the lowest counts;
without any label nothing is known against a document and every score is 1.
"""

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.words import WordHashes, free_name, words_of

SAMPLE = 10_000
BUCKETS = 4096
FACTORS = 8
EPOCHS = 15
BATCH = 128
RATE = 0.02
SHRINK_WORDS, SHRINK = 2e-4, 1e-4
KEEP = 0.7

_CLASSES = (b"#$%&*+=~^@", b"!?", b"|<>{}[]\\/_", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:")
STATISTICS = len(_CLASSES) + 12


@lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes()


def statistics(text: str, words: list[str], ids: np.ndarray, n_chars: int | None) -> np.ndarray:
    """Structure of a text, and its stated length as the only metadata."""
    out = np.zeros(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, size = len(words), max(1, len(raw))
    count = np.bincount(raw, minlength=256) / size
    out[: len(_CLASSES)] = [count[list(c)].sum() for c in _CLASSES]
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    _, repeats = np.unique(ids, return_counts=True)
    same = np.flatnonzero(ids[1:] != ids[:-1]) if n > 1 else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate(([-1], same, [n - 1]))) if n else np.zeros(1)
    out[len(_CLASSES) :] = (
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        len(repeats) / max(1, n),
        (repeats.max() if n else 0) / max(1, n),
        runs.max() / max(1, n),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        count[128:].sum(),
        np.log1p(max(0, n_chars if n_chars is not None else len(text))),
        float(n_chars is not None and n_chars != len(text)),
    )
    return out


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words (bucket, weight; of length one as a vector) and statistics of one document."""
    words = words_of(text)
    ids = _hashes().of(words)
    buckets, counts = np.unique(ids % np.uint64(BUCKETS), return_counts=True)
    weight = np.log1p(counts)
    norm = np.sqrt((weight**2).sum())
    return buckets.astype(np.int64), weight / (norm or 1.0), statistics(text or "", words, ids, n_chars)


class Machine:
    """Parameters of the factorisation machine and the scaling of its statistics."""

    def __init__(self, stats: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-3
        size = BUCKETS + STATISTICS
        self.bias, self.linear = 0.0, np.zeros(size)
        self.factors = rng.normal(0, 0.02, (size, FACTORS))

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATISTICS)

    def vector(self, buckets: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.concatenate((buckets, np.arange(BUCKETS, BUCKETS + STATISTICS)))
        return index, np.concatenate((weight, self.scaled(stats)))

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[index]
        total = x @ v
        return float(self.bias + self.linear[index] @ x + 0.5 * ((total**2).sum() - ((x**2) @ (v**2)).sum()))

    def score(self, text: str | None, n_chars: int | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*self.vector(*features(text, n_chars))), -30, 30))))

    def fit(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> "Machine":
        """Minibatch gradient steps with per-parameter scaling of the log loss."""
        rng = np.random.default_rng(seed)
        shrink = np.full(BUCKETS + STATISTICS, SHRINK)
        shrink[:BUCKETS] = SHRINK_WORDS
        seen_bias, seen_linear, seen_factors = 1e-8, np.full_like(self.linear, 1e-8), np.full_like(self.factors, 1e-8)
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch / 5)
            order = rng.permutation(len(vectors))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                index = np.concatenate([vectors[r][0] for r in rows])
                x = np.concatenate([vectors[r][1] for r in rows])
                lengths = [len(vectors[r][0]) for r in rows]
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                row = np.repeat(np.arange(len(rows)), lengths)
                v = self.factors[index]
                xv = x[:, None] * v
                total = np.add.reduceat(xv, starts)
                margin = self.bias + np.add.reduceat(self.linear[index] * x, starts)
                margin = margin + 0.5 * (total**2 - np.add.reduceat(xv**2, starts)).sum(1)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
                per = error[row] * x
                used, where = np.unique(index, return_inverse=True)
                d_linear = np.bincount(where, per, len(used)) + shrink[used] * self.linear[used]
                d_v = per[:, None] * (total[row] - xv)
                d_factors = np.stack([np.bincount(where, d_v[:, f], len(used)) for f in range(FACTORS)], 1)
                d_factors += shrink[used, None] * self.factors[used]
                d_bias = error.sum()
                seen_bias += d_bias**2
                seen_linear[used] += d_linear**2
                seen_factors[used] += d_factors**2
                self.bias -= rate * 5 * d_bias / np.sqrt(seen_bias)
                self.linear[used] -= rate * 5 * d_linear / np.sqrt(seen_linear[used])
                self.factors[used] -= rate * d_factors / np.sqrt(seen_factors[used])
        return self


def learnable(doc_id: Column) -> Column:
    """Whether a document's label may be learnt: three quarters by checksum of the id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def learnt(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, n_chars and quality of at most ``sample`` labelled documents, one row of each id."""
    wanted = (
        labels.filter(F.col("quality").isin(0, 1) & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    # one row of every id, known by hashes alone; the bound counts documents
    named = documents.select("doc_id", F.xxhash64("text", "n_chars").alias("_text"))
    chosen = (
        named.join(wanted, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("_text").alias("_text"), F.first("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    found = documents.select("doc_id", "text", "n_chars").withColumn("_text", F.xxhash64("text", "n_chars"))
    rows = found.join(F.broadcast(chosen), ["doc_id", "_text"])
    # rows that are equal in all of this are one
    return rows.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("text", "n_chars", "quality")])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """The fitted model, pickled, from at most ``sample`` labelled documents; None without any."""
    rows = learnt(documents, labels, sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                features(t, n)
                for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)
            ]
            packed = pa.array([pickle.dumps(m) for m in made], pa.binary())
            columns = [batch.column("doc_id"), batch.column("quality"), packed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "features"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = rows.select("doc_id", "quality", "text", "n_chars").mapInArrow(
        extract, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, features binary"
    )

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        vectors = [pickle.loads(f) for f in frame["features"]]
        machine = Machine(np.stack([s for _, _, s in vectors]))
        machine.fit([machine.vector(*v) for v in vectors], frame["quality"].to_numpy(float))
        return pd.DataFrame({"model": [pickle.dumps(machine)]})

    # one group, of at most ``sample`` rows
    model = made.groupBy(F.lit(1).alias("all")).applyInPandas(train, "model binary").first()
    return bytes(model[0]) if model else None


def score(documents: DataFrame, model: bytes | None, name: str = "score") -> DataFrame:
    """All columns of ``documents`` with the score (0 to 1; higher: better) as column ``name``."""
    if model is None:
        return documents.withColumn(name, F.lit(1.0))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        machine = pickle.loads(shared.value)
        for text, n_chars in parts:
            chars = [None if pd.isna(n) else int(n) for n in n_chars]
            yield pd.Series([machine.score(t, n) for t, n in zip(text, chars, strict=True)], dtype="float64")

    return documents.withColumn(name, scored("text", "n_chars"))


def classify(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    narrow = documents.select("doc_id", "text", "n_chars")
    scored = score(narrow, fit(narrow, labels))
    return scored.select(
        "doc_id",
        F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= keep).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that the classifier does not reject, all columns as they were."""
    name = free_name("_quality", documents)
    scored = score(documents, fit(documents, labels), name)
    return scored.filter(F.col(name) >= keep).drop(name)
