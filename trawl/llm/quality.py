"""Document quality by ridge regression on random Fourier features, calibrated by isotonic regression.

Every text gives a short vector of statistics. Standardised, it is lifted by random cosines whose inner products
approximate a Gaussian kernel. Partitions sum their part of the normal equations, the sums meet in a tree, and the ridge
solution scores every document. A held-back fold of the learning rows gives the isotonic map from score to probability.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import remainder, slices, small_batches, texts

FEATURES = 256
RIDGE = 1e-3
SEED = 29
#: Scores are counted on a grid of this many steps between the learning scores -1 and 2 before they are calibrated.
GRID = 6000
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "log_longest", "letters", "upper", "digits", "spaces", "stops",
    "symbols", "non_ascii", "distinct_words", "top_word", "log_line", "repeated_lines", "capital_words", "short_words", "odd_words", "pairs_repeated",
)
_ARRAY = "array<double>"


def _of_bytes(*groups: bytes) -> np.ndarray:
    found = np.zeros(256)
    for g in groups:
        found[list(g)] = 1
    return found


_LETTERS = bytes([*range(65, 91), *range(97, 123)])
#: By byte value: classes whose shares are statistics.
_CLASSES = np.stack(
    [
        _of_bytes(_LETTERS),
        _of_bytes(bytes(range(65, 91))),
        _of_bytes(b"0123456789"),
        _of_bytes(b" \t\n\r\x0b\x0c"),
        _of_bytes(b".,;:'\"?"),
        _of_bytes(bytes(b for b in range(33, 127) if b not in _LETTERS + b"0123456789.,;:'\"?")),
        _of_bytes(bytes(range(128, 256))),
    ]
)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, all finite, also for an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = _CLASSES @ np.bincount(raw, minlength=256) / max(1, len(raw))
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int32, n) if n else np.zeros(1, np.int32)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    lines = text.split("\n")
    return [
        np.log1p(len(text)),
        np.log1p(n),
        float(lengths.mean()),
        np.log1p(float(lengths.max())),
        *shares.tolist(),
        len(counts) / max(1, n),
        max(counts.values(), default=0) / max(1, n),
        np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(w.isupper() for w in words) / max(1, n),
        float((lengths <= 3).mean()),
        sum(not w.isalnum() for w in words) / max(1, n),
        1 - pairs / max(1, n - 1),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and stats (an array of doubles) for every row; null texts count as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [statistics(t) for t in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, f"doc_id long, stats {_ARRAY}")


@dataclass
class Lift:
    """Standardisation and random cosines."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, features: int, seed: int) -> Lift:
        rng = np.random.default_rng(seed)
        width = np.sqrt(len(mean))
        return cls(mean, scale, rng.normal(size=(len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features))

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        flat = np.clip((stats - self.mean) / self.scale, -8, 8)
        cosines = np.cos(flat @ self.weights + self.phases) * np.sqrt(2 / self.weights.shape[1])
        return np.hstack([cosines, flat, np.ones((len(flat), 1))])


def _pack(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def _unpack(b: bytes) -> np.ndarray:
    return np.load(io.BytesIO(b))


def _summed(parts: DataFrame, fan_in: int = 32) -> np.ndarray | None:
    """The sum of arrays packed in a column `packed`, met in a tree of bounded fan-in; None without rows."""
    width = parts.rdd.getNumPartitions()

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for b in group["packed"]:
            total = _unpack(b) if total is None else total + _unpack(b)
        return pd.DataFrame({"packed": [_pack(total)]})

    while width > fan_in:
        width = -(-width // fan_in)
        parts = parts.withColumn("slot", F.pmod(F.xxhash64(F.col("part")), F.lit(width))).groupBy("slot").applyInPandas(add, "packed binary")
        parts = parts.withColumn("part", F.monotonically_increasing_id())
    total = None
    for row in parts.select("packed").collect():  # at most fan_in arrays of fixed size
        total = _unpack(bytes(row[0])) if total is None else total + _unpack(bytes(row[0]))
    return total


def _moments(rows: DataFrame) -> np.ndarray | None:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                x = np.stack(f["stats"])
                part = np.stack([np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0)])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"packed": [_pack(total)]})

    return _summed(rows.select("stats").mapInPandas(scan, "packed binary").withColumn("part", F.spark_partition_id()))


def _normal_equations(rows: DataFrame, lift: Lift) -> np.ndarray | None:
    """[Phi'Phi | Phi'y] over the rows, summed by partition."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for at in range(0, len(f), 2048):
                part = f.iloc[at : at + 2048]
                phi = lift(np.stack(part["stats"]))
                y = part["quality"].to_numpy(dtype=float)[:, None]
                here = phi.T @ np.hstack([phi, y])
                total = here if total is None else total + here
        if total is not None:
            yield pd.DataFrame({"packed": [_pack(total)]})

    return _summed(rows.select("stats", "quality").mapInPandas(scan, "packed binary").withColumn("part", F.spark_partition_id()))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in rising x: the blocks' mean x and their rising values."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


@dataclass
class Model:
    lift: Lift | None
    weights: np.ndarray | None
    at: np.ndarray
    value: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        if self.lift is None:
            return np.full(len(stats), self.value[0])
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def _scored(rows: DataFrame, score, kept: list[str], name: str) -> DataFrame:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f[kept].assign(**{name: np.concatenate([score(np.stack(f["stats"].iloc[a : a + 4096])) for a in range(0, len(f), 4096)])})

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "stats").mapInPandas(scan, f"{types}, {name} double")


def fit(learning: DataFrame, *, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model from rows of stats, quality (0 or 1) and fold; fold 4 calibrates, the others fit the weights.

    Without rows of both labels the score is the share of label 1, or 0.5 if there is none at all.
    """
    fitting, held = learning.filter("fold <> 4"), learning.filter("fold = 4")
    seen = fitting.agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("mean")).first()
    if not seen["n"] or seen["mean"] in (0, 1):
        return Model(None, None, np.zeros(1), np.array([0.5 if not seen["n"] else float(seen["mean"])]))
    n, total, squares = _moments(fitting)
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1
    lift = Lift.draw(mean, scale, features, seed)
    sums = _normal_equations(fitting, lift)
    gram, target = sums[:, :-1], sums[:, -1]
    weights = np.linalg.solve(gram + ridge * seen["n"] / len(gram) * np.eye(len(gram)) + 1e-8 * np.eye(len(gram)), target)
    model = Model(lift, weights, np.zeros(1), np.zeros(1))
    step = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) * (GRID / 3)).cast("int")
    points = _scored(held, model.raw, ["quality"], "raw").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("w"), F.avg("quality").alias("y")).toPandas()
    if not len(points):
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    points = points.sort_values("step")
    model.at, model.value = isotonic(points["step"].to_numpy() * (3 / GRID), points["y"].to_numpy(), points["w"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Labels are learned only from documents whose crc32(doc_id as text) mod 5 is not 0. A document with several labels
    counts with their mean; labels that are null or name no document are left out. Repeated rows score alike. Only
    doc_id, text, labels.doc_id and labels.quality are read.
    """
    stats = describe(docs).withColumn("fold", remainder(F.col("doc_id"), 5)).persist(StorageLevel.MEMORY_AND_DISK)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    marks = marks.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    learning = stats.filter("fold > 0").join(marks, "doc_id").select("fold", "stats", "quality").persist(StorageLevel.MEMORY_AND_DISK)
    model = fit(learning)
    scored = _scored(stats, model.probability, ["doc_id", "fold"], "score")
    return scored.select(
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose calibrated score reaches the threshold.

    Learns as `score` does. The texts are described again for the decision, so they are never shuffled.
    """
    stats = describe(docs).withColumn("fold", remainder(F.col("doc_id"), 5))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    marks = marks.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    model = fit(stats.filter("fold > 0").join(marks, "doc_id").select("fold", "stats", "quality").persist(StorageLevel.MEMORY_AND_DISK))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                good = model.probability(np.array([statistics(t) for t in texts(part)])) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(scan, docs.schema)
