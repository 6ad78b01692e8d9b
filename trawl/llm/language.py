"""Language identification by character models with interpolated Kneser-Ney smoothing.

Every word, between two boundary marks, is a sequence of characters. From the words of each language come counts of
character n-grams; orders below the longest count continuations instead, as Kneser and Ney do. The finished
probabilities and back-off weights of all languages lie in arrays sorted by a hash of the n-gram, one set per order, and
a text's cross-entropy under a language is the sum over its words, each scored once however often it stands there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import mix64, remainder, slices, small_batches, texts

ORDER = 4
#: N-grams are told apart by this many bits of their hash within an order, which bounds the model's size:
#: at most ORDER * 2**HASH_BITS entries, whatever the corpus.
HASH_BITS = 20
DISCOUNT = 0.75
UNKNOWN = "und"
#: Rejection threshold on the calibrated probability.
REJECT = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_EDGE = 1


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points between two marks, one after the other, and each position's distance from its word's start."""
    joined = "\x01" + "\x01".join(words) + "\x01"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    edges = np.flatnonzero(points == _EDGE)
    depth = np.arange(len(points)) - edges[np.searchsorted(edges, np.arange(len(points)), side="right") - 1]
    return points, depth


def _hashes(points: np.ndarray, depth: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. order: the positions that end an n-gram, and the n-grams' hashes.

    A position is a character to be predicted: each letter of a word and the mark after it. Its history goes back to the
    mark before the word and no further, so a short history is that of a shorter n-gram.
    """
    ends = np.arange(1, len(points))
    back = np.where(points[1:] == _EDGE, depth[ends - 1] + 1, depth[ends])
    out = []
    hashed = mix64(points[ends] + np.uint64(0x9E3779B97F4A7C15))
    for n in range(1, order + 1):
        if n > 1:
            keep = back >= n - 1
            ends, back, hashed = ends[keep], back[keep], hashed[keep]
            hashed = mix64(hashed * np.uint64(0x100000001B3) + points[ends - (n - 1)] + np.uint64(n))
        out.append((ends, hashed >> np.uint64(64 - bits)))
    return out


@dataclass
class Models:
    """Per order, sorted hashes with a column of probability and of back-off weight by language."""

    languages: list[str]
    order: int
    bits: int
    keys: list[np.ndarray] = field(default_factory=list)
    probability: list[np.ndarray] = field(default_factory=list)
    context_keys: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = 1e-6
    #: Calibration: scale and offset from margin and cross-entropy to probability.
    calibration: tuple[float, float, float] = (0.0, 4.0, 0.0)

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word, nats under each language (with the mark after it), and its number of predicted characters."""
        points, depth = _codes(words)
        k = len(self.languages)
        p = np.full((len(points), k), self.floor, np.float64)
        for n, (ends, hashed) in enumerate(_hashes(points, depth, self.order, self.bits)):
            if n:
                # the history of this n-gram weights what the shorter one said
                at, known = _find(self.context_keys[n - 1], _contexts(points, ends, n, self.bits))
                weight = np.ones((len(ends), k))
                weight[known] = self.backoff[n - 1][at[known]]
                p[ends] *= weight
            at, known = _find(self.keys[n], hashed)
            some = ends[known]
            p[some] += self.probability[n][at[known]]
        nats = -np.log(p)
        nats[0] = 0
        stops = np.flatnonzero(points == _EDGE)
        total = np.add.reduceat(nats, stops[:-1] + 1, axis=0)
        return total, np.diff(stops)


def _contexts(points: np.ndarray, ends: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes of the n characters before each end."""
    hashed = mix64(points[ends - 1] + np.uint64(0xD1B54A32D192ED03))
    for j in range(2, n + 1):
        hashed = mix64(hashed * np.uint64(0x100000001B3) + points[ends - j] + np.uint64(j))
    return hashed >> np.uint64(64 - bits)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _count_ngrams(order: int, bits: int):
    """Counts by language, order, n-gram, history and suffix for a partition's words, each different n-gram a row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                by: dict[int, dict[str, int]] = {}
                for lang, text in zip(part.column("lang_no").to_pylist(), texts(part), strict=True):
                    counts = by.setdefault(lang, {})
                    for w in words_of(text):
                        counts[w] = counts.get(w, 0) + 1
                for lang, counts in by.items():
                    if not counts:
                        continue
                    points, depth = _codes(list(counts))
                    stops = np.flatnonzero(points == _EDGE)
                    times = np.zeros(len(points), np.int64)
                    times[1:] = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), np.diff(stops))
                    grams = _hashes(points, depth, order, bits)
                    for n, (ends, hashed) in enumerate(grams):
                        keys, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
                        sums = np.bincount(inverse, weights=times[ends]).astype(np.int64)
                        history = _contexts(points, ends[first], n, bits).astype(np.int64) if n else np.zeros(len(keys), np.int64)
                        shorter = grams[n - 1] if n else None
                        suffix = shorter[1][np.searchsorted(shorter[0], ends[first])].astype(np.int64) if n else np.full(len(keys), -1)
                        # a gram whose history begins at a mark cannot be extended to the left
                        initial = depth[ends[first] - n] == 0 if n else np.zeros(len(keys), bool)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(keys), lang, np.int32)),
                                pa.array(np.full(len(keys), n, np.int32)),
                                pa.array(keys.astype(np.int64)),
                                pa.array(history),
                                pa.array(suffix),
                                pa.array(initial),
                                pa.array(sums),
                            ],
                            ["lang_no", "n", "gram", "history", "suffix", "initial", "times"],
                        )

    return scan


_NGRAM = "lang_no int, n int, gram long, history long, suffix long, initial boolean, times long"


def train(learning: DataFrame, *, order: int = ORDER, bits: int = HASH_BITS, discount: float = DISCOUNT) -> Models:
    """Models from rows of lang and text, all of them; rows of null lang are left out.

    What comes to the driver is a row for each language and hashed n-gram, whose number HASH_BITS bounds.
    """
    known = learning.filter("lang is not null").select("lang", "text")
    languages = sorted(r[0] for r in known.groupBy("lang").agg(F.count(F.lit(1))).select("lang").collect())
    models = Models(languages, order, bits)
    if not languages:
        return models
    numbers = F.element_at(F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)]), F.col("lang"))
    rows = known.select(numbers.cast("int").alias("lang_no"), F.col("text").cast("string"))
    grams = (
        rows.mapInArrow(_count_ngrams(order, bits), _NGRAM)
        .groupBy("lang_no", "n", "gram")
        .agg(F.min("history").alias("history"), F.min("suffix").alias("suffix"), F.max("initial").alias("initial"), F.sum("times").alias("times"))
        .toPandas()
    )
    k = len(languages)
    alphabet = max(2, grams.loc[grams.n == 0, "gram"].nunique()) + 1
    models.floor = 1.0 / alphabet
    for n in range(order):
        level = grams[grams.n == n]
        counts = level.times.to_numpy(dtype=float)
        if n < order - 1:
            # how many different characters stand before the gram, in place of its count
            above = grams[grams.n == n + 1].groupby(["lang_no", "suffix"]).size()
            wide = above.reindex(pd.MultiIndex.from_arrays([level.lang_no, level.gram]), fill_value=0).to_numpy(dtype=float)
            counts = np.where(level.initial.to_numpy() | (wide == 0), counts, wide)
        keys, where = np.unique(level.gram.to_numpy(), return_inverse=True)
        lang = level.lang_no.to_numpy()
        contexts, context = np.unique(level.history.to_numpy(), return_inverse=True)
        total, different = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
        np.add.at(total, (context, lang), counts)
        np.add.at(different, (context, lang), 1.0)
        probability = np.zeros((len(keys), k))
        np.add.at(probability, (where, lang), np.maximum(counts - discount, 0) / total[context, lang])
        backoff = np.where(total > 0, discount * different / np.maximum(total, 1), 1.0)
        models.keys.append(keys.astype(np.uint64))
        models.probability.append(probability)
        if n:
            models.context_keys.append(contexts.astype(np.uint64))
            models.backoff.append(backoff)
        else:
            unseen = backoff[0] if len(backoff) else np.ones(k)
            models.floor = float(unseen.mean()) / alphabet
    return models


_COSTS = "doc_id long, held_out boolean, lang_no int, best int, margin double, entropy double, letters long"


def _costs(rows: DataFrame, models: Models) -> DataFrame:
    """For each row the cheapest language, its length-normalised cross-entropy, and the runner-up's distance."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = max(1, len(models.languages))
        for batch in batches:
            for part in slices(batch, "text"):
                found = [words_of(t) for t in texts(part)]
                ids: dict[str, int] = {}
                index = np.fromiter((ids.setdefault(w, len(ids)) for x in found for w in x), np.int64)
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                total, size = np.zeros((len(found), k)), np.zeros(len(found), np.int64)
                if len(index) and models.languages:
                    nats, chars = models.costs(list(ids))
                    owner = np.repeat(np.arange(len(found)), lengths)
                    for j in range(k):
                        total[:, j] = np.bincount(owner, weights=nats[index, j], minlength=len(found))
                    size = np.bincount(owner, weights=chars[index], minlength=len(found)).astype(np.int64)
                mean = total / np.maximum(size, 1)[:, None]
                order = np.argsort(mean, axis=1, kind="stable")
                rows_ = np.arange(len(found))
                best = order[:, 0]
                entropy = mean[rows_, best]
                margin = mean[rows_, order[:, 1]] - entropy if k > 1 else np.ones(len(found))
                best = np.where(size > 0, best, -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("lang_no"), pa.array(best.astype(np.int32)), pa.array(margin), pa.array(entropy), pa.array(size)],
                    ["doc_id", "held_out", "lang_no", "best", "margin", "entropy", "letters"],
                )

    return rows.select("doc_id", "held_out", "lang_no", "text").mapInArrow(scan, _COSTS)


def calibrate(points: pd.DataFrame, steps: int = 200) -> tuple[float, float, float]:
    """Logistic regression of being right on log-margin and log-length, by Newton steps over counted cells."""
    x = np.column_stack([np.ones(len(points)), points["m"].to_numpy(dtype=float), points["l"].to_numpy(dtype=float)])
    good, n = points["good"].to_numpy(dtype=float) + 0.5, points["n"].to_numpy(dtype=float) + 1
    w = np.array([0.0, 1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (good - n * p) - 1e-2 * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w)


def identify(docs: DataFrame, *, order: int = ORDER, bits: int = HASH_BITS, reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, entropy for every row of docs.

    Learns from text and non-null lang of documents whose crc32(doc_id as text) mod 4 is not 2. A text without letters,
    a null text, and any text when no language was learned, is `und` with score 0. Ties go to the first language by
    name. `rejected` marks predictions whose calibrated probability is below `reject`; the prediction stays.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
    )
    models = train(rows.filter("not held_out"), order=order, bits=bits)
    pairs = [F.lit(x) for i, lang in enumerate(models.languages) for x in (lang, i)]
    number = F.element_at(F.create_map(*pairs), F.col("lang")).cast("int") if pairs else F.lit(None).cast("int")
    costs = _costs(rows.withColumn("lang_no", number), models).persist(StorageLevel.MEMORY_AND_DISK)
    m = F.log(F.greatest(F.col("margin"), F.lit(1e-4)))
    n_letters = F.log(F.col("letters").cast("double"))
    seen = costs.filter("not held_out and best >= 0 and lang_no is not null")
    cells = seen.groupBy(F.round(m, 1).alias("m"), F.round(n_letters, 1).alias("l")).agg(F.sum((F.col("best") == F.col("lang_no")).cast("int")).alias("good"), F.count(F.lit(1)).alias("n"))
    points = cells.toPandas()  # cells of a fixed grid
    a, b, c = calibrate(points) if len(points) else (0.0, 1.0, 0.0)
    names = F.element_at(F.create_map(*[F.lit(x) for i, lang in enumerate(models.languages) for x in (i, lang)]), F.col("best")) if models.languages else F.lit(None).cast("string")
    chance = 1 / (1 + F.exp(-(a + b * m + c * n_letters)))
    some = F.col("best") >= 0
    scored = costs.select(
        "doc_id",
        "held_out",
        F.when(some, names).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(some, chance).otherwise(0.0).alias("score"),
        "entropy",
    )
    return scored.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), "score", (F.col("score") < reject).alias("rejected"), "entropy")
