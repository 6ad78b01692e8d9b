"""Scoring of documents by the likelihood of their subword lattices.

The pieces and the order of an existing vocabulary give every piece a first weight; expected counts over the words of
the corpus refine the weights (the pieces stay as they are). A word's probability is the sum over all its segmentations,
by a forward recursion in log space. Words that the corpus holds have an arc of their own through the lattice, with
their discounted frequency; what the discount takes off goes to the pieces. No piece crosses white space, so the
probability of a document is the product of those of its words and of one end, and its marginal probability is the
weighted sum of that over a few hidden classes, each with weights of its own, learned from the languages of the
training documents. What is scored is always the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import remainder, slices, small_batches

#: Rounds of expected counts.
ROUNDS = 2
#: Pseudo-counts that the vocabulary's own order keeps.
PRIOR = 100.0
#: Bytes of text in a chunk of documents, which bounds a task's memory, and different words that a counting task keeps.
CHUNK_BYTES = 40 << 20
KEEP_WORDS = 500_000
#: Hidden classes at most; languages beyond the most frequent share the last one.
CLASSES = 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_START = "▁"
_HASH = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but space and the control characters 9 to 13."""
    return text.translate(_LOWER).split()


def _piece_hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = (h + np.uint64(c) + np.uint64(1)) * _HASH
        h ^= h >> np.uint64(29)
    return h[0]


@dataclass
class Pieces:
    """Pieces by length: sorted hashes with piece numbers; single characters and bytes by table; log weights."""

    hashes: list[np.ndarray]
    numbers: list[np.ndarray]
    single: np.ndarray
    byte: np.ndarray
    prior: np.ndarray

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        rank = np.array([-model.get_score(i) for i in range(n)])
        prior = 1.0 / (100.0 + np.maximum(rank, 0))
        by: dict[int, list[tuple[np.uint64, int]]] = {}
        single = np.full(0x110000, -1, np.int32)
        byte = np.full(256, -1, np.int64)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte[int(piece[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or _START in piece[1:]:
                prior[i] = 0
            elif len(piece) == 1:
                single[ord(piece)] = i
            else:
                by.setdefault(len(piece), []).append((_piece_hash([ord(c) for c in piece]), i))
        hashes, numbers = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int64)] * 2
        for length in range(2, max(by) + 1):
            rows = sorted(by.get(length, []))
            hashes.append(np.array([h for h, _ in rows], np.uint64))
            numbers.append(np.array([i for _, i in rows], np.int64))
        prior = prior / prior.sum()
        return cls(hashes, numbers, single, byte, prior)

    def weights(self, counts: np.ndarray | float = 0.0) -> np.ndarray:
        """Log weights after expected counts, with the vocabulary's own order as a prior."""
        p = counts + PRIOR * self.prior
        return np.log(np.maximum(p / p.sum(), 1e-300))


def _matrices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of like length together: their places, their lengths, and their characters after a start mark, 0 beyond."""
    strings = [_START + w.decode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        low = int(sizes[order[at]])
        high = low if low <= 24 else low + low // 4
        to = int(np.searchsorted(sizes[order], high, side="right"))
        to = min(to, at + max(1, 200_000 // high))
        own = order[at:to]
        width = int(sizes[own[-1]])
        flat = "".join(strings[i].ljust(width, "\0") for i in own)
        yield own, sizes[own], np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32).reshape(len(own), width)
        at = to


@dataclass
class Arcs:
    """Piece numbers by length of arc and start (-1: none), and what stands in for characters without a piece."""

    numbers: list[np.ndarray]
    inside: np.ndarray
    odd: np.ndarray
    odd_bytes: list[list[int]]

    @classmethod
    def of(cls, pieces: Pieces, chars: np.ndarray, sizes: np.ndarray) -> Arcs:
        width = chars.shape[1]
        inside = np.arange(width)[None, :] < sizes[:, None]
        number = pieces.single[chars]
        strange = inside & (number < 0)
        odd = np.full(chars.shape, -1, np.int64)
        odd_bytes: list[list[int]] = []
        if strange.any():
            codes, where = np.unique(chars[strange], return_inverse=True)
            odd[strange] = where
            odd_bytes = [pieces.byte[list(chr(c).encode("utf-8", "replace"))].tolist() for c in codes.tolist()]
        numbers = [np.where(inside, number, -1)]
        wide = chars.astype(np.uint64) + np.uint64(1)
        hashed = wide * _HASH
        hashed ^= hashed >> np.uint64(29)
        for length in range(2, min(width, len(pieces.hashes) - 1) + 1):
            hashed = (hashed[:, :-1] + wide[:, length - 1 :]) * _HASH
            hashed ^= hashed >> np.uint64(29)
            keys = pieces.hashes[length]
            number = np.full(hashed.shape, -1, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashed.ravel()), len(keys) - 1).reshape(hashed.shape)
                number = np.where(keys[at] == hashed, pieces.numbers[length][at], -1)
            numbers.append(number)
        return cls(numbers, inside, odd, odd_bytes)

    def weighted(self, logp: np.ndarray) -> list[np.ndarray | None]:
        """Log weights of the arcs by length; None where no word has an arc of the length."""
        padded = np.append(logp, -np.inf)
        out: list[np.ndarray | None] = [padded[n] if (n >= 0).any() else None for n in self.numbers]
        if self.odd_bytes:
            by_code = np.array([logp[b].sum() for b in self.odd_bytes])
            first = out[0] if out[0] is not None else np.full(self.odd.shape, -np.inf)
            out[0] = np.where(self.odd >= 0, by_code[self.odd], first)
        return out


def _forward(weights: list[np.ndarray | None], rows: int, width: int) -> np.ndarray:
    alpha = np.full((rows, width + 1), -np.inf)
    alpha[:, 0] = 0
    for j in range(1, width + 1):
        total = np.full(rows, -np.inf)
        for length in range(1, min(j, len(weights)) + 1):
            if weights[length - 1] is not None:
                total = np.logaddexp(total, alpha[:, j - length] + weights[length - 1][:, j - length])
        alpha[:, j] = total
    return alpha


def _backward(weights: list[np.ndarray | None], sizes: np.ndarray, width: int) -> np.ndarray:
    beta = np.full((len(sizes), width + 1), -np.inf)
    beta[np.arange(len(sizes)), sizes] = 0
    for i in range(width - 1, -1, -1):
        total = beta[:, i]
        for length in range(1, min(width - i, len(weights)) + 1):
            if weights[length - 1] is not None:
                total = np.logaddexp(total, weights[length - 1][:, i] + beta[:, i + length])
        beta[:, i] = total
    return beta


def word_log_probability(words: list[bytes], pieces: Pieces, logps: list[np.ndarray]) -> np.ndarray:
    """Natural log of the sum over all segmentations of each word, a column for each set of weights."""
    out = np.zeros((len(words), len(logps)))
    for own, sizes, chars in _matrices(words):
        arcs = Arcs.of(pieces, chars, sizes)
        for k, logp in enumerate(logps):
            out[own, k] = _forward(arcs.weighted(logp), len(own), chars.shape[1])[np.arange(len(own)), sizes]
    return out


def expected_counts(words: list[bytes], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece when every different word is written once."""
    counts = np.zeros(len(pieces.prior))
    for own, sizes, chars in _matrices(words):
        width = chars.shape[1]
        arcs = Arcs.of(pieces, chars, sizes)
        weights = arcs.weighted(logp)
        alpha, beta = _forward(weights, len(own), width), _backward(weights, sizes, width)
        whole = alpha[np.arange(len(own)), sizes][:, None]
        for length, (w, number) in enumerate(zip(weights, arcs.numbers, strict=True), 1):
            used = number >= 0
            if w is not None and used.any():
                share = (alpha[:, : w.shape[1]] + w + beta[:, length : length + w.shape[1]] - whole)[used]
                counts += np.bincount(number[used], weights=np.exp(share), minlength=len(counts))
        if arcs.odd_bytes:
            times = np.bincount(arcs.odd[arcs.odd >= 0], minlength=len(arcs.odd_bytes))
            for ids, k in zip(arcs.odd_bytes, times, strict=True):
                np.add.at(counts, ids, k)
    return counts


def _binary(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(column).to_pylist()]


def _count_words(classes: int):
    """Different words by class with their counts; words that only held-out documents hold have class -1 and count 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: list[dict[bytes, int]] = [{} for _ in range(classes)]
        held: set[bytes] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            for k, counts in enumerate(by):
                held.difference_update(counts)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([k] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "class", "c"])
                counts.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([-1] * len(held), pa.int32()), pa.array([0] * len(held), pa.int64())], ["word", "class", "c"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "raw"):
                for k, raw in zip(part.column("class").to_pylist(), _binary(part, "raw"), strict=True):
                    if k < 0:
                        held.update(tokens(raw))
                        continue
                    counts = by[k]
                    for w in tokens(raw):
                        counts[w] = counts.get(w, 0) + 1
                if len(held) + sum(map(len, by)) > KEEP_WORDS:
                    yield from flush()
        yield from flush()

    return scan


def _refine(words: DataFrame, pieces: Pieces, logps: list[np.ndarray]) -> list[np.ndarray]:
    """One round for each class: expected counts of all its training words, summed over partitions by piece."""
    classes = len(logps)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, len(pieces.prior)))
        for batch in batches:
            found = _binary(batch, "word")
            for k in range(classes):
                own = np.flatnonzero(batch.column(f"c{k}").to_numpy() > 0)
                if len(own):
                    total[k] += expected_counts([found[i] for i in own], pieces, logps[k])
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece), pa.array(total[k, piece])], ["class", "piece", "n"])

    sums = words.mapInArrow(scan, "class int, piece long, n double").groupBy("class", "piece").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((classes, len(pieces.prior)))
    counts[sums["class"].to_numpy(dtype=np.int64), sums["piece"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy()
    return [pieces.weights(c) for c in counts]


_CHUNK_WORDS = "chunk long, at int, word binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _chunk_words(group: pa.Table) -> pa.Table:
    found: set[bytes] = set()
    for batch in group.select(["raw"]).to_batches():
        for part in slices(batch, "raw"):
            for raw in _binary(part, "raw"):
                found.update(tokens(raw))
    words = sorted(found)
    chunk = group.column("chunk")[0].as_py() if group.num_rows else 0
    return pa.table({"chunk": pa.array(np.full(len(words), chunk, np.int64)), "at": pa.array(np.arange(len(words), dtype=np.int32)), "word": pa.array(words, pa.binary())})


def _score_chunk(base_end: float, end_known: bool, ends: np.ndarray, shares: np.ndarray):
    def score(docs: pa.Table, values: pa.Table) -> pa.Table:
        at = values.column("at").to_numpy()
        known, base, logp = np.zeros(len(at), bool), np.zeros(len(at)), np.zeros((len(at), len(ends)))
        known[at] = values.column("known").to_numpy()
        base[at] = values.column("base").to_numpy()
        for batch in values.select(["at", "logp"]).to_batches():
            if batch.num_rows:
                logp[batch.column("at").to_numpy()] = np.frombuffer(b"".join(batch.column("logp").to_pylist()), np.float32).reshape(-1, len(ends))
        found: set[bytes] = set()
        parts = [p for b in docs.to_batches() for p in slices(b, "raw")]
        for p in parts:
            for raw in _binary(p, "raw"):
                found.update(tokens(raw))
        place = {w: i for i, w in enumerate(sorted(found))}
        del found
        rows = []
        for p in parts:
            for raw in _binary(p, "raw"):
                words = tokens(raw)
                i = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                by_class = logp[i].sum(0) + ends + shares
                rows.append((len(words) + 1, int(known[i].sum()) + end_known, float(base[i].sum()) + base_end, float(np.logaddexp.reduce(by_class))))
        n_tokens, n_known, base_score, total = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(np.array(total) / np.log(10), pa.float64()),
            }
        )

    return score


def score(docs: DataFrame, vocabulary: str, *, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from documents whose crc32(doc_id as text) mod 7 is not 2: from their text and, for the hidden classes, their
    lang if there is such a column (null: a class like any other). A text is its words and one end; a null text is
    empty, so only an end. Scores are log10 probabilities. Repeated rows count and score each; without training
    documents the pieces' first weights stand alone. Only doc_id, text and lang are read.
    """
    small_batches(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (remainder(F.col("doc_id"), 7) == 2).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"),
        F.coalesce(lang, F.lit("")).alias("tongue"),
    )
    sizes = rows.groupBy("held_out", "tongue").agg(F.sum(F.length("raw")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    total_bytes = sizes.agg(F.sum("bytes")).first()[0] or 0
    most = sizes.filter("not held_out").orderBy(F.desc("n"), "tongue").limit(CLASSES).collect()
    documents = np.array([r["n"] for r in most] or [0], float)
    training = sizes.filter("not held_out").agg(F.sum("n")).first()[0] or 0
    documents[-1] += training - documents.sum()
    classes = len(documents)
    number = F.coalesce(*[F.when(F.col("tongue") == r["tongue"], k) for k, r in enumerate(most)], F.lit(classes - 1))
    training_rows = rows.select(F.when(F.col("held_out"), -1).otherwise(number).alias("class"), "raw")
    sums = [F.sum(F.when(F.col("class") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    words = training_rows.mapInArrow(_count_words(classes), "word binary, class int, c long").groupBy("word").agg(*sums).persist(StorageLevel.MEMORY_AND_DISK)

    def seen(of, k: int) -> list:
        c = F.col(f"c{k}") if k >= 0 else sum((F.col(f"c{j}") for j in range(1, classes)), F.col("c0"))
        return [F.sum(c).alias(f"n_{of}"), *(F.sum(F.when(t, 1).otherwise(0)).alias(f"{name}_{of}") for name, t in (("v", c > 0), ("once", c == 1), ("twice", c == 2)))]

    counted = words.agg(*seen("all", -1), *(x for k in range(classes) for x in seen(k, k))).first().asDict()
    got = lambda name: np.array([counted[f"{name}_{k}"] or 0 for k in range(classes)], float)
    n, v = (counted["n_all"] or 0) + training, (counted["v_all"] or 0) + (training > 0)
    tokens_in, once, twice = got("n") + documents, got("once"), got("twice")
    different = got("v") + (documents > 0)
    discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
    size = np.maximum(tokens_in, 1)
    end_share = np.where(tokens_in > 0, documents / size, 0.5)
    left = np.where(tokens_in > 0, discount * different / size, 1.0)
    shares = np.log((documents + 1) / (documents.sum() + classes))
    pieces = Pieces.load(vocabulary)
    logps = [pieces.weights()] * classes
    if counted["v_all"]:
        for _ in range(rounds):
            logps = _refine(words, pieces, logps)
    ends = np.log(np.maximum(np.maximum(documents - discount, 0) / size + left * end_share, 1e-300))
    down = float(n + v + 1)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([batch.column(f"c{k}").to_numpy() for k in range(classes)], axis=1)
            inner = word_log_probability(_binary(batch, "word"), pieces, logps) + np.log(np.maximum(left * (1 - end_share), 1e-300))
            with np.errstate(divide="ignore"):
                both = np.logaddexp(np.log(np.maximum(c - discount, 0) / size), inner).astype(np.float32)
            every = c.sum(1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * classes), len(c), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(every > 0), pa.array(np.log10((every + 1) / down)), packed], ["word", "known", "base", "logp"])

    valued = words.mapInArrow(values, "word binary, known boolean, base double, logp binary")
    chunks = max(1, -(-total_bytes // chunk_bytes))
    chunked = rows.select("doc_id", "held_out", "raw", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(chunks)).alias("chunk"))
    wanted = chunked.groupBy("chunk").applyInArrow(_chunk_words, _CHUNK_WORDS)
    answers = wanted.join(valued, "word").select("chunk", "at", "known", "base", "logp")
    base_end = float(np.log10((training + 1) / down))
    scored = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(base_end, training > 0, ends, shares), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
