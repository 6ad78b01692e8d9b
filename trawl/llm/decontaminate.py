"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages over the vocabulary of the benchmark itself, weighted by inverse document
frequency over the whole corpus. A randomised singular value decomposition of these passages at unit length, whose
products are summed over partitions, gives a latent space in which short items count as much as long ones. Every window of every document is folded in and compared with all item passages by cosine; what
comes near is checked by a longest common subsequence of words and, for paraphrases, by the words of the answer. Exact
copies of an item are besides looked up from its rarest word, whatever its weight and what stands around it.

The benchmark is a stated query set and is taken in blocks of bounded size, a scan of the corpus for each.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import slices, small_batches, texts

RANK = 96
#: Items in a block and words of text in a block, which bound what is sent to every task.
BLOCK_ITEMS = 1024
BLOCK_WORDS = 200_000
#: Windows are runs of PARTS parts of STEP words; item passages are as long.
STEP, PARTS = 12, 4
#: Bytes of text searched at once, and windows compared with all passages at once; any number gives the same leaks.
SLICE, WINDOWS = 1 << 20, 1024
COSINE = 0.3
#: Least share of an item passage's latent energy that a window must hold to be a candidate, besides the cosine.
COVERAGE = 0.5
#: Share of an item's weight that a common subsequence must hold: alone, or with the answer's words.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.7
SEED = 11

_BREAK = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.lower().encode("utf-8", "replace").translate(_BREAK).split()


@dataclass
class Block:
    """Benchmark items: their words as numbers, where their answer begins, and the numbering of words."""

    item_ids: list[int]
    items: list[np.ndarray]
    answers: list[int]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        ids, items, answers = [], [], []
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            ids.append(item_id)
            items.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64))
            answers.append(len(words) - len(words_of(answer_of(text))))
        return cls(ids, items, answers, vocabulary)


def answer_of(text: str) -> str:
    """What stands after the last answer mark, or else the last sentence."""
    low = text.lower()
    if (at := low.rfind("answer:")) >= 0:
        return text[at + 7 :]
    body = text.rstrip(" \n.!?")
    cut = max(body.rfind(". "), body.rfind("? "), body.rfind("! "), body.rfind("\n"))
    return body[cut + 1 :]


def _numbers(some: list[str], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of texts in a row (-1: not in the vocabulary) and the number of words of each."""
    found = [words_of(t) for t in some]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(map(vocabulary.get, chain.from_iterable(found), repeat(-1)), np.int64, int(lengths.sum())), lengths


def _count(vocabulary: dict[bytes, int]):
    """Document frequencies of the vocabulary in a partition, a row for each word it holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary), np.int64)
        terms = vocabulary.keys()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                here = [vocabulary[w] for text in texts(part) for w in set(words_of(text)) & terms]
                seen += np.bincount(np.array(here, np.int64), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["term", "n"])

    return scan


def _packed(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def _fold(terms: np.ndarray, bounds: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sums of the matrix's rows by term, over runs that begin at bounds."""
    out = np.zeros((len(bounds) - 1, matrix.shape[1]), matrix.dtype)
    full = np.flatnonzero(np.diff(bounds))
    for a in range(0, len(full), 1024):
        some = full[a : a + 1024]
        first = bounds[some[0]]
        out[some] = np.add.reduceat(matrix[terms[first : bounds[some[-1] + 1]]], bounds[some] - first, axis=0)
    return out


def weights(frequency: np.ndarray, total: int) -> np.ndarray:
    """Inverse document frequencies, log 2 at least: a word of every document still gives its item a direction."""
    return np.log(1 + (total + 1) / (frequency + 1))


def _product(passages: DataFrame, weight: np.ndarray, basis: np.ndarray, gram: bool) -> np.ndarray:
    """Over all TF-IDF passages A of unit length: A'(A basis), or (A basis)'(A basis) if gram; summed by partition."""
    weighted = basis * weight[:, None]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for at in range(0, len(f), 4096):
                runs = [np.asarray(x, np.int64) for x in f["passage"].iloc[at : at + 4096]]
                bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
                terms = np.concatenate(runs) if runs else np.zeros(0, np.int64)
                length = np.sqrt(_fold(terms, bounds, weight[:, None] ** 2))
                latent = _fold(terms, bounds, weighted) / np.maximum(length, 1e-9)
                if gram:
                    part = latent.T @ latent
                else:
                    part = np.zeros_like(basis)
                    np.add.at(part, terms, np.repeat(latent / np.maximum(length, 1e-9), np.diff(bounds), axis=0))
                    part *= weight[:, None]
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"packed": [_packed(total)]})

    parts = passages.repartition(8).mapInPandas(scan, "packed binary")
    return sum((np.load(io.BytesIO(bytes(r[0]))) for r in parts.toLocalIterator()), np.zeros(1))


def latent_space(passages: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF passages by a randomised range finder with one power step."""
    width = min(len(weight), rank + 8)
    sketch = np.random.default_rng(seed).normal(size=(len(weight), width))
    q, _ = np.linalg.qr(_product(passages, weight, sketch, gram=False))
    values, vectors = np.linalg.eigh(_product(passages, weight, q, gram=True))
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-30)]
    return q @ vectors[:, order]


def lcs_weight(item: np.ndarray, weight: np.ndarray, words: np.ndarray) -> float:
    """The largest weight of a common subsequence of the item's words and a run of words."""
    best = np.zeros(len(item) + 1)
    for w in words:
        hit = np.flatnonzero(item == w)
        if len(hit):
            grown = best.copy()
            grown[hit + 1] = np.maximum(grown[hit + 1], best[hit] + weight[hit])
            best = np.maximum.accumulate(grown)
    return float(best[-1])


def _exact(block: Block, weight: np.ndarray):
    """Finds (document, item) wherever an item's words stand in a row in one document."""
    rarest = [int(np.argmax(weight[x])) for x in block.items]
    is_anchor = np.zeros(len(weight) + 1, bool)  # the last place takes the words outside the vocabulary
    is_anchor[[x[o] for x, o in zip(block.items, rarest, strict=True)]] = True

    def find(terms: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int]]:
        at = np.flatnonzero(is_anchor[terms])
        at = at[np.argsort(terms[at], kind="stable")]
        bounds = np.searchsorted(terms[at], np.arange(len(weight) + 1))
        for i, (item, o) in enumerate(zip(block.items, rarest, strict=True)):
            begin = at[bounds[item[o]] : bounds[item[o] + 1]] - o
            begin = begin[(begin >= 0) & (begin + len(item) <= len(terms))]
            for k, w in enumerate(item):
                if not len(begin):
                    break
                begin = begin[terms[begin + k] == w]
            doc = np.searchsorted(firsts, begin, side="right") - 1
            for d in np.unique(doc[begin + len(item) <= firsts[doc + 1]]).tolist():
                yield d, i

    return find


_HIT = "doc_id long, item_id long, cosine double, lcs double, answer double"


def _search(block: Block, weight: np.ndarray, space: np.ndarray, cosine: float):
    length = STEP * PARTS
    folded = (space * weight[:, None]).astype(np.float32)
    owners, passages = [], []
    for i, item in enumerate(block.items):
        for at in range(0, max(1, len(item) - length // 2), length // 2):
            owners.append(i)
            passages.append(item[at : at + length])
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in passages])]).astype(np.int64)
    targets = _fold(np.concatenate(passages), bounds, folded)
    norms = np.linalg.norm(targets, axis=1)
    keep = norms > 1e-6
    targets, owner, energy = targets[keep] / norms[keep][:, None], np.array(owners)[keep], norms[keep]
    exact = _exact(block, weight)
    values = [weight[x] for x in block.items]
    wholes = [float(v.sum()) for v in values]
    present = np.zeros(len(weight) + 1, bool)  # the last place takes the words outside the vocabulary

    def check(item: int, words: np.ndarray, first: int) -> tuple[float, float]:
        text = block.items[item]
        reach = len(text) // 2
        near = words[max(0, first - reach) : first + length + reach]
        # several windows of the item's own length, so that scattered common words do not add up
        span = len(text) + len(text) // 3 + 2
        whole = wholes[item]
        present[near] = True
        most = values[item][present[text]].sum()  # no subsequence holds more
        present[near] = False
        if most < LCS_WITH_ANSWER * whole:
            return 0.0, 0.0
        best, answer = 0.0, 0.0
        last = max(0, len(near) - span)
        for at in [*range(0, last, max(1, len(text) // 6)), last]:
            run = near[at : at + span]
            share = lcs_weight(text, values[item], run[run >= 0]) / whole
            if share > best:
                tail = text[block.answers[item] :]
                tail = tail if len(tail) else text
                best, answer = share, float(weight[tail][np.isin(tail, run)].sum() / weight[tail].sum())
        return best, answer

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                terms, lengths = _numbers(texts(part), block.vocabulary)
                doc_ids = part.column("doc_id").to_pylist()
                firsts = np.concatenate([[0], np.cumsum(lengths)])
                # parts of STEP words, counted from each document's start
                n_parts = -(-lengths // STEP)
                part_doc = np.repeat(np.arange(len(lengths)), n_parts)
                part_no = np.arange(len(part_doc)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                at = np.flatnonzero(terms >= 0)
                doc = np.searchsorted(firsts, at, side="right") - 1
                of = (np.cumsum(n_parts) - n_parts)[doc] + (at - firsts[doc]) // STEP
                runs = np.searchsorted(of, np.arange(len(part_doc) + 1))
                sums = _fold(terms[at], runs, folded)
                # a window is PARTS parts in a row of one document; the last ones are shorter
                windows = sums.copy()
                for j in range(1, PARTS):
                    same = np.flatnonzero(part_doc[:-j] == part_doc[j:]) if len(part_doc) > j else np.zeros(0, np.int64)
                    windows[same] += sums[same + j]
                size = np.linalg.norm(windows, axis=1)
                some = np.flatnonzero(size > 1e-6)
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for a in range(0, len(some), WINDOWS):
                    lo = max(a - 1, 0)  # with the windows beside them, so that where a run of windows ends does not matter
                    w = some[lo : a + WINDOWS + 1]
                    along = windows[w] @ targets.T
                    near = along / size[w][:, None]
                    passing = (near >= cosine) & (along >= COVERAGE * energy)
                    own = passing[a - lo : a - lo + WINDOWS]
                    r, t = np.nonzero(own)
                    r += a - lo
                    # of overlapping windows that hold the same passage, the fullest one is checked
                    before, after = np.maximum(r - 1, 0), np.minimum(r + 1, len(w) - 1)
                    top = ~passing[before, t] | (along[r, t] >= along[before, t]) | (part_doc[w[before]] != part_doc[w[r]])
                    top &= ~passing[after, t] | (after == r) | (along[r, t] > along[after, t]) | (part_doc[w[after]] != part_doc[w[r]])
                    for r, t in zip(r[top], t[top], strict=True):
                        d, i = int(part_doc[w[r]]), int(owner[t])
                        if best.get((d, i), (0.0, 0.0, 0.0))[1] >= LCS_ALONE:
                            continue
                        share, answer = check(i, terms[firsts[d] : firsts[d + 1]], int(part_no[w[r]]) * STEP)
                        if share >= LCS_ALONE or share >= LCS_WITH_ANSWER and answer >= ANSWER:
                            found = (float(near[r, t]), share, answer)
                            if (d, i) not in best or found[1] > best[d, i][1]:
                                best[d, i] = found
                for d, i in exact(terms, firsts):
                    best[d, i] = (best.get((d, i), (1.0,))[0], 1.0, 1.0)
                rows = [(doc_ids[d], block.item_ids[i], *x) for (d, i), x in best.items()]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.float64()) for x in c[2:])], ["doc_id", "item_id", "cosine", "lcs", "answer"])

    return scan


def _blocks(benchmark: DataFrame, items: int, words: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null").toLocalIterator():
        n = len(words_of(row[1]))
        if block and (len(block) >= items or size + n > words):
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, lcs (weighted share of the item) and answer (share of the answer's weight).

    A row for each document and item that stands in it, nearly or exactly. Null and empty texts and items match nothing;
    repeated rows of documents each give rows. Of an exact copy lcs and answer are 1, and
    so is the cosine if no window comes near to it. Of docs only doc_id and text are read, of the benchmark item_id and text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.count()
    found: DataFrame | None = None
    for some in _blocks(benchmark, BLOCK_ITEMS, BLOCK_WORDS):
        block = Block.of(some)
        if not block.items or not total:
            continue
        counted = rows.select("text").mapInArrow(_count(block.vocabulary), "term int, n long")
        frequency = np.zeros(len(block.vocabulary))
        for term, n in counted.groupBy("term").agg(F.sum("n")).collect():  # at most the block's words
            frequency[term] = n
        weight = weights(frequency, total)
        own = spark.createDataFrame(pd.DataFrame({"passage": [x[a : a + STEP * PARTS].tolist() for x in block.items for a in range(0, len(x), STEP * PARTS)]}), "passage array<int>")
        space = latent_space(own, weight, rank)
        hits = rows.mapInArrow(_search(block, weight, space, cosine), _HIT)
        found = hits if found is None else found.unionAll(hits)
    return found if found is not None else spark.createDataFrame([], _HIT)
