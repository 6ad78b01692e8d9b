"""Jaccard self-join of documents on word shingles, as a blocked sparse product of documents by n-grams.

A document is a row of the incidence matrix: its set of hashed shingles in one global order, rare ones first by a
counting sketch of the corpus. Pairs that can reach the wanted similarity share a column within the leading part of both
rows, and at the first column they share their places leave the overlap that the sizes ask for possible.

Columns are multiplied in two steps, so that groups of near copies do not make pairs of all their members. First each
document of a column meets the column's centres, the two documents that have the least before the column; the overlaps
of those pairs are counted and join documents to classes. Then only documents of different classes meet, in blocks; a
pair becomes a row if its places and the parity maps of its two sets, which bound their difference from below, leave the
overlap possible. The overlaps of those rows are counted whole too.

Large sets fill that map, so that it bounds nothing; they have a second one that grows with them, and pairs of them are
held against it before whole sets are sent anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut_lineage, mix64, slices, small_batches
from trawl.operators.graph import connected

WORDS = 5
#: Documents link when 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Counters of the sketch, a power of two. It only orders shingles; any size gives the same links.
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 16
#: About so many documents of one column meet as many others at once in the second step; any number gives the same links.
COLUMN = 1024
#: A column's rows that a task holds before it passes them on.
HELD = 1 << 14
#: Bits of the parity map of a set, a multiple of 64.
PARITY_BITS = 512
#: Bits of the map that spares documents outside all pairs; any size gives the same links.
SPOT_BITS = 22
#: Bytes of text shingled at once.
SLICE = 2 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(raws: list[bytes], hashes: dict[bytes, int], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    found = [r.translate(_LOWER).split() for r in raws]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((hashes[w] for x in found for w in x), np.uint64, int(lengths.sum()))
    runs = flat.copy()
    for j in range(1, min(words, len(flat))):
        runs[: len(flat) - j] = runs[: len(flat) - j] * _STEP + flat[j:]
    runs = mix64(runs)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= words:
            s = np.sort(runs[at : at + n - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("raw").to_pylist()]


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """How many shingles of all documents fall on each counter."""
    size = 1 << bits
    width = min(size, SKETCH_BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for part in slices(batch, "raw", SLICE):
                sets = shingle_sets(_raws(part), hashes)
                if sets:
                    total += np.bincount(_place(np.concatenate(sets), bits), minlength=size).astype(np.uint32)
        blocks = [i for i in range(size // width) if total[i * width : (i + 1) * width].any()]
        packed = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])

    def add(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint64)
        for batch in group:
            for b in batch.column("packed").to_pylist():
                total += np.frombuffer(zlib.decompress(b), np.uint32)
        clipped = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(clipped.tobytes(), 1)], pa.binary())], ["block", "packed"])

    out = np.zeros(size, np.uint32)
    for block, packed in rows.select("raw").mapInArrow(count, "block int, packed binary").groupBy("block").applyInArrow(add, "block int, packed binary").collect():  # the sketch, of fixed size
        out[block * width : (block + 1) * width] = np.frombuffer(zlib.decompress(bytes(packed)), np.uint32)
    return out


def _order(hashes: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """Places of the sorted hashes in the global order: by level of frequency, then by hash."""
    return np.argsort(level[_place(hashes, bits)], kind="stable")


def _lead(n: int, percent: int) -> int:
    """How many leading shingles of a set of n any partner's leading ones must meet."""
    return n - -(-percent * n // 100) + 1


_ROWS = "doc_id long, n_shingles long, node long, lead binary, parity array<long>, wide binary"


def node_of(packed: bytes) -> int | None:
    """The node of a set: 64 bits of its hashes' hash, as wide as the shingles' own."""
    return int.from_bytes(xxhash.xxh3_128_digest(packed)[:8], "little", signed=True) if packed else None


def parity_maps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set: bit i tells whether an odd number of its hashes fall on i. Sets that differ in d
    hashes differ in at most d bits."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cells = np.repeat(np.arange(len(sets)) * PARITY_BITS, lengths) + (flat & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    odd = (np.bincount(cells, minlength=len(sets) * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), PARITY_BITS), axis=1).view(np.int64)


def wide_map(hashes: np.ndarray) -> bytes | None:
    """The parity map of a set larger than PARITY_BITS, in as many bits as hashes or up to twice as many."""
    if len(hashes) <= PARITY_BITS:
        return None
    bits = 1 << (len(hashes) - 1).bit_length()
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(one: bytes, two: bytes) -> int:
    """In how many bits two wide maps differ, the larger folded to the size of the other: not more than their sets differ."""
    x, y = sorted((np.frombuffer(m, np.uint64) for m in (one, two)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _rows(rows: DataFrame, levels, bits: int, percent: int) -> DataFrame:
    """Each row of docs with its node (a hash of its set, null without shingles) and the leading part of its set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        level = np.frombuffer(zlib.decompress(levels.value), np.uint8)
        for batch in batches:
            for part in slices(batch, "raw", SLICE):
                sets = shingle_sets(_raws(part), hashes)
                nodes = [node_of(s.tobytes()) for s in sets]
                leads = [s[_order(s, level, bits)[: _lead(len(s), percent)]] if len(s) else s for s in sets]
                words = np.arange(len(sets) + 1, dtype=np.int32) * (PARITY_BITS // 64)
                maps = pa.ListArray.from_arrays(pa.array(words), pa.array(parity_maps(sets).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x in leads], pa.binary()), maps, pa.array(map(wide_map, sets), pa.binary())],
                    ["doc_id", "n_shingles", "node", "lead", "parity", "wide"],
                )

    return rows.mapInArrow(scan, _ROWS)


_COLUMN = "h long, node long, n int, place int"


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each leading shingle of each set: shingle, node, size and place; of equal sets in a task only one."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "lead", 4 << 20):
            new = []
            for i, node in enumerate(part.column("node").to_pylist()):
                if node not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    new.append(i)
            part = part.take(pa.array(new, pa.int64()))
            leads = [np.frombuffer(x, np.int64) for x in part.column("lead").to_pylist()]
            lengths = np.fromiter(map(len, leads), np.int64, len(leads))
            if lengths.sum():
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(leads)),
                        pa.array(np.repeat(part.column("node").to_numpy(), lengths)),
                        pa.array(np.repeat(part.column("n_shingles").to_numpy(), lengths).astype(np.int32)),
                        pa.array(place.astype(np.int32)),
                    ],
                    ["h", "node", "n", "place"],
                )


def _possible(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets whose first common column stands at these places can overlap enough for their sizes."""
    most = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 + percent) * most >= percent * (n1 + n2)


def _stars(percent: int):
    """From rows sorted by column, then place: pairs of each document with the column's two centres, and the rows of
    columns of four documents and more, whose other pairs are for the second step (rows without b).

    A pair that links passes the bound at its first common column; c is the number of columns where it passes here.
    """
    names = ["a", "b", "h", "c", "n", "place"]

    def pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        keep = (x[:, 1] != y[:, 1]) & _possible(x[:, 2], x[:, 3], y[:, 2], y[:, 3], percent)
        ends = np.stack([np.minimum(x[keep, 1], y[keep, 1]), np.maximum(x[keep, 1], y[keep, 1])], 1)
        ends, times = np.unique(ends, axis=0, return_counts=True)
        none = lambda t: pa.nulls(len(ends), t)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), none(pa.int64()), pa.array(times.astype(np.int32)), none(pa.int32()), none(pa.int32())], names)

    def others(x: np.ndarray) -> pa.RecordBatch:
        none = lambda t: pa.nulls(len(x), t)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 1]), none(pa.int64()), pa.array(x[:, 0]), none(pa.int32()), pa.array(x[:, 2].astype(np.int32)), pa.array(x[:, 3].astype(np.int32))], names)

    def multiply(data: np.ndarray, done: int) -> Iterator[pa.RecordBatch]:
        """Whole columns, or the beginning of one; its first `done` rows were passed on before."""
        begin = np.concatenate([[True], data[1:, 0] != data[:-1, 0]])
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(data)))
        at = np.repeat(starts, lengths)
        rank = np.arange(len(data)) - at
        fresh = np.arange(len(data)) >= done
        for centre in (0, 1):
            x = np.flatnonzero(fresh & (rank > centre))
            if len(x):
                yield pairs(data[at[x] + centre], data[x])
        rest = fresh & (np.repeat(lengths, lengths) > 3)
        if rest.any():
            yield others(data[rest])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = np.zeros((0, 4), np.int64), 0
        for batch in batches:
            data = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h", "node", "n", "place")], axis=1)
            data = np.concatenate([held, data])
            if not len(data):
                continue
            same = (data[1:, 0] == data[:-1, 0]) & (data[1:, 1] == data[:-1, 1])  # an equal set of another task
            data = data[np.concatenate([[True], ~same])]
            last = int(np.searchsorted(data[:, 0], data[-1, 0]))
            if last:
                yield from multiply(data[:last], done)
                done = 0
            held = data[last:]
            if len(held) > HELD:
                yield from multiply(held, done)
                held, done = held[:4], 4
        if len(held):
            yield from multiply(held, done)

    return scan


_PAIRS = "a long, b long, h long, c int, n int, place int"


def _overlaps(percent: int):
    """Whole overlaps of pairs from their two rows of the matrix; keeps those that link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            left, right = batch.column("set_a"), batch.column("set_b")
            for i in range(batch.num_rows):
                s, t = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                if 100 * common >= percent * (len(s) + len(t) - common):
                    kept.append(i)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    return scan


def _sets(spots):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        marked = np.frombuffer(zlib.decompress(spots.value), np.uint8)
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            batch = batch.filter(pa.array((marked[spot >> 3] >> (spot & 7) & 1).astype(bool)))
            for part in slices(batch, "raw", SLICE):
                sets = {node_of(x): x for x in (s.tobytes() for s in shingle_sets(_raws(part), hashes)) if x}
                yield pa.RecordBatch.from_arrays([pa.array(sets.keys(), pa.int64()), pa.array(sets.values(), pa.binary())], ["node", "set"])

    return scan


def _candidate_sets(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whole sets of the nodes that stand in a pair, made where the texts are read.

    A map of hashed ids, of fixed size, spares the other documents; what it lets through besides falls in the join.
    """
    spark = rows.sparkSession
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SPOT_BITS))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select(spot("doc_id").alias("spot"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << SPOT_BITS - 3, np.uint8)
        for batch in batches:
            at = batch.column("spot").to_numpy()
            np.bitwise_or.at(marked, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(marked.tobytes(), 1)], pa.binary())], ["packed"])

    marked = np.zeros(1 << SPOT_BITS - 3, np.uint8)
    for row in wanted.coalesce(16).mapInArrow(mark, "packed binary").collect():  # sixteen maps of fixed size
        marked |= np.frombuffer(zlib.decompress(bytes(row[0])), np.uint8)
    spots = spark.sparkContext.broadcast(zlib.compress(marked.tobytes(), 1))
    sets = rows.filter("doc_id is not null").withColumn("spot", spot("doc_id")).mapInArrow(_sets(spots), "node long, set binary")
    return sets.join(ends, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""
    sets = _candidate_sets(pairs, rows, nodes).persist(StorageLevel.DISK_ONLY)
    with_a = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    links = cut_lineage(both.select("a", "b", "set_a", "set_b").mapInArrow(_overlaps(percent), "a long, b long"))
    sets.unpersist()
    return links


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity maps leave the overlap that their sizes ask for possible."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    bits = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = (F.col("n_a") + F.col("n_b") - bits) / 2  # twice the overlap is the sizes' sum less the difference
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    return _near(near.select("a", "b", "c"), nodes, percent)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, c) without those of two large sets whose wide maps differ too much."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "wide_a", "wide_b")), strict=True)
            # twice the overlap is the sizes' sum less the difference
            kept = [not (v and w) or (100 + percent) * (m + n - differences(v, w)) >= 2 * percent * (m + n) for m, n, v, w in rows]
            yield batch.select(["a", "b", "c"]).filter(pa.array(kept, pa.bool_()))

    side = lambda x: nodes.filter("wide is not null").select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}"))
    wide = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return wide.select("a", "b", "c", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(scan, "a long, b long, c long")


def _best(pairs: DataFrame) -> DataFrame:
    """For each node the pair with the partner that it meets in most columns."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "c").unionAll(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "c"))
    top = both.groupBy("x").agg(F.max_by("y", F.struct("c", "y")).alias("y"))
    return top.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one class."""
    root = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
    seen = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return seen.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def link_classes(docs: DataFrame, *, percent: int = PERCENT, bits: int = SKETCH_BITS, column: int = COLUMN) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Sets of equal shingles are one node, named by a hash of the set, so copies cost nothing. Null texts, empty ones and
    ones of white space have no shingle, link with nothing and are their own class. Rows of equal doc_id share what any
    of their texts links to; a row of null doc_id stands for nothing and has its class only through an equal set. Very
    long texts are sets like any other. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    counts = sketch(rows, bits)
    mean = float(counts.mean())
    usual = mean + 4 * mean**0.5 + 4  # what a counter of rare shingles alone hardly passes
    level = np.zeros(len(counts), np.uint8)
    often = np.flatnonzero(counts > usual)
    level[often] = 2 * np.log2(counts[often] / usual) + 1
    levels = spark.sparkContext.broadcast(zlib.compress(level.tobytes(), 1))
    described = _rows(rows, levels, bits, percent).persist(StorageLevel.DISK_ONLY)
    known = described.filter("node is not null and doc_id is not null")
    # the sets of nodes are made from the text of the smallest id; ids that have other texts beside it come by their own
    nodes = cut_lineage(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("parity").alias("parity"), F.first("n_shingles").alias("n_shingles"), F.first("wide").alias("wide")))
    columns = known.select("node", "n_shingles", "lead").mapInArrow(_columns, _COLUMN)
    sorted_ = columns.repartition("h").sortWithinPartitions("h", "place", "n", "node")
    met = cut_lineage(sorted_.mapInArrow(_stars(percent), _PAIRS))
    # several texts of one id are linked by it
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
    links = cut_lineage(known.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").filter("a <> b").select("a", "b").distinct())
    pairs = cut_lineage(_bounded(met.filter("b is not null").groupBy("a", "b").agg(F.sum("c").alias("c")), nodes, percent))
    # the likeliest pair of each node joins most classes; of the other pairs only those between classes matter
    links = cut_lineage(links.unionAll(_verified(_best(pairs), rows, nodes, percent)))
    roots = connected(links)
    links = links.unionAll(_verified(cut_lineage(_apart(pairs, roots)), rows, nodes, percent))
    roots = connected(links)
    rest = _rest(met.filter("b is null").select("h", F.col("a").alias("node"), "n", "place"), roots, nodes, pairs, percent, column)
    if rest is not None:
        roots = connected(links.unionAll(_verified(rest, rows, nodes, percent)))
    named = nodes.select("node", "doc_id").join(roots.select(F.col("id").alias("node"), "root"), "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    classes = named.join(named.groupBy("root").agg(F.min("doc_id").alias("class")), "root").select("node", "class")
    return described.select("doc_id", "n_shingles", "node").join(classes, "node", "left").select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))


_MET = ["h", "i", "j", "own", "node", "n", "place", "root"]


def _blocks(percent: int):
    """From rows sorted by column and pair of blocks: the pairs of different classes that can still link."""

    def meet(data: np.ndarray, parity: np.ndarray) -> np.ndarray:
        first, second = np.flatnonzero(data[:, 3] == data[:, 1]), np.flatnonzero(data[:, 3] == data[:, 2])
        found = []
        if len(first) and len(second) and data[:, 7].min() < data[:, 7].max():
            y = data[second]
            for i in first:
                x = data[i]
                keep = (y[:, 7] != x[7]) & _possible(y[:, 5], y[:, 6], x[5], x[6], percent)
                if x[1] == x[2]:
                    keep &= y[:, 4] > x[4]
                at = np.flatnonzero(keep)
                if len(at):
                    apart = np.bitwise_count(parity[second[at]] ^ parity[i]).sum(axis=1, dtype=np.int64)
                    sizes = y[at, 5] + x[5]
                    at = at[(100 + percent) * (sizes - apart) >= 2 * percent * sizes]
                    found.append(np.stack([np.minimum(y[at, 4], x[4]), np.maximum(y[at, 4], x[4])], 1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, parity = np.zeros((0, len(_MET)), np.int64), np.zeros((0, PARITY_BITS // 64), np.int64)

        def passed(groups: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(groups), axis=0) if groups else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            new = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _MET], axis=1)
            data = np.concatenate([data, new])
            parity = np.concatenate([parity, batch.column("parity").flatten().to_numpy().reshape(len(new), -1)])
            if not len(data):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (data[1:, :3] != data[:-1, :3]).any(axis=1)])).tolist()
            yield passed([meet(data[s:e], parity[s:e]) for s, e in zip(starts[:-1], starts[1:], strict=True)])
            data, parity = data[starts[-1] :], parity[starts[-1] :]
        if len(data):
            yield passed([meet(data, parity)])

    return scan


def _rest(left: DataFrame, roots: DataFrame, nodes: DataFrame, done: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Pairs between different classes that share a column and were not yet compared; None if there is none.

    A column whose documents all are in one class by now has nothing left. The others' documents meet block by block.
    """
    labelled = cut_lineage(left.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_ = labelled.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi").select("h", "m")
    dealt = labelled.join(open_, "h").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(nodes.select("node", "parity"), "node")
    # a document is sent to the blocks that it meets as first or as second
    sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = sides.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "place", "root", "parity")
    met = sides.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_blocks(percent), "a long, b long")
    new = met.distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")
    found = cut_lineage(_near(new.withColumn("c", F.lit(0).cast("long")), nodes, percent).select("a", "b"))
    return None if found.isEmpty() else found
