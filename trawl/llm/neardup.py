"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations learned by iterative quantisation turn the principal components of a vector into balanced bits. Several tables
each index every vector by a short run of its bits; vectors that meet in a bucket of any table are compared by the
cosine of the original vectors, bucket by bucket as matrix products, so pairs never become rows. A pair counts in the
first table in which it meets, and each bucket passes on only counts and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators.graph import connected

COSINE = 0.9
#: The rotation is learned on at most so many vectors, taken by a hash of their id; every vector is indexed.
SAMPLE = 20_000
ITERATIONS = 30
BITS = 128
#: A table's bits are chosen so that a bucket holds about so many of the vectors by chance.
FILL = 64
#: A pair at the cosine's bound is missed by all tables with this probability at most, if its bits differ at random.
MISS = 0.04
#: Larger buckets are compared in blocks of this many vectors.
BLOCK = 1024
SEED = 5


@dataclass
class Quantiser:
    mean: np.ndarray
    projection: np.ndarray

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.projection > 0


def learn(sample: np.ndarray, bits: int = BITS, iterations: int = ITERATIONS, seed: int = SEED) -> Quantiser:
    """Principal components, then for each set of bits a rotation that alternates with the nearest binary codes."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    centred = sample - mean
    width = min(sample.shape[1], 64)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    components = vectors[:, ::-1][:, :width]
    flat = centred @ components
    sets = []
    for _ in range(-(-bits // width)):
        rotation, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(iterations):
            codes = np.where(flat @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ flat)
            rotation = (left @ right).T
        sets.append(components @ rotation)
    return Quantiser(mean, np.hstack(sets)[:, :bits])


def tables_for(n: int, cosine: float, bits: int = BITS, seed: int = SEED) -> list[np.ndarray]:
    """The bit positions of each table: runs of the code while they last, then random draws."""
    short = min(24, max(6, math.ceil(math.log2(max(2, n) / FILL))))
    same = (1 - math.acos(cosine) / math.pi) ** short
    count = math.ceil(math.log(MISS) / math.log(1 - same))
    rng = np.random.default_rng(seed)
    order = rng.permutation(bits)
    out = [order[i * short : (i + 1) * short] for i in range(min(count, bits // short))]
    while len(out) < count:
        out.append(rng.choice(bits, short, replace=False))
    return out


def _unit(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, unit vector as bytes of doubles (null: links with nothing), its dimension and a print for equal ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, dims, prints = [], [], []
            for v in batch.column(1).to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
                if x is not None and len(x) and np.isfinite(x).all() and (big := np.abs(x).max()) > 0:
                    x = x / big
                    raw = (x / np.sqrt(x @ x)).tobytes()
                    units.append(raw)
                    dims.append(len(x))
                    prints.append(xxhash.xxh3_128_digest(raw))
                else:
                    units.append(None)
                    dims.append(None)
                    prints.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(dims, pa.int32()), pa.array(prints, pa.binary())], ["vec_id", "unit", "dim", "print"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.mapInArrow(scan, "vec_id long, unit binary, dim int, print binary")


def _encode(quantiser: Quantiser, tables: list[np.ndarray]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = quantiser.bits(_unit(batch.column("unit").to_pylist()))
            buckets = np.stack([bits[:, t] @ (1 << np.arange(len(t))) for t in tables], axis=1).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, buckets.shape[1], dtype=np.int32)), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("unit"), flat], ["node", "copies", "unit", "buckets"])

    return scan


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place it reaches over the links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            break
        root = new
    return root


def _compare(cosine: float):
    """Counts and a forest for the pairs of one bucket, or of two blocks of it, that meet here first."""

    def meet(group: pa.Table) -> pa.Table:
        t, left, right = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        order = np.argsort(group.column("node").to_numpy(), kind="stable")
        node, copies = group.column("node").to_numpy()[order], group.column("copies").to_numpy()[order]
        own = group.column("own").to_numpy()[order]
        unit = _unit(group.column("unit").to_pylist())[order]
        buckets = np.array(group.column("buckets").to_pylist(), np.int32).reshape(len(node), -1)[order, :t]
        first, second = np.flatnonzero(own == left), np.flatnonzero(own == right)
        counts = np.zeros(len(node), np.int64)
        links_i, links_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(first), 512):
            rows = first[a : a + 512]
            r, c = np.nonzero(unit[rows] @ unit[second].T >= cosine)
            r, c = rows[r], second[c]
            keep = r < c if left == right else np.ones(len(r), bool)
            r, c = r[keep], c[keep]
            for at in range(0, len(r), 1 << 16):
                x, y = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                new = ~(buckets[x] == buckets[y]).any(1)
                x, y = x[new], y[new]
                counts += np.bincount(x, weights=copies[y], minlength=len(node)).astype(np.int64)
                counts += np.bincount(y, weights=copies[x], minlength=len(node)).astype(np.int64)
                links_i.append(x)
                links_j.append(y)
        root = _forest(len(node), np.concatenate(links_i), np.concatenate(links_j))
        some = np.flatnonzero(counts)
        return pa.table({"node": node[some], "n": counts[some], "root": node[root[some]]})

    return meet


def _classes(clean: DataFrame, dim: int, n: int, cosine: float, sample: int, bits: int, block: int) -> DataFrame:
    """print, n_links, class of the n vectors of one dimension."""
    good = clean.filter((F.col("dim") == dim) & F.col("vec_id").isNotNull())
    drawn = good.select("unit", F.xxhash64("vec_id", F.lit(SEED)).alias("draw"), "vec_id").orderBy("draw", "vec_id").limit(sample).toPandas()
    quantiser = learn(_unit([bytes(b) for b in drawn["unit"]]), bits)
    tables = tables_for(n, cosine, bits)
    nodes = good.groupBy("print").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")).persist(StorageLevel.MEMORY_AND_DISK)
    encoded = nodes.select("node", "copies", "unit").mapInArrow(_encode(quantiser, tables), "node long, copies long, unit binary, buckets array<int>").persist(StorageLevel.MEMORY_AND_DISK)
    sizes = encoded.select(F.posexplode("buckets").alias("t", "bucket")).groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("m"))
    placed = encoded.select("node", "copies", "unit", "buckets", F.posexplode("buckets").alias("t", "bucket"))
    placed = placed.join(sizes.filter("m > 1"), ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "unit", "buckets")
    found = dealt.groupBy("t", "bucket", "i", "j").applyInArrow(_compare(cosine), "node long, n long, root long").persist(StorageLevel.MEMORY_AND_DISK)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected(found, "node", "root")
    return (
        nodes.select("print", "node", "copies")
        .join(counts, "node", "left")
        .join(roots.select(F.col("id").alias("node"), "root"), "node", "left")
        .select("print", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("class"))
    )


def link_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Others link with those
    of their own dimension, each dimension with its own rotation and tables. Equal vectors are one node and link with each other. An empty table gives an
    empty result; only the two named columns are read. Pairs below the cosine never link; of those at it or above, the
    tables miss a few (see MISS), fewer the closer they are.
    """
    clean = _clean(vectors, vec_id, embedding).persist(StorageLevel.MEMORY_AND_DISK)
    dims = clean.filter("dim is not null and vec_id is not null").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()  # one row a dimension
    if not dims:
        return clean.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = reduce(DataFrame.unionAll, [_classes(clean, d["dim"], d["n"], cosine, sample, bits, block) for d in dims])
    linked = clean.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("print")).alias("print")).join(classes, "print", "left")
    return linked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("class", "vec_id"), F.lit(True)).alias("kept"),
    )
