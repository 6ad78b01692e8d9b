"""Packing of tokenised documents into fixed-length training sequences.

Documents become token ids and are cut into pieces of at most one sequence. Pieces are dealt to randomised groups by a
hash of their document, as many groups as the total of tokens asks for, and each group packs on its own by first-fit
decreasing: a tournament tree over the free room of the open sequences finds the first that fits in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import slices
from trawl.llm.tokens import SLICE, encoding, with_end

SEQUENCE = 4096
END_ID = 2
#: A group holds about so many tokens and pieces, which bounds a task's memory and time.
GROUP_TOKENS = 8 << 20
GROUP_PIECES = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, *, end_id: int = END_ID, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `sequence` ids of every document (null text: empty, so only the end id).

    A row each: doc_id, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit numbers),
    doc_tokens, and the ids as an array if asked for. Repeated rows give pieces each; a null doc_id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(vocabulary) as encoder:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    flat, bounds = with_end(*encoder.encode(part.column("text")), end_id)
                    flat = flat.astype("<u4")
                    sizes = np.diff(bounds)
                    counts = -(-sizes // sequence)
                    row = np.repeat(np.arange(len(sizes)), counts)
                    starts = sequence * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
                    lengths = np.minimum(sequence, sizes[row] - starts)
                    begins = bounds[row] + starts
                    marks = [zlib.crc32(flat[a : a + n].data) for a, n in zip(begins.tolist(), lengths.tolist(), strict=True)]
                    columns = [part.column("doc_id").take(pa.array(row)), pa.array(starts), pa.array(lengths), pa.array(marks, pa.int64()), pa.array(sizes[row])]
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each length, in the given (falling) order.

    The tree's leaves are the bins' free room and each inner node holds its children's maximum, so the walk from the
    root that prefers the left child wherever it has room ends at the first bin that fits.
    """
    n = len(lengths)
    size = 1
    while size < max(1, n):
        size *= 2
    tree = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < size:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= length
        node //= 2
        while node:
            most = tree[2 * node]
            if tree[2 * node + 1] > most:
                most = tree[2 * node + 1]
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def pack(cut: DataFrame, *, sequence: int = SEQUENCE, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of `pieces`, others are dropped).

    Groups are drawn by a hash of document and seed; a group's sequences are numbered from its own base, so no global
    numbering is needed. Ties of length go by doc_id, start and checksum. An empty table gives an empty result.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kept = cut.select(*names).persist(StorageLevel.MEMORY_AND_DISK)
    total = kept.agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces")).first()
    groups = max(1, -(-(total["tokens"] or 0) // group_tokens), -(-total["pieces"] // group_pieces))
    dealt = kept.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed)), F.lit(groups)))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), sequence)
        return group[names].assign(sequence_id=int(key[0]) * (1 << 32) + bins, offset=offsets)

    return dealt.groupBy("bin_group").applyInPandas(fill, PIECES + ", sequence_id long, offset long")
