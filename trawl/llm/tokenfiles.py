"""Token ids of documents in compressed files, and back.

A folder holds two Parquet tables. `code`: id and length of every id's canonical Huffman code, from counts over all
documents. `blocks`: part, block, start (ids of the part before it), n_ids, doc_ids, doc_tokens, data and points. Parts
follow each other in ascending doc_id, blocks in a part likewise, so the ids of all blocks in order are those of all
documents. A block holds whole documents and can be decoded alone: each document's codes begin on a whole byte, and
points holds the bit length of each run of huffman.STEP ids, from which the bit offsets of all runs follow.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import ragged, shared_checkpoints, slices
from trawl.llm.huffman import STEP, Code, code_lengths
from trawl.llm.packing import END_ID
from trawl.llm.tokens import Encoder, encoding, with_end

#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
SLICE = 8 << 20
#: Bytes of ids that are coded at once; each id takes about a hundred bytes of numbers meanwhile.
CODED = 2 << 20
#: Ids of a part, about; parts are dealt by quantiles of doc_id this near to the true ones, as a share of a part.
PART_IDS = 4 << 20
NEAR = 0.1
#: What a null doc_id counts as when parts are dealt.
FIRST = -(1 << 63)
BLOCKS = "part int, block int, start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, data binary, points binary"


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of data, by their bounds in bytes, as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def id_type(vocabulary: str) -> str:
    """Two bytes an id where they hold every id of the vocabulary, else four."""
    return "<u2" if Encoder.of(vocabulary).vocabulary <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, as `id_type` says) of every document, end_id last; null text is empty."""
    kind = id_type(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(vocabulary) as encoder:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    ids, bounds = with_end(*encoder.encode(part.column("text")), end_id)
                    raw = _binary(ids.astype(kind).view(np.uint8), np.dtype(kind).itemsize * bounds)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), raw], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as numbers in a row, and the bounds of its values."""
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data).view(kind), (offsets - offsets[0]) // width


def global_code(tokens: DataFrame, kind: str) -> Code:
    """The code of all ids by their counts over all documents. What meets the driver is a row an id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(_flat(batch.column("ids"), kind)[0])
            if len(seen) > len(total):
                total, seen = seen.astype(np.int64), total
            total[: len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return Code(counted["id"].to_numpy(np.int64), code_lengths(counted["n"].to_numpy(np.int64)))


def _ranges(tokens: DataFrame) -> list[int]:
    """The doc_ids at which parts of about PART_IDS ids begin, by a read of the ids' numbers alone; a doc_id of many
    rows begins many. What meets the driver is a number a part."""
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // PART_IDS))
    ids = tokens.select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc_id"))
    return [int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], NEAR / parts)] if parts > 1 else []


def _part(doc_ids: np.ndarray, marks: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The part of each row; rows of a doc_id that begins several are dealt to these by their mark, in its order."""
    low, high = np.searchsorted(begins, doc_ids, side="left"), np.searchsorted(begins, doc_ids, side="right")
    return low + ((marks * (high - low + 1)) >> 32)


def _coded(tokens: DataFrame, code: Code, kind: str, ranges: list[int]) -> DataFrame:
    """part, doc_id, n_tokens, mark (crc32 of the ids), the document's codes, and the bit lengths of its runs."""
    begins = np.array(ranges, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids", CODED):
                ids, bounds = _flat(part.column("ids"), kind)
                ids = ids.astype("<u4")
                data, byte_bounds, marks, point_bounds = code.encode(ids, bounds)
                ends = np.cumsum(code.size[ids])
                runs = np.diff(np.concatenate([marks, np.zeros(1, np.int64)]))
                last = point_bounds[1:] - 1
                bits = ends[bounds[1:] - 1] - np.concatenate([np.zeros(1, np.int64), ends])[bounds[:-1]]
                runs[last] = bits - marks[last]
                sums = np.fromiter((zlib.crc32(ids[a:b].data) for a, b in zip(bounds[:-1], bounds[1:], strict=True)), np.int64, len(bounds) - 1)
                where = _part(part.column("doc_id").fill_null(FIRST).to_numpy(), sums, begins)
                columns = [pa.array(where.astype(np.int32)), part.column("doc_id"), part.column("n_tokens"), pa.array(sums)]
                columns += [_binary(data, byte_bounds), _binary(runs.astype("<u2").view(np.uint8), 2 * point_bounds)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "n_tokens", "mark", "data", "points"])

    return tokens.mapInArrow(encode, "part int, doc_id long, n_tokens long, mark long, data binary, points binary")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents in the given order."""
    part, number, start = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []
    size = 0

    def block() -> pa.RecordBatch:
        doc_ids, counts, data, points = zip(*held, strict=True)
        values = [part, number, start, size, list(doc_ids), list(counts), b"".join(data), b"".join(points)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "data", "points")), strict=True):
            held.append(row)
            size += row[1]
            if size >= BLOCK_IDS:
                yield block()
                number, start, size, held = number + 1, start + size, 0, []
    if held:
        yield block()


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int = END_ID) -> None:
    """Writes every document's ids to the folder, ascending by doc_id.

    Null doc_ids come first; rows of one doc_id go by the checksum of their ids. Null text is an empty document, its end
    id alone; texts of any length are one row each; other columns are not looked at. An empty table gives empty tables.
    Texts are encoded once, into a table beside the result, which counting and coding read; documents are then dealt to
    parts in coded form. Many rows of one doc_id, or of none, spread over parts by their checksums.
    """
    spark = docs.sparkSession
    token_table(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(f"{folder}/ids")
    tokens = spark.read.parquet(f"{folder}/ids")
    kind, ranges = id_type(vocabulary), _ranges(tokens)
    code = global_code(tokens, kind)
    told = spark.createDataFrame([(int(s), int(n)) for s, n in zip(code.symbols, code.lengths, strict=True)], "id int, length int")
    told.coalesce(1).write.parquet(f"{folder}/code")
    dealt = _coded(tokens, code, kind, ranges).repartitionById(len(ranges) + 1, "part").sortWithinPartitions("doc_id", "mark")
    dealt.select("doc_id", "n_tokens", "data", "points").mapInArrow(_joined, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_code(spark: SparkSession, folder: str) -> Code:
    rows = spark.read.parquet(f"{folder}/code").toPandas().sort_values("id")
    return Code(rows["id"].to_numpy(np.int64), rows["length"].to_numpy(np.uint8))


def decode_block(code: Code, counts: np.ndarray, data: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """All ids of a block's documents (of counts ids each) in a row."""
    points = -(-counts // STEP)
    first = np.cumsum(points) - points
    ends = np.cumsum(runs.astype(np.int64))
    bits = np.add.reduceat(runs.astype(np.int64), first)
    base = np.concatenate([np.zeros(1, np.int64), np.cumsum((bits + 7) >> 3)])[:-1]
    before = ends - runs
    starts = before + np.repeat(8 * base - before[first], points)
    sizes = np.full(len(runs), STEP, np.int64)
    sizes[first + points - 1] = counts - STEP * (points - 1)
    return code.decode(data, starts, sizes)


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document.

    Blocks are decoded each by itself; what the parts before hold is summed from the blocks' heads alone.
    """
    code = read_code(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    names = ["doc_id", "part", "local", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                counts = row.column("doc_tokens").flatten().to_numpy()
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
                ids = decode_block(code, counts, _flat(row.column("data"), "u1")[0], _flat(row.column("points"), "<u2")[0]).astype("<u4")
                sums = [zlib.crc32(ids[a:b].data) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                n = len(counts)
                columns = [row.column("doc_ids").flatten(), pa.array(np.full(n, row.column("part")[0].as_py(), np.int32)), pa.array(bounds[:-1] + row.column("start")[0].as_py())]
                columns += [pa.array(counts), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = blocks.select("part", "start", "doc_ids", "doc_tokens", "data", "points").mapInArrow(decode, "doc_id long, part int, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    base = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, *, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids to a new folder, beside the session's checkpoints unless one is named, and reads them."""
    spark = docs.sparkSession
    if folder is None:
        shared_checkpoints(spark)
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary, folder)
    return read_tokens(spark, folder)
