"""Removal of long repeated byte strings by suffix arrays over shards.

Every window of the wanted length names an anchor, the least hashed k-gram in it, so equal windows stand at the same
distance from equal anchors. Only the surroundings of anchors that occur more than once can hold a repeat; they are
dealt to shards by anchor, equal ones once with their number. Each shard sorts its suffixes by Larsson-Sadakane
refinement, takes common prefixes by Kasai's recurrence, and so finds the windows that occur elsewhere. The surroundings
of very frequent anchors spread over several shards, whose sorted windows meet by binary search: of the equal windows of
a shard one stands for all, and windows travel packed by bucket. Only texts that are asked for are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut_lineage, mix64, slices, small_batches

LENGTH = 400
GRAM = 32
#: Bytes that a shard sorts, about; anchors whose surroundings take more than a sixteenth of that have shards of their own.
#: Texts longer than SEGMENT are anchored in overlapping segments.
SHARD_BYTES = 2 << 20
SEGMENT = 4 << 20
#: Anchors with more different surroundings than this are spread over shards.
SPREAD = 2048
#: Bytes of packed windows that meet at once, about.
BUCKET_BYTES = 2 << 20
#: Bits (a power of two) of the map that spares the texts nobody asks for, and of one row of it; any size gives the same result.
SPOT_BITS, SPOT_ROW = 26, 15
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE_BITS = np.uint64(28)


def _steps(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length()) if length >> b & 1]


def _rolling(data: np.ndarray, length: int, factor: int = 0x100000001B3) -> np.ndarray:
    """A 64-bit hash of the `length` bytes that start at each place."""
    power: dict[int, np.uint64] = {1: np.uint64(factor)}
    by = {1: _TABLE[data]}
    size = 1
    while size * 2 <= length:
        power[size * 2] = np.uint64(int(power[size]) ** 2 & (1 << 64) - 1)
        x = by[size]
        by[size * 2] = x[:-size] * power[size] + x[size:]
        if not length & size:
            del by[size]
        size *= 2
    out, at = None, 0
    for size in _steps(length):
        x = by[size][at:]
        if out is None:
            out = x
        else:
            n = len(x)
            out = out[:n] * power[size] + x
        at += size
    return mix64(out)


def anchors_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor: first start, last start, and the anchor's hash."""
    n = len(data) - length + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    hashed = _rolling(data, gram)
    width = length - gram + 1
    packed = (hashed >> _PLACE_BITS) << _PLACE_BITS | np.arange(len(hashed), dtype=np.uint64)
    blocks = -(-len(packed) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, hashed[place[first]].view(np.int64)


_ANCHORS = "doc_id long, dh long, h long, print binary, start long, size int"


def _anchor_rows(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw", SEGMENT):
                ids, dhs, hs, prints, starts, sizes = [], [], [], [], [], []
                for doc_id, dh, raw in zip(part.column("doc_id").to_pylist(), part.column("dh").to_pylist(), part.column("raw").to_pylist(), strict=True):
                    for at in range(0, max(1, len(raw) - length + 1), SEGMENT):
                        piece = raw[at : at + SEGMENT + length - 1]
                        first, last, h = anchors_of(np.frombuffer(piece, np.uint8), length, gram)
                        ids += [doc_id] * len(first)
                        dhs += [dh] * len(first)
                        hs.append(h)
                        size = last - first + length
                        prints += [xxhash.xxh3_128_digest(piece[a : a + k]) for a, k in zip(first.tolist(), size.tolist(), strict=True)]
                        starts.append(first + at)
                        sizes.append(size)
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(dhs, pa.int64()), pa.array(np.concatenate(hs)), pa.array(prints, pa.binary()), pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes).astype(np.int32))],
                        ["doc_id", "dh", "h", "print", "start", "size"],
                    )

    return scan


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of bytes and its inverse, by refinement of groups that share ever longer prefixes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    order = np.argsort(key).astype(np.int32)  # places in 32 bits: a shard is far smaller, and a task holds several such arrays
    key = key[order]
    heads = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    # suffixes shorter than the key are told from equal keys by the zeros after the end only if the text has no zeros
    slot = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(heads, slot, np.int32(0))) + 1
    active = slot[~heads | np.concatenate([~heads[1:], [False]])]
    depth = 8
    while len(active):
        suffix = order[active]
        key = rank[suffix].astype(np.int64)
        key *= n + 1
        key += rank[np.minimum(suffix + depth, n)]
        moved = np.argsort(key, kind="stable")
        suffix, key = suffix[moved], key[moved]
        del moved
        order[active] = suffix
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        rank[suffix] = np.maximum.accumulate(np.where(heads, active, np.int32(0))) + 1
        active = active[~heads | np.concatenate([~heads[1:], [False]])]
        depth = min(2 * depth, 2 * n + 8)
        if depth > 2 * n:
            break
    inverse = np.empty(n, np.int32)
    inverse[order] = slot
    return order, inverse


def common_prefixes(data: np.ndarray, order: np.ndarray, inverse: np.ndarray, starts: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """For each place, the length (up to limit) that its suffix shares with the one before it in order.

    Kasai's recurrence, a place shares at least one less than the place before it, runs along all runs between the
    starts at once; each run begins afresh.
    """
    n = len(data)
    words = np.ndarray((n + 1,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), 0, (1,))
    before = np.where(inverse > 0, order[inverse - 1], -1)
    out = np.zeros(n, np.int32)
    ends = np.concatenate([starts[1:], [n]])
    by_length = np.argsort(starts - ends, kind="stable")  # longest first
    starts, ends = starts[by_length], ends[by_length]
    length = np.zeros(len(starts), np.int64)
    sizes = ends - starts
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, side="left"))
        place = starts[:live] + step
        other = before[place]
        length = np.maximum(length[:live] - 1, 0)
        open_ = np.flatnonzero((other >= 0) & (length < limit))
        length[other < 0] = 0
        while len(open_):
            p, q, l = place[open_], other[open_], length[open_]
            room = np.minimum(n - np.maximum(p, q) - l, limit - l)
            differ = words[np.minimum(p + l, n)] ^ words[np.minimum(q + l, n)]
            # bytes in common: the place of the lowest bit that differs
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            grown = np.minimum(same, room)
            length[open_] = l + grown
            open_ = open_[(grown == 8) & (room > 8)]
        out[place] = length
    return out


_FOUND = "h long, print binary, first array<int>, last array<int>, shard long, digests binary"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def _search(length: int):
    """One shard: runs of repeated starts of each of its surroundings; digests of the different windows of those that are spread."""

    def scan(group: pa.Table) -> pa.Table:
        texts = group.column("text").to_pylist()
        copies = group.column("n").to_numpy()
        spread = group.column("spread").to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum(sizes) - sizes
        order, inverse = suffix_array(data)
        shared = common_prefixes(data, order, inverse, starts, length)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        valid = np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[owner] <= (sizes - length)[owner]
        classes = np.cumsum(shared[order] < length, dtype=np.int32) - 1
        del shared, inverse
        weight = np.where(valid[order], copies[owner[order]], 0)
        often = np.bincount(classes, weights=weight) >= 2
        del weight, owner
        repeated = np.zeros(len(data), bool)
        repeated[order] = often[classes]
        repeated &= valid
        sent = np.zeros(len(data), bool)
        if spread.any():
            # the first of the windows of each class that are spread tells the other shards of them
            asks = np.flatnonzero((valid & np.repeat(spread, sizes))[order])
            sent[order[asks[np.unique(classes[asks], return_index=True)[1]]]] = True
        shard = group.column("shard")[0].as_py()
        rows: list[tuple] = []
        for i in range(len(texts)):
            a, k = int(starts[i]), int(sizes[i]) - length + 1
            first, last = _runs(repeated[a : a + k])
            digests = None
            at = np.flatnonzero(sent[a : a + k])
            if len(at):
                one = _rolling(data[a : a + int(sizes[i])], length)
                two = _rolling(data[a : a + int(sizes[i])], length, 0x9E3779B97F4A7C55)
                digests = np.stack([one[at], two[at], np.where(repeated[a : a + k], 2, copies[i])[at].astype(np.uint64), at.astype(np.uint64)], 1).tobytes()
            rows.append((group.column("h")[i].as_py(), group.column("print")[i].as_py(), first, last, shard, digests))
        h, prints, firsts, lasts, shards, digests = zip(*rows, strict=True)
        return pa.table(
            {
                "h": pa.array(h, pa.int64()),
                "print": pa.array(prints, pa.binary()),
                "first": pa.array(firsts, pa.list_(pa.int32())),
                "last": pa.array(lasts, pa.list_(pa.int32())),
                "shard": pa.array(shards, pa.int64()),
                "digests": pa.array(digests, pa.binary()),
            }
        )

    return scan


#: A window: its digest, how often it occurs (2: or more), where it stands in its surrounding, anchor and print.
_WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("n", "<u8"), ("at", "<u8"), ("h", "<i8"), ("print", "V16")])


def _windows(buckets: int):
    """The windows of each batch of surroundings packed by bucket, a row for each bucket that has any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "digests"):
                packed = part.column("digests").to_pylist()
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 32
                found = np.empty(int(sizes.sum()), _WINDOW)
                for c, x in zip(("one", "two", "n", "at"), np.frombuffer(b"".join(packed), np.uint64).reshape(-1, 4).T, strict=True):
                    found[c] = x
                found["h"] = np.repeat(part.column("h").to_numpy(), sizes)
                found["print"] = np.repeat(np.frombuffer(b"".join(part.column("print").to_pylist()), "V16"), sizes)
                bucket = (found["one"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, bucket = found[order], bucket[order]
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(found) else np.zeros(0, np.int64)
                rows = [found[a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(found)], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(rows, pa.binary())], ["bucket", "windows"])

    return scan


def _merge(group: pa.Table) -> pa.Table:
    """Windows of one bucket from all shards: each is looked up by binary search in all of them, sorted."""
    found = np.frombuffer(b"".join(group.column("windows").to_pylist()), _WINDOW)
    key = np.empty(len(found), np.dtype([("one", "<u8"), ("two", "<u8")]))
    key["one"], key["two"] = found["one"], found["two"]
    order = np.lexsort((key["two"], key["one"]))
    changes = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    heads = np.flatnonzero(changes)
    place = np.searchsorted(key[order][heads], key)
    total = np.bincount(place, weights=found["n"])
    kept = found[(total[place] >= 2) & (found["n"] < 2)]
    names = np.stack([kept["h"], *np.ascontiguousarray(kept["print"]).view(np.int64).reshape(-1, 2).T], 1)
    order = np.lexsort((kept["at"], *names.T))
    kept, names = kept[order], names[order]
    starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])) if len(kept) else np.zeros(0, np.int64)
    at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(kept)).astype(np.int32)), pa.array(kept["at"].astype(np.int32)))
    return pa.table({"h": pa.array(kept["h"][starts]), "print": pa.array([x.tobytes() for x in kept["print"][starts]], pa.binary()), "at": at})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted surroundings of each document."""
    for batch in batches:
        for part in slices(batch, "raw"):
            rows = [
                (w["h"], w["print"], w["n"], w["m"], w["room"], raw[w["start"] : w["start"] + w["size"]])
                for raw, wanted in zip(part.column("raw").to_pylist(), part.column("wanted").to_pylist(), strict=True)
                for w in wanted
            ]
            if rows:
                h, name, n, m, room, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(name, pa.binary()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(room, pa.int64()), pa.array(text, pa.binary())],
                    ["h", "print", "n", "m", "room", "text"],
                )


def _kept(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                rows = []
                for raw, firsts, lasts in zip(part.column("raw").to_pylist(), part.column("firsts").to_pylist(), part.column("lasts").to_pylist(), strict=True):
                    kept, at, spans, removed = [], 0, 0, 0
                    for first, last in sorted(zip(firsts or [], lasts or [], strict=True)):
                        end = last + length
                        if end <= at and spans:
                            continue
                        if first > at or not spans:
                            kept.append(raw[at:first])
                            spans += 1
                            at = first
                        removed += end - at
                        at = end
                    kept.append(raw[at:])
                    rows.append((len(raw), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
                n, removed, spans, sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return scan


def _dealt(surroundings: DataFrame, shards: int, shard_bytes: int, spread: int) -> DataFrame:
    """Adds the shard of each of the surroundings, and whether its anchor is spread over all shards."""
    wide = F.col("m") > spread
    # several large anchors in one shard would make it many times as large as the others
    own = F.col("room") > shard_bytes // 16
    shard = F.when(wide, F.pmod(F.xxhash64("h", "print"), F.lit(shards))).when(own, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards)))
    return surroundings.withColumn("shard", shard).withColumn("spread", wide)


def _asked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows with `asked`: false only where wanted (w_id, w_dh) does not name the document, by a map of hashed keys."""
    spot = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(1 << SPOT_BITS))
    block, inside = F.shiftright("spot", SPOT_ROW), F.col("spot") % (1 << SPOT_ROW)
    spots = wanted.select(spot("w_id", "w_dh").alias("spot")).select(block.alias("block"), inside.alias("inside"))
    marked = cut_lineage(spots.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("inside").alias("marked")))  # of fixed size
    placed = rows.withColumn("spot", spot("doc_id", "dh")).withColumn("block", block).join(F.broadcast(marked), "block", "left")
    byte = F.conv(F.hex(F.substring("marked", (inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.withColumn("asked", F.coalesce(F.getbit(byte, (inside % 8).cast("int")) == 1, F.lit(False))).drop("spot", "block", "marked")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Removes each byte covered by a `length`-byte string that also starts elsewhere, in the same row or another; strings
    are judged on the input. Null texts are empty, repeated rows count as often as they stand there, and texts shorter
    than `length` stay whole. Only doc_id and text are read.
    """
    small_batches(docs.sparkSession)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).withColumn("dh", F.xxhash64("raw"))
    anchors = rows.select("doc_id", "dh", "raw").mapInArrow(_anchor_rows(length, gram), _ANCHORS).persist(StorageLevel.MEMORY_AND_DISK)
    often = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h")
    met = anchors.join(often, "h", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    kinds = met.groupBy("h", "print").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "dh", "start", "size")).alias("of"))
    kinds = kinds.persist(StorageLevel.MEMORY_AND_DISK)
    different = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("of.size").cast("long")).alias("room")).filter("m > 1")
    # surroundings that all their anchor's places share need no sorting: each window stands in all of those places
    whole = kinds.join(different, "h", "left_anti").select("h", "print", F.array(F.lit(0)).alias("first"), F.array((F.col("of.size") - length).cast("int")).alias("last"))
    wanted = kinds.join(different, "h").select(F.col("of.doc_id").alias("w_id"), F.col("of.dh").alias("w_dh"), F.struct("h", "print", "n", "m", "room", "of.start", "of.size").alias("w"))
    wanted = wanted.groupBy("w_id", "w_dh").agg(F.collect_list("w").alias("wanted")).persist(StorageLevel.MEMORY_AND_DISK)  # of one document
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("dh") == F.col("w_dh"))
    surroundings = _asked(rows, wanted).filter("asked").join(wanted.hint("shuffle_hash"), same).select("raw", "wanted").mapInArrow(_cut, "h long, print binary, n long, m long, room long, text binary")
    surroundings = surroundings.dropDuplicates(["h", "print"]).persist(StorageLevel.MEMORY_AND_DISK)
    total = surroundings.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = _dealt(surroundings, shards, shard_bytes, spread)
    found = dealt.groupBy("shard").applyInArrow(_search(length), _FOUND).persist(StorageLevel.MEMORY_AND_DISK)
    told = found.filter("digests is not null").select("h", "print", "digests")
    buckets = max(1, -(-2 * (told.agg(F.sum(F.length("digests"))).first()[0] or 0) // BUCKET_BYTES))
    merged = told.mapInArrow(_windows(buckets), "bucket long, windows binary").groupBy("bucket").applyInArrow(_merge, "h long, print binary, at array<int>")
    merged = merged.select("h", "print", F.col("at").alias("first"), F.col("at").alias("last"))
    ranges = whole.unionAll(found.select("h", "print", "first", "last")).unionAll(merged).filter(F.size("first") > 0)
    placed = met.join(ranges, ["h", "print"]).select("doc_id", "dh", F.transform("first", lambda x: x + F.col("start")).alias("first"), F.transform("last", lambda x: x + F.col("start")).alias("last"))
    spans = placed.groupBy(F.col("doc_id").alias("w_id"), F.col("dh").alias("w_dh")).agg(F.flatten(F.collect_list("first")).alias("firsts"), F.flatten(F.collect_list("last")).alias("lasts"))  # of one document
    spans = spans.persist(StorageLevel.MEMORY_AND_DISK)
    asked = _asked(rows, spans)
    none = F.lit(None).cast("array<int>")
    cut = asked.filter("asked").join(spans.hint("shuffle_hash"), same, "left").select("doc_id", "raw", "firsts", "lasts")
    rest = asked.filter("not asked").select("doc_id", "raw", none.alias("firsts"), none.alias("lasts"))
    return cut.unionAll(rest).mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
