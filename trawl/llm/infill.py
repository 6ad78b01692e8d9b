"""Fill-in-middle: documents cut in three and put in another order, so that a model learns to fill gaps.

Cuts fall between tokens, `[A-Za-z]+|[^A-Za-z]`, and are asked for by number. Content-defined chunk memoization finds
them: a rolling hash cuts a text into chunks wherever the hash is the least for a while, so equal passages fall into equal
chunks; a worker keeps, for each chunk's content, its number of tokens and characters and whether letters stand at its
ends. The numbers of a text's chunks add up, less one token wherever a run of letters crosses from one into the next, and
lead to the one chunk that holds a cut; only that chunk is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import mix64, slices

#: Bytes that the rolling hash sees, and bytes before a cut with no hash as small: a chunk has about so many.
REACH = 32
WINDOW = 256
#: Bytes of chunks that a worker remembers.
MEMORY = 64 << 20
SLICE = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts in a row: at each text that is not empty, and after each byte whose
    hash is less than those of the WINDOW - 1 bytes before. Runs of equal hashes are not cut."""
    n = len(data)
    held = _GEAR[data]
    reach = 1
    while reach < REACH:
        held[reach:] += held[:-reach] << np.uint32(reach)
        reach *= 2
    least, seen = held.copy(), 1
    while seen < WINDOW:
        np.minimum(least[seen:], least[:-seen].copy(), out=least[seen:])
        seen *= 2
    cut = np.zeros(n + 1, bool)
    cut[2:n] = held[1 : n - 1] < least[: n - 2]
    cut[bounds] = True
    cut[n] = False
    return np.flatnonzero(cut)


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data | 32) - 97).astype(np.uint8) < 26


class Memory:
    """Summaries of chunks by their content."""

    def __init__(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.size = 0
        self.table = np.zeros((0, 4), np.int64)

    def summaries(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row a chunk: tokens if no letter came before, characters, a letter first, a letter last."""
        raw = data.tobytes()
        ends = np.append(starts[1:], len(data))
        chunks = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if self.size > MEMORY:
            self.__init__()
        fresh = list(dict.fromkeys(c for c in chunks if c not in self.rows))
        if fresh:
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, _summarise(fresh)])
            self.size += sum(map(len, fresh))
        return self.table[np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))]


def _summarise(chunks: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(chunks), np.uint8)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    first = np.cumsum(sizes) - sizes
    letter, whole = _letters(data), (data & 0xC0) != 0x80
    begins = whole.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[first] = whole[first]
    count = lambda x: np.add.reduceat(x.astype(np.int64), first)
    return np.stack([count(begins), count(whole), letter[first], letter[first + sizes - 1]], axis=1)


def _within(chunk: np.ndarray, crossing: bool, k: int) -> int:
    """The byte at which token k of the chunk begins; a crossing chunk's first letters are of the token before it."""
    letter, begins = _letters(chunk), (chunk & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    if crossing:
        begins[0] = False
    return int(np.flatnonzero(begins)[k])


def choices(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers drawn by seed and doc_id; a null doc_id draws as the empty text."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(told[i : i + 8], 16) for i in (0, 8, 16, 24))


ROWS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, *, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Of four numbers drawn by doc_id the first two give the cuts, the third (of 100) whether a document stays plain, the
    fourth whether its suffix comes first. Null text is empty and, like every empty text or one that holds a marker,
    stays plain. Texts of any length are a row each and cut by chunks; repeated rows give equal rows; an empty table
    gives none; only doc_id and text are read, other columns may have any name.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield _transformed(part, memory, seed, plain_from, spm_below)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(transform, ROWS)


def _transformed(part: pa.RecordBatch, memory: Memory, seed: int, plain_from: int, spm_below: int) -> pa.RecordBatch:
    texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    starts = chunk_starts(data, bounds) if len(data) else np.zeros(0, np.int64)
    told = memory.summaries(data, starts) if len(starts) else np.zeros((0, 4), np.int64)
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    crossing = np.zeros(len(starts), bool)
    crossing[1:] = (told[1:, 2] & told[:-1, 3]).astype(bool) & ~begins[starts[1:]]
    tokens = np.concatenate([np.zeros(1, np.int64), np.cumsum(told[:, 0] - crossing)])
    chars = np.concatenate([np.zeros(1, np.int64), np.cumsum(told[:, 1])])
    first = np.searchsorted(starts, bounds)
    ends = np.append(starts, len(data))
    raw = data.tobytes()

    def located(i: int, k: int) -> tuple[int, int]:
        """Byte and character (of the row of texts) at which text i's token k begins, or its end."""
        wanted = tokens[first[i]] + k
        if wanted == tokens[first[i + 1]]:
            return int(bounds[i + 1]), int(chars[first[i + 1]])
        c = int(np.searchsorted(tokens, wanted, side="right")) - 1
        chunk = data[ends[c] : ends[c + 1]]
        at = _within(chunk, crossing[c], int(wanted - tokens[c]))
        return int(ends[c]) + at, int(chars[c] + np.count_nonzero((chunk[:at] & 0xC0) != 0x80))

    rows = []
    for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
        text = raw[bounds[i] : bounds[i + 1]]
        n = int(tokens[first[i + 1]] - tokens[first[i]])
        one, two, three, four = choices(doc_id, seed)
        if not text or three % 100 >= plain_from or any(m in text for m in (b"<P>", b"<S>", b"<M>")):
            rows.append((doc_id, n, "plain", None, None, text))
            continue
        (a, a_chars), (b, b_chars) = (located(i, k) for k in sorted((one % (n + 1), two % (n + 1))))
        prefix, middle, suffix = (b"<P>", raw[bounds[i] : a]), (b"<M>", raw[a:b]), (b"<S>", raw[b : bounds[i + 1]])
        form = "spm" if four % 100 < spm_below else "psm"
        order = (suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle)
        rows.append((doc_id, n, form, a_chars - int(chars[first[i]]), b_chars - a_chars, b"".join(x for pair in order for x in pair)))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], [c.split()[0] for c in ROWS.split(", ")])


def restored(output: Column, form: Column) -> Column:
    """The document's text, from what fill_in_middle made of it and the form alone."""
    second, width = F.when(form == "psm", SUFFIX).otherwise(PREFIX), len(PREFIX)
    body = F.substr(output, F.lit(width + 1))
    one = F.substring_index(body, MIDDLE, 1)
    at = F.locate(SUFFIX, one)
    at = F.when(form == "psm", at).otherwise(F.locate(PREFIX, one))
    ahead, behind = F.substr(one, F.lit(1), at - 1), F.substr(one, at + F.length(second))
    middle = F.substr(body, F.length(one) + F.lit(width + 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(ahead, middle, behind)).otherwise(F.concat(behind, middle, ahead))


def digested(rows: DataFrame) -> DataFrame:
    """The rows with sha256 of output and of the text restored from it, in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """WITH own AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tok, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, len(tok)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM own),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parted AS (SELECT *, array_to_string(tok[:a], '') AS pre, array_to_string(tok[a + 1:b], '') AS mid, array_to_string(tok[b + 1:], '') AS suf FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parted"""
