"""Token ids of whole columns of texts, by way of their distinct words.

A vocabulary whose normaliser and splitter never look across a space or a line feed gives a text the ids of its words in
a row. A worker splits a slice of texts and numbers its distinct words in Arrow, encodes those that it has not met, and
gathers the ids by word number; no loop runs over all words. Words of plain Latin letters, digits and signs are cut as the
vocabulary's splitter would cut them and only merged by its model; all other words take the tokenizer's whole way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trawl.llm.common import ragged

#: Bytes of text encoded at once.
SLICE = 2 << 20

#: Words, and parts of words, whose ids a worker keeps at most; beyond that it starts anew.
CACHE_WORDS = 1 << 19

#: Parts that the model merges in one call.
RUN = 500

#: The vocabulary's splitter, for which words are known to be independent.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]

#: Words that no composition and no contraction can touch, and, once they are in lower case, their parts between spaces.
PLAIN = r"^[!-&(-~À-ÖØ-öø-ÿ]+$"
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+| ")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is printable, else the next free one."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Kept:
    """Ids of strings, in one arena."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.arena, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, strings: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(max(len(self.arena), len(ids)), np.uint32)])
        self.arena[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(ids)
        self.rows.update(zip(strings, range(len(self.rows), len(self.rows) + len(strings)), strict=True))

    def find(self, strings) -> np.ndarray:
        """The row of each string, -1 for unknown ones."""
        get = self.rows.get
        return np.fromiter((get(x, -1) for x in strings), np.int64, len(strings))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, and how many each has."""
        lengths = self.lengths[rows]
        return self.arena[ragged(self.starts[rows], lengths)], lengths


class Encoder:
    """Ids by a vocabulary file; `of` keeps one a worker."""

    _kept: dict[str, Encoder] = {}
    _letters = _byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = steps == NORMALISERS and bool(cuts) and cuts[0].get("pattern", {}).get("Regex") == SPLITTER and not cuts[-1]["add_prefix_space"] and bool(told["model"].get("end_of_word_suffix"))
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        if self.by_word:
            self.merger = Tokenizer(self.tokenizer.model)
            self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            suffix = told["model"]["end_of_word_suffix"]
            self.final = np.zeros(self.vocabulary, bool)
            self.final[[i for t, i in told["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _reset(self) -> None:
        self.words, self.parts = _Kept(), _Kept()
        self.parts.add([" "], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts in a row and how many each has. The model ends each part with an id of its own kind."""
        spelt = [p if p.isascii() else "".join(map(self._letters.__getitem__, p.encode())) for p in parts]
        runs = [" ".join(spelt[i : i + RUN]) for i in range(0, len(spelt), RUN)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.merger.encode_batch_fast(runs, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(parts):
            one = [[t.id for t in self.tokenizer.model.tokenize(p)] for p in spelt]
            return np.fromiter(chain.from_iterable(one), np.uint32), np.fromiter(map(len, one), np.int64, len(one))
        return ids, np.diff(ends, prepend=0)

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words in a row and how many each has, by their parts."""
        found = PARTS.findall(" ".join(words).lower())
        numbered = pa.array(found, pa.string()).dictionary_encode()
        parts = numbered.dictionary.to_numpy(zero_copy_only=False)
        known = self.parts.find(parts)
        unknown = np.flatnonzero(known < 0)
        if len(unknown):
            known[unknown] = np.arange(len(self.parts.rows), len(self.parts.rows) + len(unknown))
            fresh = parts[unknown].tolist()
            self.parts.add(fresh, *self._merged(fresh))
        rows = known[numbered.indices.to_numpy()]
        ids, lengths = self.parts.take(rows)
        ends = np.append(np.flatnonzero(rows == 0), len(rows))
        return ids, np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[ends], prepend=0)

    def _learn(self, words: pa.Array) -> None:
        plain = pc.match_substring_regex(words, PLAIN)
        if self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(words, self.special)))
        easy = words.filter(plain).to_numpy(zero_copy_only=False).tolist()
        if easy:
            self.words.add(easy, *self._cut(easy))
        odd = words.filter(pc.invert(plain)).to_pylist()
        ids = [self.tokenizer.encode(w, add_special_tokens=False).ids if w else [] for w in odd]
        self.words.add(odd, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: none), and where each text's begin, with the end as last entry."""
        column = pc.fill_null(column, "")
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
            bounds = np.cumsum([0, *map(len, ids)])
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(bounds[-1])), bounds
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False)
        if len(self.words.rows) + len(words) > CACHE_WORDS or len(self.parts.rows) > CACHE_WORDS:
            self._reset()
        known = self.words.find(words)
        unknown = known < 0
        if unknown.any():
            self._learn(numbered.dictionary.filter(pa.array(unknown)))
            known[unknown] = self.words.find(words[unknown])
        ids, lengths = self.words.take(known[numbered.indices.to_numpy()])
        per_word = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        counts = pc.list_value_length(split).to_numpy()
        return ids, per_word[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])]


@contextmanager
def encoding(path: str) -> Iterator[Encoder]:
    """The worker's encoder for a task. The words it kept go with the task: a worker lives on, and later stages need the room."""
    encoder = Encoder.of(path)
    try:
        yield encoder
    finally:
        encoder._reset()
        pa.default_memory_pool().release_unused()


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)
