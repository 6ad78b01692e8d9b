"""Token files, Merkle manifest and fill-in-middle against brute force and SQL."""

import hashlib
import re
import zlib
from itertools import combinations, product

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.llm import infill, merkle, packing, registry, tokenfiles, tokens
from trawl.llm.huffman import STEP, Code, code_lengths

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ODD = ["<|endoftext|>a b", "it's I'LL don't, 's", "Ａ１ ½x ²", "é ≠ H̱ é", "ΟΔΟΣ, İx", "a\tb c\r\nd", "naïve,Straße;x9y8--z..", "µªº ÷×", "emoji😀x", "l'été's x", "<|ENDOFTEXT|>"]


# token ids


def whole(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_are_the_tokenizers(prose):
    texts = [*prose, *ODD]
    encoder = tokens.Encoder(VOCABULARY)
    assert encoder.by_word
    for _ in range(2):
        ids, bounds = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole(texts)


@given(st.lists(st.text(st.sampled_from("aBé' ,<|>endoftx9\ńß"), max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(texts):
    ids, bounds = tokens.Encoder.of(VOCABULARY).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole(texts)


def test_other_vocabularies_take_the_whole_way(prose):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens.Encoder(path)
    assert not encoder.by_word
    ids, bounds = encoder.encode(pa.array(prose[:20]))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in prose[:20]]


def test_a_worker_keeps_no_words_after_its_task(frame):
    def kept(batches):
        for _ in batches:
            encoder = tokens.Encoder._kept.get(VOCABULARY)
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder.words.rows) if encoder else 0], pa.int64())], ["n"])

    docs = frame(["some words that are kept for a while"]).coalesce(1)
    assert packing.pieces(docs, VOCABULARY).count() == 1
    assert [r.n for r in docs.mapInArrow(kept, "n long").collect()] == [0]
    assert tokenfiles.token_table(docs, VOCABULARY).count() == 1
    assert [r.n for r in docs.mapInArrow(kept, "n long").collect()] == [0]
    with tokens.encoding(VOCABULARY) as encoder:
        encoder.encode(pa.array(["a word", None]))
        assert encoder.words.rows
    assert not encoder.words.rows


def test_a_full_memory_starts_anew(prose, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    encoder = tokens.Encoder(VOCABULARY)
    for t in prose[:10]:
        assert encoder.encode(pa.array([t]))[0].tolist() == whole([t])[0]


# codes


@pytest.mark.parametrize("limit", [3, 4, 6])
def test_lengths_are_the_best_within_the_limit(limit):
    rng = np.random.default_rng(limit)
    for n in (2, 3, 5, 6):
        counts = rng.integers(1, 200, n)
        lengths = code_lengths(counts, limit)
        limit_ = max(limit, (n - 1).bit_length() + 1)
        best = min(int((counts * np.array(x)).sum()) for x in product(range(1, limit_ + 1), repeat=n) if sum(2.0**-k for k in x) <= 1)
        assert int((counts * lengths).sum()) == best and lengths.max() <= limit_ and sum(2.0 ** -lengths.astype(float)) == 1


@given(st.integers(1, 300), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip(n, seed):
    rng = np.random.default_rng(seed)
    counts = (rng.pareto(0.3, n) * 5 + 1).astype(np.int64)
    symbols = np.sort(rng.choice(70000, n, replace=False))
    code = Code(symbols, code_lengths(counts))
    words = [format(int(code.code[s]), f"0{code.size[s]}b") for s in symbols]
    assert not any(b.startswith(a) for a, b in combinations(sorted(words), 2))
    sizes = rng.integers(0, 4 * STEP, 20)
    ids = rng.choice(symbols, int(sizes.sum())).astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data, byte_bounds, marks, point_bounds = code.encode(ids, bounds)
    for i in range(20):
        bits = "".join(format(int(code.code[x]), f"0{code.size[x]}b") for x in ids[bounds[i] : bounds[i + 1]])
        assert "".join(format(b, "08b") for b in data[byte_bounds[i] : byte_bounds[i + 1]]) == bits.ljust(-(-len(bits) // 8) * 8, "0")
    points = np.diff(point_bounds)
    starts = marks + 8 * np.repeat(byte_bounds[:-1], points)
    counts = np.full(len(starts), STEP)
    has = sizes > 0
    counts[point_bounds[1:][has] - 1] = (sizes - STEP * (points - 1))[has]
    assert code.decode(data, starts, counts).tolist() == ids.tolist()


# token files


def check_files(spark, df, folder):
    tokenfiles.write_tokens(df, VOCABULARY, folder)
    got = sorted(map(tuple, tokenfiles.read_tokens(spark, folder, with_ids=True).select("start", "doc_id", "n_tokens", "ids_crc32", "ids").collect()))
    rows = df.select("doc_id", "text").collect()
    pairs = [(r.doc_id, np.array([*x, 2], "<u4")) for r, x in zip(rows, whole([r.text for r in rows]), strict=True)]
    pairs.sort(key=lambda p: (p[0] is not None, p[0] or 0, zlib.crc32(p[1].tobytes())))
    at = 0
    for (start, doc_id, n, crc, ids), (want, held) in zip(got, pairs, strict=True):
        assert (start, doc_id, n, crc, list(ids)) == (at, want, len(held), zlib.crc32(held.tobytes()), held.tolist())
        at += n


def test_files_give_back_every_document(spark, frame, prose, tmp_path):
    texts = [*prose, *ODD, "many words here " * 40000]
    both = frame(texts).unionAll(frame(texts[:9])).unionAll(frame([None, "x"]).withColumn("doc_id", F.lit(None).cast("long")))
    check_files(spark, both.withColumn("data", F.lit(1)).withColumn("part", F.lit(2)).repartition(5), str(tmp_path / "a"))


def test_a_document_id_of_many_rows_spreads_over_parts(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PART_IDS", 200)
    rows = frame([f"text {i % 90} of many" for i in range(300)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 77).when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("doc_id")))
    check_files(spark, rows.repartition(4), str(tmp_path / "a"))
    blocks = spark.read.parquet(str(tmp_path / "a/blocks"))
    assert blocks.filter(F.array_contains("doc_ids", 77)).select("part").distinct().count() > 1


def test_files_of_an_empty_table(spark, empty, tmp_path):
    check_files(spark, empty, str(tmp_path / "a"))


def test_one_symbol_only(spark, frame, tmp_path):
    check_files(spark, frame([None, "", " \n"]), str(tmp_path / "a"))


def test_blocks_hold_whole_documents_and_decode_alone(spark, frame, tmp_path):
    folder = str(tmp_path / "a")
    tokenfiles.write_tokens(frame(["one two three four five six seven " * 4000] * 60).repartition(3), VOCABULARY, folder)
    code = tokenfiles.read_code(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks").collect()
    assert len(blocks) > 4 and sum(len(b.doc_ids) for b in blocks) == 60
    for b in blocks:
        ids = tokenfiles.decode_block(code, np.array(b.doc_tokens), np.frombuffer(b.data, np.uint8), np.frombuffer(b.points, "<u2"))
        assert len(ids) == b.n_ids == sum(b.doc_tokens) and ids[-1] == 2


def test_contract_columns_of_tokens(spark):
    assert registry.op11_tokens(spark, DATA).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of dicts, by walking the tree for every row."""

    def told(row, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        steps = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            steps.append((run[: i % 8], run[i % 8 + 1 :]))
            i //= 8
        return steps

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    branches = {}
    for r in rows:
        branches.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, told(r, r["text"]), r))
    names = sorted(branches, key=lambda b: (b is not None, (b or "").encode()))
    trees = {b: tree([x[2] for x in sorted(branches[b], key=lambda x: x[:3])]) for b in names}
    top = tree([trees[b][-1][0] for b in names]) if names else None
    out = []
    for j, b in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(branches[b], key=lambda x: x[:3])):
            steps = path(trees[b], i) + path(top, j)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now = told(r, r["text"].translate(lower)) if bad and r["text"] is not None else own
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((r["doc_id"], own, trees[b][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), now, now == top[-1][0]))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check_manifest(df):
    want = brute_manifest([r.asDict() for r in df.select(*merkle.FIELDS).collect()])
    got = merkle.verify(merkle.manifest(df)).select(*NAMES)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    return want


def test_manifest_of_branches_of_every_size(spark, frame):
    sizes = [(None, 1), ("", 7), ("en", 8), ("é", 9), ("fr", 65), ("zz", 130), ("a", 1), ("b", 2), ("c", 1), ("d", 3)]
    langs = [lang for lang, n in sizes for _ in range(n)]
    both = frame([f"Text {i % 50}" if i % 11 else None for i in range(len(langs))]).join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, name string"), "doc_id").withColumn("lang", F.col("name"))
    repeated = both.unionAll(both.filter("doc_id % 5 = 0")).unionAll(both.filter("doc_id % 9 = 0").withColumn("text", F.lit("Other"))).unionAll(both.filter("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long")))
    crowded = repeated.withColumn("branch", F.lit(1)).withColumn("node", F.lit(2)).withColumn("path", F.lit(3)).withColumn("digest", F.lit(4))
    want = check_manifest(crowded.repartition(7))
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9])
def test_manifest_of_one_branch(frame, n):
    check_manifest(frame([f"A {i}" for i in range(n)]) if n else frame(["x"]).limit(0))


def test_manifest_of_nulls_and_long_texts(spark, frame, prose):
    rows = frame([*prose, "Long one " * 300000])
    blank = rows.limit(3).select(*(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    check_manifest(rows.unionAll(blank))


# fill-in-middle


def brute_infill(doc_id, text):
    text = text or ""
    tok = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    told = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tok)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tok[:a], tok[a:b], tok[b:]))
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def check_infill(df):
    made = infill.fill_in_middle(df)
    rows = df.select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(str(brute_infill(r.doc_id, r.text)) for r in rows)
    back = made.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in rows))) == sorted(map(str, ((r.doc_id, r.text) for r in back)))


def test_infill_matches_brute_force(frame, prose):
    marked = ["a <P> b", "<S", "x<M>y", "<<S> z", "P> S> M>", "ends with <", "<P", "aé" * 3000, "é" * 900, "ab " * 700000, "z" * 3000]
    long = ["One two, three! " * 300 + str(i) for i in range(40)]
    both = frame([*prose, *ODD, *marked, *long])
    check_infill(both.unionAll(both.limit(20)).unionAll(both.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("output", F.lit(1)).withColumn("form", F.lit(2)))


def test_infill_of_an_empty_table(empty):
    assert infill.digested(infill.fill_in_middle(empty)).count() == 0


@given(st.lists(st.text(st.sampled_from("abZ é😀.<"), max_size=60), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_chunks_count_as_their_text(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    starts = infill.chunk_starts(data, bounds)
    assert set(bounds[:-1][np.diff(bounds) > 0]) <= set(starts)
    if len(starts):
        told = infill.Memory().summaries(data, starts)
        assert told[:, 1].sum() == len("".join(texts))


def test_chunks_of_a_passage_are_the_same_wherever_it_stands(prose):
    passage = max((t for t in prose if t), key=lambda t: len(set(t.split()))).encode()
    cut = []
    for ahead in (b"", b"some words ahead of it, of any length ", b"x" * 700):
        data = np.frombuffer(ahead + passage, np.uint8)
        starts = infill.chunk_starts(data, np.array([0, len(data)])) - len(ahead)
        cut.append({int(s) for s in starts if s > 400})
    assert len(cut[0]) > 50 and cut[0] == cut[1] == cut[2]


def test_memory_starts_anew_when_full(frame, prose, monkeypatch):
    monkeypatch.setattr(infill, "MEMORY", 100)
    memory = infill.Memory()
    for _ in range(3):
        data = np.frombuffer(prose[0].encode(), np.uint8)
        told = memory.summaries(data, infill.chunk_starts(data, np.array([0, len(data)])))
        assert told[:, 1].sum() == len(prose[0])


# SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLES[name]).df()
    key = ["doc_id"]
    pd.testing.assert_frame_equal(ours.sort_values(key).reset_index(drop=True), theirs[ours.columns].sort_values(key).reset_index(drop=True), check_dtype=False)
