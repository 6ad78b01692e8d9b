"""Near-duplicate vectors against all pairs, and the pipeline against its stages' brute-force versions."""

import zlib

import numpy as np
import pandas as pd
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from trawl.llm import neardup, pii, quality
from trawl.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def all_pairs(vectors):
    unit = np.stack(vectors) / np.linalg.norm(np.stack(vectors), axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    root = list(range(len(unit)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(links, 1)), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return links.sum(1) - 1, np.array([find(i) for i in range(len(unit))])


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_links(spark, block):
    draw = np.random.default_rng(0)
    base = draw.normal(size=(300, 32))
    near = [base[i] + draw.normal(size=32) * s for i in range(40) for s in (0.1, 0.3, 0.45)]
    crowd = [base[0] + draw.normal(size=32) * 0.2 for _ in range(60)]
    vectors = [*base, *near, *crowd, base[5] * 3, base[5] * 3]
    odd = [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0, 2.0]]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)] + [(1000 + i, v, None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = neardup.link_vectors(df, block=block).toPandas().set_index("vec_id").sort_index()
    n, root = all_pairs(vectors)
    ours = got.loc[range(len(vectors))]
    assert (ours.n_links.to_numpy() <= n).all()
    assert ours.n_links.sum() >= 0.9 * n.sum()
    # a class of ours never joins what links do not
    assert pd.Series(root).groupby(ours.component_id.to_numpy()).nunique().max() == 1
    assert (got.kept == (got.index == got.component_id)).all()
    assert (got.loc[1000:].n_links == 0).all() and got.loc[1000:].kept.all()


def test_vectors_of_several_dimensions(spark):
    draw = np.random.default_rng(2)
    rows, want = [], {}
    for dim, n in ((16, 60), (8, 30), (1, 2)):
        first = len(rows)
        for i in range(n):
            v = draw.normal(size=dim) if dim > 1 else np.ones(1)
            rows += [(len(rows) + k, [float(x) for x in v]) for k in (0, 1)]
        want[dim] = range(first, len(rows))
    got = neardup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    assert len(got) == len(rows)
    for dim, ids in want.items():
        ours = got.loc[ids]
        assert (ours.n_links >= 1).all() and ours.component_id.isin(ids).all()
        n, _ = all_pairs([np.array(rows[i][1]) for i in ids])
        assert (ours.n_links.to_numpy() <= n).all()


def test_vectors_of_nothing(spark):
    assert neardup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert neardup.link_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().kept


def test_codes_are_balanced():
    sample = np.random.default_rng(1).normal(size=(2000, 24)) + 3
    bits = neardup.learn(sample, 48).bits(sample)
    assert (np.abs(bits.mean(0) - 0.5) < 0.1).all()


def test_pipeline_against_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = quality.score(spark.read.parquet(f"{DATA}/documents.parquet"), labels).toPandas()
    docs = docs[docs.doc_id.isin(scores[scores.predicted == 1].doc_id)]

    def shingles_of(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = [(i, shingles_of(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    root = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, x in sets:
            for j, y in sets:
                both = len(x & y)
                if both and 100 * both >= 75 * len(x | y) and root[i] != root[j]:
                    low, high = min(root[i], root[j]), max(root[i], root[j])
                    root = {k: low if r == high else r for k, r in root.items()}
                    changed = True
    docs = docs[[root[i] == i for i in docs.doc_id]]
    flat = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in t.lower()).split())} "
    items = [flat(t) for t in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas().text]
    exact = {i for i, t in zip(docs.doc_id, docs.text, strict=True) if any(x in flat(t) for x in items)}
    rows = corpus_pipeline.run(spark, DATA).toPandas()
    kept = set(rows.doc_id)
    assert kept == set(docs.doc_id) - exact
    anchors, tokenizer = pii.automaton(), Tokenizer.from_file(path("word_bpe_49k.json"))
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        if i in kept:
            ids = np.array([*tokenizer.encode(pii.mask(t, pii.find_spans(t, anchors)), add_special_tokens=False).ids, 2], "<u4")
            for r in rows[rows.doc_id == i].itertuples():
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_registered_names():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(ORACLES) <= set(QUERIES)
