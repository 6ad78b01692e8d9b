"""The operators on texts against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trawl.llm import decontaminate, language, lattice, packing, pii, quality, secrets, shingles, suffixes


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# 1


def test_lattice_base_scores(frame, prose):
    got = {r.doc_id: r for r in lattice.score(frame(prose), path("piece_bpe_32k.model")).collect()}
    counts = collections.Counter()
    tokens = {i: [*words(t), None] for i, t in enumerate(prose)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    for i, x in tokens.items():
        if not held[i]:
            counts.update(x)
    n, v = sum(counts.values()), len(counts)
    for i, x in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(counts[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert -math.inf < r.score < 0


def test_forward_recursion_sums_all_segmentations():
    pieces = lattice.Pieces.load(path("piece_bpe_32k.model"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    logp = pieces.weights(np.random.default_rng(1).random(len(pieces.prior)) * 100)
    known = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i)}

    def brute(word):
        total = 0.0
        for cuts in itertools.product([False, True], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            parts.append(word[last:])
            if all(p in known and (len(p) == 1 or "▁" not in p[1:]) for p in parts):
                total += math.exp(sum(logp[known[p]] for p in parts))
        return math.log(total)

    some = ["the", "thering", "a", "inghand", "zq", "únder"]
    got = lattice.word_log_probability([w.encode() for w in some], pieces, [logp])[:, 0]
    assert np.allclose(got, [brute("▁" + w) for w in some])
    assert np.isfinite(lattice.word_log_probability(["\U0001f600亜".encode(), b"x" * 3000], pieces, [logp])).all()


def test_expected_counts_add_up_to_characters():
    pieces = lattice.Pieces.load(path("piece_bpe_32k.model"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    counts = lattice.expected_counts([b"thering", b"hand", b"of"], pieces, pieces.weights())
    size = np.array([len(model.id_to_piece(i)) for i in range(model.get_piece_size())])
    assert math.isclose((counts * size).sum(), len("thering") + len("hand") + len("of") + 3, rel_tol=1e-9)


def test_lattice_of_nothing(frame, empty):
    assert lattice.score(empty, path("piece_bpe_32k.model")).count() == 0
    one = lattice.score(frame([None]), path("piece_bpe_32k.model")).first()
    assert one.n_tokens == 1 and math.isfinite(one.score)


# 2


def repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        flags = gone[:-1] if len(b) else gone[:0]
        out.append((len(b), int(flags.sum()), int((np.diff(np.concatenate([[0], flags])) == 1).sum()), hashlib.sha256(bytes(x for x, f in zip(b, flags, strict=True) if not f)).hexdigest()))
    return out


@pytest.mark.parametrize("spread", [2048, 1])
def test_repeated_strings(frame, prose, spread):
    texts = [*prose, "ab" * 900, "ab" * 450, prose[0], "start " + (prose[70] or "x") * 3]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame(texts), spread=spread).collect()}
    assert [got[i] for i in range(len(texts))] == repeats(texts, 400)


def test_repeated_rows_and_segments(frame, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    texts = prose[:20] + prose[-10:]
    twice = frame(texts).unionAll(frame(texts[:3]))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(twice).collect())
    want = repeats([*texts, *texts[:3]], 400)
    assert got == collections.Counter((i, *x) for i, x in zip([*range(len(texts)), 0, 1, 2], want, strict=True))


def test_windows_of_spread_anchors_meet_packed(frame, monkeypatch):
    draw = random.Random(8)
    base = "".join(draw.choice("abcdefgh ") for _ in range(900))
    texts = []
    for i in range(40):  # near copies: their windows meet across shards
        at = draw.randrange(100, 800)
        texts.append(base[:at] + f"<{i % 30}>" + base[at:])
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4096)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame(texts), spread=2, shard_bytes=4096).collect()}
    assert [got[i] for i in range(len(texts))] == repeats(texts, 400)
    windows = np.arange(4 * 500, dtype=np.uint64).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"x" * 16, b"y" * 16]), pa.array([windows, windows])], ["h", "print", "digests"])
    (out,) = suffixes._windows(4)(iter([batch]))
    assert out.num_rows <= 4 and sum(len(x) for x in out.column("windows").to_pylist()) == 1000 * suffixes._WINDOW.itemsize


def test_only_texts_that_are_asked_for_are_marked(spark):
    rows = spark.range(3000).selectExpr("if(id = 7, null, id) doc_id", "id * 31 dh")
    wanted = rows.filter("dh % 3 = 0").selectExpr("doc_id w_id", "dh w_dh")
    seen = suffixes._asked(rows, wanted).collect()
    assert len(seen) == 3000 and all(r.asked for r in seen if r.dh % 3 == 0)
    assert sum(r.asked for r in seen) < 1100
    assert not any(r.asked for r in suffixes._asked(rows, wanted.limit(0)).collect())


def test_repeats_of_nothing(empty):
    assert suffixes.remove_repeats(empty).count() == 0


def test_large_anchors_share_no_shard(spark):
    large = [(100 + h, bytes([i]), 1, 8, 8 << 10) for h in range(40) for i in range(8)]
    small = [(900 + h, b"s", 1, 2, 800) for h in range(40)]
    seen = spark.createDataFrame(large + small, "h long, print binary, n long, m long, room long")
    shards = collections.defaultdict(set)
    for r in suffixes._dealt(seen, 4, 64 << 10, 2048).collect():
        shards[r.shard].add(r.h)
    assert sorted(h for own in shards.values() for h in own) == sorted({r[0] for r in large + small})
    assert sum(any(h < 900 for h in own) for own in shards.values()) == 40


def test_suffix_array_needs_little_memory():
    data = np.tile(np.random.default_rng(5).integers(97, 123, 20_000).astype(np.uint8), 10)
    tracemalloc.start()
    try:
        suffixes.suffix_array(data)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 70 * len(data)


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(0)
    for _ in range(60):
        data = draw.integers(65, 68, draw.integers(1, 120)).astype(np.uint8)
        raw = data.tobytes()
        order, inverse = suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = suffixes.common_prefixes(data, order, inverse, np.array([0]), 20)
        for r in range(1, len(raw)):
            a, b = raw[order[r] :], raw[order[r - 1] :]
            want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[order[r]] == min(20, want)


# 3


def junk(text, draw):
    return " ".join(w + draw.choice(["***", "%%%", "$$$"]) for w in (text or "x").split())


def test_quality_separates_junk_on_held_out(spark, frame, prose):
    draw = random.Random(1)
    good = [t for t in prose if t and len(t) > 40] * 4
    texts = [*good, *(junk(t, draw) for t in good), None, ""]
    marks = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(2 * len(good))] + [(None, 1, 0), (0, None, 0), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score(frame(texts), marks).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(2 * len(good)) if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert np.mean([rows[i].predicted == (i < len(good)) for i in held]) > 0.97
    kept = {r.doc_id for r in quality.keep_good(frame(texts), marks).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted}


def test_quality_without_labels(spark, frame, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(frame(["a", None]), none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0


def test_isotonic_rises_and_keeps_the_mean():
    x, y, w = np.arange(6.0), np.array([0.1, 0.4, 0.2, 0.3, 0.9, 0.8]), np.array([1.0, 2, 1, 1, 3, 1])
    at, value = quality.isotonic(x, y, w)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    assert np.allclose(value, [0.1, 0.325, 0.875])


# 5


def test_secrets_are_found_and_false_ones_fall(frame):
    draw = random.Random(5)
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    texts = [f'some words token = "{hexes(40)}" and more' for _ in range(120)] + [f"invoice card 4{draw.randrange(10**14, 10**15)} of the order" for _ in range(120)]
    texts += [f"commit {hexes(40)} sha checksum" for _ in range(60)]
    texts += [f'password: "example{draw.randrange(1000, 9999)}"' for _ in range(60)] + [None, "", "no candidate here"]
    rows = secrets.scan(frame(texts)).collect()
    at = {(r.doc_id, r.start): texts[r.doc_id][r.start : r.start + r.length] for r in rows}
    assert all(hashlib.sha256(at[r.doc_id, r.start].encode()).hexdigest() == r.sha256 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and all(r.is_secret == (r.doc_id < 120) for r in held)


def test_secrets_unquoted_and_bare(frame):
    draw = random.Random(12)
    code = lambda n: "".join(draw.choice("abcdefghijkmnpqrABCDEFGH23456789") for _ in range(n)) + "7"
    forms = [
        lambda: f"export API_KEY={code(24)}\n",
        lambda: f"db:\n  password: {code(14)}\n",
        lambda: f"push with ghp_{code(36)} then",
        lambda: f"id AKIA{code(16).upper()} of",
        lambda: f"Authorization: Bearer {code(30)}",
        lambda: f'your test token = "{code(30)}" for',
        lambda: f'some words token = "{code(30)}" and',
    ]
    real = [f() for f in forms for _ in range(40)]
    clean = [f"invoice card 4{draw.randrange(10**14, 10**15)} of the order" for _ in range(120)] + [f"commit {code(40)} sha checksum" for _ in range(60)]
    rows = secrets.scan(frame(real + clean)).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id // 40 for r in held if r.doc_id < len(real)} == set(range(len(forms)))
    assert [r.doc_id for r in held if r.is_secret != (r.doc_id < len(real))] == []
    # one bare token among quoted ones only
    few = [f'some words token = "{code(30)}" and' for _ in range(60)] + clean + [f"push with ghp_{code(36)} then"]
    assert [r.is_secret for r in secrets.scan(frame(few)).collect() if r.doc_id == len(few) - 1] == [True]


def test_secrets_behind_joined_names(frame):
    values = {
        'dbPassword: "correct!horse"': "correct!horse",
        'accessToken="s3cr.etX!"': "s3cr.etX!",
        'clientSecret = "abcDEF12"': "abcDEF12",
        "export MY_API_KEY=abcdef1234567890": "abcdef1234567890",
        "dbPassword=abcdef1234567890": "abcdef1234567890",
        "x.y-auth : 'p@ss.w0rd'": "p@ss.w0rd",
        "éètoken=q!w@e#r$": "q!w@e#r$",
        "passwd : qwerty$1": "qwerty$1",
    }
    # what the pattern by look-behind at every place found, with names taken off long runs, is still found
    names = "|".join(secrets.NAMES)
    ahead = rf"""(?i:{names})["']?\s{{0,2}}[:=]\s{{0,2}}["']?"""
    value = re.compile(r"""[^\s"',;]{6,}""")
    run = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")
    draw = random.Random(6)
    parts = ["key", "my", "Token", "_", ".", "-", "=", ": ", ' = "', '"', " ", "'", "/", "secret: ", "abc1", "q!w@e#", "12345678", "é", "\n", ",", "pwd=", "auth"]
    noise = ["".join(draw.choice(parts) for _ in range(40)) for _ in range(400)]

    def plain(text):
        at = 0
        while at < len(text):
            m = value.match(text, at) if re.search(rf"{ahead}\Z", text[max(0, at - 24) : at]) else None
            if m := m or run.match(text, at):
                yield m.span()
            at = m.end() if m else at + 1

    texts = [*values, *noise]
    got = collections.defaultdict(list)
    for r in secrets.candidates(frame(texts)).collect():
        assert texts[r.doc_id][r.start : r.start + len(r.found)] == r.found
        got[r.doc_id].append((r.start, r.start + len(r.found)))
    for i, v in enumerate(values.values()):
        assert [texts[i][a:b] for a, b in got[i]] == [v]
    for i, text in enumerate(texts):
        held = {x for a, b in got[i] for x in range(a, b)}
        for a, b in plain(text):
            name = re.match(rf"[A-Za-z0-9_-]*(?i:{names})=", text[a:b])
            assert set(range(a + (name.end() if name else 0), b)) <= held, (text, text[a:b])


def test_secrets_run_no_python_and_bear_nothing(frame, empty):
    assert secrets.scan(empty).count() == 0
    assert secrets.scan(frame([None, "plain"])).count() == 0
    plan = secrets.scan(frame(['token = "0123456789abcdef0123"', "order 12345678901234567890"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_reviewed_findings_are_learned(spark, frame):
    texts = [f"run abcdefgh12345678{i:04d}" for i in range(40)]
    marks = spark.createDataFrame([(i, 0, float(i % 2)) for i in range(40)] + [(1, 0, None)], "doc_id long, ordinal int, label double")
    assert secrets.scan(frame(texts), marks).count() == 40


# 6


def test_leaks_are_found_and_clean_texts_left(spark, frame, prose):
    items = [t for t in prose[:60] if t and len(t.split()) >= 15][:20]
    bench = spark.createDataFrame([*enumerate(items), (97, None), (98, ""), (99, items[0])], "item_id long, text string")
    draw = random.Random(2)
    clean = [" ".join(draw.sample((prose[draw.randrange(20, 60)] or "x y").split() * 3, 12)) + " clear" for _ in range(80)]
    leaky = [f"before it {t.title()} after. {t[:10]}" for t in items]
    fudged = []
    for t in items:
        w = t.split()
        w[len(w) // 3] = "changed"
        fudged.append("so " + " ".join(w))
    texts = [*clean, *leaky, *fudged, None, ""]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(texts), bench).collect()}
    want = {(len(clean) + j * len(items) + i, i) for j in (0, 1) for i in range(len(items))}
    assert want <= got
    assert not {d for d, _ in got if d < len(clean)}
    assert {d for d, i in got if i == 99} == {d for d, i in got if i == 0}


def test_leaks_of_nothing(spark, frame, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(frame(["a"]), none).count() == 0
    assert decontaminate.find_leaks(empty, some).count() == 0


def test_leaks_of_items_in_many_documents(spark, frame):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(20), text(20), text(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = " ".join("changed" if k == 6 else w for k, w in enumerate(items[0].split()))
    many = [f"{text(30)} {items[0]} {text(30)}" for _ in range(19)] + [f"{text(30)} {edited} {text(30)}"] + [text(60) for _ in range(40)]
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(many), bench).collect()} == {(i, 0) for i in range(20)}
    few = [f"{text(30)} {items[1]} {text(30)}", *(text(60) for _ in range(4))]
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(few), bench).collect()} == {(0, 1)}
    # an item that stands in every document, short and among rare words of another item
    bench = spark.createDataFrame([(0, "of the in to"), (1, items[1])], "item_id long, text string")
    every = [f"{items[1]} of the in to {items[1]}"] + [f"{text(20)} of the in to" for _ in range(30)] + ["to in the of"]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(every), bench).collect()}
    assert got == {(0, 1), *((i, 0) for i in range(31))}


def test_leaks_that_end_a_document(spark, frame):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (24, 30, 36, 48, 60, 90) for _ in range(2)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, want = [], set()
    for i, t in enumerate(items):
        w = t.split()
        for before in range(40, 52):
            # the first words are changed, so that little can be missed at the end
            for changed in (0, len(w) // 6):
                want.add((len(texts), i))
                texts.append(" ".join([*(word() for _ in range(before)), *(word() for _ in range(changed)), *w[changed:]]))
    texts += [" ".join(word() for _ in range(80)) for _ in range(100)]
    got = {(r.doc_id, r.item_id): r.lcs for r in decontaminate.find_leaks(frame(texts), bench).collect()}
    assert set(got) == want
    assert all(got[d, i] > 0.999 for d, i in want if d % 2 == 0)


def test_leak_search_needs_little_memory_and_any_run_of_windows(monkeypatch):
    draw = random.Random(9)
    some = [f"w{i}" for i in range(400)]
    items = [" ".join(draw.choices(some, k=40)) for _ in range(20)]
    block = decontaminate.Block.of(list(enumerate(items)))
    space = np.linalg.qr(np.random.default_rng(9).normal(size=(len(block.vocabulary), 96)))[0]
    search = decontaminate._search(block, np.ones(len(block.vocabulary)), space, 0.3)
    texts = [" ".join([*draw.choices(some, k=2000), items[i % 20], *draw.choices(some, k=2000)]) for i in range(300)]

    def found(n):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts[:n], pa.string())})
        return [tuple(r.values()) for x in search(iter([batch])) for r in x.to_pylist()]

    tracemalloc.start()
    try:
        rows = found(300)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {(i, i % 20) for i in range(300)} <= {(d, i) for d, i, *_ in rows}
    assert most < 60e6
    want = [r for r in rows if r[0] < 20]
    monkeypatch.setattr(decontaminate, "WINDOWS", 3)
    near = lambda x: sorted((d, i, *(round(v, 5) for v in more)) for d, i, *more in x)
    assert near(found(20)) == near(want)


def test_weight_of_common_subsequence():
    weight = np.array([1.0, 2, 3, 4])
    assert decontaminate.lcs_weight(np.array([0, 1, 2, 3]), weight, np.array([1, 9, 0, 2, 3])) == 9
    assert decontaminate.lcs_weight(np.array([0, 1]), weight, np.array([], int)) == 0


# 7


def classes(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("column", "bits"), [(256, 20), (3, 20), (2, 4)])
def test_shingle_classes(frame, prose, column, bits):
    draw = random.Random(4)
    base = (prose[-9] or "").split()[:120]
    family = []
    for _ in range(15):  # a large group of near copies, not all of which link with each other
        w = list(base)
        for _ in range(draw.randint(1, 4)):
            w[draw.randrange(len(w))] = f"e{draw.randrange(99)}"
        family.append(" ".join(w))
    texts = [*prose, *family]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.link_classes(frame(texts), column=column, bits=bits).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


@pytest.mark.parametrize("raw", [b"", b"one", b"One two", b"one two three", b"one two three four", b"one two three four five"])
def test_shingles_of_one_short_document(raw):
    (alone,) = shingles.shingle_sets([raw], shingles._WordHashes())
    beside, _ = shingles.shingle_sets([raw, b"a b c d e f g h"], shingles._WordHashes())
    assert len(alone) == (1 if raw else 0) and (alone == beside).all()


def test_shingles_of_nothing_and_repeated_rows(spark, frame, empty):
    assert shingles.link_classes(empty).count() == 0
    twice = frame(["a b c d e f", None]).unionAll(frame(["a b c d e f"])).unionAll(frame(["A b c d e f"], 7))
    assert sorted((r.doc_id, r.component_id) for r in shingles.link_classes(twice).collect()) == [(0, 0), (0, 0), (1, 1), (7, 0)]


# 8


def plain_spans(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_base_spans_match_plain_patterns():
    anchors, draw = pii.automaton(), random.Random(1)
    for _ in range(20000):
        alphabet = draw.choice(["ab.@-1 ", "0123456789 -", "12.+ (", "a1@.", "0127.. +-@ab"])
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
        assert pii.joined([s for s in pii.find_spans(text, anchors) if s.kind in pii.BASE_KINDS]) == plain_spans(text)


def test_personal_data_of_rows(frame):
    texts = ["é mail to a.b@c.example.com or +1 (555) 123-4567", "1.2.3.4 999.1.1.1 4111 1111 1111 1111", None, "", "IBAN: DE89 3704 0044 0532 0130 00 http://u:p@h.org", "x" * 200_000 + " a@b.cd"]
    rows = {r.doc_id: r for r in pii.digest(pii.detect(frame(texts))).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(rows[i].spans.split(","))
    assert "iban:" in rows[4].spans and "login:" in rows[4].spans
    kept = {r.doc_id: r for r in pii.redact(frame(texts)).collect()}
    assert kept[0].text == "é mail to <EMAIL> or <PHONE>" and kept[2].text is None and kept[3].text == "" and kept[0].h == 1
    assert pii.redact(frame(["clean text 12"])).first().text == "clean text 12"


# 9


def test_language_on_held_out(spark):
    draw = random.Random(6)
    parts = {"aa": ["th", "er", "ing", "on"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["eau", "é", "ou", "tion"]}
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(draw.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang if i % 10 else None, 1.0))
    rows += [(240, None, "aa", 1.0), (241, "12 !!", "bb", 1.0), (242, "", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].lang_pred == "abc"[i % 3] * 2 for i in range(240))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (240, 241, 242))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(["abc abd", "ab ba cab", "bad dab"])], "doc_id long, text string, lang string")
    models = language.train(docs.select("lang", "text"), order=3)
    # all continuations of a word's start, its end included, and a share for what was never seen
    costs, _ = models.costs(["a", "b", "c", "d"])
    assert np.isfinite(costs).all() and (costs > 0).all()


def test_language_of_nothing(spark, empty, frame):
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(frame(["abc"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 10


def test_packing_places_each_id_once(frame, prose):
    texts = [*prose, prose[0], "<|endoftext|> é́ can't　x", "a" * 30000]
    cut = packing.pieces(frame(texts), path("word_bpe_49k.json"))
    rows = packing.pack(cut, group_tokens=20_000).collect()
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    of = collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    room = collections.defaultdict(list)
    for r in rows:
        room[r.sequence_id].append((r.offset, r.length))
    for x in room.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 4096


def test_first_fit_decreasing_is_first_fit():
    draw = np.random.default_rng(2)
    for _ in range(50):
        lengths = np.sort(draw.integers(1, 60, draw.integers(0, 80)))[::-1]
        bins, offsets = packing.first_fit_decreasing(lengths, 60)
        free: list[int] = []
        for i, n in enumerate(lengths.tolist()):
            b = next((j for j, f in enumerate(free) if f >= n), len(free))
            if b == len(free):
                free.append(60)
            assert (bins[i], offsets[i]) == (b, 60 - free[b])
            free[b] -= n


def test_packing_of_nothing(empty):
    assert packing.pack(packing.pieces(empty, path("word_bpe_49k.json"))).count() == 0


def test_large_sets_are_told_apart_by_their_wide_maps(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 3000).astype(np.uint64)
    near, half, other = (np.sort(np.concatenate([base[k:], draw.integers(0, 2**63, k + extra).astype(np.uint64)])) for k, extra in ((100, 0), (1500, 0), (3000, 3000)))
    sets = [np.sort(base), near, half, other, base[:100]]
    assert shingles.wide_map(sets[-1]) is None
    for x, y in itertools.combinations(sets[:-1], 2):
        assert shingles.differences(shingles.wide_map(x), shingles.wide_map(y)) <= len(np.setxor1d(x, y))
    rows = [(i, len(s), shingles.parity_maps([s])[0].tolist(), shingles.wide_map(s)) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n_shingles long, parity array<long>, wide binary")
    pairs = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 1), (1, 2, 1)], "a long, b long, c long")
    # maps of one size let the pairs of half the hashes pass; a pair with a small set is left to the sizes
    assert sorted((r.a, r.b) for r in shingles._bounded(pairs, nodes, 75).collect()) == [(0, 1), (0, 4)]


def test_large_documents_link_by_whole_overlaps(frame):
    draw = random.Random(11)
    base = [f"w{draw.randrange(9999)}" for _ in range(1300)]
    texts = []
    for edits in (0, 0, 20, 30, 45, 60, 120):  # about three quarters are shared at 45 edits
        w = list(base)
        for _ in range(edits):
            w[draw.randrange(len(w))] = f"e{draw.randrange(9999)}"
        texts.append(" ".join(w))
    texts.append(" ".join(base + base[::-1]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.link_classes(frame(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)
