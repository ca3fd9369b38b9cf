"""The training-data operators against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import bisect
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from varve.llm import exact_dedup, language, licenses, mixing, near_dedup, packing, quality, sketching, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, row string, size int, key string, bucket int, score double, label int, id string, n long, component_id long"


def docs(spark, rows):
    """A table of ``(doc_id, text, lang, source)`` with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "k", 2, 0.5, 3, "i", 4, 5) for r in rows], SCHEMA)


def corpus(seed=0, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.05:
            text = None
        elif kind < 0.1:
            text = rnd.choice(["", " ", "\n\t "])
        elif kind < 0.25 and rows:
            text = rnd.choice(rows)[1]
        elif kind < 0.4 and rows:
            text = (rnd.choice(rows)[1] or "a b c d e f") + rnd.choice(["", " tail", "  \n", " x y"])
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 30, 80, 400])))
        rows.append((i * 3 % 1000, text, rnd.choice(["en", "fr", None]), rnd.choice(["b", "a", "a", "a", None, "ä"])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


# --- exact dedup ---


def test_exact_digest(spark, rows):
    table = docs(spark, rows + [rows[3], (None, "only null", None, None), (None, rows[5][1], None, None)])
    got = sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in exact_dedup.digest(table).collect())
    want = brute.exact([(r[0], r[1]) for r in rows + [rows[3], (None, "only null"), (None, rows[5][1])]])
    assert got == sorted((repr(d), repr(k), n, h) for d, k, n, h in want)


def test_exact_filter_keeps_one_of_each(spark, rows):
    table = docs(spark, rows + [rows[3], rows[3]])
    kept = exact_dedup.exact_dedup(table)
    assert kept.columns == table.columns
    want = {k for _, k, _, _ in brute.exact([(r[0], r[1]) for r in rows])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 9)), max_size=60), st.sampled_from([150, 400, 10**6]))
def test_trie_owners_with_spills(items, budget):
    trie, want = exact_dedup.PatriciaTrie(budget), {}
    for key, i in items:
        trie.insert(key, i)
        least, n, own = want.get(key, (i, 0, 0))
        own = own + 1 if i == least else (1 if i < least else own)
        want[key] = (min(i, least), n + 1, own)
    assert {k: (a, n, o) for k, a, n, o in trie.owners()} == want


@pytest.mark.parametrize("budget", [1_000, 20_000, 200_000])
def test_trie_spills_below_a_long_shared_beginning(budget):
    rnd = random.Random(1)
    head = bytes(rnd.randrange(256) for _ in range(3_000))
    keys = [head + str(rnd.randrange(200)).encode() * rnd.choice([1, 3, 40]) for _ in range(600)] + [head, head[:1_500], b""]
    trie, want = exact_dedup.PatriciaTrie(budget), Counter(keys)
    for i, key in enumerate(keys):
        trie.insert(key, i)
    assert {k: (a, n) for k, a, n, _ in trie.owners()} == {k: (keys.index(k), n) for k, n in want.items()}


def test_exact_of_very_long_texts(spark):
    head = "licence " * 4_000
    rows = [(i, head + f"{i % 40} " + "tail " * 20_000, None, None) for i in range(120)]
    exact_dedup.TRIE_BYTES, kept = 1 << 20, exact_dedup.TRIE_BYTES
    try:
        got = sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in exact_dedup.digest(docs(spark, rows).repartition(1)).collect())
    finally:
        exact_dedup.TRIE_BYTES = kept
    assert got == sorted((repr(d), repr(k), n, h) for d, k, n, h in brute.exact([(r[0], r[1]) for r in rows]))


# --- mixing ---


def test_mixing(spark, rows):
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.digest(docs(spark, rows)).collect()}
    want = brute.mix([(r[0], r[1], r[3]) for r in rows])
    assert got.keys() == want.keys()
    for d, (size, total, target, taken) in want.items():
        assert got[d][:2] == (size, total) and math.isclose(got[d][2], target) and got[d][3] == taken


def test_mixing_of_repeated_ids_and_long_texts(spark, rows):
    """Rows that repeat an id, as a whole or with other texts, are documents of their own; reruns agree."""
    extra = rows + rows[:10] + [(rows[3][0], "another text of this id", None, "a"), (None, "no id", None, "b"), (None, "no id", None, "b"), (7_000, "long " * 200_000, None, "a")]
    table = docs(spark, extra)
    got = sorted(map(repr, mixing.digest(table).collect()))
    assert got == sorted(map(repr, mixing.digest(table.repartition(3)).collect())) and len(got) == len(extra)
    found = mixing.digest(table).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in found)
    want = brute.mix([(i, t, s) for i, (_, t, _, s) in enumerate(extra)])
    totals = {}
    for (_, total, target, taken) in want.values():
        totals[total, round(target, 6)] = totals.get((total, round(target, 6)), 0) + taken
    sums = {}
    for r in found:
        sums[r.source_size, round(r.target, 6)] = sums.get((r.source_size, round(r.target, 6)), 0) + r.taken
    assert sums == totals


def test_mix_places_are_gapless(spark, rows):
    slim = mixing.keyed(docs(spark, rows).selectExpr("doc_id", "source", "size(filter(split(coalesce(text, ''), '[ \\t-\\r]+'), x -> x <> '')) as size").selectExpr("doc_id", "source", "cast(size as long) size"))
    places = sorted((r.mix_start, r.piece) for r in mixing.mixed(mixing.schedule(slim, slim)).collect())
    at = 0
    for start, piece in places:
        assert start == at
        at += piece


def test_mix_rows(spark, rows):
    table = docs(spark, rows)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    want = brute.mix([(r[0], r[1], r[3]) for r in rows])
    assert all(abs(times.get(d, 0) * size - taken) <= size / 2 for d, (size, _, _, taken) in want.items())


# --- packing ---


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    return lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


def test_packing_is_exact_and_gapless(spark, rows, tokens):
    long = (5000, "word " * 9000 + "ünï <|endoftext|> 漢字 İ don't", None, None)
    extra = rows + [long, rows[7]]
    got = packing.pack(docs(spark, extra)).collect()
    seen = {}
    for r in got:
        seen.setdefault((r.doc_id), []).append(r)
    for d, text, *_ in extra:
        ids = tokens(text)
        parts = {r.piece: r for r in seen[d]}
        assert len(parts) == -(-len(ids) // 4096)
        for k, r in parts.items():
            part = ids[k * 4096 : (k + 1) * 4096]
            assert (r.start, r.length, r.ids_crc32) == (k * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) == packing.least_sequences(_counts(r.length for r in got), 4096)


def _counts(lengths):
    out = {}
    for n in lengths:
        out[n] = out.get(n, 0) + 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_bin_completion_uses_every_piece_once(lengths):
    counts = _counts(lengths)
    used, sequences = {}, 0
    for uses, times in packing.complete(counts, 50):
        assert sum(k * n for k, n in uses) <= 50
        sequences += times
        for k, n in uses:
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    bins = []
    for n in sorted(lengths, reverse=True):  # first fit decreasing
        at = next((i for i, b in enumerate(bins) if b + n <= 50), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert packing.least_sequences(counts, 50) <= sequences <= len(bins)


def _best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=120))
def test_packing_is_never_worse_than_best_fit(lengths):
    counts = _counts(lengths)
    grouped = packing.best_fit(counts, 60)
    assert sum(t for _, t in grouped) == _best_fit(lengths, 60)
    assert {k: sum(t * dict(uses).get(k, 0) for uses, t in grouped) for k in counts} == counts
    assert sum(t for _, t in packing.complete(counts, 60)) <= _best_fit(lengths, 60)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=4), st.lists(st.integers(1, 9), min_size=1, max_size=4))
def test_domination_is_a_partition(a, b):
    a, b = sorted(a, reverse=True), sorted(b, reverse=True)
    fits = any(all(sum(x for x, i in zip(b, places, strict=True) if i == j) <= room for j, room in enumerate(a)) for places in itertools.product(range(len(a)), repeat=len(b)))
    assert fits or not packing.dominates(a, b)


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("mean", [1, 5, 10, 12, 400])
def test_hundred_thousand_pieces(mean, seed):
    lengths = np.clip(np.random.default_rng(seed).normal(mean, mean / 3, 100_000), 1, 4096).astype(int).tolist()
    counts = _counts(lengths)
    used = sum(t for _, t in packing.complete(counts, 4096))
    least = packing.least_sequences(counts, 4096)
    assert least <= used <= min(_best_fit(lengths, 4096), least + least // 1_000 + 1)


@pytest.mark.parametrize("counts", [{5: 100_000}, {10: 100_000}, {1: 100_000}, {1: 30_000, 2: 30_000, 3: 9_000}, {1: 50_000, 4000: 20, 700: 45}, {7: 9_000, 5: 2_000}])
def test_many_short_pieces_fill_sequences(counts):
    patterns = packing.complete(counts, 4096)
    assert sum(t for _, t in patterns) == packing.least_sequences(counts, 4096)
    assert all(sum(k * n for k, n in uses) <= 4096 for uses, _ in patterns)
    assert {k: sum(t * dict(uses).get(k, 0) for uses, t in patterns) for k in counts} == counts


# --- near dedup ---


def test_near_digest(spark, rows):
    for width, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.digest(docs(spark, rows), width=width, percent=percent).collect()}
        assert got == brute.near([(r[0], r[1]) for r in rows], width, percent)


@pytest.fixture
def small_blocks():
    """Blocks, buckets and hubs so small that few rows go every way of the search."""
    sizes = {"BLOCK_ROWS": 40, "SMALL": 8, "MANY": 60, "HUBS": 3}
    kept = {k: getattr(near_dedup, k) for k in sizes}
    for k, v in sizes.items():
        setattr(near_dedup, k, v)
    yield
    for k, v in kept.items():
        setattr(near_dedup, k, v)


def edited(rnd, n, length, edits):
    """Copies of one text with so many words exchanged, most of which are close to the base only."""
    base = [f"w{rnd.randrange(5000)}" for _ in range(length)]
    for _ in range(n):
        copy = base[:]
        for _ in range(rnd.choice(edits)):
            copy[rnd.randrange(length)] = f"e{rnd.randrange(5000)}"
        yield " ".join(copy)


def test_near_group_larger_than_a_small_bucket(spark, small_blocks):
    rnd = random.Random(5)
    rows = [(i, t, None, None) for i, t in enumerate([*edited(rnd, 150, 120, [0, 1, 2, 3, 5]), *edited(rnd, 120, 150, [4, 6, 8])])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.digest(docs(spark, rows), width=3, percent=85).collect()}
    assert got == brute.near([(r[0], r[1]) for r in rows], 3, 85)


def test_blocks_copy_outsiders_only(spark, small_blocks):
    """A bucket with a large component: its members go to the blocks of outsiders and no further."""
    rows = [("b", i, 5, 0 if i < 400 else i) for i in range(430)]
    many = spark.createDataFrame(rows, "bucket string, id long, n long, component long")
    sets = spark.range(430).selectExpr("id", "array(id) shingles")
    assert near_dedup.in_blocks(many, sets).where("id < 400").count() == 400


def test_near_rows_that_repeat_an_id(spark):
    words = [[f"{k}{i}" for i in range(100)] for k in "ab"]
    a, b = (" ".join(w) for w in words)
    rows = [(3, a + " more"), (5, a), (5, b), (5, b), (9, b + " more"), (11, b + " more"), (11, None), (12, "c d e f g h"), (12, "c d e f g h")]
    got = near_dedup.digest(docs(spark, [(*r, None, None) for r in rows])).collect()
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert found == sorted((d, max(0, len((t or "").split()) - 4), (3 if t else d) if d < 12 else 12, d in (3, 12) or not t) for d, t in rows)
    left = near_dedup.near_dedup(docs(spark, [(*r, None, None) for r in rows])).collect()
    assert sorted(r.doc_id for r in left) == [3, 12, 12]


def test_near_recall_against_brute_force(spark):
    """Groups of copies around the threshold: every link of brute force is found."""
    rnd = random.Random(8)
    texts = [t for _ in range(60) for t in edited(rnd, 12, rnd.choice([20, 60, 200]), [0, 1, 2, 4, 8])]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.digest(docs(spark, rows)).collect()}
    assert got == brute.near([(r[0], r[1]) for r in rows], 5, 80)


def test_near_of_very_long_texts(spark):
    rnd = random.Random(9)
    long = [f"w{rnd.randrange(50_000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long), None, None), (2, " ".join(long[:-4000]), None, None), (3, " ".join(long[:200_000]), None, None)]
    got = {r.doc_id: r.component_id for r in near_dedup.digest(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_filter(spark, rows):
    table = docs(spark, rows + [(None, rows[9][1], None, None)])
    kept = near_dedup.near_dedup(table)
    assert kept.columns == table.columns
    want = {d for d, (_, c) in brute.near([(r[0], r[1]) for r in rows], 5, 80).items() if d == c}
    assert {r.doc_id for r in kept.collect()} == want | {None}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.sampled_from([4, 16, 64]))
def test_sketch_fills_every_bin(values, t):
    s = sketching.sketch([np.array(sorted(values), np.uint64)] * 2, t)
    assert (s != sketching.EMPTY).all() and (s[0] == s[1]).all()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    s = sketching.sketch([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))], 2048)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05


def test_bands_miss_next_to_nothing():
    for percent in (80, 85, 90, 100):
        rows, bands = near_dedup.banding(percent)
        assert rows * bands <= near_dedup.BINS and (1 - (percent / 100) ** rows) ** bands <= 1e-8


# --- exact top-k ---


def test_top_k_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(300)]
    rows += [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (2400, [0.0] * 6), (None, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, page string")
    topk.PAGE, topk.PER_NODE, kept = 64, 100, (topk.PAGE, topk.PER_NODE)
    try:
        got = sorted(tuple(r) for r in topk.top_k(table, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect())
    finally:
        topk.PAGE, topk.PER_NODE = kept
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    assert got == brute.top_k(whole, lambda i: i % 100 == 0)


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(3)
    one = {i: rng.integers(-5, 6, 4).tolist() for i in range(40)}
    best = max(range(1, 40), key=lambda i: np.dot(one[i], one[0]))
    rows = [(i, v) for i, v in one.items()] + [(best, one[best])] * 14 + [(7, one[7])] * 4 + [(20, one[20]), (20, one[21])]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(table, "vec_id", "embedding", F.col("vec_id") % 20 == 0, scale=1).collect()))
    want = []
    for q in (0, 20):
        pairs = sorted((-int(np.dot(v, a)), i) for p, a in rows if p == q for i, v in rows if i != q)
        want += [(q, n + 1, i, -score) for n, (score, i) in enumerate(pairs[:10])]
    assert got == want


def test_top_k_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(table, "vec_id", "embedding", F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 2, 1024 * 1024), (0, 2, 1, 512 * 1024)]


# --- learned scores ---


def test_factorization_machine_against_all_pairs():
    """The sum over pairs, one by one."""
    rng = np.random.default_rng(4)
    model = toxicity.Machine(50, 0.3)
    model.value, model.weights, model.vectors = rng.random(50).astype(np.float32), rng.standard_normal(50).astype(np.float32), rng.standard_normal((50, toxicity.RANK)).astype(np.float32)
    texts = [np.sort(rng.choice(50, n, replace=False)) for n in (1, 2, 9, 30, 50)]
    for terms, got in zip(texts, model.scores(texts), strict=True):
        x = [float(model.value[t]) for t in terms]
        pairs = sum(x[i] * x[j] * float(model.vectors[terms[i]] @ model.vectors[terms[j]]) for i in range(len(x)) for j in range(i))
        logit = 0.3 + sum(v * float(model.weights[t]) for v, t in zip(x, terms, strict=True)) + pairs / (1 + sum(x))
        assert math.isclose(got, 1 / (1 + math.exp(-logit)), abs_tol=1e-5)


def test_attention_against_plain_sums():
    """Each passage on its own: gated weight, softmax over the document, weighted representation."""
    rng = np.random.default_rng(5)
    model = quality.Attention(0.4)
    model.mean, model.scale = rng.standard_normal(quality.FEATURES).astype(np.float32), rng.random(quality.FEATURES).astype(np.float32) + 0.5
    bags = [rng.standard_normal((n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 40)]
    for bag, got in zip(bags, model.scores(bags), strict=True):
        h = [np.tanh(((x - model.mean) / model.scale).astype(float) @ model.encode) for x in bag]
        e = [float((np.tanh(v @ model.tanh) / (1 + np.exp(-(v @ model.gate)))) @ model.weigh) for v in h]
        a = [math.exp(v) / sum(map(math.exp, e)) for v in e]
        z = sum(w * v for w, v in zip(a, h, strict=True))
        assert math.isclose(got, 1 / (1 + math.exp(-(float(z @ model.score) + model.bias))), abs_tol=1e-4)


def test_pairs_of_terms_count_for_more_than_both_alone(spark):
    """Labels that no sum of weights can tell: toxic where exactly the pair stands."""
    rnd, rows, marks = random.Random(6), [], []
    for i in range(900):
        text = [rnd.choice(["plain", "words", "stand", "here", "and", "there"]) for _ in range(12)]
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        text += ["insult"] * a + ["group"] * b
        rnd.shuffle(text)
        rows.append((i, " ".join(text), "en", "s"))
        marks.append((i, 1, int(a and b)))
    found = {r.doc_id: r for r in toxicity.digest(docs(spark, rows), labels(spark, marks)).collect()}
    own = [(found[i].predicted, t) for i, _, t in marks if found[i].held_out]
    assert np.mean([p == t for p, t in own]) > 0.97


@pytest.mark.parametrize("digest", [toxicity.digest, quality.digest])
def test_scores_of_very_long_texts(spark, digest):
    rows, marks = learnable(200)
    long = [(7001, rows[0][1] + " filler word" * 300_000, None, None), (7002, "x" * 2_000_000, None, None)]
    found = {r.doc_id: r.score for r in digest(docs(spark, rows + long), labels(spark, marks)).collect()}
    assert len(found) == 202 and all(0 <= s <= 1 for s in found.values())



def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def learnable(n=600):
    """Texts that a word pair and a junk pattern tell apart."""
    rnd = random.Random(2)
    words = [f"{a}{b}" for a in ("lo", "ma", "ri", "te", "su") for b in ("na", "ko", "li", "pe", "du", "ra")]
    rows, marks = [], []
    for i in range(n):
        toxic, bad = rnd.random() < 0.3, rnd.random() < 0.3
        text = [rnd.choice(words) for _ in range(rnd.choice([20, 60, 200]))]
        if toxic:
            for _ in range(3):
                text[rnd.randrange(len(text))] = rnd.choice(["vileword", "nastyterm"])
        if bad:
            text = [w + "###" if rnd.random() < 0.5 else w for w in text]
        rows.append((i, " ".join(text), rnd.choice(["en", "xx"]), "s"))
        marks.append((i, 0 if bad else 1, int(toxic)))
    return rows, marks


def held_out(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


def test_learned_scores_hold_out(spark):
    rows, marks = learnable()
    table, mark = docs(spark, rows + [(9000, None, None, None), (9001, "", None, None), rows[0]]), labels(spark, marks + [(None, 1, 1), (7, None, None), (8000, 0, 1)])
    for made, field, cut in ((toxicity.digest(table, mark), 2, 0.7), (quality.digest(table, mark), 1, 0.5)):
        found = made.collect()
        assert len(found) == len(rows) + 3
        truth = {m[0]: m[field] for m in marks}
        assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in found)
        own = [r for r in found if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.95


def test_scores_without_labels(spark):
    rows, _ = learnable(20)
    none = labels(spark, [])
    assert {r.predicted for r in toxicity.digest(docs(spark, rows), none).collect()} == {0}
    assert {r.predicted for r in quality.digest(docs(spark, rows), none).collect()} == {1}
    kept = quality.keep_good(docs(spark, rows), none)
    assert kept.count() == len(rows) and kept.columns == docs(spark, rows).columns


def test_language(spark):
    rnd = random.Random(4)
    sound = {"aa": ["lok", "mor", "tas", "vek"], "bb": ["ñue", "ció", "lla", "erro"], "cc": ["sch", "ung", "keit", "lich"]}
    word = lambda lang: "".join(rnd.choice(sound[lang]) for _ in range(rnd.choice([1, 2, 3])))
    rows = [(i, " ".join(word(lang) for _ in range(rnd.choice([5, 40, 300]))), lang, "s") for i in range(240) for lang in [rnd.choice(list(sound))]]
    switched = " ".join(word("aa") for _ in range(50)) + " " + " ".join(word("cc") for _ in range(150))
    odd = [(5000, None, "aa", None), (5001, "123 !!", "bb", None), (5002, "", None, None), (5003, switched, None, None)]
    found = {r.doc_id: r for r in language.digest(docs(spark, rows + odd)).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert all(r.held_out == held_out(i, 4, 2) and 0 <= r.score <= 1 for i, r in found.items())
    assert np.mean([found[i].lang_pred == truth[i] for i in truth if found[i].held_out]) > 0.97
    assert [(found[i].lang_pred, found[i].score) for i in (5000, 5001, 5002)] == [("und", 0.0)] * 3
    assert found[5003].lang_pred == "cc" and found[5003].switches >= 1 and abs(found[5003].score - 0.75) < 0.05


def test_features_of_whole_words():
    """Letters far from a word's ends count, and scripts without spaces are cut into positions."""
    assert set(language.features("a" * 100 + "x" + "b" * 100)) != set(language.features("a" * 100 + "y" + "b" * 100))
    assert language.words_of("Eins zwei") == ["eins", "zwei"] and language.words_of(None) == []
    run = "".join(chr(0x4E00 + i) for i in range(200))
    cut = language.words_of(f"abc {run} déf")
    assert "".join(cut[1:-1]) == run and all(len(p) <= language.RUN for p in cut[1:-1]) and (cut[0], cut[-1]) == ("abc", "déf")


def test_language_of_unspaced_and_long_texts(spark):
    rnd = random.Random(7)
    letters = {"zh": [chr(0x4E00 + i) for i in range(60)], "yy": [chr(0x4E00 + i) for i in range(50, 110)], "aa": list("abcdefgh ")}
    text = lambda lang, n: "".join(rnd.choice(letters[lang]) for _ in range(n))
    rows = [(i, text(lang, rnd.choice([30, 200])), lang, "s") for i in range(200) for lang in [rnd.choice(list(letters))]]
    rows += [rows[3], (6000, text("yy", 400_000), None, None), (6001, text("aa", 400_000), None, None)]
    found = language.digest(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows} | {6000: "yy", 6001: "aa"}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found if r.held_out or r.doc_id >= 6000]) > 0.97


def test_forward_backward_in_segments():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 31, 32, 33, 64, 200])
    emissions, move = rng.standard_normal((lengths.sum(), 4)), rng.standard_normal((4, 4))
    got, begin = language.chances(emissions, lengths, move), 0
    for n in lengths:
        e, m = np.exp(emissions[begin : begin + n]), np.exp(move)
        a, b = e.copy(), np.ones_like(e)
        for t in range(1, n):
            a[t] = (a[t - 1] / a[t - 1].sum()) @ m * e[t]
        for t in range(n - 2, -1, -1):
            b[t] = m @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        w = a * b
        assert np.allclose(w / w.sum(axis=1, keepdims=True), got[begin : begin + n])
        begin += n


# --- licences ---


def test_licenses_inherit_from_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."),
        (3, "a/b/c/x.txt", "just text"),
        (4, "a/d/x.txt", None),
        (5, "a/d/y.txt", "code\nLicensed under the Apache License, Version 2.0.\ncode"),
        (6, "z/x.txt", "he lost his driving license and no permission"),
        (7, None, ""),
        (8, "a/b/c/LICENSE", "no licence words that match"),
        (8, "a/b/c/LICENSE", "no licence words that match"),
        (None, "a/d/z.txt", None),
        (10, "q/long.txt", "plain words of a text " * 100_000 + "Licensed under the Apache License, Version 2.0." + " and on it goes" * 100_000),
    ]
    table = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "id long, path string, text string, license string, score double")
    got = {(r.id): (r.license, r.origin, r.from_dir) for r in licenses.scan(table).collect()}
    assert got == {1: ("MIT", "own", "a"), 2: ("CC-BY-NC-4.0", "own", "a/b"), 3: ("CC-BY-NC-4.0", "inherited", "a/b"), 4: ("MIT", "inherited", "a"), None: ("MIT", "inherited", "a"), 10: ("Apache-2.0", "own", "q"), 5: ("Apache-2.0", "own", "a/d"), 6: ("", "none", ""), 7: ("", "none", ""), 8: ("CC-BY-NC-4.0", "inherited", "a/b")}


NOTICE = "Licensed under the Apache License, Version 2.0"
SHARES = {"licensed": 0.02, "under": 0.2, "the": 0.9, "license": 0.02, "version": 0.05, "apache": 0.01, "copyright": 0.02}


@pytest.mark.parametrize("files", [1_000, 50_000, 5_000_000])
def test_licence_scores_do_not_depend_on_the_number_of_files(files):
    made = [licenses.Templates(n, {t: int(share * n) for t, share in SHARES.items()}) for n in (1_000, files)]
    (a, name), (b, other) = (t.scan("Copyright 2020 Acme " + NOTICE, False) for t in made)
    assert name == other == "Apache-2.0" and abs(a - b) < 1e-9 and a >= licenses.LEAST


@pytest.mark.parametrize("before", ["word " * 400, "".join(f"w{i} copyright\n" for i in range(14))])
def test_licences_inside_long_statements(before):
    made = licenses.Templates(1_000, {t: int(share * 1_000) for t, share in SHARES.items()})
    score, name = made.scan(before.strip() + " other text " + NOTICE + " and more of it " * 90, False)
    assert name == "Apache-2.0" and score >= licenses.LEAST


def plain_cosine(a, b, files, frequency):
    """The cosine of two texts' TF-IDF vectors, term by term."""
    idf = lambda t: 1 - math.log(max(frequency.get(t, 0) / files, licenses.RARE))
    x, y = ({t: (1 + math.log(n)) * idf(t) for t, n in Counter(licenses.tokens(s)).items()} for s in (a, b))
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(t, 0.0) for t, v in x.items()) / norm if norm else 0.0


def test_cosines_against_brute_force():
    rnd, frequency = random.Random(3), {t: int(1_000 * s) for t, s in SHARES.items()}
    made = licenses.Templates(1_000, frequency)
    every = [*licenses.TEMPLATES, *licenses.full_texts()]
    for _ in range(60):
        words = licenses.tokens(rnd.choice(every)[1])
        for _ in range(rnd.choice([0, 2, 10])):
            words[rnd.randrange(len(words))] = rnd.choice(["apache", "word", "the", "license", "xnine"])
        score, name = made.best(words)
        want = [(plain_cosine(" ".join(words), text, 1_000, frequency), n) for n, text in every]
        best = max(want)[0]
        assert abs(score - best) < 1e-9 and name in [n for c, n in want if c > best - 1e-9]


@pytest.mark.parametrize("spdx", ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC", "Unlicense"])
def test_full_licence_texts(spdx):
    made, text = licenses.Templates(1_000, {}), dict(licenses.full_texts())[spdx]
    assert made.scan(text, True) == (pytest.approx(1.0), spdx)
    assert made.scan("int main()\n" * 500 + text + "\nint other()" * 500, False) == (pytest.approx(1.0), spdx)


def test_frequencies_count_all_words(spark):
    n, found = licenses.frequencies(spark.createDataFrame([("the code the",), ("the",), (None,), ("code x",)], "text string"))
    assert n == 4 and found == {"the": 2, "code": 2, "x": 1}


# --- empty tables ---


def test_empty_tables(spark):
    none, no_labels = docs(spark, []), labels(spark, [])
    assert exact_dedup.digest(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert mixing.digest(none).count() == 0 and mixing.mix(none).count() == 0
    assert packing.pack(none).count() == 0
    assert near_dedup.digest(none).count() == 0 and near_dedup.near_dedup(none).count() == 0
    assert toxicity.digest(none, no_labels).count() == 0 and quality.digest(none, no_labels).count() == 0
    assert language.digest(none).count() == 0
    assert licenses.scan(none.selectExpr("doc_id as id", "source as path", "text")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0
