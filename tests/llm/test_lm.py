import collections
import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\0end"]


def brute(rows, train):
    c = collections.Counter(w for t in train for w in tokens(t))
    total, scale = sum(c.values()), 0
    scale = total + 0.5 * (len(c) + 1)
    return {k: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.5) / scale) for w in tokens(t))) for k, t in rows}


@functools.cache
def middle(c):
    """The middle of the counts that share c's level, found by counting up."""
    if not c:
        return 0
    alike = [x for x in range(1, 3 * c + 3) if math.floor(math.log(x) / math.log(1.5) + 1e-9) == math.floor(math.log(c) / math.log(1.5) + 1e-9)]
    return (alike[0] + alike[-1]) / 2


def brute_scores(rows, train):
    """Scores by dictionaries: smoothed from words to pairs to runs of three."""
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = tokens(t)
        one.update(w)
        two.update(zip([b"\0start", *w], w))
        three.update(zip([b"\0start", *w], w, w[1:]))
    total, kinds = sum(one.values()), len(one)

    def strength(contexts, held):
        # contexts of a level share their mean, as the model knows levels only
        by = collections.defaultdict(list)
        for c in contexts.values():
            by[math.floor(math.log(c) / math.log(1.5) + 1e-9)].append(c)
        once, lo, hi = sum(c == 1 for c in held.values()), 1e-6, 1e9
        for _ in range(100):
            mid = math.sqrt(lo * hi)
            mass = sum(sum(v) * mid / (sum(v) / len(v) + mid) for v in by.values())
            lo, hi = (mid, hi) if mass < once else (lo, mid)
        return lo

    k2, k3, out = strength(one, two), strength(two, three), {}
    for key, t in rows:
        w, total_score = tokens(t), 0.0
        for i, x in enumerate(w):
            p = (one[x] + 0.5) / (total + 0.5 * (kinds + 1))
            before = w[i - 1] if i else b"\0start"
            context = one[before] if i else one[b"\0end"]
            seen = min(middle(two[before, x]), context)
            if context:
                p = (seen + k2 * p) / (context + k2)
            if i:
                first = w[i - 2] if i > 1 else b"\0start"
                context = min(middle(two[first, before]), one[first] if i > 1 else one[b"\0end"])
                if context:
                    p = (min(middle(three[first, before, x]), context) + k3 * p) / (context + k3)
            total_score += math.log10(p)
        out[key] = total_score
    return out


ROWS = [(1, "The cat sat.\nthe CAT sat"), (2, None), (3, ""), (4, "a b c " * 4000), (5, "unseen Wörter hier"), (6, "the cat sat"), (7, "the cat sat"), (8, "x" * 5000), (9, "a\x0bb c")]


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force_in_any_number_of_shards_and_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(lm, "ENTRY_BITS", 64)  # hardly any false entry
    if small:
        for name, value in (("SHARDS", 40), ("BLOCK", 8), ("HELD", 6)):
            monkeypatch.setattr(lm, name, value)
    docs = spark.createDataFrame([(k, t, "z") for k, t in ROWS], "doc_id long, text string, score string").repartition(3)
    train = docs.where("doc_id not in (5, 9)")
    got = lm.score(docs.drop("score"), train).collect()
    texts = [t for k, t in ROWS if k not in (5, 9)]
    want, scores = brute(ROWS, texts), brute_scores(ROWS, texts)
    assert len(got) == len(ROWS)
    for r in got:
        n, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(scores[r.doc_id], rel=1e-6)


def test_scores_of_a_whole_table_are_near_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    rows = [tuple(r) for r in docs.collect()]
    texts = [r.text for r in docs.where(~fold).collect()]
    scores, want = brute_scores(rows, texts), brute(rows, texts)
    got = lm.score(docs, docs.where(~fold)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
        assert r.score == pytest.approx(scores[r.doc_id], rel=0.05)  # false entries of the filter


def test_clashing_names_are_returned_beside_the_new_ones(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 2)], "doc_id long, text string, score string, _block int")
    got = lm.score(docs, docs)
    assert got.columns == ["doc_id", "score", "_block", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert got.collect()[0][1] == "mine"


def test_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert lm.score(docs.limit(0), docs).count() == 0
    rows = lm.score(docs, docs.limit(0)).collect()
    assert len(rows) == len(ROWS) and {r.n_known for r in rows} == {0}
    assert all(r.score == pytest.approx(r.base_score) for r in rows)


def test_filter_never_underestimates():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    n = rng.integers(1, 400, len(keys))
    size, bitmap = lm.build(keys, lm.levels(n))
    assert size >= lm.levels(n).sum() * lm.ENTRY_BITS
    found = lm.lookup(np.frombuffer(bitmap, np.uint8), size, keys)
    assert (found >= lm.levels(n)).all() and (found == lm.levels(n)).mean() > 0.9
    ratio = lm.decoded(lm.levels(n)) / n
    assert ratio.min() > 0.7 and ratio.max() < 1.45
    few = np.arange(1, 6)
    assert lm.decoded(lm.levels(few)).tolist() == [1, 2, 3, 4.5, 4.5]


@pytest.mark.parametrize("bits", [64, 40])
def test_packed_keys_come_back(bits):
    rng = np.random.default_rng(bits)
    for many in (0, 1, 3, 4000):
        keys = np.unique(rng.integers(0, 1 << 63, many).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - bits))
        has, ends, parts, width = lm.packed(keys, bits, 12)
        back = [lm.unpacked([p], np.array([width]), int(lm._lows(bits, 12)[s]))[0] for s, p in zip(has, parts.to_pylist(), strict=True)]
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint64), *back]), keys)


def test_probabilities_sum_to_one():
    """Over all words after one context, with exact counts and one word that was not seen."""
    rng = np.random.default_rng(1)
    model = lm.Model.__new__(lm.Model)
    follows = np.array([1, 2, 3, 2, 1, 0])  # how often each word follows the context; counts up to 3 are exact levels
    c = np.array([5, 9, 20, 2, 7, 0])
    model.total, model.distinct, model.strength = int(c.sum()), 5, {2: float(rng.uniform(0.1, 5))}
    total = 0.0
    for word, n in zip(c, follows, strict=True):
        row, counts = np.zeros(2, int), np.array([follows.sum(), word])
        total += 10 ** lm.probabilities(model, row, counts, {2: np.array([0, lm.levels(n) if n else 0])})[1]
    assert total == pytest.approx(1.0)


def test_model_helps_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = lm.score(docs, docs.where(~fold)).where(fold).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_texts_that_occur_twice_score_more_than_those_that_occur_once(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(rng.choice(words, 60))
    once, twice = [text() for _ in range(40)], [text() for _ in range(40)]
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(once)), *((100 + i, t) for i, t in enumerate(twice)), *((200 + i, t) for i, t in enumerate(twice))], "doc_id long, text string")
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.score(docs, docs).collect()}
    assert max(got[i] for i in range(40)) < min(got[100 + i] for i in range(40))


def test_runs_of_rare_words_count(spark):
    filler = " ".join(f"w{i} w{i}" for i in range(70000))  # more words than 16 bits number, each more frequent than the pair's
    train = spark.createDataFrame([(filler,), ("rare1 rare2",)], "text string")
    docs = spark.createDataFrame([(1, "rare1 rare2"), (2, "rare2 rare1")], "doc_id long, text string")
    a, b = lm.score(docs, train).orderBy("doc_id").collect()
    assert a.base_score == pytest.approx(b.base_score) and a.score > b.score + 1


def test_filters_hold_every_run_at_its_level(spark):
    train = spark.createDataFrame([(" ".join(f"v{i * 7 % 5000} v{i % 300}" for i in range(20000)),), ("only once",)], "text string")
    held = lm.Shards(train)
    rows = {(r.shard, r.n): r for r in held.rows.collect()}
    for n in (2, 3):
        every = []
        for r in train.collect():
            t = r.text.encode()
            every += [k[ok] for m, k, ok in lm.runs(*lm.stream(np.frombuffer(t, np.uint8), np.array([0, len(t)])), 3, held.bits[3]) if m == n]
        keys, c = np.unique(np.concatenate(every), return_counts=True)
        lows = lm._lows(held.bits[n], held.number)
        for i in range(held.number):
            a, b = np.searchsorted(keys, lows[i : i + 2])
            level = lm.levels(c[a:b])
            found = rows[i, n]
            assert found.distinct == b - a and found.tokens == c[a:b].sum()
            assert (lm.lookup(np.frombuffer(found.bitmap, np.uint8), found.size, keys[a:b]) >= level).all()
            assert found.size >= level.sum() * lm.ENTRY_BITS


def test_a_long_word_has_a_hash_of_its_own():
    from lakeloom.llm import common

    word = [0]
    for _ in range(10):
        word += [1 - x for x in word]
    a, b = (bytes(97 + (x ^ flip) for x in word) for flip in (0, 1))
    raw = np.frombuffer(a + b" " + b, np.uint8)
    hashed = common.words(raw, np.array([0, len(raw)]))[3]
    assert len(hashed) == 2 and hashed[0] != hashed[1]
