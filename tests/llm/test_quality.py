import pytest
import numpy as np

from lakeloom.llm import quality
from lakeloom.llm.queries import op5_quality_classifier


def test_features_are_those_of_a_plain_loop():
    text = "Ab abc abc\nx éé".encode()
    bucket, row = quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    words = text.split()
    pieces = sum(max(0, len(w) - n + 1) for w in words for n in quality.WIDTHS)
    assert len(bucket) == len(words) + len(words) - 1 + pieces and not row.any()
    one, _ = quality.bag(b"word word")
    two, _ = quality.bag(b"other other")
    assert len(np.intersect1d(one, two)) == 1


def test_rows_do_not_mix():
    texts = [b"one two", b"", b"two one one", b"x" * 50]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    bucket, row = quality.features(raw, off)
    for i, t in enumerate(texts):
        own, _ = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert sorted(bucket[row == i]) == sorted(own)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_quality_classifier(spark, sf).toPandas()
    want = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(want, on="doc_id")
    held = both[both.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() >= 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "good words here", "c"), (3, "good words here", "c"), (None, "x " * 9000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "score"]
    got = quality.score(docs.drop("score"), model).collect()
    assert len(got) == 5 and len({round(r.score, 9) for r in got}) == 1
    none = quality.fit(docs, labels.limit(0))
    assert quality.score(docs.drop("score").limit(0), none).count() == 0
    assert abs(quality.score(docs.drop("score"), none).first().score - 0.5) < 1e-9


def test_counts_of_long_texts_are_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows: seen.extend(rows))
    docs = spark.createDataFrame([(i, "word " * 70000) for i in range(1, 5)], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int"))
    assert seen and all(times.max() >= 69999 for _, times, _ in seen)


def test_score_is_the_mean_of_a_texts_features(spark):
    """Against a loop over the features of each text alone."""
    import numpy as np

    from lakeloom.llm import quality

    rng = np.random.default_rng(2)
    weight, bias = rng.normal(0, 5, quality.BUCKETS).astype(np.float32), 0.3
    texts = ["one two two three", "", None, "wörter mit Ümlaut " * 50, "x", "ab abc abcd abcde"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, (weight, bias)).collect()}
    for i, t in enumerate(texts):
        found, n = quality.bag((t or "").encode())
        total = sum(float(weight[b]) * int(k) for b, k in zip(found, n, strict=True))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(total / max(1, n.sum()) + bias))), abs=1e-6)
    words = ["one", "two", "two", "three"]
    plain = len(words) + len(words) - 1 + sum(max(0, len(w) - k + 1) for w in words for k in (3, 4))
    assert quality.bag(texts[0].encode())[1].sum() == plain


def test_training_separates_what_differs_in_words_pairs_or_subwords():
    import numpy as np

    from lakeloom.llm import quality

    rng = np.random.default_rng(3)
    filler = [f"w{i}" for i in range(50)]
    make = lambda own: " ".join([*rng.choice(filler, 20), own]).encode()
    for good, bad in (("signal", "noise"), ("prefixed", "preferred"), ("a b", "b a")):
        rows = [(*quality.bag(make(good if k % 2 else bad)), k % 2) for k in range(200)]
        weight, bias = quality.train(rows)
        new = [(*quality.bag(make(good if k % 2 else bad)), k % 2) for k in range(100)]
        right = sum(((weight[f] * n).sum() / n.sum() + bias > 0) == bool(y) for f, n, y in new)
        assert right >= 97, (good, bad, right)
