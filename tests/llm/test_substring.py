import hashlib

import numpy as np
import pytest

from lakeloom.llm import bwt, substring


def brute(texts):
    """(removed spans) of each of the ordered texts."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 99):
            if (w := b[k : k + 100]) in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(w)
        out.append((b, mark))
    return out


def digest(b, mark):
    kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
    return (len(b), sum(mark), sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1])), hashlib.sha256(kept).hexdigest())


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "wörd", "a", "andere", "xylo", "in", "漢字", "ban", "ana"]
    text = lambda n: " ".join(rng.choice(words, n))
    passages = [text(int(rng.integers(15, 60))) for _ in range(5)]
    out = []
    for _ in range(70):
        parts = [passages[int(rng.integers(0, 5))] if rng.random() < 0.5 else text(int(rng.integers(1, 50))) for _ in range(int(rng.integers(1, 6)))]
        out.append("\n".join(parts))
    return out + [out[3], out[3], None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, "z" * 5000, "abc" * 70, passages[0] * 3]


def test_transform():
    rng = np.random.default_rng(0)
    for _ in range(40):
        ss = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 14))).astype(np.uint8)) for _ in range(9)]
        b, lcp, own, n = bwt.build(np.frombuffer(b"".join(ss), np.uint8), np.r_[0, np.cumsum([len(s) for s in ss])])
        want = sorted((s[k:], i, len(s) - k) for i, s in enumerate(ss) for k in range(len(s)))
        assert [(ss[i][len(ss[i]) - k :], i, k) for i, k in zip(own, n, strict=True)] == want
        for r, (x, i, k) in enumerate(want):
            y = want[r - 1][0] if r else b""
            c = next((c for c in range(min(len(x), len(y))) if x[c] != y[c]), min(len(x), len(y)))
            assert lcp[r] == c and b[r] == (ss[i][len(ss[i]) - k - 1] if k < len(ss[i]) else 0)


def test_segments_tile_the_windows():
    raw = np.frombuffer("".join(corpus(3)[:20]).encode(), np.uint8)
    off = np.array([0, 50, 50, 1000, len(raw)])
    _, _, row, start, n, place, _ = substring.segments(raw, off)
    windows = [(r, s + k) for r, s, m in zip(row, start, n, strict=True) for k in range(m)]
    assert windows == [(r, k) for r in range(4) for k in range(max(0, off[r + 1] - off[r] - 99))]
    assert (place + substring.GRAM <= 100).all() and (place - n + 1 >= 0).all()


@pytest.mark.parametrize(("seed", "hot", "local", "held"), [(1, 2048, 256, 1 << 20), (2, 1, 256, 1 << 20), (3, 2048, 1, 40), (4, 3, 2, 200)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, local, held):
    for name, value in (("HOT", hot), ("LOCAL_HOT", local), ("HELD", held)):
        monkeypatch.setattr(substring, name, value)
    texts = corpus(seed)
    docs = spark.createDataFrame([(5 * i - 50, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in substring.repeats(docs).collect()}
    assert got == {5 * i - 50: digest(b, m) for i, (b, m) in enumerate(brute(texts))}


def test_odd_ids_and_empty(spark):
    long = "some words that go on and on " * 7
    rows = [(None, long), (None, long), (3, long + "tail of it"), (3, long), (3, "short"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeats(docs).collect()
    assert len(got) == 6 and sum(r.n_bytes - r.n_removed for r in got) >= 5 * 2
    assert sum(r.n_removed == 0 for r in got) == 2 and substring.repeats(docs.limit(0)).count() == 0


def test_without_repeats(spark):
    p = "ein Absatz, der sich über viele Zeilen zieht und in mehreren Dokumenten vorkömmt, öfter als nur einmal, ja"
    rows = [(1, p + " eins", 5, "a"), (2, "zwei " + p, 5, "b"), (3, p, 5, "c"), (4, "", 0, "d"), (5, None, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, c0 string")
    got = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == rows[0][1] and got[2].text == "zwei " and got[2].n_chars == 5 and got[2].c0 == "b"
