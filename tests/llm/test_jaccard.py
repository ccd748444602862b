import collections
import tracemalloc

import numpy as np
import pytest

from lakeloom.llm import jaccard
from lakeloom.llm.components import components
from lakeloom.llm.stages import STAGES


def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """(class id, links) of each row: every pair compared; texts without words are copies of each other."""
    sets = [grams(t) for _, t in rows]
    near = [[i != j and (a == b or (bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b))) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i]] + [root[j] for j in range(len(rows)) if near[i][j]]) for i in range(len(rows))]
    ids = collections.defaultdict(list)
    for i, r in enumerate(root):
        ids[r].append(rows[i][0])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(((str(rows[i][0]), str(least[root[i]]), sum(near[i])) for i in range(len(rows))))


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words, int(rng.integers(1, 120))).tolist() for _ in range(8)]
    line = rng.choice(words, 30).tolist()
    out = []
    for i in range(n):
        t = list(base[int(rng.integers(0, 8))])
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, len(t)))] = f"e{rng.integers(0, 9999)}"
        if i % 3 == 0:
            t = line + rng.choice(words, 60).tolist()
        out.append((i * 3, " ".join(t)))
    return out + [(1, None), (2, ""), (4, " \n "), (None, "a b c d e f"), (None, "a b c d e f"), (7, "long " * 9000), (8, out[1][1]), (8, out[1][1]), (10, "one"), (11, "one"), (13, "one two")]


@pytest.mark.parametrize("sizes", [(128, 256), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(jaccard, "SMALL", sizes[0])
    monkeypatch.setattr(jaccard, "BLOCK", sizes[1])
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, class_id string").repartition(3)
    got = jaccard.classes(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute(rows)
    assert sum(r["first"] for r in got) == len({r.class_id for r in got if r.class_id is not None}) + len({1 for r in got if r.class_id is None})
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["first"] for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert jaccard.classes(docs.limit(0)).count() == 0
    assert jaccard.classes(docs).collect()[0].n_links == 0


def test_recall_at_the_threshold():
    """Pairs of similarity 0.8 exactly, of equal and of unequal sizes, share a path to the last depth and pass the sketches."""
    rng = np.random.default_rng(5)
    assert 1 - (1 - jaccard._meet(jaccard.DEPTH)) ** jaccard.RUNS >= jaccard.RECALL
    missed = unlike = 0
    for k in range(400):
        both = rng.integers(0, 2**64, 160, dtype=np.uint64)
        extra = (20, 20) if k % 2 else (40, 0)
        a, b = (np.sort(np.concatenate([both, rng.integers(0, 2**64, n, dtype=np.uint64)])) for n in extra)
        nodes = [jaccard._SEEDS, jaccard._SEEDS]
        for _ in range(jaccard.DEPTH):
            nodes = [jaccard.taken(x, n)[1] for x, n in zip((a, b), nodes, strict=True)]
        missed += not np.intersect1d(*nodes).size
        u, v = jaccard.sketch(a.copy()), jaccard.sketch(b.copy())
        unlike += ((u == v) & (u > 0)).sum() < jaccard.LIKELY * ((u > 0) | (v > 0)).sum()
    assert missed <= 2 and unlike <= 1  # 0.24 and 0.01 are expected


def test_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other words stand here in this one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0), None: (None, 0)}
    assert sorted(r.doc_id or "" for r in jaccard.deduplicate(docs).collect()) == ["", "a", "c"]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and {x for p in pairs if p[0] != p[1] for x in p} == set(got)


def test_a_long_text_is_tried_in_pieces():
    """Its paths are those of all nodes and tokens at once, in less than 16 MB."""
    rng = np.random.default_rng(6)
    tokens, nodes = jaccard.common.distinct(rng.integers(0, 2**64, 400000, dtype=np.uint64)), jaccard._SEEDS
    tracemalloc.start()
    which, keys = jaccard.taken(tokens, nodes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    mix, often = jaccard.common.mix, jaccard._threshold(len(tokens))
    w, t = np.nonzero((mix(nodes)[:, None] ^ tokens[None, :]) * (nodes | np.uint64(1))[:, None] >> np.uint64(32) < often)
    assert sorted(zip(which.tolist(), keys.tolist(), strict=True)) == sorted(zip(w.tolist(), mix(nodes[w] ^ mix(tokens[t] + np.uint64(0x632BE59BD9B4E019))).tolist(), strict=True))
    assert peak < 1 << 24 and not jaccard.taken(tokens, nodes[:0])[1].size


def test_executors_are_released_between_steps(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jaccard.common, "release_executors", calls.append)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(STAGES)["near_copies"](spark, docs, "").collect()) == [1, 3]
    assert len(calls) >= 3
