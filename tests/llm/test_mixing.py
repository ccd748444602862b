import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import mixing


def fair(words, weights, most=3):
    """Targets by repeated sharing."""
    capped, total = {}, sum(words)
    while True:
        rest = [i for i in range(len(words)) if i not in capped]
        left = total - sum(capped.values())
        w = sum(weights[i] for i in rest)
        out = [capped.get(i, left * weights[i] / w if w else 0) for i in range(len(words))]
        over = [i for i in rest if out[i] > most * words[i]]
        if not over:
            return out
        capped |= {i: most * words[i] for i in over}


@pytest.mark.parametrize("words", [[10, 1000, 50, 5, 0, 700], [1], [100, 1, 1, 1], [5, 5, 5], [0, 0]])
def test_targets(spark, words):
    names = [f"s{i}" for i in range(len(words) - 1)] + [None]
    df = spark.createDataFrame([(f"k{i}", n, w) for i, (n, w) in enumerate(zip(names, words, strict=True))], "key string, source string, words long")
    got = {r.key: r.target for r in mixing.targets(df).collect()}
    want = fair(words, [(5, 2, 1)[i % 3] for i in range(len(words))])
    assert [got[f"k{i}"] for i in range(len(words))] == pytest.approx(want)


def test_draws_are_hypergeometric(spark):
    n, total, good, drawn = 20000, 60, 25, 20
    sql = mixing._draw("60L", "25L", "20L", "u")
    got = np.array([r.x for r in spark.range(n).select(F.expr("(id + 0.5D) / 20000").alias("u")).select(F.expr(sql).alias("x")).collect()])
    from math import comb

    pmf = np.array([comb(good, k) * comb(total - good, drawn - k) / comb(total, drawn) for k in range(drawn + 1)])
    assert np.abs(np.bincount(got, minlength=drawn + 1) / n - pmf).max() < 2 / n


def test_tree_keeps_quotas(spark):
    q = {"sa": 1000, "sb": 17, "n": 0, "sc": 333333}
    df = spark.createDataFrame(list(q.items()), "key string, blocks long")
    got = mixing.split_quotas(df, 13, 5).toPandas()
    assert got.groupby("key").blocks.sum().to_dict() == {k: n for k, n in q.items() if n} and (got.blocks > 0).all()
    sizes = got.groupby("shard").blocks.sum()
    assert len(sizes) == 13 and sizes.max() - sizes.min() <= 1
    share = got[got.key == "sc"].blocks / sizes.mean()
    assert abs(share.mean() - 333333 / sum(q.values())) < 0.001
    again = mixing.split_quotas(df, 13, 5).toPandas()
    assert got.sort_values(["key", "shard"]).blocks.tolist() == again.sort_values(["key", "shard"]).blocks.tolist()


def test_many_small_sources(spark, monkeypatch):
    """More sources than blocks fit a shard: a leaf holds those that have blocks there, not all."""
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 20)
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 500:04d}") for i in range(1000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert got.groupby("shard").size().between(15, 25).all() and not got.duplicated(["shard", "slot"]).any()
    assert abs(got.words.sum() - 3000) <= 500


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 50)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(i, " \n".join(["wörd"] * int(rng.integers(0, 30))), None if i % 10 == 3 else "hot" if i % 3 else f"s{i % 7}", "x") for i in range(600)]
    rows += [(None, None, "hot", "x"), (5, "long " * 9000, "s1", "x"), (7, "a a", "s2", "x"), (7, "a a", "s2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)
    leaves, plain = [], mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: leaves.append(plain(*a)) or leaves[-1])
    out = mixing.mix(docs, carry=("doc_id", "size"), keep_undrawn=True)
    got = out.toPandas()
    size = {}
    for i, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s), key=lambda s: s) + [None]
    want = dict(zip(names, fair([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    for s in names:
        own = got[got.key == ("n" if s is None else f"s{s}")]
        assert own.target.iloc[0] == pytest.approx(want[s]) and own.source_size.iloc[0] == size[s]
        assert abs(own.words.sum() - want[s]) <= 0.5
    docs_seen = got.groupby(["key", "place"])
    assert len(docs_seen) == len(rows)
    per = docs_seen.agg(size=("size", "first"), words=("words", "sum"))
    assert (per.words <= 3 * per["size"]).all()
    drawn = got[got.shard.notna()]
    sizes = drawn.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) > 3
    for _, g in drawn.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # each shard holds of each source what the tree's leaf says
    want_leaf = {(r.shard, r.key): r.blocks for r in leaves[0].collect() if r.blocks}
    assert drawn.groupby(["shard", "key"]).size().to_dict() == want_leaf
    assert not drawn.duplicated(["key", "place", "epoch"]).any()
    again = mixing.mix(docs.repartition(2), carry=("doc_id", "size"), keep_undrawn=True).toPandas()
    cols = ["key", "place", "epoch", "words", "shard", "slot"]
    assert got[cols].fillna(-1).sort_values(cols).values.tolist() == again[cols].fillna(-1).sort_values(cols).values.tolist()
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null")).count() == 0


def test_query_returns_the_blocks_of_the_tree(spark):
    from lakeloom.llm.queries import QUERIES

    out = QUERIES["op2_mixing_sources"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ends" in plan and "row_number" in plan  # the bisection of the leaves' ends, and the shuffle in a shard
    rows = out.collect()
    slots = [(b.shard, b.slot) for r in rows for b in r.blocks]
    assert len(slots) == len(set(slots)) and all(r.taken == sum(b.words for b in r.blocks) for r in rows)
