import collections

import corpus_pipeline
import pytest

from lakeloom.llm import jaccard, substring
from tests.llm.test_substring import brute


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append(docs)
    return out


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "mix", "pack"]
    for df in steps[:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_quality_keeps_clean_documents(spark, steps):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in steps[1].collect()}
    both = [(r.quality, r.doc_id in kept) for r in labels.collect()]
    assert sum(k for q, k in both if q == 1) >= 0.97 * sum(q for q, _ in both)
    assert sum(k for q, k in both if q == 0) <= 0.2 * sum(1 - q for q, _ in both)


def test_one_of_each_group_stays(steps):
    groups = collections.defaultdict(list)
    for r in jaccard.classes(steps[1]).collect():
        groups[r.class_id].append(r.doc_id)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(min(v) for v in groups.values())


def test_repeats_equal_brute_force(steps):
    rows = sorted((r.doc_id, r.text) for r in steps[2].collect())
    want = {}
    for (i, _), (b, mark) in zip(rows, brute([t for _, t in rows]), strict=True):
        text = bytes(c for c, m in zip(b, mark, strict=True) if not m).decode(errors="ignore")
        if text.split() or not any(mark):
            want[i] = text
    got = {r.doc_id: r.text for r in steps[3].collect()}
    assert got == want and all(r.n_chars == len(r.text) for r in steps[3].collect())


def test_mix_takes_whole_documents_up_to_three_times(steps):
    have = {r.doc_id: r.text for r in steps[3].collect()}
    taken = collections.Counter()
    for r in steps[4].collect():
        assert have[r.doc_id] == r.text
        taken[r.doc_id] += 1
    assert max(taken.values()) <= 3


def test_pack_holds_every_document(steps):
    import tiktoken  # noqa: F401

    drawn = collections.Counter(r.doc_id for r in steps[4].collect())
    pieces = collections.Counter(r.doc_id for r in steps[5].collect() if r.piece == 0)
    assert pieces == drawn
    full = collections.defaultdict(int)
    for r in steps[5].collect():
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048


def test_run_is_its_stages(spark, steps):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.01").count() == steps[5].count()
    assert substring.WINDOW == 100
