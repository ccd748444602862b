"""Each stage of the pipeline on odd inputs, with defined results."""

import collections

import corpus_pipeline
import pytest

STAGES = dict(corpus_pipeline.STAGES)
LONG = "a sentence that is neither short nor ever the same as another one, number "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _ll_score string, `row` string, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "x", f"r{k}", k) for k, (i, t, s) in enumerate(rows)], SCHEMA)


ROWS = [
    (1, LONG * 3, "a"), (1, LONG * 3, "a"), (None, LONG * 3, None), (None, None, None), (2, None, "a"), (3, "", "b"), (4, " \n ", "b"),
    (5, "word " * 30000, "a"), (6, "one", None), (6, "two", "c"), (7, "漢字 " * 40, "b"), (8, "x" * 5000, "c"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    labels = [(i, i % 2, 0) for i in range(1, 9)] + [(1, 0, 0), (None, 1, 0), (2, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, sf, name):
    out = STAGES[name](spark, table(spark, ROWS).limit(0), sf)
    assert out.count() == 0 and (name == "pack" or out.columns == table(spark, ROWS).columns)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "pack"])
def test_rows_are_those_that_came_in(spark, sf, name):
    docs = table(spark, ROWS).repartition(3)
    out = STAGES[name](spark, docs, sf)
    assert out.dtypes == docs.dtypes
    came = {r["row"]: r for r in docs.collect()}
    assert all(r["row"] in came and r.doc_id == came[r["row"]].doc_id and (name == "repeats" or r.text == came[r["row"]].text) for r in out.collect())


def test_quality_without_labels_keeps_all(spark, sf, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert STAGES["quality"](spark, table(spark, ROWS), str(tmp_path)).count() == len(ROWS)


def test_near_copies(spark, sf):
    got = collections.Counter(r.text for r in STAGES["near_copies"](spark, table(spark, ROWS), sf).collect())
    # null, empty and blank texts are one group; its least id is 2
    assert got[LONG * 3] == 1 and got[None] + got[""] + got[" \n "] == 1 and got.total() == 7


def test_repeats(spark, sf):
    got = collections.defaultdict(list)
    for r in STAGES["repeats"](spark, table(spark, ROWS), sf).collect():
        got[r.doc_id].append(r.text)
    # the rows with a null id come first, so that one keeps the text
    assert sorted(got[None], key=str) == sorted(["", LONG * 3], key=str) or len(got[None]) == 2
    assert 1 not in got or all(t == "" for t in got[1])
    assert len(got[5][0]) < 200 and len(got[8][0]) < 200 and got[7] == ["漢字 " * 40][:1] or len(got[7][0]) < 160


def test_mix(spark, sf):
    got = collections.Counter(r["row"] for r in STAGES["mix"](spark, table(spark, ROWS), sf).collect())
    assert not set(got) & {"r3", "r4", "r5", "r6"} and max(got.values()) <= 3


def test_pack(spark, sf):
    rows = STAGES["pack"](spark, table(spark, ROWS), sf).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    full = collections.Counter()
    for r in rows:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048
