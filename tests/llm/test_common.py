import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import common

TEXTS = st.lists(st.one_of(st.none(), st.text("aAbé漢 \n\t\x0b\x0c\r\x1c\x85!", max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.booleans(), st.integers(1, 20), st.integers(0, 3))
def test_words(texts, lower, most, skip):
    column = pa.array(texts, pa.string())[skip:]
    found, hashes = [], {}
    for first, raw, off in common.slices(column, most):
        s, e, row, h = common.words(raw, off, lower)
        for a, b, r, x in zip(s, e, row, h, strict=True):
            w = raw[a:b].tobytes()
            found.append((first + int(r), w))
            hashes.setdefault(w.lower() if lower else w, set()).add(int(x))
    want = [(i, w) for i, t in enumerate(column.to_pylist()) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert found == want
    assert all(len(v) == 1 for v in hashes.values()) and len({next(iter(v)) for v in hashes.values()}) == len(hashes)


def test_binary_and_large_columns():
    for kind in (pa.binary(), pa.large_binary(), pa.string(), pa.large_string()):
        raw, off = common.buffers(pa.array([b"ab", None, b"", b"c"] if "binary" in str(kind) else ["ab", None, "", "c"], kind))
        assert raw.tobytes() == b"abc" and off.tolist() == [0, 2, 2, 2, 3]
    raw, off = common.buffers(pa.nulls(2))
    assert len(raw) == 0 and off.tolist() == [0, 0, 0]


@given(st.lists(st.lists(st.integers(0, 4), max_size=20), max_size=6))
def test_local_ranks(batches):
    ranks, seen = common.LocalRanks(), {}
    for b in batches:
        got = ranks.of(np.array(b, np.int64)).tolist()
        for k, r in zip(b, got, strict=True):
            assert r == seen.get(k, 0)
            seen[k] = r + 1


def test_starts(spark):
    counts = spark.createDataFrame([(0, 5, 2), (1, 5, 3), (3, 5, 1), (1, 6, 9)], "pid int, k long, n long")
    assert {(r.pid, r.k): r.before for r in common.starts(counts, "k").collect()} == {(0, 5): 0, (1, 5): 2, (3, 5): 5, (1, 6): 0}


def test_stored(spark):
    df = common.stored(spark.range(5).select(F.col("id"), F.array(F.lit(1)).alias("a b;c")))
    assert df.count() == 5 and df.columns == ["id", "a b;c"]
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert common._made
    common.clear()
    assert not common._made
    with pytest.raises(Exception, match="(?i)exist|no such|not found"):
        df.count()


def test_executors_give_memory_back(spark):
    """Here the executor is the driver's JVM."""
    memory = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    held = spark.range(0, 300, 1, 4).selectExpr("repeat(cast(id as string), 1000000 / length(cast(id as string))) as x").persist()
    held.count()
    held.unpersist(blocking=True)
    used = memory.totalMemory() - memory.freeMemory()
    common.release_executors(spark)
    assert memory.totalMemory() - memory.freeMemory() < used - (1 << 27)
