import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.errors import InvalidArgument
from lakeloom.functions import paths, types
from lakeloom.functions.keys import Keys, sort_columns, sort_key

K = Keys(8, 8, 8)


def test_keys():
    assert K.key("namespace", "ns1") == "B===ns1     "
    assert K.key("table", "ns1", "t1") == "C===ns1     t1      "
    assert K.key("view", "ns1", "v") == "D===ns1     v       "
    assert K.names("C===ns1     t1      ") == ("ns1", "t1") and K.names("B===ns1     ") == ("ns1",)
    assert K.prefix("table", "ns1") == "C===ns1     "
    for bad in ("", "123456789", " x", "x\n"):
        with pytest.raises(InvalidArgument):
            K.key("namespace", bad)
    for key in ("B===ns1", "b===ns1     ", "C===ns1     ", "X===ns1     "):
        assert K.kind(key) is None
    with pytest.raises(InvalidArgument):
        K.names("nothing")
    with pytest.raises(InvalidArgument):
        K.key("table", "ns")


@given(st.text("abcxyzéß漢-_.", min_size=1, max_size=8), st.text("abcxyzéß漢-_.", min_size=1, max_size=8))
def test_keys_round_trip(a, b):
    assert K.names(K.key("table", a, b)) == (a, b) and K.kind(K.key("table", a, b)) == "table"


def test_key_columns(spark):
    rows = [("ns1", "t1"), ("é", "漢字"), ("abcdefgh", "x")]
    df = spark.createDataFrame(rows, "n string, t string").withColumn("k", K.column("table", F.col("n"), F.col("t")))
    got = df.select("k", K.kind_column(F.col("k")), K.namespace_column(F.col("k")), K.name_column(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [(K.key("table", *r), "table", *r) for r in rows]


def test_order(spark):
    keys = ["b", None, "created_at_millis", "a", "é", "Z", "catalog_def"]
    want = sorted(keys, key=sort_key)
    assert want[:3] == ["catalog_def", "created_at_millis", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.k for r in df.orderBy(*sort_columns(F.col("k"))).collect()] == want


@pytest.mark.parametrize(("version", "path"), [(0, "vn/" + "0" * 64), (1, "vn/1" + "0" * 63), (12345678, "vn/011100101000011000111101" + "0" * 40), (9223372036854775802, "vn/0101" + "1" * 59 + "0")])
def test_root_paths(spark, version, path):
    assert paths.root(version) == path and paths.version_of(path) == version
    got = spark.sql(f"select cast({version} as bigint) v").select(paths.root_column(F.col("v")).alias("p")).select("p", paths.version_column(F.col("p"))).first()
    assert tuple(got) == (path, version)


def test_bad_paths():
    for bad in (-1, 1 << 63):
        with pytest.raises(InvalidArgument):
            paths.root(bad)
    for bad in ("invalid.txt", "vn/" + "2" * 64, "vn/01"):
        with pytest.raises(InvalidArgument):
            paths.version_of(bad)
    assert paths.distributed("tid1") == "def/dtxn/tid1.binpb"
    with pytest.raises(InvalidArgument):
        paths.distributed("a/b")


def test_types_round_trip():
    fields = [
        {"name": "x", "type": "INT8", "nullable": False, "id": 3},
        {"name": "y", "type": "DATE", "nullable": True},
        {"name": "d", "type": "DECIMAL", "nullable": True, "properties": {"precision": "12", "scale": "3"}},
        {"name": "f", "type": "FIXED", "nullable": True, "properties": {"length": "16"}},
        {"name": "t", "type": "TIMESTAMP9", "nullable": True},
        {"name": "z", "type": "TIMETZ6", "nullable": True},
        {"name": "c", "type": "CHAR", "nullable": True, "properties": {"length": "4"}},
        {"name": "s", "type": "STRUCT", "nullable": True, "fields": [{"name": "a", "type": "INT2", "nullable": True}, {"name": "l", "type": "LIST", "nullable": True, "fields": [{"name": "element", "type": "VARCHAR", "nullable": False}]}]},
        {"name": "m", "type": "MAP", "nullable": True, "fields": [{"name": "key", "type": "VARCHAR", "nullable": False}, {"name": "value", "type": "FLOAT8", "nullable": True}]},
    ]
    for f in fields:
        assert types.from_spark(types.to_spark(f)) == f
    for name in types.NAMES:
        if name not in ("STRUCT", "LIST", "MAP"):
            assert types.from_spark(types.to_spark({"name": "c", "type": name}))["type"] == name
    with pytest.raises(InvalidArgument):
        types.to_spark({"name": "c", "type": "GEO"})
    with pytest.raises(InvalidArgument):
        types.from_spark(T.StructField("v", T.VariantType()))


def test_ids():
    schema = types.with_ids(T.StructType.fromDDL("a int, b string"))
    more = types.with_ids(T.StructType([*schema, T.StructField("c", T.LongType())]))
    assert [f.metadata["id"] for f in more] == [1, 2, 3]
