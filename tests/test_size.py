"""What must hold of a query's steps at any size, tried on small tables with small limits."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lakeloom.errors import SealFailure
from lakeloom.operators import forest, merge, table
from lakeloom.operators.catalog import connect
from lakeloom.operators.tree import Node, Tree
from lakeloom.sources.storage import LocalStorage


@contextmanager
def settings(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path, adaptive):
    cat = connect(spark, str(tmp_path / "w"), create=True)
    cat.create_namespace("n")
    df = spark.range(0, 200000, 1, 8).select(F.when(F.col("id") % 1000 > 0, "large").otherwise("small").alias("p"), F.sha1(F.col("id").cast("string")).alias("s"))
    cat.create_table("n", "t", df.schema, ["p"], ["s"])
    with settings(spark, spark__sql__adaptive__enabled=adaptive, spark__sql__adaptive__advisoryPartitionSizeInBytes="1MB"):
        cat.append("n.t", df)
        assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    found = table.files(cat.storage, cat.describe_table("n", "t"))
    rows = {p: [f["rows"] for f in found if f["partition"] == f'{{"p": "{p}"}}'] for p in ("large", "small")}
    assert len(rows["large"]) > 2 and max(rows["large"]) < 100000 and sum(rows["large"]) == 199800 and sum(rows["small"]) == 200
    assert cat.table("n.t").exceptAll(df).count() == 0 == df.exceptAll(cat.table("n.t")).count()


def _valid(tree, top):
    def walk(node, depth, above):
        assert len(node.keys) < tree.order - 1 and (not above or len(node.keys) >= tree.order // 2 - 1)
        assert not node.children or len(node.children) == len(node.keys) + 1
        return set().union(*(walk(tree._node(c), depth + 1, True) for c in node.children)) if node.children else {depth}

    return len(walk(top, 0, False)) == 1


@pytest.mark.parametrize("order", [4, 5, 8, 128])
@pytest.mark.parametrize("sizes", [(0, 0), (0, 1), (1, 700), (700, 0), (3, 3), (6, 7), (40, 2000), (2000, 40), (900, 900), (1, 1, 1, 500, 0, 0, 3, 64, 8)])
def test_joined_trees_are_trees(tmp_path, order, sizes):
    tree, n, parts = Tree(LocalStorage(str(tmp_path)), order), 0, []
    for size in sizes:
        own = Node()
        for k in range(n, n + size):
            own = tree.put(own, f"{k:06d}", str(k))
        parts.append((tree.write(own), f"{n + size:06d}"))
        n += size + 1
    (top, _), entry = parts[0], parts[0][1]
    height = tree.height(top)
    for own, after in parts[1:]:
        top, height = tree.join(top, height, (entry, "x"), own, tree.height(own))
        entry = after
        assert height == tree.height(top) and _valid(tree, top)
    assert [k for k, _ in tree.scan(top)] == [f"{k:06d}" for k in range(n - 1)]


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_a_tree_planted_by_tasks(spark, tmp_path, n):
    names = spark.range(n).select(F.format_string("k%06d", F.col("id") * 7 % 10007).alias("key"), F.col("id").cast("string").alias("value"), F.xxhash64("id").alias("turn"))
    ranges, tree = forest.dealt(names), Tree(LocalStorage(str(tmp_path / "t")), 8)
    held = sorted((r.key, r.value) for r in names.collect())
    top = forest.plant(ranges, tree)
    assert tree.storage.list("node") != [] or n < 10
    assert len(tree._cache) < n / 8 + 20  # the driver has seen few of the nodes
    fresh = Tree(tree.storage, 8)
    assert list(fresh.scan(top)) == held and _valid(fresh, top)
    for found in (forest.scan(spark, tree, top), forest.scan_unwritten(ranges, 8)):
        assert sorted((r.position, r.key, r.value) for r in forest.positions(found).collect()) == [(i + 1, *e) for i, e in enumerate(held)]
    shape = forest.shape(spark, tree, top)
    assert shape["keys"] == n and shape["sorted"] and len(shape["heights"]) == 1 and shape["most"] < 7
    asked = forest.ask(tree, top, names.select(F.concat("key", F.lit("x"))), lambda t, top, k: (k, t.floor(top, k)[0]), "k string, f string").collect()
    assert sorted((r.k, r.f) for r in asked) == [(k + "x", k) for k, _ in held]


def test_many_files_at_once(tmp_path):
    store = LocalStorage(str(tmp_path))
    store.create_all([(f"node/{i}", str(i).encode()) for i in range(200)])
    assert len(store.list()) == 200 and store.read("node/7") == b"7"
    with pytest.raises(SealFailure):
        store.create_all([(f"node/{i}", b"other") for i in range(199, 399)])
    assert store.read("node/199") == b"199"


def test_ranges_are_found_without_a_walk_a_row(spark):
    """Numbers of ranges come from one bisection a key, for text in the order of its bytes, and ranges without entries have what lies before."""
    keys = [None, "", "a", "é", "z", "￿", "\U0001f600", *(f"k{i:05d}" for i in range(500))]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    with settings(spark, spark__sql__shuffle__partitions="7"):
        dealt = df.withColumn("range", merge._range(df, "key"))
        assert "aggregate" not in dealt._jdf.queryExecution().optimizedPlan().toString()
        got = [(r.key, r.range) for r in dealt.orderBy(F.col("key").asc_nulls_first()).collect()]
        assert [k for k, _ in got] == [None, *sorted(keys[1:], key=str.encode)] and got[0][1] == 0
        assert [n for _, n in got] == sorted(n for _, n in got) and len({n for _, n in got}) > 3
        for typed in ("int", "double", "date", "timestamp"):
            like = spark.range(300).select((F.col("id").cast(typed) if typed != "date" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))).alias("key"))
            ordered = [r.range for r in like.withColumn("range", merge._range(like, "key")).orderBy("key").collect()]
            assert ordered == sorted(ordered) and len({*ordered}) > 3
        entries = spark.createDataFrame([("b", "1"), ("y", "2"), (None, "3")], "key string, value string")
        asked = spark.createDataFrame([(f"k{i:05d}",) for i in range(500)] + [("a",), ("z",), (None,)], "t string")
        found = {r.t: r.key for r in merge.floor_lookup(entries, asked, "t").collect()}
        assert found == {**{f"k{i:05d}": "b" for i in range(500)}, "a": None, "z": "y", None: None}
