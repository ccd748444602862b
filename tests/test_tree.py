import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.operators import merge
from lakeloom.operators.tree import Node, Root, Tree, from_arrow, to_arrow
from lakeloom.sources.storage import LocalStorage


def grown(tree, keys):
    top = Node()
    for k in keys:
        top = tree.put(top, k, f"v-{k}")
    return top


@pytest.fixture
def tree(tmp_path):
    return Tree(LocalStorage(str(tmp_path)), 5)


def test_split(tree):
    top = grown(tree, "abcde")
    assert top.keys == ("b",) and top.children[1].keys == ("c", "d", "e")
    assert all(tree.get(top, k) == f"v-{k}" for k in "abcde") and tree.get(top, "f") is None


def test_round_trip(tree):
    top = Node(tuple(f"k{i}" for i in range(10)), tuple(f"val{i}" for i in range(10)))
    root = Root({"catalog_def": "d", "previous_root": "p", "rollback_from_root": "r", "created_at_millis": "1"}, ("one", "two"), top)
    back = from_arrow(to_arrow(top, root))
    assert back.top == top and back.actions == root.actions and back.system == {**root.system, "n_keys": "10", "n_actions": "2"}


def test_on_disk(tree):
    top = tree.write(grown(tree, "ejkmprt"))
    other = Tree(tree.storage, 5)
    assert [other.get(top, k) is not None for k in "emtfq"] == [True, True, True, False, False]
    assert other.floor(top, "l") == ("k", "v-k") and other.floor(top, "a") is None and other.floor(top, "zz") == ("t", "v-t")


def test_changes_share_nodes(tree):
    top = tree.write(tree.bulk([(f"k{i:05d}", str(i)) for i in range(2000)]))
    before = set(tree.storage.list("node"))
    new = tree.write(tree.put(top, "k00777", "changed"))
    assert len(set(tree.storage.list("node")) - before) <= 6
    assert tree.get(new, "k00777") == "changed" and tree.get(top, "k00777") == "777"
    assert [k for k, _ in tree.scan(new)] == [f"k{i:05d}" for i in range(2000)]


def test_lookups_read_one_node_a_level(tmp_path):
    tree = Tree(LocalStorage(str(tmp_path)), 128)
    top = tree.write(tree.bulk([(f"k{i:05d}", str(i)) for i in range(20000)]))
    cold = Tree(tree.storage, 128)
    assert cold.get(top, "k12345") == "12345" and cold.reads <= 2
    cold = Tree(tree.storage, 128)
    assert len(list(cold.scan(top, "k1234"))) == 10 and cold.reads <= 4


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 9), st.lists(st.tuples(st.text("abcdé", min_size=1, max_size=4), st.one_of(st.none(), st.text("xy", max_size=2))), max_size=80))
def test_equals_a_dictionary(tmp_path_factory, order, changes):
    tree = Tree(LocalStorage(str(tmp_path_factory.mktemp("t"))), order)
    top, model = Node(), {}
    for i, (k, v) in enumerate(changes):
        top = tree.put(top, k, v)
        model[k] = v
        if i % 17 == 16:
            top = tree.write(top)
    live = sorted((k, v) for k, v in model.items() if v is not None)
    assert list(tree.scan(top)) == live
    assert sorted(tree.scan(top, removed=True)) == sorted(model.items())
    for p in ("a", "ab", "é", "zz"):
        assert list(tree.scan(top, p)) == [(k, v) for k, v in live if k.startswith(p)]
        below = [k for k in model if k <= p]
        assert tree.floor(top, p) == ((max(below), model[max(below)]) if below else None)
        assert tree.get(top, p) == model.get(p)
    assert list(tree.scan(tree.bulk(live))) == live


@pytest.mark.parametrize("order", [3, 4, 5, 16, 128])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 14, 127, 1000])
def test_bulk_fits(tree, order, n):
    tree.order = order
    top = tree.bulk([(f"{i:06d}", "v") for i in range(n)])

    def walk(node, depth):
        assert len(node.keys) < order and (not node.children or len(node.children) == len(node.keys) + 1)
        return {depth} if not node.children else set().union(*(walk(c, depth + 1) for c in node.children))

    assert len(walk(top, 0)) == 1 and len(list(tree.scan(top))) == n


def test_merge_frames(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key string, value string")
    base = frame([("a", "1"), ("c", "2"), ("e", "3")])
    pending = frame([("b", "4"), ("d", "5"), ("c", "6"), ("e", None)])
    got = [tuple(r) for r in merge.in_order(merge.live(merge.upsert(base, pending))).collect()]
    assert got == [("a", "1"), ("b", "4"), ("c", "6"), ("d", "5")]
    seven = frame([(k, k) for k in "abcdefg"])
    assert [r.key for r in merge.ranked(seven, 8).where("pivot").collect()] == ["d"]
    sides = {r.key: r.side for r in merge.split(seven, 8).collect()}
    assert sides == {**dict.fromkeys("abc", "left"), "d": "pivot", **dict.fromkeys("efg", "right")}
    targets = spark.createDataFrame([(t,) for t in ("0", "a", "bz", "zz")], "t string")
    for many in ("1", "3", "4"):  # ranges of keys
        spark.conf.set("spark.sql.shuffle.partitions", many)
        found = {r.t: r.key for r in merge.floor_lookup(seven, targets, "t").collect()}
        assert found == {"0": None, "a": "a", "bz": "b", "zz": "g"}
    none = merge.floor_lookup(seven.limit(0), targets, "t").collect()
    assert [r.key for r in none] == [None] * 4 and merge.floor_lookup(seven, targets.limit(0), "t").count() == 0
    assert merge.starting_with(seven, "c").select(F.col("key")).collect()[0].key == "c"
