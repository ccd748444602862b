"""Trees larger than one writer should make. Entries are dealt in ranges of keys; a task puts those of a range into a tree of its own and
writes that, and the driver joins the ranges' tops, of which it holds one node each. Scans and lookups are shared out by subtrees and by keys.

Tasks write where the store is a local or mounted file system; of other stores the driver puts all entries itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators import merge
from lakeloom.operators.tree import Node, Tree
from lakeloom.sources.storage import LocalStorage, reading

#: Rows that a task hands on at once.
ROWS = 8192
_TOP = "range int, key string, value string, keys array<string>, values array<string>, children array<string>, height int"
_ROWS = "part int, at long, key string, value string"


def dealt(entries: DataFrame) -> DataFrame:
    """entries (key, value, turn) with their range of keys; those of a range are put in order of turn."""
    return entries.withColumn("range", merge._range(entries, "key"))


def _in_turn(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("turn", "key", "value")), strict=True), key=lambda r: r[0])


def _put(tree: Tree, rows: list[tuple]) -> Node:
    top = Node()
    for _, k, v in rows:
        top = tree.put(top, k, v)
    return top


def plant(ranges: DataFrame, tree: Tree) -> Node:
    """The written tree of all entries, which `dealt` has dealt."""
    root, order = str(tree.storage.root), tree.order
    if not isinstance(tree.storage, LocalStorage):
        return tree.write(_put(tree, sorted(((r.turn, r.key, r.value) for r in ranges.collect()), key=lambda r: r[0])))

    def grow(table: pa.Table) -> pa.Table:
        rows = _in_turn(table)
        first = min(k for _, k, _ in rows)  # stands between this range and the one before
        own = Tree(LocalStorage(root), order)
        top = own.write(_put(own, [r for r in rows if r[1] != first]))
        value = [v for _, k, v in rows if k == first][-1]
        made = {"range": table.column("range")[0].as_py(), "key": first, "value": value, "keys": top.keys, "values": top.values, "children": top.children, "height": own.height(top)}
        return pa.Table.from_pylist([made], _SCHEMA)

    tops = ranges.groupBy("range").applyInArrow(grow, _TOP).collect()  # one row a range
    top = None
    for r in sorted(tops, key=lambda r: r.range):
        node = Node(tuple(r["keys"]), tuple(r["values"]), tuple(r["children"]))
        if top is None:
            top, high = Node(), 0
        top, high = tree.join(top, high, (r.key, r.value), node, r.height)
    return tree.write(top) if top is not None else Node()


_SCHEMA = pa.schema([("range", pa.int32()), ("key", pa.string()), ("value", pa.string()), ("keys", pa.list_(pa.string())), ("values", pa.list_(pa.string())), ("children", pa.list_(pa.string())), ("height", pa.int32())])


def scan_unwritten(ranges: DataFrame, order: int) -> DataFrame:
    """(part, at, key, value) of the ranges' trees in order, scanned before any node is written."""

    def grow(table: pa.Table) -> pa.Table:
        tree = Tree(None, order)
        found = list(tree.scan(_put(tree, _in_turn(table))))
        part = table.column("range")[0].as_py()
        return pa.table({"part": pa.array([part] * len(found), pa.int32()), "at": pa.array(range(1, len(found) + 1), pa.int64()), "key": pa.array([k for k, _ in found], pa.string()), "value": pa.array([v for _, v in found], pa.string())})

    return ranges.groupBy("range").applyInArrow(grow, _ROWS)


def _parts(tree: Tree, top: Node, many: int) -> tuple[list[tuple], list[tuple[Node, int]]]:
    """The tree in order as subtrees and entries, (path, depth, None, None) or (None, depth, key, value), of which at least `many` are
    subtrees if there are as many; and the nodes above with their depth."""
    items, above, depth = [(top, 0, None, None)], [], 0
    while any(isinstance(x[0], Node) for x in items) or 0 < sum(x[0] is not None for x in items) < many:
        out = []
        for ref, at, k, v in items:
            if ref is None:
                out.append((ref, at, k, v))
                continue
            node = tree._node(ref)
            above.append((node, depth))
            for i, entry in enumerate(zip(node.keys, node.values, strict=True)):
                if node.children:
                    out.append((node.children[i], depth + 1, None, None))
                out.append((None, depth, *entry))
            if node.children:
                out.append((node.children[-1], depth + 1, None, None))
        items, depth = out, depth + 1
    return items, above


def _many(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _subtrees(spark: SparkSession, items: list[tuple]) -> DataFrame:
    """(part, path) for each subtree, dealt over tasks."""
    rows = [(i, x[0]) for i, x in enumerate(items) if x[0] is not None]
    df = spark.createDataFrame(rows, "part int, path string")
    return df.repartition(max(1, min(len(rows), _many(spark))))


def scan(spark: SparkSession, tree: Tree, top: Node) -> DataFrame:
    """(part, at, key, value): the tree's entries in order of part and at."""
    items, _ = _parts(tree, top, _many(spark))
    root, order = str(tree.storage.root), tree.order

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(reading(root), order, cache=64)
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, at = own.scan(own.load(path).top), 0
                while some := list(islice(found, ROWS)):
                    yield pa.record_batch({"part": pa.array([part] * len(some), pa.int32()), "at": pa.array(range(at + 1, at + len(some) + 1), pa.int64()), "key": pa.array([k for k, _ in some], pa.string()), "value": pa.array([v for _, v in some], pa.string())})
                    at += len(some)

    between = spark.createDataFrame([(i, 1, k, v) for i, (ref, _, k, v) in enumerate(items) if ref is None and v is not None], _ROWS)
    return _subtrees(spark, items).mapInArrow(read, _ROWS).unionByName(between)


def positions(rows: DataFrame) -> DataFrame:
    """rows (part, at, ...) with their position among all. They are read twice, so they should be stored."""
    counts = rows.groupBy("part").agg(F.max("at").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    ahead = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return rows.join(F.broadcast(ahead), "part").withColumn("position", (F.col("at") + F.col("ahead")).cast("int")).drop("ahead")


def ask(tree: Tree, top: Node, targets: DataFrame, answer: Callable[[Tree, Node, str], tuple], schema: str) -> DataFrame:
    """answer(tree, top, target) for each target (one column); neighbours are asked one after another, so that a task reads each node about
    once."""
    root, order = str(tree.storage.root), tree.order

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(reading(root), order)
        for batch in batches:
            rows = [answer(own, top, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    names, (target,) = StructType.fromDDL(schema).names, targets.columns
    return targets.repartitionByRange(target).sortWithinPartitions(target).mapInArrow(look, schema)


def shape(spark: SparkSession, tree: Tree, top: Node) -> dict:
    """Of a written tree: its number of keys, whether they are in order, the least and most keys of a node below the top, and the heights
    of its leaves."""
    items, above = _parts(tree, top, _many(spark))
    root, order = str(tree.storage.root), tree.order

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(reading(root), order, cache=64)

        def walk(node: Node, depth: int) -> Iterator[tuple[int, int | None]]:
            yield len(node.keys), None if node.children else depth
            for c in node.children:
                yield from walk(own._node(c), depth + 1)

        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node = own.load(path).top
                sizes, n, first, last, ordered, least, most, heights = walk(node, 0), 0, None, None, True, order, 0, set()
                for size, height in sizes:
                    n, least, most = n + size, min(least, size), max(most, size)
                    heights |= {height} - {None}
                for k, _ in own.scan(node, removed=True):
                    first = k if first is None else first
                    ordered, last = ordered and (last is None or last < k), k
                yield pa.RecordBatch.from_pylist([{"part": part, "n": n, "first": first, "last": last, "ordered": ordered, "least": least, "most": most, "low": min(heights), "high": max(heights)}], found)

    found = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("ordered", pa.bool_()), ("least", pa.int32()), ("most", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
    told = {r.part: r for r in _subtrees(spark, items).mapInArrow(measure, "part int, n long, first string, last string, ordered boolean, least int, most int, low int, high int").collect()}  # one row a subtree
    ends = [x for i, (ref, _, k, _) in enumerate(items) for x in ((k, k) if ref is None else (told[i].first, told[i].last))]
    heights = {items[i][1] + h for i, r in told.items() for h in (r.low, r.high)} | {d for n, d in above if not n.children}
    sizes = [x for r in told.values() for x in (r.least, r.most)] + [len(n.keys) for n, d in above if d]
    ordered = all(r.ordered for r in told.values()) and all(a < b for a, b in zip(ends[1::2], ends[2::2], strict=False))
    return {"keys": sum(r.n for r in told.values()) + sum(len(n.keys) for n, _ in above), "sorted": ordered, "least": min(sizes, default=0), "most": max(sizes, default=0), "heights": heights}
