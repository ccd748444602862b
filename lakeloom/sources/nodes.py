"""The `catalog_nodes` data source: entries of a catalog's tree as rows, read by descent. Filters on the key that Spark hands over (equality,
a prefix) narrow the descent, so a lookup reads one node a level. Options: path, the catalog's folder or URI, which executors must reach, and
version (the latest by default)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from lakeloom.functions import paths


class Nodes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_nodes"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> "NodesReader":
        return NodesReader(dict(self.options))


class Part(InputPartition):
    def __init__(self, ref: str, own: bool) -> None:
        self.ref, self.own = ref, own


class NodesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.version, self.prefix, self.key = options["path"], options.get("version"), "", None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("key",) and isinstance(f.value, str):
                self.key = f.value
            elif isinstance(f, StringStartsWith) and tuple(f.attribute) == ("key",):
                self.prefix = f.value
            yield f  # Spark filters again: a prefix narrows what is read, no more

    def _tree(self):
        from lakeloom.operators.tree import Tree
        from lakeloom.sources.storage import reading

        return Tree(reading(self.path))

    def partitions(self):
        tree = self._tree()
        version = self.version
        if version is None:
            at = int(tree.storage.read(paths.LATEST))
            while tree.storage.exists(paths.root(at + 1)):
                at += 1
            version = at
        root = paths.root(int(version))
        children = [c for c in tree.load(root).top.children if isinstance(c, str)]
        if self.key is not None or self.prefix or not children:
            return [Part(root, False)]
        return [Part(root, True), *(Part(c, False) for c in children)]  # a task for each subtree

    def read(self, partition):
        tree = self._tree()
        top = tree.load(partition.ref).top
        if self.key is not None:
            value = tree.get(top, self.key)
            if value is not None:
                yield (self.key, value)
        elif partition.own:
            yield from ((k, v) for k, v in zip(top.keys, top.values, strict=True) if v is not None)
        else:
            yield from tree.scan(top, self.prefix)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Nodes)
