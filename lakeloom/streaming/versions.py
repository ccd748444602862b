"""A feed of catalog versions: a streaming source that gives each new version once, with the actions that made it."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lakeloom.functions import paths


class Versions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_versions"

    def schema(self) -> str:
        return "version long, created_at_millis long, type string, object_key string"

    def simpleStreamReader(self, schema) -> "VersionsReader":  # noqa: N802
        return VersionsReader(dict(self.options))


class VersionsReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.first = options["path"], int(options.get("fromVersion", 0))

    def initialOffset(self):  # noqa: N802
        return {"version": self.first}

    def _tree(self):
        from lakeloom.operators.tree import Tree
        from lakeloom.sources.storage import reading

        return Tree(reading(self.path))

    def read(self, start):
        tree, at = self._tree(), start["version"]
        end = at
        while tree.storage.exists(paths.root(end)):
            end += 1
        return self._rows(tree, at, end), {"version": end}

    def readBetweenOffsets(self, start, end):  # noqa: N802
        return self._rows(self._tree(), start["version"], end["version"])

    @staticmethod
    def _rows(tree, start: int, end: int):
        out = []
        for v in range(start, end):
            root = tree.load(paths.root(v))
            made = int(root.system["created_at_millis"])
            out += [(v, made, a["type"], a["object_key"]) for a in map(json.loads, root.actions)] or [(v, made, None, None)]
        return iter(out)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Versions)
