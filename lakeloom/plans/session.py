"""Catalog statements through a session's own sql(): what names the catalog, and BEGIN, COMMIT and ROLLBACK, goes to the catalog, all else to Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import sql as front

_TRANSACTION = re.compile(r"\s*(?:begin|commit|rollback)(?:\s+transaction)?\s*;?\s*", re.I)


def attach(spark: SparkSession, catalog, name: str = "lake") -> None:
    """From now on spark.sql() of this session object knows the catalog as `name`: its objects are name.ns.table."""
    detach(spark)
    plain, prefix = spark.sql, re.compile(rf"(?<![\w`.])`?{re.escape(name)}`?\s*\.\s*(?=[`\w])", re.I)

    def sql(statement: str, *args, **kwargs) -> DataFrame:
        masked = re.sub(front._SKIP, lambda m: "'" * len(m[0]), statement, flags=re.S)
        found = list(prefix.finditer(masked))
        if not found and not _TRANSACTION.fullmatch(masked):
            return plain(statement, *args, **kwargs)
        if args or kwargs:
            raise front.InvalidArgument("statements on the catalog take no parameters")
        out, last = [], 0
        for m in found:  # text in quotes stays as it is
            out.append(statement[last : m.start()])
            last = m.end()
        detached = "".join([*out, statement[last:]])
        detach(spark)  # the catalog's own use of the session
        try:
            return catalog.sql(detached)
        finally:
            spark.sql = sql

    spark.sql = sql


def detach(spark: SparkSession) -> None:
    spark.__dict__.pop("sql", None)
