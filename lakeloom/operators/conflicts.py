"""Which committed change stands against which pending one, for one object: never (no entry), resolvable by rebasing, or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE, RESOLVABLE, UNRESOLVABLE = "none", "resolvable", "unresolvable"

_NS_ALTER = ("NAMESPACE_ALTER", "NAMESPACE_ALTER_SET_PROPERTIES", "NAMESPACE_ALTER_UNSET_PROPERTIES")
_ALTER = ("TABLE_ALTER", "TABLE_ALTER_ADD_COLUMNS", "TABLE_ALTER_REMOVE_COLUMNS")
_ROWS = ("TABLE_INSERT", "TABLE_UPDATE", "TABLE_DELETE")

# The action types of the format, in its order.
ACTIONS = (
    "CATALOG_SHOW_NAMESPACES", "NAMESPACE_EXISTS", "NAMESPACE_DESCRIBE", "NAMESPACE_CREATE", *_NS_ALTER, "NAMESPACE_DROP", "NAMESPACE_SHOW_TABLES", "NAMESPACE_SHOW_VIEWS",
    "TABLE_EXISTS", "TABLE_DESCRIBE", "TABLE_CREATE", *_ALTER, "TABLE_SELECT", *_ROWS, "TABLE_DROP", "VIEW_EXISTS", "VIEW_DESCRIBE", "VIEW_CREATE", "VIEW_REPLACE", "VIEW_DROP",
)

# Committed type, verdict, pending types.
_BASE = (
    ("NAMESPACE_CREATE", UNRESOLVABLE, ("NAMESPACE_CREATE",)),
    ("NAMESPACE_ALTER", UNRESOLVABLE, ("NAMESPACE_ALTER",)),
    ("NAMESPACE_ALTER_SET_PROPERTIES", UNRESOLVABLE, _NS_ALTER),
    ("NAMESPACE_ALTER_UNSET_PROPERTIES", UNRESOLVABLE, _NS_ALTER),
    ("TABLE_CREATE", UNRESOLVABLE, ("TABLE_CREATE",)),
    *((c, UNRESOLVABLE, _ALTER) for c in _ALTER),
    ("TABLE_INSERT", RESOLVABLE, (*_ROWS, *_ALTER)),
    ("TABLE_UPDATE", UNRESOLVABLE, (*_ROWS, *_ALTER)),
    ("TABLE_DELETE", RESOLVABLE, ("TABLE_INSERT", *_ALTER)),
    ("TABLE_DROP", UNRESOLVABLE, (*_ALTER, *_ROWS)),
    ("VIEW_DROP", UNRESOLVABLE, ("VIEW_REPLACE",)),
)
#: What the base matrix leaves open and this engine closes: changes that would otherwise be lost without a word.
_STRICT = (
    ("NAMESPACE_ALTER", UNRESOLVABLE, _NS_ALTER),
    ("NAMESPACE_DROP", UNRESOLVABLE, (*_NS_ALTER, "NAMESPACE_DROP")),
    ("NAMESPACE_ALTER_SET_PROPERTIES", UNRESOLVABLE, ("NAMESPACE_DROP",)),
    ("NAMESPACE_ALTER_UNSET_PROPERTIES", UNRESOLVABLE, ("NAMESPACE_DROP",)),
    ("NAMESPACE_ALTER", UNRESOLVABLE, ("NAMESPACE_DROP",)),
    *((c, RESOLVABLE, _ROWS) for c in _ALTER),
    *((c, UNRESOLVABLE, ("TABLE_DROP",)) for c in (*_ALTER, *_ROWS, "TABLE_DROP")),
    ("TABLE_DELETE", UNRESOLVABLE, ("TABLE_UPDATE", "TABLE_DELETE")),
    ("VIEW_CREATE", UNRESOLVABLE, ("VIEW_CREATE",)),
    ("VIEW_REPLACE", UNRESOLVABLE, ("VIEW_REPLACE", "VIEW_DROP")),
    ("VIEW_DROP", UNRESOLVABLE, ("VIEW_DROP",)),
)


def matrix(strict: bool = False) -> dict[tuple[str, str], str]:
    return {(c, p): v for c, v, pending in (*_BASE, *(_STRICT if strict else ())) for p in pending}


_LOOSE, _FULL = matrix(), matrix(strict=True)


def verdict(committed: str, pending: str, strict: bool = True) -> str:
    return (_FULL if strict else _LOOSE).get((committed, pending), NONE)


def matrix_frame(spark: SparkSession, strict: bool = False) -> DataFrame:
    """All pairs of types with their verdict."""
    held = matrix(strict)
    return spark.createDataFrame([(c, p, held.get((c, p), NONE)) for c in ACTIONS for p in ACTIONS], "committed_type string, pending_type string, verdict string")


def analyse(committed: DataFrame, pending: DataFrame, strict: bool = True) -> DataFrame:
    """Conflicts between two logs of (object_key, type): equal keys, then the matrix, which is a few hundred rows."""
    verdicts = matrix_frame(committed.sparkSession, strict).where(F.col("verdict") != NONE)
    both = committed.select("object_key", F.col("type").alias("committed_type")).distinct().join(pending.select("object_key", F.col("type").alias("pending_type")).distinct(), "object_key")
    return both.join(F.broadcast(verdicts), ["committed_type", "pending_type"]).select("object_key", "committed_type", "pending_type", "verdict")
