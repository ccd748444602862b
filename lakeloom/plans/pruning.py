"""Which files of a table a condition can match, from the least and greatest value of each column in each file.

Spark itself analyses the condition over the table's schema, coerces types and folds literals (dates, zones, escapes); what is left as a
comparison of a bare column with a literal of its type, joined by AND, is compared with the files' statistics in Catalyst's own values.
Whatever else a condition says is left to Spark, which applies the whole of it anyway: when in doubt, a file is read."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql.types import DataType, StructType

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_OPERATORS = {"EqualTo": "=", "EqualNullSafe": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Types whose statistics are compared.
KINDS = (*_NUMBERS, "string", "date", "timestamp", "timestamp_ntz")


def comparisons(spark: SparkSession, schema: StructType, condition: str | Column | None) -> list[tuple[str, str, object]]:
    """(column, operator, value or values) of the comparisons that must all hold."""
    if condition is None or (isinstance(condition, str) and condition.strip().lower() == "true"):
        return []
    plan = spark.createDataFrame(spark.sparkContext.emptyRDD(), schema).where(condition)._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() == "Project":
        plan = plan.child()
    if plan.getClass().getSimpleName() != "Filter":
        return []
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    out: list = []
    todo = [plan.condition()]
    while todo:
        e = todo.pop()
        name = e.getClass().getSimpleName()
        if name == "And":
            todo += [e.left(), e.right()]
        elif name in _OPERATORS:
            op = _OPERATORS[name]
            for column, literal, sign in ((e.left(), e.right(), op), (e.right(), e.left(), _TURNED[op])):
                if (found := _pair(column, literal, kinds)) is not None:
                    out.append((found[0], sign, found[1]))
        elif name == "In":
            items = e.list()
            pairs = [_pair(e.value(), items.apply(i), kinds) for i in range(items.size())]
            if pairs and all(p is not None for p in pairs):
                out.append((pairs[0][0], "in", [p[1] for p in pairs]))
    return out


def _pair(column, literal, kinds: dict[str, str]):
    """(name, value) of a bare column and a literal of its type that isn't null, else None."""
    if column.getClass().getSimpleName() != "AttributeReference" or literal.getClass().getSimpleName() != "Literal":
        return None
    kind = kinds.get(column.name())
    if kind not in KINDS or literal.dataType().catalogString() != kind or (value := literal.value()) is None:
        return None
    if kind == "string":
        return column.name(), value.toString()
    return column.name(), value


def plain(value):
    """A statistic as JSON holds it."""
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (bool, int, float, str)) and value == value:
        return value
    return None


def micros(value: int) -> datetime:
    """The time that Catalyst means by microseconds."""
    return _EPOCH + timedelta(microseconds=value)


def _internal(value, kind: str):
    """A statistic as Catalyst compares it; None if that can't be told."""
    try:
        if kind in ("timestamp", "timestamp_ntz"):
            at = datetime.fromisoformat(value)
            since = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - _EPOCH
            return (since.days * 86400 + since.seconds) * 1_000_000 + since.microseconds
        if kind == "date":
            return (date.fromisoformat(value) - date(1970, 1, 1)).days
    except (TypeError, ValueError):
        return None
    if isinstance(value, bool) or isinstance(value, str) != (kind == "string"):
        return None
    return value


def may_match(low: dict, high: dict, wanted: list[tuple[str, str, object]], kinds: dict[str, DataType]) -> bool:
    """Whether a file with these statistics can hold a matching row."""
    for column, op, value in wanted:
        kind = kinds[column].simpleString()
        lo, hi = _internal(low.get(column), kind), _internal(high.get(column), kind)
        if lo is None or hi is None:
            continue
        for x in value if op == "in" else [value]:
            if not ((op in ("=", "in") and not lo <= x <= hi) or (op == "<" and not lo < x) or (op == "<=" and not lo <= x) or (op == ">" and not hi > x) or (op == ">=" and not hi >= x)):
                break
        else:
            return False
    return True
