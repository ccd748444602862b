"""Views: SQL text with a bound schema and the objects it reads, resolved to a DataFrame over one version of the catalog. Plans of other
engines are kept as bytes; of Substrait's, those that read one named table are resolved as well."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame

from lakeloom.errors import InvalidArgument, NotFound

_DEPTH = 64


def definition(version, query: str, default_namespace: str, properties: dict) -> dict:
    """A view's definition; the query must resolve now."""
    from lakeloom.plans import sql

    if not query.strip():
        raise InvalidArgument("a view needs a query")
    df = sql.select(version, query, default_namespace)
    return {"dialect": "spark", "query": query, "schema": df.schema.jsonValue(), "schema_binding": True, "references": sql.references(query, default_namespace), "default_namespace": default_namespace, "properties": {str(k): str(v) for k, v in properties.items()}}


def opaque(plan: bytes, references=(), properties: dict | None = None) -> dict:
    return {"dialect": "substrait", "query": base64.b64encode(plan).decode(), "schema": None, "schema_binding": False, "references": list(references), "default_namespace": None, "properties": dict(properties or {})}


# Field numbers of Substrait's messages (a relation's read; a read's base schema, filter, projection, named table; names).
_READ, _BASE, _FILTER, _BEST_FILTER, _PROJECTION, _NAMED, _NAMES = 1, 2, 3, 11, 4, 7, 1


def _message(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffers message by number; values are numbers or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    try:
        while at < len(data):
            tag = number()
            kind = tag & 7
            if kind == 0:
                value = number()
            elif kind in (1, 2, 5):
                size = number() if kind == 2 else 8 if kind == 1 else 4
                value, at = data[at : at + size], at + size
                if at > len(data) or len(value) < size:
                    raise InvalidArgument("a plan ends too early")
            else:
                raise InvalidArgument("no plan")
            out.setdefault(tag >> 3, []).append(value)
    except IndexError as e:
        raise InvalidArgument("a plan ends too early") from e
    return out


def named_read(plan: bytes) -> tuple[list[str], list[str]]:
    """The table's names and the columns of a relation that only reads a named table."""
    top = _message(plan)
    if set(top) != {_READ}:
        raise InvalidArgument("the plan is more than the reading of a table, and is only kept")
    read = _message(top[_READ][-1])
    if _NAMED not in read or {_FILTER, _BEST_FILTER, _PROJECTION} & set(read):
        raise InvalidArgument("the plan is more than the reading of a named table, and is only kept")
    text = lambda part: [x.decode() for x in _message(part).get(_NAMES, [])]
    return text(read[_NAMED][-1]), text(read[_BASE][-1]) if _BASE in read else []


def _substrait(version, found: dict) -> DataFrame:
    names, columns = named_read(base64.b64decode(found["query"]))
    df = version.relation(".".join(names))
    return df.select(*(f"`{c}`" for c in columns)) if columns else df


def resolve(version, namespace: str, name: str, above: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a view. A view that reads itself, through others or not, is an error."""
    from lakeloom.plans import sql

    me = f"{namespace}.{name}"
    if me in above or len(above) > _DEPTH:
        raise InvalidArgument(f"view {' -> '.join([*above, me])} reads itself")
    found = version.describe_view(namespace, name)
    if found["dialect"] == "substrait":
        return _substrait(version, found)
    if found["dialect"] != "spark":
        raise InvalidArgument(f"view {me} holds a plan in {found['dialect']}, which is only kept")
    try:
        df = sql.select(version, found["query"], found["default_namespace"], (*above, me))
    except NotFound as e:
        raise NotFound(f"view {me}: {e}") from e
    bound = [f["name"] for f in found["schema"]["fields"]]
    return df.toDF(*bound) if len(bound) == len(df.columns) else df
