"""Native column types and Spark's, both ways. What a type's name can't hold (precision, length, a zone) is kept in properties."""

from __future__ import annotations

from pyspark.sql import types as T

from lakeloom.errors import InvalidArgument

# Native names of types that have one Spark twin.
_PLAIN = {
    "BOOLEAN": T.BooleanType, "INT2": T.ShortType, "INT4": T.IntegerType, "INT8": T.LongType, "FLOAT4": T.FloatType, "FLOAT8": T.DoubleType,
    "VARCHAR": T.StringType, "DATE": T.DateType, "TIMESTAMP6": T.TimestampNTZType, "TIMESTAMPTZ6": T.TimestampType, "BINARY": T.BinaryType,
}
# Native names that Spark stores in another type.
_STORED = {"TIMESTAMP3": T.TimestampNTZType, "TIMESTAMP9": T.TimestampNTZType, "TIMESTAMPTZ3": T.TimestampType, "TIMESTAMPTZ9": T.TimestampType, "TIME3": T.LongType, "TIME6": T.LongType, "TIME9": T.LongType, "TIMETZ3": T.StringType, "TIMETZ6": T.StringType, "TIMETZ9": T.StringType}
NAMES = (*_PLAIN, *_STORED, "DECIMAL", "CHAR", "FIXED", "STRUCT", "LIST", "MAP")


def to_spark(column: dict) -> T.StructField:
    """A native column {name, type, nullable, id, properties, fields} as a Spark field."""
    kind, prop, fields = column["type"], column.get("properties") or {}, column.get("fields") or []
    if kind in _PLAIN:
        out = _PLAIN[kind]()
    elif kind in _STORED:
        out = _STORED[kind]()
    elif kind == "DECIMAL":
        out = T.DecimalType(int(prop.get("precision", 38)), int(prop.get("scale", 10)))
    elif kind == "CHAR":
        out = T.CharType(int(prop.get("length", 1)))
    elif kind == "FIXED":
        out = T.BinaryType()
    elif kind == "STRUCT":
        out = T.StructType([to_spark(f) for f in fields])
    elif kind == "LIST":
        out = T.ArrayType(to_spark(fields[0]).dataType, fields[0].get("nullable", True))
    elif kind == "MAP":
        out = T.MapType(to_spark(fields[0]).dataType, to_spark(fields[1]).dataType, fields[1].get("nullable", True))
    else:
        raise InvalidArgument(f"no native type: {kind}")
    meta = {"native": kind} if kind in _STORED or kind == "FIXED" else {}
    if kind == "FIXED" and "length" in prop:
        meta["length"] = str(prop["length"])
    if "id" in column:
        meta["id"] = column["id"]
    return T.StructField(column["name"], out, column.get("nullable", True), meta)


def from_spark(field: T.StructField) -> dict:
    """A Spark field as a native column."""
    kind, meta = field.dataType, field.metadata or {}
    out: dict = {"name": field.name, "nullable": field.nullable}
    if "id" in meta:
        out["id"] = meta["id"]
    if "native" in meta:
        out["type"] = meta["native"]
        if "length" in meta:
            out["properties"] = {"length": meta["length"]}
    elif isinstance(kind, T.DecimalType):
        out |= {"type": "DECIMAL", "properties": {"precision": str(kind.precision), "scale": str(kind.scale)}}
    elif isinstance(kind, T.CharType):
        out |= {"type": "CHAR", "properties": {"length": str(kind.length)}}
    elif isinstance(kind, T.StructType):
        out |= {"type": "STRUCT", "fields": [from_spark(f) for f in kind.fields]}
    elif isinstance(kind, T.ArrayType):
        out |= {"type": "LIST", "fields": [from_spark(T.StructField("element", kind.elementType, kind.containsNull))]}
    elif isinstance(kind, T.MapType):
        out |= {"type": "MAP", "fields": [from_spark(T.StructField("key", kind.keyType, False)), from_spark(T.StructField("value", kind.valueType, kind.valueContainsNull))]}
    else:
        name = next((n for n, t in _PLAIN.items() if type(kind) is t), "VARCHAR" if isinstance(kind, T.VarcharType) else None)
        if name is None:
            raise InvalidArgument(f"no native type for {kind.simpleString()}")
        out["type"] = name
    return out


def with_ids(schema: T.StructType, first: int = 1) -> T.StructType:
    """schema whose top-level fields all have an id; new ones count on from the highest there is."""
    top = max([first - 1, *(f.metadata["id"] for f in schema if "id" in (f.metadata or {}))])
    out = []
    for f in schema:
        if "id" not in (f.metadata or {}):
            top += 1
            f = T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), "id": top})
        out.append(f)
    return T.StructType(out)
