"""Tables: data files that snapshots list explicitly.

A definition holds schema, layout and the newest snapshots; older ones lie in log files that it points to. A snapshot names one list,
a small Arrow file of manifests with the range of each column over the manifest's files; a manifest is an Arrow file of data files
with row counts, partition values and ranges. An append adds one manifest, and FAN manifests of about one size are merged to one of the
next, so that list, definition and the bytes of a commit stay small however often a table is appended to. Reads are built from
the listed files of one snapshot and never from a folder, so a DataFrame keeps showing the version it was made from. Every change is a
small operation on the definition that can be replayed on a newer one.

Columns are known by ids. A column's name in data files is fixed when it is added, so renaming it touches no file, and a new
column that takes the name of a dropped one has another name in files."""

from __future__ import annotations

import copy
import json
import os
import re
import time
import uuid
from collections.abc import Callable
from contextlib import ExitStack, contextmanager
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from lakeloom.errors import CommitConflict, InvalidArgument, NotFound
from lakeloom.functions import types
from lakeloom.plans import pruning
from lakeloom.sources.storage import LocalStorage, Storage

MANIFEST = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()), ("partition", pa.string()), ("low", pa.string()), ("high", pa.string())])
LIST = pa.schema([("manifest", pa.string()), ("files", pa.int64()), ("rows", pa.int64()), ("low", pa.string()), ("high", pa.string())])
#: Manifests of about one size that are merged, snapshots that a definition holds at most, and files whose footers the driver reads itself.
FAN, INLINE, FOOTERS = 16, 32, 64
FORMATS = ("PARQUET", "ORC")
#: Settings of a write: 96-bit times have no usable statistics, and only adaptive execution deals a large partition over several tasks.
WRITING = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true"}


# ---- layout


_TRANSFORM = re.compile(r"(?:(?P<f>years?|months?|days?|hours?|bucket|truncate)\s*\(\s*(?:(?P<n>\d+)\s*,\s*)?`?(?P<c1>\w+)`?\s*(?:,\s*(?P<n2>\d+)\s*)?\)|`?(?P<c>\w+)`?)", re.I)


def transform(spec: str) -> tuple[str, int | None, str]:
    """A partition field as (transform, number, column)."""
    m = _TRANSFORM.fullmatch(spec.strip())
    if not m:
        raise InvalidArgument(f"no partition transform: {spec}")
    if m["c"]:
        return "identity", None, m["c"]
    kind, number = m["f"].lower().rstrip("s"), m["n"] or m["n2"]
    if (kind in ("bucket", "truncate")) != (number is not None) or number == "0":
        raise InvalidArgument(f"no partition transform: {spec}")
    return kind, int(number) if number else None, m["c1"]


def partition_column(spec: str) -> Column:
    """The value of a partition field."""
    kind, n, name = transform(spec)
    c = F.col(f"`{name}`")
    if kind == "identity":
        return c
    if kind == "bucket":
        return F.when(c.isNotNull(), F.pmod(F.hash(c), F.lit(n)))
    if kind == "truncate":  # of text its first code points, of numbers the multiple of n below
        return F.when(F.typeof(c) == "string", F.substring(c.cast("string"), 1, n)).otherwise((c.cast("decimal(38,0)") - F.pmod(c.cast("decimal(38,0)"), F.lit(n))).cast("string"))
    return F.date_format(c, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}[kind])


def definition(schema: StructType, partition_by=(), sort_by=(), properties: dict | None = None, fmt: str | None = None) -> dict:
    schema = types.with_ids(schema)
    _check_layout(schema, partition_by, sort_by)
    fmt = (fmt or (properties or {}).get("write.format.default") or "PARQUET").upper()
    if fmt not in FORMATS:
        raise InvalidArgument(f"no file format {fmt}")
    return {"format": fmt, "uuid": str(uuid.uuid4()), "schema": schema.jsonValue(), "partition_by": list(partition_by), "sort_by": list(sort_by), "properties": dict(properties or {}), "names": {}, "snapshots": [], "log": None, "current": None}


def _check_layout(schema: StructType, partition_by, sort_by) -> None:
    for c in (*(transform(p)[2] for p in partition_by), *sort_by):
        if c not in schema.fieldNames():
            raise InvalidArgument(f"no column {c}")


def schema_of(table: dict) -> StructType:
    return StructType.fromJson(table["schema"])


def stored_names(table: dict) -> dict[str, str]:
    """Of each column, its name in data files."""
    return {f.name: table["names"].get(str(f.metadata["id"]), f.name) for f in schema_of(table)}


# ---- snapshots


def _write(storage: Storage, kind: str, rows: list[dict], schema: pa.Schema) -> str:
    path = f"meta/{kind}-{uuid.uuid4()}.arrow"
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, schema) as out:
        out.write_table(pa.Table.from_pylist(rows, schema))
    storage.create(path, sink.getvalue().to_pybytes())
    return path


def _read(storage: Storage, path: str) -> list[dict]:
    with pa.ipc.open_file(pa.BufferReader(storage.read(path))) as f:
        return f.read_all().to_pylist()


def write_manifest(storage: Storage, rows: list[dict]) -> str:
    return _write(storage, "m", rows, MANIFEST)


read_manifest = _read


def snapshots(storage: Storage, table: dict) -> list[dict]:
    """All snapshots, oldest first."""
    out, log = list(table["snapshots"]), table["log"]
    while log:
        chunk = json.loads(storage.read(log))
        out, log = chunk["snapshots"] + out, chunk["log"]
    return out


def logs(storage: Storage, table: dict) -> list[str]:
    """Paths of the files that hold older snapshots."""
    out, log = [], table["log"]
    while log:
        out.append(log)
        log = json.loads(storage.read(log))["log"]
    return out


def snapshot_of(storage: Storage, table: dict, snapshot: int | None = None) -> dict | None:
    want = table["current"] if snapshot is None else snapshot
    held, log = table["snapshots"], table["log"]
    while True:
        if (found := next((s for s in held if s["id"] == want), None)) is not None:
            return found
        if want is None or not log:
            return None
        chunk = json.loads(storage.read(log))
        held, log = chunk["snapshots"], chunk["log"]


def manifests(storage: Storage, snapshot: dict | None) -> list[dict]:
    """The manifests of a snapshot, with the ranges of their files."""
    return _read(storage, snapshot["list"]) if snapshot and snapshot["list"] else []


def _entry(path: str, rows: list[dict]) -> dict:
    low, high = ranges(rows)
    return {"manifest": path, "files": len(rows), "rows": sum(r["rows"] for r in rows), "low": json.dumps(low), "high": json.dumps(high)}


def ranges(rows: list[dict]) -> tuple[dict, dict]:
    """The least and greatest value of each column over files, where all of them tell."""
    low, high = [json.loads(r["low"]) for r in rows], [json.loads(r["high"]) for r in rows]
    known = [c for c in (low[0] if low else {}) if all(x.get(c) is not None and y.get(c) is not None for x, y in zip(low, high, strict=True))]
    return {c: min(x[c] for x in low) for c in known}, {c: max(y[c] for y in high) for c in known}


def _merged(storage: Storage, held: list[dict]) -> list[dict]:
    """The list with manifests of about one size merged as soon as there are FAN of them."""
    while True:
        sizes: dict[int, list[dict]] = {}
        for e in held:
            level = 0
            while FAN ** (level + 1) <= e["files"]:
                level += 1
            sizes.setdefault(level, []).append(e)
        many = next((es for es in sizes.values() if len(es) >= FAN), None)
        if many is None:
            return held
        rows = [r for e in many for r in read_manifest(storage, e["manifest"])]
        gone = {e["manifest"] for e in many}
        held = [e for e in held if e["manifest"] not in gone] + [_entry(write_manifest(storage, rows), rows)]


def _next(storage: Storage, table: dict, operation: str, held: list[dict], summary: dict) -> None:
    number = max([0, *(s["id"] for s in table["snapshots"])]) + 1
    path = _write(storage, "l", _merged(storage, held), LIST) if held else None
    table["snapshots"].append({"id": number, "parent": table["current"], "at": int(time.time() * 1000), "operation": operation, "list": path, "summary": summary})
    table["current"] = number
    if len(table["snapshots"]) > INLINE:
        place = f"meta/s-{uuid.uuid4()}.json"
        storage.create(place, json.dumps({"snapshots": table["snapshots"][:-1], "log": table["log"]}).encode())
        table["snapshots"], table["log"] = table["snapshots"][-1:], place


# ---- operations on definitions


#: Types to which a column's type can be widened without touching its files.
_WIDER = {"tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp_ntz",)}


def _widens(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale == old.scale and new.precision >= old.precision
    return new.simpleString() in _WIDER.get(old.simpleString(), ())


def apply(storage: Storage, table: dict, op: dict) -> dict:
    """The definition after an operation; CommitConflict if it no longer fits."""
    table = copy.deepcopy(table)
    kind, schema = op["op"], schema_of(table)
    if kind in ("append", "replace"):
        held = manifests(storage, snapshot_of(storage, table))
        gone = set(op.get("removed", ()))
        kept = []
        # the manifests that held the files when they were read come first; after a merge the others are looked through as well
        for e in sorted(held, key=lambda e: e["manifest"] not in op.get("within", ())) if gone else ():
            rows = read_manifest(storage, e["manifest"]) if gone else []
            left = [r for r in rows if r["path"] not in gone]
            gone -= {r["path"] for r in rows}
            if len(left) == len(rows):
                kept.append(e)
            elif left:
                kept.append(_entry(write_manifest(storage, left), left))
        if gone:
            raise CommitConflict("files that this change replaces are no longer part of the table")
        if op.get("removed"):
            held = kept
        added = [_entry(m, read_manifest(storage, m)) for m in op["manifests"]]
        _next(storage, table, op.get("operation", "append"), held + added, op["summary"])
    elif kind == "add_columns":
        new = StructType.fromJson(op["columns"])
        for f in new:
            if f.name in schema.fieldNames():
                raise InvalidArgument(f"column {f.name} exists")
            if not f.nullable:
                raise InvalidArgument(f"new column {f.name} must be nullable")
        highest = max([0, *(f.metadata["id"] for f in schema), *table.get("ids", [])])
        taken = {*stored_names(table).values(), *table.get("dropped", [])}
        fields = [*schema]
        for f in new:
            highest += 1
            fields.append(StructField(f.name, f.dataType, f.nullable, {**{k: v for k, v in (f.metadata or {}).items() if k != "id"}, "id": highest}))
            if f.name in taken:
                table["names"][str(highest)] = f"{f.name}__{highest}"
        table["schema"] = StructType(fields).jsonValue()
    elif kind == "drop_columns":
        used = {transform(p)[2] for p in table["partition_by"]}
        for c in op["columns"]:
            if c not in schema.fieldNames() or c in used:
                raise InvalidArgument(f"can't drop column {c}")
        table["ids"] = sorted({*table.get("ids", []), *(f.metadata["id"] for f in schema)})
        table["dropped"] = table.get("dropped", []) + [stored_names(table)[c] for c in op["columns"]]
        table["schema"] = StructType([f for f in schema if f.name not in op["columns"]]).jsonValue()
        table["sort_by"] = [c for c in table["sort_by"] if c not in op["columns"]]
    elif kind == "rename_column":
        old, new = op["column"], op["to"]
        if old not in schema.fieldNames() or new in schema.fieldNames():
            raise InvalidArgument(f"can't rename column {old} to {new}")
        table["names"] |= {str(schema[old].metadata["id"]): stored_names(table)[old]}
        table["schema"] = StructType([StructField(new, f.dataType, f.nullable, f.metadata) if f.name == old else f for f in schema]).jsonValue()
        table["sort_by"] = [new if c == old else c for c in table["sort_by"]]
        table["partition_by"] = [re.sub(rf"\b{re.escape(old)}\b(?=`?\s*(?:\)|,|$))", new, p) if transform(p)[2] == old else p for p in table["partition_by"]]
    elif kind == "widen_column":
        new = StructType.fromDDL(f"c {op['type']}")[0].dataType
        if op["column"] not in schema.fieldNames() or not (schema[op["column"]].dataType == new or _widens(schema[op["column"]].dataType, new)):
            raise InvalidArgument(f"can't change column {op['column']} to {op['type']}")
        table["schema"] = StructType([StructField(f.name, new, f.nullable, f.metadata) if f.name == op["column"] else f for f in schema]).jsonValue()
    elif kind == "properties":
        table["properties"] = {k: v for k, v in {**table["properties"], **op["set"]}.items() if k not in op["unset"]}
    elif kind == "layout":
        _check_layout(schema, op["partition_by"], op["sort_by"])
        table["partition_by"], table["sort_by"] = op["partition_by"], op["sort_by"]
    else:
        raise InvalidArgument(f"no operation {kind}")
    return table


# ---- files


def files(storage: Storage, table: dict, snapshot: int | None = None, condition: str | Column | None = None) -> list[dict]:
    """Data files of a snapshot that a condition can match, each with the manifest that lists it."""
    found = snapshot_of(storage, table, snapshot)
    if found is None:
        if snapshot is not None:
            raise NotFound(f"no snapshot {snapshot}")
        return []
    schema, stored = schema_of(table), stored_names(table)
    wanted = pruning.comparisons(SparkSession.getActiveSession(), schema, condition) if condition is not None else []
    wanted = [(stored[c], op, x) for c, op, x in wanted]
    kinds = {stored[f.name]: f.dataType for f in schema}
    out = []
    for e in manifests(storage, found):
        if wanted and not pruning.may_match(json.loads(e["low"]), json.loads(e["high"]), wanted, kinds):
            continue  # the list knows enough not to read the manifest
        for f in read_manifest(storage, e["manifest"]):
            if not wanted or pruning.may_match(json.loads(f["low"]), json.loads(f["high"]), wanted, kinds):
                out.append({**f, "manifest": e["manifest"]})
    return out


def _bounds(stats: list) -> tuple:
    """The least and greatest value that all row groups tell, or nulls."""
    try:
        if stats and all(s is not None and s.has_min_max for s in stats):
            return pruning.plain(min(s.min for s in stats)), pruning.plain(max(s.max for s in stats))
    except pa.ArrowNotImplementedError:
        pass  # statistics of a type that Arrow doesn't read, such as 96-bit times
    return None, None


def _footer(path: str, names: list[str]) -> dict:
    meta = pq.read_metadata(path)
    low: dict = {}
    high: dict = {}
    for i in range(meta.num_columns):
        name = meta.row_group(0).column(i).path_in_schema if meta.num_row_groups else None
        if name in names:
            low[name], high[name] = _bounds([meta.row_group(g).column(i).statistics for g in range(meta.num_row_groups)])
    return {"path": path, "rows": meta.num_rows, "bytes": os.path.getsize(path), "partition": "{}", "low": json.dumps(low), "high": json.dumps(high)}


def describe_files(spark: SparkSession, storage: Storage, urls: list[str], schema: StructType, fmt: str = "PARQUET") -> list[dict]:
    """Manifest rows of data files (schema: with their names in files): from their footers where they are local Parquet files, many of
    them on executors, else by one distributed pass."""
    simple = [f.name for f in schema if f.dataType.typeName() not in ("struct", "array", "map", "binary", "boolean", "variant")]
    if isinstance(storage, LocalStorage) and fmt == "PARQUET" and all(u.startswith(("file:", "/")) for u in urls):
        local = {u.removeprefix("file://"): u for u in urls}
        if len(urls) <= FOOTERS:
            return [{**_footer(p, simple), "path": u} for p, u in local.items()]

        def read(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pylist([_footer(p, simple) for p in batch.column(0).to_pylist()], MANIFEST)

        places = spark.createDataFrame([(p,) for p in local], "path string").repartition(-(-len(local) // FOOTERS))
        found = places.mapInArrow(read, "path string, rows long, bytes long, partition string, low string, high string").collect()  # one row a file
        return [{**r.asDict(), "path": local[r.path]} for r in found]
    zoned = {f.name for f in schema if f.dataType.typeName() == "timestamp"}
    told = lambda c: F.unix_micros(F.col(f"`{c}`")) if c in zoned else F.col(f"`{c}`")
    stats = [F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"), *(x for i, c in enumerate(simple) for x in (F.min(told(c)).alias(f"l{i}"), F.max(told(c)).alias(f"h{i}")))]
    rows = spark.read.schema(schema).format(fmt.lower()).load(urls).groupBy(F.input_file_name().alias("path")).agg(*stats).collect()  # one row a file
    value = lambda c, x: pruning.plain(pruning.micros(x) if c in zoned and x is not None else x)
    out = []
    for r in rows:
        low = {c: value(c, r[f"l{i}"]) for i, c in enumerate(simple)}
        high = {c: value(c, r[f"h{i}"]) for i, c in enumerate(simple)}
        out.append({"path": unquote(r["path"]), "rows": r["rows"], "bytes": r["bytes"], "partition": "{}", "low": json.dumps(low), "high": json.dumps(high)})
    return out


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _partition_values(path: str, by: list[str], low: dict, stored: dict[str, str]) -> str:
    """Partition values of a file, as its folders tell; numbers as numbers."""
    told = dict(x.split("=", 1) for x in path.split("/") if re.match(r"_p\d+=", x))
    out = {}
    for i, spec in enumerate(by):
        kind, _, c = transform(spec)
        text = unquote(told.get(f"_p{i}", "__HIVE_DEFAULT_PARTITION__"))
        value = None if text == "__HIVE_DEFAULT_PARTITION__" else int(text) if kind == "bucket" else text
        out[spec] = low.get(stored[c], value) if kind == "identity" and value is not None and low.get(stored[c]) is not None else value
    return json.dumps(out)


def write_files(storage: Storage, table: dict, place: str, df: DataFrame) -> dict:
    """Writes rows as new data files of the table, dealt by partition values and sorted as it says. Gives manifests and a summary."""
    schema, stored = schema_of(table), stored_names(table)
    missing = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if missing or extra:
        raise InvalidArgument(f"columns don't fit: missing {missing}, unknown {extra}")
    rows = df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    by, sort = table["partition_by"], table["sort_by"]
    # values stay in the files; folders only keep partitions in files of their own
    rows = rows.withColumns({f"_p{i}": partition_column(spec) for i, spec in enumerate(by)})
    parts = [f"_p{i}" for i in range(len(by))]
    if by:  # rebalanced: small partitions share a task, a large one is dealt over several, each with a file of its own
        rows = rows.hint("rebalance", *parts).sortWithinPartitions(*parts, *sort)
    elif sort:
        rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    folder = f"data/{place}/{uuid.uuid4().hex}"
    out = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in stored.items()), *parts)
    writer = out.write.partitionBy(*parts) if by else out.write
    with ExitStack() as held:
        for k, v in WRITING.items():
            held.enter_context(_setting(df.sparkSession, k, v))
        writer.format(table["format"].lower()).save(storage.url(folder))
    urls = [storage.url(p) for p in storage.list(folder) if re.search(r"\.(parquet|orc)$", p)]
    physical = StructType([StructField(stored[f.name], f.dataType) for f in schema])
    every = describe_files(df.sparkSession, storage, urls, physical, table["format"]) if urls else []
    found = [{**f, "partition": _partition_values(f["path"], by, json.loads(f["low"]), stored)} for f in every if f["rows"]]
    storage.delete(u.removeprefix(storage.url("")) for u in (f["path"] for f in every if not f["rows"]))
    summary = {"files": len(found), "rows": sum(f["rows"] for f in found)}
    return {"manifests": [write_manifest(storage, found)] if found else [], "summary": summary}


# ---- reading and changing rows


def _load(spark: SparkSession, table: dict, paths: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of data files, with the table's names."""
    schema, stored = schema_of(table), stored_names(table)
    if not paths:
        return spark.createDataFrame([], schema)
    physical = StructType([StructField(stored[f.name], f.dataType, f.nullable, f.metadata) for f in schema])
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault("orc" if p.endswith(".orc") else "parquet", []).append(p)
    out = None
    for fmt, listed in kinds.items():
        df = spark.read.schema(physical).format(fmt).load(listed)
        part = df.select(*(F.col(f"`{n}`").alias(c, metadata=schema[c].metadata) if c != n else F.col(f"`{n}`") for c, n in stored.items()), *keep) if keep or any(c != n for c, n in stored.items()) else df
        out = part if out is None else out.unionByName(part)
    return out


def scan(spark: SparkSession, storage: Storage, table: dict, columns=None, condition: str | Column | None = None, snapshot: int | None = None) -> DataFrame:
    """Rows of a snapshot. Files that the condition rules out aren't listed; what is left goes to the reader as a filter."""
    df = _load(spark, table, [f["path"] for f in files(storage, table, snapshot, condition)])
    if condition is not None:
        df = df.where(condition)
    return df.select(*columns) if columns else df


def append(spark: SparkSession, storage: Storage, table: dict, place: str, df: DataFrame) -> dict:
    return {"op": "append", **write_files(storage, table, place, df)}


def _rewrite(spark, storage, table, place, operation: str, condition: str, change: Callable[[DataFrame], DataFrame]) -> dict | None:
    touched = files(storage, table, condition=condition)
    if touched:  # of the files that may match, those that do
        found = _load(spark, table, [f["path"] for f in touched], (F.input_file_name().alias("_ll_file"),))
        names = {unquote(r[0]).split("/")[-1] for r in found.where(condition).select("_ll_file").distinct().collect()}  # no more than files
        touched = [f for f in touched if f["path"].split("/")[-1] in names]
    if not touched:
        return None
    removed = [f["path"] for f in touched]
    return {"op": "replace", "operation": operation, "removed": removed, "within": sorted({f["manifest"] for f in touched}), **write_files(storage, table, place, change(_load(spark, table, removed)))}


def update(spark: SparkSession, storage: Storage, table: dict, place: str, values: dict[str, str], condition: str = "true") -> dict | None:
    """Copies on write the files that hold matching rows. Rows where the condition is null stay as they are."""
    schema = schema_of(table)
    for c in values:
        if c not in schema.fieldNames():
            raise InvalidArgument(f"no column {c}")

    def change(df: DataFrame) -> DataFrame:
        hit = F.coalesce(F.expr(condition), F.lit(False))
        return df.select(*(F.when(hit, F.expr(values[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in values else F.col(f"`{f.name}`") for f in schema))

    return _rewrite(spark, storage, table, place, "overwrite", condition, change)


def delete(spark: SparkSession, storage: Storage, table: dict, place: str, condition: str = "true") -> dict | None:
    """Removes matching rows. Rows where the condition is null stay."""
    return _rewrite(spark, storage, table, place, "delete", condition, lambda df: df.where(~F.coalesce(F.expr(condition), F.lit(False))))


def overwrite(spark: SparkSession, storage: Storage, table: dict, place: str, df: DataFrame, condition: str = "true") -> dict:
    """Replaces matching rows by those of df; without a condition, all rows."""
    new = write_files(storage, table, place, df)
    if condition == "true":
        every = files(storage, table)
        return {"op": "replace", "operation": "overwrite", "removed": [f["path"] for f in every], "within": sorted({f["manifest"] for f in every}), **new}
    kept = delete(spark, storage, table, place, condition) or {"removed": [], "within": [], "manifests": []}
    return {"op": "replace", "operation": "overwrite", "removed": kept["removed"], "within": kept["within"], **new, "manifests": kept["manifests"] + new["manifests"]}


# ---- metadata tables

METADATA_TABLES = ("history", "snapshots", "metadata_log_entries", "refs", "manifests", "all_manifests", "files", "data_files", "delete_files", "position_deletes", "all_files", "all_data_files", "all_delete_files", "entries", "all_entries", "partitions")
_FILES = "path string, record_count long, file_size_in_bytes long, partition string, lower_bounds string, upper_bounds string"
_ENTRIES = f"status int, snapshot_id long, {_FILES}"


def metadata(spark: SparkSession, storage: Storage, table: dict, name: str) -> DataFrame:
    """A metadata table. Changed files are rewritten, so there are no delete files, and those tables are empty."""
    now = snapshot_of(storage, table)
    if name not in METADATA_TABLES:
        raise InvalidArgument(f"no metadata table {name}")
    if name == "history":
        every = snapshots(storage, table)
        parents, chain, at = {s["id"]: s["parent"] for s in every}, set(), table["current"]
        while at is not None:
            chain.add(at)
            at = parents[at]
        return spark.createDataFrame([(s["id"], s["parent"], s["at"], s["id"] in chain) for s in every], "snapshot_id long, parent_id long, made_current_at long, is_current_ancestor boolean")
    if name == "snapshots":
        rows = [(s["id"], s["parent"], s["at"], s["operation"], s["list"], {k: str(v) for k, v in s["summary"].items()}) for s in snapshots(storage, table)]
        return spark.createDataFrame(rows, "snapshot_id long, parent_id long, committed_at long, operation string, manifest_list string, summary map<string,string>")
    if name == "metadata_log_entries":
        return spark.createDataFrame([(s["at"], s["list"], s["id"]) for s in snapshots(storage, table)], "timestamp long, file string, latest_snapshot_id long")
    if name == "refs":  # a table's versions are those of its catalog: one line of snapshots
        return spark.createDataFrame([("main", "BRANCH", now["id"])] if now else [], "name string, type string, snapshot_id long")
    every = snapshots(storage, table) if name.startswith("all_") else [now] if now else []
    if name.endswith("manifests"):
        rows = [(s["id"], e["manifest"], e["files"], e["rows"], e["low"], e["high"]) for s in every for e in manifests(storage, s)]
        return spark.createDataFrame(rows, "reference_snapshot_id long, path string, added_files long, added_rows long, lower_bounds string, upper_bounds string")
    if "delete" in name:
        return spark.createDataFrame([], _FILES)
    seen: dict[str, tuple] = {}
    read: dict[str, list[dict]] = {}
    for s in every:  # a file belongs to the first snapshot that lists it
        for e in manifests(storage, s):
            if e["manifest"] not in read:
                read[e["manifest"]] = read_manifest(storage, e["manifest"])
            for f in read[e["manifest"]]:
                seen.setdefault(f["path"], (1 if name.startswith("all_") or s["parent"] is None else 0, s["id"], f["path"], f["rows"], f["bytes"], f["partition"], f["low"], f["high"]))
    if name.endswith("entries"):
        return spark.createDataFrame(list(seen.values()), _ENTRIES)
    found = spark.createDataFrame([r[2:] for r in seen.values()], _FILES)
    if name == "partitions":
        return found.groupBy("partition").agg(F.sum("record_count").alias("record_count"), F.count("*").alias("file_count"))
    return found
