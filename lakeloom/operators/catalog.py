"""The catalog: versions of all objects, transactions over them, and the operations on namespaces, tables and views.

A version is a root file; creating the file of the next version is the commit. A transaction works on the root it began with and keeps
its changes as a list of operations. If another commit took the next version, the newer root's actions are checked against this
transaction's, and if nothing stands against them the operations are replayed on the newer root."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lakeloom import errors
from lakeloom.errors import AlreadyExists, InvalidArgument, NotEmpty, NotFound
from lakeloom.functions import paths, types
from lakeloom.functions.keys import Keys
from lakeloom.operators import conflicts, table, views
from lakeloom.operators.tree import Node, Root, Tree, to_arrow
from lakeloom.sources.storage import Storage, copy_files, open_storage

SNAPSHOT, SERIALIZABLE = "SNAPSHOT", "SERIALIZABLE"
RESTRICT, CASCADE = "RESTRICT", "CASCADE"
SYSTEM, DISTRIBUTED, DISTRIBUTED_PREFIX = "sys", "dtxns", "dtxn_"
ATTEMPTS = 20

# What a catalog definition holds, and its defaults.
DEFAULTS = {"major_version": 0, "order": 128, "namespace_name_max_size_bytes": 100, "table_name_max_size_bytes": 100, "view_name_max_size_bytes": 100, "node_file_max_size_bytes": 1048576, "txn_isolation_level": SNAPSHOT, "txn_ttl_millis": 259200000}


def catalog_definition(**values) -> dict:
    """A catalog's definition; numbers may come as text."""
    out: dict = {"id": str(uuid.uuid4()), **DEFAULTS, "properties": {}, "exported_snapshots": {}}
    for k, v in values.items():
        key = k.replace("-", "_")
        if key in DEFAULTS:
            out[key] = int(v) if isinstance(DEFAULTS[key], int) else str(v).upper()
        elif key in ("id", "properties", "exported_snapshots"):
            out[key] = v
        else:
            out["properties"][k] = str(v)
    if out["txn_isolation_level"] not in (SNAPSHOT, SERIALIZABLE):
        raise InvalidArgument(f"no isolation level {out['txn_isolation_level']}")
    return out


class Version:
    """One version of the catalog, for reading."""

    def __init__(self, catalog: "Catalog", number: int, root: Root) -> None:
        self.catalog, self.number, self.root = catalog, number, root

    @property
    def created_at(self) -> int:
        return int(self.root.system["created_at_millis"])

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    # hooks that a transaction replaces
    def _saw(self, action: str, *names: str, kind: str | None = None, detail: dict | None = None) -> None:
        pass

    def _lookup(self, key: str) -> dict | None:
        path = self.catalog.tree.get(self.root.top, key)
        return None if path is None else self.catalog._definition(path)

    def _keys(self, prefix: str) -> Iterator[str]:
        return (k for k, _ in self.catalog.tree.scan(self.root.top, prefix))

    # namespaces

    def show_namespaces(self) -> list[str]:
        self._saw("CATALOG_SHOW_NAMESPACES")
        k = self.catalog.keys
        return [k.names(x)[0] for x in self._keys(k.prefix("namespace"))]

    def namespace_exists(self, namespace: str) -> bool:
        self._saw("NAMESPACE_EXISTS", namespace)
        return self._lookup(self.catalog.keys.key("namespace", namespace)) is not None

    def describe_namespace(self, namespace: str) -> dict[str, str]:
        self._saw("NAMESPACE_DESCRIBE", namespace)
        return self._need("namespace", namespace)["properties"]

    def _need(self, kind: str, *names: str) -> dict:
        found = self._lookup(self.catalog.keys.key(kind, *names))
        if found is None:
            raise NotFound(f"{kind} {'.'.join(names)} does not exist")
        return found

    def _show(self, kind: str, namespace: str) -> list[str]:
        k = self.catalog.keys
        return [k.names(x)[1] for x in self._keys(k.prefix(kind, namespace))]

    # tables and views

    def show_tables(self, namespace: str) -> list[str]:
        self._saw("NAMESPACE_SHOW_TABLES", namespace)
        return self._show("table", namespace)

    def table_exists(self, namespace: str, name: str) -> bool:
        self._saw("TABLE_EXISTS", namespace, name)
        return self._lookup(self.catalog.keys.key("table", namespace, name)) is not None

    def describe_table(self, namespace: str, name: str) -> dict:
        self._saw("TABLE_DESCRIBE", namespace, name)
        return self._need("table", namespace, name)

    def show_views(self, namespace: str) -> list[str]:
        self._saw("NAMESPACE_SHOW_VIEWS", namespace)
        return self._show("view", namespace)

    def view_exists(self, namespace: str, name: str) -> bool:
        self._saw("VIEW_EXISTS", namespace, name)
        return self._lookup(self.catalog.keys.key("view", namespace, name)) is not None

    def describe_view(self, namespace: str, name: str) -> dict:
        self._saw("VIEW_DESCRIBE", namespace, name)
        return self._need("view", namespace, name)

    # rows

    def table(self, name: str, columns=None, where=None, snapshot: int | None = None) -> DataFrame:
        """Rows of `ns.t` as of this version, or one of its metadata tables, `ns.t.files`."""
        parts = name.split(".")
        found = self._need("table", *parts[:2])
        if len(parts) == 3:
            return table.metadata(self.spark, self.catalog.storage, found, parts[2].lower())
        self._saw("TABLE_SELECT", *parts, detail={"columns": [str(c) for c in columns or []], "filter": str(where) if where is not None else None})
        return table.scan(self.spark, self.catalog.storage, found, columns, where, snapshot)

    def view(self, name: str) -> DataFrame:
        """The rows of a view, over the tables of this version."""
        return views.resolve(self, *name.split("."))

    def relation(self, name: str) -> DataFrame:
        """A table, a metadata table or a view by name."""
        parts = name.split(".")
        if len(parts) == 2 and self._lookup(self.catalog.keys.key("table", *parts)) is None and self._lookup(self.catalog.keys.key("view", *parts)) is not None:
            return self.view(name)
        return self.table(name)

    # inspection

    def objects(self) -> DataFrame:
        """(object_type, namespace, name, key, definition) of every object."""
        k = self.catalog.keys
        rows = []
        for key, path in self._entries():
            names = k.names(key)
            rows.append((k.kind(key), names[0], names[1] if len(names) > 1 else None, key, path))
        return self.spark.createDataFrame(rows, "object_type string, namespace string, name string, key string, definition string")

    def _entries(self) -> Iterator[tuple[str, str | None]]:
        return self.catalog.tree.scan(self.root.top)

    def actions(self) -> DataFrame:
        """The actions whose commit made this version."""
        return self.catalog.actions_frame([json.loads(a) for a in self.root.actions])


class Transaction(Version):
    """Changes to be committed together. Not for several threads at once."""

    def __init__(self, catalog: "Catalog", number: int, root: Root, txn_id: str | None = None, isolation: str | None = None, ttl_millis: int | None = None) -> None:
        super().__init__(catalog, number, root)
        self.id = txn_id or str(uuid.uuid4())
        self.isolation = (isolation or catalog.definition["txn_isolation_level"]).upper()
        if self.isolation not in (SNAPSHOT, SERIALIZABLE):
            raise InvalidArgument(f"no isolation level {self.isolation}")
        self.began = int(time.time() * 1000)
        longest = catalog.definition["txn_ttl_millis"]
        if ttl_millis is not None and int(ttl_millis) > longest:
            raise InvalidArgument(f"a transaction lives {longest} ms at most here: older files of none are garbage")
        self.expires = self.began + int(ttl_millis if ttl_millis is not None else longest)
        self.log: list[dict] = []
        self.operations: list[dict] = []
        self.changes: dict[str, dict | None] = {}
        self.closed = False

    def _saw(self, action: str, *names: str, kind: str | None = None, detail: dict | None = None) -> None:
        if self.closed:
            raise errors.TransactionClosed(self.id)
        kind = kind or action.split("_")[0].lower()
        key = None
        if names:
            key = self.catalog.keys.key(kind, *names) if kind != "namespace" else self.catalog.keys.key("namespace", names[0])
        self.log.append({"object_type": kind, "namespace": names[0] if names else None, "name": names[1] if len(names) > 1 else None, "object_key": key, "type": action, "detail": detail})

    def _lookup(self, key: str) -> dict | None:
        return self.changes[key] if key in self.changes else super()._lookup(key)

    def _keys(self, prefix: str) -> Iterator[str]:
        mine = {k for k in self.changes if k.startswith(prefix)}
        yield from sorted({k for k in super()._keys(prefix) if k not in mine} | {k for k in mine if self.changes[k] is not None})

    def _entries(self):
        base = {k: v for k, v in super()._entries() if k not in self.changes}
        return iter(sorted({**base, **{k: None for k, v in self.changes.items() if v is not None}}.items()))

    def _do(self, action: str, op: str, kind: str, names: tuple[str, ...], payload: dict | None = None, detail: dict | None = None) -> None:
        """Takes an operation on, applied to what this transaction sees."""
        if self.closed:
            raise errors.TransactionClosed(self.id)
        step = {"op": op, "kind": kind, "names": list(names), "payload": payload}
        self._apply(step)
        self.operations.append(step)
        self._saw(action, *names, kind=kind, detail=detail)

    def _apply(self, step: dict) -> None:
        key = self.catalog.keys.key(step["kind"], *step["names"])
        now, what = self._lookup(key), f"{step['kind']} {'.'.join(step['names'])}"
        if step["op"] == "create":
            if now is not None:
                raise AlreadyExists(f"{what} exists")
            if step["kind"] != "namespace":
                self._need("namespace", step["names"][0])
            self.changes[key] = step["payload"]
            return
        if now is None:
            raise NotFound(f"{what} does not exist")
        if step["op"] == "put":
            if "replaces" in (step["payload"] or {}) and step["payload"]["replaces"] != now["current"]:
                raise errors.CommitConflict(f"{what} has new rows")
            self.changes[key] = step["payload"]
        elif step["op"] == "drop":
            self.changes[key] = None
        elif step["op"] == "properties":
            kept = {**now["properties"], **step["payload"]["set"]}
            self.changes[key] = {**now, "properties": {k: v for k, v in kept.items() if k not in step["payload"]["unset"]}}
        else:
            self.changes[key] = table.apply(self.catalog.storage, now, step["payload"])

    # namespaces

    def create_namespace(self, namespace: str, properties: dict | None = None) -> None:
        self._do("NAMESPACE_CREATE", "create", "namespace", (namespace,), {"properties": dict(properties or {})})

    def alter_namespace(self, namespace: str, properties: dict | None = None, set: dict | None = None, unset=()) -> None:  # noqa: A002
        """Replaces all properties, or sets and removes single ones."""
        if properties is not None:
            return self._do("NAMESPACE_ALTER", "put", "namespace", (namespace,), {"properties": dict(properties)})
        action = "NAMESPACE_ALTER_UNSET_PROPERTIES" if unset and not set else "NAMESPACE_ALTER_SET_PROPERTIES" if set and not unset else "NAMESPACE_ALTER"
        return self._do(action, "properties", "namespace", (namespace,), {"set": dict(set or {}), "unset": list(unset)})

    def drop_namespace(self, namespace: str, behavior: str = RESTRICT) -> None:
        """RESTRICT: only an empty one. CASCADE: its tables and views go first."""
        self._need("namespace", namespace)
        held = [("table", n) for n in self._show("table", namespace)] + [("view", n) for n in self._show("view", namespace)]
        if held and behavior.upper() == RESTRICT:
            raise NotEmpty(f"namespace {namespace} holds {len(held)} objects")
        for kind, name in held:
            self._do(f"{kind.upper()}_DROP", "drop", kind, (namespace, name))
        self._do("NAMESPACE_DROP", "drop", "namespace", (namespace,))

    # tables

    def create_table(self, namespace: str, name: str, schema: StructType | str, partition_by=(), sort_by=(), properties: dict | None = None) -> None:
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        prefix = self.catalog.options
        defaults = {k.removeprefix("table-default."): v for k, v in prefix.items() if k.startswith("table-default.")}
        forced = {k.removeprefix("table-override."): v for k, v in prefix.items() if k.startswith("table-override.")}
        self._do("TABLE_CREATE", "create", "table", (namespace, name), table.definition(schema, partition_by, sort_by, {**defaults, **(properties or {}), **forced}))

    def replace_table(self, namespace: str, name: str, schema: StructType | str, partition_by=(), sort_by=(), properties: dict | None = None, create: bool = False) -> None:
        """A table of that name with a new schema and no rows; its identity and properties are kept, and earlier versions of the
        catalog still have its rows. With create, one that isn't there is made."""
        now = self._lookup(self.catalog.keys.key("table", namespace, name))
        if now is None and create:
            return self.create_table(namespace, name, schema, partition_by, sort_by, properties)
        self._need("table", namespace, name)
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        new = table.definition(schema, partition_by, sort_by, {**now["properties"], **(properties or {})})
        return self._do("TABLE_UPDATE", "put", "table", (namespace, name), {**new, "uuid": now["uuid"], "replaces": now["current"]}, {"replaced": True})

    def register_table(self, namespace: str, name: str, *files: str, partition_by=()) -> None:
        """A table over Parquet files or folders that lie where they lie."""
        df = self.spark.read.parquet(*files)
        found = table.definition(df.schema, partition_by)
        rows = table.describe_files(self.spark, self.catalog.storage, sorted(unquote(f) for f in df.inputFiles()), df.schema)
        manifest = table.write_manifest(self.catalog.storage, rows)
        op = {"op": "append", "manifests": [manifest], "summary": {"files": len(rows), "rows": sum(r["rows"] for r in rows)}}
        self._do("TABLE_CREATE", "create", "table", (namespace, name), table.apply(self.catalog.storage, found, op))

    def alter_table(self, namespace: str, name: str, set: dict | None = None, unset=(), partition_by=None, sort_by=None) -> None:  # noqa: A002
        now = self._need("table", namespace, name)
        if partition_by is not None or sort_by is not None:
            op = {"op": "layout", "partition_by": list(now["partition_by"] if partition_by is None else partition_by), "sort_by": list(now["sort_by"] if sort_by is None else sort_by)}
            self._do("TABLE_ALTER", "table", "table", (namespace, name), op)
        if set or unset:
            self._do("TABLE_ALTER", "table", "table", (namespace, name), {"op": "properties", "set": dict(set or {}), "unset": list(unset)})

    def add_columns(self, namespace: str, name: str, columns: StructType | str) -> None:
        new = StructType.fromDDL(columns) if isinstance(columns, str) else columns
        self._do("TABLE_ALTER_ADD_COLUMNS", "table", "table", (namespace, name), {"op": "add_columns", "columns": new.jsonValue()}, {"columns": new.fieldNames()})

    def drop_columns(self, namespace: str, name: str, *columns: str) -> None:
        self._do("TABLE_ALTER_REMOVE_COLUMNS", "table", "table", (namespace, name), {"op": "drop_columns", "columns": list(columns)}, {"columns": list(columns)})

    def rename_column(self, namespace: str, name: str, column: str, to: str) -> None:
        """No file is touched: columns are known by ids."""
        self._do("TABLE_ALTER", "table", "table", (namespace, name), {"op": "rename_column", "column": column, "to": to}, {"renamed": [column, to]})

    def widen_column(self, namespace: str, name: str, column: str, kind: str) -> None:
        """A wider type for a column, which files of the narrower one are read as."""
        self._do("TABLE_ALTER", "table", "table", (namespace, name), {"op": "widen_column", "column": column, "type": kind}, {"widened": [column, kind]})

    def drop_table(self, namespace: str, name: str) -> None:
        """The files stay, for earlier versions."""
        self._do("TABLE_DROP", "drop", "table", (namespace, name))

    def rename_table(self, namespace: str, name: str, new: str, kind: str = "table") -> None:
        held = self._need(kind, namespace, name)
        self._do(f"{kind.upper()}_CREATE", "create", kind, (namespace, new), held)
        self._do(f"{kind.upper()}_DROP", "drop", kind, (namespace, name))

    def _rows(self, action: str, name: str, made) -> None:
        ns, t = name.split(".")
        op = made(self.spark, self.catalog.storage, self._need("table", ns, t), f"{ns}/{t}")
        if op is not None:
            detail = {"manifests": op["manifests"], "removed": op.get("removed", []), "summary": op["summary"], "selects": [a["detail"] for a in self.log if a["type"] == "TABLE_SELECT"]}
            self._do(action, "table", "table", (ns, t), op, detail)

    def append(self, name: str, df: DataFrame) -> None:
        self._rows("TABLE_INSERT", name, lambda *at: table.append(*at, df))

    def overwrite(self, name: str, df: DataFrame, where: str = "true") -> None:
        self._rows("TABLE_UPDATE", name, lambda *at: table.overwrite(*at, df, where))

    def update(self, name: str, values: dict[str, str], where: str = "true") -> None:
        self._rows("TABLE_UPDATE", name, lambda *at: table.update(*at, values, where))

    def delete(self, name: str, where: str = "true") -> None:
        self._rows("TABLE_DELETE", name, lambda *at: table.delete(*at, where))

    # views

    def create_view(self, namespace: str, name: str, query: str, default_namespace: str | None = None, properties: dict | None = None, replace: bool = False) -> None:
        prefix = {k.removeprefix("view-default."): v for k, v in self.catalog.options.items() if k.startswith("view-default.")}
        exists = self._lookup(self.catalog.keys.key("view", namespace, name))
        kept = exists["properties"] if exists and replace else {}
        made = views.definition(self, query, default_namespace or namespace, {**prefix, **kept, **(properties or {})})
        if exists and replace:
            self.replace_view(namespace, name, made)
        else:
            self._do("VIEW_CREATE", "create", "view", (namespace, name), made)

    def create_opaque_view(self, namespace: str, name: str, plan: bytes, references=(), properties: dict | None = None) -> None:
        """A view whose plan another engine reads; it is kept as it is."""
        self._do("VIEW_CREATE", "create", "view", (namespace, name), views.opaque(plan, references, properties or {}))

    def replace_view(self, namespace: str, name: str, definition: dict | str) -> None:
        if isinstance(definition, str):
            now = self._need("view", namespace, name)
            definition = views.definition(self, definition, now["default_namespace"], now["properties"])
        self._do("VIEW_REPLACE", "put", "view", (namespace, name), definition)

    def drop_view(self, namespace: str, name: str) -> None:
        self._do("VIEW_DROP", "drop", "view", (namespace, name))

    # end

    def commit(self) -> Version:
        return self.catalog._commit(self)

    def rollback(self) -> None:
        self.closed = True

    def save(self) -> str:
        """Puts the transaction into the store, where another session can go on with it."""
        return self.catalog.save_distributed(self)


class Catalog:
    """A catalog in one store. Reading methods see the active transaction, else the latest version; changing methods work in the active
    transaction or commit at once."""

    def __init__(self, spark: SparkSession, storage: Storage, **options: str) -> None:
        self.spark, self.storage, self.options = spark, storage, options
        self.active: Transaction | None = None
        self._defs: dict[str, dict] = {}
        self.tree = Tree(storage)
        self.definition, self.keys = catalog_definition(), Keys()
        if self.exists():
            self._open()

    @property
    def system(self) -> str:
        """The name of the namespace in which the catalog itself is addressed."""
        return self.options.get("system.ns-name") or SYSTEM

    @property
    def distributed_parent(self) -> str:
        """The name, in the system namespace, of what holds saved transactions."""
        return self.options.get("dtxn.parent-ns-name") or DISTRIBUTED

    @property
    def distributed_prefix(self) -> str:
        """What stands before a saved transaction's id in its namespace's name."""
        return self.options.get("dtxn.prefix") or self.options.get("dtxn.ns-prefix") or DISTRIBUTED_PREFIX

    # ---- life of the catalog

    def exists(self) -> bool:
        return self.storage.exists(paths.root(0))

    def _open(self) -> None:
        self._use(self._definition(self.tree.load(self._root_path(self._latest())).system["catalog_def"]))

    def _use(self, definition: dict) -> None:
        self.definition = definition
        self.keys = Keys(*(definition[f"{k}_name_max_size_bytes"] for k in ("namespace", "table", "view")))
        self.tree.order = definition["order"]

    def create(self, **values) -> Version:
        if self.exists():
            raise AlreadyExists("the catalog exists")
        definition = catalog_definition(**values)
        self._use(definition)
        root = Root({"catalog_def": self._write_definition("catalog", definition), "created_at_millis": str(int(time.time() * 1000))})
        try:
            self._seal(0, root)
        except errors.SealFailure as e:
            raise AlreadyExists("the catalog exists") from e
        return Version(self, 0, root)

    # ---- files

    def _root_path(self, version: int) -> str:
        return paths.root(version)

    def _definition(self, path: str) -> dict:
        if path not in self._defs:
            self._defs[path] = json.loads(self.storage.read(path))
        return self._defs[path]

    def _write_definition(self, kind: str, value: dict, *names: str) -> str:
        path = paths.definition(kind, *names)
        self.storage.create(path, json.dumps(value).encode())
        return path

    def _seal(self, version: int, root: Root) -> Root:
        root = Root(root.system, root.actions, self.tree.write(root.top))
        self.storage.create(paths.root(version), to_arrow(root.top, root))
        try:
            self.storage.overwrite(paths.LATEST, str(version).encode())
        except OSError:
            pass  # only a hint
        return root

    # ---- versions

    def _latest(self) -> int:
        """The newest version: from the hint upward until one is missing."""
        try:
            at = int(self.storage.read(paths.LATEST))
        except (errors.ReadFailure, ValueError):
            at = self._oldest()
        while self.storage.exists(paths.root(at + 1)):
            at += 1
        return at

    def _oldest(self) -> int:
        try:
            return int(self.storage.read(paths.OLDEST))
        except (errors.ReadFailure, ValueError):
            return 0

    def latest(self) -> Version:
        if not self.exists() and not self._oldest():
            raise NotFound("the catalog does not exist")
        return self._version(self._latest())

    def _version(self, number: int) -> Version:
        return Version(self, number, self.tree.load(paths.root(number)))

    def at(self, version: int | None = None, timestamp_millis: int | None = None) -> Version:
        """A version by number, or the newest that is not after a time."""
        newest, oldest = self._latest(), self._oldest()
        if version is not None:
            if not oldest <= version <= newest:
                raise NotFound(f"no version {version}")
            return self._version(version)
        lo, hi = oldest, newest
        if self._version(lo).created_at > timestamp_millis:
            raise NotFound("no version is that old")
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self._version(mid).created_at <= timestamp_millis else (lo, mid - 1)
        return self._version(lo)

    def history(self) -> Iterator[Version]:
        """Versions from the newest back."""
        at = self._latest()
        while True:
            found = self._version(at)
            yield found
            before = found.root.system.get("previous_root")
            if before is None or not self.storage.exists(before):
                return
            at = paths.version_of(before)

    def versions(self) -> DataFrame:
        rows = [(v.number, paths.root(v.number), v.root.system.get("previous_root"), v.root.system.get("rollback_from_root"), v.created_at, len(v.root.actions)) for v in self.history()]
        return self.spark.createDataFrame(rows, "version long, path string, previous_root string, rollback_from_root string, created_at_millis long, n_actions long")

    def actions_frame(self, actions: list[dict]) -> DataFrame:
        rows = [(a["object_type"], a["namespace"], a["name"], a["object_key"], a["type"], json.dumps(a["detail"]) if a["detail"] else None) for a in actions]
        return self.spark.createDataFrame(rows, "object_type string, namespace string, name string, object_key string, type string, detail string")

    # ---- transactions

    def begin(self, **properties) -> Transaction:
        """A transaction on the latest version. Properties: id, isolation-level, ttl-millis."""
        known = {k.replace("-", "_"): v for k, v in properties.items()}
        now = self.latest()
        return Transaction(self, now.number, now.root, known.get("id"), known.get("isolation_level"), known.get("ttl_millis"))

    @contextmanager
    def transaction(self, **properties):
        """Commits at the end, rolls back if an error leaves it."""
        txn = self.begin(**properties)
        try:
            yield txn
        except BaseException:
            txn.rollback()
            raise
        txn.commit()

    def _commit(self, txn: Transaction) -> Version:
        if txn.closed:
            raise errors.TransactionClosed(txn.id)
        if not txn.operations:
            raise errors.NothingToCommit(txn.id)
        if time.time() * 1000 > txn.expires:
            raise errors.Expired(f"transaction {txn.id} outlived its time")
        written = [m for step in txn.operations for m in (step["payload"] or {}).get("manifests", ())]
        written += [x["snapshots"][-1]["list"] for x in txn.changes.values() if x and x.get("snapshots")]
        for m in written:
            if m and not self.storage.exists(m):
                raise errors.CommitConflict(f"{m}, which this transaction wrote, is gone")
        number, root = txn.number, txn.root
        for _ in range(ATTEMPTS):
            top = root.top
            for key, value in sorted(txn.changes.items()):
                kind = self.keys.kind(key)
                top = self.tree.put(top, key, None if value is None else self._write_definition(kind, value, *self.keys.names(key)))
            stamp = max(int(time.time() * 1000), int(root.system["created_at_millis"]))
            system = {"catalog_def": root.system["catalog_def"], "previous_root": paths.root(number), "created_at_millis": str(stamp)}
            try:
                sealed = self._seal(number + 1, Root(system, tuple(json.dumps(a) for a in txn.log), top))
                txn.closed = True
                return Version(self, number + 1, sealed)
            except errors.SealFailure:
                number += 1
                root = self.tree.load(paths.root(number))
                self._rebase(txn, number, root)
        raise errors.AttemptsExhausted(f"{ATTEMPTS} commits came first")

    def _rebase(self, txn: Transaction, number: int, root: Root) -> None:
        """Replays a transaction on a newer root unless that root's actions stand against it."""
        committed = [json.loads(a) for a in root.actions]
        if root.system.get("rollback_from_root"):
            raise errors.CommitConflict("the catalog was rolled back meanwhile")
        pending: dict[str, set[str]] = {}
        for a in txn.log:
            if a["object_key"]:
                pending.setdefault(a["object_key"], set()).add(a["type"])
        reads = {a["object_key"] for a in txn.log if a["type"] == "TABLE_SELECT"}
        dropped = {a["object_key"] for a in committed if a["type"] == "NAMESPACE_DROP"}
        for a in committed:
            for p in pending.get(a["object_key"] or "", ()):
                if conflicts.verdict(a["type"], p) == conflicts.UNRESOLVABLE:
                    raise errors.CommitConflict(f"{a['type']} of {a['object_key'].strip()} was committed; this transaction has {p}")
            if txn.isolation == SERIALIZABLE and a["type"] in ("TABLE_INSERT", "TABLE_UPDATE", "TABLE_DELETE") and a["object_key"] in reads:
                raise errors.CommitConflict(f"{a['object_key'].strip()} was read and has changed")
        made = {a["namespace"] for a in txn.log if a["type"] in ("TABLE_CREATE", "VIEW_CREATE")}
        if any(self.keys.key("namespace", ns) in dropped for ns in made):
            raise errors.CommitConflict("a namespace of new objects was dropped")
        filled = {a["namespace"] for a in committed if a["type"] in ("TABLE_CREATE", "VIEW_CREATE")}
        if filled & {a["namespace"] for a in txn.log if a["type"] == "NAMESPACE_DROP"}:
            raise errors.CommitConflict("objects were created in a namespace that this transaction drops")
        txn.number, txn.root, txn.changes = number, root, {}
        for step in txn.operations:
            try:
                txn._apply(step)
            except (AlreadyExists, NotFound) as e:
                raise errors.CommitConflict(str(e)) from e

    def rollback_to(self, version: int) -> Version:
        """A new version with the content of an earlier one."""
        target = self.at(version=version)
        for _ in range(ATTEMPTS):
            now = self.latest()
            stamp = max(int(time.time() * 1000), now.created_at)
            system = {"catalog_def": target.root.system["catalog_def"], "previous_root": paths.root(now.number), "rollback_from_root": paths.root(now.number), "created_at_millis": str(stamp)}
            try:
                return Version(self, now.number + 1, self._seal(now.number + 1, Root(system, (), target.root.top)))
            except errors.SealFailure:
                continue
        raise errors.AttemptsExhausted("rollback")

    # ---- distributed transactions

    def save_distributed(self, txn: Transaction) -> str:
        path = paths.distributed(txn.id)
        state = {"id": txn.id, "base": txn.number, "began": txn.began, "expires": txn.expires, "isolation": txn.isolation, "log": txn.log, "operations": txn.operations}
        self.storage.overwrite(path, json.dumps(state).encode())
        return path

    def load_distributed(self, txn_id: str) -> Transaction:
        if not self.distributed_exists(txn_id):
            raise NotFound(f"no transaction {txn_id}")
        state = json.loads(self.storage.read(paths.distributed(txn_id)))
        base = self._version(state["base"])
        txn = Transaction(self, base.number, base.root, state["id"], state["isolation"])
        txn.began, txn.expires = state["began"], state["expires"]
        for step in state["operations"]:
            txn._apply(step)
        txn.operations, txn.log = state["operations"], state["log"]
        return txn

    def distributed_exists(self, txn_id: str) -> bool:
        return self.storage.exists(paths.distributed(txn_id))

    def show_distributed(self) -> list[str]:
        return [p.rsplit("/", 1)[1].removesuffix(".binpb") for p in self.storage.list("def/dtxn")]

    def drop_distributed(self, txn_id: str) -> None:
        self.storage.delete([paths.distributed(txn_id)])

    # ---- snapshots and expiry

    def reachable(self, versions: list[Version], data: bool = True) -> set[str]:
        """Store paths that these versions need, their lists, manifests and logs among them; with data, data files in this store as well."""
        out: set[str] = set()
        base, store = str(self.storage.root).rstrip("/") + "/", self.storage
        for v in versions:
            out |= {paths.root(v.number), v.root.system["catalog_def"], *self.tree.reachable(v.root.top)}
            for key, path in self.tree.scan(v.root.top):
                if path in out:
                    continue
                out.add(path)
                if self.keys.kind(key) == "table":
                    found = self._definition(path)
                    out |= {*table.logs(store, found)}
                    for snapshot in table.snapshots(store, found):
                        if snapshot["list"] is None or snapshot["list"] in out:
                            continue
                        out.add(snapshot["list"])
                        for m in table.manifests(store, snapshot):
                            if m["manifest"] not in out:
                                out.add(m["manifest"])
                                if data:
                                    out |= {f["path"].removeprefix(base) for f in table.read_manifest(store, m["manifest"]) if f["path"].startswith(base)}
        return out

    def export(self, name: str, target: str, minimal: bool = False, only: list[str] | None = None) -> str:
        """Copies the latest version, as version 0 of a catalog at target: all that it reaches, or (minimal) its metadata only, with data read
        from here, or (only: names of tables and namespaces) all data of these and the metadata of the rest. Executors copy data
        files; the driver copies small ones. The export is noted in this catalog."""
        now, other = self.latest(), open_storage(target)
        mine = self.reachable([now], data=False) - {paths.root(now.number)}
        base, new = str(self.storage.root).rstrip("/"), str(other.root).rstrip("/")
        moved: set[str] = set()
        for key, path in self.tree.scan(now.root.top):
            names = self.keys.names(key)
            if self.keys.kind(key) == "table" and not minimal and (only is None or names[0] in only or ".".join(names) in only):
                found = self._definition(path)
                listed = {m["manifest"] for s in table.snapshots(self.storage, found) for m in table.manifests(self.storage, s)}
                moved |= {f["path"] for m in listed for f in table.read_manifest(self.storage, m) if f["path"].startswith(base + "/")}
        manifests = {p for p in mine if p.startswith("meta/m-")}
        self.storage.copy_to(other, sorted(mine - manifests))
        for m in sorted(manifests):  # data files that move along change their places
            rows = [{**r, "path": new + r["path"].removeprefix(base) if r["path"] in moved else r["path"]} for r in table.read_manifest(self.storage, m)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, table.MANIFEST) as out:
                out.write_table(pa.Table.from_pylist(rows, table.MANIFEST))
            other.create(m, sink.getvalue().to_pybytes())
        copy_files(self.spark, self.storage, other, sorted(p.removeprefix(base + "/") for p in moved))
        system = {k: v for k, v in now.root.system.items() if k in ("catalog_def", "created_at_millis")}
        other.create(paths.root(0), to_arrow(now.root.top, Root(system, (), now.root.top)))
        other.overwrite(paths.LATEST, b"0")
        exported = {**self.definition, "exported_snapshots": {**self.definition["exported_snapshots"], name: str(other.root)}}
        self._replace_definition(exported)
        return str(other.root)

    def _replace_definition(self, definition: dict) -> None:
        path = self._write_definition("catalog", definition)
        for _ in range(ATTEMPTS):
            now = self.latest()
            system = {"catalog_def": path, "previous_root": paths.root(now.number), "created_at_millis": str(max(int(time.time() * 1000), now.created_at))}
            try:
                self._seal(now.number + 1, Root(system, (), now.root.top))
                self._use(definition)
                return
            except errors.SealFailure:
                continue
        raise errors.AttemptsExhausted("catalog definition")

    def expire(self, keep: int = 1) -> list[str]:
        """Forgets all but the newest versions. Gives what no longer serves any; that is not deleted before collect_garbage()."""
        newest = self._latest()
        oldest = max(self._oldest(), newest - keep + 1)
        self.storage.overwrite(paths.OLDEST, str(oldest).encode())
        return self.unreachable()

    def unreachable(self) -> list[str]:
        """Files in the store that no kept version and no saved transaction needs."""
        kept = [self._version(n) for n in range(self._oldest(), self._latest() + 1)]
        for t in self.show_distributed():
            kept.append(self._version(json.loads(self.storage.read(paths.distributed(t)))["base"]))
        needed = self.reachable(kept) | {paths.LATEST, paths.OLDEST, paths.root(0)}
        saved = [json.loads(self.storage.read(paths.distributed(t))) for t in self.show_distributed()]
        pending = {m for t in saved for step in t["operations"] for m in (step["payload"] or {}).get("manifests", [])}
        base = str(self.storage.root).rstrip("/") + "/"
        needed |= pending | {f["path"].removeprefix(base) for m in pending for f in table.read_manifest(self.storage, m)}
        return [p for p in self.storage.list() if p not in needed and not p.startswith("def/dtxn/") and not p.rsplit("/", 1)[-1].startswith("_")]

    def collect_garbage(self, older_than_millis: int | None = None) -> int:
        """Deletes what no longer serves any version. Files younger than a transaction may live (or than is given) stay: open
        transactions, which only their sessions know of, may have written them."""
        age = self.definition["txn_ttl_millis"] if older_than_millis is None else older_than_millis
        before = time.time() * 1000 - age
        gone = [p for p in self.unreachable() if (at := self.storage.modified(p)) is not None and at <= before]
        for i in range(0, len(gone), self.storage.delete_batch):
            self.storage.delete(gone[i : i + self.storage.delete_batch])
        return len(gone)

    # ---- one-statement use

    def reader(self) -> Version:
        return self.active or self.latest()

    def sql(self, statement: str) -> DataFrame:
        from lakeloom.plans import sql

        return sql.run(self, statement)


def _reading(name: str):
    def call(self, *args, **kwargs):
        return getattr(self.reader(), name)(*args, **kwargs)

    call.__name__ = name
    return call


def _changing(name: str):
    def call(self, *args, **kwargs):
        if self.active is not None:
            return getattr(self.active, name)(*args, **kwargs)
        txn = self.begin()
        getattr(txn, name)(*args, **kwargs)
        return txn.commit() if txn.operations else None

    call.__name__ = name
    return call


for _name in ("show_namespaces", "namespace_exists", "describe_namespace", "show_tables", "table_exists", "describe_table", "show_views", "view_exists", "describe_view", "table", "view", "relation", "objects"):
    setattr(Catalog, _name, _reading(_name))
for _name in (
    "create_namespace", "alter_namespace", "drop_namespace", "create_table", "replace_table", "register_table", "alter_table", "add_columns", "drop_columns", "rename_column", "widen_column", "drop_table", "rename_table",
    "append", "overwrite", "update", "delete", "create_view", "create_opaque_view", "replace_view", "drop_view",
):
    setattr(Catalog, _name, _changing(_name))


def connect(spark: SparkSession, warehouse: str, storage_type: str | None = None, create: bool = False, **options) -> Catalog:
    """The catalog at a warehouse path or URI; with create, made if it isn't there."""
    catalog = Catalog(spark, open_storage(warehouse, storage_type, **{k: v for k, v in options.items() if k.startswith(("delete", "read"))}), **options)
    if create and not catalog.exists():
        catalog.create(**{k: v for k, v in options.items() if k.replace("-", "_") in DEFAULTS})
    return catalog


__all__ = ["CASCADE", "RESTRICT", "SERIALIZABLE", "SNAPSHOT", "Catalog", "Node", "Transaction", "Version", "connect", "types"]
