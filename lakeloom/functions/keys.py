"""Keys of catalog objects, as Python values and as columns.

A key is a prefix for the type and the names, each padded with blanks to its configured width, so keys sort by type, then namespace, then
name, byte by byte in UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.errors import InvalidArgument

# Fixed values of the storage format.
NAMESPACE, TABLE, VIEW = "B===", "C===", "D==="
SYSTEM_KEYS = ("catalog_def", "previous_root", "rollback_from_root", "created_at_millis", "n_keys", "n_actions")

_TYPES = {"namespace": NAMESPACE, "table": TABLE, "view": VIEW}
_NAMES = {v: k for k, v in _TYPES.items()}


class Keys:
    """The encoders of one catalog."""

    def __init__(self, namespace: int = 100, table: int = 100, view: int = 100) -> None:
        self.widths = {"namespace": namespace, "table": table, "view": view}

    def _padded(self, kind: str, name: str) -> str:
        width = self.widths[kind]
        if not name or not name.strip():
            raise InvalidArgument(f"{kind} name must not be empty")
        if len(name) > width:
            raise InvalidArgument(f"{kind} name has {len(name)} characters; the limit is {width}")
        if name != name.strip() or any(c in name for c in "\n\r\t"):
            raise InvalidArgument(f"{kind} name {name!r} begins or ends with a blank or holds a control character")
        return name.ljust(width)

    def key(self, kind: str, namespace: str, name: str | None = None) -> str:
        """namespace('ns'), table('ns', 't') or view('ns', 'v') as a key."""
        if (kind == "namespace") != (name is None):
            raise InvalidArgument(f"a {kind} key takes {'one name' if kind == 'namespace' else 'two names'}")
        return _TYPES[kind] + self._padded("namespace", namespace) + ("" if name is None else self._padded(kind, name))

    def prefix(self, kind: str, namespace: str | None = None) -> str:
        """What the keys of a kind, or of a kind in a namespace, begin with."""
        return _TYPES[kind] + ("" if namespace is None else self._padded("namespace", namespace))

    def kind(self, key: str) -> str | None:
        """The kind of object of a key; None for any other string."""
        kind = _NAMES.get(key[:4])
        if kind is None:
            return None
        want = 4 + self.widths["namespace"] + (0 if kind == "namespace" else self.widths[kind])
        return kind if len(key) == want else None

    def names(self, key: str) -> tuple[str, ...]:
        """The names in a key."""
        kind = self.kind(key)
        if kind is None:
            raise InvalidArgument(f"not an object key: {key!r}")
        cut = 4 + self.widths["namespace"]
        return (key[4:cut].rstrip(),) if kind == "namespace" else (key[4:cut].rstrip(), key[cut:].rstrip())

    def column(self, kind: str, namespace: Column, name: Column | None = None) -> Column:
        parts = [F.lit(_TYPES[kind]), F.rpad(namespace, self.widths["namespace"], " ")]
        return F.concat(*parts, *([] if name is None else [F.rpad(name, self.widths[kind], " ")]))

    def kind_column(self, key: Column) -> Column:
        w = self.widths
        size = F.length(key)
        out = F.when(key.startswith(NAMESPACE) & (size == 4 + w["namespace"]), "namespace")
        for kind in ("table", "view"):
            out = out.when(key.startswith(_TYPES[kind]) & (size == 4 + w["namespace"] + w[kind]), kind)
        return out

    def namespace_column(self, key: Column) -> Column:
        return F.rtrim(F.substring(key, 5, self.widths["namespace"]))

    def name_column(self, key: Column) -> Column:
        return F.rtrim(F.substring(key, 5 + self.widths["namespace"], 1 << 20))


def sort_key(key: str | None) -> tuple[int, bytes]:
    """Order of rows in a node: system keys, the null row, objects."""
    if key is None:
        return 1, b""
    return (0 if key in SYSTEM_KEYS else 2), key.encode()


def sort_columns(key: Column) -> list[Column]:
    """The same order for a DataFrame."""
    rank = F.when(key.isNull(), 1).when(key.isin(*SYSTEM_KEYS), 0).otherwise(2)
    return [rank.asc(), key.asc_nulls_first()]
