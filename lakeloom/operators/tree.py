"""The catalog's ordered map: an immutable search tree whose nodes are small Arrow files.

A change copies the nodes on its path and shares all others, so a commit writes a handful of files however many objects there
are, and every root stands for a whole version. Nodes are read when they are first needed and kept in a cache by path; a
node file never changes."""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa

from lakeloom.errors import InvalidArgument
from lakeloom.functions import paths
from lakeloom.functions.keys import SYSTEM_KEYS
from lakeloom.sources.storage import Storage

SCHEMA = pa.schema([("key", pa.string()), ("value", pa.string()), ("pnode", pa.string())])
ACTION = "action/"
#: Nodes that are written at once.
TOGETHER = 4096


@dataclass(frozen=True)
class Node:
    """Sorted keys with values (None: removed) and, unless it is a leaf, one child more than keys: a path or a node not written yet."""

    keys: tuple[str, ...] = ()
    values: tuple[str | None, ...] = ()
    children: tuple["str | Node", ...] = ()


@dataclass(frozen=True)
class Root:
    """A version: its system values, the actions that made it, and the top node."""

    system: dict[str, str] = field(default_factory=dict)
    actions: tuple[str, ...] = ()
    top: Node = field(default_factory=Node)


def to_arrow(node: Node, root: Root | None = None) -> bytes:
    """A node as an Arrow file: system rows and actions (roots only), a null row with the leftmost child, a row for each key."""
    rows: list[tuple] = []
    if root is not None:
        system = {**root.system, "n_keys": str(len(node.keys)), "n_actions": str(len(root.actions))}
        rows += [(k, system[k], None) for k in SYSTEM_KEYS if k in system]
        rows += [(f"{ACTION}{i:09d}", a, None) for i, a in enumerate(root.actions)]
    below = node.children or (None,) * (len(node.keys) + 1)
    rows.append((None, None, below[0]))
    rows += list(zip(node.keys, node.values, below[1:], strict=True))
    table = pa.table([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], schema=SCHEMA)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, SCHEMA) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_arrow(data: bytes) -> Root:
    with pa.ipc.open_file(pa.BufferReader(data)) as f:
        table = f.read_all()
    keys, values, below = (table.column(i).to_pylist() for i in range(3))
    cut = keys.index(None)
    head = list(zip(keys[:cut], values[:cut], strict=True))
    children = tuple(below[cut:]) if below[cut] is not None else ()
    return Root({k: v for k, v in head if not k.startswith(ACTION)}, tuple(v for k, v in head if k.startswith(ACTION)), Node(tuple(keys[cut + 1 :]), tuple(values[cut + 1 :]), children))


class Tree:
    """Reads and changes trees in one store."""

    def __init__(self, storage: Storage, order: int = 128, cache: int = 4096) -> None:
        if order < 3:
            raise InvalidArgument("a tree's order is 3 at least")
        self.storage, self.order, self._cache, self._room = storage, order, OrderedDict(), cache
        self.reads = 0

    # ---- reading

    def load(self, path: str) -> Root:
        if path in self._cache:
            self._cache.move_to_end(path)
            return self._cache[path]
        self.reads += 1
        found = self._cache[path] = from_arrow(self.storage.read(path))
        while len(self._cache) > self._room:
            self._cache.popitem(last=False)
        return found

    def _node(self, ref: "str | Node") -> Node:
        return ref if isinstance(ref, Node) else self.load(ref).top

    def get(self, top: Node, key: str) -> str | None:
        """The value of a key, None if it is missing or removed."""
        while True:
            at = bisect_left(top.keys, key)
            if at < len(top.keys) and top.keys[at] == key:
                return top.values[at]
            if not top.children:
                return None
            top = self._node(top.children[at])

    def floor(self, top: Node, key: str) -> tuple[str, str | None] | None:
        """The greatest entry that is not above the key, removed ones included."""
        best = None
        while True:
            at = bisect_left(top.keys, key)
            if at < len(top.keys) and top.keys[at] == key:
                return key, top.values[at]
            if at:
                best = top.keys[at - 1], top.values[at - 1]
            if not top.children:
                return best
            top = self._node(top.children[at])

    def scan(self, top: Node, prefix: str = "", removed: bool = False) -> Iterator[tuple[str, str | None]]:
        """Entries in order whose key begins with the prefix; subtrees that can't hold any are not read."""
        first = bisect_left(top.keys, prefix)
        for at in range(first, len(top.keys) + 1):
            if top.children:
                yield from self.scan(self._node(top.children[at]), prefix, removed)
            if at == len(top.keys) or not top.keys[at].startswith(prefix):
                return
            if removed or top.values[at] is not None:
                yield top.keys[at], top.values[at]

    def reachable(self, top: Node) -> Iterator[str]:
        """Paths of all written nodes below the top."""
        for c in top.children:
            if isinstance(c, str):
                yield c
            yield from self.reachable(self._node(c))

    # ---- changing

    def put(self, top: Node, key: str, value: str | None) -> Node:
        """The tree with an entry added or replaced; None marks it as removed."""
        node, extra = self._put(top, key, value)
        if extra is None:
            return node
        pivot, pivot_value, right = extra
        return Node((pivot,), (pivot_value,), (node, right))

    def _put(self, node: Node, key: str, value: str | None):
        at = bisect_left(node.keys, key)
        if at < len(node.keys) and node.keys[at] == key:
            return Node(node.keys, (*node.values[:at], value, *node.values[at + 1 :]), node.children), None
        if not node.children:
            return self._halved(Node((*node.keys[:at], key, *node.keys[at:]), (*node.values[:at], value, *node.values[at:])))
        child, extra = self._put(self._node(node.children[at]), key, value)
        if extra is None:
            return Node(node.keys, node.values, (*node.children[:at], child, *node.children[at + 1 :])), None
        pivot, pivot_value, right = extra
        return self._halved(Node((*node.keys[:at], pivot, *node.keys[at:]), (*node.values[:at], pivot_value, *node.values[at:]), (*node.children[:at], child, right, *node.children[at + 1 :])))

    def _halved(self, node: Node, mid: int | None = None):
        """The node, or its lower half with pivot (number mid, from 0) and upper half once it is full."""
        if len(node.keys) < self.order - 1:
            return node, None
        mid = self.order // 2 - 1 if mid is None else mid
        low = Node(node.keys[:mid], node.values[:mid], node.children[: mid + 1])
        high = Node(node.keys[mid + 1 :], node.values[mid + 1 :], node.children[mid + 1 :])
        return low, (node.keys[mid], node.values[mid], high)

    def height(self, top: Node) -> int:
        n = 0
        while top.children:
            top, n = self._node(top.children[0]), n + 1
        return n

    def join(self, low: Node, low_height: int, entry: tuple[str, str | None], high: Node, high_height: int) -> tuple[Node, int]:
        """One tree, and its height, of two and the entry that lies between them. Only nodes on the edge where they meet are read and made."""
        node, extra = self._joined(low, low_height, entry, high, high_height)
        height = max(low_height, high_height)
        return (node, height) if extra is None else (Node(extra[:1], extra[1:2], (node, extra[2])), height + 1)

    def _joined(self, low: Node, low_height: int, entry: tuple[str, str | None], high: Node, high_height: int):
        if low_height == high_height:
            if min(len(low.keys), len(high.keys)) >= max(1, self.order // 2 - 1):
                return low, (*entry, high)
            both = Node((*low.keys, entry[0], *high.keys), (*low.values, entry[1], *high.values), (*low.children, *high.children))
            return self._halved(both, len(both.keys) // 2)
        if low_height > high_height:
            child, extra = self._joined(self._node(low.children[-1]), low_height - 1, entry, high, high_height)
            keys, values, children = low.keys, low.values, (*low.children[:-1], child)
            return (Node(keys, values, children), None) if extra is None else self._halved(Node((*keys, extra[0]), (*values, extra[1]), (*children, extra[2])))
        child, extra = self._joined(low, low_height, entry, self._node(high.children[0]), high_height - 1)
        keys, values, children = high.keys, high.values, high.children[1:]
        return (Node(keys, values, (child, *children)), None) if extra is None else self._halved(Node((extra[0], *keys), (extra[1], *values), (child, extra[2], *children)))

    def bulk(self, entries: list[tuple[str, str | None]]) -> Node:
        """A tree of sorted entries, built level by level with even nodes; removed entries are left out."""
        entries = [e for e in entries if e[1] is not None]
        most = self.order - 2

        def build(lo: int, hi: int, height: int) -> Node:
            if height == 0:
                return Node(tuple(k for k, _ in entries[lo:hi]), tuple(v for _, v in entries[lo:hi]))
            room = (most + 1) ** height - 1  # entries that a child's subtree can hold
            parts = max(2, -(-(hi - lo + 1) // (room + 1)))
            ends = [lo + (hi - lo + 1) * i // parts for i in range(parts + 1)]
            pivots = [ends[i] - 1 for i in range(1, parts)]
            children = tuple(build(ends[i], ends[i + 1] - 1, height - 1) for i in range(parts))
            return Node(tuple(entries[p][0] for p in pivots), tuple(entries[p][1] for p in pivots), children)

        height = 0
        while len(entries) > (most + 1) ** (height + 1) - 1:
            height += 1
        return build(0, len(entries), height)

    def write(self, top: Node) -> Node:
        """Writes all nodes below the top that are not in the store yet, children first; gives the top with paths."""
        made: list[tuple[str, bytes]] = []

        def flush() -> None:
            self.storage.create_all(made)
            made.clear()
            while len(self._cache) > self._room:
                self._cache.popitem(last=False)

        def settled(ref: "str | Node") -> str:
            if isinstance(ref, str):
                return ref
            node = Node(ref.keys, ref.values, tuple(settled(c) for c in ref.children))
            path = paths.node()
            made.append((path, to_arrow(node)))
            self._cache[path] = Root(top=node)
            if len(made) >= TOGETHER:
                flush()
            return path

        out = Node(top.keys, top.values, tuple(settled(c) for c in top.children))
        flush()
        return out


def edit(tree: Tree, top: Node, changes: dict[str, str | None], apply: Callable[[Tree, Node, str, str | None], Node] | None = None) -> Node:
    """top with all changes."""
    for key in sorted(changes):
        top = apply(tree, top, key, changes[key]) if apply else tree.put(top, key, changes[key])
    return top
