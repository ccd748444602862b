"""The SQL front door. Statements on transactions and on catalog objects are recognised as a whole; in queries, the names of catalog
relations are replaced by views over the DataFrames of the pinned version, and Spark does the rest."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lakeloom.errors import InvalidArgument, TransactionClosed
from lakeloom.operators.table import FORMATS

_SKIP = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/"
_NAME = r"(?:`[^`]+`|\w+)(?:\s*\.\s*(?:`[^`]+`|\w+))*"
_TRAVEL = r"(?:\s+(?:for\s+)?(?P<kind>system_version|version|system_time|timestamp)\s+as\s+of\s+(?P<at>'[^']*'|\d+))?"
_CTE = re.compile(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)(\w+)\s*(?:\([^()]*\)\s*)?as\s*\(", re.I)


def _parts(name: str) -> list[str]:
    return [p.strip().strip("`") for p in re.findall(r"`[^`]+`|\w+", name)]


def _text(literal: str) -> str:
    return literal[1:-1].replace("''", "'")


def _relations(query: str):
    """Matches of relations after FROM, JOIN or a comma that name no common table expression."""
    # strings are emptied but keep their quotes, comments go
    plain = re.sub(_SKIP, lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][0] if m[0][0] in "'\"" else " " * len(m[0]), query, flags=re.S)
    local = {c.lower() for c in _CTE.findall(plain)} | {"values", "lateral", "unnest"}
    for m in re.finditer(rf"\b(?P<word>from|join)\s+(?P<first>{_NAME}){_TRAVEL}", plain, re.I):
        call = plain[m.end() :].lstrip().startswith("(")
        if not call and m["first"].lower() not in local:
            yield m.start("first"), m.end(), query[m.start("first") : m.end("first")], m["kind"], query[m.start("at") : m.end("at")] if m["kind"] else None
        at = m.end()
        while not call and m["word"].lower() == "from" and (c := re.match(rf"(?:\s+(?:as\s+)?(?!where\b|join\b|on\b|group\b|order\b|inner\b|left\b|right\b|full\b|cross\b|limit\b|union\b)\w+)?\s*,\s*(?P<name>{_NAME})", plain[at:], re.I)):
            if c["name"].lower() not in local:
                yield at + c.start("name"), at + c.end("name"), query[at + c.start("name") : at + c.end("name")], None, None
            at += c.end()


def _qualified(name: str, namespace: str | None) -> str:
    parts = _parts(name)
    if len(parts) == 1:
        if namespace is None:
            raise InvalidArgument(f"{name} needs a namespace")
        parts = [namespace, *parts]
    return ".".join(parts)


def references(query: str, namespace: str | None = None) -> list[str]:
    """The catalog objects that a query reads."""
    return sorted({_qualified(name, namespace) for _, _, name, _, _ in _relations(query)})


def _millis(text: str) -> int:
    if text.isdigit():
        return int(text)
    at = datetime.fromisoformat(text)
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def _system(catalog) -> list[str]:
    """Where saved transactions are addressed."""
    return [catalog.system, catalog.distributed_parent]


def _saved(catalog, part: str):
    return catalog.load_distributed(part.removeprefix(catalog.distributed_prefix))


def _relation(version, name: str, above: tuple[str, ...]) -> DataFrame:
    from lakeloom.operators import views

    parts, system = name.split("."), _system(version.catalog)
    if parts[:2] == system and len(parts) == 5:
        return _saved(version.catalog, parts[2]).relation(".".join(parts[3:]))
    if parts == [system[0], "versions"]:
        return version.catalog.versions()
    if len(parts) == 2 and not version.table_exists(*parts) and version.view_exists(*parts):
        return views.resolve(version, *parts, above)
    return version.table(name)


def select(version, query: str, namespace: str | None = None, above: tuple[str, ...] = ()) -> DataFrame:
    """A query over one version of the catalog."""
    spark, out, last, made = version.spark, [], 0, {}
    for start, end, name, kind, at in _relations(query):
        full = _qualified(name, namespace)
        source = version
        if kind and kind.lower().endswith("version"):
            source = version.catalog.at(version=int(_text(at) if at.startswith("'") else at))
        elif kind:
            source = version.catalog.at(timestamp_millis=_millis(_text(at) if at.startswith("'") else at))
        key = (full, source.number if kind else None)
        if key not in made:
            made[key] = f"lakeloom_{uuid.uuid4().hex}"
            _relation(source, full, above).createOrReplaceTempView(made[key])
        tail = query[end:]
        aliased = re.match(r"\s+(?:as\s+)?(?!(?:where|join|on|using|group|order|having|inner|left|right|full|cross|limit|union|intersect|except|natural|anti|semi|lateral|window|tablesample|pivot|unpivot|offset|qualify|sort|distribute|cluster)\b)[A-Za-z_`]", tail, re.I)
        out += [query[last:start], made[key], "" if aliased else f" AS `{_parts(name)[-1]}`"]
        last = end
    out.append(query[last:])
    try:
        return spark.sql("".join(out))
    finally:
        for view in made.values():  # the plan is resolved; the name is free again
            spark.catalog.dropTempView(view)


def _properties(text: str) -> dict[str, str]:
    return {_text(k): _text(v) for k, v in re.findall(r"('(?:[^']|'')*')\s*=\s*('(?:[^']|'')*')", text or "")}


def _names(catalog, names: list[str], column: str) -> DataFrame:
    return catalog.spark.createDataFrame([(n,) for n in names], f"{column} string")


def _done(catalog) -> DataFrame:
    return catalog.spark.createDataFrame([], "result string")


def _target(catalog, name: str):
    """What changes apply to, and the name there: an object in a saved transaction, or in this session."""
    parts = _parts(name)
    if len(parts) >= 4 and parts[:2] == _system(catalog):
        if catalog.active is not None:
            raise InvalidArgument("a saved transaction can't be used inside another one")
        return _saved(catalog, parts[2]), parts[3:]
    return catalog, parts


def _keep(catalog, target) -> None:
    if target is not catalog:
        catalog.save_distributed(target)


def _begin(catalog, m):
    if catalog.active is not None and not catalog.active.closed:
        raise InvalidArgument("a transaction is active")
    catalog.active = catalog.begin()


def _active(catalog):
    txn, catalog.active = catalog.active, None
    if txn is None:
        raise TransactionClosed("no transaction is active")
    return txn


def _commit(catalog, m):
    txn = _active(catalog)
    if txn.operations:
        txn.commit()


def _rollback(catalog, m):
    _active(catalog).rollback()


def _create_namespace(catalog, m):
    parts = _parts(m["name"])
    if parts == [catalog.system]:
        catalog.create(**_properties(m["props"]))
    elif parts[:2] == _system(catalog) and len(parts) == 3:
        catalog.begin(id=parts[2].removeprefix(catalog.distributed_prefix), **_properties(m["props"])).save()
    else:
        target, names = _target(catalog, m["name"])
        if not (m["guard"] and target.namespace_exists(names[0])):
            target.create_namespace(names[0], _properties(m["props"]))
            _keep(catalog, target)


def _alter_namespace(catalog, m):
    parts, props = _parts(m["name"]), _properties(m["props"])
    if parts[:2] == _system(catalog) and len(parts) == 3:
        txn = _saved(catalog, parts[2])
        if str(props.get("commit", "")).lower() == "true":
            txn.commit()
            catalog.drop_distributed(txn.id)
        return
    target, names = _target(catalog, m["name"])
    if m["un"]:
        target.alter_namespace(names[0], unset=[_text(x) for x in re.findall(r"'(?:[^']|'')*'", m["props"])])
    else:
        target.alter_namespace(names[0], set=props)
    _keep(catalog, target)


def _drop_namespace(catalog, m):
    parts = _parts(m["name"])
    if parts[:2] == _system(catalog) and len(parts) == 3:
        catalog.drop_distributed(parts[2].removeprefix(catalog.distributed_prefix))
        return
    target, names = _target(catalog, m["name"])
    if not (m["guard"] and not target.namespace_exists(names[0])):
        target.drop_namespace(names[0], m["how"] or "RESTRICT")
        _keep(catalog, target)


def _show_namespaces(catalog, m):
    inside = _parts(m["name"] or "")
    if inside == [catalog.system]:
        found = [catalog.distributed_parent]
    elif inside == _system(catalog):
        found = [f"{catalog.distributed_prefix}{t}" for t in catalog.show_distributed()]
    elif inside[:2] == _system(catalog):
        found = _saved(catalog, inside[2]).show_namespaces()
    else:
        found = [*catalog.show_namespaces(), catalog.system]
    return _names(catalog, found, "namespace")


def _show(catalog, m):
    target, names = _target(catalog, m["name"])
    return _names(catalog, getattr(target, f"show_{m['what'].lower()}")(names[0]), "name")


def _fields(text: str | None) -> list[str]:
    """Partition fields between commas that stand outside parentheses."""
    return [c.strip(" `\n") for c in re.findall(r"(?:[^,()]|\([^()]*\))+", text or "") if c.strip()]


def _describe_namespace(catalog, m):
    target, names = _target(catalog, m["name"])
    rows = [("Namespace", names[0]), *sorted(target.describe_namespace(names[0]).items())]
    return catalog.spark.createDataFrame(rows, "info_name string, info_value string")


def _describe(catalog, m):
    """Columns of a table or view; extended: with layout, format, snapshot and properties."""
    target, (ns, t) = _target(catalog, m["name"])
    version = catalog.reader() if target is catalog else target
    is_view = not version.table_exists(ns, t) and version.view_exists(ns, t)
    found = version.describe_view(ns, t) if is_view else version.describe_table(ns, t)
    schema = StructType.fromJson(found["schema"]) if found["schema"] else StructType()
    rows = [(f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment")) for f in schema]
    if m["more"]:
        more = {"Query": found["query"], "References": ",".join(found["references"])} if is_view else {"Format": found["format"], "Partitioned by": ",".join(found["partition_by"]), "Sorted by": ",".join(found["sort_by"]), "Snapshot": str(found["current"])}
        rows += [(f"# {k}", v, None) for k, v in {**more, **found["properties"]}.items()]
    return catalog.spark.createDataFrame(rows, "col_name string, data_type string, comment string")


def _create_table(catalog, m):
    target, (ns, t) = _target(catalog, m["name"])
    if m["guard"] and target.table_exists(ns, t):
        return
    by, properties = _fields(m["by"]), _properties(m["props"])
    if (m["format"] or "").upper() in FORMATS[1:]:
        properties = {"write.format.default": m["format"].lower(), **properties}
    if m["query"]:
        df = select(catalog.reader() if target is catalog else target, m["query"])
        alone = target is catalog and catalog.active is None
        txn = catalog.begin() if alone else target
        make = txn.replace_table if m["replace"] and txn.table_exists(ns, t) else txn.create_table
        make(ns, t, df.schema, by, properties=properties)
        txn.append(f"{ns}.{t}", df)
        if alone:
            txn.commit()
    else:
        make = target.replace_table if m["replace"] and target.table_exists(ns, t) else target.create_table
        make(ns, t, m["columns"], by, properties=properties)
    _keep(catalog, target)


def _drop(catalog, m):
    target, (ns, t) = _target(catalog, m["name"])
    kind = m["what"].lower()
    if not (m["guard"] and not getattr(target, f"{kind}_exists")(ns, t)):
        getattr(target, f"drop_{kind}")(ns, t)
        _keep(catalog, target)


def _create_view(catalog, m):
    target, (ns, v) = _target(catalog, m["name"])
    target.create_view(ns, v, m["query"], replace=bool(m["replace"]))
    _keep(catalog, target)


def _alter_table(catalog, m):
    target, (ns, t) = _target(catalog, m["name"])
    rest = m["rest"].strip()
    if a := re.fullmatch(r"add\s+columns?\s*\(?(.*?)\)?", rest, re.I | re.S):
        target.add_columns(ns, t, a[1])
    elif a := re.fullmatch(r"drop\s+columns?\s*\(?(.*?)\)?", rest, re.I | re.S):
        target.drop_columns(ns, t, *(c.strip(" `") for c in a[1].split(",")))
    elif a := re.fullmatch(r"set\s+tblproperties\s*\((.*)\)", rest, re.I | re.S):
        target.alter_table(ns, t, set=_properties(a[1]))
    elif a := re.fullmatch(r"unset\s+tblproperties\s*\((.*)\)", rest, re.I | re.S):
        target.alter_table(ns, t, unset=[_text(x) for x in re.findall(r"'(?:[^']|'')*'", a[1])])
    elif a := re.fullmatch(r"rename\s+column\s+`?(\w+)`?\s+to\s+`?(\w+)`?", rest, re.I):
        target.rename_column(ns, t, a[1], a[2])
    elif a := re.fullmatch(r"(?:alter|change)\s+column\s+`?(\w+)`?\s+type\s+(.+)", rest, re.I | re.S):
        target.widen_column(ns, t, a[1], a[2].strip())
    elif a := re.fullmatch(r"(add|drop)\s+partition\s+field\s+(.+)", rest, re.I | re.S):
        now, field = target.describe_table(ns, t)["partition_by"], _fields(a[2])
        target.alter_table(ns, t, partition_by=[*now, *field] if a[1].lower() == "add" else [p for p in now if p not in field])
    elif a := re.fullmatch(r"write\s+ordered\s+by\s+(.+)", rest, re.I | re.S):
        target.alter_table(ns, t, sort_by=_fields(a[1]))
    elif a := re.fullmatch(rf"rename\s+to\s+({_NAME})", rest, re.I):
        target.rename_table(ns, t, _parts(a[1])[-1])
    else:
        raise InvalidArgument(f"can't alter a table by: {rest}")
    _keep(catalog, target)


def _insert(catalog, m):
    target, (ns, t) = _target(catalog, m["name"])
    df = select(catalog.reader() if target is catalog else target, m["query"])
    names = [c.strip(" `") for c in m["columns"].split(",")] if m["columns"] else [f["name"] for f in target.describe_table(ns, t)["schema"]["fields"]]
    df = df.toDF(*names)
    if m["how"].lower() == "overwrite":
        target.overwrite(f"{ns}.{t}", df)
    else:
        target.append(f"{ns}.{t}", df)
    _keep(catalog, target)


def _delete(catalog, m):
    target, (ns, t) = _target(catalog, m["name"])
    target.delete(f"{ns}.{t}", m["where"] or "true")
    _keep(catalog, target)


def _update(catalog, m):
    target, (ns, t) = _target(catalog, m["name"])
    values, depth, part = {}, 0, ""
    for token in re.findall(r"'(?:[^']|'')*'|.", m["values"] + ",", re.S):
        depth += (token == "(") - (token == ")")
        if token == "," and not depth:
            c, _, v = part.partition("=")
            values[c.strip(" `\n")] = v.strip()
            part = ""
        else:
            part += token
    target.update(f"{ns}.{t}", values, m["where"] or "true")
    _keep(catalog, target)


_NS = r"(?:database|schema|namespace)"
_STATEMENTS = [
    (r"begin(?:\s+transaction)?", _begin),
    (r"commit(?:\s+transaction)?", _commit),
    (r"rollback(?:\s+transaction)?", _rollback),
    (rf"create\s+{_NS}\s+(?P<guard>if\s+not\s+exists\s+)?(?P<name>{_NAME})(?:\s+with\s+(?:dbproperties|properties)\s*\((?P<props>.*)\))?", _create_namespace),
    (rf"alter\s+{_NS}\s+(?P<name>{_NAME})\s+(?P<un>un)?set\s+(?:dbproperties|properties)\s*\((?P<props>.*)\)", _alter_namespace),
    (rf"drop\s+{_NS}\s+(?P<guard>if\s+exists\s+)?(?P<name>{_NAME})(?:\s+(?P<how>restrict|cascade))?", _drop_namespace),
    (rf"show\s+(?:databases|schemas|namespaces)(?:\s+(?:in|from)\s+(?P<name>{_NAME}))?", _show_namespaces),
    (rf"show\s+(?P<what>tables|views)\s+(?:in|from)\s+(?P<name>{_NAME})", _show),
    (rf"create\s+(?P<replace>or\s+replace\s+)?table\s+(?P<guard>if\s+not\s+exists\s+)?(?P<name>{_NAME})\s*(?:\((?P<columns>.*?)\))?(?:\s*using\s+(?P<format>\w+))?(?:\s*partitioned\s+by\s*\((?P<by>(?:[^()]|\([^()]*\))*)\))?(?:\s*tblproperties\s*\((?P<props>[^)]*)\))?(?:\s+as\s+(?P<query>(?:select|with)\b.*))?", _create_table),
    (rf"desc(?:ribe)?\s+{_NS}\s+(?:extended\s+)?(?P<name>{_NAME})", _describe_namespace),
    (rf"desc(?:ribe)?\s+(?:table\s+)?(?P<more>extended\s+|formatted\s+)?(?P<name>(?!query\b){_NAME})", _describe),
    (rf"create\s+(?P<replace>or\s+replace\s+)?view\s+(?P<name>{_NAME})\s+as\s+(?P<query>.*)", _create_view),
    (rf"drop\s+(?P<what>table|view)\s+(?P<guard>if\s+exists\s+)?(?P<name>{_NAME})", _drop),
    (rf"alter\s+table\s+(?P<name>{_NAME})\s+(?P<rest>.*)", _alter_table),
    (rf"insert\s+(?P<how>into|overwrite)\s+(?:table\s+)?(?P<name>{_NAME})\s*(?:\((?P<columns>[^()]*)\)\s*)?(?P<query>(?:select|values|with)\b.*)", _insert),
    (rf"delete\s+from\s+(?P<name>{_NAME})(?:\s+where\s+(?P<where>.*))?", _delete),
    (rf"update\s+(?P<name>{_NAME})\s+set\s+(?P<values>.*?)(?:\s+where\s+(?P<where>.*))?", _update),
]
_STATEMENTS = [(re.compile(p, re.I | re.S), f) for p, f in _STATEMENTS]


def run(catalog, statement: str) -> DataFrame:
    """Runs one statement; those that give no rows give an empty DataFrame."""
    bare = re.sub(rf"({_SKIP})", lambda m: m[0] if m[0][0] in "'\"" else " ", statement, flags=re.S).strip().rstrip(";").strip()
    for pattern, do in _STATEMENTS:
        if m := pattern.fullmatch(bare):
            out = do(catalog, m)
            return out if out is not None else _done(catalog)
    return select(catalog.reader(), bare)
