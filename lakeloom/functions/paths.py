"""Places of catalog files, as Python values and as columns. The root of version v lies under the 64 binary digits of v, lowest first,
which spreads neighbouring versions over an object store."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.errors import InvalidArgument

# Fixed values of the storage format.
LATEST, OLDEST = "vn/latest", "vn/oldest"
_BITS = 64
_ROOT = re.compile(r"vn/([01]{64})")
_FOLDERS = {"catalog": "def/catalog", "namespace": "def/ns", "table": "def/table", "view": "def/view"}


def root(version: int) -> str:
    if not 0 <= version < 1 << 63:
        raise InvalidArgument(f"no version: {version}")
    return "vn/" + format(version, f"0{_BITS}b")[::-1]


def version_of(path: str) -> int:
    m = _ROOT.fullmatch(path)
    if not m:
        raise InvalidArgument(f"not the path of a root: {path}")
    return int(m[1][::-1], 2)


def node() -> str:
    return f"node/{uuid.uuid4()}.arrow"


def definition(kind: str, *names: str) -> str:
    return f"{_FOLDERS[kind]}/{'/'.join([*names, str(uuid.uuid4())])}.binpb"


def distributed(txn_id: str) -> str:
    if not txn_id or "/" in txn_id:
        raise InvalidArgument(f"no transaction id: {txn_id!r}")
    return f"def/dtxn/{txn_id}.binpb"


def root_column(version: Column) -> Column:
    return F.concat(F.lit("vn/"), F.reverse(F.lpad(F.bin(version), _BITS, "0")))


def version_column(path: Column) -> Column:
    return F.conv(F.reverse(F.substring(path, 4, _BITS)), 2, 10).cast("long")
