"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line with its line end; its digest is the start of the SHA-256 of its bytes. A section is a run of paragraphs that
ends after one whose SHA-256 starts with three zero bits, so that edits move section bounds only near them; its digest is that of its
paragraphs' digests, and the root that of the sections'. All of them stand in the fingerprint, so that two fingerprints alone
tell whether texts are equal (the roots), which sections differ, and in these which paragraphs; and each digest can be checked
against those below it. Below a paragraph stands a short mark for each chunk of its words (a chunk ends after a word whose hash
is 0 modulo CHUNK), so that likeness doesn't end at paragraphs.

A fingerprint is the root in hex, a colon, and the sections between semicolons: a digest, a colon, and the paragraphs between commas, each
a digest and then MARK characters a chunk. Likeness goes down the tree: equal sections count with all their chunks, then equal
paragraphs of the other sections, then equal chunks of the other paragraphs. It is 1 for equal roots, else twice the shared chunks
over those of both, below 1.

Null text: empty, no paragraph. Null ids come first in order; ties of ids are ordered by the text's hash, equal rows in any order. A
single row is followed by itself. Very long texts: read whole. Empty table: no rows. Repeated rows: each for itself. Ids: of any type
that orders. Names that clash with the new column: both are returned, the caller's first; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from . import common

CHUNK, MARK = 6, 5
#: Bytes of a section's or paragraph's digest in a fingerprint, and characters.
DIGEST = 9
_WIDE = DIGEST * 4 // 3
#: Rows that are sampled to deal rows by ranges, for each range.
SAMPLED = 30
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)


def chunks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and 64-bit hashes of the chunks that tile the bytes of one text."""
    n = len(raw)
    _, end, _, hashed = common.words(raw, np.array([0, n]))
    cut = np.zeros(n + 1, bool)
    cut[end[hashed % np.uint64(CHUNK) == 0]] = True
    cut[np.flatnonzero(raw == 10) + 1] = True
    cut[n] = True
    cut[0] = False
    end = np.flatnonzero(cut)
    p, q = common.powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(common._TABLE[raw] * p, out=total[1:])
    begin = np.r_[0, end[:-1]]
    return end, common.mix((total[end] - total[begin]) * q[begin] + (end - begin).astype(np.uint64))


def _text(digest: bytes) -> str:
    return base64.urlsafe_b64encode(digest[:DIGEST]).decode()


def _above(digests: list[str]) -> bytes:
    """The digest of what stands over these."""
    return hashlib.sha256("".join(digests).encode()).digest()


class Tree:
    """A fingerprint's tree: root, and sections as (digest, [(paragraph's digest, its marks), ...])."""

    def __init__(self, root: str, sections: list[tuple[str, list[tuple[str, str]]]]) -> None:
        self.root, self.sections = root, sections

    @classmethod
    def of(cls, data: bytes) -> Tree:
        lines = data.split(b"\n")
        paragraphs = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        end, hashed = chunks(np.frombuffer(data, np.uint8)) if data else (np.zeros(0, int), np.zeros(0, np.uint64))
        shifts = np.arange(MARK, dtype=np.uint64) * np.uint64(6)
        marks = _LETTERS[((hashed >> np.uint64(64 - 6 * MARK))[:, None] >> shifts & np.uint64(63)).astype(np.intp)].tobytes().decode()
        bounds = (np.r_[0, np.searchsorted(end, np.cumsum([len(x) for x in paragraphs]), "right")] * MARK).tolist()
        sections, held = [], []
        for k, x in enumerate(paragraphs):
            digest = hashlib.sha256(x).digest()
            held.append((_text(digest), marks[bounds[k] : bounds[k + 1]]))
            if digest[0] < 32 or k == len(paragraphs) - 1:
                sections.append((_text(_above([d for d, _ in held])), held))
                held = []
        return cls(_above([d for d, _ in sections]).hex(), sections)

    @classmethod
    def read(cls, fingerprint: str) -> Tree:
        root, _, body = fingerprint.partition(":")
        sections = []
        for s in body.split(";") if body else ():
            digest, _, parts = s.partition(":")
            sections.append((digest, [(p[:_WIDE], p[_WIDE:]) for p in parts.split(",")]))
        return cls(root, sections)

    @property
    def text(self) -> str:
        return f"{self.root}:" + ";".join(f"{d}:" + ",".join(p + m for p, m in ps) for d, ps in self.sections)

    def holds(self) -> bool:
        """Whether every digest is that of the digests below it."""
        return self.root == _above([d for d, _ in self.sections]).hex() and all(d == _text(_above([p for p, _ in ps])) for d, ps in self.sections)


def _marks(paragraphs) -> Counter:
    return Counter(m[i : i + MARK] for _, m in paragraphs for i in range(0, len(m), MARK))


def _apart(a: list, b: list, key) -> tuple[list, list, list]:
    """What of a has an equal in b, one for one, and what is left of both."""
    free = Counter(map(key, b))
    both, left = [], []
    for x in a:
        if free[key(x)]:
            free[key(x)] -= 1
            both.append(x)
        else:
            left.append(x)
    rest = []
    for x in reversed(b):
        if free[key(x)]:
            free[key(x)] -= 1
            rest.append(x)
    return both, left, rest[::-1]


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    size = lambda ps: sum(len(m) for _, m in ps) // MARK
    total = sum(size(ps) for t in (a, b) for _, ps in t.sections)
    both, left, right = _apart(a.sections, b.sections, lambda s: s[0])
    shared = sum(size(ps) for _, ps in both)
    both, left, right = _apart([p for _, ps in left for p in ps], [p for _, ps in right for p in ps], lambda p: p[0])
    shared += size(both) + (_marks(left) & _marks(right)).total()
    return min(2 * shared / total, 1 - 1e-9) if total else 0.0


def differing(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """What turns the text of fingerprint a into that of b, from the root down: (kind, first and end paragraph of a, first and end
    paragraph of b), kind being delete, insert or replace; paragraphs are numbered from 0 through the text. None if roots agree."""
    ta, tb = Tree.read(a), Tree.read(b)
    if ta.root == tb.root:
        return []
    starts = [np.r_[0, np.cumsum([len(ps) for _, ps in t.sections])].astype(int).tolist() for t in (ta, tb)]
    out = []
    for kind, i, j, k, l in SequenceMatcher(None, [d for d, _ in ta.sections], [d for d, _ in tb.sections], autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        # only sections that differ are opened
        mine, other = ([d for _, ps in t.sections[x:y] for d, _ in ps] for t, x, y in ((ta, i, j), (tb, k, l)))
        for what, p, q, r, s in SequenceMatcher(None, mine, other, autojunk=False).get_opcodes():
            if what != "equal":
                out.append((what, starts[0][i] + p, starts[0][i] + q, starts[1][k] + r, starts[1][k] + s))
    return out


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `fingerprint`, last."""
    at, names = docs.columns.index(column), docs.columns

    @common.trimmed
    def run(batches):
        for batch in batches:
            marks = [Tree.of((x or "").encode()).text for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], [f"c{i}" for i in range(len(names) + 1)])

    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)), StructField(f"c{len(names)}", StringType())])
    return common.batched(docs.toDF(*(f"c{i}" for i in range(len(names))))).mapInArrow(run, schema).toDF(*names, "fingerprint")


def against_next(docs: DataFrame) -> DataFrame:
    """For each document (doc_id, text) its fingerprint, that of its edited text (the second half of its code points replaced by
    the first as many of the next document by id) and the likeness to the edited text and to the next document.

    Rows are dealt by ranges of id, text hash and input position, so that rows of one id, and equal rows, spread as well; one
    shuffle of the texts. The first document of each range also goes to the range before. A bounded sample picks the ranges' bounds."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), *StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")])
    rows = docs.select("doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("s"))
    many, total = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count()
    if not total:
        return spark.createDataFrame([], schema)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("s").asc()]
    sample = rows.select("doc_id", "h", "s").sample(min(1.0, SAMPLED * many / total), seed=3).orderBy(*order).collect()  # SAMPLED rows a range
    bounds = sorted({max(0, len(sample) * i // many) for i in range(1, many)}) if sample else []
    bounds = [tuple(sample[i]) for i in bounds if i < len(sample)]
    kinds = StructType([StructField("doc_id", kind), StructField("h", StructType.fromDDL("h long")[0].dataType), StructField("s", StructType.fromDDL("s long")[0].dataType)])
    key = lambda d, h, s: (d is not None, 0 if d is None else d, h, s)
    edges = [key(*x) for x in bounds]

    @F.arrow_udf("int")
    def range_of(d: pa.Array, h: pa.Array, s: pa.Array) -> pa.Array:  # a bound is in the range that it begins
        return pa.array([bisect_right(edges, key(*x)) for x in zip(d.to_pylist(), h.to_pylist(), s.to_pylist(), strict=True)], pa.int32())

    ranged = rows.withColumn("r", range_of("doc_id", "h", "s"))
    me = F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "h", "s")
    heads = sorted(((r.r, r.least) for r in ranged.select("r", me.alias("me")).groupBy("r").agg(F.min("me").alias("least")).collect()), key=lambda x: x[0])  # one row a range
    before = spark.createDataFrame([(least.doc_id, least.h, least.s, heads[i - 1][0]) for i, (_, least) in enumerate(heads)], StructType([*kinds, StructField("to", StructType.fromDDL("r int")[0].dataType)]))
    before = F.broadcast(before.withColumnsRenamed({"doc_id": "b_id", "h": "b_h", "s": "b_s"}))
    same = (F.col("s") == F.col("b_s")) & (F.col("h") == F.col("b_h")) & F.col("doc_id").eqNullSafe(F.col("b_id"))
    first = ranged.join(before, same).select("doc_id", "text", "h", "s", F.col("to").alias("r"), F.lit(True).alias("head"))
    dealt = ranged.select("doc_id", "text", "h", "s", "r", F.lit(False).alias("head")).unionByName(first)
    dealt = dealt.repartition("r").sortWithinPartitions("r", "head", *order).select("doc_id", "text", "r", "head")

    @common.trimmed
    def pair(batches):
        def finish(mine, after):
            doc, text, tree = mine
            half = len(text) // 2
            edited = (text[: len(text) - half] + after[1][:half]).encode()
            other = Tree.of(edited)
            out.append((doc, len(text), hashlib.sha256(edited).hexdigest(), tree.text, other.text, likeness(tree, other), likeness(tree, after[2])))

        kept = None  # (range, the row that waits for its next one)
        for batch in batches:
            out: list = []
            for doc, text, r, head in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kept and kept[0] != r:
                    kept = None
                mine = (doc, text or "", Tree.of((text or "").encode()))
                if kept:
                    finish(kept[1], mine)
                kept = None if head else (r, mine)
            cols = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema.fieldNames())

    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return common.batched(dealt).mapInArrow(pair, schema)
