"""Exact removal of repeated byte strings with sorted suffixes built column by column.

Every byte that lies in a string of WINDOW bytes which also starts earlier (in a document before, or earlier in the same one) is
removed; strings are judged on the input. A single collection of whole documents would take as many rounds as its longest
document has bytes, so documents are cut first where their own content says so: each window has as its anchor the least
GRAM-byte hash in it, the first of ties, and a run of windows with one anchor is a segment of at most 2 * WINDOW - GRAM bytes. Equal windows have equal
anchors, so only segments that share an anchor can repeat each other.

1. Executors cut documents into segments and drop, within their task, those that equal an earlier one; the rest meet by
   anchor, as packed arrays, and equal ones (by 128 bits of hash and 64 of the anchor's) are again reduced to the first. All
   windows of a later equal segment are repeated.
2. Different segments with one anchor may still share windows. Their bytes are fetched; of those that share a context of the anchor that
   two equal windows must share the Burrows-Wheeler transform and common prefixes are built column by column, BATCH_BYTES at a
   time, and rows whose common prefix reaches WINDOW are equal windows; all but the first occurrence are repeated.
3. An anchor with more than HOT different segments (a passage that very many documents quote) would make one large task: its windows
   are compared by 128-bit hashes in a distributed aggregation instead.
4. Repeated windows of a document are merged to spans and cut out.

Null text: empty. Null or repeated ids: rows are ordered by id (null first), then by a hash of the text, and rows equal in both
are copies in any order. Texts under WINDOW bytes: kept whole. Empty table: no rows. Other columns: kept by without_repeats().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import bwt, common
from .jaccard import _groups

WINDOW, GRAM = 100, 32
#: Different segments of an anchor that one batch takes, and of which one map task sends to one place, at most.
HOT, LOCAL_HOT = 2048, 256
#: Segments that a map task holds before it reduces and sends them, and bytes of text to a bucket of anchors; buckets at least.
HELD, BUCKET_BYTES, BUCKETS = 1 << 19, 1 << 22, 96
#: Bytes of segments that one batch sorts, about, and the steps of contexts by which segments are picked for it.
BATCH_BYTES, STEP = 1 << 20, 4
#: Bytes of documents' spans that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 1 << 26
_POSITION = np.uint64(30)
_SECOND = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)
#: Column types of packed segments: anchor, hash, document, start, windows, the anchor's place, a second hash.
_KINDS = ("<u8", "<u8", "<i8", "<i4", "u1", "u1", "<u8")


def segments(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Anchor, hash, row, start in the row, number of windows, the anchor's place in it and a second hash, of each segment of each row."""
    n = len(raw)
    if n < WINDOW:
        return [np.zeros(0, k) for k in _KINDS]
    p, q = common.powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(common._TABLE[raw] * p, out=total[1:])
    m = n - GRAM + 1
    h = common.mix((total[GRAM:] - total[:m]) * q[:m])
    low = (np.uint64(1) << _POSITION) - np.uint64(1)
    x = (h & ~low) | np.arange(m, dtype=np.uint64)
    width, wide = 1, WINDOW - GRAM + 1
    while width * 2 <= wide:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    if width < wide:
        x = np.minimum(x[: len(x) - (wide - width)], x[wide - width :])
    at = (x & low).astype(np.int64)
    ok = np.arange(len(at)) + WINDOW <= np.repeat(off[1:], np.diff(off))[: len(at)]
    changed = np.r_[True, at[1:] != at[:-1]]
    s = np.flatnonzero(ok & (changed | ~np.r_[False, ok[:-1]]))
    e = np.flatnonzero(ok & (np.r_[changed[1:], True] | ~np.r_[ok[1:], False])) + 1
    row = np.searchsorted(off, s, "right") - 1
    size = (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    whole = common.mix((total[e + WINDOW - 1] - total[s]) * q[s] + size)
    np.cumsum(_SECOND[raw] * p, out=total[1:])
    second = common.mix((total[e + WINDOW - 1] - total[s]) * q[s] + size)
    return [h[at[s]], whole, row, s - off[row], e - s, at[s] - s, second]


def _pack(cols: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype(k).tobytes() for c, k in zip(cols, _KINDS, strict=True)))


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in _KINDS)
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in _KINDS]
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, at = len(data) // width, 0
        for kind, part in zip(_KINDS, parts, strict=True):
            part.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


def _firsts(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """cols by anchor, hashes and place; and which of them are the first of their anchor and hashes."""
    order = np.lexsort((cols[3], cols[2], cols[6], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    first = np.ones(len(order), bool)
    first[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[6][1:] != cols[6][:-1])
    return cols, first


def _variants(anchor: np.ndarray) -> np.ndarray:
    """For sorted anchors: how many rows each has."""
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
    return np.repeat(np.diff(np.r_[edge, len(anchor)]), np.diff(np.r_[edge, len(anchor)]))


def _spans(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals merged per document."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    new = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(new) - 1
    # ends so far within a document: shifted apart so that one running maximum serves all
    shift = group * (int(b.max()) + 1)
    top = np.maximum.accumulate(b + shift) - shift
    new[1:] |= a[1:] > top[:-1]
    first = np.flatnonzero(new)
    return doc[first], a[first], top[np.r_[first[1:], len(a)] - 1]


def _ordered(docs: DataFrame) -> DataFrame:
    """docs with `_ll_ord`, a unique long in the order of documents: the id itself, or a number of sorted rows where ids are null or repeat."""
    seen = docs.select(F.count("*").alias("n"), F.count("doc_id").alias("k"), F.countDistinct("doc_id").alias("d")).first()
    if seen.n == seen.k == seen.d and docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs.withColumn("_ll_ord", F.col("doc_id").cast("long"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return common.stored(docs.repartitionByRange(many, *by).sortWithinPartitions(*by).withColumn("_ll_ord", F.monotonically_increasing_id()))


def shared_segments(docs: DataFrame) -> DataFrame:
    """docs (text, _ll_ord) to (kind, ord, a, b, anchor, place): kind 0, bytes a to b are repeated; kind 1, the segment at a with b windows
    shares its anchor with others and is the first of its like; kind 2, so do very many."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(BUCKETS, -(-n_bytes // BUCKET_BYTES))
    parts = min(many, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def runs(to, rows):
        """(value, rows) of each value of `to` among these rows."""
        if not len(rows):
            return []
        order = rows[np.argsort(to[rows], kind="stable")]
        edge = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]])
        return [(int(to[order[a]]), order[a:b]) for a, b in zip(edge, np.r_[edge[1:], len(order)], strict=True)]

    def sent(held):
        cols, first = _firsts([np.concatenate(x) for x in zip(*held, strict=True)])
        again = [c[~first] for c in cols]
        dup = _spans(again[2], again[3].astype(np.int64), again[3] + again[4].astype(np.int64) + WINDOW - 1)
        cols = [c[first] for c in cols]
        variants = _variants(cols[0])
        bucket = (common.mix(cols[0]) % np.uint64(many)).astype(np.int64)
        # an anchor with very many segments in this task: one goes to the anchor's place, marked, the others anywhere
        hot = variants > LOCAL_HOT
        mark = hot & np.r_[True, cols[0][1:] != cols[0][:-1]]
        spread = (common.mix(cols[1]) % np.uint64(many)).astype(np.int64)
        for kind, pick, to in ((0, ~hot, bucket), (1, hot, spread), (2, mark, bucket)):
            if found := [(t, kind, _pack([c[rows] for c in cols])) for t, rows in runs(to, np.flatnonzero(pick))]:
                yield found
        if len(dup[0]):
            to = (common.mix(dup[0].astype(np.uint64)) % np.uint64(many)).astype(np.int64)
            yield [(t, 3, b"".join(c[rows].astype("<i8").tobytes() for c in dup)) for t, rows in runs(to, np.arange(len(to)))]

    @common.trimmed
    def cut(batches):
        held, size = [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "data"])

        for batch in batches:
            order = batch.column(1).to_numpy()
            for first, raw, off in common.slices(batch.column(0)):
                cols = segments(raw, off)
                cols[2] = order[first + cols[2].astype(np.int64)]
                held.append([c.astype(k) for c, k in zip(cols, _KINDS, strict=True)])
                size += len(cols[0])
                if size > HELD:
                    yield from map(batch_of, sent(held))
                    held, size = [], 0
        if size:
            yield from map(batch_of, sent(held))

    def meet(table):
        kind, data = table.column("kind").to_numpy(), table.column("data").to_pylist()
        of = lambda k: [d for d, x in zip(data, kind, strict=True) if x == k]
        out = [np.zeros((0, 6), np.int64)]

        def add(code, doc, a, b, anchor, place):
            out.append(np.stack([np.broadcast_to(np.asarray(x), len(doc)).astype(np.int64) for x in (code, doc, a, b, anchor, place)], 1))

        for blob in of(3):
            doc, a, b = np.frombuffer(blob, "<i8").reshape(3, -1)
            add(0, doc, a, b, 0, 0)
        marked = np.unique(_unpack(of(2))[0])
        for k in (0, 1):
            cols, first = _firsts(_unpack(of(k)))
            again = [c[~first] for c in cols]
            add(0, again[2], again[3], again[3].astype(np.int64) + again[4] + WINDOW - 1, 0, 0)
            cols = [c[first] for c in cols]
            if k == 0:
                variants = _variants(cols[0])
                hot = (variants > HOT) | np.isin(cols[0], marked)
            else:
                variants, hot = np.full(len(cols[0]), 2), np.ones(len(cols[0]), bool)
            pick = (variants > 1) | hot
            add(np.where(hot, 2, 1)[pick], cols[2][pick], cols[3][pick], cols[4][pick], cols[0][pick].view(np.int64), cols[5][pick])
        rows = np.concatenate(out)
        return pa.table({"kind": rows[:, 0].astype(np.int32), "ord": rows[:, 1], "a": rows[:, 2], "b": rows[:, 3], "anchor": rows[:, 4], "place": rows[:, 5].astype(np.int32)})

    met = common.batched(docs.select("text", "_ll_ord")).mapInArrow(cut, "bucket long, kind int, data binary").repartition(parts, "bucket")
    return common.stored(met.groupBy("bucket").applyInArrow(meet, "kind int, ord long, a long, b long, anchor long, place int"), release=True)


def _fetched(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The bytes of segments of kind 1, as (kind 1, anchor, ord, a, place, data), and the hashes of windows of kind 2, as (kind 2, w1, ord, a, w2, null)."""
    wanted = found.where("kind > 0").groupBy("ord").agg(F.collect_list(F.struct("kind", "anchor", "a", "b", "place")).alias("segments"))

    @common.trimmed
    def cut(batches):
        for batch in batches:
            raw, off = common.buffers(batch.column(0))
            rows = batch.column(1)
            flat = rows.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(rows.offsets)))
            kind, anchor, a, b, place = (flat.field(i).to_numpy() for i in range(5))
            order = batch.column(2).to_numpy()
            one = np.flatnonzero(kind == 1)
            begin = off[doc[one]] + a[one]
            data = [raw[s : s + n + WINDOW - 1].tobytes() for s, n in zip(begin, b[one], strict=True)]
            out = [(np.full(len(one), 1, np.int32), anchor[one], order[doc[one]], a[one], place[one].astype(np.int64), data)]
            w = [np.zeros(0, np.int64)] * 4
            if len(two := np.flatnonzero(kind == 2)):
                n = b[two]
                start = np.repeat(a[two] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                d = np.repeat(doc[two], n)
                at = off[d] + start
                p, q = common.powers(len(raw))
                hashes = []
                for table in (common._TABLE, _SECOND):
                    total = np.empty(len(raw) + 1, np.uint64)
                    total[0] = 0
                    np.cumsum(table[raw] * p, out=total[1:])
                    hashes.append(common.mix((total[at + WINDOW] - total[at]) * q[at]).view(np.int64))
                w = [hashes[0], order[d], start, hashes[1]]
            out.append((np.full(len(w[0]), 2, np.int32), *w, [None] * len(w[0])))
            for k, x, o, s, y, z in out:
                for i in range(0, len(k), 50_000):
                    c = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(k[c]), pa.array(x[c]), pa.array(o[c]), pa.array(s[c]), pa.array(y[c]), pa.array(z[c], pa.binary())], ["kind", "x", "ord", "a", "y", "data"])

    rows = docs.select("text", "_ll_ord").join(wanted, F.col("_ll_ord") == F.col("ord")).select("text", "segments", "ord")
    return common.stored(common.batched(rows).mapInArrow(cut, "kind int, x long, ord long, a long, y long, data binary"), release=True)


def alike(anchor: np.ndarray, place: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Which segments share, with another of their anchor, one of the contexts of the anchor of which two equal windows share at least one:
    b bytes before it and WINDOW - GRAM - STEP - b or more after it, for b in steps."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    off = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
    at = off[:-1] + place
    p, q = common.powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(common._TABLE[raw] * p, out=total[1:])
    group = common.mix(anchor.view(np.uint64))
    out = np.zeros(len(data), bool)
    for before in range(0, WINDOW - GRAM, STEP):
        lo, hi = at - before, at + GRAM + max(0, WINDOW - GRAM - STEP - before)
        rows = np.flatnonzero((lo >= off[:-1]) & (hi <= off[1:]))
        h = common.mix((total[hi[rows]] - total[lo[rows]]) * q[lo[rows]] ^ group[rows])
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        out[rows] |= n[back] > 1
    return out


def repeated_windows(doc: np.ndarray, start: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, from, to) of windows of these segments that occur earlier in them, by sorted suffixes."""
    # byte 0 ends strings in the transform; other bytes of UTF-8 lie below 245
    raw = np.frombuffer(b"".join(data), np.uint8) + np.uint8(1)
    off = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
    _, lcp, string, length = bwt.build(raw, off)
    group = np.cumsum(lcp < WINDOW)
    has = length >= WINDOW
    group, string, length = group[has], string[has], length[has]
    d = doc[string]
    a = start[string] + np.diff(off)[string] - length
    order = np.lexsort((a, d, group))
    later = np.r_[False, group[order][1:] == group[order][:-1]] if len(order) else np.zeros(0, bool)
    rows = order[later]
    return _spans(d[rows], a[rows], a[rows] + WINDOW)


def spans(docs: DataFrame) -> DataFrame:
    """docs (text, _ll_ord) to (ord, spans: merged intervals as pairs of 64-bit numbers), for documents with repeated bytes."""
    found = shared_segments(docs)
    parts = _fetched(docs, found)

    @common.trimmed
    def sort(batches):
        held, size = [], 0

        def flush():
            doc, start = (np.concatenate(x) for x in zip(*(h[:2] for h in held), strict=True))
            d, a, b = repeated_windows(doc, start, [x for h in held for x in h[2]])
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], ["ord", "a", "b"])

        for table in _groups(batches, 1):  # whole anchors
            data = table.column("data").to_pylist()
            pick = np.flatnonzero(alike(table.column("x").to_numpy(), table.column("y").to_numpy(), data))
            if len(pick):
                held.append((table.column("ord").to_numpy()[pick], table.column("a").to_numpy()[pick], [data[i] for i in pick]))
                size += sum(len(x) for x in held[-1][2])
            if size >= BATCH_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    by_anchor = parts.where("kind = 1").select("x", "y", "ord", "a", "data").repartition("x").sortWithinPartitions("x")
    sorted_ = by_anchor.mapInArrow(sort, "ord long, a long, b long")
    windows = parts.where("kind = 2").select(F.col("x").alias("w1"), F.col("y").alias("w2"), "ord", "a")
    least = common.stored(windows.groupBy("w1", "w2").agg(F.min(F.struct("ord", "a")).alias("least"), F.count("*").alias("n")).where("n > 1"))  # stored: a join that deals both sides can split frequent windows
    hot = windows.join(least, ["w1", "w2"]).where(F.struct("ord", "a") != F.col("least")).select("ord", "a", (F.col("a") + WINDOW).alias("b"))
    every = found.where("kind = 0").select("ord", "a", "b").unionByName(sorted_).unionByName(hot)
    per = every.groupBy("ord").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    @common.trimmed
    def merge(batches):
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            doc, a, b = _spans(np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(1).offsets))), a, b)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            pairs = np.stack([a, b], 1).astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pairs[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["ord", "spans"])

    return common.stored(common.batched(per).mapInArrow(merge, "ord long, spans binary"), release=True)


def _cut(docs: DataFrame, fields: list[StructField], digest) -> DataFrame:
    """digest(row values without text, text bytes, spans) for each document; docs must have _ll_ord."""
    found = spans(docs)
    if (found.agg(F.sum(F.length("spans") + 48)).first()[0] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    names = [f.name for f in docs.schema.fields if f.name not in ("text", "_ll_ord")]
    found = found.toDF("_ll_at", "_ll_spans")
    joined = docs.join(found, F.col("_ll_ord") == F.col("_ll_at"), "left").select("text", "_ll_spans", *(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)))
    kinds = pa.schema([(f.name, _arrow(f)) for f in fields])

    @common.trimmed
    def run(batches):
        for batch in batches:
            text, found_, rest = batch.column(0), batch.column(1), list(batch.columns[2:])
            out = []
            for i, x in enumerate(text.to_pylist()):
                data = (x or "").encode()
                out.append(digest(data, np.frombuffer(found_[i].as_py() or b"", "<i8").reshape(-1, 2).tolist()))
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True))], [*(f"c{i}" for i in range(len(names))), *kinds.names]) if out else pa.RecordBatch.from_arrays([*rest, *(pa.array([], t) for t in kinds.types)], [*(f"c{i}" for i in range(len(names))), *kinds.names])

    schema = StructType([*(StructField(f"c{i}", docs.schema[n].dataType) for i, n in enumerate(names)), *fields])
    return common.batched(joined).mapInArrow(run, schema).toDF(*names, *(f.name for f in fields))


def _arrow(field: StructField):
    return {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[field.dataType.typeName()]


def _kept(data: bytes, cuts: list[list[int]]) -> bytes:
    if not cuts:
        return data
    edge = [0, *(x for c in cuts for x in c), len(data)]
    return b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document (doc_id, text)."""

    def digest(data, cuts):
        return len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(_kept(data, cuts)).hexdigest()

    fields = StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").fields
    return _cut(_ordered(docs.select("doc_id", "text")), fields, digest)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of text (code points that a cut splits go as well); n_chars, if there is such a column, follows.
    A document of which no word is left is dropped."""

    def digest(data, cuts):
        text = _kept(data, cuts).decode(errors="ignore") if cuts else data.decode()
        return text, len(text), int(bool(cuts) and not text.split())

    fields = StructType().add("_ll_text", "string").add("_ll_chars", "long").add("_ll_gone", "long").fields
    out = _cut(_ordered(docs), fields, digest).where("_ll_gone = 0")
    kind = dict(docs.dtypes)
    new = {"text": F.col("_ll_text"), "n_chars": F.col("_ll_chars").cast(kind.get("n_chars", "long"))}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))
