"""N-gram Jaccard join by chosen paths.

A text is the set of its runs of WIDTH words (words are runs of bytes that are not white space; a shorter text is one run). Texts with
equal sets form a class and one of them, its representative, goes on. In each run a set takes each of its tokens
with probability 1 / (similarity x size) by a hash that all sets share, and goes to the bucket of each token it took. Buckets of
more than SMALL sets are split the same way again, by the path so far, up to DEPTH times, unless most of what is in them is alike. Two sets of similarity 0.8 meet in a
bucket at depth d with a chance of at least 0.63, 0.46, 0.37, 0.31 (_meet), so runs are repeated until, of the pairs that lie just at the threshold in a
bucket that had to be split to the end, a share of RECALL has met; of pairs above it or in smaller buckets far more have. Buckets are
brute-forced by sketches (one-permutation minima), in blocks if large, into candidate components; within these all pairs are
compared exactly on the whole sets. Large components are cut in blocks whose pairs are separate tasks, and only sums and spanning
links leave a task, never all pairs.

Null text: empty. Texts without words: one class of their own. Ids: of any type that orders. Null ids: allowed; a class whose ids are all null has a null
class_id. Repeated rows: copies, each counted. Empty table: no rows. Other columns: kept by deduplicate(), else not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH = 5
#: Similarity as a fraction.
OVER, UNDER = 4, 5
DEPTH, SMALL = 4, 128
#: The target recall at the threshold.
RECALL = 0.9994


def _meet(depth: int) -> float:
    """The chance, at least, that two sets at the threshold share a path of so many steps: the survival of a branching process in which a
    step shares one token on average."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - _meet(DEPTH)))
#: Sketch places, and the share of equal ones from which a pair is compared exactly; a pair at the threshold has less than this with a
#: chance of some 1 in 50000 (over four deviations).
SKETCH, LIKELY = 128, 0.65
#: Members of a large bucket that are compared, and the mean similarity from which on it is not split: most of its pairs would meet again.
PROBES, DENSE = 8, 0.4
BLOCK = 256
#: Nodes times tokens that are tried at once.
TRIED = 1 << 18
#: Bytes that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 1 << 26

_SEEDS = common.mix(np.arange(1, RUNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The set of token hashes of each row, sorted."""
    _, _, row, hashed = common.words(raw, off)
    n = len(off) - 1
    bounds = np.searchsorted(row, np.arange(n + 1))
    if len(hashed) >= WIDTH:
        h = np.zeros(len(hashed) - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            h = h * np.uint64(0x100000001B3) + hashed[k : len(hashed) - WIDTH + 1 + k]
        h = common.mix(h)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WIDTH:
            out.append(common.distinct(h[a : b - WIDTH + 1]))
        elif b > a:
            x = hashed[a : a + 1]
            for w in hashed[a + 1 : b]:
                x = common.mix(x * np.uint64(0x100000001B3) + w)
            out.append(common.mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _threshold(n: int) -> np.uint64:
    """Of 2**32: how often a set of n tokens takes one."""
    return np.uint64(min(1 << 32, (UNDER << 32) // (OVER * n)))


def taken(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of the given nodes of one set's paths: index of the node and the child's key. A long text's tokens go in pieces."""
    odd, mixed, often, step = (nodes | np.uint64(1))[:, None], common.mix(nodes)[:, None], _threshold(len(tokens)), max(1, TRIED // max(1, len(nodes)))
    found = [(w, at + t) for at in range(0, len(tokens), step) for w, t in [np.nonzero((mixed ^ tokens[None, at : at + step]) * odd >> np.uint64(32) < often)]]
    which, token = (np.concatenate(x) for x in zip(*found, strict=True))
    return which, common.mix(nodes[which] ^ common.mix(tokens[token] + np.uint64(0x632BE59BD9B4E019)))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The least token of each of SKETCH ranges of hashes, in a byte; 0 where there is none."""
    out = np.zeros(SKETCH, np.uint8)
    h = tokens * np.uint64(0xD6E8FEB86659FD93)
    h.sort()
    place = (h >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(h) else np.zeros(0, int)
    out[place[first]] = 1 + h[first] % np.uint64(255)
    return out


def _groups(batches, keys: int):
    """Columns (numpy or lists) of runs of whole groups: rows come sorted by their first `keys` columns. Groups are bounded in size."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        if held.num_rows < 4096:
            continue
        cols = [held.column(i).to_numpy() for i in range(keys)]
        same = np.ones(held.num_rows, bool)
        for c in cols:
            same &= c == c[-1]
        cut = held.num_rows - int(same[::-1].argmin() if not same.all() else held.num_rows)
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _edges_of(table: pa.Table, keys: int) -> np.ndarray:
    """First rows of groups, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(keys):
        c = table.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def _least_labels(near: np.ndarray) -> np.ndarray:
    """The least member of each row's component in a small boolean graph."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows (key, m: the key's rows, rid, ...) with b1, b2, own: tasks of one block or of two blocks of a key, at most about 2 blocks of rows each."""
    many = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("rid"), many).cast("int")
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    return out.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("other", "m")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of wanted (rid, doc_id, tk, ...), read from the documents again. Rows that agree in id and text come once or more."""
    wanted = common.stored(wanted.withColumnsRenamed({"doc_id": "w_id", "tk": "w_tk"}))
    lists = [F.size(f.name) for f in wanted.schema if f.dataType.typeName() == "array"]
    n_bytes = wanted.agg(F.sum(F.lit(64) + 8 * sum(lists, F.lit(0)) + F.octet_length(F.coalesce(F.col("w_id").cast("string"), F.lit(""))))).first()[0] or 0
    side = F.broadcast(wanted) if n_bytes <= BROADCAST_BYTES else wanted
    texts = _texts(docs)
    return texts.join(side, (F.col("tk") == F.col("w_tk")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).drop("doc_id", "tk", "w_tk", "w_id")


def sets(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, tk, s1, s2: the set's hash, n: its size, paths: first nodes of the runs, sketch), stored."""

    @common.trimmed
    def run(batches):
        pid, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            s1, s2, size, paths, marks = [], [], [], [], []
            for _, raw, off in common.slices(batch.column(1)):
                for tokens in shingles(raw, off):
                    a = int(np.add.reduce(common.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))) & (1 << 64) - 1
                    b = int(np.add.reduce(common.mix(tokens + np.uint64(0x14057B7EF767814F)))) & (1 << 64) - 1
                    s1.append(a - (1 << 63))
                    s2.append(b - (1 << 63))
                    size.append(len(tokens))
                    paths.append(common.distinct(taken(tokens, _SEEDS)[1]).view(np.int64) if len(tokens) else [])
                    marks.append(sketch(tokens).tobytes())
            rid = (np.int64(pid) << 40) + seen + np.arange(batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rid), batch.column(0), batch.column(2), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int32()), pa.array(paths, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["rid", "doc_id", "tk", "s1", "s2", "n", "paths", "sketch"])

    return common.stored(common.batched(_texts(docs)).mapInArrow(run, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tk long, s1 long, s2 long, n int, paths array<long>, sketch binary"))


def buckets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, m, rid): the buckets of 2 sets and more in which the paths of all runs end."""

    @common.trimmed
    def grow(batches):
        for batch in batches:
            rid, keys = [], []
            for i, raw, off in common.slices(batch.column(0)):
                for k, tokens in enumerate(shingles(raw, off), i):
                    nodes = np.array(batch.column(2)[k].as_py(), np.int64).view(np.uint64)
                    found = common.distinct(taken(tokens, nodes)[1]).view(np.int64)
                    keys.append(found)
                    rid.append(np.full(len(found), batch.column(1)[k].as_py()))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rid).astype(np.int64))], ["key", "rid"])

    @common.trimmed
    def alike(batches):
        for batch in batches:
            dense = []
            for row in zip(*(batch.column(i + 1).to_pylist() for i in range(PROBES)), strict=True):
                marks = np.frombuffer(b"".join(row), np.uint8).reshape(PROBES, SKETCH)
                i, j = np.triu_indices(PROBES, 1)
                u, v = marks[i], marks[j]
                same = ((u == v) & (u > 0)).sum(axis=1) / np.maximum(1, ((u > 0) | (v > 0)).sum(axis=1))
                dense.append(bool(same.mean() >= DENSE))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dense, pa.bool_())], ["key", "dense"])

    nodes = reps.select(F.explode("paths").alias("key"), "rid")
    done = None
    for depth in range(1, DEPTH + 1):
        count = common.stored(nodes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))  # stored: the join can split large buckets then
        met = common.stored(nodes.join(count, "key").select("key", "m", "rid"))
        final = met if depth == DEPTH else met.where(F.col("m") <= SMALL)
        done = final if done is None else done.unionByName(final)
        large = met.where(F.col("m") > SMALL)
        if depth == DEPTH or large.isEmpty():
            break
        # a few members of each large bucket show whether splitting it would help
        some = large.join(reps.select("rid", "sketch"), "rid").groupBy("key").agg(*(F.min_by("sketch", F.xxhash64("rid", F.lit(i))).alias(f"s{i}") for i in range(PROBES)))
        large = common.stored(large.join(common.stored(some.mapInArrow(alike, "key long, dense boolean")), "key"))
        done = done.unionByName(large.where("dense").select("key", "m", "rid"))
        large = large.where("not dense").groupBy("rid").agg(F.collect_set("key").alias("nodes"))
        wanted = large.join(reps.select("rid", "doc_id", "tk"), "rid")
        nodes = common.stored(common.batched(_fetch(docs, wanted).select("text", "rid", "nodes")).mapInArrow(grow, "key long, rid long").distinct())
    return done


def candidates(met: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) that span the likely similar sets of each bucket."""

    @common.trimmed
    def run(batches):
        for table in _groups(batches, 3):
            edge = _edges_of(table, 3)
            rid, own = table.column("rid").to_numpy(), table.column("own").to_numpy()
            marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            b1, b2 = table.column("b1").to_numpy(), table.column("b2").to_numpy()
            size, a, b = np.diff(edge), [], []
            for m in range(2, 17):  # all small groups of one size at once
                first = edge[:-1][(size == m) & (b1[edge[:-1]] == b2[edge[:-1]])]
                i, j = np.triu_indices(m, 1)
                x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                for at in range(0, len(x), 65536):
                    p, q = x[at : at + 65536], y[at : at + 65536]
                    u, v = marks[p], marks[q]
                    ok = ((u == v) & (u > 0)).sum(axis=1) >= LIKELY * ((u > 0) | (v > 0)).sum(axis=1)
                    a.append(rid[p[ok]])
                    b.append(rid[q[ok]])
            for k in np.flatnonzero((size > 16) | (b1[edge[:-1]] != b2[edge[:-1]])):
                s = slice(edge[k], edge[k + 1])
                u = marks[s]
                same, either = np.zeros((len(u), len(u)), np.int16), np.zeros((len(u), len(u)), np.int16)
                for c in range(SKETCH):
                    v = u[:, c]
                    same += (v[:, None] == v[None, :]) & (v > 0)[:, None]
                    either += (v[:, None] > 0) | (v[None, :] > 0)
                near = same >= LIKELY * either
                if b1[edge[k]] != b2[edge[k]]:
                    near &= own[s][:, None] != own[s][None, :]
                label = _least_labels(near)
                a.append(rid[s])
                b.append(rid[s][label])
            a, b = np.concatenate(a), np.concatenate(b)
            pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    rows = met.join(reps.select("rid", "sketch"), "rid").select("key", "m", "rid", "sketch")
    rows = _in_blocks(rows, "key", 2 * BLOCK).select("key", "b1", "b2", "own", "rid", "sketch")
    return rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(run, "a long, b long").distinct()


def verified(docs: DataFrame, reps: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact comparison of all pairs within candidate components. Gives (rid, links: texts linked, copies counted) and spanning links (a, b)."""
    comp = common.stored(components(linked))
    size = comp.groupBy("label").agg(F.count("*").alias("m"))
    wanted = comp.join(size, "label").withColumnRenamed("node", "rid").join(reps.select("rid", "doc_id", "tk", "copies"), "rid")

    @common.trimmed
    def cut(batches):
        for batch in batches:
            tokens = []
            for _, raw, off in common.slices(batch.column("text")):
                tokens += [t.astype("<u8").tobytes() for t in shingles(raw, off)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("label", "m", "rid", "copies")), pa.array(tokens, pa.binary())], ["label", "m", "rid", "copies", "tokens"])

    rows = common.batched(_fetch(docs, wanted).select("label", "m", "rid", "copies", "text")).mapInArrow(cut, "label long, m long, rid long, copies long, tokens binary")
    rows = _in_blocks(rows, "label", BLOCK).select("label", "b1", "b2", "own", "rid", "copies", "tokens")

    @common.trimmed
    def run(batches):
        for table in _groups(batches, 3):
            edge = _edges_of(table, 3)
            out = []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                part = table.slice(s, e - s)
                rid, once = np.unique(part.column("rid").to_numpy(), return_index=True)  # a row that was fetched twice counts once
                own, copies = part.column("own").to_numpy()[once], part.column("copies").to_numpy()[once]
                sets_ = [np.frombuffer(x, "<u8") for x in part.column("tokens").take(pa.array(once)).to_pylist()]
                n = np.array([len(x) for x in sets_])
                token, back, seen = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
                row = np.repeat(np.arange(len(n)), n)
                everywhere = seen == len(n)
                number = np.where((seen > 1) & ~everywhere, np.cumsum((seen > 1) & ~everywhere) - 1, -1)[back]
                shared = np.full((len(n), len(n)), int(everywhere.sum()), np.float32)
                width = int(number.max(initial=-1)) + 1
                order = np.argsort(number, kind="stable")
                for at in range(0, width, 8192):
                    lo, hi = np.searchsorted(number[order], [at, min(at + 8192, width)])
                    has = np.zeros((len(n), min(8192, width - at)), np.float32)
                    has[row[order[lo:hi]], number[order[lo:hi]] - at] = 1
                    shared += has @ has.T
                near = (UNDER + OVER) * shared >= OVER * (n[:, None] + n[None, :])
                np.fill_diagonal(near, False)
                if part.column("b1")[0].as_py() != part.column("b2")[0].as_py():
                    near &= own[:, None] != own[None, :]
                out.append((rid, near @ copies, rid[_least_labels(near)]))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["rid", "links", "root"])

    found = common.stored(rows.repartition("label", "b1", "b2").sortWithinPartitions("label", "b1", "b2").mapInArrow(run, "rid long, links long, root long"))
    return found.groupBy("rid").agg(F.sum("links").alias("links")), found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b"))


def classes(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text): rid, doc_id, tk, class_id (least id of its linked group), n_links (other documents of
    similarity 0.8 or more, copies included) and first (whether it is the one of its group to keep)."""
    all_sets = sets(docs)
    by_set = all_sets.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("least"), F.count("*").alias("copies"))
    by_set = common.stored(by_set.select("s1", "s2", "copies", F.col("least.rid").alias("rid"), F.col("least.doc_id").alias("least_id")))
    reps = common.stored(all_sets.join(by_set.select("rid", "copies"), "rid").select("rid", "doc_id", "tk", "copies", "paths", "sketch"))
    common.release_executors(docs.sparkSession)
    met = buckets(docs, reps)
    common.release_executors(docs.sparkSession)
    links, spanning = verified(docs, reps, candidates(met, reps))
    label = components(spanning).withColumnsRenamed({"node": "rid", "label": "class"})
    joined = common.stored(by_set.join(label, "rid", "left").join(links, "rid", "left").select("s1", "s2", "rid", "least_id", F.coalesce("class", "rid").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    head = joined.groupBy("class").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "rid")).alias("head"))
    full = joined.join(head, "class").select("s1", "s2", "n_links", F.col("head.least_id").alias("class_id"), F.col("head.rid").alias("head_rid"))
    return all_sets.select("rid", "doc_id", "tk", "s1", "s2").join(full, ["s1", "s2"]).select("rid", "doc_id", "tk", "class_id", "n_links", (F.col("rid") == F.col("head_rid")).alias("first"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each linked group: that of the least id."""
    found = common.stored(classes(docs))
    same = found.groupBy("doc_id", "tk").agg(F.max("first").alias("keep"), F.count("*").alias("n"))
    kept = same.where("keep").select(F.col("doc_id").alias("_ll_id"), F.col("tk").alias("_ll_tk"), (F.col("n") > 1).alias("_ll_twice"))
    left = docs.join(kept, (F.xxhash64(docs["text"]) == F.col("_ll_tk")) & docs["doc_id"].eqNullSafe(F.col("_ll_id")))
    once = left.where(~F.col("_ll_twice")).drop("_ll_id", "_ll_tk", "_ll_twice")
    # rows that agree in id and text are copies of each other: one of them stays
    again = left.where("_ll_twice").dropDuplicates(["_ll_id", "_ll_tk"]).drop("_ll_id", "_ll_tk", "_ll_twice")
    return once.unionByName(again)
