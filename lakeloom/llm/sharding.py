"""Resharding by minimum-cost flow.

Rows lie in old shards; each shard is to hold as many rows as any other, give or take one. Rows of an old shard and size
class form a block; how many rows of which block go to which shard is a flow from blocks to shards whose cost is the bytes
that change shard. The network has two arcs a block - stay, at no cost, or go through a hub, at the block's mean bytes a row - so
the driver solves it by successive shortest paths over a few thousand nodes, however many rows there are. Executors then
turn each row's exact rank in its block into a shard and a slot. Within a block rows of groups come first, group by group, and rows that
are alone last; a block gives away its last rows, so groups stay whole as long as a block gives away no more than its single
rows, and of the rest only a group at a cut is parted.

Null size: counts as 0. Null group: a group of its own, hash 0. Very long texts: not read, but by the caller. Empty table: no rows.
Repeated rows: each has its own slot. Other columns: kept as they are, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import common

#: Size classes to a doubling, and bytes of group hashes that are broadcast at most.
CLASSES, BROADCAST_BYTES = 4, 1 << 24


class Network:
    """A flow network with costs; arcs are (to, room, cost, index of the reverse arc)."""

    def __init__(self, nodes: int) -> None:
        self.arcs: list[list[list]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: float = 0.0) -> tuple[int, int]:
        self.arcs[a].append([b, room, cost, len(self.arcs[b])])
        self.arcs[b].append([a, 0, -cost, len(self.arcs[a]) - 1])
        return a, len(self.arcs[a]) - 1

    def push(self, a: int, i: int, flow: int) -> None:
        arc = self.arcs[a][i]
        arc[1] -= flow
        self.arcs[arc[0]][arc[3]][1] += flow

    def used(self, at: tuple[int, int]) -> int:
        b, _, _, back = self.arcs[at[0]][at[1]]
        return self.arcs[b][back][1]

    def solve(self, s: int, t: int) -> None:
        """Sends all it can from s to t at least cost. What was pushed before must be of least cost, with no residual arc below 0."""
        potential = [0.0] * len(self.arcs)
        while True:
            far, came = {s: 0.0}, {}
            heap, done = [(0.0, s)], set()
            while heap:
                d, a = heapq.heappop(heap)
                if a in done:
                    continue
                done.add(a)
                if a == t:
                    break
                for i, (b, room, cost, _) in enumerate(self.arcs[a]):
                    if room and b not in done:
                        e = d + max(0.0, cost + potential[a] - potential[b])
                        if e < far.get(b, np.inf) - 1e-12:
                            far[b], came[b] = e, (a, i)
                            heapq.heappush(heap, (e, b))
            if t not in done:
                return
            for a in range(len(potential)):
                potential[a] += far[a] if a in done else far[t]
            flow, b = 1 << 62, t
            while b != s:
                a, i = came[b]
                flow, b = min(flow, self.arcs[a][i][1]), a
            b = t
            while b != s:
                a, i = came[b]
                self.push(a, i, flow)
                b = a


def transfers(blocks: list[tuple[int, int, float]], shards: int) -> list[list[tuple[int, int]]]:
    """For each block (old shard or -1, rows, mean bytes): [(shard, rows), ...], so that shards' rows differ by one at most and
    the bytes that change shard are fewest."""
    total = sum(n for _, n, _ in blocks)
    base, extra = divmod(total, shards)
    s, t, hub, more, first = 0, 1, 2, 3, 4 + shards
    net = Network(first + len(blocks))
    least = [net.arc(4 + j, t, base) for j in range(shards)]
    for j in range(shards):
        net.arc(4 + j, more, 1)
    net.arc(more, t, extra)
    hand = [net.arc(hub, 4 + j, total) for j in range(shards)]
    supply, stay, go = [], [], []
    for k, (old, n, cost) in enumerate(blocks):
        supply.append(net.arc(s, first + k, n))
        stay.append(net.arc(first + k, 4 + old, n) if 0 <= old < shards else None)
        go.append(net.arc(first + k, hub, n, cost))
    free = [base] * shards
    for k in sorted(range(len(blocks)), key=lambda k: -blocks[k][2]):  # rows that stay cost nothing: a least-cost start
        if stay[k] and (n := min(blocks[k][1], free[blocks[k][0]])):
            free[blocks[k][0]] -= n
            for at in (supply[k], stay[k], least[blocks[k][0]]):
                net.push(*at, n)
    net.solve(s, t)
    out = [[(blocks[k][0], net.used(stay[k]))] if stay[k] and net.used(stay[k]) else [] for k in range(len(blocks))]
    room = [[j, net.used(hand[j])] for j in range(shards) if net.used(hand[j])]
    for k in range(len(blocks)):
        left = net.used(go[k])
        while left:
            n = min(left, room[-1][1])
            out[k].append((room[-1][0], n))
            left -= n
            room[-1][1] -= n
            if not room[-1][1]:
                room.pop()
    return out


def reshard(df: DataFrame, shards: int, old: Column, size: Column, group: Column) -> DataFrame:
    """df with old_shard, shard and slot (gapless from 0 in each shard). old: where each row lies, null for a new row; size: its
    bytes; group: a hash whose equal values are kept together where the law allows."""
    size = F.coalesce(size, F.lit(0)).cast("long")
    level = F.when(size > 0, F.floor(F.log2(size.cast("double")) * CLASSES) + 1).otherwise(0)
    block = (F.coalesce(old, F.lit(-1)).cast("long") + 1) * 1024 + F.least(level, F.lit(1023))
    names = df.columns
    wide = df.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)), block.alias("b"), size.alias("s"), F.coalesce(group, F.lit(0)).cast("long").alias("h"), F.monotonically_increasing_id().alias("tie"))
    several = common.stored(wide.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("g")))
    several = F.broadcast(several) if several.count() * 16 <= BROADCAST_BYTES else several
    wide = wide.join(several, F.col("h") == F.col("g"), "left").withColumn("alone", F.col("g").isNull()).drop("g")
    order = ["b", "alone", "h", "tie"]  # tie: the place in the input, so that rows of one large group go to many tasks
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = wide.repartitionByRange(many, *order).sortWithinPartitions(*order).drop("alone", "h", "tie")

    @common.trimmed
    def ranked(batches):
        local, pid = common.LocalRanks(), TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(local.of(batch.column("b").to_numpy()))], [*batch.schema.names, "pid", "local"])

    rows = common.stored(common.batched(wide).mapInArrow(ranked, StructType([*wide.schema.fields, StructField("pid", IntegerType()), StructField("local", LongType())])))
    counts = rows.groupBy("b", "pid").agg(F.count("*").alias("n"), F.sum("s").alias("bytes"))
    found = sorted(counts.groupBy("b").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect())  # old shards x classes
    plan = transfers([(b // 1024 - 1, n, size / n) for b, n, size in found], shards)
    runs, slot = [], [0] * shards
    for (b, _, _), parts in zip(found, plan, strict=True):
        at = 0
        for j, n in parts:
            runs.append((b, at, j, slot[j]))
            at, slot[j] = at + n, slot[j] + n
    held = df.sparkSession.sparkContext.broadcast({k: np.array([x[i] for x in runs], np.int64) for i, k in enumerate(("block", "rank", "shard", "slot"))})

    @common.trimmed
    def placed(batches):
        p = held.value
        for batch in batches:
            b, rank = batch.column("b").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(p["block"] * (1 << 46) + p["rank"], b * (1 << 46) + rank, "right") - 1
            old = pa.array((b // 1024 - 1).astype(np.int32), mask=b < 1024)
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("b", "rank")]
            yield pa.RecordBatch.from_arrays([*cols, old, pa.array(p["shard"][at].astype(np.int32)), pa.array(p["slot"][at] + rank - p["rank"][at])], out.fieldNames())

    before = common.starts(counts, "b").select("b", "pid", "before")  # tasks are ranges, in order
    ready = rows.join(before, ["b", "pid"]).select(*(f"c{i}" for i in range(len(names))), "b", (F.col("local") + F.col("before")).alias("rank"))
    out = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)), StructField("old_shard", IntegerType()), StructField("shard", IntegerType()), StructField("slot", LongType())])
    return ready.mapInArrow(placed, out).toDF(*names, "old_shard", "shard", "slot")


def rewrite(resharded: DataFrame, path: str) -> None:
    """Writes the shards that gained or lost rows, each as a folder shard=N under path, deletes those that lost all of them, and
    leaves the others' files alone."""
    moved = resharded.where("old_shard is null or old_shard <> shard")
    touched = moved.select(F.col("shard").alias("shard")).union(moved.where("old_shard is not null").select("old_shard")).distinct()
    (
        resharded.join(F.broadcast(touched), "shard", "left_semi")  # no more rows than shards
        .drop("old_shard")
        .repartition("shard", F.floor(F.col("slot") / 1_000_000))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
    spark = resharded.sparkSession
    for (n,) in touched.join(resharded.select("shard").distinct(), "shard", "left_anti").collect():  # no more than old shards
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={n}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
