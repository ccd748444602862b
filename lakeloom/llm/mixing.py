"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame and SQL functions only.

Sources share as many words as all documents have, by weight, up to `most` times what a source has; what a capped source can't
take is shared by the others (water filling, in closed form over the sources). A block is one occurrence of a document. Each
source's blocks stand in a random order by hash; it gives whole passes over them and then a prefix that ends at its target, the last block
cut to fit. That fixes the exact number of blocks each source gives. A binary tree over the output shards then splits
these quotas: a node's left half gets of each source a hypergeometric number of blocks, drawn source after source, so every
shard has its exact size and the sources in it are mixed as if all blocks had been shuffled. A shard takes its disjoint run of each
source's permuted blocks and shuffles them locally.

Ranks in a source come from hash buckets and the buckets' sums, so no source's rows meet in one task.

Null text: size 0, never drawn. Null source: a source of its own, last. Null ids: as any id. Empty table: no rows. Only empty
texts: targets 0, nothing drawn. Repeated rows: each is a document. Other columns: carried along as a struct, so names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: Documents in a hash bucket and blocks in a shard, about.
BUCKET_ROWS, SHARD_BLOCKS = 2048, 8192
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sources (key, source, words) with weight and target. One row a source, so one task orders them."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("weight", F.element_at(F.lit(list(weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_need = Window.orderBy(most * F.col("words") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("words").over(everything) - most * F.coalesce(F.sum("words").over(by_need), F.lit(0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_need), F.lit(0))
    return ranked.withColumn("level", left / rest).withColumn("target", F.least((most * F.col("words")).cast("double"), F.col("weight") * F.max("level").over(everything))).drop("level")


def _draw(total: str, good: str, n: str, u: str) -> str:
    """SQL of a hypergeometric number: of `n` drawn from `total` of which `good` count. Inverse distribution from the mode outwards;
    what lies 12 deviations away has no weight that a double could show."""
    up = "cast((q - k) as double) * (n - k) / ((k + 1.0D) * (t - q - n + k + 1.0D))"
    down = "cast(k as double) * (t - q - n + k) / ((q - k + 1.0D) * (n - k + 1.0D))"
    zero = "named_struct('w', 1.0D, 's', 0.0D)"
    def with_(name: str, value: str, body: str) -> str:  # a let-binding: the one element of an array
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def total_of(seq: str, ratio: str) -> str:
        return f"aggregate({seq}, {zero}, (a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}), a -> a.s)"

    def found(seq: str, ratio: str, at: str, step: str) -> str:
        start = "named_struct('w', 1.0D, 's', 0.0D, 'x', m)"
        return f"aggregate({seq}, {start}, (a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}, 'x', if(a.s <= {at}, k {step} 1, a.x)), a -> a.x)"

    ups = "if(hi > m, sequence(m, hi - 1L), cast(array() as array<bigint>))"
    downs = "if(lo < m, sequence(m, lo + 1L, -1L), cast(array() as array<bigint>))"
    pick = f"if(p < 1.0D, m, if(p < 1.0D + su, {found('us', up, '(p - 1.0D)', '+')}, {found('ds', down, '(p - 1.0D - su)', '-')}))"
    body = with_("p", f"({u}) * (1.0D + su + sd)", pick)
    body = with_("su", total_of("us", up), with_("sd", total_of("ds", down), body))
    body = with_("us", ups, with_("ds", downs, body))
    wide = "cast(12 * sqrt(cast(n as double) * q / t * (t - q) / t * (t - n) / greatest(t - 1, 1)) + 12 as bigint)"
    body = with_("lo", "greatest(0L, n - (t - q), m - d)", with_("hi", "least(n, q, m + d)", body))
    body = with_("d", wide, body)
    body = with_("m", "least(n, q, greatest(0L, n - (t - q), cast(floor((n + 1.0D) * (q + 1.0D) / (t + 2.0D)) as bigint)))", body)
    return with_("t", total, with_("q", good, with_("n", n, f"if(t <= 0 or q <= 0 or n <= 0, 0L, if(q >= t, n, {body}))")))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (key, blocks) split among shards: (key, shard, blocks), without zeros, so no more rows than blocks. A node holds the sources
    that still have blocks there."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("key", F.col("blocks").cast("long").alias("q")))).alias("qs")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "qs", F.expr("aggregate(qs, 0L, (a, x) -> a + x.q)").alias("all"))
    u = f"shiftrightunsigned(xxhash64({seed}L, lo, hi, x.key), 11) / 9007199254740992.0D"
    step = _draw("s.t", "x.q", "s.n", u)
    left = f"aggregate(qs, named_struct('l', cast(array() as array<bigint>), 'n', half, 't', aggregate(qs, 0L, (a, x) -> a + x.q)), (s, x) -> element_at(transform(array({step}), g -> named_struct('l', concat(s.l, array(g)), 'n', s.n - g, 't', s.t - x.q)), 1), s -> s.l)"
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        # a shard k ends at floor(all * (k + 1) / shards) of all blocks
        node = node.withColumn("mid", F.expr("cast((lo + hi) div 2 as int)")).withColumn("half", F.expr(f"if(hi - lo > 1, (all * mid) div {shards} - (all * lo) div {shards}, 0L)"))
        node = node.withColumn("left", F.expr(f"if(hi - lo > 1, {left}, transform(qs, x -> 0L))"))
        halves = "if(hi - lo > 1, array(named_struct('lo', lo, 'hi', mid, 'qs', zip_with(qs, left, (x, g) -> named_struct('key', x.key, 'q', g))), named_struct('lo', mid, 'hi', hi, 'qs', zip_with(qs, left, (x, g) -> named_struct('key', x.key, 'q', x.q - g)))), array(named_struct('lo', lo, 'hi', hi, 'qs', transform(qs, x -> named_struct('key', x.key, 'q', x.q)))))"
        node = node.select("all", F.explode(F.expr(halves)).alias("c")).select("c.lo", "c.hi", F.filter("c.qs", lambda x: x["q"] > 0).alias("qs"), "all")
    return node.select(F.col("lo").alias("shard"), F.explode("qs").alias("x")).select(F.col("x.key").alias("key"), "shard", F.col("x.q").alias("blocks"))


def mix(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 11, keep_undrawn: bool = False) -> DataFrame:
    """One row a block: row (struct of the carried columns), key and place (which row of which source), size, source_size, target, epoch,
    words (those that this block takes; less than size in a source's last block), shard, slot. With keep_undrawn also one row, with
    nulls there, for each document that is not drawn."""
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*carry).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), *carry, text, source).alias("h"),
    )
    total = docs.count()
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0))
    drawable = (F.col("size") > 0).cast("long")
    sums = common.stored(rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.sum(drawable).alias("blocks")))
    sources = targets(sums.groupBy("key", "source").agg(F.sum("words").alias("words"), F.sum("blocks").alias("all_blocks")), weights, most)
    quota = F.round("target").cast("long")
    whole = F.when(F.col("words") > 0, F.floor(quota / F.col("words"))).otherwise(0).cast("int")
    sources = common.stored(sources.select("key", F.col("words").alias("source_size"), "all_blocks", "target", whole.alias("epochs"), (quota - whole * F.col("words")).alias("part")))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sums.select("key", "bucket", offset("words").alias("w0"), offset("n").alias("n0"), offset("blocks").alias("b0")).join(sources, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    placed = rows.select("row", "key", "size", "bucket", within("size").alias("w"), within(F.lit(1)).alias("n"), within(drawable).alias("b")).join(offsets, ["key", "bucket"])
    ranked = common.stored(
        placed.select("row", "key", "size", "source_size", "target", "epochs", "all_blocks", (F.col("n0") + F.col("n")).alias("place"), (F.col("b0") + F.col("b")).alias("rank"), F.greatest(F.lit(0), F.least("size", F.col("part") - F.col("w0") - F.col("w"))).alias("last"))
    )
    quotas = common.stored(ranked.groupBy("key").agg((F.max(F.col("epochs") * F.col("all_blocks")) + F.sum((F.col("last") > 0).cast("long"))).alias("blocks")))
    blocks = quotas.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, math.ceil(blocks / SHARD_BLOCKS))
    leaves = common.stored(split_quotas(quotas, shards, seed))
    upto = Window.partitionBy("key").orderBy("shard")
    ends = leaves.withColumn("end", F.sum("blocks").over(upto)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    times = F.col("epochs") + (F.col("last") > 0).cast("int")
    drawn = ranked.where((F.col("size") > 0) & (times > 0)).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    drawn = drawn.withColumn("words", F.when(F.col("epoch") < F.col("epochs"), F.col("size")).otherwise(F.col("last"))).withColumn("g", F.col("epoch") * F.col("all_blocks") + F.col("rank"))
    # the shard whose run of the source's blocks holds this one, by bisection
    mid = "cast((s.a + s.b) div 2 as int)"
    steps = math.ceil(math.log2(shards)) + 1
    bisect = f"get(ends, aggregate(sequence(0, {steps}), named_struct('a', 0, 'b', size(ends)), (s, i) -> if(s.a >= s.b, s, if(get(ends, {mid}).end <= g, named_struct('a', {mid} + 1, 'b', s.b), named_struct('a', s.a, 'b', {mid}))), s -> s.a)).shard"
    drawn = drawn.join(ends, "key").withColumn("shard", F.expr(bisect))
    shuffle = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "key", "g"), "key", "g")
    columns = ["row", "key", "place", "size", "source_size", "target", "epoch", "words", "shard"]
    out = drawn.select(*columns, (F.row_number().over(shuffle) - 1).cast("long").alias("slot"))
    if keep_undrawn:
        rest = ranked.where((F.col("size") == 0) | (times <= 0))
        out = out.unionByName(rest.select("row", "key", "place", "size", "source_size", "target"), allowMissingColumns=True)
    return out
