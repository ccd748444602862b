"""The ordered map's operators on DataFrames of (key, value, ...), for catalogs that are loaded or inspected in bulk."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.keys import sort_columns

#: Keys that are sampled for each range.
SAMPLED = 50


def merge_runs(*runs: DataFrame, key: str = "key") -> DataFrame:
    """Runs merged by key; of equal keys the row of the first run that has one stays. A hash aggregation, so each run is combined before
    the shuffle."""
    columns = runs[0].columns
    rest = [c for c in columns if c != key]
    marked = [r.select(key, F.struct(F.lit(i).alias("run"), *rest).alias("row")) for i, r in enumerate(runs)]
    best = reduce(DataFrame.unionByName, marked).groupBy(key).agg(F.min_by("row", F.col("row.run")).alias("row"))
    return best.select(*(key if c == key else F.col(f"row.{c}").alias(c) for c in columns))


def upsert(base: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    return merge_runs(changes, base, key=key)


def live(entries: DataFrame, value: str = "value") -> DataFrame:
    """Entries that are not marked as removed."""
    return entries.where(F.col(value).isNotNull())


def in_order(entries: DataFrame, key: str = "key") -> DataFrame:
    return entries.orderBy(*sort_columns(F.col(key)))


def _range(df: DataFrame, key: str = "key") -> Column:
    """The number of a range of keys, in order: ranges hold about as many rows each, as a bounded sample of keys tells. Null: before all."""
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = df.select(key).where(F.col(key).isNotNull()).orderBy(F.rand(5)).limit(SAMPLED * many)  # one pass, SAMPLED rows a range
    found = sorted(r[0] for r in sample.collect())
    bounds = sorted({found[len(found) * i // many] for i in range(1, many)}) if found else []
    if not bounds:
        return F.lit(0)
    # how many bounds are not above the key, by bisection
    if df.schema[key].dataType.typeName() in ("string", "byte", "short", "integer", "long"):  # Python orders these as Spark does
        return _bisected(bounds)(F.col(key))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("z")), lambda w, _: F.when(w["a"] >= w["z"], w).otherwise(_narrowed(w, bounds, F.col(key))), lambda w: w["a"])
    return F.when(F.col(key).isNull(), 0).otherwise(walk)


def _bisected(bounds: list):
    @F.arrow_udf("int")
    def number(keys: pa.Array) -> pa.Array:
        return pa.array([0 if k is None else bisect_right(bounds, k) for k in keys.to_pylist()], pa.int32())

    return number


def _narrowed(w: Column, bounds: list, key: Column) -> Column:
    mid = F.floor((w["a"] + w["z"]) / 2).cast("int")
    below = F.get(F.lit(bounds), mid) <= key
    return F.struct(F.when(below, mid + 1).otherwise(w["a"]).alias("a"), F.when(below, w["z"]).otherwise(mid).alias("z"))


def ranked(entries: DataFrame, order: int, key: str = "key", within: list[str] | None = None) -> DataFrame:
    """entries with their position in the node (from 1) and whether they are its pivot: key number order / 2. Without `within`, all
    entries are one node: they are ranked in ranges of keys, and ranges are joined by their counts."""
    if within:
        w = Window.partitionBy(*within).orderBy(key)
        return entries.withColumn("position", F.row_number().over(w)).withColumn("pivot", F.col("position") == order // 2)
    dealt = entries.withColumn("_range", _range(entries, key))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(key)
    out = dealt.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(before), "_range")  # no more rows than ranges
    out = out.withColumn("position", (F.col("_rank") + F.col("_before")).cast("int")).withColumn("pivot", F.col("position") == order // 2)
    return out.select(*entries.columns, "position", "pivot")


def split(entries: DataFrame, order: int, key: str = "key", within: list[str] | None = None) -> DataFrame:
    """entries with `side`: left of, at, or right of the pivot."""
    out = ranked(entries, order, key, within)
    return out.withColumn("side", F.when(F.col("pivot"), "pivot").when(F.col("position") < order // 2, "left").otherwise("right"))


def floor_lookup(entries: DataFrame, targets: DataFrame, target: str, key: str = "key", value: str = "value") -> DataFrame:
    """For each target the greatest key that is not above it. One sorted pass over both sides in ranges of keys; what a range lacks
    comes from the last key of the ranges before, of which there is one row a range."""
    both = entries.select(F.col(key).alias("k"), F.col(value).alias("v"), F.lit(0).alias("asked")).unionByName(targets.select(F.col(target).alias("k"), F.lit(None).cast("string").alias("v"), F.lit(1).alias("asked")))
    number = _range(both, "k")
    both = both.withColumn("range", number)
    inside = Window.partitionBy("range").orderBy("k", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.when(F.col("asked") == 0, F.struct("k", "v"))
    found = both.withColumn("near", F.last(held, ignorenulls=True).over(inside)).where("asked = 1")
    tops = entries.select(F.col(key).alias("k"), F.col(value).alias("v")).groupBy(number.alias("range")).agg(F.max_by(F.struct("k", "v"), F.col("k")).alias("top"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = entries.sparkSession.range(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1).select(F.col("id").cast("int").alias("range"))
    before = ranges.join(tops, "range", "left").select("range", F.last("top", ignorenulls=True).over(w).alias("before"))  # ranges without entries, too
    out = found.join(F.broadcast(before), "range").withColumn("near", F.coalesce("near", "before"))  # no more rows than ranges
    return out.select(F.col("k").alias(target), F.col("near.k").alias(key), F.col("near.v").alias(value))


def starting_with(entries: DataFrame, prefix: str | Column, key: str = "key") -> DataFrame:
    return entries.where(F.col(key).startswith(prefix))
