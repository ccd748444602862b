"""Registered queries of the catalog engine and the SQL that each must equal. Every query makes a catalog in a folder of its own, brings it
into the state that it is about, and returns rows that were read through the catalog."""

from __future__ import annotations

import functools
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.errors import CommitConflict, SealFailure
from lakeloom.functions import paths, types
from lakeloom.functions.keys import SYSTEM_KEYS, Keys
from lakeloom.operators import conflicts, forest, merge
from lakeloom.operators.catalog import CASCADE, Catalog, connect
from lakeloom.operators.tree import Node, Tree, from_arrow
from lakeloom.sources.storage import URI, open_storage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where the session names none."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return f"{at.rstrip('/')}/lakeloom-q-{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix="lakeloom-q-")


def _catalog(spark: SparkSession, sf_dir: str, *tables: str) -> Catalog:
    catalog = connect(spark, _place(spark), create=True)
    with catalog.transaction() as txn:
        txn.create_namespace("tpch")
        for t in tables:
            txn.register_table("tpch", t, f"{sf_dir}/{t}.parquet")
    return catalog


def _copied(spark: SparkSession, sf_dir: str, table: str, where: str = "true", partition_by=(), sort_by=()) -> Catalog:
    """A catalog with an own copy of a table, tpch.t."""
    catalog = _catalog(spark, sf_dir)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where)
    with catalog.transaction() as txn:
        txn.create_table("tpch", "t", df.schema, partition_by, sort_by)
        txn.append("tpch.t", df)
    return catalog


_SUMMARY = """
  select l_returnflag, l_linestatus, {round}(sum(l_quantity), 2) as sum_qty, {round}(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, count(*) as count_order
  from {table} where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _catalog(spark, sf_dir, "lineitem").table("tpch.lineitem", where="l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.count("*").alias("count_order"),
    )


QUERIES["pricing_summary"] = flagship
ORACLES["pricing_summary"] = _SUMMARY.format(round="round", table="lineitem")


# ---- scans and changes of rows


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_quantity > 45 and l_returnflag = 'R'")
def scan_project_filter(spark, sf_dir):
    return _catalog(spark, sf_dir, "lineitem").table("tpch.lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_quantity > 45 and l_returnflag = 'R'")


@query("select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1997-01-01 00:00:00' and o_orderdate < timestamp '1997-04-01 00:00:00'")
def scan_file_skipping(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "orders", sort_by=["o_orderdate"])
    return catalog.table("tpch.t", ["o_orderkey", "o_totalprice"], "o_orderdate >= timestamp_ntz '1997-01-01 00:00:00' and o_orderdate < timestamp_ntz '1997-04-01 00:00:00'")


@query("select c_custkey, c_name from customer")
def append_then_scan(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "customer", "c_acctbal > 0")
    catalog.append("tpch.t", spark.read.parquet(f"{sf_dir}/customer.parquet").where("not coalesce(c_acctbal > 0, false)"))
    return catalog.table("tpch.t", ["c_custkey", "c_name"])


@query("select o_orderkey, case when o_orderstatus = 'F' then 'DONE' else o_orderpriority end as o_orderpriority from orders")
def overwrite_update(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "orders")
    catalog.update("tpch.t", {"o_orderpriority": "'DONE'"}, "o_orderstatus = 'F'")
    return catalog.table("tpch.t", ["o_orderkey", "o_orderpriority"])


@query("select s_suppkey, s_name from supplier where not coalesce(s_acctbal > 0 and s_nationkey < 20, false)")
def delete_where(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "supplier")
    catalog.delete("tpch.t", "s_acctbal > 0 and s_nationkey < 20")
    return catalog.table("tpch.t", ["s_suppkey", "s_name"])


@query("select p_partkey, p_brand from part where p_size > 25 union all select p_partkey, 'NEW' as p_brand from part where p_size <= 25")
def overwrite_where(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "part")
    new = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size <= 25").withColumn("p_brand", F.lit("NEW"))
    catalog.overwrite("tpch.t", new, "p_size <= 25")
    return catalog.table("tpch.t", ["p_partkey", "p_brand"])


@query("select n_nationkey, n_name, cast(null as varchar) as remark from nation union all select n_nationkey + 100, n_name, 'new' from nation")
def add_column_nulls(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "nation")
    catalog.add_columns("tpch", "t", "remark string")
    catalog.append("tpch.t", spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("n_nationkey", F.col("n_nationkey") + 100).withColumn("remark", F.lit("new")))
    return catalog.table("tpch.t", ["n_nationkey", "n_name", "remark"])


@query("select n_nationkey, n_regionkey from nation")
def drop_column(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "nation")
    catalog.drop_columns("tpch", "t", "n_name")
    return catalog.table("tpch.t")


@query("select l_returnflag, count(*) as n from lineitem where l_returnflag <> 'A' group by l_returnflag")
def partitioned_write(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "lineitem", partition_by=["l_returnflag"])
    return catalog.table("tpch.t", where="l_returnflag <> 'A'").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""select '{"o_orderstatus": "' || o_orderstatus || '"}' as "partition", cast(count(*) as bigint) as record_count, min(o_orderstatus) as low, max(o_orderstatus) as high from orders group by o_orderstatus""")
def files_metadata_table(spark, sf_dir):
    found = _copied(spark, sf_dir, "orders", partition_by=["o_orderstatus"]).table("tpch.t.files")
    low, high = (F.get_json_object(c, "$.o_orderstatus") for c in ("lower_bounds", "upper_bounds"))
    return found.groupBy("partition").agg(F.sum("record_count").alias("record_count"), F.min(low).alias("low"), F.max(high).alias("high"))


@query("""select '{"o_orderstatus": "' || o_orderstatus || '"}' as "partition", cast(count(*) as bigint) as record_count from orders group by o_orderstatus""")
def partitions_metadata_table(spark, sf_dir):
    return _copied(spark, sf_dir, "orders", partition_by=["o_orderstatus"]).table("tpch.t.partitions").select("partition", "record_count")


@query("select * from (values (1, cast(null as bigint), true), (2, 1, true), (3, 2, true)) t(snapshot_id, parent_id, is_current_ancestor)")
def history_table(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "region")
    catalog.append("tpch.t", spark.read.parquet(f"{sf_dir}/region.parquet"))
    catalog.delete("tpch.t", "r_regionkey = 0")
    return catalog.table("tpch.t.history").select("snapshot_id", "parent_id", "is_current_ancestor")


@query("select * from (values (1, 'append'), (2, 'append'), (3, 'delete')) t(snapshot_id, operation)")
def snapshots_table(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "region")
    catalog.append("tpch.t", spark.read.parquet(f"{sf_dir}/region.parquet"))
    catalog.delete("tpch.t", "r_regionkey = 0")
    return catalog.table("tpch.t.snapshots").select("snapshot_id", "operation")


# ---- versions


@query("select c_custkey, c_acctbal from customer")
def time_travel_version(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "customer")
    before = catalog.latest().number
    catalog.delete("tpch.t", "c_acctbal < 0")
    return catalog.at(version=before).table("tpch.t", ["c_custkey", "c_acctbal"])


@query("select c_custkey, c_acctbal from customer")
def time_travel_timestamp(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "customer")
    then = catalog.latest().created_at
    time.sleep(0.01)
    catalog.update("tpch.t", {"c_acctbal": "0"})
    return catalog.at(timestamp_millis=then).table("tpch.t", ["c_custkey", "c_acctbal"])


@query("select n_nationkey, n_name from nation")
def rollback_version(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "nation")
    before = catalog.latest().number
    catalog.drop_table("tpch", "t")
    catalog.rollback_to(before)
    return catalog.table("tpch.t", ["n_nationkey", "n_name"])


@query("select s_suppkey, s_acctbal from supplier")
def snapshot_export_full(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "supplier")
    target = catalog.export("copy", _place(spark))
    catalog.delete("tpch.t")
    catalog.expire()
    catalog.collect_garbage(older_than_millis=0)
    return connect(spark, target).table("tpch.t", ["s_suppkey", "s_acctbal"])


@query("select s_suppkey, s_acctbal from supplier")
def snapshot_export_minimal(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "supplier")
    return connect(spark, catalog.export("copy", _place(spark), minimal=True)).table("tpch.t", ["s_suppkey", "s_acctbal"])


@query("""with recursive chain(version, previous) as (select cast(4 as bigint), cast(3 as bigint) union all select previous, case when previous > 0 then previous - 1 end from chain where previous is not null)
  select version, 'vn/' || reverse(lpad(bin(version), 64, '0')) as path, case when previous is not null then 'vn/' || reverse(lpad(bin(previous), 64, '0')) end as previous_root from chain""")
def version_chain(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "region")
    for k in range(2):
        catalog.alter_namespace("tpch", set={"k": str(k)})
    return catalog.versions().select("version", "path", "previous_root")


@query("select cast(count(*) as bigint) as orders, cast(count(distinct o_custkey) as bigint) as customers from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def multi_table_atomic_commit(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    with catalog.transaction() as txn:
        for t in ("orders", "customer"):
            txn.create_table("tpch", t, read(t).schema)
            txn.append(f"tpch.{t}", read(t))
    both = catalog.table("tpch.orders").join(catalog.table("tpch.customer", where="c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return both.agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@query("select p_partkey, p_name from part")
def rebase_concurrent_append(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "part", "p_size <= 20")
    mine, other = catalog.begin(), catalog.begin()
    rest = spark.read.parquet(f"{sf_dir}/part.parquet").where("not coalesce(p_size <= 20, false)")
    mine.append("tpch.t", rest.where("p_size <= 35"))
    other.append("tpch.t", rest.where("not coalesce(p_size <= 35, false)"))
    other.commit()
    mine.commit()
    return catalog.table("tpch.t", ["p_partkey", "p_name"])


@query("select n_nationkey, n_name from nation where n_nationkey <> 3")
def conflicting_commit_is_refused(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "nation")
    mine, other = catalog.begin(), catalog.begin()
    mine.update("tpch.t", {"n_name": "'lost'"}, "n_nationkey = 4")
    other.delete("tpch.t", "n_nationkey = 3")
    other.commit()
    try:
        mine.commit()
    except CommitConflict:
        return catalog.table("tpch.t", ["n_nationkey", "n_name"])
    raise AssertionError("a change was lost")


def _matrix_sql(strict: bool) -> str:
    # the rules as sets of types, joined; all other pairs are none
    kinds = ", ".join(f"('{a}')" for a in conflicts.ACTIONS)
    rows = "('TABLE_INSERT', 'TABLE_UPDATE', 'TABLE_DELETE')"
    closed = f"""
        when c.t = p.t and c.t in ('NAMESPACE_DROP', 'TABLE_DROP', 'VIEW_CREATE', 'VIEW_REPLACE', 'VIEW_DROP', 'TABLE_DELETE') then 'unresolvable'
        when c.t like 'NAMESPACE_ALTER%' and (p.t like 'NAMESPACE_ALTER%' or p.t = 'NAMESPACE_DROP') then 'unresolvable'
        when c.t = 'NAMESPACE_DROP' and p.t like 'NAMESPACE_ALTER%' then 'unresolvable'
        when c.t = 'TABLE_DELETE' and p.t = 'TABLE_UPDATE' then 'unresolvable'
        when (c.t like 'TABLE_ALTER%' or c.t in {rows}) and p.t = 'TABLE_DROP' then 'unresolvable'
        when c.t like 'TABLE_ALTER%' and p.t in {rows} then 'resolvable'
        when c.t = 'VIEW_REPLACE' and p.t = 'VIEW_DROP' then 'unresolvable'""" if strict else ""
    return f"""
      with kinds(t) as (values {kinds})
      select c.t as committed_type, p.t as pending_type, case {closed}
        when c.t = p.t and c.t in ('NAMESPACE_CREATE', 'NAMESPACE_ALTER', 'TABLE_CREATE') then 'unresolvable'
        when c.t in ('NAMESPACE_ALTER_SET_PROPERTIES', 'NAMESPACE_ALTER_UNSET_PROPERTIES') and p.t like 'NAMESPACE_ALTER%' then 'unresolvable'
        when c.t like 'TABLE_ALTER%' and p.t like 'TABLE_ALTER%' then 'unresolvable'
        when c.t = 'TABLE_INSERT' and (p.t like 'TABLE_ALTER%' or p.t in {rows}) then 'resolvable'
        when c.t in ('TABLE_UPDATE', 'TABLE_DROP') and (p.t like 'TABLE_ALTER%' or p.t in {rows}) then 'unresolvable'
        when c.t = 'TABLE_DELETE' and (p.t like 'TABLE_ALTER%' or p.t = 'TABLE_INSERT') then 'resolvable'
        when c.t = 'VIEW_DROP' and p.t = 'VIEW_REPLACE' then 'unresolvable' else 'none' end as verdict
      from kinds c cross join kinds p
    """


@query(_matrix_sql(strict=False))
def conflict_matrix(spark, sf_dir):
    return conflicts.matrix_frame(spark)


@query(_matrix_sql(strict=True))
def conflict_matrix_of_commits(spark, sf_dir):
    return conflicts.matrix_frame(spark, strict=True)


@query("""with c as (select distinct cast(o_custkey as varchar) as k, case o_orderstatus when 'F' then 'TABLE_DELETE' when 'O' then 'TABLE_UPDATE' else 'TABLE_INSERT' end as t from orders),
  p as (select distinct cast(c_custkey as varchar) as k, case when c_acctbal < 0 then 'TABLE_UPDATE' when c_acctbal < 5000 then 'TABLE_DELETE' else 'TABLE_INSERT' end as t from customer)
  select c.k as object_key, c.t as committed_type, p.t as pending_type, case when c.t = 'TABLE_UPDATE' or (c.t = 'TABLE_DELETE' and p.t <> 'TABLE_INSERT') then 'unresolvable' else 'resolvable' end as verdict from c join p on c.k = p.k""")
def conflict_analysis(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "TABLE_DELETE").when(F.col("o_orderstatus") == "O", "TABLE_UPDATE").otherwise("TABLE_INSERT")
    committed = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("object_key"), kind.alias("type"))
    kind = F.when(F.col("c_acctbal") < 0, "TABLE_UPDATE").when(F.col("c_acctbal") < 5000, "TABLE_DELETE").otherwise("TABLE_INSERT")
    pending = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("object_key"), kind.alias("type"))
    return conflicts.analyse(committed, pending)


# ---- objects


@query("select * from (values ('a'), ('b'), ('tpch')) t(namespace)")
def show_namespaces(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    catalog.create_namespace("b")
    catalog.create_namespace("a")
    return catalog.sql("show databases").where("namespace <> 'sys'")


@query("select * from (values ('nation'), ('region')) t(name)")
def show_tables(spark, sf_dir):
    return _catalog(spark, sf_dir, "region", "nation").sql("show tables in tpch")


@query("select * from (values ('v1'), ('v2')) t(name)")
def show_views(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "region")
    for v in ("v2", "v1"):
        catalog.sql(f"create view tpch.{v} as select * from tpch.region")
    return catalog.sql("show views in tpch")


@query("select * from (values ('kept', 'table', 'n')) t(namespace, object_type, name)")
def drop_cascade(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "region", "nation")
    catalog.create_view("tpch", "v", "select * from tpch.region")
    catalog.create_namespace("kept")
    catalog.register_table("kept", "n", f"{sf_dir}/nation.parquet")
    catalog.drop_namespace("tpch", CASCADE)
    return catalog.objects().where("object_type <> 'namespace'").select("namespace", "object_type", "name")


@query("select * from (values ('nation')) t(name)")
def tombstone_hidden(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "region", "nation")
    catalog.drop_table("tpch", "region")
    return catalog.sql("show tables in tpch")


@query("select * from (values ('a', '1'), ('c', '4')) t(key, value)")
def namespace_properties(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    catalog.create_namespace("p", {"a": "1", "b": "2", "c": "3"})
    catalog.alter_namespace("p", set={"c": "4"})
    catalog.alter_namespace("p", unset=["b"])
    return spark.createDataFrame(sorted(catalog.describe_namespace("p").items()), "key string, value string")


@query("select n_name, 'C===' || rpad(r_name, 16, ' ') || rpad(n_name, 12, ' ') as table_key, 'B===' || rpad(r_name, 16, ' ') as namespace_key from nation join region on n_regionkey = r_regionkey")
def object_keys(spark, sf_dir):
    k = Keys(namespace=16, table=12)
    both = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_name", k.column("table", F.col("r_name"), F.col("n_name")).alias("table_key"), k.column("namespace", F.col("r_name")).alias("namespace_key"))


@query("select 'table' as kind, r_name as namespace, n_name as name from nation join region on n_regionkey = r_regionkey")
def decode_keys(spark, sf_dir):
    k, key = Keys(namespace=16, table=12), F.col("table_key")
    return object_keys(spark, sf_dir).select(k.kind_column(key).alias("kind"), k.namespace_column(key).alias("namespace"), k.name_column(key).alias("name"))


@query("select o_orderkey as version, 'vn/' || reverse(lpad(bin(o_orderkey), 64, '0')) as path from orders")
def version_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("version"), paths.root_column(F.col("o_orderkey")).alias("path"))


@query("select o_orderkey as version, 'vn/' || reverse(lpad(bin(o_orderkey), 64, '0')) as path, o_orderkey as back from orders")
def version_paths_inverse(spark, sf_dir):
    return version_paths(spark, sf_dir).withColumn("back", paths.version_column(F.col("path")))


# ---- the ordered map

_ENTRIES = "select 'k' || lpad(cast(o_orderkey as varchar), 10, '0') as key, o_orderpriority as value from orders"
# changes are known by the orders' lines: returned ones are removed, others that were shipped early changed, and two more than the table has are new
_CHANGES = "select 'k' || lpad(cast(l_orderkey as varchar), 10, '0') as key, case when max(l_returnflag) < 'R' then 'new ' || max(l_returnflag) end as value from lineitem group by l_orderkey having min(l_shipdate) < timestamp '1998-01-01 00:00:00' union all select 'k' || lpad(cast(max(o_orderkey) + 1 as varchar), 10, '0'), 'added' from orders"


def _key(column) -> Column:
    return F.concat(F.lit("k"), F.lpad(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), 10, "0"))


def _entries(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(_key("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))


def _changes(spark, sf_dir) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"), F.min("l_shipdate").alias("at"))
    changed = lines.where("at < timestamp_ntz '1998-01-01 00:00:00'").select(_key("l_orderkey").alias("key"), F.when(F.col("flag") < "R", F.concat(F.lit("new "), "flag")).alias("value"))
    return changed.unionByName(spark.read.parquet(f"{sf_dir}/orders.parquet").agg((F.max("o_orderkey") + 1).alias("k")).select(_key("k").alias("key"), F.lit("added").alias("value")))


@query(f"with e as ({_ENTRIES}), c as ({_CHANGES}) select key, value from (select * from c union all select * from e where key not in (select key from c)) where value is not null")
def merge_pending_over_persisted(spark, sf_dir):
    return merge.live(merge.upsert(_entries(spark, sf_dir), _changes(spark, sf_dir)))


@query("select r_name as key, cast(row_number() over (order by r_name) as integer) as position from region")
def key_order_scan(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    names = [r.r_name for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]  # objects are made one by one
    with catalog.transaction() as txn:
        for n in sorted(names, reverse=True):
            txn.create_namespace(n)
    found = [n for n in catalog.show_namespaces() if n in names]
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(found)], "key string, position int")


@query("select c_nationkey as node, c_name as key, cast(rn as integer) as position, case when rn = 64 then 'pivot' when rn < 64 then 'left' else 'right' end as side from (select c_nationkey, c_name, row_number() over (partition by c_nationkey order by c_name) as rn from customer)")
def split_pivot(spark, sf_dir):
    entries = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("node"), F.col("c_name").alias("key"))
    return merge.split(entries, 128, within=["node"]).select("node", "key", "position", "side")


@query(f"select key, value, position, case when position = 64 then 'pivot' when position < 64 then 'left' else 'right' end as side from (select key, value, cast(row_number() over (order by key) as integer) as position from ({_ENTRIES}))")
def split_of_one_node(spark, sf_dir):
    return merge.split(_entries(spark, sf_dir), 128).select("key", "value", "position", "side")


@query(f"with e as ({_ENTRIES}), t as (select distinct 'k' || lpad(cast(l_orderkey as varchar), 10, '0') || 'x' as target from lineitem) select target, max(e.key) as key from t left join e on e.key <= t.target group by target")
def floor_lookup(spark, sf_dir):
    targets = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("k"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("x")).alias("target")).distinct()
    return merge.floor_lookup(_entries(spark, sf_dir), targets, "target").select("target", "key")


@query(f"select key, value from ({_ENTRIES}) where starts_with(key, 'k00000001')")
def prefix_scan(spark, sf_dir):
    return merge.starting_with(_entries(spark, sf_dir), "k00000001")


# ---- views


@query("select r_name, cast(count(*) as bigint) as nations from nation join region on n_regionkey = r_regionkey group by r_name")
def view_select(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "nation", "region")
    catalog.create_view("tpch", "pairs", "select r_name, n_name from nation join region on n_regionkey = r_regionkey")
    catalog.create_view("tpch", "sizes", "select r_name, count(*) as nations from pairs group by r_name")
    return catalog.view("tpch.sizes")


@query("select n_name from nation where n_regionkey = 1")
def view_replace(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "nation")
    catalog.create_view("tpch", "v", "select n_nationkey from nation")
    catalog.create_view("tpch", "v", "select n_name from nation where n_regionkey = 1", replace=True)
    return catalog.sql("select * from tpch.v")


@query("select * from (values ('v', 'tpch.nation'), ('v', 'tpch.region')) t(view, reference)")
def view_references(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "nation", "region")
    catalog.create_view("tpch", "v", "select n_name from nation where n_regionkey in (select r_regionkey from tpch.region)")
    return spark.createDataFrame([("v", r) for r in catalog.describe_view("tpch", "v")["references"]], "view string, reference string")


# ---- transactions across sessions, and SQL


@query("select n_nationkey from nation union all select n_nationkey + 1000 from nation")
def dist_txn_publish(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "nation")
    txn = catalog.begin(id="audit")
    txn.append("tpch.t", spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("n_nationkey", F.col("n_nationkey") + 1000))
    txn.save()
    other = connect(spark, str(catalog.storage.root))  # as another session
    resumed = other.load_distributed("audit")
    assert resumed.table("tpch.t").count() == 2 * other.table("tpch.t").count()
    resumed.commit()
    return other.table("tpch.t", ["n_nationkey"])


@query("select r_regionkey, r_name from region union all select 77, 'x'")
def sql_begin_commit(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "region")
    for s in ("BEGIN TRANSACTION", "insert into tpch.t values (77, 'x')", "commit"):
        catalog.sql(s)
    return catalog.sql("select r_regionkey, r_name from tpch.t")


@query("select r_regionkey, r_name from region")
def sql_rollback(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "region")
    for s in ("begin", "delete from tpch.t where r_regionkey > 1", "insert into tpch.t values (77, 'x')", "ROLLBACK TRANSACTION"):
        catalog.sql(s)
    return catalog.sql("select r_regionkey, r_name from tpch.t")


@query("select o_orderkey, o_totalprice from orders")
def sql_time_travel(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "orders")
    at = catalog.latest().number
    catalog.sql("delete from tpch.t where o_orderstatus = 'F'")
    return catalog.sql(f"select o_orderkey, o_totalprice from tpch.t version as of {at}")


@query("select s_suppkey, case when s_nationkey = 5 then s_name || '!' else s_name end as s_name, s_acctbal from supplier where not coalesce(s_acctbal < 0, false)")
def sql_update_delete(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "supplier")
    catalog.sql("update tpch.t set s_name = concat(s_name, '!') where s_nationkey = 5")
    catalog.sql("delete from tpch.t where s_acctbal < 0")
    return catalog.sql("select s_suppkey, s_name, s_acctbal from tpch.t")


@query("select n_name, cast(count(*) as bigint) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey where c_acctbal > (select avg(c_acctbal) from customer) group by n_name")
def sql_join_subquery(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "customer", "nation")
    return catalog.sql("select n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from tpch.customer c join tpch.nation on c_nationkey = n_nationkey where c_acctbal > (select avg(c_acctbal) from tpch.customer) group by n_name")


@query("select o_orderpriority, cast(count(*) as bigint) as n from orders group by o_orderpriority")
def sql_create_table_as(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "orders")
    catalog.sql("create table tpch.sums as select o_orderpriority, count(*) as n from tpch.orders group by o_orderpriority")
    return catalog.table("tpch.sums")


@query("select * from (values ('BOOLEAN', 'boolean'), ('INT2', 'smallint'), ('INT4', 'int'), ('INT8', 'bigint'), ('FLOAT4', 'float'), ('FLOAT8', 'double'), ('VARCHAR', 'string'), ('DATE', 'date'), ('TIMESTAMP3', 'timestamp_ntz'), ('TIMESTAMP6', 'timestamp_ntz'), ('TIMESTAMP9', 'timestamp_ntz'), ('TIMESTAMPTZ3', 'timestamp'), ('TIMESTAMPTZ6', 'timestamp'), ('TIMESTAMPTZ9', 'timestamp'), ('BINARY', 'binary'), ('FIXED', 'binary'), ('DECIMAL', 'decimal(38,10)')) t(native, spark_type)")
def schema_type_map(spark, sf_dir):
    plain = [n for n in types.NAMES if not n.startswith("TIME") or n.startswith("TIMESTAMP")]
    rows = [(n, types.to_spark({"name": "c", "type": n}).dataType.simpleString()) for n in plain if n not in ("STRUCT", "LIST", "MAP", "CHAR")]
    return spark.createDataFrame(rows, "native string, spark_type string")


@query("select * from (values ('data'), ('def'), ('meta'), ('vn')) t(folder)")
def unreachable_files(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "region")
    catalog.overwrite("tpch.t", spark.read.parquet(f"{sf_dir}/region.parquet"))
    catalog.drop_table("tpch", "t")
    return spark.createDataFrame([(p.split("/")[0],) for p in catalog.expire()], "folder string").distinct()


@query("select 'table' as object_type, 'tpch' as namespace, t.name from (values ('lineitem'), ('nation'), ('orders')) t(name)")
def catalog_nodes_source(spark, sf_dir):
    from lakeloom.sources import nodes

    catalog = _catalog(spark, sf_dir, "lineitem", "nation", "orders")
    nodes.register(spark)
    k, key = catalog.keys, F.col("key")
    rows = spark.read.format("catalog_nodes").option("path", str(catalog.storage.root)).load().where(key.startswith(k.prefix("table", "tpch")))
    return rows.select(k.kind_column(key).alias("object_type"), k.namespace_column(key).alias("namespace"), k.name_column(key).alias("name"))


@query("select * from (values ('NAMESPACE_CREATE', 'tpch'), ('TABLE_CREATE', 't'), ('TABLE_INSERT', 't')) t(type, object)")
def action_log(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "region")
    both = catalog.at(version=1).actions().unionByName(catalog.at(version=2).actions())
    return both.select("type", F.coalesce("name", "namespace").alias("object"))


# ---- types, pruning and layout


def _zoned(spark, sf_dir) -> DataFrame:
    """Orders with their date as a time in UTC."""
    d = "o_orderdate"
    at = F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), F.hour(d), F.minute(d), F.second(d), F.lit("UTC"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", at.alias("at"))


@query("select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1997-05-31 22:00:00'")
def append_timestamp(spark, sf_dir):
    catalog, df = _catalog(spark, sf_dir), _zoned(spark, sf_dir)
    catalog.create_table("tpch", "t", df.schema, sort_by=["at"])
    catalog.append("tpch.t", df)
    return catalog.table("tpch.t", ["o_orderkey", "o_totalprice"], "at >= timestamp '1997-06-01 00:00:00+02:00'")


# condition on the catalog's table, and the same in plain SQL
_PRUNED = {
    "date as text": ("d >= '1997-1-5'", "o_orderdate >= timestamp '1997-01-05 00:00:00'"),
    "days": ("d = date '1998-02-03'", "cast(o_orderdate as date) = date '1998-02-03'"),
    "escape": (r"s = 'F\tO'", "o_orderstatus = 'F'"),
    "zone": ("at < timestamp '1995-01-01 02:00:00+02:00'", "o_orderdate < timestamp '1995-01-01 00:00:00'"),
    "between": ("o_totalprice between 1000 and 50000.5", "o_totalprice between 1000 and 50000.5"),
    "in": ("o_orderstatus in ('P', 'X')", "o_orderstatus in ('P', 'X')"),
    "wider literal": ("o_custkey > 100 and 5000000000 > o_custkey", "o_custkey > 100"),
    "either": ("o_totalprice < 1000 or o_orderstatus = 'O'", "o_totalprice < 1000 or o_orderstatus = 'O'"),
}


@query(" union all ".join(f"select '{k}' as name, cast(count(*) as bigint) as n from orders where {sql}" for k, (_, sql) in _PRUNED.items()))
def prune_equals_plain_scan(spark, sf_dir):
    catalog, orders = _catalog(spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = orders.join(_zoned(spark, sf_dir).select("o_orderkey", "at"), "o_orderkey").withColumns({"d": F.col("o_orderdate").cast("date"), "s": F.concat("o_orderstatus", F.lit("\tO"))})
    catalog.create_table("tpch", "t", df.schema, ["months(o_orderdate)"], ["o_orderstatus"])
    catalog.append("tpch.t", df)
    parts = [catalog.table("tpch.t", where=c).agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, (c, _) in _PRUNED.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("select strftime(l_shipdate, '%Y-%m') as shipped, l_returnflag as flag, cast(count(*) as bigint) as n from lineitem group by 1, 2")
def partition_transforms(spark, sf_dir):
    catalog, lines = _catalog(spark, sf_dir), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    catalog.create_table("tpch", "t", lines.schema, ["months(l_shipdate)", "truncate(1, l_returnflag)", "bucket(2, l_suppkey)"])
    catalog.append("tpch.t", lines)
    value = lambda spec: F.get_json_object("partition", f"$['{spec}']")
    found = catalog.table("tpch.t.files").select(value("months(l_shipdate)").alias("shipped"), value("truncate(1, l_returnflag)").alias("flag"), "record_count")
    return found.groupBy("shipped", "flag").agg(F.sum("record_count").alias("n"))


@query("select '[\"o_orderstatus\"]' as fields, cast(count(*) as bigint) as n from orders where o_orderstatus <> 'F' union all select '[\"years(o_orderdate)\"]', cast(count(*) as bigint) from orders where o_orderstatus = 'F'")
def partition_evolution(spark, sf_dir):
    catalog, orders = _catalog(spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet")
    catalog.create_table("tpch", "t", orders.schema, ["o_orderstatus"])
    catalog.append("tpch.t", orders.where("o_orderstatus <> 'F'"))
    catalog.sql("alter table tpch.t drop partition field o_orderstatus")
    catalog.sql("alter table tpch.t add partition field years(o_orderdate)")
    catalog.append("tpch.t", orders.where("o_orderstatus = 'F'"))
    found = catalog.table("tpch.t.files").select(F.to_json(F.json_object_keys("partition")).alias("fields"), "record_count")
    return found.groupBy("fields").agg(F.sum("record_count").alias("n"))


@query("select n_nationkey as nation, cast(n_regionkey as bigint) as n_regionkey, cast(null as varchar) as n_name from nation union all select n_nationkey + 100, cast(n_regionkey as bigint) + 5000000000, n_name from nation")
def column_evolution(spark, sf_dir):
    catalog, nation = _copied(spark, sf_dir, "nation"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    for s in ("rename column n_nationkey to nation", "alter column n_regionkey type bigint", "drop column n_name", "add column n_name string"):
        catalog.sql(f"alter table tpch.t {s}")
    catalog.append("tpch.t", nation.select((F.col("n_nationkey") + 100).alias("nation"), (F.col("n_regionkey") + F.lit(5000000000)).alias("n_regionkey"), "n_name"))
    return catalog.table("tpch.t", ["nation", "n_regionkey", "n_name"])


@query("select s_suppkey, s_name, s_acctbal from supplier where s_acctbal > 1000")
def orc_table(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "supplier")
    catalog.sql("create table tpch.t using orc as select * from tpch.supplier")
    catalog.delete("tpch.t", "not s_acctbal > 1000")
    return catalog.table("tpch.t", ["s_suppkey", "s_name", "s_acctbal"], "s_acctbal > 1000")


@query("select cast(count(*) as bigint) as snapshots, 1 as live, 40 as appends, cast(count(*) * 5 as bigint) as n from range(40)")
def many_appends(spark, sf_dir):
    catalog, region = _catalog(spark, sf_dir), spark.read.parquet(f"{sf_dir}/region.parquet")
    catalog.create_table("tpch", "t", region.schema)
    for _ in range(40):
        catalog.append("tpch.t", region)
    held = catalog.table("tpch.t.history").agg(F.count("*").alias("snapshots"), F.lit(1).alias("live"), F.lit(40).alias("appends"))
    return held.crossJoin(catalog.table("tpch.t").agg(F.count("*").alias("n")))  # one row each


@query("select * from (values ('all_data_files', 5), ('all_entries', 5), ('all_manifests', 4), ('data_files', 3), ('delete_files', 0), ('entries', 3), ('metadata_log_entries', 3), ('refs', 1)) t(name, n)")
def metadata_tables(spark, sf_dir):
    catalog, region = _catalog(spark, sf_dir), spark.read.parquet(f"{sf_dir}/region.parquet").coalesce(1)
    catalog.create_table("tpch", "t", region.schema)
    for _ in range(2):
        catalog.append("tpch.t", region)
    with catalog.transaction() as txn:
        txn.overwrite("tpch.t", region.withColumn("r_name", F.lit("x")).unionByName(region).repartitionByRange(3, "r_regionkey", "r_name"))
    rows = [(n, catalog.table(f"tpch.t.{n}").count()) for n in ("all_data_files", "all_entries", "all_manifests", "data_files", "delete_files", "entries", "metadata_log_entries", "refs")]
    return spark.createDataFrame(rows, "name string, n int")


@query("select c_custkey, c_name from customer")
def gc_beside_open_txn(spark, sf_dir):
    catalog, rest = _copied(spark, sf_dir, "customer", "c_acctbal > 0"), spark.read.parquet(f"{sf_dir}/customer.parquet").where("not coalesce(c_acctbal > 0, false)")
    txn = catalog.begin()
    txn.append("tpch.t", rest)
    catalog.expire()
    catalog.collect_garbage()
    txn.commit()
    return catalog.table("tpch.t", ["c_custkey", "c_name"])


@query("select s_suppkey, s_name from supplier union all select cast(r_regionkey as bigint), r_name from region")
def snapshot_export_partial(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "supplier")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    catalog.create_table("tpch", "small", region.schema)
    catalog.append("tpch.small", region)
    copy = connect(spark, catalog.export("part", _place(spark), only=["tpch.t"]))
    catalog.drop_table("tpch", "t")
    catalog.expire()
    catalog.collect_garbage(older_than_millis=0)  # the exported table's files are its own, the other's are still here
    return copy.table("tpch.t", ["s_suppkey", "s_name"]).union(copy.table("tpch.small", ["r_regionkey", "r_name"]))


# ---- objects that are there or not, and what is said of them


@query("select * from (values ('catalog', true, false), ('namespace', true, false), ('table', true, false), ('view', true, false)) t(kind, present, absent)")
def object_existence(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "region")
    catalog.create_view("tpch", "v", "select * from tpch.region")
    none = connect(spark, _place(spark))
    rows = [
        ("catalog", catalog.exists(), none.exists()),
        ("namespace", catalog.namespace_exists("tpch"), catalog.namespace_exists("other")),
        ("table", catalog.table_exists("tpch", "region"), catalog.table_exists("tpch", "v")),
        ("view", catalog.view_exists("tpch", "v"), catalog.view_exists("tpch", "region")),
    ]
    return spark.createDataFrame(rows, "kind string, present boolean, absent boolean")


@query("select * from (values ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) t(col_name, data_type)")
def describe_table(spark, sf_dir):
    return _catalog(spark, sf_dir, "customer").sql("describe table tpch.customer").select("col_name", "data_type")


@query("select * from (values ('Namespace', 'p'), ('a', '1')) t(info_name, info_value)")
def describe_namespace(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    catalog.sql("create database p with dbproperties ('a' = '1')")
    return catalog.sql("describe database p")


@query("select * from (values ('kept', '1'), ('new', '2')) t(key, value)")
def alter_table_properties(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "region")
    catalog.alter_table("tpch", "region", set={"kept": "1", "gone": "x"})
    catalog.sql("alter table tpch.region set tblproperties ('new' = '2')")
    catalog.sql("alter table tpch.region unset tblproperties ('gone')")
    return spark.createDataFrame(sorted(catalog.describe_table("tpch", "region")["properties"].items()), "key string, value string")


@query("select n_nationkey, n_name from nation")
def rename_table(spark, sf_dir):
    catalog = _copied(spark, sf_dir, "nation")
    catalog.sql("alter table tpch.t rename to tpch.nations")
    assert catalog.show_tables("tpch") == ["nations"]
    return catalog.table("tpch.nations", ["n_nationkey", "n_name"])


@query("select * from (values ('kept')) t(name)")
def drop_view(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "region")
    for v in ("kept", "gone"):
        catalog.create_view("tpch", v, "select * from tpch.region")
    catalog.sql("drop view tpch.gone")
    return catalog.sql("show views in tpch")


@query("select r_regionkey, r_name from region")
def substrait_view(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "region")

    def part(number: int, *values: bytes) -> bytes:  # a field of a message, repeated
        return b"".join(bytes([number << 3 | 2, len(v)]) + v for v in values)

    plan = part(1, part(2, part(1, b"r_regionkey", b"r_name")) + part(7, part(1, b"tpch", b"region")))
    catalog.create_opaque_view("tpch", "v", plan, ["tpch.region"])
    return catalog.view("tpch.v")


@query("select n_nationkey, n_name from nation")
def registered_odd_file_name(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    at = f"{catalog.storage.root}/elsewhere/my file+1%.parquet"
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(at)
    catalog.register_table("tpch", "t", at)
    return catalog.table("tpch.t", ["n_nationkey", "n_name"])


@query("select r_regionkey, r_name from region union all select 77, 'x'")
def session_sql(spark, sf_dir):
    from lakeloom.plans import session

    catalog = _copied(spark, sf_dir, "region")
    session.attach(spark, catalog, "lake")
    try:
        spark.sql("BEGIN")
        spark.sql("insert into lake.tpch.t values (77, 'x')")
        spark.sql("COMMIT")
        return spark.sql("select r_regionkey, r_name from lake.tpch.t")
    finally:
        session.detach(spark)


@query("select * from (values ('meta', 'work'), ('meta.work', 'w_7')) t(parent, name)")
def system_names(spark, sf_dir):
    catalog = connect(spark, _place(spark), create=True, **{"system.ns-name": "meta", "dtxn.parent-ns-name": "work", "dtxn.prefix": "w_"})
    catalog.sql("create database meta.work.w_7")
    rows = [(p, r.namespace) for p in ("meta", "meta.work") for r in catalog.sql(f"show databases in {p}").collect()]
    return spark.createDataFrame(rows, "parent string, name string")


# ---- the stored tree


def _planted(spark, sf_dir) -> tuple[Tree, Node, DataFrame]:
    """A written tree of small nodes over all customers, put in the order of their names' ends, and the entries that it was made of."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ranges = forest.dealt(customers.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.reverse("c_name").alias("turn")))
    tree = Tree(open_storage(_place(spark)), order=8)
    return tree, forest.plant(ranges, tree), ranges


def _stored(spark, rows: DataFrame) -> DataFrame:
    at = f"{_place(spark)}/rows"
    rows.write.parquet(at)
    return spark.read.parquet(at)


_RANKED = "select c_name as key, c_mktsegment as value, cast(row_number() over (order by c_name) as integer) as position from customer"


@query(f"select 'dirty' as state, key, value, position from ({_RANKED}) union all select 'persisted', key, value, position from ({_RANKED})")
def tree_scan_dirty_and_persisted(spark, sf_dir):
    tree, top, ranges = _planted(spark, sf_dir)
    scans = {"dirty": forest.scan_unwritten(ranges, tree.order), "persisted": forest.scan(spark, tree, top)}
    rows = [forest.positions(_stored(spark, found)).select(F.lit(state).alias("state"), "key", "value", "position") for state, found in scans.items()]
    return rows[0].unionByName(rows[1])


@query("select c_name as target, c_mktsegment as found, c_name as floor, c_name as floor_after from customer")
def tree_lookup(spark, sf_dir):
    tree, top, entries = _planted(spark, sf_dir)
    ask = lambda t, top, k: (k, t.get(top, k), t.floor(top, k)[0], t.floor(top, k + "!")[0])
    return forest.ask(tree, top, entries.select("key"), ask, "target string, found string, floor string, floor_after string")


@query("select cast(count(*) as bigint) as keys, true as sorted, true as within_order, true as one_height from customer")
def tree_split_invariants(spark, sf_dir):
    tree, top, _ = _planted(spark, sf_dir)
    found = forest.shape(spark, tree, top)
    halves = found["least"] >= 3 and found["most"] < 7  # a full node of 7 keys is halved around its pivot
    return spark.createDataFrame([(found["keys"], found["sorted"], halves, len(found["heights"]) == 1)], "keys long, sorted boolean, within_order boolean, one_height boolean")


@query("select 'changed' as state, true as one_path, cast(count(*) as bigint) as keys from customer")
def tree_change_writes_one_path(spark, sf_dir):
    tree, top, entries = _planted(spark, sf_dir)
    key, made, create = entries.first().key, [], tree.storage.create
    tree.storage.create = lambda path, data: (made.append(path), create(path, data))  # all that is written from here on
    changed = tree.write(tree.put(top, key, "changed"))
    assert all(tree.storage.exists(p) for p in made)
    return forest.scan(spark, tree, changed).agg(F.lit(tree.get(changed, key)).alias("state"), F.lit(len(made) <= tree.height(top)).alias("one_path"), F.count("*").alias("keys"))


@query("select * from (values ('catalog_def'), ('created_at_millis'), ('n_actions'), ('n_keys'), ('previous_root')) t(key)")
def system_rows(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "region")
    root = from_arrow(catalog.storage.read(paths.root(catalog.latest().number)))
    assert all(k in SYSTEM_KEYS and not k.startswith(("B", "C", "D")) for k in root.system)  # they sort before all objects
    return spark.createDataFrame([(k,) for k in sorted(root.system)], "key string")


@query("select * from (values ('/a/b', 'file', '', '/a/b'), ('hdfs://n:8020/w/', 'hdfs', 'n:8020', '/w'), ('s3://bucket/a%20b?x=1#f', 's3', 'bucket', '/a%20b')) t(text, scheme, authority, path)")
def store_uris(spark, sf_dir):
    uris = [(t, URI(t)) for t in ("/a/b", "hdfs://n:8020/w/", "s3://bucket/a%20b?x=1#f")]
    return spark.createDataFrame([(t, u.scheme, u.authority, u.path) for t, u in uris], "text string, scheme string, authority string, path string")


@query("select * from (values ('hadoop', 'first', 3, true), ('local', 'first', 3, true)) t(kind, content, files, second_refused)")
def store_contract(spark, sf_dir):
    """The same steps on both writable stores, with a small delete batch."""
    rows = []
    for kind in ("local", "hadoop"):
        store = open_storage(f"file://{_place(spark).removeprefix('file://')}", kind, **{"delete-batch-size": "2"})
        assert store.delete_batch == 2
        store.create("a/one", b"first")
        try:
            store.create("a/one", b"second")
            refused = False
        except SealFailure:
            refused = True
        for n in ("a/two", "b/three", "gone"):
            store.overwrite(n, b"x")
        store.delete(["gone"])
        rows.append((kind, store.read("a/one").decode(), len(store.list()), refused))
    return spark.createDataFrame(rows, "kind string, content string, files int, second_refused boolean")
