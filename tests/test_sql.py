import pytest
from pyspark.sql.types import StructType

from lakeloom import errors
from lakeloom.operators import table
from lakeloom.operators.catalog import connect
from lakeloom.plans import pruning, session
from lakeloom.plans import sql as front
from lakeloom.sources import nodes
from lakeloom.streaming import versions


@pytest.fixture
def cat(spark, tmp_path):
    c = connect(spark, str(tmp_path / "w"))
    c.sql("CREATE DATABASE sys WITH DBPROPERTIES ('order' = '8', 'txn-isolation-level' = 'SNAPSHOT')")
    c.sql("create namespace if not exists db with properties ('a' = 'b')")
    c.sql("create table db.t (id int, v string) using parquet partitioned by (v) tblproperties ('x' = 'y')")
    c.sql("insert into db.t values (1, 'one'), (2, 'two'), (3, 'it''s')")
    return c


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_statements(cat):
    assert cat.definition["order"] == 8 and cat.describe_table("db", "t")["partition_by"] == ["v"]
    assert values(cat.sql("select * from db.t where v = 'it''s'")) == [(3, "it's")]
    cat.sql("insert into table db.t (v, id) select concat(v, '-from db.t'), id + 10 from db.t where id = 1")
    assert values(cat.sql("select id, v from db.t where id > 10")) == [(11, "one-from db.t")]
    cat.sql("update db.t set v = concat(v, ',', 'x'), id = id * 2 where id = 2 -- a comment")
    cat.sql("/* delete */ delete from db.t where id in (1, 11);")
    assert values(cat.sql("table db.t" if False else "select * from db.t")) == [(3, "it's"), (4, "two,x")]
    cat.sql("insert overwrite db.t values (7, 'only')")
    assert values(cat.sql("select * from db.t")) == [(7, "only")]
    assert values(cat.sql("show tables in db")) == [("t",)] and values(cat.sql("show databases")) == [("db",), ("sys",)]
    cat.sql("alter database db set dbproperties ('c' = 'd')")
    cat.sql("alter database db unset dbproperties ('a')")
    assert cat.describe_namespace("db") == {"c": "d"}
    cat.sql("alter table db.t add columns (more int, z string)")
    cat.sql("alter table db.t drop column z")
    cat.sql("alter table db.t set tblproperties ('k' = 'v')")
    cat.sql("alter table db.t rename to u")
    assert cat.table("db.u").columns == ["id", "v", "more"] and cat.describe_table("db", "u")["properties"] == {"x": "y", "k": "v"}
    cat.sql("create table if not exists db.u (id int)")
    cat.sql("create table db.w as with c as (select id from db.u) select id, 1 as one from c")
    assert values(cat.sql("select * from db.w")) == [(7, 1)]
    before = cat.latest().number
    cat.sql("create or replace table db.w as select id, 'two' as two, 2 as n from db.w")
    assert values(cat.sql("select id, two, n from db.w")) == [(7, "two", 2)] and values(cat.sql(f"select * from db.w version as of {before}")) == [(7, 1)]
    cat.sql("create view db.vw as select id from db.w")
    cat.sql("create or replace view db.vw as select id + 1 as id from db.w")
    assert values(cat.sql("select vw.id from db.vw join db.w on vw.id = w.id + 1")) == [(8,)] and values(cat.sql("show views in db")) == [("vw",)]
    cat.sql("drop view db.vw")
    cat.sql("drop table if exists db.nothing")
    with pytest.raises(errors.NotEmpty):
        cat.sql("drop database db")
    cat.sql("drop database db cascade")
    assert values(cat.sql("show namespaces")) == [("sys",)]
    assert values(cat.sql("select 1 as a")) == [(1,)]


def test_transactions(cat):
    cat.sql("begin transaction")
    cat.sql("insert into db.t values (9, 'nine')")
    assert cat.sql("select * from db.t").count() == 4 and cat.latest().table("db.t").count() == 3
    with pytest.raises(errors.InvalidArgument):
        cat.sql("begin")
    cat.sql("  COMMIT ;")
    assert cat.latest().table("db.t").count() == 4
    cat.sql("BEGIN")
    cat.sql("delete from db.t")
    assert cat.sql("select * from db.t").count() == 0
    cat.sql("ROLLBACK TRANSACTION")
    assert cat.sql("select * from db.t").count() == 4
    for s in ("commit", "rollback"):
        with pytest.raises(errors.TransactionClosed):
            cat.sql(s)
    assert cat.sql("begin select 5 as x; end").count() == 1  # a Spark script is left to Spark


def test_time_travel(cat):
    v, at = cat.latest().number, cat.latest().created_at
    cat.sql("delete from db.t where id = 1")
    assert cat.sql(f"select * from db.t version as of {v}").count() == 3
    assert cat.sql(f"select a.id from db.t for version as of '{v}' as a left anti join db.t b on a.id = b.id").count() == 1
    assert cat.sql(f"select * from db.t timestamp as of '{at}'").count() == 3
    assert cat.sql("select * from db.t timestamp as of '2999-01-01 00:00:00'").count() == 2
    assert cat.sql("select * from db.t.history").count() == 2 and cat.sql("select count(*) from sys.versions").first()[0] == cat.latest().number + 1


def test_saved_transactions(cat, spark):
    cat.sql("create database sys.dtxns.dtxn_1234")
    assert values(cat.sql("show databases in sys.dtxns")) == [("dtxn_1234",)]
    cat.sql("insert into sys.dtxns.dtxn_1234.db.t values (5, 'five')")
    cat.sql("create database sys.dtxns.dtxn_1234.fresh")
    other = connect(spark, str(cat.storage.root))
    assert other.sql("select * from sys.dtxns.dtxn_1234.db.t").count() == 4 and other.sql("select * from db.t").count() == 3
    assert values(other.sql("show databases in sys.dtxns.dtxn_1234")) == [("db",), ("fresh",)]
    other.sql("alter database sys.dtxns.dtxn_1234 set dbproperties ('commit' = 'true')")
    assert cat.sql("select * from db.t").count() == 4 and cat.namespace_exists("fresh") and cat.show_distributed() == []
    cat.sql("create database sys.dtxns.dtxn_x")
    cat.sql("drop database sys.dtxns.dtxn_x")
    assert cat.show_distributed() == []


def test_prefix_of_saved_transactions(spark, tmp_path):
    c = connect(spark, str(tmp_path), create=True, **{"dtxn.ns-prefix": "wip_"})
    c.sql("create database sys.dtxns.wip_7")
    c.sql("create database sys.dtxns.wip_7.made")
    assert c.show_distributed() == ["7"] and values(c.sql("show databases in sys.dtxns")) == [("wip_7",)]
    c.sql("alter database sys.dtxns.wip_7 set dbproperties ('commit' = 'true')")
    assert c.namespace_exists("made")


def test_references():
    q = "with c as (select 'from x.y' as s from a.b) select * from c, d.e f, g.h join i on 1 = 1 where k in (select z from j.k) -- from n.o\n"
    assert front.references(q, "ns") == ["a.b", "d.e", "g.h", "j.k", "ns.i"]
    with pytest.raises(errors.InvalidArgument):
        front.references("select * from alone")


def test_comparisons(spark):
    schema = StructType.fromDDL("a int, b string, c double, d date, f timestamp, g decimal(10,2)")
    found = lambda c: sorted(pruning.comparisons(spark, schema, c), key=str)
    assert found("a > 5 and b = 'x and y' and c between 1 and 2 and abs(a) = 3") == [("a", ">", 5), ("b", "=", "x and y"), ("c", "<=", 2.0), ("c", ">=", 1.0)]
    assert found("d >= '2020-1-5'") == [("d", ">=", 18266)] and found(r"b = 'a\tb'") == [("b", "=", "a\tb")] and found("7 < a") == [("a", ">", 7)]
    assert found("f = timestamp '1970-01-01 01:00:00+01:00'") == [("f", "=", 0)] and found("a in (1, 2, null)") == [] and found("a in (1, 2)") in ([("a", "in", [1, 2])], [("a", "in", [2, 1])])
    for none in (None, "true", "a > 5 or b = 'x'", "not a = 1", "g = 1", "b = 5", "a = null", "rand() < 0.5"):
        assert found(none) == [], none


def test_pruning(spark):
    schema = StructType.fromDDL("a int, s string, t timestamp_ntz, u int")
    low, high = {"a": 1, "s": "b", "t": "2020-01-01 00:00:00"}, {"a": 9, "s": "d", "t": "2020-02-01 00:00:00"}
    kinds = {f.name: f.dataType for f in schema}
    for text, want in (("a = 10", False), ("a = 9", True), ("a < 1", False), ("a <= 1", True), ("a > 9", False), ("s = 'c'", True), ("s > 'd'", False), ("t > date '2020-01-31'", True), ("t >= date '2020-02-02'", False), ("u = 1", True), ("a in (10, 11)", False), ("a in (10, 9)", True)):
        assert pruning.may_match(low, high, pruning.comparisons(spark, schema, text), kinds) == want, text


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_scan_equals_an_unpruned_scan(spark, tmp_path, zone):
    """Many small files, so that nearly every one can be left out, against Spark's own filter over all rows."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        cat = connect(spark, str(tmp_path), create=True)
        cat.create_namespace("n")
        df = spark.range(400).selectExpr(
            "cast(id as int) as i", "cast(id % 7 as double) / 2 as x", "if(id % 50 = 0, null, concat('k\t', id % 40)) as s", "date_add(date '2019-12-20', cast(id as int)) as d",
            "timestamp_millis(id * 3600000) as t", "cast(date '2020-01-01' as timestamp_ntz) + make_interval(0, 0, 0, 0, cast(id as int)) as n", "cast(id as decimal(12, 2)) as p", "id % 2 = 0 as b",
        )
        cat.create_table("n", "t", df.schema, ["truncate(20, i)"])
        cat.append("n.t", df)
        plain = cat.table("n.t").cache()
        for c in (
            "d >= '2020-1-5'", "d = '2020-1-5'", "d < date '2020-01-01' + interval 1 day", "t >= '1970-01-02'", "t < timestamp '1970-01-02 00:00:00'", "t = timestamp '1970-01-03 05:00:00+02:00'",
            "n > '2020-01-04 05:00'", "n <= date '2020-01-03'", r"s = 'k\t5'", "s = 'k\t5'", "s like 'k%'", "s > 'k'", "s is null", "s <=> 'k\t7'", "i = 3.0", "i > 100.5", "i < 5000000000", "i in (1, 399)",
            "x = 1.5", "x = 'NaN'", "p = 17", "p between 3 and 9.5", "b", "not b", "i > 10 and (d < '2020-01-20' or i = 300)", "cast(i as string) = '7'", "i between 390 and 1000", "10 >= i", "d in ('2020-01-01', '2020-2-1')",
        ):
            assert sorted(r.i for r in cat.table("n.t", ["i"], c).collect()) == sorted(r.i for r in plain.where(c).collect()), c
        listed = table.files(cat.storage, cat.describe_table("n", "t"), condition="d = '2020-1-5'")
        assert len(listed) == 1 < len(table.files(cat.storage, cat.describe_table("n", "t")))
        cat.delete("n.t", r"s = 'k\t5'")
        assert cat.table("n.t").where(plain.s == "k\t5").count() == 0 and cat.table("n.t").count() == 390
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_describe_and_column_statements(cat, spark):
    cat.sql("create database dd with dbproperties ('x' = 'y')")
    cat.sql("create table dd.t (id int, day timestamp_ntz, v float) partitioned by (days(day), bucket(4, id))")
    assert [tuple(r)[:2] for r in cat.sql("describe dd.t").collect()][0] == ("id", "int") and ("Namespace", "dd") in values(cat.sql("describe database dd"))
    assert any(r[0] == "# Partitioned by" and r[1] == "days(day),bucket(4, id)" for r in values(cat.sql("describe table extended dd.t")))
    cat.sql("alter table dd.t rename column day to moment")
    cat.sql("alter table dd.t alter column v type double")
    assert cat.describe_table("dd", "t")["partition_by"] == ["days(moment)", "bucket(4, id)"] and cat.table("dd.t").dtypes[1:] == [("moment", "timestamp_ntz"), ("v", "double")]
    for bad in ("alter table dd.t alter column v type int", "alter table dd.t rename column none to x", "alter table dd.t rename column v to id", "alter table dd.t add partition field days(nothing)", "alter table dd.t drop column moment"):
        with pytest.raises(errors.InvalidArgument):
            cat.sql(bad)


def test_session_statements(cat, spark):
    session.attach(spark, cat, "lake")
    try:
        spark.sql("create database lake.ss")
        spark.sql("begin")
        spark.sql("create table lake.ss.t (id int, s string)")
        spark.sql("insert into lake.ss.t values (1, 'lake.ss.t')")
        assert spark.sql("select 1 as one").first().one == 1
        spark.sql("commit")
        assert values(spark.sql("select s from lake.ss.t")) == [("lake.ss.t",)]
    finally:
        session.detach(spark)
    assert "sql" not in spark.__dict__


def test_node_source(cat, spark):
    nodes.register(spark)
    with cat.transaction() as txn:
        for i in range(60):
            txn.create_namespace(f"n{i:03d}")
    df = spark.read.format("catalog_nodes").option("path", str(cat.storage.root)).load()
    k = cat.keys
    assert df.count() == 62
    assert df.where(df.key == k.key("namespace", "n031")).count() == 1 and df.where(df.key == "nothing").count() == 0
    assert df.where(df.key.startswith(k.prefix("table"))).count() == 1 and df.where(df.key.startswith(k.prefix("namespace") + "n01")).count() == 10
    old = spark.read.format("catalog_nodes").option("path", str(cat.storage.root)).option("version", 1).load()
    assert old.count() == 1


def test_version_feed(cat, spark, tmp_path):
    versions.register(spark)
    df = spark.readStream.format("catalog_versions").option("path", str(cat.storage.root)).load()
    q = df.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    first = spark.sql("select count(distinct version) from feed").first()[0]
    cat.create_namespace("later")
    q.processAllAvailable()
    q.stop()
    assert first == 4 and spark.sql("select type from feed where version = 4").first()[0] == "NAMESPACE_CREATE"
