import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lakeloom import errors
from lakeloom.operators import conflicts, table
from lakeloom.operators.catalog import CASCADE, SERIALIZABLE, connect


@pytest.fixture
def cat(spark, tmp_path):
    return connect(spark, str(tmp_path / "w"), create=True)


@pytest.fixture
def full(cat):
    cat.create_namespace("ns1", {"k1": "v1"})
    cat.create_table("ns1", "tbl1", "id int, v string", properties={"k1": "v1"})
    return cat


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").cast("int").alias("id"), F.col("id").cast("string").alias("v"))


# ---- life, namespaces


def test_create_catalog(spark, tmp_path):
    c = connect(spark, str(tmp_path))
    assert not c.exists()
    with pytest.raises(errors.NotFound):
        c.latest()
    v = c.create(order="16", txn_isolation_level="serializable", note="x")
    assert v.number == 0 and c.exists() and c.definition["order"] == 16 and c.tree.order == 16 and c.definition["properties"] == {"note": "x"}
    with pytest.raises(errors.AlreadyExists):
        c.create()
    again = connect(spark, str(tmp_path))
    assert again.definition == c.definition and again.begin().isolation == SERIALIZABLE


def test_namespaces(cat):
    assert cat.create_namespace("ns1", {"k1": "v1"}).number == 1
    assert cat.namespace_exists("ns1") and not cat.namespace_exists("ns2") and cat.describe_namespace("ns1") == {"k1": "v1"}
    with pytest.raises(errors.AlreadyExists):
        cat.create_namespace("ns1")
    assert cat.alter_namespace("ns1", {"k1": "v2"}).number == 2 and cat.describe_namespace("ns1") == {"k1": "v2"}
    cat.alter_namespace("ns1", set={"a": "1", "b": "2"}, unset=["k1"])
    assert cat.describe_namespace("ns1") == {"a": "1", "b": "2"}
    cat.create_namespace("a")
    assert cat.show_namespaces() == ["a", "ns1"]
    cat.drop_namespace("a")
    assert cat.show_namespaces() == ["ns1"]
    for call in (lambda: cat.describe_namespace("a"), lambda: cat.drop_namespace("a"), lambda: cat.alter_namespace("a", {})):
        with pytest.raises(errors.NotFound):
            call()
    with pytest.raises(errors.InvalidArgument):
        cat.create_namespace("n" * 101)


def test_drop_namespace_with_objects(full):
    full.create_view("ns1", "view1", "select * from tbl1")
    with pytest.raises(errors.NotEmpty):
        full.drop_namespace("ns1")
    full.drop_table("ns1", "tbl1")
    with pytest.raises(errors.NotEmpty):
        full.drop_namespace("ns1")
    full.drop_namespace("ns1", CASCADE)
    assert full.show_namespaces() == [] and full.objects().count() == 0


# ---- tables and views


def test_tables(full):
    with pytest.raises(errors.AlreadyExists):
        full.create_table("ns1", "tbl1", "id int")
    with pytest.raises(errors.NotFound):
        full.create_table("nope", "t", "id int")
    full.create_table("ns1", "tbl2", "id int", properties={"k2": "v2"})
    assert full.show_tables("ns1") == ["tbl1", "tbl2"] and full.show_tables("ns") == []
    assert full.describe_table("ns1", "tbl2")["properties"] == {"k2": "v2"}
    full.alter_table("ns1", "tbl2", set={"a": "b"}, unset=["k2"])
    assert full.describe_table("ns1", "tbl2")["properties"] == {"a": "b"}
    full.rename_table("ns1", "tbl2", "tbl3")
    assert full.show_tables("ns1") == ["tbl1", "tbl3"]
    full.drop_table("ns1", "tbl3")
    assert not full.table_exists("ns1", "tbl3")
    with pytest.raises(errors.NotFound):
        full.describe_table("ns1", "tbl3")
    full.create_table("ns1", "tbl3", "other long")  # a removed name may come back
    assert full.table("ns1.tbl3").columns == ["other"]


def test_views(full, spark):
    full.append("ns1.tbl1", rows(spark, 3))
    full.create_view("ns1", "view1", "select id + 1 as next from tbl1")
    full.create_view("ns1", "tbl1x", "select * from view1 where next > 1")
    assert sorted(r.next for r in full.view("ns1.tbl1x").collect()) == [2, 3]
    assert full.show_views("ns1") == ["tbl1x", "view1"] and full.describe_view("ns1", "view1")["references"] == ["ns1.tbl1"]
    with pytest.raises(errors.AlreadyExists):
        full.create_view("ns1", "view1", "select 1 as x")
    full.create_view("ns1", "view1", "select id * 10 as next from tbl1", replace=True, properties={"p": "q"})
    assert sorted(r.next for r in full.view("ns1.tbl1x").collect()) == [10, 20]
    full.replace_view("ns1", "view1", "select next from tbl1x")  # now they read each other
    with pytest.raises(errors.InvalidArgument, match="reads itself"):
        full.view("ns1.view1")
    full.drop_view("ns1", "view1")
    with pytest.raises(errors.NotFound):
        full.view("ns1.tbl1x")
    with pytest.raises(errors.NotFound):
        full.replace_view("ns1", "view1", "select 1 as a")
    full.create_opaque_view("ns1", "other", b"\x00plan", ["ns1.tbl1"])
    assert full.describe_view("ns1", "other")["dialect"] == "substrait"
    with pytest.raises(errors.InvalidArgument):
        full.view("ns1.other")


def test_defaults_and_overrides(spark, tmp_path):
    c = connect(spark, str(tmp_path), create=True, **{"table-default.a": "1", "table-override.b": "2", "view-default.key1": "value1"})
    c.create_namespace("n")
    c.create_table("n", "t", "x int", properties={"a": "3", "b": "4"})
    c.create_view("n", "v", "select 1 as one")
    assert c.describe_table("n", "t")["properties"] == {"a": "3", "b": "2"} and c.describe_view("n", "v")["properties"] == {"key1": "value1"}


# ---- rows


def test_rows(full, spark):
    full.append("ns1.tbl1", rows(spark, 10))
    kept = full.table("ns1.tbl1")
    full.append("ns1.tbl1", rows(spark, 5, 100))
    full.update("ns1.tbl1", {"v": "concat(v, '!')", "id": "id + 1"}, "id < 2")
    full.delete("ns1.tbl1", "id = 100 or v is null")
    got = sorted(tuple(r) for r in full.table("ns1.tbl1").collect())
    assert got == sorted([(1, "0!"), (2, "1!")] + [(i, str(i)) for i in range(2, 10)] + [(i, str(i)) for i in range(101, 105)])
    assert kept.count() == 10  # a DataFrame stays at its version
    full.overwrite("ns1.tbl1", rows(spark, 2, 50), "id > 5")
    assert sorted(r.id for r in full.table("ns1.tbl1").collect()) == [1, 2, 2, 3, 4, 5, 50, 51]
    full.overwrite("ns1.tbl1", rows(spark, 1))
    assert full.table("ns1.tbl1").count() == 1
    with pytest.raises(errors.InvalidArgument):
        full.append("ns1.tbl1", rows(spark, 1).withColumn("more", F.lit(1)))
    assert full.delete("ns1.tbl1", "id = 999") is None  # nothing matches, nothing is committed


def test_null_conditions_keep_rows(full, spark):
    full.append("ns1.tbl1", spark.createDataFrame([(1, None), (2, "x"), (None, "x")], "id int, v string"))
    full.delete("ns1.tbl1", "v = 'x' and id > 0")
    full.update("ns1.tbl1", {"v": "'y'"}, "v <> 'x'")
    assert sorted((str(r.id), str(r.v)) for r in full.table("ns1.tbl1").collect()) == [("1", "None"), ("None", "x")]


def test_files_are_skipped_and_filters_pushed(full, spark):
    full.create_table("ns1", "p", "id int, v string, d date", partition_by=["v"], sort_by=["id"])
    full.append("ns1.p", spark.range(1000).selectExpr("cast(id as int) id", "cast(id % 4 as string) v", "date_add(date '2020-01-01', cast(id as int)) d"))
    everything = full.table("ns1.p.files").count()
    assert everything == 4 and full.table("ns1.p.partitions").count() == 4
    df = full.table("ns1.p", ["id"], "v = '2' and id between 10 and 20")
    assert len(df.inputFiles()) == 1 and sorted(r.id for r in df.collect()) == [10, 14, 18]
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "ReadSchema: struct<id:int,v:string>" in plan
    assert len(full.table("ns1.p", where="d > date '2030-01-01'").inputFiles()) == 0
    assert full.table("ns1.p", where="d = date '2020-01-03'").count() == 1
    assert full.table("ns1.p", where="v = '2' or v = '3'").count() == 500
    assert full.table("ns1.p", where="not (v = '2')").count() == 750


def test_manifests_are_skipped(full, spark, monkeypatch):
    for k in range(4):
        full.append("ns1.tbl1", rows(spark, 10, 10 * k))
    read, plain = [], table.read_manifest
    monkeypatch.setattr(table, "read_manifest", lambda s, p: read.append(p) or plain(s, p))
    assert full.table("ns1.tbl1", where="id between 12 and 15").count() == 4 and len(read) == 1


def test_replacing_a_table_sees_other_commits(full, spark):
    full.append("ns1.tbl1", rows(spark, 2))
    txn = full.begin()
    txn.replace_table("ns1", "tbl1", "x long")
    full.append("ns1.tbl1", rows(spark, 1))
    with pytest.raises(errors.CommitConflict):
        txn.commit()
    full.replace_table("ns1", "tbl1", "x long", create=True)
    full.replace_table("ns1", "tbl9", "x long", create=True)
    assert full.table("ns1.tbl1").columns == ["x"] and full.table("ns1.tbl1").count() == 0 and full.table_exists("ns1", "tbl9")


def test_schema_changes(full, spark):
    full.append("ns1.tbl1", rows(spark, 2))
    full.add_columns("ns1", "tbl1", "more array<int>, z double")
    full.append("ns1.tbl1", rows(spark, 1, 7).selectExpr("*", "array(1, 2) more", "0.5D z"))
    assert sorted((r.id, r.more, r.z) for r in full.table("ns1.tbl1").collect()) == [(0, None, None), (1, None, None), (7, [1, 2], 0.5)]
    full.drop_columns("ns1", "tbl1", "v", "z")
    assert full.table("ns1.tbl1").columns == ["id", "more"]
    with pytest.raises(errors.InvalidArgument):
        full.add_columns("ns1", "tbl1", "id int")
    full.append("ns1.tbl1", rows(spark, 1, 9).select("id"))
    full.add_columns("ns1", "tbl1", "v string")  # not the one that was dropped
    assert full.table("ns1.tbl1").count() == 4 and full.table("ns1.tbl1").where("v is not null").count() == 0
    ids = [f["metadata"]["id"] for f in full.describe_table("ns1", "tbl1")["schema"]["fields"]]
    assert len(set(ids)) == len(ids)


def test_metadata_tables(full, spark):
    full.append("ns1.tbl1", rows(spark, 2))
    full.append("ns1.tbl1", rows(spark, 3, 5))
    for name, n in (("history", 2), ("snapshots", 2), ("manifests", 2), ("refs", 1)):
        assert full.table(f"ns1.tbl1.{name}").count() == n
    assert full.table("ns1.tbl1.files").agg(F.sum("record_count")).first()[0] == 5
    assert full.table("ns1.tbl1", snapshot=1).count() == 2
    with pytest.raises(errors.InvalidArgument):
        full.table("ns1.tbl1.nothing")


# ---- versions


def test_time_travel(full, spark):
    first = full.latest()
    stamps = [first.created_at]
    for i in range(3):
        time.sleep(0.01)
        stamps.append(full.append("ns1.tbl1", rows(spark, 1, i)).created_at)
    for i, at in enumerate(stamps):
        assert full.at(version=first.number + i).table("ns1.tbl1").count() == i
        assert full.at(timestamp_millis=at).table("ns1.tbl1").count() == i
        assert full.at(timestamp_millis=at + 1).number == first.number + i
    assert full.at(timestamp_millis=stamps[-1] + 10**9).number == full.latest().number
    for bad in ({"version": 99}, {"version": -1}, {"timestamp_millis": 5}):
        with pytest.raises(errors.NotFound):
            full.at(**bad)
    assert [v.number for v in full.history()] == list(range(full.latest().number, -1, -1))


def test_rollback(full, spark):
    before = full.append("ns1.tbl1", rows(spark, 4)).number
    full.drop_namespace("ns1", CASCADE)
    now = full.rollback_to(before)
    assert now.number == before + 2 and full.table("ns1.tbl1").count() == 4
    assert full.versions().where("rollback_from_root is not null").count() == 1
    full.append("ns1.tbl1", rows(spark, 1))
    assert full.table("ns1.tbl1").count() == 5


def test_export_expire_collect(full, spark, tmp_path):
    full.append("ns1.tbl1", rows(spark, 4))
    target = full.export("backup", str(tmp_path / "copy"))
    part = full.export("light", str(tmp_path / "light"), minimal=True)
    assert full.definition["exported_snapshots"] == {"backup": target, "light": part}
    assert connect(spark, part).table("ns1.tbl1").count() == 4 and not (tmp_path / "light" / "data").exists()
    full.overwrite("ns1.tbl1", rows(spark, 1))
    held = full.begin(id="held")
    held.append("ns1.tbl1", rows(spark, 2))
    held.save()
    assert all(p.startswith("meta/l-") for p in full.unreachable())  # lists of what is not committed; they are made again
    full.expire()
    assert full.collect_garbage() == 0  # all files are younger than a transaction may be
    gone = full.collect_garbage(older_than_millis=0)
    assert gone > 0 and full.unreachable() == [] and full.table("ns1.tbl1").count() == 1
    full.load_distributed("held").commit()
    assert full.table("ns1.tbl1").count() == 3
    with pytest.raises(errors.NotFound):
        full.at(version=1)
    assert connect(spark, target).table("ns1.tbl1").count() == 4
    assert connect(spark, str(full.storage.root)).table("ns1.tbl1").count() == 3


# ---- transactions


def test_transactions(full, spark):
    txn = full.begin(id="t", ttl_millis=10**6)
    txn.create_namespace("ns2")
    txn.create_table("ns2", "t", "id int, v string")
    txn.append("ns2.t", rows(spark, 2))
    txn.append("ns2.t", rows(spark, 2))
    assert txn.table("ns2.t").count() == 4 and txn.show_namespaces() == ["ns1", "ns2"] and full.show_namespaces() == ["ns1"]
    before = full.latest().number
    assert txn.commit().number == before + 1 and full.table("ns2.t").count() == 4
    for call in (txn.commit, lambda: txn.create_namespace("x"), lambda: txn.show_namespaces()):
        with pytest.raises(errors.TransactionClosed):
            call()
    with pytest.raises(errors.NothingToCommit):
        full.begin().commit()
    with pytest.raises(RuntimeError), full.transaction() as t:
        t.drop_table("ns2", "t")
        raise RuntimeError
    assert full.table_exists("ns2", "t")
    late = full.begin(ttl_millis=0)
    late.create_namespace("late")
    time.sleep(0.01)
    with pytest.raises(errors.Expired):
        late.commit()
    with pytest.raises(errors.InvalidArgument):
        full.begin(isolation_level="chaos")


def change(kind):
    """A change to the catalog below: (action type, what to do)."""
    return {
        "NAMESPACE_CREATE": lambda t: t.create_namespace("new"),
        "NAMESPACE_ALTER": lambda t: t.alter_namespace("empty", {"x": "y"}),
        "NAMESPACE_ALTER_SET_PROPERTIES": lambda t: t.alter_namespace("empty", set={"a": "b"}),
        "NAMESPACE_ALTER_UNSET_PROPERTIES": lambda t: t.alter_namespace("empty", unset=["k1"]),
        "NAMESPACE_DROP": lambda t: t.drop_namespace("empty"),
        "TABLE_CREATE": lambda t: t.create_table("ns1", "new", "a int"),
        "TABLE_ALTER": lambda t: t.alter_table("ns1", "tbl1", set={"a": "b"}),
        "TABLE_ALTER_ADD_COLUMNS": lambda t: t.add_columns("ns1", "tbl1", "more int"),
        "TABLE_ALTER_REMOVE_COLUMNS": lambda t: t.drop_columns("ns1", "tbl1", "v"),
        "TABLE_INSERT": lambda t: t.append("ns1.tbl1", t.spark.sql("select 9 as id")),
        "TABLE_UPDATE": lambda t: t.update("ns1.tbl1", {"id": "id + 1"}, "id = 1"),
        "TABLE_DELETE": lambda t: t.delete("ns1.tbl1", "id = 0"),
        "TABLE_DROP": lambda t: t.drop_table("ns1", "tbl1"),
        "VIEW_CREATE": lambda t: t.create_view("ns1", "new", "select 1 as a"),
        "VIEW_REPLACE": lambda t: t.replace_view("ns1", "v", "select 2 as a"),
        "VIEW_DROP": lambda t: t.drop_view("ns1", "v"),
    }[kind]


CHANGES = ("NAMESPACE_CREATE", "NAMESPACE_ALTER", "NAMESPACE_ALTER_SET_PROPERTIES", "NAMESPACE_ALTER_UNSET_PROPERTIES", "NAMESPACE_DROP", "TABLE_CREATE", "TABLE_ALTER", "TABLE_ALTER_ADD_COLUMNS", "TABLE_ALTER_REMOVE_COLUMNS", "TABLE_INSERT", "TABLE_UPDATE", "TABLE_DELETE", "TABLE_DROP", "VIEW_CREATE", "VIEW_REPLACE", "VIEW_DROP")


def test_every_pair_of_changes(full, spark):
    """Whatever was committed first: the second change is kept as well, or refused if the matrix says so."""
    full.create_namespace("empty", {"k1": "v1"})
    full.append("ns1.tbl1", rows(spark, 3))
    full.create_view("ns1", "v", "select 1 as a")
    base = full.latest().number
    for committed in CHANGES:
        for pending in CHANGES:
            now = full.rollback_to(base)
            mine, other = full.begin(), full.begin()
            change(pending)(mine)
            change(committed)(other)
            other.commit()
            said = conflicts.verdict(committed, pending)
            if said == conflicts.UNRESOLVABLE:
                with pytest.raises(errors.CommitConflict):
                    mine.commit()
                    pytest.fail(f"{pending} after {committed}")
                assert full.latest().number == now.number + 1
                continue
            try:
                mine.commit()
            except errors.CommitConflict:
                # the columns or files that it needs are gone
                assert {committed, pending} & {"TABLE_ALTER_REMOVE_COLUMNS", "TABLE_DELETE"}
                continue
            assert full.latest().number == now.number + 2
            ids = sorted(r.id for r in full.table("ns1.tbl1").collect()) if full.table_exists("ns1", "tbl1") else None
            if {committed, pending} == {"TABLE_INSERT", "TABLE_UPDATE"}:
                assert ids == [0, 2, 2, 9]
            if {committed, pending} == {"TABLE_INSERT", "TABLE_DELETE"}:
                assert ids == [1, 2, 9]
            if {committed, pending} == {"TABLE_INSERT"}:
                assert ids == [0, 1, 2, 9, 9]


def test_reads_count_under_serializable(full, spark):
    full.append("ns1.tbl1", rows(spark, 2))
    for isolation, conflict in (("SNAPSHOT", False), ("SERIALIZABLE", True)):
        txn = full.begin(isolation_level=isolation)
        total = txn.table("ns1.tbl1").count()
        txn.create_namespace(f"n{total}{isolation.lower()}")
        full.append("ns1.tbl1", rows(spark, 1))
        if conflict:
            with pytest.raises(errors.CommitConflict):
                txn.commit()
        else:
            txn.commit()


def test_namespace_drops_and_new_objects(full):
    full.create_namespace("n")
    a, b = full.begin(), full.begin()
    a.create_table("n", "t", "x int")
    b.drop_namespace("n")
    b.commit()
    with pytest.raises(errors.CommitConflict):
        a.commit()
    full.create_namespace("n")
    a, b = full.begin(), full.begin()
    a.drop_namespace("n")
    b.create_table("n", "t", "x int")
    b.commit()
    with pytest.raises(errors.CommitConflict):
        a.commit()


def test_race_loses_nothing(full):
    done, failed = [], []

    def work(i):
        try:
            full.storage  # noqa: B018
            txn = full.begin()
            txn.create_namespace(f"w{i:02d}")
            txn.commit()
            done.append(f"w{i:02d}")
        except errors.CatalogError as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and [n for n in full.show_namespaces() if n.startswith("w")] == sorted(done) and len(done) == 12


def test_distributed(full, spark):
    txn = full.begin(id="wap")
    txn.append("ns1.tbl1", rows(spark, 3))
    txn.create_namespace("made")
    path = txn.save()
    assert path == "def/dtxn/wap.binpb" and full.distributed_exists("wap") and full.show_distributed() == ["wap"]
    other = connect(spark, str(full.storage.root))
    again = other.load_distributed("wap")
    assert again.table("ns1.tbl1").count() == 3 and other.table("ns1.tbl1").count() == 0
    full.append("ns1.tbl1", rows(spark, 1))
    again.commit()
    assert other.table("ns1.tbl1").count() == 4 and other.namespace_exists("made")
    other.drop_distributed("wap")
    with pytest.raises(errors.NotFound):
        other.load_distributed("wap")


def test_conflict_frames(spark):
    a = spark.createDataFrame([("k1", "TABLE_UPDATE"), ("k2", "TABLE_INSERT"), ("k3", "TABLE_SELECT")], "object_key string, type string")
    b = spark.createDataFrame([("k1", "TABLE_INSERT"), ("k2", "TABLE_DELETE"), ("k3", "TABLE_DROP"), ("k4", "TABLE_DROP")], "object_key string, type string")
    got = {(r.object_key, r.verdict) for r in conflicts.analyse(a, b).collect()}
    assert got == {("k1", "unresolvable"), ("k2", "resolvable")}


def test_garbage_beside_an_open_transaction(full, spark):
    full.append("ns1.tbl1", rows(spark, 3))
    txn = full.begin()
    txn.append("ns1.tbl1", rows(spark, 4))
    full.expire()
    full.collect_garbage()
    txn.commit()
    assert full.table("ns1.tbl1").count() == 7
    late = full.begin()
    late.append("ns1.tbl1", rows(spark, 1))
    full.collect_garbage(older_than_millis=0)
    with pytest.raises(errors.CommitConflict):
        late.commit()  # its files are gone; the table stays readable
    assert full.table("ns1.tbl1").count() == 7
    with pytest.raises(errors.InvalidArgument):
        full.begin(ttl_millis=10**12)


def test_many_appends_keep_a_commit_small(full, spark, monkeypatch):
    """Commits of prepared manifests: what a commit writes does not grow with their number."""
    entry = {"path": "file:///nowhere/x.parquet", "rows": 1, "bytes": 1, "partition": "{}", "low": '{"id": 1}', "high": '{"id": 2}'}
    written = []
    plain = type(full.storage).create
    monkeypatch.setattr(type(full.storage), "create", lambda s, p, d: written.append((p, len(d))) or plain(s, p, d))
    sizes = []
    for i in range(600):
        written.clear()
        m = table.write_manifest(full.storage, [{**entry, "path": f"file:///nowhere/{i}.parquet"}])
        with full.transaction() as txn:
            txn._do("TABLE_INSERT", "table", "table", ("ns1", "tbl1"), {"op": "append", "manifests": [m], "summary": {"files": 1, "rows": 1}})
        sizes.append(sum(n for _, n in written))
    found = full.describe_table("ns1", "tbl1")
    assert len(table.files(full.storage, found)) == 600 and len(table.snapshots(full.storage, found)) == 600
    assert len(table.manifests(full.storage, table.snapshot_of(full.storage, found))) < 3 * table.FAN
    assert len(json.dumps(found)) < 20_000 and sorted(sizes[-100:])[50] < 1.5 * sorted(sizes[100:200])[50]
    assert table.snapshot_of(full.storage, found, 17)["id"] == 17


def test_columns_are_known_by_ids(full, spark):
    full.append("ns1.tbl1", rows(spark, 3))
    first = full.table("ns1.tbl1").columns
    full.rename_column("ns1", "tbl1", first[0], "renamed")
    assert full.table("ns1.tbl1", where="renamed is not null").columns == ["renamed", *first[1:]] and full.table("ns1.tbl1").where("renamed is not null").count() == 3
    full.add_columns("ns1", "tbl1", f"{first[0]} string")  # the old name, for a column of its own
    assert full.table("ns1.tbl1").where(f"{first[0]} is not null").count() == 0
    full.drop_columns("ns1", "tbl1", first[0])
    full.add_columns("ns1", "tbl1", f"{first[0]} string")
    full.update("ns1.tbl1", {first[0]: "'x'"}, "renamed is not null")
    assert full.table("ns1.tbl1", where=f"{first[0]} = 'x'").count() == 3
    full.delete("ns1.tbl1", f"{first[0]} = 'x'")
    assert full.table("ns1.tbl1").count() == 0


def test_transforms():
    assert [table.transform(s) for s in ("a", "`a`", "days(b)", "bucket(16, c)", "bucket(c, 16)", "Truncate(2, d)")] == [("identity", None, "a"), ("identity", None, "a"), ("day", None, "b"), ("bucket", 16, "c"), ("bucket", 16, "c"), ("truncate", 2, "d")]
    for bad in ("", "days()", "bucket(c)", "days(3, c)", "weeks(c)", "bucket(0, c)"):
        with pytest.raises(errors.InvalidArgument):
            table.transform(bad)
