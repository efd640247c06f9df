import struct

import pytest
from pyspark.sql import functions as F

from quillon.constraints import Constraints, ForeignKey, propagate, validate
from quillon.errors import ConstraintError, QueryError, StoreError
from quillon.sources import dbf, xbf
from quillon.sources.catalog import Catalog
from quillon.store import Store, merged, patched
from quillon.streaming import cdc
from quillon.transactions import CatalogLog, CatalogTransaction


def test_dbf_round_trip(spark, tmp_path):
    dbf.register(spark)
    df = spark.createDataFrame([(1, "Ärger", 2.5, True, "20240131", 1, False), (None, None, None, None, None, 2, True), (3, "x", -1.25, False, "19991231", 3, False)], "n long, c string, f double, l boolean, d string, _record_number long, _deleted boolean")
    df = df.withColumn("d", F.to_date("d", "yyyyMMdd"))
    path = str(tmp_path / "t.dbf")
    assert dbf.write_dbf(df, path) == 3
    for rows in (1, 2, 100):
        got = spark.read.format("dbf").option("rows", rows).load(path).orderBy("_record_number").collect()
        assert [tuple(r) for r in got] == [(1, "Ärger", 2.5, True, "20240131", 1, False), (None, "", None, None, None, 2, True), (3, "x", -1.25, False, "19991231", 3, False)]  # blank text is empty text
    with pytest.raises(Exception, match="doesn't fit"):
        dbf.write_dbf(spark.createDataFrame([("x" * 300,)], "c string"), str(tmp_path / "u.dbf"))


def table(fields, records, version=0x03, driver=0x03, count=None):
    """A DBF file from raw fields and record bytes."""
    width = 1 + sum(f.width for f in fields)
    head = struct.pack("<BBBBIHH", version, 24, 1, 1, len(records) if count is None else count, 33 + 32 * len(fields), width) + bytes(17) + bytes([driver, 0, 0])
    for f in fields:
        head += f.name.encode().ljust(11, b"\0") + f.type.encode() + bytes(4) + bytes([f.width, f.decimals, f.flags]) + bytes(13)
    return head + b"\x0d" + b"".join(records) + b"\x1a"


def test_dbf_types_and_memo(spark, tmp_path):
    dbf.register(spark)
    fields = [dbf.Field("I", "I", 4), dbf.Field("T", "T", 8), dbf.Field("Y", "Y", 8), dbf.Field("B", "B", 8), dbf.Field("M", "M", 4), dbf.Field("V", "V", 6), dbf.Field("_NullFlags", "0", 1, 0, 5)]
    memo = bytearray(64 * 2)
    memo[6:8] = struct.pack(">H", 64)
    memo += struct.pack(">II", 1, 5) + b"hello" + bytes(51)
    (tmp_path / "t.fpt").write_bytes(memo)
    day = 2440588 + 19000
    one = b" " + struct.pack("<i", -5) + struct.pack("<iI", day, 3_600_000) + struct.pack("<q", -12345) + struct.pack("<d", 1.5) + struct.pack("<I", 2) + b"abc\0\0\3" + b"\1"
    two = b"*" + struct.pack("<i", 7) + bytes(8) + struct.pack("<q", 10000) + struct.pack("<d", float("nan")) + struct.pack("<I", 0) + b"abcdef" + b"\0"
    path = tmp_path / "t.dbf"
    path.write_bytes(table(fields, [one, two], 0x32))
    got = spark.read.format("dbf").load(str(path)).orderBy("_record_number").collect()
    assert got[0].asDict() == {"I": -5, "T": "2022-01-08T01:00:00", "Y": "-1.2345", "B": 1.5, "M": "hello", "V": "abc", "_record_number": 1, "_deleted": False}
    assert got[1].asDict() == {"I": 7, "T": None, "Y": "1.0000", "B": None, "M": None, "V": "abcdef", "_record_number": 2, "_deleted": True}


@pytest.mark.parametrize("driver,code", [(0x7B, "cp932"), (0x7A, "gbk"), (0x79, "cp949"), (0x78, "cp950"), (0xC9, "cp1251"), (0x65, "cp866")])
def test_code_pages(spark, tmp_path, driver, code):
    dbf.register(spark)
    text = {"cp932": "日本", "gbk": "中文", "cp949": "한국", "cp950": "中文", "cp1251": "мир", "cp866": "мир"}[code]
    path = tmp_path / "t.dbf"
    path.write_bytes(table([dbf.Field("C", "C", 10)], [b" " + text.encode(code).ljust(10)], driver=driver))
    assert spark.read.format("dbf").load(str(path)).first().C == text


def test_malformed_dbf(spark, tmp_path):
    dbf.register(spark)
    good = table([dbf.Field("C", "C", 3)], [b" abc"])
    for i, bad in enumerate([good[:20], good[:40], good.replace(b"\x0d", b"\x01", 1), table([dbf.Field("C", "C", 3)], [b"?abc"]), table([dbf.Field("C", "C", 3)], [b" abc"], count=9), good[:10] + b"\x09\x00" + good[12:]]):
        path = tmp_path / f"{i}.dbf"
        path.write_bytes(bad)
        with pytest.raises(Exception):
            spark.read.format("dbf").load(str(path)).collect()


def test_xbf_round_trip_and_damage(spark, tmp_path):
    xbf.register(spark)
    df = spark.sql("SELECT true b, 1 i, 2L l, CAST(18446744073709551615 AS DECIMAL(20,0)) u, CAST(1.5 AS FLOAT) f, 2.5D d, 'é' s, X'00FF' y, DATE'2024-02-29' a, TIMESTAMP_NTZ'2024-02-29 12:34:56.789' t UNION ALL SELECT null, null, null, null, null, null, null, null, null, null")
    path = str(tmp_path / "t.xbf")
    assert xbf.write_xbf(df, path, 7) == 2 and xbf.read_layout(path).generation == 7
    got = spark.read.format("xbf").load(path).drop("_record_number", "_deleted")
    assert got.dtypes == df.dtypes and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    raw = bytearray((tmp_path / "t.xbf").read_bytes())
    for at in (0, 5, 20, 93, 110, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        (tmp_path / "bad.xbf").write_bytes(bad)
        with pytest.raises(Exception):
            spark.read.format("xbf").load(str(tmp_path / "bad.xbf")).collect()
    assert xbf.crc32c(b"123456789") == 0xE3069283 and xbf.crc32c(b"6789", xbf.crc32c(b"12345")) == 0xE3069283


def test_checksums_in_lanes_and_joined():
    import random

    raw = random.Random(1).randbytes(200_003)
    slow = xbf._bytewise(raw, 0xFFFFFFFF) ^ 0xFFFFFFFF
    assert xbf.crc32c(raw) == slow == xbf.crc32c(raw[90_000:], xbf.crc32c(raw[:90_000]))
    assert xbf.crc32c_joined(xbf.crc32c(raw[:777]), xbf.crc32c(raw[777:]), len(raw) - 777) == slow


def test_conversions_both_ways(spark, tmp_path):
    d, x, back = (str(tmp_path / n) for n in ("a.dbf", "a.xbf", "b.dbf"))
    df = spark.createDataFrame([(1, "Ärger", 2.5, True, 1, False), (2, "x", -1.25, None, 2, True), (3, "y", None, False, 3, False)], "n long, c string, f double, l boolean, _record_number long, _deleted boolean")
    dbf.write_dbf(df.repartition(3), d)
    assert xbf.dbf_to_xbf(spark, d, "file://" + x) == 3 and xbf.xbf_to_dbf(spark, x, "file://" + back) == 3
    assert sorted(map(tuple, spark.read.format("dbf").load(back).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    xbf.write_xbf(spark.createDataFrame([("z" * 300,)], "c string"), x)
    with pytest.raises(QueryError, match="longer than 254"):
        xbf.xbf_to_dbf(spark, x, back)
    assert not [p for p in tmp_path.iterdir() if "parts" in p.name]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.create(spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", None)], "id int, name string, age int").coalesce(1), Constraints(primary=("id",), checks={"age": {"age": {"$not": {"$lt": 0}}}}, defaults={"name": "new"}))
    return s


def rows(df):
    return sorted(tuple(r) for r in df.select("_record_number", "id", "name", "age", "_deleted").collect())


def test_transactions_and_history(spark, store):
    t = store.begin()
    t.insert([{"id": 4, "age": 5}])
    t.patch(1, {"$inc": {"age": 1}, "$set": {"name": "A"}})
    t.delete(2)
    t.merge_patch(3, {"name": None, "age": 1})
    assert [r.id for r in t.query({"filter": {"age": {"$gt": 4}}, "sort": {"id": 1}}).collect()] == [1, 4]
    assert store.read().count() == 3  # nothing before the commit
    assert t.commit() == 2
    assert rows(store.read()) == [(1, 1, "A", 11, False), (2, 2, "b", 20, True), (3, 3, None, 1, False), (4, 4, "new", 5, False)]
    assert rows(store.read(1)) == [(1, 1, "a", 10, False), (2, 2, "b", 20, False), (3, 3, "c", None, False)]
    assert sorted(r.record_number for r in store.changes(1).collect()) == [1, 2, 3, 4] and store.changes(0, 1).count() == 3
    assert [r.txn for r in store.row_versions(1).collect()] == [1, 2]
    t = store.begin()
    t.recall(2)
    t.commit()
    assert not store.row_at(2, 3).first()["_deleted"] and store.row_at(2, 2).first()["_deleted"]
    t = store.begin()
    t.insert(spark.range(5, 8).select(F.col("id").cast("int").alias("id")))
    t.delete_where({"id": {"$lt": 3}})
    t.commit()
    store.pack()
    assert [r[0] for r in rows(store.read())] == [1, 2, 3, 4, 5] and [r[1] for r in rows(store.read())] == [3, 4, 5, 6, 7]
    assert store.gc(1) == [1, 2, 3, 4]
    with pytest.raises(StoreError):
        store.read(2)


def test_bad_steps(store):
    for step in (lambda t: t.patch(9, {"age": 1}), lambda t: t.insert([{"nope": 1}]), lambda t: t.patch(1, {"$inc": {"age": 1}, "name": "x"}), lambda t: t.patch(1, {"$set": {"age": 1}, "$inc": {"age": 1}}), lambda t: t.recall(1), lambda t: t.json_patch(1, [{"op": "test", "path": "/name", "value": "z"}])):
        with pytest.raises(StoreError):
            step(store.begin())
    for step, name in ((lambda t: t.insert([{"id": 1}]), "primary"), (lambda t: t.patch(1, {"age": -1}), "check:age"), (lambda t: t.patch(1, {"id": None}), "not_null")):
        t = store.begin()
        step(t)
        with pytest.raises(ConstraintError, match=name):
            t.commit()
    assert store.latest().txn == 1


def test_row_merge(store):
    a, b, c = store.begin(), store.begin(), store.begin()
    a.patch(1, {"age": 1})
    b.patch(2, {"age": 2})
    c.patch(1, {"age": 3})
    a.commit()
    with pytest.raises(StoreError):
        b.commit()
    b.commit(merge=True)
    with pytest.raises(StoreError):
        c.commit(merge=True)
    assert [(r[1], r[3]) for r in rows(store.read())] == [(1, 1), (2, 2), (3, None)]


def test_backup_restore_catalog(spark, store, tmp_path):
    store.backup(str(tmp_path / "copy"))
    t = store.begin()
    t.delete(1)
    t.commit()
    store.restore(str(tmp_path / "copy"))
    assert len([r for r in rows(store.read()) if not r[4]]) == 3
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    dbf.write_dbf(spark.range(2).withColumn("name", F.lit("x")), str(tmp_path / "d.dbf"))
    c = Catalog(spark, str(tmp_path))
    assert c.table_names() == ["copy", "d", "p", "t"]
    e = c.engine()
    assert e.find("d", {"aggregate": [{"$count": "n"}]}).first().n == 2
    assert e.join({"from": "d", "join": {"table": "p", "on": {"d.id": {"$eq": {"$field": "p.id"}}}}}).count() == 2
    assert c.engine(at=2).find("t", {"aggregate": [{"$count": "n"}]}).first().n == 2
    c.register_views()
    assert spark.sql("SELECT count(*) FROM t").first()[0] == 3
    with pytest.raises(StoreError):
        c.table("nope")


def test_change_stream(spark, store, tmp_path):
    for i in range(3):
        t = store.begin()
        t.patch(1, {"age": i})
        t.commit()
    q = cdc.mirror(cdc.change_stream(spark, store.folder, 1), str(tmp_path / "m"), str(tmp_path / "c"))
    q.awaitTermination()
    last = sorted(p for p in (tmp_path / "m").iterdir() if p.is_dir())[-1]
    got = cdc.parsed(spark.read.parquet(str(last)).select(F.lit(None).cast("string").alias("before"), F.col("content").alias("after")), store.read().drop("_record_number").schema)
    assert sorted(r.after.id for r in got.collect()) == [1, 2, 3] and {r.after.age for r in got.collect() if r.after.id == 1} == {2}


def test_constraints(spark):
    parent = spark.createDataFrame([(1, 1, False), (2, 2, False)], "_record_number long, k int, _deleted boolean")
    child = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, None, False)], "_record_number long, p int, _deleted boolean")
    key = lambda d, u="restrict": ForeignKey(("p",), "parent", ("k",), d, u)
    gone = parent.withColumn("_deleted", F.col("k") == 1)
    moved = parent.withColumn("k", F.when(F.col("k") == 1, 9).otherwise(F.col("k")))
    with pytest.raises(ConstraintError):
        propagate(parent, gone, {"child": (child, key("restrict"))})
    assert [r["_deleted"] for r in propagate(parent, gone, {"child": (child, key("cascade"))})["child"].orderBy("_record_number").collect()] == [True, False, False]
    assert [r.p for r in propagate(parent, gone, {"child": (child, key("set_null"))})["child"].orderBy("_record_number").collect()] == [None, 2, None]
    assert [r.p for r in propagate(parent, moved, {"child": (child, key("restrict", "cascade"))})["child"].orderBy("_record_number").collect()] == [9, 2, None]
    c = Constraints(foreign_keys=(key("restrict"),))
    validate(child, c, lambda n: parent)
    with pytest.raises(ConstraintError):
        validate(child, c, lambda n: gone)
    validate(child, c, lambda n: gone, frozenset({"foreign_key:p"}))
    assert Constraints.from_json(c.to_json()) == c


def test_patches():
    assert merged({"a": 1, "b": {"c": 1, "d": 2}}, {"a": None, "b": {"c": None}, "e": [1]}) == {"b": {"d": 2}, "e": [1]}
    d = {"a": [1, 2], "b": {"c~/": 3}}
    assert patched(d, [{"op": "add", "path": "/a/-", "value": 3}, {"op": "remove", "path": "/a/0"}, {"op": "move", "from": "/b/c~0~1", "path": "/x"}, {"op": "copy", "from": "/x", "path": "/y"}, {"op": "test", "path": "/y", "value": 3}]) == {"a": [2, 3], "b": {}, "x": 3, "y": 3}
    assert d == {"a": [1, 2], "b": {"c~/": 3}}
    with pytest.raises(StoreError):
        patched(d, [{"op": "remove", "path": "/nope/1"}])
    with pytest.raises(QueryError):
        raise QueryError("the two kinds of errors are apart")


def test_sorted_layout(spark, tmp_path):
    from quillon.sources.layout import SortedLayout

    base = spark.range(1000).select(F.col("id").alias("_record_number"), (F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("B").alias("s"))
    layout = SortedLayout(spark, str(tmp_path / "l"))
    layout.build(base, {"s": 1, "k": -1}, "unicode-lowercase")
    assert layout.verify(base) and not layout.verify(base.where("k > 3"))
    assert {r.k for r in layout.lookup({"k": {"$lt": 5}}).collect()} == set(range(5))
    assert layout.fetch(base, {"k": 14}).first()["_record_number"] == 2
    with pytest.raises(StoreError):
        layout.build(base, {"k": 2})


def test_command_line(spark, tmp_path, capsys):
    from quillon.__main__ import main

    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert main(["tables", str(tmp_path)]) == 0 and main(["find", str(tmp_path), "t", '{"filter": {"id": {"$gt": 1}}}']) == 0
    assert main(["schema", str(tmp_path), "t"]) == 0 and main(["explain", str(tmp_path), "t", "{}"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("t\n") and '{"id":2}' in out
    assert main(["find", str(tmp_path), "t", "{"]) == 1 and main(["find", str(tmp_path), "nope", "{}"]) == 1


def test_a_losing_commit_changes_nothing(spark, store):
    """Both transactions begin at one version, and the second commits while the first has its data written."""
    slow, fast = store.begin(), store.begin()
    slow.patch(1, {"age": 50})
    fast.patch(1, {"age": 60})
    before, after, base = slow.merged(False)
    prepared = store._prepare(after, before, slow.rules, False, base)
    assert fast.commit() == 2
    with pytest.raises(StoreError):
        store._publish(prepared)
    assert [r[3] for r in rows(store.read())] == [60, 20, None]
    assert [(r.txn, r.record_number) for r in store.changes(1).collect()] == [(2, 1)]
    assert cdc.change_stream(spark, store.folder).isStreaming and spark.read.parquet(f"{store.folder}/changes").where("txn = 2").count() == 1
    assert store.cleanup() == []


def test_recovery_publishes_committed_changes(spark, store):
    t = store.begin()
    t.patch(2, {"age": 21})
    before, after, base = t.merged(False)
    p = store._prepare(after, before, t.rules, False, base)
    lost = store._prepare(after, before, t.rules, False, base)
    assert store.files.create(f"{store.folder}/manifests/{p.number:012d}.json", p.manifest())  # and a crash
    assert Store(spark, store.folder).read().where("age = 21").count() == 1
    assert lost.versions[-1].data in store.cleanup()
    assert spark.read.parquet(f"{store.folder}/changes").where("txn = 2").count() == 1
    assert not store.files.create(f"{store.folder}/manifests/{p.number:012d}.json", "{}")


@pytest.fixture
def shop(spark, tmp_path):
    """Three tables in a chain: makers, their goods (cascade), the goods' labels (set null on delete, cascade on update)."""
    folder = str(tmp_path / "shop")
    key = lambda c, t, p, *actions: Constraints(foreign_keys=(ForeignKey((c,), t, (p,), *actions),))
    Store(spark, f"{folder}/maker").create(spark.createDataFrame([(1,), (2,), (3,)], "m int").coalesce(1), Constraints(primary=("m",)))
    Store(spark, f"{folder}/goods").create(spark.createDataFrame([(10, 1), (11, 2), (12, None)], "g int, maker int").coalesce(1), key("maker", "maker", "m", "cascade", "cascade"))
    Store(spark, f"{folder}/tag").create(spark.createDataFrame([("x", 10), ("y", 11)], "t string, goods int").coalesce(1), key("goods", "goods", "g", "set_null", "cascade"))
    return folder


def test_foreign_keys_at_every_commit(spark, shop):
    goods, maker = Store(spark, f"{shop}/goods"), Store(spark, f"{shop}/maker")
    t = goods.begin()
    t.insert([{"g": 13, "maker": 99}])
    with pytest.raises(ConstraintError, match="foreign_key:maker"):
        t.commit()
    t = maker.begin()
    t.delete(1)
    t.commit()
    assert [r["_deleted"] for r in goods.read().orderBy("_record_number").collect()] == [True, False, False]
    assert [r.goods for r in Store(spark, f"{shop}/tag").read().orderBy("t").collect()] == [None, 11]
    t = maker.begin()
    t.patch(2, {"m": 20})
    t.commit()
    assert [r.maker for r in goods.read().orderBy("_record_number").collect()] == [1, 20, None]


def test_catalog_transactions(spark, shop):
    a, b = CatalogTransaction(spark, shop), CatalogTransaction(spark, shop)
    a.table("goods").insert([{"g": 14, "maker": 7}])
    a.table("maker").insert([{"m": 7}])
    assert a.query("goods", {"filter": {"g": 14}}).count() == 1 and a.commit() == 1
    b.table("tag").insert([{"t": "z", "goods": 12}])
    with pytest.raises(StoreError):
        b.commit()
    log = CatalogLog(spark, shop)
    assert sorted((r.seq, r.table) for r in log.changes().collect()) == [(1, "goods"), (1, "maker")]
    assert log.versions_at(0) == {} and log.versions_at(1) == {"goods": 2, "maker": 2} and log.read("goods", 1).count() == 4
    c = CatalogTransaction(spark, shop)
    c.table("goods").insert([{"g": 15, "maker": 8}])
    with pytest.raises(ConstraintError):
        c.commit()
    assert Store(spark, f"{shop}/goods").latest().txn == 2 and log.latest() == 1
    with pytest.raises(StoreError):
        c.table("nope")


def test_constraint_timing(spark, shop):
    t = CatalogTransaction(spark, shop, immediate=True)
    with pytest.raises(ConstraintError):
        t.table("goods").insert([{"g": 14, "maker": 7}])
    t.table("goods").set_deferred("foreign_key:maker")
    t.table("goods").insert([{"g": 14, "maker": 7}])
    with pytest.raises(ConstraintError):
        t.table("goods").set_deferred("foreign_key:maker", deferred=False)
    t.table("maker").insert([{"m": 7}])
    t.table("goods").set_deferred("foreign_key:maker", deferred=False)
    assert t.commit() == 1
    with pytest.raises(StoreError):
        t.table("goods").set_deferred("unique:nope")
