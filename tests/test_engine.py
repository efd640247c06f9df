import json

import pytest
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.errors import QueryError
from quillon.limits import STRICT, Limits
from quillon.plans.documents import parse_join, parse_query


@pytest.fixture(scope="module")
def cities(spark):
    rows = [(1, "Quito", 29, True), (2, "rome", 7, False), (3, "Évora", 29, None), (4, None, None, True)]
    return spark.createDataFrame(rows, "ID int, TOWN string, HEIGHT int, COASTAL boolean").withColumn("_record_number", F.col("ID").cast("long"))


@pytest.fixture(scope="module")
def sites(spark):
    rows = [(1, "north gate", 1), (2, "mill", 2), (3, "torn down", 99), (4, "unplaced", None)]
    return spark.createDataFrame(rows, "ID int, CALLED string, CITY int").withColumn("_record_number", F.col("ID").cast("long"))


@pytest.fixture(scope="module")
def engine(spark, cities, sites):
    return Engine(spark, lambda name, ordered: {"cities": cities, "sites": sites}[name])


def ids(df):
    return [r.ID for r in df.collect()]


@pytest.mark.parametrize(
    "bad",
    [
        "{", "[]", {"where": {}}, {"sort": {"A": 0}}, {"sort": {"A": True}}, {"projection": {"A": 1, "B": 0}}, {"collation": "unicode-lowercase"}, {"collation": "x", "sort": {"A": 1}}, {"cursor": "x"}, {"page_size": 0}, {"page_size": 2000}, {"page_size": 5, "skip": 1},
        {"skip": -1}, {"limit": 1.5}, {"filter": {"A": {"$near": [0, 1]}}}, {"filter": {"$nor": []}}, {"filter": {"A": {"$in": 3}}}, {"filter": {"A": {"$size": -1}}}, {"filter": {"A": {"$exists": 1}}}, {"filter": {"$expr": {"$add": [1, 2]}}},
        {"aggregate": []}, {"aggregate": [{"$group": {"_id": None}}], "limit": 3}, {"aggregate": [{"$match": {}}]}, {"aggregate": [{"$count": "n"}, {"$limit": 1}]}, {"aggregate": [{"$count": "$n"}]}, {"aggregate": [{"$group": {"_id": "$A", "x": {"$median": "$A"}}}]},
        {"aggregate": [{"$limit": 1}, {"$limit": 2}, {"$count": "n"}]}, {"aggregate": [{"$count": "n"}, {"$count": "m"}]}, {"aggregate": [{"$group": {"_id": "$A"}}, {"$limit": 1}, {"$sort": {"_id": 1}}]}, {"aggregate": [{"$bucket": {"groupBy": "$A", "boundaries": [3, 1]}}]},
        {"aggregate": [{"$bucketAuto": {"groupBy": "$A", "buckets": 0}}]}, {"aggregate": [{"$unwind": "$a.b"}, {"$count": "n"}]}, {"aggregate": [{"$group": {"_id": None, "x": {"$minN": {"input": "$A", "n": 0}}}}]}, {"aggregate": [{"$lookup": {}}, {"$count": "n"}]}, {"filter": {"$expr": {"$eq": ["$a", {"$toInt": "$b"}]}}},
    ],
)
def test_rejected_documents(bad):
    with pytest.raises(QueryError):
        parse_query(bad)


@pytest.mark.parametrize(
    "bad",
    [
        {"from": "a"}, {"from": "a", "join": {"table": "a", "on": {"ID": {"$eq": {"$field": "ID"}}}}}, {"from": "a", "join": {"table": "b", "type": "theta", "on": {}}}, {"from": "a", "join": {"table": "b", "on": {}}}, {"from": "a", "join": {"table": "b", "type": "cross", "on": {"x": {"$eq": {"$field": "y"}}}}},
        {"from": "a", "join": {"table": "b", "on": {"x": {"$gt": {"$field": "y"}}}}}, {"from": "a", "join": {"table": "b", "on": {"c.x": {"$eq": {"$field": "b.y"}}}}}, {"from": "a", "sort": {}, "join": {"table": "b", "type": "cross"}},
    ],
)
def test_rejected_joins(bad):
    with pytest.raises(QueryError):
        parse_join(bad)


def test_request_size():
    with pytest.raises(QueryError):
        parse_query(json.dumps({"filter": {"A": "x" * (1 << 20)}}))
    assert parse_query(json.dumps({"filter": {"A": "x" * (1 << 20)}}), Limits(request_bytes=None)).filter


def test_find(engine):
    assert ids(engine.find("cities", {"filter": {"HEIGHT": 29}})) == [1, 3]
    assert ids(engine.find("cities", {"filter": {"HEIGHT": {"$ne": 29}}})) == [2, 4]
    assert ids(engine.find("cities", {"filter": {"HEIGHT": None}})) == [4]
    assert ids(engine.find("cities", {"filter": {"HEIGHT": {"$lte": None}}})) == [4]
    assert ids(engine.find("cities", {"filter": {"NOPE": None}})) == []
    assert ids(engine.find("cities", {"filter": {"NOPE": {"$nin": [1]}}})) == [1, 2, 3, 4]
    assert ids(engine.find("cities", {"sort": {"HEIGHT": -1}})) == [1, 3, 2, 4]
    assert ids(engine.find("cities", {"sort": {"HEIGHT": 1, "TOWN": -1}, "skip": 1, "limit": 2})) == [2, 3]
    assert ids(engine.find("cities", {"sort": {"TOWN": 1}, "collation": "unicode-lowercase"})) == [4, 1, 2, 3]
    df = engine.find("cities", {"projection": {"TOWN": 0}})
    assert df.columns == ["ID", "HEIGHT", "COASTAL"]
    assert engine.find("cities", {"filter": {"ID": 99}, "aggregate": [{"$count": "n"}]}).first().n == 0


def test_projection_of_paths(spark):
    df = spark.createDataFrame([(1, (2, "x"), [(1, "a"), (2, "b")], [5, 6, 7])], "a int, s struct<p:int,q:string>, l array<struct<k:int,v:string>>, n array<int>")
    e = Engine(spark)
    r = e.find(df, {"projection": {"s.q": 1, "l.k": 1, "n.1": 1}}).first()
    assert r.asDict(True) == {"s": {"q": "x"}, "l": [{"k": 1}, {"k": 2}], "n": [None, 6]}
    r = e.find(df, {"projection": {"s.q": 0, "l.v": 0, "n.0": 0}}).first()
    assert r.asDict(True) == {"a": 1, "s": {"p": 2}, "l": [{"k": 1}, {"k": 2}], "n": [None, 6, 7]}


def test_pheights_cover_everything_once(engine, cities):
    for sort in ({}, {"sort": {"HEIGHT": -1}}, {"sort": {"TOWN": 1, "HEIGHT": 1}}, {"sort": {"HEIGHT": 1}}):
        seen, cursor = [], None
        while True:
            p = engine.page("cities", sort | {"page_size": 1} | ({"cursor": cursor} if cursor else {}))
            seen += [r.ID for r in p.records]
            cursor = p.cursor
            if cursor is None:
                break
        assert seen == ids(engine.find("cities", sort or {"sort": {"ID": 1}}))
    p = engine.page("cities", {"sort": {"HEIGHT": 1}, "page_size": 2})
    for other in ({"sort": {"HEIGHT": -1}}, {"sort": {"TOWN": 1}}, {}):
        with pytest.raises(QueryError):
            engine.page("cities", other | {"page_size": 2, "cursor": p.cursor})
    with pytest.raises(QueryError):
        engine.page("cities", {"page_size": 2, "cursor": "nonsense"})


def test_ordered_accumulators(spark):
    rows = [(1, "a", 3, None), (2, "b", 1, "x"), (3, "a", 2, "y"), (4, "a", None, "y"), (5, "b", 9, None)]
    df = spark.createDataFrame(rows, "i long, g string, v int, t string").repartition(4).withColumn("_record_number", F.col("i"))
    doc = {"_id": "$g", "first": {"$first": "$t"}, "last": {"$last": "$v"}, "all": {"$push": "$t"}, "set": {"$addToSet": "$t"}, "f2": {"$firstN": {"input": "$v", "n": 2}}, "l2": {"$lastN": {"input": "$v", "n": 2}}, "m2": {"$minN": {"input": "$v", "n": 2}}, "x2": {"$maxN": {"input": "$v", "n": 5}}}
    got = {r["_id"]: r.asDict() for r in Engine(spark).find(df, {"aggregate": [{"$group": doc}]}).collect()}
    assert got["a"] == {"_id": "a", "first": None, "last": None, "all": [None, "y", "y"], "set": [None, "y"], "f2": [3, 2], "l2": [2, None], "m2": [2, 3], "x2": [3, 2]}
    assert got["b"]["all"] == ["x", None] and got["b"]["x2"] == [9, 1]
    down = Engine(spark).find(df, {"aggregate": [{"$sort": {"t": -1, "v": 1}}, {"$group": {"_id": None, "i": {"$push": "$i"}, "last": {"$last": "$i"}}}]}).first()
    assert down.i == [4, 3, 2, 1, 5] and down["last"] == 5


def test_unwind_and_buckets(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "i long, l array<int>").withColumn("_record_number", F.col("i"))
    e = Engine(spark)
    n = lambda stage: e.find(df, {"aggregate": [{"$unwind": stage}, {"$group": {"_id": None, "l": {"$push": "$l"}, "p": {"$push": "$p"}}}]}).first()
    assert n({"path": "$l", "includeArrayIndex": "p"})["l"] == [1, 2] and n({"path": "$l", "includeArrayIndex": "p"})["p"] == [0, 1]
    assert n({"path": "$l", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "p"})["l"] == [1, 2, None, None]
    with pytest.raises(QueryError):
        e.find(df, {"aggregate": [{"$unwind": "$i"}, {"$count": "n"}]})
    heights = spark.createDataFrame([(a,) for a in (7, 18, 29, 45)], "HEIGHT int")
    assert [(r["_id"].min, r["_id"].max, r["count"]) for r in e.find(heights, {"aggregate": [{"$bucketAuto": {"groupBy": "$HEIGHT", "buckets": 2}}]}).collect()] == [(7, 29, 2), (29, 45, 2)]
    for u, b in ((10, 3), (7, 7), (5, 9), (23, 4)):
        df = spark.range(u).select((F.col("id") * 3).alias("v"))
        got = [r["count"] for r in e.find(df, {"aggregate": [{"$bucketAuto": {"groupBy": "$v", "buckets": b}}]}).collect()]
        m = min(u, b)
        assert sum(got) == u and len(got) == m and max(got) - min(got) <= 1
    edges = list(range(0, 300, 3))
    many = e.find(spark.range(400), {"aggregate": [{"$bucket": {"groupBy": "$id", "boundaries": edges, "default": "rest"}}]}).collect()
    assert [(r["_id"], r["count"]) for r in many] == [(str(x), 3) for x in edges[:-1]] + [("rest", 103)]
    few = e.find(spark.range(400), {"aggregate": [{"$group": {"_id": None, "lo": {"$minN": {"input": "$id", "n": 3}}, "hi": {"$maxN": {"input": "$id", "n": 2}}}}]}).first()
    assert few.lo == [0, 1, 2] and few.hi == [399, 398]
    with pytest.raises(Exception, match="outside the boundaries"):
        e.find(heights, {"aggregate": [{"$bucket": {"groupBy": "$HEIGHT", "boundaries": [0, 10]}}]}).collect()


def test_joins_and_missing(engine):
    on = {"cities.ID": {"$eq": {"$field": "sites.CITY"}}}
    got = lambda kind, **more: engine.join({"from": "cities", "join": {"table": "sites", "type": kind, "on": on}} | more)
    assert got("inner").count() == 2 and got("left").count() == 4 and got("right").count() == 4 and got("full").count() == 6
    assert got("semi").columns == ["cities.ID", "cities.TOWN", "cities.HEIGHT", "cities.COASTAL"] and got("semi").count() == 2 and got("anti").count() == 2
    assert got("left", filter={"sites.CALLED": {"$exists": False}}).count() == 2
    assert got("left", filter={"sites.CALLED": None}).count() == 0
    assert got("full", filter={"cities.TOWN": None}).count() == 1  # the fourth user; padding is missing, not null
    assert got("full", filter={"cities.TOWN": {"$exists": False}}).count() == 2
    assert engine.join({"from": "cities", "join": {"table": "sites", "type": "cross"}}).count() == 16
    with pytest.raises(QueryError):
        engine.join({"from": "cities", "join": {"table": "sites", "on": {"cities.NOPE": {"$eq": {"$field": "sites.ID"}}}}})


def test_exact_unsigned_numbers(spark):
    e = Engine(spark)
    df = spark.sql("SELECT * FROM VALUES (1, CAST(18446744073709551615 AS DECIMAL(20,0)), 2L), (2, CAST(9007199254740993 AS DECIMAL(20,0)), 3L) AS t(i, u, n)")
    out = {k: [int(r[k]) for r in e.find(df, {"aggregate": [{"$set": {"x": x}}, {"$group": {"_id": "$i", "x": {"$max": "$x"}}}, {"$sort": {"_id": 1}}]}).withColumnRenamed("x", k).collect()] for k, x in {"less": {"$subtract": ["$u", 1]}, "half": {"$mod": ["$u", 10]}, "same": {"$abs": "$u"}, "more": {"$add": [{"$subtract": ["$u", "$n"]}, 1]}}.items()}
    assert out == {"less": [2**64 - 2, 2**53], "half": [5, 3], "same": [2**64 - 1, 2**53 + 1], "more": [2**64 - 2, 2**53 - 1]}
    assert int(e.find(df, {"aggregate": [{"$group": {"_id": None, "s": {"$sum": "$u"}}}]}).first().s) == 2**64 + 2**53
    with pytest.raises(Exception):
        e.find(df, {"aggregate": [{"$set": {"x": {"$multiply": ["$u", "$u"]}}}, {"$group": {"_id": "$x"}}]}).collect()


def test_split_takes_any_delimiter_but_none(spark):
    e = Engine(spark)
    df = spark.createDataFrame([("a\\Eb", "\\E"), ("a.b", "."), ("a\\Qb", "\\Q"), ("x", "|")], "s string, d string")
    rows = e.find(df, {"aggregate": [{"$set": {"p": {"$split": ["$s", "$d"]}}}, {"$group": {"_id": "$s", "p": {"$max": "$p"}}}]}).collect()
    assert {r["_id"]: r.p for r in rows} == {"a\\Eb": ["a", "b"], "a.b": ["a", "b"], "a\\Qb": ["a", "b"], "x": ["x"]}
    with pytest.raises(Exception, match="delimiter"):
        e.find(spark.createDataFrame([("a", "")], "s string, d string"), {"aggregate": [{"$set": {"p": {"$split": ["$s", "$d"]}}}, {"$group": {"_id": "$p"}}]}).collect()


def test_data_errors(spark, cities):
    e = Engine(spark)
    for bad in ({"$strLenCP": "$TOWN"}, {"$divide": ["$HEIGHT", 0]}, {"$mod": ["$HEIGHT", 0]}, {"$split": ["$TOWN", "x"]}, {"$add": [9223372036854775807, "$ID"]}):
        with pytest.raises(Exception):
            e.find(cities, {"aggregate": [{"$set": {"x": bad}}, {"$group": {"_id": "$x"}}]}).collect()


def test_limits(spark, engine):
    strict = Engine(spark, limits=STRICT)
    with pytest.raises(QueryError):
        strict.find(spark.range(10_001), {"aggregate": [{"$group": {"_id": "$id"}}]})
    assert Engine(spark).find(spark.range(10_001), {"aggregate": [{"$group": {"_id": "$id"}}]}).count() == 10_001


def test_streams_and_explain(engine):
    assert [r.ID for r in engine.stream("cities", {"filter": {"HEIGHT": 29}})] == [1, 3]
    assert [json.loads(x)["ID"] for x in engine.stream("cities", {"projection": {"ID": 1}}).json()] == [1, 2, 3, 4]
    s = engine.stream("cities", {})
    s.cancel()
    assert list(s) == []
    with pytest.raises(QueryError):
        engine.stream("cities", {"sort": {"ID": 1}})
    assert "Filter" in engine.explain("cities", {"filter": {"HEIGHT": 29}})["plan"]


def test_record_numbers_of_many_files(spark, tmp_path):
    spark.range(90).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    e = Engine.of_parquet(spark, str(tmp_path))
    rows = e.table("t", True).collect()
    numbers = [r["_record_number"] for r in rows]
    assert len(set(numbers)) == 90 and None not in numbers and len({n >> 40 for n in numbers}) == 3
    p, seen = None, []
    for _ in range(3):
        p = e.page("t", {"page_size": 30} | ({"cursor": p.cursor} if p else {}))
        seen += [r.id for r in p.records]
    assert sorted(seen) == list(range(90)) and p.cursor is None


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS unused").write.parquet(str(tmp_path / "t.parquet"))
    e = Engine.of_parquet(spark, str(tmp_path))
    plan = e.explain("t", {"filter": {"id": {"$gte": 5}, "v": {"$in": [2, 4, 6, 8, 10, 12]}}, "projection": {"id": 1}})["plan"]
    assert "GreaterThanOrEqual(id,5)" in plan and "In(v" in plan and "unused" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "row_index" not in plan
