"""The column compiler against the row interpreter, over generated rows and filters."""

import pytest
from pyspark.sql import functions as F

from quillon import interpreter
from quillon.operators.expressions import Scope
from quillon.operators.filters import compile_filter
from quillon.plans.expressions import parse_scalar
from quillon.operators import expressions

TOWNS = ["Ålesund", "ålesund", "Lima", "LIMA", "Łódź", "Bonn", "Ise", "Tomé-Açu", "İzmir", "Gent"]
DEPTHS = [-40, -7, -3, -2, -1, 0, 1, 2, 3, 4, 5, 9, 1 << 30, -(1 << 30)]


def reading(k: int) -> dict:
    """A row by rules of its own index: numbers of all sizes, towns with accents, holes of several kinds."""
    n, town = DEPTHS[k % len(DEPTHS)], TOWNS[(3 * k) % len(TOWNS)]
    return {
        "n": n, "flag": [True, False, None][k % 3], "label": town, "opt": [None, 10, n, -20, 0][k % 5], "x": [0.5, -1.25, None, 1.0, 1e18][(k * 2) % 5],
        "list": [None, [], [1], [n, None, 2], [1, 2, 3], [5, 1]][k % 6], "words": town.split("i"), "sub": {"a": n % 7 if abs(n) < 100 else None, "b": town[:2]}, "objs": [[], [{"k": 2, "s": "v"}], [{"k": n % 5, "s": "u"}, {"k": None, "s": "v"}]][k % 3],
    }


ROWS = [reading(k) for k in range(28)]
SCHEMA = "n long, flag boolean, label string, opt long, x double, list array<long>, words array<string>, sub struct<a:long,b:string>, objs array<struct<k:long,s:string>>"


@pytest.fixture(scope="module")
def frame(spark):
    rows = [tuple(r[k] for k in ("n", "flag", "label", "opt", "x", "list", "words")) + ((r["sub"]["a"], r["sub"]["b"]), [(o["k"], o["s"]) for o in r["objs"]]) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(1).withColumn("i", F.monotonically_increasing_id()).cache()


def filters():
    out = []
    for f, values in {"n": [-2, 0, 3, 2.5, "x", None, True], "label": ["LIMA", "Li", None, 1, "Łódź"], "opt": [None, 10, -20, "a"], "flag": [True, False, None], "x": [0.5, 1, None], "list": [1, None, [1, 2]], "missing": [None, 1], "sub.a": [1, None], "objs.k": [2, None], "list.1": [2, None]}.items():
        for v in values:
            out.append({f: v})
            out += [{f: {op: v}} for op in ("$eq", "$ne")]
            if not isinstance(v, list):
                out += [{f: {op: v}} for op in ("$gt", "$gte", "$lt", "$lte")]
                out += [{f: {"$in": [v, 7]}}, {f: {"$nin": [v, 7]}}, {f: {"$not": {"$gt": v}}}]
        out += [{f: {"$exists": b}} for b in (True, False)]
    out += [{"list": {"$size": n}} for n in range(4)] + [{"list": {"$all": [1]}}, {"list": {"$all": []}}, {"list": {"$elemMatch": {"$gt": 0, "$lt": 3}}}, {"list": {"$elemMatch": {}}}]
    out += [{"objs": {"$elemMatch": {"k": {"$gt": 1}, "s": "v"}}}, {"objs": {"$all": [{"$elemMatch": {"k": 2}}]}}, {"objs": {"$size": 2}}, {"words": {"$all": ["L", "ma"]}}, {"sub": {"a": 1, "b": "Li"}}]
    out += [{"$or": []}, {"$and": []}, {"$not": {"n": 1}}, {"n": {"$in": [1, 2, 3, 4, 5, -1]}}, {"label": {"$in": ["a", "b", "c", "d", "Lima", None]}}]
    out += [{"$expr": {op: ["$n", "$opt"]}} for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")] + [{"$expr": {"$ne": ["$n", "$missing"]}}, {"$expr": {"$eq": [{"$add": ["$n", 1]}, {"$divide": ["$opt", 10]}]}}]
    singles = [f for f in out if len(f) == 1]
    for a, b in zip(singles[::3], singles[1::3]):
        out += [{"$and": [a, b]}, {"$or": [a, b]}, {"$not": {"$or": [a, b]}}]
    return out


@pytest.mark.parametrize("loose", [False, True])
def test_filters(frame, loose):
    every = filters()
    assert len(every) * len(ROWS) >= 1000
    for lo in range(0, len(every), 60):
        part = every[lo : lo + 60]
        columns = [F.coalesce(compile_filter(Scope(frame.drop("i").schema), f, loose), F.lit(False)).alias(f"c{k}") for k, f in enumerate(part)]
        got = frame.orderBy("i").select(*columns).collect()
        for k, f in enumerate(part):
            want = [interpreter.matches(r, f) for r in ROWS]
            assert [g[k] for g in got] == want, f


def test_unguarded_predicates_are_never_null(frame):
    for lo in range(0, len(filters()), 60):
        part = filters()[lo : lo + 60]
        nulls = frame.select(*(F.count_if(compile_filter(Scope(frame.schema), f).isNull()).alias(f"c{k}") for k, f in enumerate(part))).first()
        assert not any(nulls)


EXPRESSIONS = [
    "$n", "$missing", {"$add": ["$n", 2]}, {"$add": ["$n", "$x"]}, {"$subtract": ["$n", "$opt"]}, {"$multiply": ["$n", "$label"]}, {"$divide": ["$n", 4]}, {"$mod": ["$n", 3]}, {"$mod": ["$x", 2]}, {"$abs": "$n"}, {"$ceil": "$x"}, {"$floor": "$x"},
    {"$cond": [{"$gt": ["$n", 0]}, "up", "down"]}, {"$cond": {"if": {"$and": [{"$eq": ["$flag", True]}, {"$not": {"$lt": ["$n", 0]}}]}, "then": "$n", "else": None}}, {"$ifNull": ["$opt", -1]}, {"$ifNull": ["$missing", "none"]},
    {"$concat": ["$label", "-", "$sub.b"]}, {"$concat": ["$label", "$opt"]}, {"$toLower": "$label"}, {"$toUpper": "$label"}, {"$strLenCP": "$label"}, {"$substrCP": ["$label", 1, 2]}, {"$substrCP": ["$label", 9, 2]}, {"$split": ["$label", "i"]},
    {"$indexOfCP": ["$label", "i"]}, {"$indexOfCP": ["$label", "L", 1, 3]}, {"$indexOfCP": ["$label", "", 2]}, {"$indexOfCP": ["$label", "c", 9]}, {"$replaceOne": {"input": "$label", "find": "I", "replacement": "__"}}, {"$replaceAll": {"input": "$label", "find": "l", "replacement": ""}},
    {"$map": {"input": "$list", "in": {"$add": ["$$this", "$$IDX"]}}}, {"$map": {"input": "$words", "as": "w", "in": {"$concat": ["$$w", "!"]}}}, {"$filter": {"input": "$list", "cond": {"$gt": ["$$this", 0]}}}, {"$filter": {"input": "$list", "as": "y", "cond": {"$gte": ["$$y", "$n"]}, "limit": 1}},
    {"$reduce": {"input": "$list", "initialValue": 0, "in": {"$add": ["$$value", {"$multiply": ["$$this", "$$IDX"]}]}}}, {"$reduce": {"input": "$words", "initialValue": "", "in": {"$concat": ["$$value", "$$this", ";"]}}}, {"$let": {"vars": {"a": {"$add": ["$n", 1]}}, "in": {"$multiply": ["$$a", "$$a"]}}}, ["$n", "$missing", 3], {"$literal": "$n"}, "$$ROOT.sub.a", "$sub.b", "$objs.k", "$list.0",
]


def test_expressions(frame):
    s = Scope(frame.drop("i").schema)
    values = [expressions.scalar(s, parse_scalar(e)).given() for e in EXPRESSIONS]
    got = frame.orderBy("i").select(*((v.column if v.type is not None else v.column.cast("string")).alias(f"c{k}") for k, v in enumerate(values))).collect()
    for k, e in enumerate(EXPRESSIONS):
        for g, r in zip(got, ROWS):
            want = interpreter.plain(interpreter.value(parse_scalar(e), r, {}))
            have = g[k]
            if values[k].fanned:  # one element stands for itself, none for nothing
                have = None if not have else have[0] if len(have) == 1 else have
            assert have == want, (e, r)
