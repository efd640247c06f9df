"""The registered queries of the engine, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, numbered
from .ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Tables of the folder; events with parsed properties, documents with an array of words."""
    ship(spark)

    def tables(name: str, ordered: bool) -> DataFrame:
        path = f"{sf_dir}/{name}.parquet"
        df = numbered(spark, path) if ordered else spark.read.parquet(path)
        if name == "events":
            df = df.withColumn("props", F.from_json("props", "k bigint"))
        if name == "documents":
            df = df.withColumn("words", F.split("text", " "))
        return df

    return Engine(spark, tables)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(engine(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def document(name: str, table: str, doc: dict, sql: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A query that is one document; shape turns its result into plain columns."""
    query(name, sql)(lambda e: shape(e.find(table, doc)))


def join(name: str, doc: dict, sql: str) -> None:
    query(name, sql)(lambda e: e.join(doc))


def rounded(*names: str, to: int = 4):
    return lambda df: df.withColumns({n: F.round(n, to) for n in names})


def texts(*names: str):
    """Arrays as comma-joined text."""
    return lambda df: df.withColumns({n: F.array_join(F.transform(n, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",") for n in names})


document(
    "flagship", "lineitem",
    {"filter": {"l_shipdate": {"$lte": "1998-09-02"}}, "aggregate": [
        {"$group": {"_id": "$l_returnflag", "rows": {"$count": {}}, "qty": {"$sum": "$l_quantity"}, "avg_disc": {"$avg": "$l_discount"}}}, {"$sort": {"_id": 1}}]},
    """SELECT l_returnflag AS "_id", count(*) AS rows, sum(l_quantity) AS qty, round(avg(l_discount), 4) AS avg_disc
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1""",
    rounded("avg_disc"),
)

# -- filters, sort, projection, skip, limit ---------------------------------

document(
    "find_range_sort_limit", "orders",
    {"filter": {"o_totalprice": {"$gte": 1000.0, "$lt": 250000.0}}, "sort": {"o_orderpriority": 1, "o_totalprice": -1}, "limit": 50, "projection": {"o_orderkey": 1, "o_orderpriority": 1, "o_totalprice": 1}},
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 250000
       ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50""",
)
document(
    "find_in_nin_ne", "customer",
    {"filter": {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "$ne": "MACHINERY"}, "c_nationkey": {"$nin": [1, 2, 3, 4, 5, 6]}}, "projection": {"c_custkey": 1, "c_mktsegment": 1, "c_nationkey": 1}},
    """SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
       WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_mktsegment <> 'MACHINERY' AND c_nationkey NOT IN (1, 2, 3, 4, 5, 6)""",
)
document(
    "find_or_not", "customer",
    {"filter": {"$or": [{"c_acctbal": {"$gt": 9000}}, {"$and": [{"c_mktsegment": "BUILDING"}, {"$not": {"c_nationkey": {"$lt": 20}}}]}], "c_acctbal": {"$not": {"$lt": 0}}}, "projection": {"c_custkey": 1, "c_acctbal": 1}},
    """SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal > 9000 OR (c_mktsegment = 'BUILDING' AND NOT c_nationkey < 20)) AND coalesce(NOT c_acctbal < 0, true)""",
)
document(
    "find_not", "customer",
    {"filter": {"$or": [{"c_acctbal": {"$gt": 9000}}, {"$and": [{"c_mktsegment": "BUILDING"}, {"$not": {"c_nationkey": {"$lt": 20}}}]}], "c_mktsegment": {"$not": {"$eq": "MACHINERY"}}}, "projection": {"c_custkey": 1, "c_acctbal": 1}},
    """SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal > 9000 OR (c_mktsegment = 'BUILDING' AND NOT c_nationkey < 20)) AND NOT c_mktsegment = 'MACHINERY'""",
)
document(
    "find_exists", "supplier", {"filter": {"s_name": {"$exists": True}, "s_phone": {"$exists": False}, "s_fax": {"$ne": "x"}}, "projection": {"s_suppkey": 1}},
    "SELECT s_suppkey FROM supplier",
)
document(
    "find_skip_exclude", "part", {"sort": {"p_retailprice": -1, "p_partkey": 1}, "skip": 20, "limit": 30, "projection": {"p_name": 0, "p_type": 0}},
    """SELECT p_partkey, p_brand, p_size, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 30 OFFSET 20""",
)
document(
    "collation_lower", "part", {"sort": {"p_name": 1, "p_partkey": 1}, "collation": "unicode-lowercase", "limit": 25, "projection": {"p_partkey": 1, "p_name": 1}},
    "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name) NULLS FIRST, p_partkey LIMIT 25",
)
document(
    "collation_nfkc", "part", {"sort": {"p_brand": 1, "p_partkey": 1}, "collation": "unicode-nfkc-lowercase", "limit": 25, "projection": {"p_partkey": 1, "p_brand": 1}},
    "SELECT p_partkey, p_brand FROM part ORDER BY lower(nfc_normalize(p_brand)) NULLS FIRST, p_partkey LIMIT 25",
)
document(
    "collation_icu_ja", "nation", {"sort": {"n_name": 1}, "collation": "icu4x-2.1.1-ja", "limit": 12, "projection": {"n_nationkey": 1, "n_name": 1}},
    "SELECT n_nationkey, n_name FROM nation ORDER BY n_name COLLATE ja NULLS FIRST, n_nationkey LIMIT 12",
)

for _lang in ("zh", "ko"):
    document(
        f"collation_icu_{_lang}", "customer", {"sort": {"c_mktsegment": 1, "c_custkey": 1}, "collation": f"icu4x-2.1.1-{_lang}", "limit": 15, "projection": {"c_custkey": 1, "c_mktsegment": 1}},
        f"SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment COLLATE {_lang} NULLS FIRST, c_custkey LIMIT 15",
    )

# -- arrays and paths -------------------------------------------------------

document(
    "arr_size_all", "documents", {"filter": {"words": {"$all": ["the"]}, "lang": "en"}, "projection": {"doc_id": 1, "n_chars": 1}},
    "SELECT doc_id, n_chars FROM documents WHERE list_contains(str_split(text, ' '), 'the') AND lang = 'en'",
)
document(
    "arr_elem_match", "embeddings", {"filter": {"embedding": {"$elemMatch": {"$gt": 0.3, "$lt": 0.35}, "$size": 64}}, "projection": {"vec_id": 1}},
    "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x > 0.3 AND x < 0.35)) > 0",
)
document(
    "arr_size", "documents", {"filter": {"words": {"$size": 150}}, "projection": {"doc_id": 1}},
    "SELECT doc_id FROM documents WHERE len(str_split(text, ' ')) = 150",
)
document(
    "arr_index_path", "embeddings", {"filter": {"embedding.0": {"$gt": 0.1}}, "projection": {"vec_id": 1, "label": 1}},
    "SELECT vec_id, label FROM embeddings WHERE embedding[1] > 0.1::FLOAT",
)
document(
    "json_path", "events", {"filter": {"props.k": {"$gte": 50}, "event_type": {"$ne": "view"}}, "aggregate": [{"$group": {"_id": "$event_type", "n": {"$count": {}}, "k": {"$sum": "$props.k"}}}]},
    """SELECT event_type AS "_id", count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events
       WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AND event_type <> 'view' GROUP BY 1""",
)

# -- expressions: $expr and $set --------------------------------------------

document(
    "expr_field_compare", "lineitem", {"filter": {"$expr": {"$and": [{"$gt": ["$l_partkey", "$l_suppkey"]}, {"$lte": ["$l_tax", "$l_discount"]}]}}, "aggregate": [{"$count": "n"}]},
    "SELECT count(*) AS n FROM lineitem WHERE l_partkey > l_suppkey AND l_tax <= l_discount",
)
document(
    "expr_numeric", "lineitem",
    {"aggregate": [
        {"$set": {"rest": {"$mod": ["$l_orderkey", 7]}, "net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, "half": {"$divide": ["$l_quantity", 2]}, "up": {"$ceil": "$l_extendedprice"}, "down": {"$floor": {"$abs": {"$subtract": ["$l_partkey", "$l_suppkey"]}}}}},
        {"$group": {"_id": "$l_linestatus", "net": {"$sum": "$net"}, "half": {"$sum": "$half"}, "up": {"$sum": "$up"}, "down": {"$sum": "$down"}, "rest": {"$sum": "$rest"}, "plus": {"$max": "$l_linenumber"}}}]},
    """SELECT l_linestatus AS "_id", round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, sum(l_quantity / 2) AS half, sum(ceil(l_extendedprice)) AS up,
       CAST(sum(abs(l_partkey - l_suppkey)) AS BIGINT) AS down, CAST(sum(l_orderkey % 7) AS BIGINT) AS rest, max(l_linenumber) AS plus FROM lineitem GROUP BY 1""",
    rounded("net", to=2),
)
document(
    "expr_mod", "lineitem",
    {"aggregate": [
        {"$set": {"rest": {"$mod": ["$l_orderkey", 7]}, "net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, "half": {"$divide": ["$l_quantity", 2]}, "up": {"$ceil": "$l_extendedprice"}, "down": {"$floor": {"$abs": {"$subtract": ["$l_partkey", "$l_suppkey"]}}}}},
        {"$group": {"_id": "$rest", "n": {"$count": {}}, "net": {"$sum": "$net"}, "half": {"$sum": "$half"}, "up": {"$sum": "$up"}, "down": {"$sum": "$down"}}}]},
    """SELECT l_orderkey % 7 AS "_id", count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, sum(l_quantity / 2) AS half, sum(ceil(l_extendedprice)) AS up,
       CAST(sum(abs(l_partkey - l_suppkey)) AS BIGINT) AS down FROM lineitem GROUP BY 1""",
    rounded("net", to=2),
)
document(
    "expr_cond_ifnull_let", "customer",
    {"aggregate": [{"$set": {"tier": {"$let": {"vars": {"b": {"$ifNull": ["$c_acctbal", 0.0]}}, "in": {"$cond": {"if": {"$gte": ["$$b", 5000]}, "then": "high", "else": {"$cond": [{"$lt": ["$$b", 0]}, {"$literal": "debt"}, "low"]}}}}}}}, {"$group": {"_id": "$tier", "n": {"$count": {}}}}]},
    """SELECT CASE WHEN coalesce(c_acctbal, 0) >= 5000 THEN 'high' WHEN coalesce(c_acctbal, 0) < 0 THEN 'debt' ELSE 'low' END AS "_id", count(*) AS n FROM customer GROUP BY 1""",
)
document(
    "str_case_concat", "customer",
    {"aggregate": [{"$set": {"tag": {"$concat": [{"$toLower": "$c_mktsegment"}, ":", {"$toUpper": {"$substrCP": ["$c_name", 0, 3]}}]}}}, {"$sortByCount": "$tag"}]},
    """SELECT concat(lower(c_mktsegment), ':', upper(substr(c_name, 1, 3))) AS "_id", count(*) AS count FROM customer GROUP BY 1""",
)
document(
    "str_len_substr_index", "part",
    {"aggregate": [{"$set": {"n": {"$strLenCP": "$p_name"}, "head": {"$substrCP": ["$p_type", 1, 4]}, "at": {"$indexOfCP": ["$p_type", "A"]}}}, {"$group": {"_id": "$head", "n": {"$sum": "$n"}, "at": {"$sum": "$at"}}}]},
    """SELECT substr(p_type, 2, 4) AS "_id", CAST(sum(length(p_name)) AS BIGINT) AS n, CAST(sum(instr(p_type, 'A') - 1) AS BIGINT) AS at FROM part GROUP BY 1""",
)
document(
    "str_split_replace", "orders",
    {"aggregate": [
        {"$set": {"parts": {"$split": ["$o_orderpriority", "-"]}, "once": {"$replaceOne": {"input": "$o_orderpriority", "find": "I", "replacement": "#"}}, "all": {"$replaceAll": {"input": "$o_orderpriority", "find": "I", "replacement": "##"}}}},
        {"$unwind": "$parts"}, {"$group": {"_id": "$parts", "n": {"$count": {}}, "once": {"$min": "$once"}, "all": {"$max": "$all"}}}]},
    """SELECT part AS "_id", count(*) AS n, min(CASE WHEN instr(o_orderpriority, 'I') > 0 THEN concat(substr(o_orderpriority, 1, instr(o_orderpriority, 'I') - 1), '#', substr(o_orderpriority, instr(o_orderpriority, 'I') + 1)) ELSE o_orderpriority END) AS once,
       max(replace(o_orderpriority, 'I', '##')) AS "all" FROM (SELECT o_orderpriority, unnest(str_split(o_orderpriority, '-')) AS part FROM orders) GROUP BY 1""",
)
document(
    "arr_map_filter_reduce", "embeddings",
    {"aggregate": [
        {"$set": {"kept": {"$reduce": {"input": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0.1]}, "limit": 5}}, "initialValue": 0, "in": {"$add": ["$$value", 1]}}}, "even": {"$filter": {"input": "$embedding", "arrayIndexAs": "i", "cond": {"$eq": [{"$mod": ["$$i", 2]}, 0]}}},
                  "sum": {"$reduce": {"input": {"$map": {"input": "$embedding", "in": {"$multiply": ["$$this", 2]}}}, "initialValue": 0.0, "in": {"$add": ["$$value", "$$this"]}}}}},
        {"$match": {"even": {"$size": 32}}}, {"$group": {"_id": "$label", "n": {"$count": {}}, "sum": {"$sum": "$sum"}, "kept": {"$sum": "$kept"}}}]},
    """SELECT label AS "_id", count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2))), 2) AS sum, CAST(sum(least(5, len(list_filter(embedding, lambda x: x::DOUBLE > 0.1)))) AS BIGINT) AS kept FROM embeddings GROUP BY 1""",
    rounded("sum", to=2),
)

# -- grouping ---------------------------------------------------------------

document(
    "group_sum_avg_minmax_std", "lineitem",
    {"aggregate": [{"$group": {"_id": "$l_returnflag", "q": {"$sum": "$l_quantity"}, "a": {"$avg": "$l_extendedprice"}, "lo": {"$min": "$l_discount"}, "hi": {"$max": "$l_tax"}, "sp": {"$stdDevPop": "$l_quantity"}, "ss": {"$stdDevSamp": "$l_quantity"}}}]},
    """SELECT l_returnflag AS "_id", sum(l_quantity) AS q, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi, round(stddev_pop(l_quantity), 4) AS sp, round(stddev_samp(l_quantity), 4) AS ss FROM lineitem GROUP BY 1""",
    rounded("a", "sp", "ss"),
)
document(
    "group_first_last_push_set", "orders",
    {"aggregate": [{"$sort": {"o_orderdate": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}, "all": {"$push": "$o_orderkey"}, "states": {"$addToSet": "$o_orderstatus"}}}]},
    """WITH s AS (SELECT o_custkey, o_orderstatus, min(rn) AS rn FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) GROUP BY 1, 2)
       SELECT o.o_custkey AS "_id", arg_min(o_orderkey, (-epoch_us(o_orderdate), o_orderkey)) AS first, arg_max(o_orderkey, (-epoch_us(o_orderdate), o_orderkey)) AS last,
       string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) AS "all", any_value(t.states) AS states
       FROM orders o JOIN (SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY rn) AS states FROM s GROUP BY 1) t ON o.o_custkey = t.o_custkey GROUP BY 1""",
    texts("all", "states"),
)
document(
    "group_minn_maxn_firstn", "orders",
    {"aggregate": [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_orderpriority", "lo": {"$minN": {"input": "$o_totalprice", "n": 3}}, "hi": {"$maxN": {"input": "$o_totalprice", "n": 2}}, "head": {"$firstN": {"input": "$o_orderkey", "n": 4}}, "tail": {"$lastN": {"input": "$o_orderkey", "n": 3}}}}]},
    """SELECT o_orderpriority AS "_id", array_to_string(list(o_totalprice::DECIMAL(18,2) ORDER BY o_totalprice)[1:3], ',') AS lo, array_to_string(list(o_totalprice::DECIMAL(18,2) ORDER BY o_totalprice DESC)[1:2], ',') AS hi,
       array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:4], ',') AS head, array_to_string(list_reverse(list(o_orderkey ORDER BY o_orderkey DESC)[1:3]), ',') AS tail FROM orders GROUP BY 1""",
    lambda df: texts("lo", "hi", "head", "tail")(df.withColumns({n: F.transform(n, lambda x: x.cast("decimal(18,2)")) for n in ("lo", "hi")})),
)
document(
    "group_null_empty", "region", {"filter": {"r_name": "NOWHERE"}, "aggregate": [{"$group": {"_id": None, "n": {"$count": {}}, "s": {"$sum": "$r_regionkey"}, "m": {"$max": "$r_name"}}}, {"$project": {"n": 1, "s": 1, "m": 1}}]},
    "SELECT count(*) AS n, CAST(0 AS BIGINT) AS s, max(r_name) AS m FROM region WHERE r_name = 'NOWHERE'",
)
document(
    "group_having_project_sort", "lineitem",
    {"aggregate": [{"$group": {"_id": "$l_suppkey", "rev": {"$sum": "$l_extendedprice"}, "n": {"$count": {}}}}, {"$match": {"n": {"$gte": 5}}}, {"$project": {"_id": 1, "n": 1, "rev": 1}}, {"$sort": {"n": -1, "_id": 1}}, {"$skip": 2}, {"$limit": 20}]},
    """SELECT l_suppkey AS "_id", count(*) AS n, round(sum(l_extendedprice), 2) AS rev FROM lineitem GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, 1 NULLS FIRST LIMIT 20 OFFSET 2""",
    rounded("rev", to=2),
)
document(
    "group_merge_objects", "events",
    {"aggregate": [{"$sort": {"event_id": 1}}, {"$group": {"_id": "$user_id", "props": {"$mergeObjects": "$props"}}}]},
    """SELECT user_id AS "_id", arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k FROM events WHERE props IS NOT NULL GROUP BY 1""",
    lambda df: df.select("_id", F.col("props.k").alias("k")),
)
document(
    "unwind_index", "embeddings", {"aggregate": [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, {"$group": {"_id": "$i", "n": {"$count": {}}, "hi": {"$max": "$embedding"}}}]},
    """SELECT i - 1 AS "_id", count(*) AS n, max(x) AS hi FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1""",
)
query("unwind_preserve", "SELECT count(*) AS n, count(CASE WHEN lang = 'en' THEN 1 END) AS with_word FROM (SELECT lang, unnest(CASE WHEN lang = 'en' THEN str_split(text, ' ') ELSE [NULL] END) AS w FROM documents)")(
    lambda e: e.find(
        e.table("documents", True).withColumn("w", F.when(F.col("lang") == "en", F.col("words"))),
        {"aggregate": [{"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}, {"$set": {"one": {"$cond": [{"$eq": ["$w", None]}, 0, 1]}}}, {"$group": {"_id": None, "n": {"$count": {}}, "with_word": {"$sum": "$one"}}}, {"$project": {"n": 1, "with_word": 1}}]},
    )
)
document(
    "bucket_default", "customer", {"aggregate": [{"$bucket": {"groupBy": "$c_acctbal", "boundaries": [0, 1000, 5000, 8000], "default": -1, "output": {"n": {"$count": {}}, "top": {"$max": "$c_acctbal"}}}}]},
    """SELECT CAST(CASE WHEN c_acctbal >= 0 AND c_acctbal < 1000 THEN 0 WHEN c_acctbal >= 1000 AND c_acctbal < 5000 THEN 1000 WHEN c_acctbal >= 5000 AND c_acctbal < 8000 THEN 5000 ELSE -1 END AS BIGINT) AS "_id", count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1""",
)
document(
    "bucket_auto", "part", {"aggregate": [{"$bucketAuto": {"groupBy": "$p_size", "buckets": 7, "output": {"n": {"$count": {}}}}}]},
    """WITH d AS (SELECT p_size, dense_rank() OVER (ORDER BY p_size) - 1 AS r FROM (SELECT DISTINCT p_size FROM part)), u AS (SELECT count(*) AS u FROM d),
       b AS (SELECT p_size, CAST(floor(((r + 1) * least(7, u) - 1) / u) AS INTEGER) AS b FROM d, u), e AS (SELECT b, min(p_size) AS lo, max(p_size) AS hi FROM b GROUP BY b)
       SELECT e.lo AS min, coalesce(n.lo, e.hi) AS max, count(*) AS n FROM part JOIN b ON part.p_size = b.p_size JOIN e ON b.b = e.b LEFT JOIN e n ON n.b = e.b + 1 GROUP BY 1, 2""",
    lambda df: df.select(F.col("_id.min").alias("min"), F.col("_id.max").alias("max"), "n"),
)
document("sort_by_count", "events", {"aggregate": [{"$sortByCount": "$event_type"}]}, """SELECT event_type AS "_id", count(*) AS count FROM events GROUP BY 1""")
document("count_stage", "orders", {"filter": {"o_orderstatus": "F"}, "aggregate": [{"$count": "n"}]}, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
document("distinct_stage", "orders", {"aggregate": [{"$distinct": "$o_orderpriority"}]}, "SELECT DISTINCT o_orderpriority AS value FROM orders")
document(
    "input_sort_skip_limit", "orders", {"aggregate": [{"$match": {"o_orderstatus": {"$in": ["F", "O"]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 10}, {"$limit": 100}, {"$project": {"o_orderstatus": 1, "o_totalprice": 1}}, {"$group": {"_id": "$o_orderstatus", "n": {"$count": {}}, "s": {"$sum": "$o_totalprice"}}}]},
    """SELECT o_orderstatus AS "_id", count(*) AS n, round(sum(o_totalprice), 2) AS s FROM (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10) GROUP BY 1""",
    rounded("s", to=2),
)

# -- joins ------------------------------------------------------------------


def on(left: str, right: str) -> dict:
    return {left: {"$eq": {"$field": right}}}


CUSTOMER_ORDERS = on("customer.c_custkey", "orders.o_custkey")
join(
    "join_inner", {"from": "customer", "join": {"table": "orders", "type": "inner", "on": CUSTOMER_ORDERS}, "filter": {"orders.o_totalprice": {"$gt": 200000}, "customer.c_mktsegment": "BUILDING"}, "projection": {"customer.c_custkey": 1, "orders.o_orderkey": 1}},
    """SELECT c_custkey AS "customer.c_custkey", o_orderkey AS "orders.o_orderkey" FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING'""",
)
for _kind in ("left", "right", "full"):
    join(
        f"join_{_kind}", {"from": "supplier", "join": {"table": "customer", "type": _kind, "on": on("supplier.s_suppkey", "customer.c_custkey") | on("supplier.s_nationkey", "customer.c_nationkey")}, "projection": {"supplier.s_suppkey": 1, "customer.c_custkey": 1}},
        f"""SELECT s_suppkey AS "supplier.s_suppkey", c_custkey AS "customer.c_custkey" FROM supplier {_kind.upper()} JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey""",
    )
for _kind in ("semi", "anti"):
    join(
        f"join_{_kind}", {"from": "customer", "join": {"table": "supplier", "type": _kind, "on": on("customer.c_custkey", "supplier.s_suppkey")}, "projection": {"customer.c_custkey": 1, "customer.c_acctbal": 1}},
        f"""SELECT c_custkey AS "customer.c_custkey", c_acctbal AS "customer.c_acctbal" FROM customer {_kind.upper()} JOIN supplier ON c_custkey = s_suppkey""",
    )
join(
    "join_cross", {"from": "region", "join": {"table": "nation", "type": "cross"}, "filter": {"$expr": {"$lt": ["$region.r_regionkey", "$nation.n_regionkey"]}}, "projection": {"region.r_name": 1, "nation.n_name": 1}},
    """SELECT r_name AS "region.r_name", n_name AS "nation.n_name" FROM region CROSS JOIN nation WHERE r_regionkey < n_regionkey""",
)
join(
    "join_chain4",
    {"from": "nation", "join": {"table": "customer", "type": "inner", "on": on("nation.n_nationkey", "customer.c_nationkey")}, "joins": [{"table": "orders", "type": "inner", "on": CUSTOMER_ORDERS}, {"table": "lineitem", "type": "left", "on": on("orders.o_orderkey", "lineitem.l_orderkey")}],
     "filter": {"nation.n_regionkey": 2, "orders.o_totalprice": {"$gte": 100000}, "lineitem.l_quantity": {"$gt": 45}}, "projection": {"nation.n_name": 1, "orders.o_orderkey": 1, "lineitem.l_linenumber": 1, "lineitem.l_quantity": 1}},
    """SELECT n_name AS "nation.n_name", o_orderkey AS "orders.o_orderkey", l_linenumber AS "lineitem.l_linenumber", l_quantity AS "lineitem.l_quantity" FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
       LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE n_regionkey = 2 AND o_totalprice >= 100000 AND l_quantity > 45""",
)
join(
    "join_missing_semantics", {"from": "customer", "join": {"table": "supplier", "type": "left", "on": on("customer.c_custkey", "supplier.s_suppkey")}, "filter": {"supplier.s_suppkey": {"$exists": False}, "supplier.s_acctbal": {"$ne": 5}}, "projection": {"customer.c_custkey": 1}},
    """SELECT c_custkey AS "customer.c_custkey" FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey WHERE s_suppkey IS NULL""",
)
query("join_null_isnt_missing", "SELECT count(*) AS n FROM customer WHERE 1 = 0")(
    lambda e: e.join({"from": "customer", "join": {"table": "supplier", "type": "left", "on": on("customer.c_custkey", "supplier.s_suppkey")}, "filter": {"supplier.s_suppkey": None}}).agg(F.count(F.lit(1)).alias("n"))
)

# -- pages ------------------------------------------------------------------


def second_page(e: Engine, doc: dict) -> DataFrame:
    return e.find("orders", doc | {"cursor": e.page("orders", doc).cursor})


query("page_keyset_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 40")(
    lambda e: second_page(e, {"sort": {"o_totalprice": -1, "o_orderkey": 1}, "page_size": 40, "projection": {"o_orderkey": 1, "o_totalprice": 1}})
)
query("page_physical", "SELECT o_orderkey FROM (SELECT o_orderkey, file_row_number AS r FROM (SELECT *, row_number() OVER () - 1 AS file_row_number FROM orders)) WHERE r >= 40 AND r < 80")(
    lambda e: second_page(e, {"page_size": 40, "projection": {"o_orderkey": 1}})
)


# -- versions, changes and constraints ---------------------------------------


def _raised(e: Engine) -> tuple[DataFrame, DataFrame]:
    """Two versions of customer: balances of nation 3 raised, nation 4 gone, and new rows."""
    before = e.table("customer").withColumn("_record_number", F.col("c_custkey") + 1)
    after = before.where("c_nationkey <> 4").withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 10).otherwise(F.col("c_acctbal")))
    new = before.where("c_custkey < 5").withColumn("_record_number", F.col("_record_number") + 10_000_000)
    return before, after.unionByName(new)


@query(
    "cdc_diff",
    """WITH b AS (SELECT c_custkey + 1 AS r, * FROM customer), a AS (SELECT c_custkey + 1 AS r, c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey <> 4
         UNION ALL SELECT c_custkey + 10000001, * FROM customer WHERE c_custkey < 5)
       SELECT coalesce(b.r, a.r) AS record_number, b.r IS NULL AS inserted, a.r IS NULL AS removed FROM b FULL JOIN a ON b.r = a.r
       WHERE b.r IS NULL OR a.r IS NULL OR b.c_acctbal IS DISTINCT FROM a.c_acctbal""",
)
def _cdc_diff(e: Engine) -> DataFrame:
    from .store import changes

    before, after = _raised(e)
    return changes(before, after, False).select("record_number", F.col("before").isNull().alias("inserted"), F.col("after").isNull().alias("removed"))


def _scratch(e: Engine) -> str:
    base = e.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillon-store-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


@query("time_travel", """SELECT 1 AS txn, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier UNION ALL SELECT 2, count(*), round(sum(s_acctbal) + 500, 2) FROM supplier""")
def _time_travel(e: Engine) -> DataFrame:
    from .store import Store

    store = Store(e.spark, _scratch(e))
    store.create(e.table("supplier"))
    t = store.begin()
    t.patch(2, {"$inc": {"s_acctbal": 500.0}})
    t.commit()
    each = [store.read(v).agg(F.lit(v).alias("txn"), F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance")) for v in (1, 2)]
    return each[0].union(each[1])


@query("store_delete_pack", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS record_number FROM supplier WHERE s_nationkey >= 10")
def _store_delete_pack(e: Engine) -> DataFrame:
    from .store import Store

    store = Store(e.spark, _scratch(e))
    store.create(e.table("supplier"))
    t = store.begin()
    t.delete_where({"s_nationkey": {"$lt": 10}})
    t.commit()
    store.pack()
    return store.read().select("s_suppkey", F.col("_record_number").alias("record_number"))


@query("store_row_merge", "SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN 'ours' WHEN s_suppkey = 1 THEN 'theirs' ELSE s_name END AS s_name FROM supplier")
def _store_row_merge(e: Engine) -> DataFrame:
    from .store import Store

    store = Store(e.spark, _scratch(e))
    store.create(e.table("supplier"))
    ours, theirs = store.begin(), store.begin()
    ours.patch(1, {"s_name": "ours"})
    theirs.patch(2, {"s_name": "theirs"})
    theirs.commit()
    ours.commit(merge=True)
    return store.read().select("s_suppkey", "s_name")


@query("constraint_fk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)")
def _constraint_fk(e: Engine) -> DataFrame:
    from .constraints import orphans

    return orphans(e.table("orders"), e.find("customer", {"filter": {"c_nationkey": {"$ne": 7}}}), ["o_custkey"], ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("constraint_unique", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _constraint_unique(e: Engine) -> DataFrame:
    from .constraints import repeated_keys

    return repeated_keys(e.table("orders"), ["o_custkey", "o_orderstatus"])


@query("constraint_check", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0 OR c_mktsegment = 'BUILDING')")
def _constraint_check(e: Engine) -> DataFrame:
    from .constraints import failing_check

    return failing_check(e.table("customer"), {"$or": [{"c_acctbal": {"$gte": 0}}, {"c_mktsegment": "BUILDING"}]}).select("c_custkey")


@query("constraint_cascade", "SELECT n_nationkey, n_regionkey = 2 AS deleted, CASE WHEN n_regionkey = 1 THEN 101 ELSE n_regionkey END AS n_regionkey FROM nation")
def _constraint_cascade(e: Engine) -> DataFrame:
    from .constraints import ForeignKey, propagate

    region = e.table("region").withColumns({"_record_number": F.col("r_regionkey") + 1, "_deleted": F.lit(False)})
    nation = e.table("nation").withColumns({"_record_number": F.col("n_nationkey") + 1, "_deleted": F.lit(False)})
    after = region.withColumns({"_deleted": F.col("r_regionkey") == 2, "r_regionkey": F.when(F.col("r_regionkey") == 1, 101).otherwise(F.col("r_regionkey"))})
    key = ForeignKey(("n_regionkey",), "region", ("r_regionkey",), "cascade", "cascade")
    return propagate(region, after, {"nation": (nation, key)})["nation"].select("n_nationkey", F.col("_deleted").alias("deleted"), F.col("n_regionkey").cast("int").alias("n_regionkey"))


def _stores(e: Engine, **tables) -> str:
    """A folder of stores: name=(frame, constraints)."""
    from .store import Store

    folder = _scratch(e)
    for name, (df, rules) in tables.items():
        Store(e.spark, f"{folder}/{name}").create(df, rules)
    return folder


@query(
    "constraint_cascade_chain",
    """SELECT 'region' AS "table", count(*) AS n, count(CASE WHEN r_regionkey = 2 THEN 1 END) AS deleted FROM region
       UNION ALL SELECT 'nation', count(*), count(CASE WHEN n_regionkey = 2 THEN 1 END) FROM nation
       UNION ALL SELECT 'supplier', count(*), count(CASE WHEN n_regionkey = 2 THEN 1 END) FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _constraint_cascade_chain(e: Engine) -> DataFrame:
    """A region goes, with its nations and their suppliers, in one commit of three tables."""
    from .constraints import Constraints, ForeignKey
    from .store import Store

    up = lambda c, t, p: Constraints(foreign_keys=(ForeignKey((c,), t, (p,), "cascade", "cascade"),))
    folder = _stores(e, region=(e.table("region"), Constraints(primary=("r_regionkey",))), nation=(e.table("nation"), up("n_regionkey", "region", "r_regionkey")), supplier=(e.table("supplier"), up("s_nationkey", "nation", "n_nationkey")))
    t = Store(e.spark, f"{folder}/region").begin()
    t.delete_where({"r_regionkey": 2})
    t.commit()
    each = [Store(e.spark, f"{folder}/{n}").read().agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n"), F.count_if("_deleted").alias("deleted")) for n in ("region", "nation", "supplier")]
    return each[0].union(each[1]).union(each[2])


@query("constraint_deferred", "SELECT s_suppkey, CASE s_suppkey WHEN 0 THEN 'Supplier#1' WHEN 1 THEN 'Supplier#0' ELSE s_name END AS s_name, true AS refused FROM (SELECT s_suppkey, 'Supplier#' || s_suppkey AS s_name FROM supplier)")
def _constraint_deferred(e: Engine) -> DataFrame:
    """Two unique names are swapped: refused step by step, taken once the constraint is deferred to the commit."""
    from .constraints import Constraints
    from .errors import ConstraintError
    from .store import Store

    df = e.table("supplier").select("s_suppkey", F.concat(F.lit("Supplier#"), "s_suppkey").alias("s_name"))
    store = Store(e.spark, _stores(e, supplier=(df, Constraints(unique=(("s_name",),)))) + "/supplier")
    numbers = {r.s_suppkey: r["_record_number"] for r in store.read().where("s_suppkey < 2").collect()}
    refused = False
    t = store.begin(immediate=True)
    try:
        t.patch(numbers[0], {"s_name": "Supplier#1"})
    except ConstraintError:
        refused = True
    t = store.begin(immediate=True)
    t.set_deferred("unique:s_name")
    t.patch(numbers[0], {"s_name": "Supplier#1"})
    t.patch(numbers[1], {"s_name": "Supplier#0"})
    t.commit()
    return store.read().select("s_suppkey", "s_name", F.lit(refused).alias("refused"))


@query(
    "catalog_commit",
    """SELECT 1 AS seq, 'region' AS "table", 1 AS n, count(*) AS nations_then, (SELECT count(*) FROM nation) + 1 AS nations_now FROM nation UNION ALL SELECT 1, 'nation', 1, count(*), count(*) + 1 FROM nation""",
)
def _catalog_commit(e: Engine) -> DataFrame:
    """A child and its new parent in one commit, the catalog's log of it, and the catalog before and after."""
    from .constraints import Constraints, ForeignKey
    from .sources.catalog import Catalog
    from .transactions import CatalogLog, CatalogTransaction

    folder = _stores(e, region=(e.table("region"), Constraints(primary=("r_regionkey",))), nation=(e.table("nation"), Constraints(foreign_keys=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),))))
    t = CatalogTransaction(e.spark, folder)
    t.table("nation").insert([{"n_nationkey": 1000, "n_name": "NEW", "n_regionkey": 77}])
    t.table("region").insert([{"r_regionkey": 77, "r_name": "NEWER"}])
    t.commit()
    log, count = CatalogLog(e.spark, folder), {"aggregate": [{"$count": "n"}]}
    then = Catalog(e.spark, folder).engine(at=1).find("nation", count).select(F.col("n").alias("nations_then"))
    now = Catalog(e.spark, folder).engine(seq=1).find("nation", count).select(F.col("n").alias("nations_now"))
    changed = log.changes().groupBy(F.col("seq").cast("int").alias("seq"), "table").agg(F.count(F.lit(1)).alias("n"))
    return changed.crossJoin(then).crossJoin(now)  # one row each


@query("row_history", "SELECT 1 AS txn, 'r0' AS s_name UNION ALL SELECT 3, 'r2' UNION ALL SELECT 4, 'r3' UNION ALL SELECT 5, 'r4'")
def _row_history(e: Engine) -> DataFrame:
    """A row after each commit that changed it: replaced, merged, patched; the second commit changed another row."""
    from .store import Store

    store = Store(e.spark, _scratch(e))
    store.create(e.table("supplier").select("s_suppkey", F.lit("r0").alias("s_name"), "s_nationkey"))
    for step in (lambda t: t.patch(2, {"s_nationkey": 1000}), lambda t: t.replace(1, {"s_suppkey": 0, "s_name": "r2"}), lambda t: t.merge_patch(1, {"s_name": "r3"}), lambda t: t.json_patch(1, [{"op": "replace", "path": "/s_name", "value": "r4"}])):
        t = store.begin()
        step(t)
        t.commit()
    return store.row_versions(1).select(F.col("txn").cast("int").alias("txn"), F.get_json_object("after", "$.s_name").alias("s_name"))


@query("store_default_gc_backup", "SELECT 'kept' AS what, 1 AS n UNION ALL SELECT 'dropped', 2 UNION ALL SELECT 'rows', count(*) + 1 FROM region UNION ALL SELECT 'defaulted', 1 UNION ALL SELECT 'restored', count(*) FROM region")
def _store_default_gc_backup(e: Engine) -> DataFrame:
    from .constraints import Constraints
    from .store import Store

    store, copy = Store(e.spark, _scratch(e)), _scratch(e)
    store.create(e.table("region"), Constraints(defaults={"r_name": "by default"}))
    store.backup(copy)
    t = store.begin()
    t.insert([{"r_regionkey": 500}])
    t.commit()
    rows, defaulted = store.read().count(), store.read().where("r_name = 'by default'").count()
    store.restore(copy)
    dropped = store.gc(1)
    return e.spark.createDataFrame([("kept", len(store.manifest())), ("dropped", len(dropped)), ("rows", rows), ("defaulted", defaulted), ("restored", store.read().count())], "what string, n long")


# -- further operators --------------------------------------------------------

document(
    "find_eq", "orders", {"filter": {"o_orderstatus": {"$eq": "F"}, "o_totalprice": {"$gt": 200000}}, "projection": {"o_orderkey": 1}},
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
)
document(
    "expr_or_not_ne", "lineitem",
    {"filter": {"$expr": {"$or": [{"$ne": ["$l_linestatus", "O"]}, {"$not": {"$lt": ["$l_tax", "$l_discount"]}}]}}, "aggregate": [{"$group": {"_id": "$l_returnflag", "n": {"$count": {}}}}]},
    """SELECT l_returnflag AS "_id", count(*) AS n FROM lineitem WHERE l_linestatus <> 'O' OR NOT l_tax < l_discount GROUP BY 1""",
)
document(
    "expr_array_root_current", "part",
    {"aggregate": [{"$set": {"three": ["$p_size", 1, "$$ROOT.p_partkey"], "brand": "$$CURRENT.p_brand"}}, {"$unwind": {"path": "$three", "includeArrayIndex": "i"}}, {"$group": {"_id": "$brand", "n": {"$count": {}}, "sum": {"$sum": "$three"}, "places": {"$sum": "$i"}}}]},
    """SELECT p_brand AS "_id", 3 * count(*) AS n, CAST(sum(p_size + 1 + p_partkey) AS BIGINT) AS sum, 3 * count(*) AS places FROM part GROUP BY 1""",
)
document(
    "expr_index_of_range", "part", {"aggregate": [{"$set": {"at": {"$indexOfCP": ["$p_type", "E", 2, 9]}}}, {"$group": {"_id": "$at", "n": {"$count": {}}}}]},
    """SELECT CAST(CASE WHEN instr(substr(p_type, 3, 7), 'E') > 0 THEN instr(substr(p_type, 3, 7), 'E') + 1 ELSE -1 END AS BIGINT) AS "_id", count(*) AS n FROM part GROUP BY 1""",
)
document(
    "arr_filter_limit_reduce_index", "embeddings",
    {"aggregate": [{"$set": {"sum": {"$reduce": {"input": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0.1]}, "limit": 5}}, "initialValue": 0.0, "arrayIndexAs": "i", "in": {"$add": ["$$value", {"$multiply": ["$$this", {"$add": ["$$i", 1]}]}]}}}}},
                   {"$group": {"_id": "$label", "sum": {"$sum": "$sum"}, "most": {"$max": "$sum"}}}]},
    """SELECT label AS "_id", round(sum(s), 3) AS sum, round(max(s), 3) AS most FROM (SELECT label, coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x > 0.1)[1:5], lambda x, i: x::DOUBLE * i)), 0) AS s FROM embeddings) GROUP BY 1""",
    rounded("sum", "most", to=3),
)
document(
    "arr_all_elem_match", "embeddings", {"filter": {"embedding": {"$all": [{"$elemMatch": {"$gt": 0.35}}, {"$elemMatch": {"$lt": -0.35}}]}}, "projection": {"vec_id": 1}},
    "SELECT vec_id FROM embeddings WHERE list_max(embedding) > 0.35 AND list_min(embedding) < -0.35",
)
document(
    "projection_nested", "events", {"filter": {"event_type": "click"}, "projection": {"event_id": 1, "props.k": 1}},
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'",
    lambda df: df.select("event_id", F.col("props.k").alias("k")),
)
document(
    "group_having_sum", "lineitem", {"aggregate": [{"$group": {"_id": "$l_suppkey", "rev": {"$sum": "$l_extendedprice"}, "n": {"$count": {}}}}, {"$match": {"n": {"$gte": 5}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 20}]},
    """SELECT l_suppkey AS "_id", round(sum(l_extendedprice), 2) AS rev, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, 1 NULLS FIRST LIMIT 20""",
    rounded("rev", to=2),
)
document(
    "bucket_many", "orders", {"aggregate": [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": list(range(0, 500_001, 5000)), "default": -1, "output": {"n": {"$count": {}}}}}]},
    """SELECT CAST(CASE WHEN o_totalprice >= 0 AND o_totalprice < 500000 THEN floor(o_totalprice / 5000) * 5000 ELSE -1 END AS BIGINT) AS "_id", count(*) AS n FROM orders GROUP BY 1""",
)


def placed(df: DataFrame) -> DataFrame:
    """The order of few sorted rows as a column, so that it counts in comparisons."""
    return df.withColumn("place", F.monotonically_increasing_id() + 1)  # a limit leaves one partition


@query(
    "collation_lower_accents",
    """WITH w AS (SELECT DISTINCT unnest(str_split(text, ' ')) AS w FROM documents), n AS (SELECT CASE WHEN length(w) % 2 = 0 THEN upper(w) ELSE w END AS w FROM w WHERE regexp_matches(w, '^[a-zA-ZÀ-ÖØ-Þà-öø-þ]+$') AND regexp_matches(w, '[À-ÖØ-Þà-öø-þ]')),
       u AS (SELECT min(w) AS w FROM n GROUP BY lower(w)) SELECT w, row_number() OVER (ORDER BY lower(w)) AS place FROM u ORDER BY lower(w) LIMIT 60""",
)
def _collation_lower_accents(e: Engine) -> DataFrame:
    """Words of the documents with accented letters, every other in capitals."""
    w = e.table("documents").select(F.explode(F.split("text", " ")).alias("w")).distinct().where(F.col("w").rlike("^[a-zA-ZÀ-ÖØ-Þà-öø-þ]+$") & F.col("w").rlike("[À-ÖØ-Þà-öø-þ]"))
    w = w.select(F.when(F.length("w") % 2 == 0, F.upper("w")).otherwise(F.col("w")).alias("w")).groupBy(F.lower("w")).agg(F.min("w").alias("w")).select("w")
    return placed(e.find(w, {"sort": {"w": 1}, "collation": "unicode-lowercase", "limit": 60}))


_WIDE, _NARROW = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26)), "".join(chr(65 + i) for i in range(26)) + "".join(chr(97 + i) for i in range(26))


@query(
    "collation_nfkc_wide",
    f"""WITH w AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN translate(n_name, '{_NARROW}', '{_WIDE}') ELSE lower(n_name) END AS w FROM nation)
        SELECT n_nationkey, w, row_number() OVER (ORDER BY lower(translate(w, '{_WIDE}', '{_NARROW}')), n_nationkey) AS place FROM w ORDER BY place LIMIT 20""",
)
def _collation_nfkc_wide(e: Engine) -> DataFrame:
    """Names of nations, every other in full-width letters: equal to the narrow ones under compatibility normalisation alone."""
    w = e.table("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.translate("n_name", _NARROW, _WIDE)).otherwise(F.lower("n_name")).alias("w"))
    return placed(e.find(w, {"sort": {"w": 1, "n_nationkey": 1}, "collation": "unicode-nfkc-lowercase", "limit": 20}))


#: First code point and number of the characters that the queries below sort; every seventh of them.
_SCRIPTS = {"ja": (0x3041, 86 * 7), "zh": (0x4E00, 300 * 7), "ko": (0xAC00, 300 * 7)}


def _collation_of(lang: str) -> None:
    first, n = _SCRIPTS[lang]

    @query(
        f"collation_icu_{lang}_script",
        f"SELECT w, row_number() OVER (ORDER BY w COLLATE {lang}) AS place FROM (SELECT chr({first} + CAST(i AS INTEGER)) || chr({first} + CAST({n} - i AS INTEGER)) AS w FROM range(0, {n}, 7) t(i)) ORDER BY place LIMIT 80",
    )
    def run(e: Engine) -> DataFrame:
        words = e.spark.createDataFrame([(chr(first + i) + chr(first + n - i),) for i in range(0, n, 7)], "w string")
        return placed(e.find(words, {"sort": {"w": 1}, "collation": f"icu4x-2.1.1-{lang}", "limit": 80}))


for _lang in _SCRIPTS:
    _collation_of(_lang)


@query("stream_rows", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def _stream_rows(e: Engine) -> DataFrame:
    """A row stream read as JSON lines by the client."""
    import json

    rows = [json.loads(x) for x in e.stream("nation", {"filter": {"n_regionkey": {"$in": [1, 3]}}, "projection": {"n_nationkey": 1, "n_name": 1}}).json()]
    return e.spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


@query("explain_pushdown", "SELECT 'o_custkey' AS field, true AS pushed, false AS unused UNION ALL SELECT 'o_totalprice', true, false")
def _explain_pushdown(e: Engine) -> DataFrame:
    """Which predicates the plan of a filter gives to the scan, and whether it reads a column that nothing needs."""
    plan = e.explain("orders", {"filter": {"o_custkey": {"$gte": 5}, "o_totalprice": {"$lt": 1000.5}}, "projection": {"o_orderkey": 1}})["plan"]
    pushed, schema = plan.split("PushedFilters")[1].split("\n")[0], plan.split("ReadSchema")[1].split("\n")[0]
    return e.spark.createDataFrame([(f, f in pushed, "o_orderpriority" in schema) for f in ("o_custkey", "o_totalprice")], "field string, pushed boolean, unused boolean")


@query("validation", "SELECT 'query' AS kind, 9 AS refused UNION ALL SELECT 'join', 3 UNION ALL SELECT 'page', 2 UNION ALL SELECT 'limit', 1")
def _validation(e: Engine) -> DataFrame:
    """Documents, cursors and results that must be refused."""
    from .errors import QueryError
    from .limits import STRICT
    from .plans.documents import parse_join, parse_query

    page = e.page("orders", {"sort": {"o_totalprice": 1}, "page_size": 5})
    strict = Engine(e.spark, e._tables, STRICT)
    tries = [("query", lambda d=d: parse_query(d)) for d in ({"having": {}}, {"sort": {"A": 3}}, {"limit": -2}, {"skip": "1"}, {"filter": {"A": {"$almost": 1}}}, {"projection": {"A": 0, "B": 1}}, {"aggregate": []}, {"page_size": 0}, {"collation": "unicode-lowercase"})]
    tries += [("join", lambda d=d: parse_join(d)) for d in ({"from": "a"}, {"from": "a", "join": {"table": "b", "type": "outermost", "on": {}}}, {"from": "a", "join": {"table": "b", "on": {}}})]
    tries += [("page", lambda d=d: e.find("orders", d)) for d in ({"sort": {"o_custkey": 1}, "page_size": 5, "cursor": page.cursor}, {"page_size": 5, "cursor": "tampered"})]
    tries += [("limit", lambda: strict.find("lineitem", {"aggregate": [{"$group": {"_id": {"$add": ["$l_extendedprice", "$l_partkey"]}}}]}) and strict.find(e.spark.range(10_001), {"aggregate": [{"$group": {"_id": "$id"}}]}))]
    refused = {k: 0 for k, _ in tries}
    for kind, run in tries:
        try:
            run()
        except QueryError:
            refused[kind] += 1
    return e.spark.createDataFrame(list(refused.items()), "kind string, refused int")


@query("catalog_discovery", "SELECT 'd' AS name, count(*) AS n FROM region UNION ALL SELECT 'p', count(*) FROM nation UNION ALL SELECT 's', count(*) FROM supplier UNION ALL SELECT 'x', count(*) FROM region")
def _catalog_discovery(e: Engine) -> DataFrame:
    """Tables of four kinds that one folder holds, found by name and counted."""
    from .sources import dbf, xbf
    from .sources.catalog import Catalog
    from .store import Store

    folder = _scratch(e)
    dbf.register(e.spark)
    xbf.register(e.spark)
    dbf.write_dbf(e.table("region").withColumnsRenamed({"r_regionkey": "rkey", "r_name": "rname"}), f"{folder}/d.dbf")
    xbf.write_xbf(e.table("region"), f"{folder}/x.xbf")
    e.table("nation").write.parquet(f"{folder}/p.parquet")
    Store(e.spark, f"{folder}/s").create(e.table("supplier"))
    catalog = Catalog(e.spark, folder)
    engine = catalog.engine()
    rows = [(n, engine.find(n, {"aggregate": [{"$count": "n"}]}).first().n) for n in catalog.table_names()]
    return e.spark.createDataFrame(rows, "name string, n long")


@query("dbf_dates_and_marks", "SELECT o_orderkey AS orderkey, strftime(o_orderdate, '%Y%m%d') AS day, o_orderstatus = 'F' AS final FROM orders")
def _dbf_dates_and_marks(e: Engine) -> DataFrame:
    """Date and logical fields of a DBF file, by way of an XBF file made from it."""
    from .sources import dbf, xbf

    dbf.register(e.spark)
    xbf.register(e.spark)
    folder = _scratch(e)
    dbf.write_dbf(e.table("orders").select(F.col("o_orderkey").alias("orderkey"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("final")), f"{folder}/o.dbf")
    xbf.dbf_to_xbf(e.spark, f"{folder}/o.dbf", f"{folder}/o.xbf")
    return e.spark.read.format("xbf").load(f"{folder}/o.xbf").select("orderkey", "day", "final")


# -- files --------------------------------------------------------------------


@query("dbf_round_trip", "SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nation, round(s_acctbal, 2) AS acctbal FROM supplier")
def _dbf_round_trip(e: Engine) -> DataFrame:
    """Written as one DBF file in the shared folder and read back in ranges of records."""
    from .sources import dbf

    dbf.register(e.spark)
    path = _scratch(e) + "/supplier.dbf"
    dbf.write_dbf(e.table("supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acctbal")), path)
    return e.spark.read.format("dbf").option("rows", 40).load(path).select("suppkey", "name", F.col("nation").cast("int").alias("nation"), F.round("acctbal", 2).alias("acctbal"))


@query("xbf_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _xbf_round_trip(e: Engine) -> DataFrame:
    """All orders written as one XBF file and read back."""
    from .sources import xbf

    xbf.register(e.spark)
    path = _scratch(e) + "/orders.xbf"
    xbf.write_xbf(e.find("orders", {"projection": {"o_orderkey": 1, "o_orderstatus": 1, "o_totalprice": 1}}), path)
    return e.spark.read.format("xbf").option("rows", 5000).load(path).drop("_record_number", "_deleted")


@query("xbf_representable", "SELECT 'p_name' AS column, 'trailing blanks' AS reason, count(*) AS n FROM part UNION ALL SELECT 'p_retailprice_in_full', 'name longer than 10 bytes', count(*) FROM part")
def _xbf_representable(e: Engine) -> DataFrame:
    from .sources import xbf

    return xbf.representable(e.table("part").select(F.concat("p_name", F.lit(" ")).alias("p_name"), F.round("p_retailprice", 2).alias("p_retailprice_in_full")))


@query("json_interpreter", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def _json_interpreter(e: Engine) -> DataFrame:
    """Filter and projection over JSON text by the row interpreter, for rows of mixed types."""
    from .interpreter import find_json

    rows = e.table("events").select(F.to_json(F.struct("event_id", "props")).alias("v"))
    out = find_json(rows, "v", {"filter": {"props.k": {"$gte": 90}}, "projection": {"event_id": 1}})
    return out.select(F.from_json("value", "event_id bigint")["event_id"].alias("event_id"))


@query("cdc_stream", "SELECT 1 AS txn, 'insert' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 2, 'update', 1 UNION ALL SELECT 3, 'insert', 2")
def _cdc_stream(e: Engine) -> DataFrame:
    """The change log read as a stream and counted."""
    from .store import Store
    from .streaming.cdc import change_counts, change_stream

    store = Store(e.spark, _scratch(e))
    store.create(e.table("supplier"))
    t = store.begin()
    t.patch(3, {"s_name": "new"})
    t.commit()
    t = store.begin()
    t.insert([{"s_suppkey": 900001}, {"s_suppkey": 900002}])
    t.commit()
    name = f"cdc_{uuid.uuid4().hex}"
    q = change_counts(change_stream(e.spark, store.folder)).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return e.spark.table(name).select(F.col("txn").cast("int").alias("txn"), "kind", "n")


@query("layout_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey >= 10 AND o_custkey < 20 AND o_totalprice > 1000")
def _layout_lookup(e: Engine) -> DataFrame:
    """Rows found through a layout sorted by customer and falling price."""
    from .sources.layout import SortedLayout

    base, layout = e.table("orders", True), SortedLayout(e.spark, _scratch(e))
    layout.build(base, {"o_custkey": 1, "o_totalprice": -1})
    return layout.fetch(base, {"o_custkey": {"$gte": 10, "$lt": 20}, "o_totalprice": {"$gt": 1000.0}}).select("o_orderkey", "o_totalprice")
