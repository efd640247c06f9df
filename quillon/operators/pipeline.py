"""Aggregation pipelines over DataFrames.

Row order is a list of key columns that travels along: it costs nothing unless a
stage or an accumulator asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.order import Key, columns, comparable, dense_rank, sort_key
from ..plans.stages import Accumulator, Pipeline
from .expressions import Scope, scalar
from .filters import compile_filter
from .projection import project, quoted
from .values import ARRAY, NULL, NUMBER, OBJECT, Value, resolve

RECORD = "_record_number"
MOST_CASES = 64  # buckets spelled out as cases; more are looked up in an array


@dataclass
class Rows:
    df: DataFrame
    order: list[Key] = field(default_factory=list)

    @property
    def hidden(self) -> set[str]:
        return {k.name for k in self.order} | {RECORD, "_deleted"}

    @property
    def scope(self) -> Scope:
        return Scope(self.df.schema, hidden=frozenset(self.hidden))

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*columns(self.order)) if self.order else self.df


def needs_order(plan: Pipeline) -> bool:
    """Whether any stage or accumulator depends on the order of rows."""
    accumulators = plan.terminal[1][-1] if plan.terminal[0] in ("$group", "$bucket", "$bucketAuto") else {}
    ordered = {"$first", "$last", "$firstN", "$lastN", "$push", "$addToSet", "$mergeObjects", "$minN", "$maxN"}
    return any(op in ("$sort", "$skip", "$limit") for op, _ in plan.input) or any(a.op in ordered for a in accumulators.values())


def run(rows: Rows, plan: Pipeline) -> DataFrame:
    for op, arg in plan.input:
        rows = STAGES[op](rows, arg)
    op, arg = plan.terminal
    df = TERMINALS[op](rows, arg)
    names = [k for k, _ in plan.output]
    for op, arg in plan.output:
        if op == "$match":
            df = df.where(compile_filter(Scope(df.schema), arg))
        elif op == "$project":
            df = project(df, arg, set())
        elif op == "$sort":
            keys = [(resolve(Scope(df.schema).schema, f), way) for f, way in arg if f in df.columns]
            tie = [F.to_json(F.struct(quoted("_id")))] if "_id" in df.columns else []
            df = df.orderBy(*(sort_key(v).asc() if way == 1 else sort_key(v).desc() for v, way in keys), *tie)
        else:
            if "$sort" not in names and "_id" in df.columns and plan.terminal[0] == "$group":
                df = df.orderBy(F.to_json(F.struct("_id")))  # groups come in the order of their key's text
            df = df.offset(arg) if op == "$skip" else df.limit(arg)
    return df


def match(rows: Rows, f: dict) -> Rows:
    return Rows(rows.df.where(compile_filter(rows.scope, f, True)), rows.order)


def unwind(rows: Rows, arg) -> Rows:
    name, index, keep = arg
    df, v = rows.df, resolve(rows.df.schema, name)
    if v.present is False or v.kind == NULL:
        if not keep:
            return Rows(df.where(F.lit(False)), rows.order)
        return Rows(df.withColumn(index, F.lit(None).cast("long")) if index else df, rows.order)
    if v.kind != ARRAY:
        raise QueryError(f"$unwind needs an array: {name}")
    place = f"_pos_{len(rows.order)}"
    explode = F.posexplode_outer if keep else F.posexplode
    others = [quoted(n) for n in df.columns if n != name]
    out = df.select(*others, explode(v.column).alias(place, name))
    if index:
        out = out.withColumn(index, F.col(place).cast("long"))
    return Rows(out, [*rows.order, Key(place)] if rows.order else [])


def set_fields(rows: Rows, fields: dict) -> Rows:
    s = rows.scope
    return Rows(rows.df.withColumns({k: typed(scalar(s, x).given()) for k, x in fields.items()}), rows.order)


def typed(v: Value) -> Column:
    return v.column if v.type is not None else v.column.cast("string")


def project_input(rows: Rows, projection: dict) -> Rows:
    kept = project(rows.df, projection, set())
    hidden = [n for n in rows.hidden if n in rows.df.columns]
    if 1 in projection.values():
        kept = project(rows.df, projection | {h: 1 for h in hidden}, set())
    return Rows(kept, rows.order)


def sort(rows: Rows, keys) -> Rows:
    df, order = rows.df, []
    for i, (f, way) in enumerate(keys):
        v = resolve(df.schema, f)
        if v.present is False or v.type is None:
            continue
        name = f"_sort_{len(rows.order)}_{i}"
        df = df.withColumn(name, sort_key(v))
        order.append(Key(name, way == 1))
    return Rows(df, [*order, *rows.order])


def skip(rows: Rows, n: int) -> Rows:
    return Rows(rows.sorted().offset(n), rows.order)


def limit(rows: Rows, n: int) -> Rows:
    return Rows(rows.sorted().limit(n), rows.order)


STAGES = {"$match": match, "$unwind": unwind, "$set": set_fields, "$project": project_input, "$sort": sort, "$skip": skip, "$limit": limit}


class Aggregates:
    """Accumulators over rows grouped by a column `_id` (or over all rows, without one).

    Those with state of fixed size go into one aggregation. Each of the others has
    its own reduction before values are collected: ranks cut off below n, or
    distinct values with their first place; it is joined on the group key.
    """

    def __init__(self, rows: Rows, key: Value | None):
        self.rows, self.keyed = rows, key is not None
        self.df = rows.df.withColumn("__id", typed(key.given())) if key is not None else rows.df
        self.scope = rows.scope
        self.order = comparable(rows.df.schema, rows.order) if rows.order else F.lit(0)

    def grouped(self, df: DataFrame):
        return df.groupBy("__id") if self.keyed else df.groupBy()

    def build(self, accumulators: dict[str, Accumulator]) -> DataFrame:
        plain, apart = {}, {}
        for name, a in accumulators.items():
            if a.op in ("$minN", "$maxN", "$firstN", "$lastN", "$addToSet"):
                apart[name] = a
            else:
                plain[name] = self.plain(a)
        df = self.grouped(self.df).agg(*(c.alias(n) for n, c in plain.items()), F.count(F.lit(1)).alias("__rows"))
        for name, a in apart.items():
            other = (self.distinct if a.op == "$addToSet" else self.best)(name, a)
            if self.keyed:
                other = other.withColumnRenamed("__id", "__other")
                df = df.join(other, df["__id"].eqNullSafe(other["__other"]), "left").drop("__other")
            else:
                df = df.crossJoin(other)  # one row with one row
            df = df.withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))
        names = [quoted(n) for n in accumulators]
        id_ = F.col("__id") if self.keyed else F.lit(None).cast("string")
        return df.select(id_.alias("_id"), *names)

    def value(self, tree) -> Value:
        return scalar(self.scope, tree).given()

    def plain(self, a: Accumulator) -> Column:
        if a.op == "$count":
            return F.count(F.lit(1))
        v = self.value(a.operand)
        c = typed(v)
        if a.op in ("$sum", "$avg", "$stdDevPop", "$stdDevSamp"):
            if v.kind != NUMBER:
                return F.count(F.lit(None)) if a.op == "$sum" else F.max(F.lit(None).cast("double"))
            if a.op == "$sum":
                if isinstance(v.type, T.DecimalType) and v.type.scale == 0:
                    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,0)"))
                whole = isinstance(v.type, T.IntegralType)
                return F.coalesce(F.sum(c.cast("long" if whole else "double")), F.lit(0).cast("long" if whole else "double"))
            f = {"$avg": F.avg, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}[a.op]
            return f(c.cast("double"))
        if a.op == "$min":
            return F.min(c)
        if a.op == "$max":
            return F.max(c)
        if a.op in ("$first", "$last"):
            pick = F.min_by if a.op == "$first" else F.max_by
            return pick(F.struct(c.alias("v")), self.order)["v"]
        if a.op == "$push":
            return F.transform(F.array_sort(F.collect_list(F.struct(self.order.alias("o"), c.alias("v")))), lambda e: e["v"])
        if v.kind == NULL:
            return F.max(F.lit(None).cast("string"))
        if v.kind != OBJECT:
            raise QueryError("$mergeObjects takes objects")
        if isinstance(v.type, T.MapType):
            maps = F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(self.order.alias("o"), F.map_entries(c).alias("v"))))), lambda e: F.map_from_entries(e["v"]))
            empty = F.create_map().cast(v.type)
            return F.aggregate(maps, empty, lambda x, m: F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(m, k)), m))
        # every object of a typed column has all fields, so the last one wins whole
        return F.max_by(c, F.when(c.isNotNull(), self.order))

    def best(self, name: str, a: Accumulator) -> DataFrame:
        """The n first rows of each group by value or by order; the rank's bound is applied before and after the exchange."""
        v = self.value(a.operand)
        df = self.df.withColumn("__v", typed(v)).withColumn("__o", self.order)
        if a.op in ("$minN", "$maxN"):
            df = df.where(F.col("__v").isNotNull())
        by = {"$minN": [F.col("__v").asc(), F.col("__o").asc()], "$maxN": [F.col("__v").desc(), F.col("__o").asc()], "$firstN": [F.col("__o").asc()], "$lastN": [F.col("__o").desc()]}[a.op]
        n = self.value(a.n).column.cast("int")
        if self.keyed:
            ranked = df.withColumn("__r", F.row_number().over(W.partitionBy("__id").orderBy(*by))).where(F.col("__r") <= n)
        else:
            # n is a constant here; each task keeps n rows, and only those meet in one
            ranked = df.orderBy(*by).limit(a.n.value).withColumn("__r", F.row_number().over(W.orderBy(*by)))
        items = F.array_sort(F.collect_list(F.struct("__r", "__v")))
        if a.op == "$lastN":
            items = F.reverse(items)
        return self.grouped(ranked).agg(F.transform(items, lambda e: e["__v"]).alias(name))

    def distinct(self, name: str, a: Accumulator) -> DataFrame:
        df = self.df.select(*(["__id"] if self.keyed else []), typed(self.value(a.operand)).alias("__v"), self.order.alias("__o"))
        first = df.groupBy(*(["__id"] if self.keyed else []), "__v").agg(F.min("__o").alias("__o"))
        return self.grouped(first).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda e: e["__v"]).alias(name))


def group(rows: Rows, arg) -> DataFrame:
    key, accumulators = arg
    return Aggregates(rows, None if key is None else scalar(rows.scope, key)).build(accumulators)


def bucket(rows: Rows, arg) -> DataFrame:
    tree, bounds, (has_default, default), accumulators = arg
    v = scalar(rows.scope, tree).given()
    whole = all(isinstance(b, int) for b in bounds)
    kind = "long" if whole else "double"
    mixed = has_default and default is not None and (isinstance(default, (str, bool)))
    if has_default and isinstance(default, float):
        kind = "double"
    shown = (lambda x: F.lit(str(x))) if mixed else (lambda x: F.lit(x).cast(kind))
    out = F.when(F.lit(False), shown(bounds[0]))
    place = F.when(F.lit(False), F.lit(0))
    if v.kind == NUMBER and len(bounds) > MOST_CASES:
        edges = F.array(*(F.lit(b).cast(kind if whole else "double") for b in bounds))
        at = F.size(F.filter(edges, lambda b: b <= v.column))
        inside = (at > 0) & (at < len(bounds))
        found = F.get(edges, at - 1)
        out, place = out.when(inside, found.cast("string") if mixed else found.cast(kind)), place.when(inside, at - 1)
    elif v.kind == NUMBER:
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            inside = (v.column >= lo) & (v.column < hi)
            out, place = out.when(inside, shown(lo)), place.when(inside, F.lit(i))
    if not has_default:
        bad = F.raise_error(F.lit("a value lies outside the boundaries and $bucket has no default"))
        out, place = out.otherwise(bad.cast("string" if mixed else kind)), place.otherwise(F.lit(len(bounds)))
    else:
        last = F.lit(str(default).lower() if isinstance(default, bool) else default) if mixed else F.lit(default).cast(kind)
        out, place = out.otherwise(last), place.otherwise(F.lit(len(bounds)))
    df = rows.df.withColumn("__bucket", F.struct(place.alias("place"), out.alias("id")))
    t = df.schema["__bucket"].dataType
    grouped = Aggregates(Rows(df, rows.order), Value(F.col("__bucket"), t)).build(accumulators)
    return grouped.orderBy("_id.place").withColumn("_id", F.col("_id.id"))


def bucket_auto(rows: Rows, arg) -> DataFrame:
    tree, buckets, accumulators = arg
    v = scalar(rows.scope, tree).given()
    if v.kind != NUMBER:
        raise QueryError("$bucketAuto groups by numbers")
    wrong = F.raise_error(F.lit("$bucketAuto groups by numbers")).cast(v.type)
    df = rows.df.withColumn("__v", F.coalesce(v.column, wrong))
    values = df.select("__v").distinct()
    ranked, total = dense_rank(values, "__v", "__rank")
    if not total:
        return Aggregates(Rows(df.withColumn("__b", F.struct(F.col("__v").alias("min"), F.col("__v").alias("max"))), rows.order), Value(F.col("__b"), T.StructType([T.StructField("min", v.type), T.StructField("max", v.type)]))).build(accumulators)
    n = min(buckets, total)
    # the values of rank r fall into bucket floor(((r + 1) * n - 1) / total): sizes differ by one at most
    placed = ranked.withColumn("__b", F.floor(((F.col("__rank") + 1).cast("long") * n - 1) / F.lit(total)).cast("int"))
    edges = placed.groupBy("__b").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    following = edges.select((F.col("__b") - 1).alias("__b"), F.col("__lo").alias("__next"))
    edges = edges.join(following, "__b", "left").select("__b", F.col("__lo").alias("min"), F.coalesce("__next", "__hi").alias("max"))
    known = placed.join(edges, "__b").select(F.col("__v").alias("__value"), F.struct("min", "max").alias("__range"))
    met = df.join(known, df["__v"] == known["__value"]).drop("__value")
    out = Aggregates(Rows(met.drop("__v"), rows.order), Value(F.col("__range"), known.schema["__range"].dataType)).build(accumulators)
    return out.orderBy("_id.min")


def sort_by_count(rows: Rows, tree) -> DataFrame:
    key = scalar(rows.scope, tree).given()
    out = rows.df.groupBy(typed(key).alias("_id")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), F.to_json(F.struct("_id")))


def count(rows: Rows, name: str) -> DataFrame:
    return rows.df.agg(F.count(F.lit(1)).alias(name))


def distinct(rows: Rows, tree) -> DataFrame:
    v = scalar(rows.scope, tree).given()
    return rows.df.select(typed(v).alias("value")).distinct().orderBy(F.to_json(F.struct("value")))


TERMINALS = {"$group": group, "$bucket": bucket, "$bucketAuto": bucket_auto, "$sortByCount": sort_by_count, "$count": count, "$distinct": distinct}
