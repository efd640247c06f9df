"""Row order as columns: sort keys, and one comparable column for ordered accumulators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.values import ARRAY, NUMBER, OBJECT, STRING, TIME, Value, kind_of


@dataclass(frozen=True)
class Key:
    name: str  # a column
    up: bool = True


def sort_key(v: Value) -> Column:
    """Nulls first; arrays and objects by their JSON text."""
    c = v.given().column
    return F.to_json(F.struct(c.alias("v"))) if v.kind in (ARRAY, OBJECT) else c


def columns(order: list[Key]) -> list[Column]:
    return [F.col(f"`{k.name}`").asc() if k.up else F.col(f"`{k.name}`").desc() for k in order]


def comparable(schema: T.StructType, order: list[Key]) -> Column:
    """A struct that sorts ascending as the order does."""
    parts = []
    for i, k in enumerate(order):
        c, t = F.col(f"`{k.name}`"), schema[k.name].dataType
        if not k.up:
            parts.append(c.isNull().alias(f"n{i}"))
            c = reversed_key(c, t)
        parts.append(c.alias(f"k{i}"))
    return F.struct(*parts)


def reversed_key(c: Column, t: T.DataType) -> Column:
    kind = kind_of(t)
    if kind == NUMBER:
        return -c
    if kind == TIME:
        return -F.unix_micros(c.cast("timestamp"))
    if kind == STRING:
        # code points negated; the end stands above all of them, so that a longer string comes first
        return F.concat(F.transform(F.split(c, ""), lambda x: -F.ascii(x)), F.array(F.lit(1)))
    return ~c


def dense_rank(df, value: str, out: str, parts: int = 64):
    """df of distinct non-null numbers with their rank from 0, without a window over all rows: ranks within ranges, plus the counts before."""
    from pyspark.sql import Window as W

    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    ranged = df.withColumn("__part", F.size(F.filter(bounds, lambda b: b < F.col(value).cast("double"))))
    sizes = {r[0]: r[1] for r in ranged.groupBy("__part").count().collect()}  # at most `parts` rows
    before, total = [], 0
    for p in sorted(sizes):
        before += [F.lit(p), F.lit(total)]
        total += sizes[p]
    base = F.create_map(*before)[F.col("__part")] if before else F.lit(0)
    return ranged.withColumn(out, base + F.row_number().over(W.partitionBy("__part").orderBy(value)) - 1).drop("__part"), total
