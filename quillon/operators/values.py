"""Typed values of documents: a column, its type, and whether it is present.

SQL NULL is the null of documents; a *missing* value is told apart by
`present`, which is a Python bool where the schema decides, else a column that
is never null.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

NUMBER, STRING, BOOLEAN, ARRAY, OBJECT, NULL, TIME = "number", "string", "boolean", "array", "object", "null", "time"


def kind_of(t: T.DataType | None) -> str:
    if t is None or isinstance(t, T.NullType):
        return NULL
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, T.ArrayType):
        return ARRAY
    if isinstance(t, (T.StructType, T.MapType)):
        return OBJECT
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIME
    raise QueryError(f"a column of type {t.simpleString()} can't be used")


@dataclass(frozen=True)
class Value:
    column: Column
    type: T.DataType | None
    present: Column | bool = True
    fanned: bool = False  # elements of several array members: one element stands for itself

    @property
    def kind(self) -> str:
        return kind_of(self.type)

    @property
    def is_present(self) -> Column:
        return F.lit(self.present) if isinstance(self.present, bool) else self.present

    def given(self) -> Value:
        """Null where missing."""
        return self if self.present is True else replace(self, column=F.when(self.is_present, self.column), present=True)


def missing() -> Value:
    return Value(F.lit(None), None, False)


def null() -> Value:
    return Value(F.lit(None), None, True)


def both(a: Column | bool, b: Column | bool) -> Column | bool:
    if a is True:
        return b
    if b is True:
        return a
    if a is False or b is False:
        return False
    return a & b


def sure(c: Column) -> Column:
    """c with null as false."""
    return F.coalesce(c, F.lit(False))


def literal(x: Any) -> Value:
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(x), T.BooleanType())
    if isinstance(x, int):
        if not -(2**63) <= x < 2**64:
            raise QueryError("an integer is out of range")
        return Value(F.lit(x), T.LongType()) if x < 2**63 else Value(F.lit(str(x)).cast("decimal(20,0)"), T.DecimalType(20, 0))
    if isinstance(x, float):
        return Value(F.lit(x), T.DoubleType())
    if isinstance(x, str):
        return Value(F.lit(x), T.StringType())
    if isinstance(x, list):
        items = [literal(i) for i in x]
        t = common_type([i.type for i in items])
        if t is None:
            return Value(F.array().cast("array<string>") if not items else F.array(*(F.lit(None).cast("string") for _ in items)), T.ArrayType(T.StringType()))
        return Value(F.array(*(i.column.cast(t) for i in items)), T.ArrayType(t))
    if isinstance(x, dict):
        items = {k: literal(v) for k, v in sorted(x.items())}
        if not items:
            return Value(F.struct(), T.StructType([]))
        return Value(F.struct(*(v.column.cast(v.type or T.StringType()).alias(k) for k, v in items.items())), T.StructType([T.StructField(k, v.type or T.StringType()) for k, v in items.items()]))
    raise QueryError(f"not a JSON value: {x!r}")


def common_type(types: list[T.DataType | None]) -> T.DataType | None:
    """The one type that holds all; None if all are null."""
    real = [t for t in types if t is not None and not isinstance(t, T.NullType)]
    if not real:
        return None
    if all(t == real[0] for t in real):
        return real[0]
    kinds = {kind_of(t) for t in real}
    if kinds == {NUMBER}:
        if all(isinstance(t, T.IntegralType) for t in real):
            return T.LongType()
        if all(isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0) for t in real):
            return T.DecimalType(20, 0)
        return T.DoubleType()
    if kinds == {STRING}:
        return T.StringType()
    if kinds == {ARRAY}:
        return T.ArrayType(common_type([t.elementType for t in real]) or T.StringType())
    raise QueryError("values of different types meet where one type is needed")


def resolve(schema: T.StructType, path: str, root: Column | None = None, presence: dict[str, Column] | None = None) -> Value:
    """The value at a path. An exact name wins over a dotted one; numbers index arrays, names fan out over them."""
    if path in schema.names:
        f = schema[path]
        column = root[path] if root is not None else F.col(f"`{path.replace('`', '``')}`")
        return Value(column, f.dataType, (presence or {}).get(path, True))
    parts = path.split(".")
    for n in range(len(parts) - 1, 0, -1):
        head = ".".join(parts[:n])
        if head in schema.names:
            return walk(resolve(schema, head, root, presence), parts[n:])
    return missing()


def walk(v: Value, parts: list[str]) -> Value:
    if not parts:
        return v
    t = v.type
    present = both(v.present, v.column.isNotNull())
    if isinstance(t, T.StructType):
        inner = resolve(t, ".".join(parts), v.column)
        return replace(inner, present=both(present, inner.present))
    if isinstance(t, T.MapType):
        found = both(present, sure(F.map_contains_key(v.column, F.lit(parts[0]))))
        return walk(Value(F.try_element_at(v.column, F.lit(parts[0])), t.valueType, found), parts[1:])
    if isinstance(t, T.ArrayType):
        if parts[0].isdigit():
            at = int(parts[0])
            return walk(Value(F.get(v.column, F.lit(at)), t.elementType, both(present, sure(F.size(v.column) > at))), parts[1:])
        inner = walk(Value(F.lit(None).cast(t.elementType), t.elementType), parts)
        if inner.present is False:
            return missing()
        items = F.filter(v.column, lambda e: sure(walk(Value(e, t.elementType), parts).is_present))
        column = F.transform(items, lambda e: walk(Value(e, t.elementType), parts).column)
        it = inner.type
        if inner.fanned or isinstance(it, T.ArrayType) and inner.fanned:
            column, it = F.flatten(column), it
            return Value(column, it, both(present, sure(F.size(column) > 0)), True)
        return Value(column, T.ArrayType(it or T.StringType()), both(present, sure(F.size(column) > 0)), True)
    return missing()


def comparable(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Columns to compare, if both are of one scalar kind; times compare with strings that name them."""
    x, y = a.kind, b.kind
    if x == y and x in (NUMBER, STRING, BOOLEAN, TIME):
        return a.column, b.column
    if {x, y} == {TIME, STRING}:
        return (a.column, F.try_to_timestamp(b.column).cast(a.type)) if x == TIME else (F.try_to_timestamp(a.column).cast(b.type), b.column)
    return None


def not_nan(v: Value) -> Column:
    """False for NaN, which documents don't have."""
    return ~F.isnan(v.column) if isinstance(v.type, (T.DoubleType, T.FloatType)) else F.lit(True)


def same(a: Value, b: Value) -> Column:
    """Structural equality of two values, nulls included; never null."""
    if a.kind == NULL or b.kind == NULL:
        return (a.column.isNull() if a.kind != NULL else F.lit(True)) & (b.column.isNull() if b.kind != NULL else F.lit(True))
    pair = comparable(a, b)
    if pair:
        return pair[0].eqNullSafe(pair[1])
    none = a.column.isNull() & b.column.isNull()
    if a.kind == b.kind == ARRAY:
        x, y = a.type.elementType, b.type.elementType
        each = F.forall(F.arrays_zip(a.column.alias("a"), b.column.alias("b")), lambda e: same(Value(e["a"], x), Value(e["b"], y)))
        return none | sure((F.size(a.column) == F.size(b.column)) & each)
    if a.kind == b.kind == OBJECT and isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        if set(a.type.names) != set(b.type.names):
            return none
        out = a.column.isNotNull() & b.column.isNotNull()
        for n in a.type.names:
            out = out & same(Value(a.column[n], a.type[n].dataType), Value(b.column[n], b.type[n].dataType))
        return none | sure(out)
    return none


def ordered(op: str, a: Value, b: Value) -> Column:
    """a < b, and so on, for values of one kind; false for others and, but for two nulls and an inclusive operator, for null. Never null."""
    inclusive = op in ("$gte", "$lte")
    both_null = (a.column.isNull() if a.kind != NULL else F.lit(True)) & (b.column.isNull() if b.kind != NULL else F.lit(True))
    pair = comparable(a, b)
    if not pair:
        return both_null if inclusive else F.lit(False)
    x, y = pair
    out = {"$gt": x > y, "$gte": x >= y, "$lt": x < y, "$lte": x <= y}[op]
    out = sure(out & not_nan(a) & not_nan(b))
    return out | both_null if inclusive else out
