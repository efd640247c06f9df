"""Filters to boolean columns that are never null."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.documents import is_operators
from .expressions import Scope, boolean
from .values import ARRAY, Value, comparable, literal, not_nan, ordered, resolve, same, sure


def compile_filter(scope: Scope, f: dict, loose: bool = False) -> Column:
    """loose: null may stand for false, as in a WHERE; such comparisons reach the scan, guarded ones don't."""
    parts = []
    for key, condition in f.items():
        if key == "$and":
            parts += [compile_filter(scope, x, loose) for x in condition]
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, (compile_filter(scope, x) for x in condition), F.lit(False)))
        elif key == "$not":
            parts.append(~compile_filter(scope, condition))
        elif key == "$expr":
            from ..plans.expressions import parse_boolean

            parts.append(boolean(scope, parse_boolean(condition)))
        else:
            parts.append(matches(resolve(scope.schema, key, scope.root, scope.presence), condition, loose))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def matches(v: Value, condition: Any, loose: bool = False) -> Column:
    if not is_operators(condition):
        return equal(v, condition)
    return reduce(lambda a, b: a & b, (operator(v, op, x, loose) for op, x in condition.items()))


def operator(v: Value, op: str, x: Any, loose: bool = False) -> Column:
    if op == "$eq":
        return equal(v, x)
    if op == "$ne":
        return ~equal(v, x)
    if op == "$in":
        return member(v, x, loose)
    if op == "$nin":
        return ~member(v, x)
    if op == "$exists":
        return v.is_present if x else ~v.is_present
    if op == "$not":
        return ~matches(v, x)
    if v.present is False:
        return F.lit(False)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if loose and v.present is True and v.kind != ARRAY and x is not None:
            pair = comparable(v, literal(x))
            if not pair:
                return F.lit(False)
            out = {"$gt": pair[0] > pair[1], "$gte": pair[0] >= pair[1], "$lt": pair[0] < pair[1], "$lte": pair[0] <= pair[1]}[op]
            return out & not_nan(v) if op in ("$gt", "$gte") else out  # NaN is above all numbers
        return v.is_present & compared(v, op, x)
    if op == "$size":
        return array_present(v) & sure(F.size(v.column) == x) if v.kind == ARRAY else F.lit(False)
    if op == "$all":
        if v.kind != ARRAY or not x:
            return F.lit(False)
        each = [any_element(v, c["$elemMatch"]) if isinstance(c, dict) and set(c) == {"$elemMatch"} else contains(v, c) for c in x]
        return array_present(v) & reduce(lambda a, b: a & b, each)
    return array_present(v) & any_element(v, x) if v.kind == ARRAY else F.lit(False)


def array_present(v: Value) -> Column:
    """Whether the value is an array; a fanned-out one of one element stands for that element."""
    return v.is_present & sure(F.size(v.column) > 1) if v.fanned else v.is_present & v.column.isNotNull()


def equal(v: Value, x: Any) -> Column:
    if v.present is False:
        return F.lit(False)
    if v.kind == ARRAY:
        whole = sure(same(v, literal(x))) if isinstance(x, list) or x is None and not v.fanned else F.lit(False)
        return v.is_present & (whole | contains(v, x))
    return v.is_present & same(v, literal(x))


def contains(v: Value, x: Any) -> Column:
    e = v.type.elementType
    return sure(F.exists(v.column, lambda y: same(Value(y, e), literal(x))))


def member(v: Value, items: list, loose: bool = False) -> Column:
    plain = [x for x in items if isinstance(x, (str, int, float)) and not isinstance(x, bool)]
    if v.present is False or not items:
        return F.lit(False)
    # literals of the column's own kind in one membership test
    kind = {"number": (int, float), "string": (str,)}.get(v.kind)
    if kind and len(plain) > 4:
        own = [x for x in plain if isinstance(x, kind)]
        rest = [x for x in items if x not in own or isinstance(x, bool)]
        if own and not rest and loose and v.present is True:
            return v.column.isin(own)
        out = sure(v.column.isin(own)) if own else F.lit(False)
        return v.is_present & reduce(lambda a, b: a | b, (equal(v, x) for x in rest), out)
    return reduce(lambda a, b: a | b, (equal(v, x) for x in items))


def compared(v: Value, op: str, x: Any) -> Column:
    if v.kind == ARRAY:
        e = v.type.elementType
        out = sure(F.exists(v.column, lambda y: ordered(op, Value(y, e), literal(x))))
        # a null in place of an array compares as null does
        return out | v.column.isNull() if x is None and op in ("$gte", "$lte") and not v.fanned else out
    return ordered(op, v, literal(x))


def any_element(v: Value, condition: dict) -> Column:
    """Whether one element satisfies the whole condition; {} is satisfied by any."""
    e = v.type.elementType
    if not condition:
        return sure(F.size(v.column) > 0)
    if is_operators(condition) and not {"$and", "$or", "$expr"} & set(condition):
        return sure(F.exists(v.column, lambda y: matches(Value(y, e), condition)))
    if not isinstance(e, T.StructType):
        return F.lit(False)
    return sure(F.exists(v.column, lambda y: y.isNotNull() & compile_filter(Scope(e, y), condition)))
