"""Expression trees to typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans import expressions as E
from .values import ARRAY, NULL, NUMBER, STRING, Value, both, common_type, literal, missing, null, ordered, resolve, same, walk


@dataclass(frozen=True)
class Scope:
    """Where names are looked up: a row's fields and bound variables."""

    schema: T.StructType
    root: Column | None = None
    presence: dict[str, Column] = field(default_factory=dict)
    variables: dict[str, Value] = field(default_factory=dict)
    hidden: frozenset = frozenset()

    def bound(self, **more: Value) -> Scope:
        return replace(self, variables=self.variables | more)

    def row(self) -> Value:
        names = [n for n in self.schema.names if n not in self.hidden]
        t = T.StructType([self.schema[n] for n in names])
        return Value(F.struct(*(resolve(self.schema, n, self.root).column.alias(n) for n in names)), t)

    def variable(self, name: str, path: str | None) -> Value:
        if name in self.variables:
            v = self.variables[name]
        elif name in ("ROOT", "CURRENT"):
            if path:
                return resolve(self.schema, path, self.root, self.presence)
            return self.row()
        else:
            raise QueryError(f"unbound variable: {name}")
        return walk(v, path.split(".")) if path else v


def boolean(s: Scope, x) -> Column:
    """Never null."""
    if isinstance(x, E.Literal):
        return F.lit(x.value)
    if x.op == "$and":
        return reduce(lambda a, b: a & b, (boolean(s, i) for i in x.args), F.lit(True))
    if x.op == "$or":
        return reduce(lambda a, b: a | b, (boolean(s, i) for i in x.args), F.lit(False))
    if x.op == "$not":
        return ~boolean(s, x.args[0])
    a, b = (scalar(s, i) for i in x.args)
    if a.present is False or b.present is False:
        return F.lit(False)
    out = same(a, b) if x.op == "$eq" else ~same(a, b) if x.op == "$ne" else ordered(x.op, a, b)
    present = both(a.present, b.present)
    return out if present is True else present & out


def scalar(s: Scope, x) -> Value:
    if isinstance(x, E.Field):
        return resolve(s.schema, x.path, s.root, s.presence)
    if isinstance(x, E.Variable):
        return s.variable(x.name, x.path)
    if isinstance(x, E.Literal):
        return literal(x.value)
    if isinstance(x, E.Array):
        return array([scalar(s, i) for i in x.items])
    if isinstance(x, E.Bind):
        return bind(s, x)
    return call(s, x)


def array(items: list[Value]) -> Value:
    t = common_type([i.type for i in items]) or T.StringType()
    if not items:
        return Value(F.array().cast(T.ArrayType(t)), T.ArrayType(t))
    return Value(F.array(*(i.given().column.cast(t) for i in items)), T.ArrayType(t))


def choose(test: Column, yes: Value, no: Value) -> Value:
    t = common_type([yes.type, no.type])
    if t is None:
        return null()
    present: Column | bool = True
    if yes.present is not True or no.present is not True:
        present = F.when(test, yes.is_present).otherwise(no.is_present)
    return Value(F.when(test, yes.column.cast(t)).otherwise(no.column.cast(t)), t, present)


def call(s: Scope, x: E.Call) -> Value:
    op = x.op
    if op == "$cond":
        return choose(boolean(s, x.args[0]), scalar(s, x.args[1]), scalar(s, x.args[2]))
    args = [scalar(s, i) for i in x.args]
    if op == "$ifNull":
        a, b = args
        if a.kind == NULL or a.present is False:
            return b
        return choose(a.is_present & a.column.isNotNull(), a, b)
    if op in E.ARITHMETIC or op in E.ROUNDING:
        return numeric(op, args)
    return string(op, args)


def numeric(op: str, args: list[Value]) -> Value:
    if any(a.kind != NUMBER for a in args):
        return missing()
    present = reduce(both, (both(a.present, a.column.isNotNull()) for a in args))
    whole = all(is_whole(a.type) for a in args)
    # unsigned 64-bit numbers are exact decimals; a result beyond 20 digits is an error
    wide = whole and any(isinstance(a.type, T.DecimalType) for a in args)
    kind = UNSIGNED if wide else T.LongType() if whole else T.DoubleType()
    c = [a.column.cast(kind) for a in args]
    if op == "$abs":
        return Value(F.abs(c[0]).cast(kind), kind, present)
    if op in ("$ceil", "$floor"):
        if whole:
            return Value(c[0], kind, present)
        # beyond 2**63 every double is whole already, and a long can't hold it
        out = F.ceil(c[0]) if op == "$ceil" else F.floor(c[0])
        return Value(F.when(F.abs(c[0]) < 2.0**63, out.cast("double")).otherwise(c[0]), T.DoubleType(), present)
    if op == "$divide":
        zero = F.raise_error(F.lit("division by zero"))
        a, b = (i.cast("double") for i in c)
        return Value(F.when(b == 0, zero.cast("double")).otherwise(a / b), T.DoubleType(), present)
    if op == "$mod":
        zero = F.raise_error(F.lit("remainder of a division by zero"))
        return Value(F.when(c[1] == 0, zero.cast(kind)).otherwise((c[0] % c[1]).cast(kind)), kind, present)
    out = {"$add": lambda: c[0] + c[1], "$subtract": lambda: c[0] - c[1], "$multiply": lambda: c[0] * c[1]}[op]()
    return Value(out.cast(kind), kind, present)


UNSIGNED = T.DecimalType(20, 0)


def is_whole(t: T.DataType | None) -> bool:
    return isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0)


def required(v: Value, what: str) -> Column:
    """The string, or an error at run time where it is null or missing."""
    if v.kind != STRING or v.present is False:
        return F.raise_error(F.lit(f"{what} needs a string")).cast("string")
    c = v.given().column
    return F.when(c.isNull(), F.raise_error(F.lit(f"{what} needs a string")).cast("string")).otherwise(c)


def string(op: str, args: list[Value]) -> Value:
    if op == "$strLenCP":
        return Value(F.char_length(required(args[0], op)).cast("long"), T.LongType())
    if op == "$split":
        by = required(args[1], op)
        by = F.when(by == "", F.raise_error(F.lit("$split needs a delimiter")).cast("string")).otherwise(by)
        # a quoted pattern; the end of quoting within the delimiter is spelled out
        quoted = F.concat(F.lit("\\Q"), F.replace(by, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        return Value(F.split(required(args[0], op), quoted, -1), T.ArrayType(T.StringType()))
    if op == "$substrCP":
        v, start, count = args
        if v.present is False or v.kind == NULL:
            return literal("")
        if v.kind != STRING or start.kind != NUMBER or count.kind != NUMBER:
            raise QueryError("$substrCP takes a string and two integers")
        bad = (start.column < 0) | (count.column < 0)
        out = F.substring(v.given().column, (start.column + 1).cast("int"), count.column.cast("int"))
        return Value(F.when(bad, F.raise_error(F.lit("$substrCP takes no negative numbers")).cast("string")).otherwise(F.coalesce(out, F.lit(""))), T.StringType())
    if any(a.present is False for a in args) or any(a.kind != STRING for a in args[: 2 if op == "$indexOfCP" else 3]):
        return null() if op in ("$indexOfCP", "$replaceOne", "$replaceAll") else missing()
    if op == "$concat":
        present = reduce(both, (both(a.present, a.column.isNotNull()) for a in args))
        return Value(F.concat(*(a.column for a in args)), T.StringType(), present)
    if op in ("$toLower", "$toUpper"):
        a = args[0]
        return Value(F.lower(a.column) if op == "$toLower" else F.upper(a.column), T.StringType(), both(a.present, a.column.isNotNull()))
    if op == "$indexOfCP":
        return Value(index_of(*(a.given().column for a in args)).cast("long"), T.LongType())
    text, find, new = (a.given().column for a in args)
    empty = F.when(find == "", F.raise_error(F.lit(f"{op} needs something to find")).cast("string"))
    if op == "$replaceAll":
        return Value(empty.otherwise(F.replace(text, find, new)), T.StringType())
    at = F.position(find, text)
    once = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.char_length(find), F.char_length(text)))
    return Value(empty.when(at == 0, F.when(new.isNotNull(), text)).otherwise(once), T.StringType())


def index_of(text: Column, find: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Place of the first occurrence in [start, end), or -1; null where the text is null."""
    n = F.char_length(text)
    start = F.lit(0) if start is None else start.cast("int")
    end = n if end is None else F.least(end.cast("int"), n)
    bad = (start < 0) | (end < 0)
    part = F.substring(text, F.lit(1), end)
    at = F.position(find, part, start + 1) - 1
    at = F.when((start > end), F.lit(-1)).when(find == "", start).otherwise(at)
    return F.when(bad, F.raise_error(F.lit("$indexOfCP takes no negative numbers")).cast("int")).otherwise(at)


def array_input(v: Value, op: str) -> Value | None:
    if v.present is False or v.kind == NULL:
        return None
    if v.kind != ARRAY:
        raise QueryError(f"{op} takes an array")
    return v.given()


def bind(s: Scope, x: E.Bind) -> Value:
    p = x.parts
    if x.op == "$let":
        return scalar(s.bound(**{k: scalar(s, v) for k, v in p["vars"].items()}), p["in"])
    v = array_input(scalar(s, p["input"]), x.op)
    if v is None:
        return null()
    e, index = v.type.elementType, p.get("arrayIndexAs", "IDX")
    if x.op == "$reduce":
        return reduced(s, v, x)
    name = p.get("as", "this")

    def inner(c: Column, i: Column) -> Scope:
        return s.bound(**{name: Value(c, e), index: Value(i.cast("long"), T.LongType())})

    if x.op == "$map":
        t = scalar(inner(F.lit(None).cast(e), F.lit(0)), p["in"]).type or T.StringType()
        return Value(F.transform(v.column, lambda c, i: scalar(inner(c, i), p["in"]).given().column.cast(t)), T.ArrayType(t))
    out = F.filter(v.column, lambda c, i: boolean(inner(c, i), p["cond"]))
    if "limit" in p:
        n = scalar(s, p["limit"])
        if n.kind == NUMBER:
            out = F.when(n.column.isNull(), out).when(n.column < 1, F.raise_error(F.lit("the limit of $filter must be a positive integer")).cast(v.type)).otherwise(F.slice(out, F.lit(1), n.column.cast("int")))
    return Value(out, v.type)


def reduced(s: Scope, v: Value, x: E.Bind) -> Value:
    p = x.parts
    start = scalar(s, p["initialValue"]).given()
    this, value, index = p.get("as", "this"), p.get("valueAs", "value"), p.get("arrayIndexAs", "IDX")
    e = v.type.elementType

    def step(acc: Value, c: Column, i: Column) -> Value:
        return scalar(s.bound(**{this: Value(c, e), value: acc, index: Value(i.cast("long"), T.LongType())}), p["in"]).given()

    t = start.type
    for _ in range(3):  # the type of the value may widen once it is combined with elements
        new = common_type([t, step(Value(F.lit(None).cast(t or T.StringType()), t or T.StringType()), F.lit(None).cast(e), F.lit(0)).type])
        if new == t:
            break
        t = new
    t = t or T.StringType()
    pairs = F.transform(v.column, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return Value(F.aggregate(pairs, start.column.cast(t), lambda a, z: step(Value(a, t), z["c"], z["i"]).column.cast(t)), t)
