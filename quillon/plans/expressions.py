"""Expression documents to a small syntax tree."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..errors import QueryError

ARITHMETIC = ("$add", "$subtract", "$multiply", "$divide", "$mod")
ROUNDING = ("$abs", "$ceil", "$floor")


@dataclass(frozen=True)
class Field:
    path: str


@dataclass(frozen=True)
class Variable:
    name: str
    path: str | None


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Array:
    items: tuple


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


@dataclass(frozen=True)
class Bind:
    """$let, $map, $filter and $reduce: names bound around an inner expression."""

    op: str
    parts: dict


def parse_scalar(x: Any, numeric: bool = False):
    """numeric: an operand of a numeric operator, which takes numbers, references and numeric operators alone."""
    if isinstance(x, str):
        if x.startswith("$$"):
            name, _, path = x[2:].partition(".")
            if not name:
                raise QueryError("a variable needs a name")
            return Variable(name, path or None)
        if x.startswith("$"):
            if len(x) == 1:
                raise QueryError("a field reference needs a name")
            return Field(x[1:])
        if numeric:
            raise QueryError("a numeric operand can't be a string")
        return Literal(x)
    if numeric and (isinstance(x, (bool, list)) or x is None):
        raise QueryError("a numeric operand must be a number, a reference or a numeric operator")
    if x is None or isinstance(x, (bool, int, float)):
        return Literal(x)
    if isinstance(x, list):
        return Array(tuple(parse_scalar(i) for i in x))
    if not isinstance(x, dict) or len(x) != 1:
        raise QueryError("an expression object has one operator")
    ((op, arg),) = x.items()
    if op in ARITHMETIC:
        return Call(op, tuple(parse_scalar(i, True) for i in operands(op, arg, 2)))
    if op in ROUNDING:
        return Call(op, (parse_scalar(single(arg), True),))
    if numeric:
        raise QueryError(f"{op} isn't a numeric operator")
    if op == "$literal":
        return Literal(arg)
    if op == "$cond":
        if isinstance(arg, dict):
            if set(arg) != {"if", "then", "else"}:
                raise QueryError("$cond has the members if, then and else")
            arg = [arg["if"], arg["then"], arg["else"]]
        test, yes, no = operands(op, arg, 3)
        return Call(op, (parse_boolean(test), parse_scalar(yes), parse_scalar(no)))
    if op == "$ifNull":
        return Call(op, tuple(parse_scalar(i) for i in operands(op, arg, 2)))
    if op == "$concat":
        if not isinstance(arg, list) or len(arg) < 2:
            raise QueryError("$concat takes two operands at least")
        return Call(op, tuple(parse_scalar(i) for i in arg))
    if op in ("$toLower", "$toUpper", "$strLenCP"):
        return Call(op, (parse_scalar(single(arg)),))
    if op == "$substrCP":
        return Call(op, tuple(parse_scalar(i) for i in operands(op, arg, 3)))
    if op == "$split":
        a = operands(op, arg, 2)
        if a[1] == "":
            raise QueryError("$split needs a delimiter")
        return Call(op, tuple(parse_scalar(i) for i in a))
    if op == "$indexOfCP":
        if not isinstance(arg, list) or not 2 <= len(arg) <= 4:
            raise QueryError("$indexOfCP takes two to four operands")
        return Call(op, tuple(parse_scalar(i) for i in arg))
    if op in ("$replaceOne", "$replaceAll"):
        if not isinstance(arg, dict) or set(arg) != {"input", "find", "replacement"}:
            raise QueryError(f"{op} has the members input, find and replacement")
        if arg["find"] == "":
            raise QueryError(f"{op} needs something to find")
        return Call(op, tuple(parse_scalar(arg[k]) for k in ("input", "find", "replacement")))
    if op == "$let":
        if not isinstance(arg, dict) or set(arg) != {"vars", "in"} or not isinstance(arg["vars"], dict):
            raise QueryError("$let has the members vars and in")
        for name in arg["vars"]:
            variable_name(name)
        return Bind(op, {"vars": {k: parse_scalar(v) for k, v in arg["vars"].items()}, "in": parse_scalar(arg["in"])})
    if op in ("$map", "$filter", "$reduce"):
        return parse_array(op, arg)
    raise QueryError(f"unsupported expression operator: {op}")


def parse_array(op: str, arg: Any) -> Bind:
    needed, optional = {
        "$map": ({"input", "in"}, {"as", "arrayIndexAs"}),
        "$filter": ({"input", "cond"}, {"as", "arrayIndexAs", "limit"}),
        "$reduce": ({"input", "initialValue", "in"}, {"as", "valueAs", "arrayIndexAs"}),
    }[op]
    if not isinstance(arg, dict) or not needed <= set(arg) <= needed | optional:
        raise QueryError(f"{op} has the members {', '.join(sorted(needed))}, and may have {', '.join(sorted(optional))}")
    parts: dict[str, Any] = {"input": parse_scalar(arg["input"])}
    for k in ("as", "arrayIndexAs", "valueAs"):
        if k in arg:
            parts[k] = variable_name(arg[k])
    if op == "$filter":
        parts["cond"] = parse_boolean(arg["cond"])
        if arg.get("limit") is not None:
            if isinstance(arg["limit"], (int, float)) and (isinstance(arg["limit"], bool) or arg["limit"] != int(arg["limit"]) or arg["limit"] < 1):
                raise QueryError("the limit of $filter must be a positive integer")
            parts["limit"] = parse_scalar(arg["limit"])
    else:
        parts["in"] = parse_scalar(arg["in"])
    if op == "$reduce":
        parts["initialValue"] = parse_scalar(arg["initialValue"])
    return Bind(op, parts)


def variable_name(name: Any) -> str:
    if not isinstance(name, str) or not name or not name[0].isalpha() or not name[0].islower() or not all(c.isalnum() or c == "_" for c in name):
        raise QueryError(f"not a variable name: {name!r}")
    return name


def operands(op: str, arg: Any, n: int) -> list:
    if not isinstance(arg, list) or len(arg) != n:
        raise QueryError(f"{op} takes {n} operands")
    return arg


def single(arg: Any) -> Any:
    if isinstance(arg, list):
        if len(arg) != 1:
            raise QueryError("one operand is needed")
        return arg[0]
    return arg


def parse_boolean(x: Any):
    if isinstance(x, bool):
        return Literal(x)
    if not isinstance(x, dict) or len(x) != 1:
        raise QueryError("a boolean expression has one operator")
    ((op, arg),) = x.items()
    if op in ("$and", "$or"):
        if not isinstance(arg, list):
            raise QueryError(f"{op} takes an array")
        return Call(op, tuple(parse_boolean(i) for i in arg))
    if op == "$not":
        return Call(op, (parse_boolean(arg),))
    if op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
        return Call(op, tuple(parse_scalar(i) for i in operands(op, arg, 2)))
    raise QueryError(f"unsupported boolean operator: {op}")
