"""Aggregation pipelines: lists of one-member stages to a validated plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..errors import QueryError
from .documents import check_filter, parse_projection, parse_sort, whole
from .expressions import Field, Literal, parse_scalar

ONCE = ("$set", "$project", "$sort", "$skip", "$limit")
TERMINALS = ("$group", "$bucket", "$bucketAuto", "$sortByCount", "$count", "$distinct")
ACCUMULATORS = ("$count", "$sum", "$avg", "$stdDevPop", "$stdDevSamp", "$min", "$max", "$minN", "$maxN", "$firstN", "$lastN", "$first", "$last", "$push", "$addToSet", "$mergeObjects")


@dataclass(frozen=True)
class Accumulator:
    op: str
    operand: Any = None  # a syntax tree
    n: Any = None


@dataclass(frozen=True)
class Pipeline:
    input: tuple[tuple[str, Any], ...]
    terminal: tuple[str, Any]
    output: tuple[tuple[str, Any], ...] = field(default_factory=tuple)


def parse_pipeline(stages) -> Pipeline:
    before, terminal, after, seen = [], None, [], set()
    order = ("$match", "$project", "$sort", "$skip", "$limit")
    for s in stages:
        if not isinstance(s, dict) or len(s) != 1:
            raise QueryError("a stage has one member")
        ((op, arg),) = s.items()
        op = "$set" if op == "$addFields" else op
        if op in TERMINALS:
            if terminal:
                raise QueryError("a pipeline has one grouping stage")
            terminal = (op, parse_terminal(op, arg))
        elif terminal is None:
            if op in ONCE:
                if op in seen:
                    raise QueryError(f"{op} may come once before the grouping stage")
                seen.add(op)
            before.append((op, parse_input(op, arg)))
        else:
            if terminal[0] in ("$count", "$distinct"):
                raise QueryError(f"nothing follows {terminal[0]}")
            if op not in order:
                raise QueryError(f"unsupported stage after grouping: {op}")
            if after and (order.index(op) < order.index(after[-1][0]) or (op == after[-1][0] and op != "$match")):
                raise QueryError(f"{op} is out of order after grouping")
            after.append((op, parse_input(op, arg)))
    if terminal is None:
        raise QueryError("a pipeline needs a grouping stage: " + ", ".join(TERMINALS))
    return Pipeline(tuple(before), terminal, tuple(after))


def parse_input(op: str, arg: Any) -> Any:
    if op == "$match":
        return check_filter(arg)
    if op == "$unwind":
        if isinstance(arg, str):
            arg = {"path": arg}
        if not isinstance(arg, dict) or set(arg) - {"path", "includeArrayIndex", "preserveNullAndEmptyArrays"} or "path" not in arg:
            raise QueryError("$unwind takes a path")
        path, index, keep = arg["path"], arg.get("includeArrayIndex"), arg.get("preserveNullAndEmptyArrays", False)
        if not isinstance(path, str) or not path.startswith("$") or "." in path or len(path) < 2:
            raise QueryError("$unwind takes the name of a top-level field, with $")
        if index is not None and (not isinstance(index, str) or not index or index.startswith("$") or index == path[1:]):
            raise QueryError("includeArrayIndex takes another field's name")
        if not isinstance(keep, bool):
            raise QueryError("preserveNullAndEmptyArrays takes a boolean")
        return path[1:], index, keep
    if op == "$set":
        if not isinstance(arg, dict) or not arg:
            raise QueryError("$set takes an object of expressions")
        for k in arg:
            if not k or k.startswith("$") or "." in k:
                raise QueryError(f"$set can't set {k!r}")
        return {k: parse_scalar(v) for k, v in arg.items()}
    if op == "$project":
        return parse_projection(arg, empty=False)
    if op == "$sort":
        sort = parse_sort(arg)
        if not sort:
            raise QueryError("$sort needs a field")
        return sort
    if op in ("$skip", "$limit"):
        return whole(arg, op)
    raise QueryError(f"unsupported aggregate stage: {op}")


def parse_terminal(op: str, arg: Any) -> Any:
    if op == "$group":
        if not isinstance(arg, dict) or "_id" not in arg:
            raise QueryError("$group needs _id")
        key = None if arg["_id"] is None else parse_scalar(arg["_id"])
        return key, accumulators({k: v for k, v in arg.items() if k != "_id"}, key)
    if op == "$bucket":
        if not isinstance(arg, dict) or not {"groupBy", "boundaries"} <= set(arg) <= {"groupBy", "boundaries", "default", "output"}:
            raise QueryError("$bucket has the members groupBy and boundaries, and may have default and output")
        bounds = arg["boundaries"]
        if not isinstance(bounds, list) or len(bounds) < 2 or any(isinstance(b, bool) or not isinstance(b, (int, float)) for b in bounds) or any(a >= b for a, b in zip(bounds, bounds[1:])):
            raise QueryError("boundaries are ascending numbers, two at least")
        if "default" in arg and isinstance(arg["default"], (dict, list)):
            raise QueryError("the default of $bucket must be a scalar")
        return parse_scalar(arg["groupBy"]), tuple(bounds), ("default" in arg, arg.get("default")), accumulators(arg.get("output", {"count": {"$count": {}}}), None)
    if op == "$bucketAuto":
        if not isinstance(arg, dict) or not {"groupBy", "buckets"} <= set(arg) <= {"groupBy", "buckets", "output"}:
            raise QueryError("$bucketAuto has the members groupBy and buckets, and may have output")
        buckets = whole(arg["buckets"], "buckets", 1)
        if buckets > 10_000:
            raise QueryError("buckets may be 10000 at most")
        return parse_scalar(arg["groupBy"]), buckets, accumulators(arg.get("output", {"count": {"$count": {}}}), None)
    if op == "$sortByCount":
        return parse_scalar(arg)
    if op == "$count":
        if not isinstance(arg, str) or not arg or arg.startswith("$") or "." in arg:
            raise QueryError("$count takes a field's name")
        return arg
    tree = parse_scalar(arg)
    if not isinstance(tree, Field):
        raise QueryError("$distinct takes a field")
    return tree


def accumulators(members: Any, key) -> dict[str, Accumulator]:
    if not isinstance(members, dict):
        raise QueryError("accumulators are members of an object")
    out = {}
    for name, x in members.items():
        if not name or name.startswith("$") or "." in name or name == "_id":
            raise QueryError(f"not a name for an accumulator: {name!r}")
        if not isinstance(x, dict) or len(x) != 1:
            raise QueryError(f"{name} needs one accumulator")
        ((op, arg),) = x.items()
        if op not in ACCUMULATORS:
            raise QueryError(f"unsupported accumulator: {op}")
        if op == "$count":
            if arg != {}:
                raise QueryError("$count takes {}")
            out[name] = Accumulator(op)
        elif op in ("$sum", "$avg", "$stdDevPop", "$stdDevSamp"):
            out[name] = Accumulator(op, parse_scalar(arg, True) if not isinstance(arg, dict) or next(iter(arg), "") not in ("$cond", "$ifNull") else parse_scalar(arg))
        elif op in ("$min", "$max", "$first", "$last", "$push", "$addToSet"):
            tree = parse_scalar(arg)
            if not isinstance(tree, Field):
                raise QueryError(f"{op} takes a field")
            out[name] = Accumulator(op, tree)
        elif op == "$mergeObjects":
            out[name] = Accumulator(op, parse_scalar(arg))
        else:
            if not isinstance(arg, dict) or set(arg) != {"input", "n"}:
                raise QueryError(f"{op} has the members input and n")
            n = arg["n"]
            if isinstance(n, (int, float)):
                if isinstance(n, bool) or n != int(n) or not 1 <= n <= 10_000:
                    raise QueryError("n must be an integer from 1 to 10000")
                n = Literal(int(n))
            else:
                n = parse_scalar(n)
                if key is None or n != key:
                    raise QueryError("n must be a constant or the group's _id")
            out[name] = Accumulator(op, parse_scalar(arg["input"]), n)
    return out
