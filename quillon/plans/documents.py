"""Request documents: JSON text or dicts to validated dataclasses. No data is touched here."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from ..errors import QueryError
from ..limits import DEFAULT, Limits

COLLATIONS = ("unicode-lowercase", "unicode-nfkc-lowercase", "icu4x-2.1.1-ja", "icu4x-2.1.1-zh", "icu4x-2.1.1-ko")
COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
FIELD_OPERATORS = (*COMPARISONS, "$in", "$nin", "$exists", "$not", "$all", "$elemMatch", "$size")


@dataclass(frozen=True)
class QueryDocument:
    filter: dict = field(default_factory=dict)
    sort: tuple[tuple[str, int], ...] = ()
    projection: dict[str, int] = field(default_factory=dict)
    collation: str | None = None
    skip: int = 0
    limit: int | None = None
    page_size: int | None = None
    cursor: str | None = None
    aggregate: tuple[dict, ...] | None = None


@dataclass(frozen=True)
class JoinStage:
    table: str
    on: tuple[tuple[str, str], ...]  # (field of an earlier table, field of this one)
    kind: str


@dataclass(frozen=True)
class JoinDocument:
    table: str
    stages: tuple[JoinStage, ...]
    filter: dict = field(default_factory=dict)
    projection: dict[str, int] = field(default_factory=dict)


def loaded(document: str | bytes | dict, limits: Limits) -> dict:
    if isinstance(document, (str, bytes)):
        raw = document.encode() if isinstance(document, str) else document
        if limits.request_bytes is not None and len(raw) > limits.request_bytes:
            raise QueryError("the request is too large")
        try:
            document = json.loads(raw)
        except ValueError as e:
            raise QueryError(f"not JSON: {e}") from None
    if not isinstance(document, dict):
        raise QueryError("a request must be an object")
    return document


def whole(value: Any, what: str, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise QueryError(f"{what} must be an integer of at least {least}")
    return value


def parse_query(document: str | bytes | dict, limits: Limits = DEFAULT) -> QueryDocument:
    d = loaded(document, limits)
    known = {"filter", "sort", "projection", "collation", "skip", "limit", "page_size", "cursor", "aggregate"}
    if unknown := set(d) - known:
        raise QueryError(f"unknown members: {', '.join(sorted(unknown))}")
    q = QueryDocument(
        filter=check_filter(d.get("filter", {})),
        sort=parse_sort(d.get("sort", {})),
        projection=parse_projection(d.get("projection", {})),
        collation=d.get("collation"),
        skip=whole(d.get("skip", 0), "skip"),
        limit=whole(d["limit"], "limit") if d.get("limit") is not None else None,
        page_size=whole(d["page_size"], "page_size", 1) if d.get("page_size") is not None else None,
        cursor=d.get("cursor"),
        aggregate=tuple(d["aggregate"]) if isinstance(d.get("aggregate"), list) else None,
    )
    if "aggregate" in d and q.aggregate is None:
        raise QueryError("aggregate must be an array of stages")
    if q.collation is not None and q.collation not in COLLATIONS:
        raise QueryError(f"unknown collation: {q.collation}")
    if q.collation is not None and not q.sort:
        raise QueryError("collation needs sort")
    if q.page_size is not None and q.page_size > limits.page_size:
        raise QueryError(f"page_size may be {limits.page_size} at most")
    if q.cursor is not None and q.page_size is None:
        raise QueryError("cursor needs page_size")
    if q.page_size is not None and q.skip:
        raise QueryError("skip doesn't go with paging")
    if q.aggregate is not None:
        if set(d) - {"filter", "aggregate"}:
            raise QueryError("aggregate goes with filter alone")
        from .stages import parse_pipeline

        parse_pipeline(q.aggregate)
    return q


def parse_sort(sort: Any) -> tuple[tuple[str, int], ...]:
    if not isinstance(sort, dict):
        raise QueryError("sort must be an object")
    for f, way in sort.items():
        if isinstance(way, bool) or way not in (1, -1):
            raise QueryError(f"the direction of {f} must be 1 or -1")
    return tuple(sort.items())


def parse_projection(projection: Any, empty: bool = True) -> dict[str, int]:
    if not isinstance(projection, dict) or (not empty and not projection):
        raise QueryError("a projection must be an object" + ("" if empty else " with members"))
    ways = set()
    for f, way in projection.items():
        if isinstance(way, bool) or way not in (0, 1):
            raise QueryError(f"the projection of {f} must be 0 or 1")
        ways.add(way)
    if len(ways) > 1:
        raise QueryError("a projection can't include and exclude")
    return dict(projection)


def check_filter(f: Any) -> dict:
    """f, if it is a valid filter."""
    if not isinstance(f, dict):
        raise QueryError("a filter must be an object")
    for key, condition in f.items():
        if key in ("$and", "$or"):
            if not isinstance(condition, list):
                raise QueryError(f"{key} takes an array of filters")
            for x in condition:
                check_filter(x)
        elif key == "$not":
            check_filter(condition)
        elif key == "$expr":
            from .expressions import parse_boolean

            parse_boolean(condition)
        elif key.startswith("$"):
            raise QueryError(f"unsupported operator: {key}")
        else:
            check_condition(condition)
    return f


def is_operators(condition: Any) -> bool:
    """Whether a field's condition is an object of operators; any other object is a literal."""
    return isinstance(condition, dict) and any(k.startswith("$") for k in condition)


def check_condition(condition: Any) -> None:
    if not is_operators(condition):
        return
    for op, x in condition.items():
        if op not in FIELD_OPERATORS:
            raise QueryError(f"unsupported operator: {op}")
        if op in ("$in", "$nin", "$all") and not isinstance(x, list):
            raise QueryError(f"{op} takes an array")
        if op == "$exists" and not isinstance(x, bool):
            raise QueryError("$exists takes a boolean")
        if op == "$size":
            whole(x, "$size")
        if op == "$not":
            if not is_operators(x):
                raise QueryError("$not takes an object of operators")
            check_condition(x)
        if op == "$all":
            for c in x:
                if isinstance(c, dict) and "$elemMatch" in c:
                    check_condition(c)
        if op == "$elemMatch":
            if not isinstance(x, dict):
                raise QueryError("$elemMatch takes an object")
            check_condition(x) if is_operators(x) and not {"$and", "$or", "$expr"} & set(x) else check_filter(x)


KINDS = ("inner", "left", "right", "full", "semi", "anti", "cross")


def parse_join(document: str | bytes | dict, limits: Limits = DEFAULT) -> JoinDocument:
    """{"from": table, "join": {"table", "type", "on": {left: {"$eq": {"$field": right}}}}, "joins": [...], "filter", "projection"}."""
    d = loaded(document, limits)
    if unknown := set(d) - {"from", "join", "joins", "filter", "projection"}:
        raise QueryError(f"unknown members: {', '.join(sorted(unknown))}")
    table = d.get("from")
    if not isinstance(table, str) or not table:
        raise QueryError("from must name a table")
    raw = [d["join"]] if "join" in d else []
    raw += d.get("joins", [])
    if not raw:
        raise QueryError("a join needs a second table")
    if limits.join_stages is not None and len(raw) > limits.join_stages:
        raise QueryError(f"more than {limits.join_stages} joins")
    seen, stages = [table], []
    for j in raw:
        if not isinstance(j, dict) or set(j) - {"table", "type", "on"}:
            raise QueryError("a join has the members table, type and on")
        name, kind, on = j.get("table"), j.get("type", "inner"), j.get("on", {})
        if kind not in KINDS:
            raise QueryError(f"unknown join type: {kind}")
        if not isinstance(name, str) or name in seen:
            raise QueryError("each table is joined once, and not with itself")
        if not isinstance(on, dict) or (kind == "cross") != (not on):
            raise QueryError("on must be empty for cross joins, and for them alone")
        pairs = []
        for left, condition in on.items():
            try:
                ((op, ref),) = condition.items()
                ((word, right),) = ref.items()
                assert op == "$eq" and word == "$field" and isinstance(right, str)
            except (AttributeError, ValueError, AssertionError):
                raise QueryError('a join condition is {"$eq": {"$field": name}}') from None
            left, right = qualified(left, seen, table), qualified(right, [name], name)
            pairs.append((left, right))
        stages.append(JoinStage(name, tuple(pairs), kind))
        seen.append(name)
    for s in stages[:-1]:
        if s.kind in ("semi", "anti"):
            raise QueryError(f"a {s.kind} join can only be the last")
    return JoinDocument(table, tuple(stages), check_filter(d.get("filter", {})), parse_projection(d.get("projection", {})))


def qualified(name: str, tables: list[str], default: str) -> str:
    """table.field; a name without a table belongs to the default one."""
    head, dot, _ = name.partition(".")
    if dot and head in tables:
        return name
    if dot and head not in tables:
        raise QueryError(f"{name} names no table joined so far")
    return f"{default}.{name}"
