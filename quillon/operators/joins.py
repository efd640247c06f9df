"""Equality joins of named tables, in chains. Columns of the result are named table.field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..limits import DEFAULT, Limits
from ..plans.documents import JoinDocument
from .expressions import Scope
from .filters import compile_filter
from .projection import project, quoted

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def marker(table: str) -> str:
    return f"__p_{table}"


def named(df: DataFrame, table: str, hidden: set[str]) -> DataFrame:
    """Columns as table.field, and a marker that tells rows of the table from padding."""
    return df.select(*(F.col(quoted(n)).alias(f"{table}.{n}") for n in df.columns if n not in hidden), F.lit(True).alias(marker(table)))


def execute(tables, doc: JoinDocument, hidden: set[str], limits: Limits = DEFAULT) -> DataFrame:
    """tables: a function from a name to its frame. Rows padded by an outer join lack that side's fields: they are missing, not null, to the filter."""
    out, seen, padded = named(tables(doc.table), doc.table, hidden), [doc.table], set()
    for s in doc.stages:
        right = named(tables(s.table), s.table, hidden)
        if s.kind == "cross":
            # a cross join is what the document asks for; its size is the product of the tables
            out = out.crossJoin(right)
        else:
            for a, b in s.on:
                if a not in out.columns or b not in right.columns:
                    raise QueryError(f"unknown join field: {a if a not in out.columns else b}")
            condition = reduce(lambda a, b: a & b, (out[quoted(a)] == right[quoted(b)] for a, b in s.on))
            out = out.join(right, condition, HOW[s.kind])
            if s.kind in ("left", "full"):
                padded.add(s.table)
            if s.kind in ("right", "full"):
                padded.update(seen)
        if s.kind not in ("semi", "anti"):
            seen.append(s.table)
        if limits.join_rows is not None:
            out = limits.check(out, "join_rows")
    marks = {marker(t) for t in seen}
    if padded:
        out = out.withColumns({marker(t): F.coalesce(marker(t), F.lit(False)) for t in padded})
    presence = {n: F.col(quoted(marker(t))) for t in padded for n in out.columns if n.startswith(f"{t}.")}
    if doc.filter:
        out = out.where(compile_filter(Scope(out.schema, presence=presence, hidden=frozenset(marks)), doc.filter, True))
    return project(out, doc.projection, marks)
